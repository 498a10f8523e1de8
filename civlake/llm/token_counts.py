"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; each distinct piece is merged once. All pre-tokens of a batch lie in
one ragged numpy array of symbols. In each round every sequence finds its lowest-rank adjacent pair and
all its places are merged at once; a sequence without a pair is done, and what is left of its symbols is its count.
A merge that contains a pair's product always ranks after the pair, so that merging all places at once
gives what merging them one by one gives.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.llm.chunks import PRETOKEN, Known, chunks
from civlake.llm.common import documents, slices, utf8

NEVER = np.int32(2**31 - 1)


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of that name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}


class RankMerger:
    """The merges of a byte-level BPE vocabulary as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.of_byte = np.zeros(256, np.int32)
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = vocab[letter]
        # symbols are numbered by the vocabulary; a pair's key holds both
        left = np.array([vocab[a] for a, _ in merges], np.uint64)
        right = np.array([vocab[b] for _, b in merges], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.keys = left << np.uint64(32) | right
        self._build()

    def _build(self) -> None:
        """Two direct tables from a pair's key to its rank: the second holds the few pairs whose place in the first is taken."""
        self.bits = (22, 14)
        n = len(self.keys)
        self.tables, rest = [], np.arange(n)
        for level, bits in enumerate(self.bits):
            factor = np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[level])
            while True:
                at = (self.keys[rest] * factor) >> np.uint64(64 - bits)
                _, first = np.unique(at, return_index=True)
                if level == 0 or len(first) == len(rest):
                    break
                factor += np.uint64(2)
            table = np.full(1 << bits, -1, np.int32)
            table[at[first]] = rest[first]
            self.tables.append((factor, np.uint64(64 - bits), table))
            rest = np.setdiff1d(rest, rest[first])

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair; NEVER where there is no merge."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = np.full(len(key), NEVER, np.int32)
        for factor, shift, table in self.tables:
            found = table[(key * factor) >> shift]
            hit = (found >= 0) & (self.keys[found] == key)
            out[hit] = found[hit]
        return out

    def merged_lengths(self, data: bytes, lengths: np.ndarray) -> np.ndarray:
        """The number of symbols left of each of the sequences (none empty) that lie one behind another in data."""
        symbols = self.of_byte[np.frombuffer(data, np.uint8)]
        lengths = lengths.astype(np.int64)
        out, ids = lengths.copy(), np.arange(len(lengths))
        while len(ids):
            ends = np.cumsum(lengths)
            rank = np.full(len(symbols), NEVER, np.int32)
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[ends - 1] = NEVER
            lowest = np.minimum.reduceat(rank, ends - lengths)
            alive = lowest < NEVER
            out[ids[~alive]] = lengths[~alive]
            if not alive.all():
                keep = np.repeat(alive, lengths)
                symbols, rank = symbols[keep], rank[keep]
                ids, lengths, lowest = ids[alive], lengths[alive], lowest[alive]
                if not len(ids):
                    break
            hit = rank == np.repeat(lowest, lengths)
            # of places that overlap (a run of one symbol), every second one is merged, from the left
            at = np.flatnonzero(hit)
            if len(at) > 1:
                new_run = np.ones(len(at), bool)
                new_run[1:] = np.diff(at) > 1
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            lengths = lengths - np.add.reduceat(gone.astype(np.int64), np.cumsum(lengths) - lengths)
            symbols = symbols[~gone]
        return out

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece of text."""
        tokens = [PRETOKEN.findall(p) for p in pieces]
        flat = [t.encode("utf-8", "replace") for ts in tokens for t in ts]
        if not flat:
            return [0] * len(pieces)
        each = self.merged_lengths(b"".join(flat), np.fromiter(map(len, flat), np.int64, len(flat)))
        upto = np.concatenate([[0], np.cumsum(each)])
        bounds = np.cumsum([0, *map(len, tokens)])
        return (upto[bounds[1:]] - upto[bounds[:-1]]).tolist()


@lru_cache(maxsize=2)
def _merger(name: str) -> tuple[RankMerger, Known]:
    merger = RankMerger(tokenizer_path(name))
    return merger, Known(merger.counts)


def count_texts(texts: list[str], name: str = "byte_bpe_50k.json") -> list[int]:
    """Tokens of each text; a special token's string in a text is that one token, as the library has it."""
    merger, known = _merger(name)
    parts, counts = [], []
    for t in texts:
        special, own = 0, [t]
        for s in merger.special:
            if s in t:
                own = [x for o in own for x in o.split(s)]
        special = len(own) - 1
        own = [chunks(o) for o in own if o]
        parts.append(own)
        counts.append(special)
    first, later = known.look([c for own in parts for c in own])
    return [n + sum(first[c[0]] + sum(map(later.__getitem__, c[1:])) for c in own) for n, own in zip(counts, parts, strict=True)]


def token_counts(docs: DataFrame, limit: int = 512, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs.

    Null texts count as empty (0 bytes, 0 tokens); ids may be null or repeat; an empty table gives
    an empty result; other columns of docs are not carried.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                _, offsets = utf8(b.column("text"))
                n = pa.array(count_texts([t or "" for t in b.column("text").to_pylist()], tokenizer), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), n], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, against a limit of 512."""
    return token_counts(documents(spark, sf_dir))
