"""SentencePiece encoding and decoding by a streaming Viterbi with backpointers.

For a BPE model every prefix of a text has one encoding, so the lattice keeps one surviving path for
each end position: the piece that ends there and goes on from the path at its start without the
model merging across the border. Pieces are at most `longest` characters, so only that many ends can
still be extended; whenever all their backpointer paths meet at one boundary, the ids up to it are
committed and forgotten.

Where two neighbouring characters stand together in no piece, no edge of the lattice crosses: all surviving
paths meet there, whatever came before. These boundaries are found for a whole batch at once and cut
it into lanes, mostly words. Equal lanes are encoded once; lanes of up to LANE characters run through the
lattice side by side in numpy, one start position after another; longer ones, which have no such boundary, stream through
a window of some multiples of `longest` and commit where their paths meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civlake.llm.common import documents, slices
from civlake.llm.token_counts import tokenizer_path

SPACE_MARK = "▁"
#: A rank behind all others, and the rank from which scores say no order.
NEVER, UNRANKED = float("inf"), 1e8
#: Characters of a lane that is held whole; bytes of text encoded together; characters of a text normalised together; bits of the slots for pairs of pieces.
LANE, SLICE, STRETCH, PAIR_BITS = 64, 2 << 20, 1 << 20, 20
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_UNICODE = 0x110000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all stretches [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class PieceModel:
    """The pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.bytes = {int(_BYTE.fullmatch(p)[1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        self.lengths = np.array([len(p) for p in self.pieces])
        of_byte = {i: bytes([b]) for b, i in self.bytes.items()}
        self.spelling = pa.array([b"" if sp.is_control(i) else of_byte.get(i, p.encode()) for i, p in enumerate(self.pieces)], pa.binary())
        self.normalize = sp.normalize
        # whether a text may be normalised in stretches: each begins behind a space, which the model puts in front of any text
        self.in_stretches = all(sp.normalize(f"{a} {b}") == sp.normalize(a) + sp.normalize(b) for a, b in (("a", "b"), ("a,", "b"), ("a\n", "b")))
        self.edges: dict = {}
        self.pairs = np.full(1 << PAIR_BITS, -1)
        self.early, self.widest = 0, 0
        self._tables()

    def _tables(self) -> None:
        """Pieces as a tree of characters, in arrays, and which characters stand next to each other in some piece."""
        joint = sorted({c for p in self.ids if len(p) > 1 for c in p})
        alone = sorted({c for p in self.ids for c in p}.difference(joint))
        order = {c: i + 1 for i, c in enumerate(joint + alone)}
        self.letter = np.zeros(_UNICODE, np.uint16)  # 0: in no piece
        self.letter[[ord(c) for c in order]] = list(order.values())
        self.joint = np.zeros(_UNICODE, np.uint16)  # 0: in no piece of several characters
        self.joint[[ord(c) for c in joint]] = [order[c] for c in joint]
        self.n_joint, self.n_letters = len(joint) + 1, len(order) + 1
        link = np.zeros((self.n_joint, self.n_joint), bool)
        children: dict[int, int] = {}
        ends = [-1]
        for piece, i in self.ids.items():
            for a, b in pairwise(piece):
                link[order[a], order[b]] = True
            node = 0
            for c in piece:
                node = children.setdefault(node * self.n_letters + order[c], len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.link = link.ravel()
        self.ends = np.array(ends, np.int32)
        # slots by hash, each probed `probes` times at most
        keys, nodes = np.array(list(children), np.int64), np.array(list(children.values()), np.int32)
        bits = max(8, int(len(keys)).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.slot_key, self.slot_node = np.full((1 << bits) + 64, -1), np.full((1 << bits) + 64, -1, np.int32)
        self.probes = 0
        while len(keys):
            at = (keys.astype(np.uint64) * _A >> self.shift).astype(np.int64) + self.probes
            free = self.slot_key[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_node[at[put]] = keys[put], nodes[put]
            keys, nodes = keys[~put], nodes[~put]
            self.probes += 1

    def _step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, -1 if it has none."""
        key = node * np.int64(self.n_letters) + letter
        at = (key.astype(np.uint64) * _A >> self.shift).astype(np.int64)
        found = np.where(self.slot_key[at] == key, self.slot_node[at], -1)
        for probe in range(1, self.probes):
            left = np.flatnonzero((found < 0) & (letter > 0))
            near = at[left] + probe
            hit = self.slot_key[near] == key[left]
            found[left[hit]] = self.slot_node[near[hit]]
        return found

    def _simulated(self, text: str) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """What the model makes of a text by merging the best-scored pair again and again (the leftmost of equals), and the merges it made."""
        parts, made = list(text), {}
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return parts, made
            i = -best[1]
            made[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _edges(self, piece: str) -> tuple[list, list]:
        """The symbols that stand at a piece's left and right edge while it is built: (symbol, rank that makes it, rank that absorbs it)."""
        if piece not in self.edges:
            parts, made = self._simulated(piece)
            out = []
            for side in (0, 1):
                symbol, until, edge = piece, NEVER, []
                while True:
                    own = -self.scores.get(symbol, 0.0) if symbol in made else -1.0
                    edge.append((symbol, own, until))
                    if symbol not in made:
                        break
                    symbol, until = made[symbol][side], own
                out.append(edge)
            odd = parts != [piece] or any(own >= until or own >= UNRANKED for edge in out for _, own, until in edge)
            self.edges[piece] = None if odd else tuple(out)
        return self.edges[piece]

    def _follows(self, u: str, t: str) -> bool:
        """Whether the model encodes u + t as these two pieces.

        It does unless, at some rank, the symbols at the border are both there and their own merge comes
        first: before what absorbs the left one, and no later than what absorbs the right one.
        """
        left, right = self._edges(u), self._edges(t)
        if left is None or right is None:
            return self._simulated(u + t)[0] == [u, t]
        scores = self.scores
        for a, a_made, a_gone in left[1]:
            for b, b_made, b_gone in right[0]:
                score = scores.get(a + b)
                if score is not None and -score < a_gone and -score <= b_gone and a_made < b_gone and b_made < a_gone:
                    return False
        return True

    def follow(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """_follows of pairs of ids; what is worked out stays in a table of fixed size. Anything may follow a u outside the vocabulary."""
        good = u >= self.size
        key = u * np.int64(self.size) + t
        at = (key.astype(np.uint64) * _A >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        entry = self.pairs[at]
        known = entry >> 1 == key
        good |= known & (entry & 1 == 1)
        left = np.flatnonzero(~known & ~good)
        if len(left):
            new, of = np.unique(key[left], return_inverse=True)
            pieces = self.pieces
            ok = np.array([self._follows(pieces[k // self.size], pieces[k % self.size]) for k in new.tolist()])
            good[left] = ok[of]
            self.pairs[at[left]] = key[left] << 1 | ok[of]
        return good

    def stream(self, codes: list[int]) -> Iterator[int]:
        """The pieces of a lane (code points) as ids, committed as soon as all surviving paths agree; size + code point for a character without a piece."""
        letters = self.letter[codes].tolist()
        step, ends, lengths, size, total = self._scalar(), self.ends, self.lengths, self.size, len(codes)
        follow = self._follow_one
        base, back = 0, [size] + [-1] * min(self.longest, total)  # back[i - base]: the piece that ends at i
        for start in range(total):
            here = start - base
            u, node = back[here], 0
            for d in range(1, min(self.longest, total - start) + 1):
                node = step(node, letters[start + d - 1])
                t = ends[node] if node >= 0 else -1
                if d == 1 and t < 0:
                    back[here + 1] = size + codes[start]
                if node < 0:
                    break
                if t >= 0 and back[here + d] < 0 and follow(u, int(t)):
                    back[here + d] = int(t)
            if start + self.longest < total:
                back.append(-1)
            self.widest = max(self.widest, len(back))
            if (start + 1) % self.longest == 0:
                meet = self._meeting(back, here + 1)
                if meet > 0:
                    self.early += 1
                    yield from self._path(back, meet)
                    # the piece at the boundary stays as the context of what follows
                    back, base = back[meet:], base + meet
        yield from self._path(back, total - base)

    def _scalar(self):
        slots, nodes, n, shift, probes = self.slot_key, self.slot_node, self.n_letters, int(self.shift), self.probes

        def step(node: int, letter: int) -> int:
            key = node * n + letter
            at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> shift
            for k in range(at, at + probes if letter else at):
                if slots[k] == key:
                    return int(nodes[k])
            return -1

        return lru_cache(maxsize=1 << 14)(step)

    def _follow_one(self, u: int, t: int) -> bool:
        if u >= self.size:
            return True
        key = u * self.size + t
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - PAIR_BITS)
        entry = int(self.pairs[at])
        if entry >> 1 != key:
            entry = key << 1 | self._follows(self.pieces[u], self.pieces[t])
            self.pairs[at] = entry
        return entry & 1 == 1

    def _width(self, piece: int) -> int:
        return 1 if piece >= self.size else int(self.lengths[piece])

    def _meeting(self, back: list, start: int) -> int:
        """The last boundary that the paths of all ends from start on share (0: none)."""
        front = {e for e in range(start, len(back)) if back[e] >= 0}
        while len(front) > 1:
            e = max(front)
            front.discard(e)
            if e == 0:
                return 0
            front.add(e - self._width(back[e]))
        return max(front.pop(), 0) if front else 0

    def _path(self, back: list, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(back[end])
            end -= self._width(back[end])
        return out[::-1]

    def _side_by_side(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of lanes (one after another in codes) and how many each has; the lattice of all lanes advances a start position at a time."""
        order = np.argsort(-lengths, kind="stable")
        size, n, most = lengths[order], len(lengths), int(lengths.max())
        first = (np.cumsum(lengths) - lengths)[order]
        grid = np.zeros((most, n), np.int32)
        rows = np.repeat(np.arange(n), size)
        grid[ranges(np.zeros(n, np.int64), size), rows] = codes[ranges(first, size)]
        letters = self.letter[grid].astype(np.int64)
        left = np.searchsorted(-size, -np.arange(most), side="left")  # lanes longer than s
        back = np.full((most + 1, n), -1, np.int32)
        back[0] = self.size
        for s in range(most):
            alive, node = np.arange(left[s]), np.zeros(left[s], np.int64)
            u = back[s, : left[s]].astype(np.int64)
            for d in range(1, min(self.longest, most - s) + 1):
                m = np.searchsorted(alive, left[s + d - 1])
                alive = alive[:m]
                node = self._step(node[:m], letters[s + d - 1, alive])
                piece = np.where(node >= 0, self.ends[node], -1)
                if d == 1:
                    bare = alive[piece < 0]
                    back[s + 1, bare] = self.size + grid[s, bare]
                met = (piece >= 0) & (back[s + d, alive] < 0)
                if met.any():
                    lane, t = alive[met], piece[met].astype(np.int64)
                    good = self.follow(u[lane], t)
                    back[s + d, lane[good]] = t[good]
                some = node >= 0
                if not some.any():
                    break
                alive, node = alive[some], node[some]
        # back from the end of every lane
        at, out, open_ = size.copy(), [], np.arange(n)
        counts = np.zeros(n, np.int64)
        while len(open_):
            piece = back[at[open_], open_]
            out.append((open_, piece))
            counts[open_] += 1
            at[open_] -= np.where(piece < self.size, self.lengths[np.minimum(piece, self.size - 1)], 1)
            open_ = open_[at[open_] > 0]
        in_order = np.empty(n, np.int64)
        in_order[order] = counts
        begin = (np.cumsum(in_order) - in_order)[order]
        flat = np.empty(int(counts.sum()), np.int32)
        for k, (lane, piece) in enumerate(out):
            flat[begin[lane] + counts[lane] - 1 - k] = piece
        return flat, in_order

    def _lanes(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of lanes and how many each has, lanes of like length together and long ones by themselves."""
        counts, parts = np.zeros(len(lengths), np.int64), []
        first = np.cumsum(lengths) - lengths
        for low, high in ((0, 16), (16, LANE)):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(own):
                flat, counts[own] = self._side_by_side(codes[ranges(first[own], lengths[own])], lengths[own])
                parts.append((own, flat))
        for i in np.flatnonzero(lengths > LANE):
            flat = np.fromiter(self.stream(codes[first[i] : first[i] + lengths[i]].tolist()), np.int32)
            counts[i] = len(flat)
            parts.append((np.array([i]), flat))
        begin, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int32)
        for own, flat in parts:
            out[ranges(begin[own], counts[own])] = flat
        return out, counts

    def _spelled(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their bytes, or as the unknown piece."""
        bare = np.flatnonzero(flat >= self.size)
        if not len(bare):
            return flat, counts
        width = np.ones(len(flat), np.int64)
        spelled = {c: [self.bytes[b] for b in chr(c).encode("utf-8", "replace")] if self.bytes else [self.unknown] for c in np.unique(flat[bare] - self.size).tolist()}
        width[bare] = [len(spelled[c]) for c in (flat[bare] - self.size).tolist()]
        begin = np.cumsum(width) - width
        out = np.repeat(flat, width)
        out[ranges(begin[bare], width[bare])] = [b for c in (flat[bare] - self.size).tolist() for b in spelled[c]]
        return out, np.add.reduceat(width, np.cumsum(counts) - counts)

    def _normalized(self, text: str) -> list[str]:
        """The text as the model sees it, a stretch at a time."""
        out, start = [], 0
        while self.in_stretches and len(text) - start > STRETCH:
            cut = re.compile(r"(?<=[a-zA-Z]) (?=[a-zA-Z])").search(text, start + STRETCH)
            if not cut:
                break
            out.append(self.normalize(text[start : cut.start()]))
            start = cut.end()
        return [*out, self.normalize(text[start:])]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts; the empty text has none."""
        marked = [self._normalized(t) if t else [] for t in texts]
        sizes = np.array([sum(map(len, m)) for m in marked], np.int64)
        codes = np.frombuffer("".join(p for m in marked for p in m).encode("utf-32-le", "surrogatepass"), np.uint32)
        del marked
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        begin = np.cumsum(sizes) - sizes
        new = np.ones(len(codes), bool)
        side = self.joint[codes].astype(np.int32)
        new[1:] = ~self.link[side[:-1] * self.n_joint + side[1:]]
        new[begin[sizes > 0]] = True
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, len(codes)))
        place = np.arange(len(codes)) - np.repeat(first, lengths)
        term = codes.astype(np.uint64) * _A + place.astype(np.uint64) * _B
        del place, side, new
        term ^= term >> np.uint64(29)
        term *= _B
        term ^= term >> np.uint64(32)
        _, own, of = np.unique(np.add.reduceat(term, first), return_index=True, return_inverse=True)
        del term
        # lanes are equal if their characters are; what shares a hash by chance is a lane of its own
        same = lengths == lengths[own][of]
        held = np.flatnonzero(same)
        differs = codes[ranges(first[held], lengths[held])] != codes[ranges(first[own][of[held]], lengths[held])]
        if differs.any():
            same[held[np.repeat(np.arange(len(held)), lengths[held])[differs]]] = False
        odd = np.flatnonzero(~same)
        of[odd] = len(own) + np.arange(len(odd))
        own = np.append(own, odd)
        flat, counts = self._spelled(*self._lanes(codes[ranges(first[own], lengths[own])], lengths[own]))
        at = np.cumsum(counts) - counts
        ids = flat[ranges(at[of], counts[of])]
        upto = np.append(0, np.cumsum(counts[of]))
        return ids, upto[np.searchsorted(first, np.append(begin, len(codes)), side="left")]

    def encode(self, text: str) -> list[int]:
        """The ids of a text (the empty text: none)."""
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: bytes are read as UTF-8, marks become spaces, the leading mark goes; a null list is the empty text."""
        flat, counts = ids.flatten(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        raw = pc.binary_join(pa.ListArray.from_arrays(offsets, self.spelling.take(flat)), b"")
        try:
            text = raw.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
        text = pc.if_else(pc.starts_with(text, SPACE_MARK), pc.utf8_slice_codeunits(text, 1), text)
        return pc.replace_substring(text, SPACE_MARK, " ")

    def decode(self, ids) -> str:
        return self.decode_all(pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py()


@lru_cache(maxsize=1)
def piece_model(name: str) -> PieceModel:
    return PieceModel(tokenizer_path(name))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", text_col: str = "text", into: str = "piece_ids", check: str | None = None) -> DataFrame:
    """docs with the ids of each row's text in the column `into` (array of int), which replaces one of that name.

    check names a boolean column that says whether decoding the ids gives the text back. Null and empty texts have no ids, and
    decode to the empty text. A very long text is encoded whole, by itself; its memory is some thirty times its bytes. Each row is encoded
    for itself: repeated rows and ids have the same ids again, and rows keep their order. An empty table gives an empty
    result with the same columns. All other columns are kept as they are.
    """
    rest = docs.drop(into, *([check] if check else []))
    own = "__text"
    while own in rest.columns:
        own += "_"
    rows = rest.withColumn(own, docs[text_col].cast("string"))
    schema = T.StructType([*rest.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.BooleanType())] if check else []))

    def run(batches):
        m = piece_model(model)
        for whole in batches:
            for b in slices(whole, own, SLICE):
                texts = b.column(own)
                ids, offsets = m.encode_all(pc.fill_null(texts, "").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                b = b.drop_columns([own]).append_column(into, lists)
                yield b.append_column(check, pc.equal(m.decode_all(lists), pc.fill_null(texts, ""))) if check else b

    return rows.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """docs with the text of each row's ids in the column `into`, which replaces one of that name.

    Null and empty lists are the empty text; bytes that are no UTF-8 become replacement characters; an id outside the vocabulary
    or null inside a list is an error. Each row is decoded for itself, repeated rows alike; an empty table
    gives an empty result. All other columns are kept as they are.
    """
    rows = docs.drop(into)
    schema = docs.drop(into).schema.add(into, "string")

    def run(batches):
        m = piece_model(model)
        for b in batches:
            yield b.append_column(into, m.decode_all(b.column(ids_col).cast(pa.list_(pa.int32()))))

    return rows.mapInArrow(run, schema)


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether decoding them gives its text back."""
    coded = encode(documents(spark, sf_dir).select("doc_id", "text"), check="round_trip")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")
