"""Token ids packed into rows of fixed length, best fit first.

A document longer than a row is split into full rows and a rest, which loses nothing. The rests are
packed by best-fit decreasing: the longest piece first, each into the row with the least room that
still holds it, found by descending a segment tree over room sizes. Every task packs its own rows,
some 100,000 pieces at a time, so nothing is shuffled and memory is bounded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.llm.chunks import PRETOKEN, stretches
from civlake.llm.common import documents, slices
from civlake.llm.token_counts import tokenizer_path

#: Pieces and ids that one task holds before it packs them.
WINDOW_PIECES, WINDOW_IDS = 100_000, 4 << 20
#: Bytes of text whose rows are taken from Arrow at a time.
SLICE = 2 << 20
PACKED_SCHEMA = "pack_id long, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, reset_at array<int>, segment_doc array<{id}>, segment_start array<long>"


class RoomTree:
    """A segment tree over room sizes 0..n: for each size, the open rows with that room."""

    def __init__(self, n: int):
        self.width = 1 << n.bit_length()
        self.held = bytearray(2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(n + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.width
        while i and not self.held[i]:
            self.held[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the open row with the least room that is at least need, removed from the tree."""
        i = need + self.width
        if not self.held[i]:
            # up to the first right sibling that holds something, then down its left edge
            while i > 1 and (i & 1 or not self.held[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.held[2 * i] else 2 * i + 1
        room = i - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.held[i] = 0
            i >>= 1
            while i:
                self.held[i] = self.held[2 * i] | self.held[2 * i + 1]
                i >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of piece numbers; each length is from 1 to capacity. Equal lengths keep their order."""
    tree, rows = RoomTree(capacity), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        got = tree.take(n) if n < capacity else None
        if got is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = got
        rows[row].append(k)
        if room > n:
            tree.add(room - n, row)
    return rows


@lru_cache(maxsize=2)
def _encoder(name: str):
    import tiktoken

    with open(tokenizer_path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding(name, pat_str=PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()).astype(np.int32) for p in stretches(text)])

    return encode


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, tokenizer: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    """Packed rows of the texts of batches (doc_id, text), a window at a time."""
    encode = _encoder(tokenizer)
    number = TaskContext.get().partitionId() << 33
    ids, owners, starts, held = [], [], [], 0
    id_type = None

    def window() -> pa.RecordBatch:
        nonlocal number
        layout = best_fit_decreasing(np.fromiter(map(len, ids), np.int64, len(ids)), capacity)
        lengths = [[len(ids[k]) for k in row] for row in layout]
        cu = [np.concatenate([[0], np.cumsum(x)]).astype(np.int32) for x in lengths]
        columns = [
            pa.array(range(number, number + len(layout)), pa.int64()),
            pa.array([int(c[-1]) for c in cu], pa.int32()),
            pa.array(list(map(len, layout)), pa.int32()),
            pa.array([np.concatenate([ids[k] for k in row]).astype("<i4").tobytes() for row in layout], pa.binary()),
            pa.array(cu, pa.list_(pa.int32())),
            pa.array([c[:-1] for c in cu], pa.list_(pa.int32())),
            pa.array([[owners[k] for k in row] for row in layout], pa.list_(id_type)),
            pa.array([[starts[k] for k in row] for row in layout], pa.list_(pa.int64())),
        ]
        number += len(layout)
        return pa.RecordBatch.from_arrays(columns, ["pack_id", "n_tokens", "n_segments", "input_ids", "cu_seqlens", "reset_at", "segment_doc", "segment_start"])

    for whole in batches:
        for b in slices(whole, "text", SLICE):
            id_type = b.column("doc_id").type
            for owner, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = encode(text or "")
                if end_id is not None:
                    own = np.append(own, np.int32(end_id))
                for at in range(0, len(own), capacity):
                    ids.append(own[at : at + capacity])
                    owners.append(owner)
                    starts.append(at)
                held += len(own)
                if len(ids) >= WINDOW_PIECES or held >= WINDOW_IDS:
                    yield window()
                    ids, owners, starts, held = [], [], [], 0
    if ids:
        yield window()


def pack_tokens(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.tiktoken", end_id: int | None = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each packed row of at most `capacity` ids.

    input_ids holds little-endian int32 ids; cu_seqlens the cumulative segment lengths from 0 to n_tokens;
    reset_at the places where positions start again at 0; segment_doc and segment_start say which
    document each segment is from and at which of its ids it starts. end_id, if not null, follows each
    document's ids. A null or empty text has no ids but end_id. Ids of documents may be null or
    repeat: each row is packed on its own. An empty table packs into nothing; other columns are not carried.
    pack_id is the task's number and a count, so it repeats when the input is laid out alike.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = PACKED_SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())
    return rows.mapInArrow(lambda batches: _packed(batches, capacity, tokenizer, end_id), schema)


_NESTED = ("n_tokens", "cu_seqlens", "reset_at", "segment_doc", "segment_start")


def _matrices(batches: Iterator[pa.RecordBatch], rows_a_matrix: int, capacity: int, pad_id: int, positions: bool) -> Iterator[pa.RecordBatch]:
    """Matrices of packed rows; one is held at a time."""
    number, held = TaskContext.get().partitionId() << 33, []

    def matrix() -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks()
        ids, place = np.full((b.num_rows, capacity), pad_id, "<i4"), np.zeros((b.num_rows, capacity) if positions else (0, 0), "<i4")
        for k, (own, cu) in enumerate(zip(b.column("input_ids").to_pylist(), b.column("cu_seqlens").to_pylist(), strict=True)):
            own, cu = np.frombuffer(own, "<i4"), np.asarray(cu)
            ids[k, : len(own)] = own
            if positions:
                place[k, : len(own)] = np.arange(len(own)) - np.repeat(cu[:-1], np.diff(cu))
        columns = [pa.array([number], pa.int64()), pa.array([b.num_rows], pa.int32()), pa.array([ids.tobytes()], pa.binary())]
        columns += [pa.array([place.tobytes()], pa.binary())] * positions
        for c in _NESTED:
            own = b.column(c).combine_chunks()
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
        return pa.RecordBatch.from_arrays(columns, ["matrix_id", "n_rows", "ids", *["positions"] * positions, *_NESTED])

    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, rows_a_matrix - sum(x.num_rows for x in held))
            held.append(part)
            at += part.num_rows
            if sum(x.num_rows for x in held) == rows_a_matrix:
                yield matrix()
                number, held = number + 1, []
    if held:
        yield matrix()


def _matrix_schema(id_type: str, positions: bool) -> str:
    lists = f"n_tokens array<int>, cu_seqlens array<array<int>>, reset_at array<array<int>>, segment_doc array<array<{id_type}>>, segment_start array<array<long>>"
    return "matrix_id long, n_rows int, ids binary, " + "positions binary, " * positions + lists


def id_matrices(packed: DataFrame, rows_a_matrix: int = 64, capacity: int = 2048, pad_id: int = 0, positions: bool = True) -> DataFrame:
    """Matrices of at most rows_a_matrix packed rows each, from the rows of pack_tokens().

    matrix_id, n_rows and ids (n_rows * capacity little-endian int32, row by row, padded with pad_id); positions, if asked for, is laid
    out alike and starts at 0 at each segment and in padding. n_tokens, cu_seqlens, reset_at, segment_doc and segment_start hold
    one entry a row, as in the packed rows. Each task builds its own matrices and holds one of them, so nothing is shuffled. An empty table has no matrix; rows
    that repeat are separate rows, and null or repeated ids of documents pass through. Other columns are not carried.
    """
    rows = packed.select("n_tokens", "input_ids", "cu_seqlens", "reset_at", "segment_doc", "segment_start")
    schema = _matrix_schema(rows.schema["segment_doc"].dataType.elementType.simpleString(), positions)
    return rows.mapInArrow(lambda batches: _matrices(batches, rows_a_matrix, capacity, pad_id, positions), schema)


def packed_matrices(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.tiktoken", end_id: int | None = 50256, rows_a_matrix: int = 64, pad_id: int = 0, positions: bool = False) -> DataFrame:
    """id_matrices(pack_tokens(docs)) of rows doc_id and text in one pass of each task, so that one Python worker does both; see there for nulls, repeats and empty tables."""
    rows = docs.select("doc_id", "text")
    schema = _matrix_schema(rows.schema["doc_id"].dataType.simpleString(), positions)
    return rows.mapInArrow(lambda batches: _matrices(_packed(batches, capacity, tokenizer, end_id), rows_a_matrix, capacity, pad_id, positions), schema)


def op1_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as matrices of rows of 2048 ids, with the cumulative lengths, resets, documents and starts of the rows' segments."""
    return packed_matrices(documents(spark, sf_dir))
