"""Removal of long byte strings that occur more than once, by phrases of a prefix-free parse.

A rolling hash of GRAM bytes triggers the phrases: every window of `length` bytes has its smallest
hash as its trigger, so that equal windows have equal triggers at equal places. A phrase is the run
of windows that share a trigger. Phrases are sorted by the bytes around their trigger, then by all
their bytes, over the whole corpus; phrases that stand next to each other there and
are the same repeat as a whole, and those that only share the bytes around the trigger are cut into
shorter pieces and sorted again, down to single windows. Sorted rows are dealt out by
range, so that a passage in many documents never has to fit in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.llm.common import HOT_KEYS, HOT_ROWS, documents, slices, stash, utf8
from civlake.llm.shingles import mixed

GRAM, PIECE = 32, 12
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
PIECE_SCHEMA = "near long, full long, tid long, start int, windows int, trigger int"


class Hashes:
    """Hashes of any stretch of some bytes, equal for equal stretches wherever they are."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.ones(n + 1, np.uint64)
        power[1:] = np.uint64(_BASE)
        power = np.multiply.accumulate(power)
        self.back = np.ones(n + 1, np.uint64)
        self.back[1:] = np.uint64(_INVERSE)
        self.back = np.multiply.accumulate(self.back)
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[:n], out=self.upto[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt=0) -> np.ndarray:
        """A hash of each stretch [start, end) and the salt."""
        return mixed((self.upto[end] - self.upto[start]) * self.back[start] + np.asarray(salt).astype(np.uint64) * np.uint64(_BASE))


def _triggers(h: Hashes, n: int, length: int) -> np.ndarray:
    """For each window of `length` bytes, the place of its smallest GRAM-byte hash (the first of equals)."""
    at = np.arange(n - GRAM + 1)
    # the place in the lower bits breaks ties to the left
    rank = (h.of(at, at + GRAM) >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    width = length - GRAM + 1
    count = len(rank) - width + 1
    blocks = -(-len(rank) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[: len(rank)] = rank
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def _cut(h: Hashes, start: np.ndarray, trigger: np.ndarray, band: int, length: int):
    """Rows of windows (by start, with their triggers) as pieces: runs with one trigger and offsets in one band.

    near: a hash of the bytes that all windows of the band share; full: of all bytes of the piece and where they lie around the trigger.
    """
    offset = trigger - start
    k = offset // band
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (k[1:] != k[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(start)))
    s, t, k = start[first], trigger[first], k[first]
    near_start = t - k * band
    near = h.of(near_start, near_start - band + 1 + length, k)
    full = h.of(s, s + windows - 1 + length, (t - s) * 1000 + windows)
    return near, full, s, windows, t


def _phrases(batches, length: int):
    for whole in batches:
        for b in slices(whole, "text", SLICE):
            data, offsets = utf8(b.column("text"))
            tid = b.column("tid").to_numpy()
            if not (np.diff(offsets) >= length).any():
                continue
            for lo, hi in _runs_of(offsets, 1 << 23):  # a trigger's place has 24 bits
                part = data[offsets[lo] : offsets[hi]]
                if len(part) < length:
                    continue
                h = Hashes(part)
                trigger = _triggers(h, len(part), length) if len(part) < 1 << 24 else _long_triggers(h, len(part), length)
                own = offsets[lo : hi + 1] - offsets[lo]
                start = np.arange(len(part) - length + 1)
                owner = np.searchsorted(own, start, side="right") - 1
                fits = start + length <= own[owner + 1]
                near, full, s, windows, t = _cut(h, start[fits], trigger[fits], length - GRAM + 1, length)
                of = np.searchsorted(own, s, side="right") - 1
                yield _pieces(near, full, tid[lo:hi][of], s - own[of], windows, t - own[of])


def _runs_of(offsets: np.ndarray, most: int):
    """Ranges of texts of at most `most` bytes together, or one longer text."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def _long_triggers(h: Hashes, n: int, length: int) -> np.ndarray:
    """_triggers of a text too long for its places to fit beside the hashes, stretch by stretch."""
    out, step = [], 1 << 23
    for at in range(0, n - length + 1, step):
        end = min(n, at + step + length - 1)
        sub = object.__new__(Hashes)
        sub.upto, sub.back = h.upto[at : end + 1] - h.upto[at], h.back[at : end + 1]
        out.append(_triggers(sub, end - at, length) + at)
    return np.concatenate(out)


def _pieces(near, full, tid, start, windows, trigger) -> pa.RecordBatch:
    names = ["near", "full", "tid", "start", "windows", "trigger"]
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64()).cast(k) for x, k in zip((near, full, tid, start, windows, trigger), kinds, strict=True)], names)


def _adjacent(batches):
    """Of sorted pieces: those that a neighbour equals (repeats), and one of each kind that shares only `near` with a neighbour, or stands at a task's border (to be cut)."""
    names = ["tid", "start", "windows", "trigger"]

    def judged(rows: pa.RecordBatch, before, after) -> pa.RecordBatch:
        near, full = rows.column("near").to_numpy(), rows.column("full").to_numpy()
        n = len(near)
        near = np.concatenate([[before[0] if before else 0], near, [after[0] if after else 0]])
        full = np.concatenate([[before[1] if before else 0], full, [after[1] if after else 0]])
        tied = near[1:] == near[:-1]
        if not before:
            tied[0] = False
        if not after:
            tied[-1] = False
        same = tied & (full[1:] == full[:-1])
        repeats = same[:-1] | same[1:]
        other = tied & ~same
        cut = other[:-1] | other[1:]
        if not before:
            cut[0] = True
        if not after:
            cut[-1] = True
        take = np.flatnonzero(repeats | cut)
        out = rows.select(names).take(pa.array(take))
        return out.append_column("repeats", pa.array(repeats[take])).append_column("cut", pa.array(cut[take]))

    held, before = None, None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield judged(held, before, (b.column("near")[0].as_py(), b.column("full")[0].as_py()))
            before = (held.column("near")[-1].as_py(), held.column("full")[-1].as_py())
        held = b
    if held is not None:
        yield judged(held, before, None)


def _sorted(pieces: DataFrame) -> DataFrame:
    keys = ("near", "full", "tid", "start")
    judged = pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_adjacent, "tid long, start int, windows int, trigger int, repeats boolean, cut boolean")
    return stash(judged, "pieces")


def _finer(texts: DataFrame, cut: DataFrame, band: int, length: int) -> DataFrame:
    """The pieces to be cut, cut into narrower bands."""
    lists = cut.distinct().groupBy("tid").agg(F.collect_list(F.struct("start", "windows", "trigger")).alias("runs"))

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                data, offsets = utf8(b.column("text"))
                h = Hashes(data)
                runs = b.column("runs")
                flat, counts = runs.flatten(), runs.value_lengths().to_numpy()
                begin = np.repeat(offsets[:-1], counts)
                tid = np.repeat(b.column("tid").to_numpy(), counts)
                first, n, t = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
                order = np.argsort(first + begin, kind="stable")
                first, n, t, begin, tid = (x[order] for x in (first + begin, n, t + begin, begin, tid))
                of = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
                near, full, s, windows, trigger = _cut(h, start, t[of], band, length)
                at = np.searchsorted(first, s, side="right") - 1
                yield _pieces(near, full, tid[at], s - begin[at], windows, trigger - begin[at])

    return texts.join(lists, "tid").select("tid", "text", "runs").mapInArrow(run, PIECE_SCHEMA)


def remove_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept_sha256 (and kept_bytes, if with_text), without the text column.

    Each byte that a string of `length` bytes covers which also starts anywhere else, in the same
    text or another, is removed; texts are judged as they come in, as UTF-8, null as empty. n_spans counts the maximal
    removed runs. Repeated rows repeat each other, whatever their ids. Texts shorter than `length` stay whole. An empty
    table gives an empty result. Copies of a text are cut alike; a text that more than HOT_ROWS rows have (and more than one in HOT_KEYS of such rows, so that
    hot texts are few enough to broadcast) goes through the work once. Columns of the result's names are replaced; others are kept. Equal bytes, and
    equal texts, are told by 64-bit hashes. A text is worked on whole: memory is some forty times the longest one's bytes.
    """
    own = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "tid").withColumnRenamed(text_col, "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("tid", F.xxhash64("text"))
    # of a text that very many rows have, one row goes through the work; all of its copies repeat each other from end to end
    row = F.xxhash64(*[f.name for f in own.schema if f.name != "text" and "map<" not in f.dataType.simpleString()])
    classes = stash(own.select("tid", row.alias("row")).groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("carrier")).filter(f"copies > {HOT_ROWS}"), "copies")
    most = max(HOT_ROWS, (classes.agg(F.sum("copies")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(classes.filter(F.col("copies") > most).select("tid", "carrier"))
    # rows that repeat an id and a text are one carrier
    carriers = stash(own.select("tid", "text", row.alias("row")).join(hot, "tid").filter("carrier = row").groupBy("tid").agg(F.first("text").alias("text")), "carriers")
    keyed = own.select("tid", "text").join(hot, "tid", "left_anti").unionByName(carriers)
    level = _sorted(keyed.mapInArrow(lambda batches: _phrases(batches, length), PIECE_SCHEMA))
    columns = ("tid", "start", "windows")
    found = level.filter("repeats").select(*columns)
    level = _sorted(_finer(keyed, level.filter("cut").select(*columns, "trigger"), PIECE, length))
    found = found.unionByName(level.filter("repeats").select(*columns))
    single = stash(_finer(keyed, level.filter("cut").select(*columns, "trigger"), 1, length), "windows")
    twice = single.groupBy("full").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = found.unionByName(single.join(twice, "full").select(*columns))
    spans = found.distinct().groupBy("tid").agg(F.collect_list(F.struct("start", "windows")).alias("__spans"))
    kept = [f for f in own.schema if f.name not in ("text", "tid")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"] + ["kept_bytes binary"] * with_text)

    def strip(batches):
        for b in batches:
            rest = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("__spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                left, at, removed, runs = [], 0, 0, 0
                end = -1
                for x in sorted((s["start"], s["start"] + s["windows"] - 1 + length) for s in spans or ()):
                    if x[0] > end:
                        runs += 1
                        left.append(raw[at : x[0]])
                        end = x[0]
                    if x[1] > end:
                        removed += x[1] - end
                        end = at = x[1]
                left.append(raw[at:])
                whole = b"".join(left)
                rest.append((len(raw), removed, runs, hashlib.sha256(whole).hexdigest(), whole))
            columns = [b.column(f.name) for f in kept] + [pa.array([r[k] for r in rest], pa.string() if k == 3 else pa.int64()) for k in range(4)]
            if with_text:
                columns.append(pa.array([r[4] for r in rest], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_bytes"] * with_text)

    whole = F.octet_length("text") - length + 1
    copies = own.join(hot, "tid", "left_semi").withColumn("__spans", F.when(whole > 0, F.array(F.struct(F.lit(0).alias("start"), whole.cast("int").alias("windows")))))
    rest = own.join(hot, "tid", "left_anti").join(spans, "tid", "left")
    return rest.unionByName(copies).mapInArrow(strip, schema)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its 200-byte strings that occur elsewhere."""
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
