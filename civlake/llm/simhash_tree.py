"""SimHash near duplicates by vantage-point trees.

Equal fingerprints are one point. A tree over a bounded sample of points cuts the space: each node sends a point inside its radius around a vantage
point to one side, the others to the other side, and points that lie less than the sought distance beyond the radius to both, so that, by the triangle inequality, every two
points that are near enough meet in a leaf. A leaf's points are one shard, in which the same cut goes on down to
small sets that are compared whole. Links are handed on as forests, not as all pairs, and tied together as components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.llm.common import documents, join_hot, slices, stash
from civlake.llm.graph import components, spanning
from civlake.llm.words import LOWER, stretches

#: Points of a shard, about; points of the sample a leaf, and leaves, at most; points compared whole in a shard.
SHARD, LEAF_SAMPLE, LEAVES, SMALL = 4096, 16, 1 << 16, 256
#: Vantage points tried for a cut, and the share of the points that its larger side may keep.
TRIED, KEPT = 6, 0.9
#: Shingles hashed at a time.
SHINGLES = 1 << 16
#: Bytes in words: all but white space.
_INSIDE = ~np.isin(np.arange(256), [32, *range(9, 14)])


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The 64 bits that more than half of the hashes of the text's k-word shingles have; 0 without words."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    parts = stretches((text or "").encode("utf-8", "surrogatepass").translate(LOWER), _INSIDE)
    for part in parts:
        words = carry + part.split()
        carry = words[1 - k :] if k > 1 else []
        if len(words) < k:
            carry = words
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
        ends = ends[k - 1 :].tolist()
        for low in range(0, len(starts), SHINGLES):
            found = np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[low : low + SHINGLES], ends[low : low + SHINGLES], strict=True)], np.uint64)
            ones += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(found)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(carry), seed) if carry else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (a signed long of the fingerprint's bits) and the columns `others` of every row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *others)
    kept = [f for f in own.schema if f.name != "text"]

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                found = np.array([fingerprint(t.as_py(), k, seed) for t in b.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(found.view(np.int64))], [f.name for f in kept] + ["fp"])

    return own.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", fp long")


def best_cut(points: np.ndarray, bits: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that leave least work, points near the border counted on both sides; None if no cut makes both sides smaller by enough."""
    least, cut, n = np.inf, None, len(points)
    for v in points[np.linspace(0, n - 1, min(TRIED, n)).astype(int)]:
        within = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65 + bits))
        inside, outside = within[bits:], n - within[: len(within) - bits]
        fits = (np.maximum(inside, outside) <= KEPT * n) & (np.minimum(inside, outside) > 0)
        if fits.any():
            work = np.where(fits, inside * np.log(np.maximum(inside, 1)) + outside * np.log(np.maximum(outside, 1)), np.inf)
            if work.min() < least:
                least, cut = work.min(), (v, int(work.argmin()))
    return cut


class Tree:
    """A vantage-point tree whose leaves are numbered; nodes are (vantage, radius, inside, outside)."""

    def __init__(self, sample: np.ndarray, leaves: int, bits: int):
        self.bits, self.leaves = bits, 0
        self.root = self._grown(sample, leaves)

    def _grown(self, sample: np.ndarray, leaves: float):
        cut = best_cut(sample, self.bits) if leaves > 1 and len(sample) > 1 else None
        if cut is None:
            self.leaves += 1
            return self.leaves - 1
        v, radius = cut
        far = np.bitwise_count(sample ^ v)
        inside, outside = sample[far <= radius], sample[far > radius]
        if not len(inside) or not len(outside):
            self.leaves += 1
            return self.leaves - 1
        share = len(inside) / len(sample)
        return v, radius, self._grown(inside, leaves * share), self._grown(outside, leaves * (1 - share))

    def placed(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, its points): every two points within `bits` of each other are together in some leaf."""
        todo = [(self.root, points)]
        while todo:
            node, points = todo.pop()
            if not len(points):
                continue
            if isinstance(node, int):
                yield node, points
                continue
            v, radius, inside, outside = node
            far = np.bitwise_count(points ^ v)
            todo += [(inside, points[far <= radius + self.bits]), (outside, points[far > radius])]


def near_pairs(points: np.ndarray, bits: int) -> Iterator[tuple[list[int], list[int]]]:
    """All pairs of different points within `bits` bits of each other (some more than once), a set that a cut no longer shrinks at a time, as signed numbers."""
    todo = [points]
    while todo:
        points = todo.pop()
        cut = best_cut(points, bits) if len(points) > SMALL else None
        if cut is not None:
            v, radius = cut
            far = np.bitwise_count(points ^ v)
            todo += [points[far <= radius + bits], points[far > radius]]
            continue
        signed = points.view(np.int64)
        for low in range(0, len(points), SMALL):
            for other in range(low, len(points), SMALL):
                a, b = np.nonzero(np.bitwise_count(points[low : low + SMALL, None] ^ points[None, other : other + SMALL]) <= bits)
                keep = (a + low) < (b + other)
                if keep.any():
                    yield signed[a[keep] + low].tolist(), signed[b[keep] + other].tolist()


def links(points: DataFrame, total: int, bits: int = 2, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that tie together all of the points (fp long, distinct, `total` of them) within `bits` bits of each other, loose ends through others.

    The tree that deals points out to shards is fitted on a sample of LEAF_SAMPLE points a leaf, with LEAVES leaves at most; beyond that shards grow.
    """
    leaves = max(1, min(LEAVES, -(-total // shard)))
    sample = np.zeros(0, np.uint64)
    if leaves > 1:
        wanted = leaves * LEAF_SAMPLE * 4
        some = points.filter(F.pmod(F.xxhash64("fp"), F.lit(total)) < wanted)
        sample = np.unique(np.array([r[0] for r in some.collect()], np.int64)).view(np.uint64)
        sample = np.random.default_rng(len(sample)).permutation(sample)
    tree = Tree(sample, leaves, bits)

    def deal(batches):
        for b in batches:
            for leaf, found in tree.placed(b.column("fp").to_numpy().view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), leaf)), pa.array(found.view(np.int64))], ["shard", "fp"])

    def tie(table: pa.Table) -> pa.Table:
        found = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        return pa.Table.from_batches(list(spanning(near_pairs(found, bits))))

    return points.mapInArrow(deal, "shard long, fp long").groupBy("shard").applyInArrow(tie, "a long, b long")


def near_fingerprints(docs: DataFrame, bits: int = 2, k: int = 3, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = (), shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id and the columns `others` of every row of docs.

    Words are what white space parts, with A-Z lower-cased; a text of fewer than k words has one shingle, all its words. Texts without words, null and empty ones,
    have fingerprint 0 and are linked like any other. Fingerprints with at most `bits` differing bits are linked, each such pair of different ones without
    exception; component_id is the smallest id that links reach, null only where all of those ids are. Rows that repeat an id are separate rows. An empty table gives an
    empty result. Further columns of docs are not carried. Ids are whole numbers. Very long texts are hashed in stretches.
    """
    rows = stash(fingerprints(docs, k, id_col=id_col, text_col=text_col, others=others), "fingerprints")
    points = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "points")
    total, n_rows = points.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    tied = components(links(points.select("fp"), total, bits, shard))
    linked = stash(tied.withColumnRenamed("node", "fp").join(points.select("fp", "least"), "fp"), "linked")
    per_root = stash(linked.groupBy("root").agg(F.min("least").alias("reached"), F.count(F.lit(1)).alias("points")), "roots")
    reached = join_hot(linked.select("root", "fp"), per_root, ["root"], "points", total).select("fp", "reached")
    named = stash(points.join(reached, "fp", "left").select("fp", "rows", F.coalesce("reached", "least").alias("component_id")), "named")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_hot(rows, named, ["fp"], "rows", n_rows).select("doc_id", digits, "component_id", *others)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by 3-word shingles and two bits."""
    return near_fingerprints(documents(spark, sf_dir))
