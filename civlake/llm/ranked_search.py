"""Ranked lexical search: the best documents for each item, by branch and bound over a hierarchical tree of term maxima.

Documents are counted once, for the terms that items use. Each task then takes its documents in ranges and builds a tree over every range: a node
holds, for each term below it, the greatest share any of its documents gets from the term. An item's weights summed over a node's maxima bound
the scores of all documents under it. The node with the highest bound is opened first, and a range is done when no
bound reaches the worst of the best documents found so far; a bound that only equals it is opened too, as ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civlake.llm.common import documents, pieces_of, slices, stash
from civlake.llm.words import LOWER, byte_class, stretches

#: Children of a tree's node, documents of a range and counts of terms in it, and bytes of items searched in one pass.
FAN, RANGE_DOCS, RANGE_COUNTS, ITEM_BYTES = 16, 1 << 16, 1 << 22, 4 << 20
#: Parts in which an item's results of all tasks are cut down before they meet.
SALTS = 64
INSIDE = byte_class("0-9a-z")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> Counter:
    """How often each term is in the text, as bytes."""
    found: Counter = Counter()
    for part in stretches((text or "").encode("utf-8", "surrogatepass").translate(LOWER), INSIDE):
        found.update(_WORD.findall(part))
    return found


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, number of terms, and how often each term of the vocabulary occurs, for every row with a term."""
    known = vocabulary.keys()

    def count(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                ids, n, terms, tfs, bounds = [], [], [], [], [0]
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    found = terms_of(text.as_py())
                    if not found:
                        continue
                    ids.append(doc_id)
                    n.append(found.total())
                    hits = found.keys() & known
                    terms += [vocabulary[t] for t in hits]
                    tfs += [found[t] for t in hits]
                    bounds.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, COUNTS)


def shares(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term that a document of n terms holds tf times gives it, before the term's weight."""
    m = 25 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """Levels of nodes over a range of documents; each level has its nodes' terms and maxima one behind the other, and where they begin."""

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, share: np.ndarray, vocabulary: int):
        self.levels = [(bounds, terms, share)]
        while len(bounds) - 1 > FAN:
            node = np.repeat(np.arange(len(bounds) - 1) // FAN, np.diff(bounds))
            key = node * vocabulary + terms
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            share = np.maximum.reduceat(share[order], first) if len(first) else share[:0]
            key = key[first]
            terms = key % vocabulary
            bounds = np.searchsorted(key // vocabulary, np.arange((len(bounds) - 2) // FAN + 2))
            self.levels.append((bounds, terms, share))

    def sums(self, level: int, low: int, high: int, weights: np.ndarray) -> np.ndarray:
        """The weighted sums of the nodes [low, high): scores on the level of documents, bounds above it."""
        bounds, terms, share = self.levels[level]
        a, b = bounds[low], bounds[high]
        upto = np.concatenate([[0], np.cumsum(weights[terms[a:b]] * share[a:b])])
        return np.diff(upto[bounds[low : high + 1] - a])

    def best(self, weights: np.ndarray, ids: list[int], k: int, best: list[tuple[int, int]]) -> None:
        """Put the range's documents among the k best: a heap of (score, -id), the worst on top."""
        top = len(self.levels) - 1
        heap = [(-s, top, i) for i, s in enumerate(self.sums(top, 0, len(self.levels[top][0]) - 1, weights).tolist()) if s > 0]
        heapq.heapify(heap)
        while heap:
            bound, level, node = heapq.heappop(heap)
            if len(best) == k and -bound < best[0][0]:
                return
            if level == 0:
                found = (-bound, -ids[node])
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
                continue
            low = node * FAN
            least = best[0][0] if len(best) == k else 1
            for i, s in enumerate(self.sums(level - 1, low, min(low + FAN, len(self.levels[level - 1][0]) - 1), weights).tolist(), low):
                if s >= least and s > 0:
                    heapq.heappush(heap, (-s, level - 1, i))


def _ranges(batches) -> Iterator[pa.Table]:
    """The rows of a task in ranges of bounded size."""
    held, docs, counts = [], 0, 0
    for b in batches:
        for at in range(0, b.num_rows, RANGE_DOCS // 8):
            part = b.slice(at, RANGE_DOCS // 8)
            held.append(part)
            docs, counts = docs + part.num_rows, counts + len(part.column("terms").flatten())
            if docs >= RANGE_DOCS or counts >= RANGE_COUNTS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, docs, counts = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _searched(batches, items: list[tuple[int | None, list[tuple[int, int]]]], vocabulary: int, n_docs: int, n_terms: int, k: int):
    """(item, doc_id, score) of the k best documents of a task for each item, an item being its id and its terms with their weights."""
    nothing = 1 << 63  # a null id is larger than any other
    found: list[list[tuple[int, int]]] = [[] for _ in items]
    weights = np.zeros(vocabulary, np.int64)
    for table in _ranges(batches):
        lists = table.column("terms").chunk(0)
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        tf = table.column("tfs").chunk(0).flatten().to_numpy().astype(np.int64)
        n = np.repeat(table.column("n").to_numpy(), np.diff(bounds))
        tree = Tree(bounds, lists.flatten().to_numpy().astype(np.int64), shares(tf, n, n_docs, n_terms), vocabulary)
        ids = [nothing if i is None else i for i in table.column("doc_id").to_pylist()]
        for best, (_, wanted) in zip(found, items, strict=True):
            for term, w in wanted:
                weights[term] = w
            tree.best(weights, ids, k, best)
            for term, _ in wanted:
                weights[term] = 0
    rows = [(x, None if d == -nothing else -d, s) for x, best in enumerate(found) for s, d in best]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best rows of docs with a score above 0, all if there are fewer.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. A term weighs floor(1000 * ln((2N + 2) / (2 df + 1))), where N counts
    the rows with a term and df those that hold it; a row's score adds, for each term of the item and each time the item has it, the weight times
    (10^9 tf) div (1000 tf + 8m), where m is 25 + (75 n N) div L, n being the row's terms and L all rows' terms. Equal scores go by id, a null id last.
    Rows that repeat a doc_id are separate documents; rows that repeat an item_id, null among them, are one item with the terms of all. Null and empty texts have no terms: such items
    have no rows. Without documents or items there are none. Further columns are not carried. Ids are whole numbers. Very long texts are counted in stretches.

    Items are searched in blocks of about ITEM_BYTES of text, whose terms, weights and results alone are held; each block reads the documents once.
    """
    spark = docs.sparkSession
    asked = stash(items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")), "items")
    blocks = pieces_of(asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], ITEM_BYTES)
    out = []
    for block in range(blocks):
        per_item: dict[int | None, Counter] = {}
        for item_id, text in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            per_item.setdefault(item_id, Counter()).update(terms_of(text))
        vocabulary = {t: i for i, t in enumerate(sorted({t for c in per_item.values() for t in c}))}
        if not vocabulary:
            continue
        table = stash(counted(docs, vocabulary, id_col, text_col), "counts")
        n_docs, n_terms = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        holders = dict(table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect())
        weigh = lambda t: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * holders.get(vocabulary[t], 0) + 1)))  # noqa: E731, B023
        wanted = [(i, [(vocabulary[t], n * weigh(t)) for t, n in sorted(c.items())]) for i, c in per_item.items()]
        size = len(vocabulary)
        found = table.mapInArrow(lambda batches, a=(wanted, size, n_docs, n_terms, k): _searched(batches, *a), "item long, doc_id long, score long")
        first = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(x, i) for x, (i, _) in enumerate(wanted)], "item long, item_id long")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, t, count(*) AS m FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY 1, 2),
n AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, n GROUP BY t, n_docs),
x AS (SELECT p.r, d.doc_id, p.t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n_docs) // n_terms))) AS s FROM p JOIN d USING (r) JOIN f USING (t), n),
s AS (SELECT item_id, r, doc_id, sum(m * s)::BIGINT AS score FROM q JOIN x USING (t) GROUP BY 1, 2, 3)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
