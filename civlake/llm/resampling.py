"""Importance resampling towards a target distribution, by hashed runs of words.

Each run of one to three words falls into a bucket by its CRC. Buckets are counted over all documents and over the target's texts; how much more
often the target has a bucket is its gain, and a document's weight is the sum of its features' gains. A weight with Gumbel noise is a score whose
highest values are a draw without replacement in proportion to the weights. Texts are scored as arrays: the CRCs of all words of a batch
advance byte by byte side by side. The k-th highest score is found by distributed selection on its digits, so that only drawn rows are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.llm.common import documents, slices, stash, utf8
from civlake.llm.radix import kth_key, ranked, up_to
from civlake.llm.words import LOWER, byte_class, word_bounds

BUCKETS, RUN, SLICE = 10_000, 3, 1 << 22
#: Words whose CRCs advance together, and bytes of a word that do; the rest of a longer word is one call.
WORDS_AT_ONCE, SIDE_BY_SIDE = 1 << 18, 32
INSIDE = byte_class("0-9a-z")
_LOWER = np.frombuffer(LOWER, np.uint8)
#: The CRC register after each byte value: zlib's answer for a byte, without its complements.
_STEP = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)
_ONES = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _STEP[(state ^ byte).astype(np.uint8)] ^ (state >> np.uint32(8))


class _Words:
    """Words by falling length, so that those that still have a byte at some place come first."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        length = end - start
        self.order = np.argsort(-length, kind="stable")
        start, self.end = start[self.order], end[self.order]
        falling = -length[self.order]
        self.data, self.bytes = data, []
        for place in range(min(SIDE_BY_SIDE, int(-falling[0]))):
            alive = int(np.searchsorted(falling, -place))
            self.bytes.append(data[start[:alive] + place].astype(np.uint32))
        self.longer = [(k, int(start[k]) + SIDE_BY_SIDE, int(self.end[k])) for k in range(int(np.searchsorted(falling, -SIDE_BY_SIDE)))]

    def after(self, state: np.ndarray) -> np.ndarray:
        """The register after each word, from the one before it."""
        s = state[self.order]
        for b in self.bytes:
            s[: len(b)] = _step(s[: len(b)], b)
        for k, at, end in self.longer:
            s[k] = zlib.crc32(self.data[at:end], int(s[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        out = np.empty_like(s)
        out[self.order] = s
        return out


def features(data: np.ndarray, offsets: np.ndarray, run: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, CRCs) of all runs of 1 to `run` consecutive words joined by a space, some words at a time."""
    data = _LOWER[data]
    start, end, owner = word_bounds(data, offsets, INSIDE)
    for first in range(0, len(start), WORDS_AT_ONCE):
        # runs that end in this block may begin before it
        low, high = max(0, first - run + 1), min(len(start), first + WORDS_AT_ONCE)
        words, of = _Words(data, start[low:high], end[low:high]), owner[low:high]
        state, whole = words.after(np.full(high - low, _ONES)), np.ones(high - low, bool)
        for n in range(1, run + 1):
            if n > 1:
                before = np.concatenate([[_ONES], _step(state[:-1], np.uint32(32))]).astype(np.uint32)
                state = words.after(before)
                whole = np.concatenate([[False], whole[:-1] & (of[1:] == of[:-1])])
            new = np.flatnonzero(whole[first - low :]) + first - low
            yield of[new], state[new] ^ _ONES


def _batches(batches, run: int):
    """Slices of the batches with their features' text numbers and buckets' CRCs."""
    for whole in batches:
        for b in slices(whole, "text", SLICE):
            yield b, features(*utf8(b.column("text")), run)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> list[int]:
    """How many features of all texts fall into each bucket; tasks send one row a bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for _, found in _batches(batches, run):
            for _, crc in found:
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    out = [0] * buckets
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """A bucket's gain: 1000 times the logarithm of its smoothed share in the target over that in the source, rounded down."""
    s, t, buckets = float(sum(source)), float(sum(target)), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(map(float, source), map(float, target), strict=True)], np.int64)


def noise(key: str, seed: int) -> int:
    """Gumbel noise of a document, in thousandths, from a digest of its id."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, run: int = RUN, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and the columns `others` of every row of docs; the noise of a null id is that of an empty one."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__key"), F.col(text_col).alias("text"), *others)
    kept = [f for f in own.schema if f.name not in ("__key", "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_words long, n_features long, weight long, score long"])

    def score(batches):
        for b, found in _batches(batches, run):
            words = np.zeros(b.num_rows, np.int64)
            n, weight = words.copy(), np.zeros(b.num_rows)
            for k, (of, crc) in enumerate(found):
                each = np.bincount(of, minlength=b.num_rows)
                n += each
                if k % run == 0:
                    words += each
                weight += np.bincount(of, gain[crc % np.uint32(len(gain))], b.num_rows)
            weight = weight.astype(np.int64)
            chance = np.array([noise(k, seed) for k in b.column("__key").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *map(pa.array, (words, n, weight, weight + chance))], [f.name for f in kept] + ["n_words", "n_features", "weight", "score"])

    return own.mapInArrow(score, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = BUCKETS, run: int = RUN, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank and the columns `others` of every row of docs.

    Words are runs of a-z, 0-9 and characters beyond ASCII once A-Z is lower-cased. Of the rows with at least `min_words` words, `percent` in a hundred
    (rounded down) with the highest scores are drawn and ranked from 1, ties to the smaller id; all other rows have no rank. Null and empty texts have no
    words and weight 0. A null id counts as the largest. Rows that repeat an id are separate documents; among rows alike in score and id the draw takes as
    many as it needs, whichever. Without rows nothing is drawn; a target without words gives each bucket the gain of an empty one.
    A text longer than a slice is worked on by itself, at some ten times its bytes. Further columns of docs are not carried.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, text_col, buckets, run))
    table = scored(docs, gain, run, seed, id_col, text_col, others)
    # a unique row number makes keys unique: a hot key of equal rows is cut where the draw ends
    keys = ["__high", "__id", "__row"]
    table = stash(table.withColumn("__high", -F.col("score")).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn("__row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= min_words
    drawn = table.filter(fit).count() * percent // 100
    if not drawn:
        return table.withColumn("rank", F.lit(None).cast("long")).drop(*keys)
    chosen = fit & up_to(keys, kth_key(table.filter(fit), keys, drawn))
    rest = table.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked(table.filter(chosen), keys).unionByName(rest).drop(*keys)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's texts; one in twenty of those with 20 words or more is drawn."""
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: A CRC is linear: the register after a feature is that of its length in zero bytes, changed by each byte as far as the byte stands from the end.
OP11_SQL = r"""WITH RECURSIVE bit AS (SELECT b, b::BIGINT AS v, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bit WHERE k < 8),
c AS (SELECT b, v FROM bit WHERE k = 8),
w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, id, array_to_string(w[i : i + n - 1], ' ') AS f, count(*) AS n FROM (SELECT side, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 4) t(n) WHERE len(w) >= n) GROUP BY 1, 2, 3),
x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
far AS (SELECT b, v, 0 AS d FROM c UNION ALL SELECT far.b, xor(far.v >> 8, c.v), d + 1 FROM far JOIN c ON c.b = far.v & 255 WHERE d < (SELECT max(len(h)) // 2 FROM x)),
len AS (SELECT 4294967295 AS v, 0 AS d UNION ALL SELECT xor(len.v >> 8, c.v), d + 1 FROM len JOIN c ON c.b = len.v & 255 WHERE d < (SELECT max(len(h)) // 2 FROM x)),
y AS (SELECT f, len(h) // 2 AS n, i, h[2 * i + 1 : 2 * i + 2] AS two FROM (SELECT f, h, unnest(range(len(h) // 2)) AS i FROM x)),
h AS (SELECT f, xor(xor(bit_xor(far.v), any_value(len.v)), 4294967295) % 10000 AS bucket FROM y JOIN (SELECT printf('%02X', b) AS two, v, d FROM far) far ON far.two = y.two AND far.d = n - 1 - i JOIN len ON len.d = n GROUP BY f),
s AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM f JOIN h USING (f) GROUP BY 1),
r AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM s) + 10000)::DOUBLE))) AS BIGINT) AS g FROM s),
v AS (SELECT id, sum(n) AS n_features, sum(n * g) AS weight FROM f JOIN h USING (f) JOIN r USING (bucket) WHERE side = 0 GROUP BY 1),
z AS (SELECT id AS doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + CAST(floor(-1000 * ln(-ln((('0x' || sha256('42:' || id)[1:8])::BIGINT + 0.5) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN v USING (id) WHERE side = 0),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE words >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM k) // 100 THEN rank END AS rank FROM z LEFT JOIN k USING (doc_id)
"""
