"""A quality classifier from positive and unlabelled texts.

A small network scores surface features of a text. It is fitted by minimising the non-negative
unbiased risk (trusted positives, unlabelled texts and a class prior): the negatives' risk, estimated from
the unlabelled less the positives' share, may not fall below zero; where it would, the step goes the other way.
The prior itself is estimated from how a plain positive-against-unlabelled score ranks the two samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.llm.common import documents, slices, utf8

#: The bound of the sample that the model is fitted on.
POSITIVES, UNLABELLED = 4000, 10000
HIDDEN, STEPS, RATE, DECAY = 8, 300, 0.01, 3e-2
#: The estimated prior errs upwards (finite samples overlap), and too high a prior hides whole kinds of negatives; it is taken this much lower.
PRIOR_SHADE = 0.99
N_FEATURES = 256 + 12
#: Bytes of text whose features are worked out at a time; numpy holds some sixty times as much meanwhile.
SLICE = 1 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers for each text: byte shares (as roots) and how words, lines and cases run."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    counts = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    total = np.maximum(sizes, 1)[:, None]
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :256] = np.sqrt(counts / total)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = white[1:] != white[:-1]
    edge[offsets] = True
    # words as runs of bytes that are not white space, and a hash of each
    at = np.flatnonzero(edge[:-1]) if len(data) else np.zeros(0, np.int64)
    if len(at):
        weight = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        within = np.arange(len(data), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(data)))).astype(np.uint64)
        mixed = weight ^ (within * np.uint64(0xBF58476D1CE4E5B9))
        mixed ^= mixed >> np.uint64(29)
        hashes = np.add.reduceat(mixed * np.uint64(0x94D049BB133111EB), at)
        length = np.diff(np.append(at, len(data)))
        is_word = ~white[at]
        hashes, length, of = hashes[is_word], length[is_word], owner[at][is_word]
        words = np.maximum(np.bincount(of, minlength=n), 1)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        distinct = np.zeros(n)
        if len(hashes):
            order = np.lexsort((hashes, of))
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
            distinct = np.bincount(of[order][new], minlength=n)
        extra = [
            np.bincount(of, again, n) / words,
            distinct / words,
            np.bincount(of, length, n) / words / 10,
            np.bincount(of, length >= 15, n) / words,
            np.bincount(of, length == 1, n) / words,
            np.log1p(words) / 10,
            words / total[:, 0],
        ]
        out[:, 256 : 256 + len(extra)] = np.stack(extra, 1)
    share = lambda lo, hi: counts[:, lo : hi + 1].sum(1) / total[:, 0]
    out[:, 263] = share(65, 90)
    out[:, 264] = share(48, 57)
    out[:, 265] = share(33, 47) + share(58, 64) + share(91, 96) + share(123, 126)
    out[:, 266] = share(10, 10) * 10
    out[:, 267] = sizes == 0
    return out


@dataclass
class Scorer:
    """The fitted network; a few thousand numbers."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ w1 + b1) @ w2 + b2
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk_and_gradient(w: list[np.ndarray], x: np.ndarray, positive: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """The risk of the network w and the direction to descend along.

    With a prior, the risk of positives and that of negatives, which is the unlabelled rows' less the prior's share of the positives'; where it is
    below zero the direction is that which raises it. Without, the plain risk of telling positive from unlabelled rows.
    """
    n_p, n_u = positive.sum(), (~positive).sum()
    h = np.tanh(x @ w[0] + w[1])
    z = np.clip(h @ w[2] + w[3], -40, 40)
    g = 1 / (1 + np.exp(-z))
    as_positive, as_negative = np.log1p(np.exp(-z)), np.log1p(np.exp(z))
    # the logistic loss of calling a row positive has slope g - 1, of calling it negative g
    if prior is None:
        risk = as_positive[positive].mean() + as_negative[~positive].mean()
        slope = np.where(positive, (g - 1) / n_p, g / n_u)
    else:
        negatives = as_negative[~positive].mean() - prior * as_negative[positive].mean()
        risk = prior * as_positive[positive].mean() + max(negatives, 0.0)
        if negatives >= 0:
            slope = np.where(positive, (prior * (g - 1) - prior * g) / n_p, g / n_u)
        else:
            slope = np.where(positive, prior * g / n_p, -g / n_u)
    dh = slope[:, None] * w[2] * (1 - h * h)
    return float(risk), [x.T @ dh, dh.sum(0), h.T @ slope, slope.sum(keepdims=True)]


def _fit(x: np.ndarray, positive: np.ndarray, prior: float | None, seed: int = 7) -> list[np.ndarray]:
    """Adam on the non-negative risk with the logistic loss; without a prior, plain positive against unlabelled."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, STEPS + 1):
        _, grads = risk_and_gradient(w, x, positive, prior)
        for k in (0, 2):
            grads[k] += DECAY * w[k]
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def estimated_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled: the least ratio, over thresholds, of unlabelled to positive rows above.

    Above a threshold that only positives pass, the ratio is the prior itself; both shares carry a margin for their sample's size.
    """
    cuts = np.quantile(positive_scores, np.linspace(0, 0.99, 200))
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, side="left") / len(s)
    p, u = above(positive_scores), above(unlabelled_scores)
    margin = lambda n: np.sqrt(np.log(4 / delta) / (2 * n))
    upper = (u + margin(len(unlabelled_scores)) + margin(len(positive_scores))) / np.maximum(p, 1e-9)
    k = int(np.argmin(upper))
    return float(np.clip(u[k] / p[k], 0.05, 0.98))


def fit(docs: DataFrame, trusted: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Scorer:
    """Fit on at most `positives` of the trusted doc_ids and `unlabelled` ids of docs (doc_id, text), the smallest by hash.

    The unlabelled sample is drawn from all rows, trusted and held-out ones among them, without a look at any label. Only the sample's ids
    are broadcast, and one row of features an id reaches the driver: of rows that repeat an id, the one with the smallest text; rows without an id are
    not used, null texts count as empty, very long ones are read whole. Without any positive, or without documents, every score is 0.5; with a single one
    the prior cannot be read off and is taken as one half. Further columns are ignored.
    """
    order = F.xxhash64("doc_id", F.lit(17))
    p_ids = trusted.select("doc_id").filter("doc_id is not null").distinct().orderBy(order).limit(positives)
    u_ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(order).limit(unlabelled)
    ids = p_ids.withColumn("positive", F.lit(True)).unionByName(u_ids.withColumn("positive", F.lit(False)))
    # texts of one id meet in partial aggregates, so that an id that many rows have is one row
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("positive", "doc_id").agg(F.min("text").alias("text"))

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                x = features(*utf8(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array([r.tobytes() for r in x], pa.binary())], ["positive", "x"])

    got = sorted((p, bytes(x)) for p, x in rows.mapInArrow(run, "positive boolean, x binary").collect())
    positive = np.array([p for p, _ in got], bool)
    x = np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    del got
    if not positive.any() or positive.all():
        return Scorer(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)], 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-2
    # in place: the sample is the largest thing that the driver's Python holds
    x -= mean
    x /= scale
    np.clip(x, -6, 6, out=x)
    # half of either sample fits the ranking from which the prior is read off the other half
    half = np.zeros(len(x), bool)
    for own in (np.flatnonzero(positive), np.flatnonzero(~positive)):
        half[np.random.default_rng(3).permutation(own)[: (len(own) + 1) // 2]] = True
    prior = 0.5
    if all((part & (positive == p)).any() for part in (half, ~half) for p in (True, False)):
        w1, b1, w2, b2 = _fit(x[half], positive[half], None)
        rank = np.tanh(x[~half] @ w1 + b1) @ w2 + b2
        prior = estimated_prior(rank[positive[~half]], rank[~positive[~half]])
    return Scorer(mean, scale, _fit(x, positive, PRIOR_SHADE * prior), prior)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null texts count as empty; very long ones are scored whole; equal texts have equal scores, whatever their ids. An empty table
    gives an empty result. Columns of these names are replaced, others are kept.
    """
    rows = docs.drop("score", "predicted")
    schema = docs.drop("score", "predicted").schema.add("score", "double").add("predicted", "integer")

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col, SLICE):
                # rounded, so that equal texts have equal scores whatever stands beside them in a batch
                s = np.round(scorer.scores(features(*utf8(b.column(text_col)))), 9)
                b = b.append_column("score", pa.array(s, pa.float64()))
                yield b.append_column("predicted", pa.array((s >= 0.5).astype(np.int32), pa.int32()))

    return rows.mapInArrow(run, schema)


def held_out():
    """Whether a row's labels are kept from learning; rows without an id are."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def trained(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on the labels of rows that are not held out; only their positives are used. See fit() for empty tables, nulls and repeats."""
    return fit(docs, labels.filter((F.col("quality") == 1) & ~held_out()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the positive labels of rows whose crc32(doc_id) mod 3 is not 1, and the estimated prior."""
    docs = documents(spark, sf_dir)
    scorer = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), scorer).drop("text").withColumn("prior", F.lit(float(scorer.prior)))
