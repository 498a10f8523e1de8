"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Each distinct shingle set has a signature of MinHash values. Each tree of the forest is one order of
the signatures; range partitioning deals the sorted rows out, so that no group of alike rows has to fit in one task. Neighbours
with a long common prefix, whose further values mostly agree, are candidates, and candidates that
hang together are a family. A family's full sets are compared exactly. A family too large for one
task is cut into regions of the trees, each as deep as its size asks for, which ties most of it together;
sets of it that are still apart are then joined on their rarest shingles, so that no link in a family is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civlake.llm.common import documents, join_hot, slices, stash, utf8
from civlake.llm.graph import components, spanning
from civlake.llm.shingles import TEXT_BITS, mixed, shingle_sets

TREES, DEPTH, PATH, VALUE_BYTES = 16, 3, 10, 3
#: Of the values behind the common prefix, so many agree in candidates: 4 of 7 miss one of a hundred pairs of similarity 0.85 in a tree.
AGREE, BACK = 4, 3
#: A family or region compared in one task holds at most so many sets and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 2_000_000
#: Rows of one shingle that meet in one block of the join on rare shingles, and shingles in a piece of a set, about.
KEY_ROWS, PIECE_SHINGLES = 1024, 4096
SLICE = 1 << 20
_FACTORS = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of TREES * DEPTH MinHash values for each set that is not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), len(_FACTORS)), np.uint32)
    if len(starts):
        for j, f in enumerate(_FACTORS):
            out[:, j] = np.minimum.reduceat(((hashes + f) * f) >> np.uint64(32), starts)
    return out


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers by which equal sets are known; 0 and 0 for empty ones."""
    some = np.diff(bounds) > 0
    one, two = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
    if some.any():
        one[some] = np.add.reduceat(mixed(hashes + np.uint64(1)), bounds[:-1][some])
        two[some] = np.add.reduceat(mixed(hashes * np.uint64(0xD1342543DE82EF95) + np.uint64(7)), bounds[:-1][some])
    return one.view(np.int64), two.view(np.int64)


def paths(signature: np.ndarray, tree: int) -> np.ndarray:
    """Each row's sort key in a tree, PATH values of VALUE_BYTES bytes."""
    at = (tree * DEPTH + np.arange(PATH)) % signature.shape[1]
    values = np.ascontiguousarray(signature[:, at].astype(">u4")).view(np.uint8).reshape(-1, PATH, 4)
    return np.ascontiguousarray(values[:, :, 4 - VALUE_BYTES :]).reshape(-1, PATH * VALUE_BYTES)


def _signed(docs: DataFrame, k: int, others: tuple[str, ...] = ()) -> DataFrame:
    kept_types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *others))

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE, 1 << TEXT_BITS):
                hashes, bounds = shingle_sets(*utf8(b.column("text")), k)
                one, two = set_keys(hashes, bounds)
                some = np.diff(bounds) > 0
                sig = iter(signatures(hashes, bounds))
                kept = pa.array([next(sig).tobytes() if x else None for x in some], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *others)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(one), pa.array(two), kept], ["doc_id", *others, "n_shingles", "s1", "s2", "sig"])

    return docs.select("doc_id", "text", *others).mapInArrow(run, f"{kept_types}, n_shingles long, s1 long, s2 long, sig binary")


def _forest(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, tree and path of each row (rep, sig) in each tree."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", tree int, path binary"

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
            for t in range(TREES):
                path = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PATH * VALUE_BYTES), len(sig), [None, pa.py_buffer(paths(sig, t))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(np.full(len(sig), t, np.int32)), path], [*keys, "tree", "path"])

    return rows.select(*keys, "sig").mapInArrow(run, schema)


def _neighbours(batches):
    """Links between rows that lie near each other in a tree's order and agree."""

    def pairs():
        held = None
        for b in batches:
            path = np.frombuffer(b"".join(b.column("path").to_pylist()), np.uint8).reshape(-1, PATH, VALUE_BYTES)
            rep, tree = b.column("rep").to_numpy(), b.column("tree").to_numpy()
            if held:
                path, rep, tree = (np.concatenate(x) for x in zip(held, (path, rep, tree), strict=True))
            for back in range(1, BACK + 1):
                same = (path[back:] == path[:-back]).all(2)
                fits = (tree[back:] == tree[:-back]) & same[:, :DEPTH].all(1) & (same[:, DEPTH:].sum(1) >= AGREE)
                yield rep[back:][fits].tolist(), rep[:-back][fits].tolist()
            held = path[-BACK:], rep[-BACK:], tree[-BACK:]

    return spanning(pairs())


def linked_sets(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """A number for each set; sets that chains of links join, each of intersection * 100 >= percent * union, have the same."""
    m = len(bounds) - 1
    label = np.full(m, -1)
    vocab, ids = np.unique(hashes, return_inverse=True)
    sizes = np.diff(bounds)
    mark = np.zeros(len(vocab), bool)
    left = np.arange(m)  # not reached yet
    flat, starts = ids, bounds[:-1]
    for first in range(m):
        if label[first] >= 0:
            continue
        label[first], queue = first, [first]
        while queue:
            i = queue.pop()
            own = ids[bounds[i] : bounds[i + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            near = (label[left] < 0) & (100 * both >= percent * (sizes[left] + sizes[i] - both))
            label[left[near]] = first
            queue += left[near].tolist()
            gone = label[left] >= 0
            if gone.sum() > len(left) // 4:
                left = left[~gone]
                if not len(left):
                    return label
                flat = np.concatenate([ids[bounds[j] : bounds[j + 1]] for j in left])
                starts = np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
    return label


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, rep, hot), sets that are compared with each other in one task, and (root, rep, n) of the families too large for one; from (root, rep, n, sig)."""
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    fits = (F.col("sets") <= BLOCK_SETS) & (F.col("shingles") <= BLOCK_SHINGLES)
    sized = members.join(size, "root")
    small = sized.filter(fits).select(F.col("root").alias("block"), "rep", F.lit(False).alias("hot"))
    hot = stash(_forest(sized.filter(~fits), "root", "rep", "n"), "hot")
    done, large = small, hot.filter("tree = 0").select("root", "rep", "n")
    for depth in range(DEPTH, PATH + 1):
        if hot.isEmpty():
            return done, large
        block = F.xxhash64("root", "tree", F.substring("path", 1, depth * VALUE_BYTES))
        level = hot.withColumn("block", block)
        size = level.groupBy("block").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"), F.min("rep").alias("pivot"))
        sized = level.join(size, "block")
        done = done.unionByName(sized.filter(fits & (F.col("sets") > 1)).select("block", "rep", F.lit(True).alias("hot")))
        hot = stash(sized.filter(~fits), "hot")
        level, hot = hot, hot.select("root", "rep", "n", "tree", "path")
    # rows with one whole path are alike; parts of them are tied together by the smallest
    parts = F.greatest(F.ceil(F.col("sets") / (BLOCK_SETS // 2)), F.ceil(F.col("shingles") / (BLOCK_SHINGLES // 2)))
    part = lambda k: F.xxhash64("block", k).alias("block")
    spread = level.filter("rep != pivot").select(part(F.pmod(F.xxhash64("rep"), parts)), "rep", F.lit(True).alias("hot"))
    pivots = level.filter("rep = pivot").select("block", "rep", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("k")).select(part(F.col("k")), "rep", F.lit(True).alias("hot"))
    return done.unionByName(spread).unionByName(pivots), large


def _pieces(texts: DataFrame, k: int) -> DataFrame:
    """(root, comp, rep, n, own, piece, part): the shingle set `own` of each text in `pieces` ranges of hash values."""
    schema = "root long, comp long, rep long, n long, own long, piece long, part array<long>"

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", SLICE, 1 << TEXT_BITS):
                hashes, bounds = shingle_sets(*utf8(b.column("text")), k)
                one, _ = set_keys(hashes, bounds)
                for i, (root, comp, rep, pieces) in enumerate(zip(*(b.column(c).to_pylist() for c in ("root", "comp", "rep", "pieces")), strict=True)):
                    own = hashes[bounds[i] : bounds[i + 1]]
                    width = -(-(1 << 64 - TEXT_BITS) // pieces)
                    cuts = np.searchsorted(own, np.arange(pieces + 1, dtype=np.uint64) * np.uint64(width))
                    some = np.flatnonzero(np.diff(cuts))
                    if not len(some):
                        continue
                    part = pa.ListArray.from_arrays(pa.array(np.append(cuts[some], cuts[some[-1] + 1]).astype(np.int32)), pa.array(own.astype(np.int64)))
                    same = [pa.array(np.full(len(some), x, np.int64)) for x in (root, comp, rep, len(own), one[i])]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(some.astype(np.int64)), part], ["root", "comp", "rep", "n", "own", "piece", "part"])

    return texts.mapInArrow(run, schema)


def _rest(own: DataFrame, large: DataFrame, tied: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (a, b) between sets of one large family that lie in different components of `tied` (rep, comp).

    With the shingles of a family ordered from rare to common, two sets of the similarity asked for share one of the
    first n - ceil(percent * n / 100) + 1 of each. A shingle that many sets have there is dealt into pairs of
    blocks. What meets is compared by whole sets, piece by piece, so that no set has to fit in one row.
    """
    held = large.join(tied, "rep", "left").groupBy("root", "rep").agg(F.coalesce(F.first("comp"), "rep").alias("comp"), F.max("n").alias("n"))
    apart = held.groupBy("root").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.ceil(F.max("n") / PIECE_SHINGLES).alias("pieces"))
    wanted = held.join(apart.filter("least < most").select("root", "pieces"), "root").select("root", "rep", "comp", "pieces")
    texts = own.join(wanted.hint("merge"), own.doc_id == wanted.rep).select("root", "comp", "rep", "pieces", "text")
    # a document's rows of one text are one set
    pieces = stash(_pieces(texts, k).dropDuplicates(["rep", "own", "piece"]), "pieces")
    each = pieces.select("root", "comp", "rep", "n", "own", F.explode("part").alias("shingle"))
    often = each.groupBy("root", "shingle").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("rep", "own").orderBy("df", "shingle"))
    first = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    prefix = each.join(often.filter("df > 1"), ["root", "shingle"], "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("place", place)
    prefix = stash(prefix.filter((F.col("place") <= first) & (F.col("df") > 1)).select("root", "shingle", "comp", "rep", "own", "n"), "prefix")
    keys = prefix.groupBy("root", "shingle").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most")
    dealt = prefix.join(keys.select("root", "shingle", F.ceil(F.col("rows") / KEY_ROWS).alias("blocks")), ["root", "shingle"]).withColumn("block", F.pmod(F.xxhash64("rep", "own"), "blocks"))
    a = dealt.select("root", "shingle", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), *(F.col(c).alias(f"{c}_a") for c in ("comp", "rep", "own", "n")))
    b = dealt.select("root", "shingle", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), *(F.col(c).alias(f"{c}_b") for c in ("comp", "rep", "own", "n")))
    fits = "comp_a != comp_b and (i < j or rep_a < rep_b)" + f" and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    # inside one block each pair meets both ways, between two blocks once
    met = a.join(b, ["root", "shingle", "i", "j"]).filter(fits).withColumn("turned", F.col("rep_a") > F.col("rep_b"))
    side = lambda c, x, y: F.when(F.col("turned"), F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}")
    pairs = stash(met.select(*(side(c, x, y) for c in ("rep", "own", "n") for x, y in ("ab", "ba"))).distinct(), "pairs")
    of = lambda x: pieces.select(F.col("rep").alias(f"rep_{x}"), F.col("own").alias(f"own_{x}"), "piece", F.col("part").alias(f"part_{x}"))
    both = pairs.join(of("a"), ["rep_a", "own_a"]).join(of("b"), ["rep_b", "own_b", "piece"])
    shared = both.groupBy("rep_a", "own_a", "n_a", "rep_b", "own_b", "n_b").agg(F.sum(F.size(F.array_intersect("part_a", "part_b"))).alias("both"))
    return shared.filter(f"100 * both >= {percent} * (n_a + n_b - both)").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the columns `others` of every row of docs.

    Texts whose sets of k-word shingles have 100 * intersection >= percent * union are linked; a component is
    named by the smallest id in it, whose row is kept. A text without words, or null, has an empty set
    and stands alone. Rows that repeat an id are one
    document as far as links go. A row with a null id stands alone with a null component_id, and is kept. An empty table gives an
    empty result, and further columns of docs are not carried. Ids are whole numbers.

    Every link between two sets of one family is found, whatever the family's size. Sets come into one family if chains of
    candidates join them, which share a tree's first DEPTH values and agree behind them: of
    two sets of similarity 0.85 one pair in three million never does.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *others)
    rows = stash(_signed(own, k, others), "signed")
    classes = stash(rows.filter("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "classes")
    ordered = _forest(classes, "rep").repartitionByRange("tree", "path", "rep").sortWithinPartitions("tree", "path", "rep")
    families = stash(components(ordered.mapInArrow(_neighbours, "a long, b long"), spanned=True), "families")
    members = families.join(classes.select(F.col("rep").alias("node"), "n", "sig"), "node").select("root", F.col("node").alias("rep"), "n", "sig")
    blocks, large = _blocks(members)
    blocks = stash(blocks, "blocks")
    texts = own.join(blocks.hint("merge"), own.doc_id == blocks.rep).select("block", "hot", "rep", "text")

    def link(table: pa.Table) -> pa.Table:
        hashes, bounds, reps = [], [0], []
        for b in table.combine_chunks().to_batches():
            for s in slices(b, "text", SLICE, 1 << TEXT_BITS):
                h, own_bounds = shingle_sets(*utf8(s.column("text")), k)
                hashes.append(h)
                bounds += (own_bounds[1:] + bounds[-1]).tolist()
                reps += s.column("rep").to_pylist()
        bounds, reps = np.array(bounds), np.array(reps)
        some = np.diff(bounds) > 0
        reps, bounds = reps[some], np.append(bounds[:-1][some], bounds[-1])
        label = linked_sets(np.concatenate(hashes), bounds, percent) if len(reps) else np.zeros(0, int)
        least = {}
        for r, x in zip(reps.tolist(), label.tolist(), strict=True):
            least[x] = min(r, least.get(x, r))
        pairs = [(r, least[x]) for r, x in zip(reps.tolist(), label.tolist(), strict=True) if r != least[x]]
        hot = table.column("hot")[0].as_py()
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64()), "hot": pa.array([hot] * len(pairs), pa.bool_())})

    links = stash(texts.groupBy("block").applyInArrow(link, "a long, b long, hot boolean"), "confirmed")
    tied = components(links.filter("hot").select("a", "b")).toDF("rep", "root")
    if not large.isEmpty():
        rest = stash(_rest(own, large, tied.toDF("rep", "comp"), k, percent), "rest")
        if not rest.isEmpty():
            tied = components(tied.toDF("a", "b").unionByName(rest)).toDF("rep", "root")
    found = links.filter("not hot").select(F.col("a").alias("rep"), F.col("b").alias("root")).unionByName(tied)
    found = found.groupBy("rep").agg(F.min("root").alias("root"))
    named = stash(classes.join(found, "rep", "left").select("s1", "s2", "copies", F.coalesce("root", "rep").alias("root")), "named")
    has_class = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    total, largest = named.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    met = join_hot(rows.filter(has_class), named, ["s1", "s2"], "copies", total, largest).drop("copies")
    final = met.unionByName(rows.filter(~has_class).withColumn("root", F.lit(None).cast("long"))).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")))
    return final.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *others)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by 3-word shingles and 85 per cent."""
    return near_duplicates(documents(spark, sf_dir), 3, 85)


OP10_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, least(a, min(b)) AS root FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id, coalesce(root, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""
