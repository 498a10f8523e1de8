"""Document fingerprints from spot signatures, in DataFrame operations only.

A common word followed by a chain of content words (other common words between them are passed
over, up to three at a time) is a spot. A text's signature set has its spots and the words whose hashes are
the smallest, a few, so that texts with few spots or none have something to compare; the
sorted hashes of the set are its fingerprint. Likeness is the Jaccard similarity of two sets. Near
duplicates are found by joining on each set's rarest spots inside partitions by length, between sets whose
sizes and places allow the similarity asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civlake.llm.common import documents, stash, text_or_empty

#: Words that open a spot, and the common words that its chain passes over; both are parameters of signature().
ANCHORS = tuple("the is was to der ist und die le la est el es los".split())
COMMON = tuple(
    "the of and to in a is that it for was with on be as by this at are from an he or not but his her have had they which you we "
    "der die das und zu den von sich mit des für auf ist im nicht ein eine dem als auch es er sie war aus bei nach "
    "le la les de et en que du un une qui est pour au par dans sur pas avec il elle ce ne se plus son "
    "el los del y las con no para su lo al como más o pero sus una por".split()
)
#: ASCII other than letters and digits parts words; all other characters belong to them.
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CHAIN = 2
#: Words that a signature set holds beside its spots, at most: those with the smallest hashes.
LEAST_WORDS = 16
#: Rows of one spot and length that meet in one block, about.
CELL_ROWS = 1024
#: Ids that one window orders, about, and ranges at most: one window orders a row a range.
IDS_A_RANGE, RANGES = 1024, 4096


def words_of(text: Column) -> Column:
    """Lower-cased words, single spaces around every one."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _APART, " "), F.lit(" "))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for any of the words that tells them apart letter by letter, which a long alternation would not."""
    heads: dict[str, list[str]] = {}
    for w in sorted({w for w in words if w}):
        heads.setdefault(w[0], []).append(w[1:])
    body = "|".join(h + any_of(tuple(rest)) for h, rest in heads.items())
    return f"(?:{body})" + ("?" if "" in words else "") if body else ""


def spot_pattern(anchors: tuple[str, ...] = ANCHORS, common: tuple[str, ...] = COMMON, chain: int = CHAIN) -> str:
    passed = any_of(common)
    return rf"(?= ({any_of(anchors)}(?:(?: {passed}(?= )){{0,3}} (?!{passed} )[^ ]+){{{chain}}}) )"


def signature(text: Column, anchors: tuple[str, ...] = ANCHORS, common: tuple[str, ...] = COMMON, chain: int = CHAIN, least_words: int = LEAST_WORDS) -> Column:
    """The sorted distinct hashes of a text's spots and of those of its words that have the smallest hashes, `least_words` at most.

    All words of the text are hashed, so that like texts have like smallest ones. A text that gains or loses a spot changes by that spot alone; a text without spots is
    told by its words. A text without words has an empty set. Null counts as empty.
    """
    words = words_of(F.coalesce(text, F.lit("")))

    # a lambda's variable holds what is worked out once and used twice
    def both(w: Column) -> Column:
        spots = F.transform(F.regexp_extract_all(w, F.lit(spot_pattern(anchors, common, chain)), F.lit(1)), lambda s: F.xxhash64(s))
        each = F.array_distinct(F.transform(F.filter(F.split(w, " "), lambda x: x != ""), lambda x: F.xxhash64(x)))
        return F.concat(spots, F.slice(F.array_sort(each), 1, least_words))

    return F.sort_array(F.array_distinct(F.transform(F.array(words), both)[0]))


def fingerprint(sig: Column) -> Column:
    """The signature set as text."""
    return F.array_join(sig.cast("array<string>"), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; of two empty ones 1, of an empty and another 0."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rep_a, rep_b, similarity) of pairs of distinct signature sets that are alike; members() tells whose set a row has.

    Rows with equal sets are one class, named by its smallest id (rows without an id take part in no class); each pair of classes appears once. Empty
    sets, of null and wordless texts, are left out. An empty table gives an empty result, and further columns
    are not carried.

    Sets are partitioned by length, each partition 1 / threshold times as wide as the one before, so that alike sets lie in one or in
    neighbouring partitions. Spots are ordered from rare to common over the whole corpus; two sets that are alike share one of the first
    n - ceil(threshold * n) + 1 of each. Pairs whose sizes, or the spots left behind the shared one, do not allow the similarity are
    dropped before sets are fetched. A spot that many sets of a partition have is dealt into pairs of blocks.
    """
    classes = members(docs, id_col, text_col).filter("doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    part = F.floor(F.log(F.col("n")) / F.lit(-math.log(threshold)) + 1e-9)
    classes = stash(classes.filter(F.size("sig") > 0).withColumn("n", F.size("sig")).withColumn("part", part), "spotclasses")
    spots = classes.select("rep", "n", "part", F.explode("sig").alias("spot"))
    often = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = spots.join(often, "spot", "left").withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "spot")))
    first = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefix = stash(ranked.filter((F.col("place") <= first) & F.col("df").isNotNull()).select("rep", "n", "part", "spot", "place"), "spotprefix")
    # a cell holds the sets of a partition and those of the next longer one
    cells = prefix.withColumn("cell", F.explode(F.array(F.col("part"), F.col("part") - 1)))
    size = cells.groupBy("spot", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("blocks"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    dealt = cells.join(size, ["spot", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "part", "place")]
    a = dealt.filter("part = cell").select("spot", "cell", F.col("block").alias("i"), F.explode(others).alias("j"), *side("a"))
    b = dealt.select("spot", "cell", F.explode(others).alias("i"), F.col("block").alias("j"), *side("b"))
    least = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1 >= least
    met = a.join(b, ["spot", "cell", "i", "j"]).filter((F.expr("part_b > part_a or rep_a < rep_b")) & sizes & left)
    pairs = met.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()
    of = lambda x: classes.select(F.col("rep").alias(f"rep_{x}"), F.col("sig").alias(f"s{x}"))
    return pairs.join(of("a"), "rep_a").join(of("b"), "rep_b").withColumn("similarity", likeness(F.col("sa"), F.col("sb"))).filter(F.col("similarity") >= threshold).select("rep_a", "rep_b", "similarity")


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and signature set of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), signature(F.col(text_col)).alias("sig"))


def _predecessors(ids: DataFrame, most: int = IDS_A_RANGE) -> DataFrame:
    """(id, before): the next smaller of some distinct ids, null for the smallest.

    Ids are dealt out by ranges of about equally many rows, whatever their values. Inside a range a window finds the next smaller id;
    the smallest of a range follows the largest of the range below, found over one row a range, of which there are at most RANGES.
    """
    parts = max(1, min(RANGES, -(-ids.count() // most)))
    ranged = stash(ids.repartitionByRange(parts, "id").withColumn("range", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("before", F.lag("id").over(Window.partitionBy("range").orderBy("id")))
    tops = ranged.groupBy("range").agg(F.min("id").alias("id"), F.max("id").alias("last"))
    across = tops.select("id", F.lag("last").over(Window.orderBy("id")).alias("below"))
    return inside.join(across, "id", "left").select("id", F.coalesce("before", "below").alias("before"))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs.

    The edited text has the last third of a text's code points replaced by the first as many of the text of
    the next document in descending id order; the last document's next is the first. Null texts count as empty. Rows that
    repeat an id share one next document, and where the next id repeats, its smallest text is taken. A row with a
    null id has no next: its edited text lacks the last third, and near_next is null. A single document
    is its own next. An empty table gives an empty result; other columns are not carried. Ids are whole numbers.
    """
    # no alias where none is needed: it would keep the two joins below from sharing one shuffle
    own = (docs if id_col == "doc_id" else docs.drop("doc_id").withColumnRenamed(id_col, "doc_id")).withColumn("text", F.coalesce(F.col(text_col), F.lit(""))).select("doc_id", "text")
    own = own if dict(own.dtypes)["doc_id"] == "bigint" else own.withColumn("doc_id", F.col("doc_id").cast("long"))
    known, nameless = own.filter("doc_id is not null"), own.filter("doc_id is null")
    rows = stash(known.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.floor(F.length("text") / 3)).cast("int").alias("taken"), F.count(F.lit(1)).alias("rows")), "ids")
    before = stash(_predecessors(rows.select("id")), "before")
    top, repeats = rows.agg(F.max("id"), F.max("rows") > 1).first()
    order = before.select("id", F.coalesce("before", F.lit(top)).cast("long").alias("next_id")).join(rows, "id")
    asked = order.select(F.col("next_id").alias("doc_id"), F.col("id").alias("for_id"), "taken")
    # each document's set, and as much of its beginning as the one before it takes; `known` is shuffled once for both joins
    given = known.join(asked.hint("merge"), "doc_id").select(F.col("for_id").alias("doc_id"), F.substring("text", F.lit(1), F.col("taken")).alias("head"), signature(F.col("text")).alias("next_sig"), "text")
    given = given.groupBy("doc_id").agg(F.min_by(F.struct("head", "next_sig"), "text").alias("g")).select("doc_id", "g.*") if repeats else given.drop("text")
    alone = nameless.withColumn("head", F.lit(None).cast("string")).withColumn("next_sig", F.lit(None).cast("array<bigint>"))
    joined = known.join(given.hint("merge"), "doc_id").unionByName(alone)
    signed = joined.withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int")).withColumn("sig", signature(F.col("text")))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.coalesce("head", F.lit("")))
    done = signed.withColumn("edited", edited).withColumn("edited_sig", signature(F.col("edited")))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op8_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text and the next document."""
    return edited_and_next(documents(spark, sf_dir))
