"""A training corpus from raw documents: STAGES in order, each reading what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs.
An empty table passes through; rows with a null text count as empty texts; very long texts are worked on whole. What an operator decides goes back to its own row by a
row key, so that rows without an id or of one id are told apart. A stage returns the columns of its docs whatever they are called, but for
one named __row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.llm import exact_dedup, lsh_forest, mixing, quality, sentence_pieces
from civlake.llm.common import documents, noting, remove, stash, stashed

ROW = "__row"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, takes for good ones.

    Every row is judged by its text, rows of equal texts alike, those without an id or of one id each for itself; an empty or null text is judged as the empty
    text. Without labels, or without positive ones, every score is 0.5 and all rows stay.
    """
    scorer = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, scorer).filter("predicted = 1").select(docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row: its place in the Parquet file it is read from, the same however often it is read; other tables are written first."""
    try:
        return docs.withColumn(ROW, F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), "_metadata.row_index"))
    except AnalysisException:
        return stash(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts, a null id being the largest; its rows all stay if it repeats.

    Null and empty texts are one group. Very long texts are told by their digests.
    """
    rows = keyed(docs)
    found = exact_dedup.exact_dedup(rows, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, others=(ROW,))
    return rows.join(found.filter("kept").select(ROW), ROW, "left_semi").select(docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates (five words, a similarity of 0.8); rows without an id stay.

    Texts without words, null and empty ones among them, stay; so do all rows of an id that stays.
    """
    rows = keyed(docs)
    found = lsh_forest.near_duplicates(rows, 5, 80, others=(ROW,))
    return rows.join(found.filter("kept").select(ROW), ROW, "left_semi").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a row without words, null texts among them, is taken by its source's rate too."""
    rows = keyed(docs)
    taken = mixing.mix(rows, others=(ROW,)).filter("copies > 0").select(ROW, "copies")
    return rows.join(taken, ROW).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of every text, none for null and empty ones; repeated rows stay."""
    return sentence_pieces.encode(docs).select("doc_id", "source", "piece_ids")


STAGES = [("quality", good_quality), ("exact_dedup", exact_copies_out), ("near_dedup", near_copies_out), ("mixing", mixed), ("sentence_pieces", encoded)]

#: SQL cannot express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read back, and what it wrote on the way is removed."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        with noting() as written:
            docs, path = stashed(stage(spark, docs, sf_dir), name)
        remove(spark, [p for p in written if p != path] + before)
        before = [path]
    return docs
