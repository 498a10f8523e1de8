"""Landed files as DataFrames: chunked parcel files, delimited rolls, ballot layouts, job logs; and the same back out."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civlake.functions.columns import iso_date
from civlake.operators.ingest import is_returned

PARCELS = "n string, o string, d string, u string, j string, td string, tw string, a double, lm double, bm double, tm double, ta double, s string, f string, z string, y double, x double, c int, p string"
RUNS = "id long, fullName string, repo string, workflow string, file string, event string, conclusion string, startedAt timestamp, durationS double, url string, commit struct<sha:string,message:string,url:string>"
#: Never read from a roll.
PRIVATE = ("DATE_OF_BIRTH",)
ROLL = ("COUNTY_ID", "LAST_NAME", "FIRST_NAME", "REGISTRATION_DATE", "VOTER_STATUS", "PARTY_AFFILIATION", "RESIDENTIAL_ADDRESS1", "RESIDENTIAL_ZIP", "PRECINCT_NAME")
BALLOTS = ("LASTN", "FIRSTN", "CNTYIDNUM", "AVSENTDATE", "AVRECVDATE", "AVRECVMETH", "AVAPPTYPE", "AVBALSTAT")


def read_chunks(spark: SparkSession, paths: list[str], count: int | None = None, on_mismatch: str = "fail", schema: str = PARCELS) -> DataFrame:
    """JSON arrays in several files as one DataFrame; if `count` is given and the rows are not so many: fail, warn or ignore.

    A file that is missing, or that holds a page of HTML or broken JSON, fails with its name.
    """
    try:
        landed = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(paths)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"a chunk is missing: {e.getMessageParameters()['path']}") from e
        raise
    rows = landed.select("*", F.col("_metadata.file_name").alias("_file"))
    bad = rows.filter("_corrupt is not null").select("_file", F.ltrim("_corrupt").startswith("<").alias("html"), rows.columns[0]).first()
    if bad:
        raise ValueError(f"{bad['_file']} holds {'a page of HTML' if bad['html'] else 'broken JSON'}, not records")
    if count is not None and on_mismatch != "ignore":
        found = rows.count()
        if found != count:
            message = f"the manifest says {count} records, the files hold {found}"
            if on_mismatch == "fail":
                raise ValueError(message)
            warnings.warn(message, stacklevel=2)
    return rows.drop("_corrupt", "_file")


def read_delimited(spark: SparkSession, path: str, required: tuple[str, ...] = (), sep: str = ",", multi_line: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, all columns as text; lines end in LF, CR LF or CR, and a mark of byte order is no part of the first name. multi_line reads quoted line ends, at the price of files that are not split. ValueError names
    required columns that are missing."""
    df = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("encoding", encoding).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    return df.drop(*PRIVATE)


def election_columns(columns: list[str], since: int = 2020) -> list[str]:
    """The columns of a roll that stand for elections from a year on, in order of their dates."""
    found = [(c, *c.split("-", 1)[1].split("/")) for c in columns if c.split("-")[0] in ("PRIMARY", "GENERAL", "SPECIAL") and c.count("/") == 2]
    return [c for c, m, d, y in sorted(found, key=lambda x: (x[3], x[1], x[2])) if int(y) >= since]


def read_roll(spark: SparkSession, path: str, since: int = 2020) -> tuple[DataFrame, list[str]]:
    """(roll, elections): one row a voter with a mask of the elections voted in; rows without a whole-number id are left out, and of a repeated id the last in the file stays."""
    df = read_delimited(spark, path, ROLL)
    names = election_columns(df.columns, since)
    if len(names) > 31:
        raise ValueError(f"{len(names)} elections do not fit in a mask of 31")
    mask = F.lit(0)
    for k, c in enumerate(names):
        mask = mask.bitwiseOR(F.when(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "", F.lit(1 << k)).otherwise(0))
    second = F.trim(F.coalesce(F.col("RESIDENTIAL_SECONDARY_ADDR"), F.lit(""))) if "RESIDENTIAL_SECONDARY_ADDR" in df.columns else F.lit("")
    rows = df.select(
        F.col("COUNTY_ID").try_cast("long").alias("id"),
        F.upper(F.trim("LAST_NAME")).alias("last"),
        F.upper(F.trim("FIRST_NAME")).alias("first"),
        F.coalesce(F.nullif(F.trim("VOTER_STATUS"), F.lit("")), F.lit("UNKNOWN")).alias("status"),
        F.coalesce(F.nullif(F.trim("PARTY_AFFILIATION"), F.lit("")), F.lit("--")).alias("party"),
        F.substring(F.trim("RESIDENTIAL_ZIP"), 1, 5).alias("zip"),
        F.concat(F.trim("RESIDENTIAL_ADDRESS1"), F.when(second != "", F.concat(F.lit(" # "), second)).otherwise("")).alias("address"),
        F.trim("PRECINCT_NAME").alias("precinct"),
        F.col("REGISTRATION_DATE").try_cast("date").alias("registered"),
        mask.alias("mask"),
        F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"),
    ).filter("id is not null")
    rest = [c for c in rows.columns if c not in ("id", "at")]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*rest), "at").alias("r"))
    return last.select("id", "r.*"), names


def rows_left_out(spark: SparkSession, path: str, key: str = "COUNTY_ID", sep: str = ",", multi_line: bool = False) -> DataFrame:
    """why, n of the rows of a roll that cannot be taken: "width", more or fewer cells than the header has, else "id", no whole number."""
    names = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path).columns
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in names), T.StructField("_wrong", T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_wrong").option("enforceSchema", True).option("columnPruning", False).csv(path)  # a pruned read counts no cells
    why = F.when(F.col("_wrong").isNotNull(), "width").when(~F.coalesce(F.trim(f"`{key}`"), F.lit("")).rlike(r"^\d+$"), "id")
    return rows.select(why.alias("why"), *[F.col(f"`{c}`") for c in names]).filter("why is not null").groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def malformed_rows(df: DataFrame, key: str = "COUNTY_ID") -> int:
    """How many rows read_roll leaves out, since their id is no whole number."""
    return df.filter(F.col(key).try_cast("long").isNull()).count()


def is_ballot_layout(columns: list[str]) -> bool:
    """Whether a header is of the ballot interchange layout."""
    return {"CNTYIDNUM", "AVAPPTYPE"} <= set(columns)


def ballots(df: DataFrame, seq: Column) -> DataFrame:
    """id, issued, back, returned, category, issue from the interchange layout; of a voter's rows the last counts."""
    rows = df.select(
        F.col("CNTYIDNUM").try_cast("long").alias("id"),
        iso_date(F.col("AVSENTDATE")).alias("issued"),
        iso_date(F.col("AVRECVDATE")).alias("back"),
        is_returned(F.nullif(F.trim("AVRECVDATE"), F.lit("")), F.col("AVRECVMETH"), F.col("AVBALSTAT")).alias("returned"),
        F.col("AVAPPTYPE").alias("category"),
        F.when(F.coalesce("AVBALSTAT", F.lit("")).isin("", "VALID"), F.lit("")).otherwise(F.col("AVBALSTAT")).alias("issue"),
        seq.alias("seq"),
    ).filter("id is not null")
    last = rows.groupBy("id").agg(F.max_by(F.struct("issued", "back", "returned", "category", "issue"), "seq").alias("b"))
    return last.select("id", "b.*")


def read_runs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A log of job runs, one JSON record a line; torn lines are left out."""
    return spark.read.schema(RUNS).option("mode", "DROPMALFORMED").json(paths).filter("id is not null")


def read_geocoder(responses: DataFrame, column: str = "body") -> DataFrame:
    """responses exploded to matched, lat, lon; entries without coordinates are left out."""
    kind = "result struct<addressMatches:array<struct<matchedAddress:string,coordinates:struct<x:double,y:double>>>>"
    match = responses.withColumn("m", F.explode(F.from_json(column, kind)["result"]["addressMatches"]))
    return match.select(*responses.columns, F.col("m.matchedAddress").alias("matched"), F.col("m.coordinates.y").alias("lat"), F.col("m.coordinates.x").alias("lon")).filter("lat is not null and lon is not null")


def write_csv(df: DataFrame, path: str, quote_all: bool = False, line_end: str = "\n") -> None:
    """With a header; quotes are doubled. One file a task."""
    df.write.option("header", True).option("quoteAll", quote_all).option("escape", '"').option("emptyValue", "").option("lineSep", line_end).csv(path)


def election_flags(df: DataFrame, labels: list[str], mask: str = "mask") -> list[Column]:
    """A Y/N column for each election, and how many were voted in."""
    flags = [F.when(F.col(mask).bitwiseAND(F.lit(1 << k)) != 0, "Y").otherwise("N").alias(x) for k, x in enumerate(labels)]
    return [*flags, F.bit_count(mask).cast("int").alias("elections_voted")]


def read_csv_back(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_csv wrote; line ends in fields are read."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
