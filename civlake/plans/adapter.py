"""The driver's tables seen as civic records: customers are voters, order years elections, nations precincts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.operators.elections import Election, eligibility

FIRST_YEAR = 1995
SCOPED = tuple(range(6))
ELECTIONS = [
    Election(k, str(FIRST_YEAR + k), "special" if k == 5 else "general" if k % 2 == 0 else "primary", provisional=k == 6, scope=SCOPED if k == 5 else None) for k in range(7)
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: voter, bit, election day."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("id"), (F.year("o_orderdate") - FIRST_YEAR).alias("bit"), F.col("o_orderdate").alias("day"))


def voters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, party, precinct, precinct_name, jurisdiction, balance, registered, mask, elig, ballot, returned, category, search."""
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    bit = F.expr(f"shiftleft(1, year(o_orderdate) - {FIRST_YEAR})")
    live = F.when(F.year("o_orderdate") == FIRST_YEAR + 6, F.col("o_orderkey"))
    last = lambda x: F.max_by(x, live)
    per = o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.bit_or(bit).alias("mask"), F.min("o_orderdate").alias("registered"), F.max(live).alias("live"), last("o_orderstatus").alias("status"), last("o_orderdate").alias("when_back"), last("o_orderpriority").alias("priority")
    )
    places = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("precinct"), F.col("n_name").alias("precinct_name"), F.col("r_name").alias("jurisdiction"))
    base = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("party"), F.col("c_nationkey").alias("precinct"), F.col("c_acctbal").alias("balance"))
    v = base.join(places, "precinct").join(per, "id", "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    has = F.col("live").isNotNull()
    return v.select(
        "id", "name", "party", "precinct", "precinct_name", "jurisdiction", "balance", "registered", "mask",
        eligibility(F.col("precinct"), F.col("mask"), ELECTIONS).alias("elig"),
        F.when(has & (F.col("status") == "F"), "returned").when(has, "out").alias("ballot"),
        F.when(has & (F.col("status") == "F"), F.col("when_back")).alias("returned"),
        F.when(has, F.col("priority")).alias("category"),
        F.lower(F.concat_ws(" ", "name", "party", "precinct_name")).alias("search"),
    )


#: The same in SQL; queries go on from its view v.
V = """WITH po AS (
  SELECT o_custkey AS id, bit_or(1 << (year(o_orderdate) - 1995))::INTEGER AS mask, min(o_orderdate) AS registered,
    max(o_orderkey) FILTER (year(o_orderdate) = 2001) AS live
  FROM orders GROUP BY 1),
v AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS party, c_nationkey AS precinct, n_name AS precinct_name, r_name AS jurisdiction, c_acctbal AS balance,
    po.registered, coalesce(mask, 0)::INTEGER AS mask, (coalesce(mask, 0) | 31 | CASE WHEN c_nationkey <= 5 THEN 32 ELSE 0 END)::INTEGER AS elig,
    CASE WHEN o_orderstatus = 'F' THEN 'returned' WHEN o_orderkey IS NOT NULL THEN 'out' END AS ballot,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS returned, o_orderpriority AS category,
    lower(c_name || ' ' || c_mktsegment || ' ' || n_name) AS search
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN po ON c_custkey = po.id LEFT JOIN orders ON o_orderkey = po.live)
"""
