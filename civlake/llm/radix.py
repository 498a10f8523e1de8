"""Exact selection and ranking of rows by whole-number keys, without sorting the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civlake.llm.common import stash

#: Values of one digit, and so the most counts that come to the driver in a round.
DIGIT = 1 << 16


def kth_key(rows: DataFrame, keys: list[str], k: int) -> tuple[int, ...] | None:
    """The k-th smallest (from 1) of the rows' composite keys, which are long columns without nulls; None if there are fewer rows.

    Digit by digit from the highest: each round counts the rows still in question by their next digit and goes
    on with the digit in which the k-th lies, in the first column until its value is known, then among equals in the next. A round reads
    the keys once and shuffles at most DIGIT counts a task.
    """
    within, found = rows.select(*keys), []
    for key in keys:
        low, high, n = within.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if n < k or k < 1:
            return None
        while low < high:
            width = 1
            while (high - low) // width >= DIGIT:
                width *= DIGIT
            offset = F.col(key).cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
            digit = within.filter(F.col(key).between(low, high)).select(offset.alias("o")).select(F.expr(f"o div {width}BD").alias("digit"))
            for at, count in sorted(digit.groupBy("digit").agg(F.count(F.lit(1))).collect()):
                if k <= count:
                    break
                k -= count
            low, high = low + at * width, min(high, low + (at + 1) * width - 1)
        found.append(low)
        within = within.filter(F.col(key) == low)
    return tuple(found)


def up_to(keys: list[str], bound: tuple[int, ...]):
    """The condition that a row's composite key is not above the bound."""
    reached = F.lit(True)
    for key, value in reversed(list(zip(keys, bound, strict=True))):
        reached = (F.col(key) < value) | ((F.col(key) == value) & reached)
    return reached


def ranked(rows: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """rows with their rank by the keys from 1, by a range sort: a row's place in its partition behind the partitions before it."""
    spark = rows.sparkSession
    placed = stash(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__place", 33)
    before, starts = 0, []
    for p, n in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect()):
        starts.append((p, before))
        before += n
    starts = spark.createDataFrame(starts, "__part long, __before long")
    numbered = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.withColumn(rank, F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__before", "__place")
