"""Best row of a key, medians, samples, runs, pages: what is asked of rows in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civlake.scratch import checkpointed, stashed


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is largest by `order` (structs compare field by field); a partial aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


#: Parts of about equally many values that a key's values are counted by in a round, and different values of a key that are ordered at last, at most.
PARTS, ORDERED = 32, 4096


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and upper_median, the value at place floor(n / 2) of a key's sorted values that are not null, for any number of keys."""
    return selected(df, keys, value, lambda n: F.floor(n / 2), "upper_median")


def selected(df: DataFrame, keys: list[str], value: str, place, name: str) -> DataFrame:
    """keys and `name`, the value at a place (from 0, a function of a key's number of values) of each key's sorted values that are not null.

    All keys narrow at once: a round takes cuts from a sketch of each key's values, counts the values between the cuts exactly, and goes on with the part in which the place lies. The
    sketch only has to cut well, not to be right. The first round has two cuts, close around the place; later ones, over values that rows share only once with their counts, many, so that what is
    left shrinks each time whatever the values are. Counts are partial aggregates, and a key's window sees a row a part. When no key has more than ORDERED different values left, these are ordered. The rows are
    computed once and written to the shared folder, as is what is left after a round. A place that no value has gives no row.
    """
    by = Window.partitionBy(*keys)
    v, at, after = F.col("__v"), F.col("__at"), F.col("__upto") - F.col("__n")
    running = lambda order: F.sum("__n").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = stashed(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), F.lit(1).cast("long").alias("__n")))
    rank = (at * 100 / F.col("__rows")).cast("int")
    grid = F.percentile_approx("__v", F.array(*[F.lit(k / 100) for k in range(101)]), F.lit(1000))
    told = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), grid.alias("__grid")).withColumn("__at", place(F.col("__rows"))).filter("__at < __rows")
    told = stashed(told.select(*keys, "__rows", "__at", F.get("__grid", F.greatest(rank - 1, F.lit(0))).alias("__low"), F.get("__grid", F.least(rank + 2, F.lit(100))).alias("__high")))
    part = (v >= F.col("__low")).cast("int") + (v > F.col("__high")).cast("int")
    first = True
    while first or told.filter(f"__rows > {ORDERED}").limit(1).count():
        if not first:
            cuts = left.groupBy(*keys).agg(F.percentile_approx("__v", F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), F.lit(PARTS * 32)).alias("__cuts"))
            told = stashed(told.join(cuts, keys).withColumn("__cuts", F.when(F.col("__rows") > ORDERED, F.col("__cuts")).otherwise(F.array().cast(cuts.schema["__cuts"].dataType))))
            part = F.size(F.filter("__cuts", lambda cut: cut <= v))
        first = False
        parts = left.join(told, keys).withColumn("__part", part).groupBy(*keys, "__part").agg(F.sum("__n").alias("__n"), F.first("__at").alias("__at"))
        chosen = stashed(parts.withColumn("__upto", running("__part")).filter((F.col("__upto") > at) & (after <= at)).select(*keys, F.col("__part").alias("__own"), (at - after).alias("__at")))
        kept = left.join(told.drop("__at", "__rows"), keys).withColumn("__part", part).join(chosen.select(*keys, "__own"), keys).filter("__part = __own")
        left = stashed(kept.groupBy(*keys, "__v").agg(F.sum("__n").alias("__n")))
        told = stashed(chosen.select(*keys, "__at").join(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")), keys))
    placed = left.withColumn("__upto", running("__v")).join(told.select(*keys, "__at"), keys)
    return placed.filter(F.col("__upto") > at).groupBy(*keys).agg(F.min("__v").alias(name))


def spread_sample(df: DataFrame, key: str, k: int) -> DataFrame:
    """Every floor(n / k)-th row in the order of a key without repeats, at most k.

    The places asked for become key bounds: rows are counted by ranges of the key, which Spark samples once and writes to the shared
    checkpoint folder, so that both readings see the same ranges.
    """
    ranged = checkpointed(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(over), F.lit(0))).withColumn("__step", F.greatest(F.lit(1), F.floor(F.sum("__n").over(Window.partitionBy()) / k))).drop("__n")
    placed = ranged.join(F.broadcast(before), "__part").withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1 + F.col("__before"))
    return placed.filter((F.col("__at") % F.col("__step") == 0) & (F.col("__at") < F.col("__step") * k)).drop("__part", "__before", "__at", "__step")


def runs_of_days(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """keys, first_day, last_day, days: maximal runs of consecutive days."""
    days = df.select(*keys, F.col(day).alias("d")).distinct()
    island = F.date_sub(F.col("d"), F.row_number().over(Window.partitionBy(*keys).orderBy("d")))
    return days.withColumn("i", island).groupBy(*keys, "i").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("i")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """value, n: the k most frequent values, the smaller of equals first; blanks as (blank)."""
    v = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("(blank)"))
    return df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def alphabetic(text: Column) -> Column:
    """A text to sort by as people sort: letters in their order whatever their case or accents, which only decide between texts that are else alike; small letters go first."""
    return F.collate(text, "UNICODE")


def count_by(df: DataFrame, column: str, sort: str = "count", collated: bool = False) -> DataFrame:
    """value, n, place: the counts of a column's values, by name or the most frequent first; collated names are in the order of alphabetic()."""
    name = F.asc(alphabetic(F.col("value"))) if collated else F.asc("value")
    order = [name] if sort == "name" else [F.desc("n"), name]
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def first_seen_index(df: DataFrame, column: str, seq: str) -> DataFrame:
    """value, index: a number from 0 for each distinct value, in the order of their first rows; the window sees a row a value."""
    firsts = df.groupBy(F.col(column).alias("value")).agg(F.min(seq).alias("first"))
    return firsts.select("value", (F.row_number().over(Window.orderBy("first")) - 1).alias("index"))


def voters_order(primary: Column, descending: bool = False) -> list[Column]:
    """The primary key in its direction, then last name and first name in alphabetic() order and id upwards."""
    return [primary.desc() if descending else primary.asc(), alphabetic(F.col("last")).asc(), alphabetic(F.col("first")).asc(), F.asc("id")]


def ballot_order() -> list[Column]:
    """Returned ballots, ballots out, then none; inside these the newest return and the newest issue first."""
    rank = F.when(F.col("ballot") == "returned", 0).when(F.col("ballot") == "out", 1).otherwise(2)
    return [rank.asc(), F.desc(F.coalesce("returned", F.lit(""))), F.desc(F.coalesce("issued", F.lit(""))), F.asc("id")]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of a total order; sizes are clamped to 50..1000."""
    size = min(max(size, 50), 1000)
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def majority(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """key, value, votes: each key's most common value, the first seen of equals."""
    votes = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"), F.min(seq).alias("first_seen"))
    return best_row(votes, [key], [F.col("votes"), -F.col("first_seen")]).drop("first_seen")
