"""Parcels: range filters, counts by class and district, profiles of source columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civlake.functions.columns import all_of, count_if, ratio
from civlake.operators.ranking import upper_median


def in_ranges(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """Inclusive bounds; an open end is None."""
    return all_of([c for k, (lo, hi) in ranges.items() for c in ([F.col(k) >= lo] * (lo is not None) + [F.col(k) <= hi] * (hi is not None))])


def class_counts(parcels: DataFrame, land_class: Column) -> DataFrame:
    return parcels.groupBy(land_class.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def district_counts(parcels: DataFrame, district: str, other: str = "Unassigned") -> DataFrame:
    """district, n, place; the unassigned come last."""
    from pyspark.sql import Window

    name = F.coalesce(F.nullif(F.trim(F.col(district)), F.lit("")), F.lit(other))
    out = parcels.groupBy(name.alias("district")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("district") == other, "district")))


def column_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """column, rows, blank, zero, blank_pct, avg_bytes (as JSON) and absent for every column, or those named, in one pass.

    blank_pct and avg_bytes are null without rows. A named column that df lacks is blank everywhere and absent.
    """
    names = names or df.columns
    has = {c: c in df.columns for c in names}
    text = lambda c: F.col(f"`{c}`").cast("string") if has[c] else F.lit(None).cast("string")
    number = {c: dict(df.dtypes).get(c, "string") not in ("string",) for c in names}
    sums = []
    for k, c in enumerate(names):
        blank = F.coalesce(F.trim(text(c)), F.lit("")) == ""
        size = F.length(F.coalesce(text(c), F.lit(""))) + F.when(text(c).isNull() | F.lit(not number[c]), 2).otherwise(0)
        sums += [count_if(blank).alias(f"b{k}"), count_if(text(c).try_cast("double") == 0).alias(f"z{k}"), F.avg(size).alias(f"s{k}")]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *sums)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"b{k}").alias("blank"), F.col(f"z{k}").alias("zero"), F.col(f"s{k}").alias("avg_bytes"), F.lit(not has[c]).alias("absent")) for k, c in enumerate(names)]
    out = row.select("rows", F.explode(F.array(*structs)).alias("s"))
    return out.select("s.column", "rows", "s.blank", "s.zero", F.try_divide(F.col("s.blank") * 100.0, F.col("rows")).alias("blank_pct"), "s.avg_bytes", (F.col("s.absent") & (F.col("rows") > 0)).alias("absent"))


#: What the names of columns of values look like (fixed values).
VALUE_NAMES = "(?i)VAL|MKT|MARKET|APPR|ASSD|ASSESS|TAXABLE|TAX_|LAND|BLDG|BUILDING|IMPR|TOT"


def value_columns(df: DataFrame, pattern: str = VALUE_NAMES, share: float = 0.3) -> DataFrame:
    """column, numbers, rows: columns named like values of which at least a share of the rows are numbers; one scan."""
    import re

    names = [c for c in df.columns if re.search(pattern, c)]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[count_if(F.col(f"`{c}`").cast("string").try_cast("double").isNotNull()).alias(f"n{k}") for k, c in enumerate(names)])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("numbers")) for k, c in enumerate(names)]
    out = counts.select("rows", F.explode(F.array(*structs) if structs else F.array().cast("array<struct<column:string,numbers:bigint>>")).alias("s"))
    return out.select("s.column", "s.numbers", "rows").filter(F.col("numbers") >= F.col("rows") * share)


def distinct_values(df: DataFrame, column: str, top: int = 30, least: int = 2, most: int = 50) -> DataFrame:
    """value, n, distinct: the most frequent values of a column that has from `least` to `most` different ones; no rows otherwise. Blanks are one value."""
    v = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("(blank)"))
    counts = df.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # of too many values no more than one over the limit are looked at
    n = counts.limit(most + 1).agg(F.count(F.lit(1)).alias("distinct"))
    return counts.crossJoin(F.broadcast(n)).filter(F.col("distinct").between(least, most)).orderBy(F.desc("n"), "value").limit(top)


def pin_coverage(points: DataFrame) -> DataFrame:
    """One row: rows, pinned (with both coordinates, neither zero), pct; pct is null without rows."""
    pinned = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("lat") != 0) & (F.col("lon") != 0)
    return points.agg(F.count(F.lit(1)).alias("rows"), count_if(pinned).alias("pinned")).withColumn("pct", F.try_divide(F.col("pinned") * 100.0, F.col("rows")))


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: parsed, unparsed, first, last, and placeholders: on or before 1900-01-01, in 1900-1910, the epoch. The column holds days, or texts of which some may be none."""
    d = F.col(column).try_cast("date")
    return df.agg(
        count_if(d.isNotNull()).alias("parsed"),
        count_if(d.isNull()).alias("unparsed"),
        F.date_format(F.min(d), "yyyy-MM-dd").alias("first"),
        F.date_format(F.max(d), "yyyy-MM-dd").alias("last"),
        count_if(d <= F.lit("1900-01-01").cast("date")).alias("floor"),
        count_if((d > F.lit("1900-01-01").cast("date")) & (d < F.lit("1911-01-01").cast("date"))).alias("decade"),
        count_if(d == F.lit("1970-01-01").cast("date")).alias("epoch"),
    )


def placeholder_values(df: DataFrame, column: str, sentinels: list[str]) -> DataFrame:
    """value, n, pct of the rows that hold one of the sentinels."""
    counts = df.groupBy(F.upper(F.trim(F.col(column))).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.filter(F.col("value").isin(*sentinels)).crossJoin(F.broadcast(total)).select("value", "n", ratio(F.col("n") * 100, F.col("total")).alias("pct"))


def ratio_medians(df: DataFrame, columns: list[str], low: float = 0.05, high: float = 1.001) -> DataFrame:
    """a, b, upper_median, kind: the upper median of b / a, over rows with a above 0, for each ordered pair, if it lies within the limits (one way then).

    kind says what a share of that size is: 'same', 'assessed' (about 0.35) or 'other'.
    """
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(a) > 0, F.round(F.try_divide(F.col(b), F.col(a)), 6)).alias("r")) for a in columns for b in columns if a != b]
    long = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("r is not null")
    median = upper_median(long, ["a", "b"], "r").filter((F.col("upper_median") >= low) & (F.col("upper_median") < high))
    m = F.col("upper_median")
    return median.withColumn("kind", F.when(m.between(0.995, 1.001), "same").when(m.between(0.34, 0.36), "assessed").otherwise("other"))


def outside_box(points: DataFrame, box: tuple[float, float, float, float], tolerance: float = 0.0) -> DataFrame:
    """n, outside, worst: points farther than the tolerance out of (west, south, east, north), and the farthest."""
    w, s, e, n = box
    over = F.greatest(F.lit(w) - F.col("lon"), F.col("lon") - e, F.lit(s) - F.col("lat"), F.col("lat") - n, F.lit(0.0))
    return points.agg(F.count(F.lit(1)).alias("n"), count_if(over > tolerance).alias("outside"), F.coalesce(F.max(over), F.lit(0.0)).alias("worst"))
