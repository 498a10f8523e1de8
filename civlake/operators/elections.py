"""Elections as bits of a mask: who voted, who could have."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civlake.functions.columns import count_if, has_bit, ratio


@dataclass(frozen=True)
class Election:
    """bit N of a mask stands for elections[N]; scope, if any, lists the precincts that could vote."""

    bit: int
    label: str
    season: str
    provisional: bool = False
    scope: tuple[int, ...] | None = None


def mask_of(elections: list[Election]) -> int:
    return sum(1 << e.bit for e in elections)


def eligibility(precinct: Column, mask: Column, elections: list[Election]) -> Column:
    """The elections open to a precinct, and any the voter voted in; a provisional one only if voted in."""
    open_to = F.lit(0)
    for e in elections:
        if not e.provisional:
            bit = F.lit(1 << e.bit)
            open_to = open_to.bitwiseOR(bit if e.scope is None else F.when(precinct.isin(*e.scope), bit).otherwise(0))
    return open_to.bitwiseOR(mask)


def keep_test(votes: DataFrame, precinct_sizes: DataFrame, turnout: float = 0.05, share: float = 0.5) -> DataFrame:
    """election, ballots, in_turnout, keep: an election stays if most of its ballots are from precincts with a real turnout.

    votes: election, precinct, one row a ballot; precinct_sizes: precinct, n. Both are aggregated before they meet.
    """
    per = votes.groupBy("election", "precinct").agg(F.count(F.lit(1)).alias("b")).join(precinct_sizes, "precinct")
    real = F.col("b") >= F.col("n") * turnout
    out = per.groupBy("election").agg(F.sum("b").alias("ballots"), F.coalesce(F.sum(F.when(real, F.col("b"))), F.lit(0)).alias("in_turnout"))
    return out.withColumn("keep", (F.col("ballots") > 0) & (F.col("in_turnout") >= F.col("ballots") * share))


def turnout_by_precinct(votes: DataFrame, precinct_sizes: DataFrame) -> DataFrame:
    per = votes.groupBy("election", "precinct").agg(F.count(F.lit(1)).alias("b"))
    return per.join(precinct_sizes, "precinct").select("election", "precinct", ratio(F.col("b"), F.col("n")).alias("turnout"))


def scope_floor(turnout: DataFrame, n_precincts: int, floor: float = 0.2, county_wide: float = 0.8) -> DataFrame:
    """election, median, in_scope, county_wide: precincts with at least a fifth of the upper median turnout are in scope."""
    from civlake.operators.ranking import upper_median

    median = upper_median(turnout, ["election"], "turnout")
    met = turnout.join(median, "election").groupBy("election", "upper_median").agg(count_if(F.col("turnout") >= F.col("upper_median") * floor).alias("in_scope"))
    return met.select("election", "upper_median", "in_scope", (F.col("in_scope") >= F.lit(n_precincts * county_wide)).alias("county_wide"))


def voted(e: Election) -> Column:
    return has_bit(F.col("mask"), e.bit)


def eligible(e: Election) -> Column:
    """All rows count for a provisional election, of which nobody knows yet who could vote."""
    return F.lit(True) if e.provisional else has_bit(F.col("elig"), e.bit)


def n_bits(mask: Column) -> Column:
    return F.bit_count(mask).cast("int")


def qualifiers(scopes: DataFrame, places: DataFrame) -> DataFrame:
    """election and qualifier: the one jurisdiction that all precincts of an election's scope share, else the empty text.

    scopes: election, precinct; places: precinct, jurisdiction. A precinct without a place shares none.
    """
    met = scopes.join(places, "precinct", "left")
    same = (F.count(F.lit(1)) == F.count("jurisdiction")) & (F.min("jurisdiction") == F.max("jurisdiction"))
    return met.groupBy("election").agg(F.coalesce(F.when(same, F.min("jurisdiction")), F.lit("")).alias("qualifier"))


def labels(elections: DataFrame) -> DataFrame:
    """elections (id, day date, season, qualifier) with label and slug.

    A November general and a year's only primary go without a month; elections whose labels would be alike show the day, and its date
    in the slug. The windows see a row an election.
    """
    month, year = F.date_format("day", "MMMM"), F.year("day").cast("string")
    primaries = F.count(F.when(F.col("season") == "primary", 1)).over(Window.partitionBy(F.year("day")))
    regular = ((F.col("season") == "general") & (F.month("day") == 11)) | ((F.col("season") == "primary") & (primaries == 1))
    word = F.nullif("qualifier", F.lit(""))
    label = F.concat_ws(" ", F.when(~regular, month), F.lit("{year}"), word, F.initcap("season"))
    slug = F.concat_ws("-", F.lit("{month}"), "season", F.lower(F.regexp_replace(word, r"\s+", "-")))
    named = elections.withColumn("label", label).withColumn("slug", slug)
    alike = F.count(F.lit(1)).over(Window.partitionBy(F.replace("label", F.lit("{year}"), year))) > 1
    named = named.withColumn("__alike", alike)
    shown = F.when(F.col("__alike"), F.concat_ws(" ", F.dayofmonth("day").cast("string"), year)).otherwise(year)
    stamp = F.when(F.col("__alike"), F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "yyyy-MM"))
    return named.withColumn("label", F.replace("label", F.lit("{year}"), shown)).withColumn("slug", F.replace("slug", F.lit("{month}"), stamp)).drop("__alike")


_MONTHS = {m: k + 1 for k, m in enumerate("january february march april may june july august september october november december".split())}
_SEASON_MONTH = {"primary": 5, "general": 11, "special": 8}


def described_file(name: str) -> dict | None:
    """Year, season, month, qualifier, label and id that a ballot file's name tells, in any order; None without a year or a season."""
    year = season = month = None
    rest = []
    for word in filter(None, re.split(r"[\s_\-]+", re.sub(r"(?i)\.csv$", "", name))):
        low = word.lower()
        if year is None and re.fullmatch(r"(19|20)\d\d", low):
            year = int(low)
        elif season is None and low in _SEASON_MONTH:
            season = low
        elif month is None and low in _MONTHS:
            month = _MONTHS[low]
        elif low not in ("absentee", "voted") and not low.endswith("county"):
            rest.append(word.capitalize())
    if year is None or season is None:
        return None
    qualifier, at = " ".join(rest), month or _SEASON_MONTH[season]
    label = " ".join(filter(None, [next((m.capitalize() for m, k in _MONTHS.items() if k == month), ""), str(year), qualifier, season.capitalize()]))
    return {"id": "-".join(filter(None, [str(year), f"{at:02d}", season, qualifier.lower().replace(" ", "-")])), "label": label, "year": year, "season": season, "month": month, "qualifier": qualifier}
