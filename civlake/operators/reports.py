"""Reports over voters (mask, elig and attributes): each is one pass of conditional sums, aggregated before any shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civlake.functions.columns import any_of, count_if, has_bit, ratio
from civlake.operators.elections import Election, eligible, mask_of, n_bits, voted

FAITHFUL = 0.8


def _stacked(row: DataFrame, names: list[tuple], columns: list[str], types: str) -> DataFrame:
    """One wide row as a row for each name."""
    named = lambda n, k: [F.lit(x) for x in (n if isinstance(n, tuple) else (n,))] + [F.col(f"{c}_{k}") for c in columns]
    structs = [F.struct(*[x.alias(t) for x, t in zip(named(n, k), types.split(), strict=True)]) for k, n in enumerate(names)]
    return row.select(F.inline(F.array(*structs)))


def cascade(voters: DataFrame, elections: list[Election]) -> DataFrame:
    """bit, label, hits, eligible, share_of_max, share_of_eligible: a row an election."""
    sums = [x for k, e in enumerate(elections) for x in (count_if(voted(e)).alias(f"h_{k}"), count_if(eligible(e)).alias(f"e_{k}"))]
    out = _stacked(voters.agg(*sums), [(e.bit, e.label) for e in elections], ["h", "e"], "bit label hits eligible")
    most = F.greatest(F.lit(1), F.max("hits").over(Window.partitionBy()))
    return out.withColumn("share_of_max", ratio(F.col("hits"), most)).withColumn("share_of_eligible", ratio(F.col("hits"), F.col("eligible")))


def retention(voters: DataFrame, elections: list[Election]) -> DataFrame:
    """a, b, total, both, share: of those who voted in a, how many voted in b; a row for each pair, zeroes included.

    Voters are counted by mask first; only the distinct masks meet the pairs.
    """
    masks = voters.groupBy("mask").agg(F.count(F.lit(1)).alias("c"))
    bits = F.array(*[F.struct(F.lit(x.bit).alias("a"), F.lit(y.bit).alias("b")) for x in elections for y in elections])
    has = lambda bit: F.expr(f"shiftright(mask, {bit}) & 1 = 1")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0)).cast("long")
    pairs = masks.select("mask", "c", F.inline(bits)).groupBy("a", "b").agg(some(has("a")).alias("total"), some(has("a") & has("b")).alias("both"))
    return pairs.withColumn("share", ratio(F.col("both"), F.col("total")))


def profile(voters: DataFrame, elections: list[Election]) -> DataFrame:
    """One row: voters, who voted in every election open to them, in one, in all on file, sums, and habits by season.

    Habits exclude each other: general and primary, only general, only primary, only special. An election in progress counts everywhere but
    for every_on_file and the habits.
    """
    done = mask_of([e for e in elections if not e.provisional])
    nv, ne = n_bits(F.col("mask")), n_bits(F.col("elig"))
    of = {s: any_of([voted(e) for e in elections if e.season == s and not e.provisional]) for s in ("general", "primary", "special")}
    g, p, s = of["general"], of["primary"], of["special"]
    return voters.agg(
        F.count(F.lit(1)).alias("n"),
        count_if((ne > 0) & (nv == ne)).alias("every_eligible"),
        count_if(nv == 1).alias("exactly_one"),
        count_if(F.col("mask").bitwiseAND(F.lit(done)) == done).alias("every_on_file"),
        F.coalesce(F.sum(nv), F.lit(0)).cast("long").alias("voted"),
        F.coalesce(F.sum(ne), F.lit(0)).cast("long").alias("could"),
        ratio(F.sum(nv), F.sum(ne)).alias("mean_rate"),
        count_if(g & p).alias("both_habits"),
        count_if(g & ~p).alias("general_only"),
        count_if(p & ~g).alias("primary_only"),
        count_if(s & ~g & ~p).alias("special_only"),
    )


def profile_histogram(voters: DataFrame, elections: list[Election]) -> DataFrame:
    """k, n: how many voted in k elections, for k from 0 to all."""
    nv = n_bits(F.col("mask").bitwiseAND(F.lit(mask_of(elections))))
    ks = list(range(len(elections) + 1))
    return _stacked(voters.agg(*[count_if(nv == k).alias(f"n_{k}") for k in ks]), ks, ["n"], "k n")


def geography(voters: DataFrame, key: str, elections: list[Election], least: int = 100) -> DataFrame:
    """key, n, voted, could, rate, faithful, once_only for keys with at least `least` voters, over all elections, one in progress too."""
    every = mask_of(elections)
    nv, ne = n_bits(F.col("mask").bitwiseAND(F.lit(every))), n_bits(F.col("elig").bitwiseAND(F.lit(every)))
    out = voters.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(nv).cast("long").alias("voted"),
        F.sum(ne).cast("long").alias("could"),
        count_if((ne > 0) & (nv >= ne * FAITHFUL)).alias("faithful"),
        count_if(nv == 1).alias("once_only"),
    )
    return out.filter(F.col("n") >= least).withColumn("rate", ratio(F.col("voted"), F.col("could")))


def cohorts(voters: DataFrame, split_from: int = 2020) -> DataFrame:
    """cohort, n, voted: registration years from split_from on, decades before; rows without a date are left out."""
    y = F.year("registered")
    cohort = F.when(y >= split_from, y).otherwise(F.floor(y / 10) * 10).cast("int")
    return voters.filter("registered is not null").groupBy(cohort.alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.sum(n_bits(F.col("mask"))).cast("long").alias("voted"))


def registrations_by_month(voters: DataFrame, since: str = "2022-01") -> DataFrame:
    month = F.date_format("registered", "yyyy-MM")
    return voters.filter("registered is not null").filter(month >= since).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


def unplaced_rate(voters: DataFrame, key: str, placed: str, least: int = 200) -> DataFrame:
    """key, n, unplaced, rate: rows for which `placed` does not hold, for keys with enough rows."""
    out = voters.groupBy(key).agg(F.count(F.lit(1)).alias("n"), count_if(~F.expr(placed)).alias("unplaced"))
    return out.filter(F.col("n") >= least).withColumn("rate", ratio(F.col("unplaced"), F.col("n")))


def early_days(voters: DataFrame, in_person: list[str]) -> DataFrame:
    """day, in_person, mail, total, running: returned ballots a day. The running total's window sees a row a day."""
    person = F.col("category").isin(*in_person)
    days = voters.filter("ballot = 'returned'").groupBy(F.to_date("returned").alias("day")).agg(count_if(person).alias("in_person"), count_if(~person).alias("mail"), F.count(F.lit(1)).alias("total"))
    return days.withColumn("running", F.sum("total").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def early_days_party(voters: DataFrame) -> DataFrame:
    """day, party, n: returned ballots by day and party."""
    return voters.filter("ballot = 'returned'").groupBy(F.to_date("returned").alias("day"), "party").agg(F.count(F.lit(1)).alias("n"))


def early_party(voters: DataFrame, in_person: list[str]) -> DataFrame:
    """party, issued, returned, in_person, mail_issued, mail_returned, mail_rate of those with a ballot."""
    person, back = F.col("category").isin(*in_person), F.col("ballot") == "returned"
    out = voters.filter("ballot is not null").groupBy("party").agg(
        F.count(F.lit(1)).alias("issued"), count_if(back).alias("returned"), count_if(person & back).alias("in_person"), count_if(~person).alias("mail_issued"), count_if(~person & back).alias("mail_returned")
    )
    return out.withColumn("mail_rate", ratio(F.col("mail_returned"), F.col("mail_issued")))


@dataclass(frozen=True)
class Yardsticks:
    """The finished elections that early votes are held against; any may be missing."""

    baseline: Election | None
    previous: Election | None
    primary: Election | None


def yardsticks(elections: list[Election], live: Election) -> Yardsticks:
    """The last two finished generals whose label (a year) has the live one's parity, else the last two generals; and the last primary."""
    done = sorted((e for e in elections if not e.provisional), key=lambda e: e.bit)
    generals, primaries = ([e for e in done if e.season == s] for s in ("general", "primary"))
    alike = [e for e in generals if int(e.label) % 2 == int(live.label) % 2] or generals
    return Yardsticks(alike[-1] if alike else None, alike[-2] if len(alike) > 1 else None, primaries[-1] if primaries else None)


def baseline_of(elections: list[Election], live: Election) -> Election | None:
    return yardsticks(elections, live).baseline


def pace(voters: DataFrame, key: str, baseline: Election, least: int = 100) -> DataFrame:
    """key, early, baseline, pace: returned ballots against the votes in the baseline election."""
    out = voters.groupBy(key).agg(count_if(F.col("ballot") == "returned").alias("early"), count_if(voted(baseline)).alias("baseline"))
    return out.filter(F.col("baseline") >= least).withColumn("pace", ratio(F.col("early"), F.col("baseline")))


def early_profile(voters: DataFrame, elections: list[Election], baseline: Election) -> DataFrame:
    """prior, n, skipped_baseline: early voters by the number of finished elections they voted in."""
    done = mask_of([e for e in elections if not e.provisional])
    prior = n_bits(F.col("mask").bitwiseAND(F.lit(done)))
    return voters.filter("ballot = 'returned'").groupBy(prior.alias("prior")).agg(F.count(F.lit(1)).alias("n"), count_if(~voted(baseline)).alias("skipped_baseline"))


def early_profile_totals(voters: DataFrame, elections: list[Election], live: Election) -> DataFrame:
    """One row of those whose ballot is back: voted, first_vote, both_generals, last_primary, skipped_baseline."""
    y = yardsticks(elections, live)
    first = F.col("mask").bitwiseAND(F.lit(mask_of([e for e in elections if not e.provisional]))) == 0
    has = lambda e: F.lit(False) if e is None else voted(e)
    skipped = F.lit(False) if y.baseline is None else ~first & ~has(y.baseline)
    back = voters.filter("ballot = 'returned'")
    return back.agg(
        F.count(F.lit(1)).alias("voted"), count_if(first).alias("first_vote"), count_if(has(y.baseline) & has(y.previous)).alias("both_generals"), count_if(has(y.primary)).alias("last_primary"), count_if(skipped).alias("skipped_baseline")
    )


def early_block(voters: DataFrame, as_of: str, in_person: list[str]) -> DataFrame:
    """One row: issued, returned, flagged (returned with an issue), undated (returned after as_of), from_file, in_person, mail."""
    back = F.col("ballot") == "returned"
    person = F.col("category").isin(*in_person)
    return voters.filter("ballot is not null").agg(
        F.count(F.lit(1)).alias("issued"),
        count_if(back).alias("returned"),
        count_if(back & (F.coalesce("issue", F.lit("")) != "")).alias("flagged"),
        count_if(back & (F.to_date("returned") > F.lit(as_of).cast("date"))).alias("undated"),
        count_if(F.col("from_file")).alias("from_file"),
        count_if(back & person).alias("in_person"),
        count_if(back & ~person).alias("mail"),
    )


def tallies(voters: DataFrame, matched: DataFrame, key: str = "id") -> DataFrame:
    """party, n, mapped: all voters by party, and those that are matched and have a place on the map."""
    ids = matched.select(key).distinct().withColumn("__m", F.lit(True))
    return voters.join(ids, key, "left").groupBy("party").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("__m").isNotNull() & F.col("placed")).alias("mapped"))


def history_of(voters: DataFrame, elections: list[Election]) -> DataFrame:
    """id, n_open and history, an array of (label, voted, eligible, live) with the newest election first."""
    rows = [F.struct(F.lit(e.label).alias("label"), voted(e).alias("voted"), has_bit(F.col("elig"), e.bit).alias("eligible"), F.lit(e.provisional).alias("live")) for e in reversed(elections)]
    return voters.select("id", n_bits(F.col("elig").bitwiseAND(F.lit(mask_of(elections)))).alias("n_open"), F.array(*rows).alias("history"))


def roll_stats(voters: DataFrame, status: str, party: str) -> DataFrame:
    """status, party, n by status, by party and by both, in one pass; null stands for all."""
    return voters.select(F.col(status).alias("s"), F.col(party).alias("p")).groupingSets([["s"], ["p"], ["s", "p"]], "s", "p").agg(F.count(F.lit(1)).alias("n")).toDF("status", "party", "n")


def undated_returns(voters: DataFrame, as_of: str) -> DataFrame:
    """returned, undated, latest: returns after as_of count as returned but not by day."""
    back = F.col("ballot") == "returned"
    late = F.to_date("returned") > F.lit(as_of).cast("date")
    return voters.agg(count_if(back).alias("returned"), count_if(back & late).alias("undated"), F.date_format(F.max(F.when(back & ~late, F.to_date("returned"))), "yyyy-MM-dd").alias("latest"))


def match_status(lookups: DataFrame, matches: DataFrame, apps: DataFrame, state: str = "39") -> DataFrame:
    """lookup, status and links of each lookup: found, none, not-ohio (no match in the state) or no-app (none in a county with an app).

    matches have lookup and fips, a county's five digits; apps have fips. A lookup may have no match.
    """
    known = matches.join(apps.select("fips", F.lit(True).alias("app")), "fips", "left")
    inside = F.col("fips").startswith(state) & (F.length("fips") == 5)
    counted = known.groupBy("lookup").agg(count_if(inside).alias("inside"), count_if(inside & F.col("app").isNotNull()).alias("links"))
    status = F.when(F.col("inside").isNull(), "none").when(F.col("inside") == 0, "not-ohio").when(F.col("links") == 0, "no-app").otherwise("found")
    return lookups.join(counted, "lookup", "left").select("lookup", status.alias("status"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def drills(elections: list[Election], one: Election, other: Election, times: int, cohort: int, placed: Column, party: str) -> dict[str, Column]:
    """Predicates behind the counts of reports, by name: the same expression counts voters and lists them."""
    every = F.lit(mask_of(elections))
    nv, ne = n_bits(F.col("mask").bitwiseAND(every)), n_bits(F.col("elig").bitwiseAND(every))
    back = F.col("ballot") == "returned"
    return {
        "turnout": voted(one),
        "cell": voted(one) & voted(other),
        f"exactly {times}": nv == times,
        "faithful": (ne > 0) & (nv >= ne * FAITHFUL),
        "cohort": F.year("registered") == cohort,
        "unplaced": ~placed,
        "back": back,
        "party back": back & (F.col("party") == party),
    }


def early_drills(day: str, party: str, month: str, ahead: int, place: str, as_of: str) -> dict[str, Column]:
    """Predicates behind the counts of early votes and registrations: a day's ballots of a party, a month's registrations, ballots back by as many days before a day as a pace is read at, ballots of a place."""
    back, returned = F.col("ballot") == "returned", F.to_date("returned")
    return {
        "day and party": back & (returned == F.lit(day).cast("date")) & (F.col("party") == party),
        "month": F.date_format("registered", "yyyy-MM") == month,
        "pace": back & (F.date_diff(F.lit(as_of).cast("date"), returned) >= ahead),
        "place": back & (F.col("jurisdiction") == place),
    }


def drill_counts(voters: DataFrame, rules: dict[str, Column], names: list[str]) -> DataFrame:
    """drill, n, least, most (ids) for each of the drills, in one scan."""
    sums = [x for k, name in enumerate(names) for x in (count_if(rules[name]).alias(f"n_{k}"), F.min(F.when(rules[name], F.col("id"))).alias(f"l_{k}"), F.max(F.when(rules[name], F.col("id"))).alias(f"m_{k}"))]
    return _stacked(voters.agg(*sums), names, ["n", "l", "m"], "drill n least most")
