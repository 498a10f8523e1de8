"""From landed rows to one row a voter: reissues, merges, conflicts, precincts, persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civlake.functions.columns import count_if
from civlake.operators.ranking import best_row

#: Ways a ballot comes back that do not count as returned.
NOT_BACK = ("NOT RECEIVED", "UNDELIVERABLE", "REFUSED", "")
SYNTHETIC_FROM = 9_000_000


def collapse_reissues(ballots: DataFrame, keys: list[str], issued: str = "issued", returned: str = "returned", seq: str = "seq") -> DataFrame:
    """The latest issue of each key (the later row of equals), with a return date from either row."""
    back = ballots.groupBy(*keys).agg(F.max(returned).alias("__back"))
    latest = best_row(ballots, keys, [F.col(issued), F.col(seq)])
    return latest.join(back, keys).withColumn(returned, F.coalesce(returned, "__back")).drop("__back")


def is_returned(date: Column, method: Column, status: Column) -> Column:
    """There is a date, a way back that counts, and the voter did not refuse."""
    return date.isNotNull() & ~F.upper(F.coalesce(method, F.lit(""))).isin(*NOT_BACK) & (F.coalesce(status, F.lit("")) != "REFUSED TO VOTE")


def upsert(roll: DataFrame, ballots: DataFrame, key: str, column: str, live_bit: int | None = None) -> DataFrame:
    """roll with the ballot column renewed, and rows for ballots whose voter is not on it; matched and added say which.

    What an earlier run put in is taken out first, so that a second run gives the same rows: the column, rows that only a ballot brought (added), and,
    if live_bit names the election in progress, that bit of mask. With live_bit, the bit is set for ballots whose column is not null.
    """
    bare = roll
    if "added" in roll.columns:
        bare = bare.filter(~F.coalesce(F.col("added"), F.lit(False)))
    if live_bit is not None:
        bare = bare.withColumn("mask", F.col("mask").bitwiseAND(F.lit(~(1 << live_bit))))
    bare = bare.drop(column, "matched", "added").withColumn("__on", F.lit(True))
    both = bare.join(ballots.select(key, column).withColumn("__has", F.lit(True)), key, "full_outer")
    has, on = F.col("__has").isNotNull(), F.col("__on").isNotNull()
    out = both.withColumn("matched", on & has).withColumn("added", ~on)
    if live_bit is not None:
        out = out.withColumn("mask", F.coalesce("mask", F.lit(0)).bitwiseOR(F.when(has & F.col(column).isNotNull(), F.lit(1 << live_bit)).otherwise(0)))
    return out.drop("__on", "__has")


def merge_exports(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """key, the newest value of each field, how often each changed from one export to the next, and mask, any bit of any export, if rows have one."""
    w = Window.partitionBy(key).orderBy(order)
    changes = rows
    for f in fields:
        before = F.lag(f).over(w)
        changes = changes.withColumn(f"__{f}", (before.isNotNull() & ~before.eqNullSafe(F.col(f))).cast("int"))
    newest = [F.max_by(f, order).alias(f) for f in fields]
    masks = [F.bit_or("mask").alias("mask")] * ("mask" in rows.columns)
    return changes.groupBy(key).agg(*newest, *masks, *[F.sum(f"__{f}").cast("long").alias(f"{f}_changes") for f in fields])


def resolve_precinct(rows: DataFrame, prior: DataFrame, neighbours: DataFrame) -> DataFrame:
    """rows (id, street, candidates) with precinct and reason: the only candidate, the one held before, the only one of the street's neighbours, else the bare first one."""
    street = neighbours.groupBy("street").agg(F.collect_set("precinct").alias("near"))
    met = rows.join(prior.select("id", F.col("precinct").alias("held")), "id", "left").join(street, "street", "left")
    both = F.array_intersect("candidates", F.coalesce("near", F.array().cast("array<string>")))
    single = F.when(F.size("candidates") == 1, F.col("candidates")[0])
    before = F.when(F.array_contains("candidates", F.col("held")), F.col("held"))
    near = F.when(F.size(both) == 1, both[0])
    reason = F.when(single.isNotNull(), "single").when(before.isNotNull(), "prior").when(near.isNotNull(), "street").otherwise("bare")
    return met.select("id", F.coalesce(single, before, near, F.array_min("candidates")).alias("precinct"), reason.alias("reason"))


def match_persons(ballots: DataFrame, roll: DataFrame, kept: tuple[str, ...] = (), told: tuple[str, ...] = ()) -> DataFrame:
    """ballots (seq, last, first, house and, if known, zip) with voter_id and how, the columns `kept` of the ballot and `told` of the voter on the roll, null without one.

    A name and house that one voter has, else a name that one voter has, of several the one in the ballot's ZIP, else a new number. The roll has id, last, first, house
    and, if ballots have a ZIP, zip. Voters are counted by key before they are joined.
    """

    def unique(keys: list[str], name: str) -> DataFrame:
        voter = [F.min("id").alias(name), *[F.min(c).alias(f"{name}_{c}") for c in told]]
        return roll.groupBy(*keys).agg(*voter, F.count(F.lit(1)).alias("__n")).filter("__n = 1").drop("__n")

    met = ballots.join(unique(["last", "first", "house"], "a"), ["last", "first", "house"], "left").join(unique(["last", "first"], "b"), ["last", "first"], "left")
    found = ["a", "b"]
    if "zip" in ballots.columns:
        met = met.join(unique(["last", "first", "zip"], "c"), ["last", "first", "zip"], "left")
        found.append("c")
    how = F.when(F.col("a").isNotNull(), "house").when(F.coalesce(*found).isNotNull(), "name").otherwise("new")
    own = [F.coalesce(*[F.when(F.col(x).isNotNull(), F.struct(F.col(f"{x}_{c}").alias("v"))) for x in found])["v"].alias(c) for c in told]
    return met.select("seq", F.coalesce(*found, F.col("seq") + SYNTHETIC_FROM).alias("voter_id"), how.alias("how"), *kept, *own)


def ballot_summary(voters: DataFrame) -> DataFrame:
    """category, issued, returned, matched, added."""
    return voters.groupBy("category").agg(F.count(F.lit(1)).alias("issued"), count_if(F.col("ballot") == "returned").alias("returned"), count_if(F.col("matched")).alias("matched"), count_if(F.col("added")).alias("added"))


def alias_match(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, known: the same name, else the only known one with as many words, the same tail and a first word that shares three letters.

    An equi-join on tail and first letters, never all pairs.
    """

    def keyed(df: DataFrame, out: str) -> DataFrame:
        words = F.split(F.upper(F.col("name")), " ")
        return df.select(F.col("name").alias(out), F.array_join(F.slice(words, 2, 99), " ").alias("tail"), F.substring(words[0], 1, 3).alias("head"))

    loose = keyed(names, "name").join(keyed(known, "known"), ["tail", "head"]).groupBy("name").agg(F.min("known").alias("loose"), F.count(F.lit(1)).alias("n"))
    exact = known.select(F.upper("name").alias("u"), F.col("name").alias("exact"))
    met = names.join(exact, F.upper(names.name) == exact.u, "left").join(loose, "name", "left")
    return met.select("name", F.coalesce("exact", F.when(F.col("n") == 1, F.col("loose"))).alias("known"))


def canonical_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """name, known: the same name whatever its case, else the only known one with as many words, the same words behind the first and a first word that begins with the name's, else the name itself.

    Names are few and distinct on both sides or made so; a known name's first word is cut to every length, so that beginnings meet in an equi-join.
    """
    words = lambda c: F.split(F.lower(F.trim(c)), r"\s+")
    tail = lambda c: F.array_join(F.slice(words(c), 2, 1000), " ")
    asked = names.select("name").filter("name != ''").distinct().withColumn("__l", F.lower("name")).withColumn("head", words(F.col("name"))[0]).withColumn("tail", tail(F.col("name")))
    told = known.select(F.col("name").alias("known")).distinct()
    same = told.groupBy(F.lower("known").alias("__l")).agg(F.min("known").alias("exact"))
    first = words(F.col("known"))[0]
    cuts = F.transform(F.sequence(F.lit(1), F.length(first)), lambda k: F.left(first, k))
    begins = told.filter("known != ''").select("known", tail(F.col("known")).alias("tail"), F.explode(cuts).alias("head"))
    only = begins.groupBy("head", "tail").agg(F.min("known").alias("begun"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    met = asked.join(same, "__l", "left").join(only, ["head", "tail"], "left")
    return met.select("name", F.coalesce("exact", "begun", "name").alias("known"))
