"""Rolls as one JSON document of dictionaries and tuples, and back; summary documents; what a ballot file is and whether it is newer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civlake.functions.columns import count_if
from civlake.operators.elections import Election
from civlake.operators.reports import baseline_of
from civlake.scratch import stashed

ROLL_DOCUMENT = (
    "county string, elections array<struct<label:string,countyWide:boolean,scope:array<string>,provisional:boolean>>, precincts array<string>, cities array<string>, zips array<string>, parties array<string>, jurisdictions array<string>, "
    "ballotCategories array<string>, statuses array<string>, voters array<array<string>>"
)
NO_PLACE = "Unassigned"


def read_roll_document(spark: SparkSession, path: str) -> DataFrame:
    """One row of the document; cells of mixed types are read as text."""
    return spark.read.schema(ROLL_DOCUMENT).option("multiLine", True).json(path)


def read_roll_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A document with a voter a line, as publish_roll() writes it, read in pieces: one row of the document without its voters, and a row (v) a voter.

    The other lines, as many as the dictionaries have entries, are the document of nobody; a piece's first byte and a line's number in it order them.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    tuples = F.col("value").rlike(r"^,?\[")
    rest = lines.filter(~tuples).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"]), "").alias("text"))
    doc = stashed(rest.select(F.from_json("text", ROLL_DOCUMENT).alias("d")).select("d.*"), "document")
    return doc, lines.filter(tuples).select(F.from_json(F.ltrim("value", F.lit(",")), "array<string>").alias("v"))


def expanded_roll(doc: DataFrame, voters: DataFrame | None = None) -> DataFrame:
    """A row a voter of a roll document: dictionary numbers as values, "CITY, ST" parted, mask and elig, ballot and its status, a search text.

    The voters are a table of tuples (v), or else the document's own list, which is one row and so one task's work. Dictionaries become small tables of position and value that voters join, so that no row carries them. Elections not county-wide are open to the precincts of their
    scope; one in progress only to who voted in it; who voted was eligible. A ballot is a list of category, issued, returned, from file, issue.
    """
    v = doc.select(F.explode("voters").alias("v")) if voters is None else voters
    number = lambda k: F.try_element_at("v", F.lit(k + 1)).try_cast("int")
    text = lambda k: F.coalesce(F.try_element_at("v", F.lit(k + 1)), F.lit(""))
    ballot = F.from_json(F.try_element_at("v", F.lit(15)), "array<string>")
    rows = v.select(
        F.try_element_at("v", F.lit(1)).try_cast("long").alias("id"), number(1).alias("k_precincts"), text(2).alias("last"), text(3).alias("first"), text(4).alias("street"), number(5).alias("k_cities"), number(6).alias("k_zips"), text(7).alias("registered"), number(8).alias("k_parties"),
        F.coalesce(number(9), F.lit(0)).alias("mask"), F.try_element_at("v", F.lit(11)).try_cast("double").alias("lat"), F.try_element_at("v", F.lit(12)).try_cast("double").alias("lon"), number(13).alias("k_jurisdictions"),
        F.when(F.size(ballot) >= 3, ballot).alias("b"), F.when(F.size(ballot) >= 3, ballot[0].try_cast("int")).alias("k_ballotCategories"), number(15).alias("k_statuses"),
    )
    for name in ("precincts", "cities", "zips", "parties", "jurisdictions", "ballotCategories", "statuses"):
        words = doc.select(F.posexplode(F.coalesce(F.col(name), F.array().cast("array<string>"))).alias(f"k_{name}", name))
        rows = rows.join(words, f"k_{name}", "left")
    bits = doc.select(F.posexplode("elections").alias("bit", "e")).filter("not coalesce(e.provisional, false)").select(F.expr("shiftleft(1, bit)").alias("bit"), F.coalesce("e.countyWide", F.lit(True)).alias("wide"), "e.scope")
    wide = bits.filter("wide").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).alias("wide"))
    scoped = bits.filter("not wide").select("bit", F.explode("scope").alias("precincts")).groupBy("precincts").agg(F.bit_or("bit").alias("scoped"))
    rows = rows.join(scoped, "precincts", "left").crossJoin(F.broadcast(wide))
    city = F.coalesce("cities", F.lit(""))
    place = F.regexp_extract(city, r"^(.*), ([A-Z]{2})$", 1)
    out = rows.select(
        "id", F.coalesce("precincts", F.lit("")).alias("precinct"), "last", "first", "street", F.when(place == "", city).otherwise(place).alias("city"), F.coalesce(F.nullif(F.regexp_extract(city, r"^(.*), ([A-Z]{2})$", 2), F.lit("")), F.lit("OH")).alias("state"),
        F.coalesce("zips", F.lit("")).alias("zip"), "registered", F.coalesce("parties", F.lit("--")).alias("party"), F.coalesce("jurisdictions", F.lit(NO_PLACE)).alias("jurisdiction"), "mask",
        F.col("mask").bitwiseOR(F.col("wide")).bitwiseOR(F.coalesce("scoped", F.lit(0))).alias("elig"), "lat", "lon", F.coalesce("statuses", F.lit("")).alias("status"),
        F.when(F.col("b").isNotNull(), F.struct(F.coalesce("ballotCategories", F.lit("?")).alias("category"), F.col("b")[1].alias("issued"), F.col("b")[2].alias("returned"), (F.coalesce(F.try_element_at("b", F.lit(4)), F.lit("0")) == "1").alias("from_file"), F.coalesce(F.try_element_at("b", F.lit(5)), F.lit("")).alias("issue"))).alias("ballot"),
    )
    status = F.when(F.col("ballot").isNull(), "none").when(F.col("ballot.returned") != "", "returned").otherwise("out")
    search = F.lower(F.concat_ws(" ", "last", "first", F.col("id").cast("string"), "street", "city", "zip", "precinct", "jurisdiction"))
    return out.withColumn("ballot_status", status).withColumn("search", search)


def placed_tuples(voters: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """roll_tuples() in no order, with the place of each row in it (a number that grows, with gaps).

    Voters are computed and sorted once and written; dictionaries are found in one pass over them, and are written too, so that Spark knows how small they are when voters join them.
    """
    base = stashed(voters.orderBy("last", "first", "id").withColumn("place", F.monotonically_increasing_id()), "voters")
    names = ("precinct", "city", "zip", "party", "jurisdiction", "status", "category")
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names]))
    firsts = base.select("place", kinds.alias("w")).select("place", "w.*").filter("value is not null").groupBy("name", "value").agg(F.min("place").alias("first"))
    words = stashed(firsts.select("name", "value", (F.row_number().over(Window.partitionBy("name").orderBy("first")) - 1).alias("index")), "dictionaries")
    placed, dictionaries = base, {}
    for name in names:
        dictionaries[name] = words.filter(F.col("name") == name).select("value", "index")
        placed = placed.join(dictionaries[name].select(F.col("value").alias(name), F.col("index").alias(f"k_{name}")), name, "left")
    text = lambda c: F.regexp_replace(F.to_json(F.array(F.coalesce(F.col(c), F.lit("")))), r"^\[|\]$", "")
    plain = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    ballot = F.when(F.col("category").isNull(), "0").otherwise(F.concat(F.lit("["), F.concat_ws(",", plain("k_category", "0"), text("issued"), text("returned"), F.lit("0")), F.lit("]")))
    cells = [plain("id", "null"), plain("k_precinct", "-1"), text("last"), text("first"), text("street"), plain("k_city", "-1"), plain("k_zip", "-1"), text("registered"), plain("k_party", "-1"), plain("mask", "0"), plain("lat", "null"), plain("lon", "null"), F.lit("0"), plain("k_jurisdiction", "-1"), ballot, plain("k_status", "-1")]
    return placed.select("place", "last", "first", "id", F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]")).alias("line")), dictionaries


def roll_tuples(voters: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(last, first, id, line) of voters (id, precinct, last, first, street, city, zip, registered, party, mask, lat, lon, jurisdiction, status, category, issued, returned), each a JSON tuple, sorted by name and id over all partitions; and each dictionary as (value, index), in the order of first appearance."""
    tuples, dictionaries = placed_tuples(voters)
    return tuples.orderBy("place").drop("place"), dictionaries


def roll_file(name: Column) -> Column:
    """county and date of a roll file's name, SOS_<COUNTY>_<date>.txt or .csv; null for other names."""
    pattern = r"(?i)^SOS_([A-Z][A-Z _-]*?)_(\d{4}-\d{2}-\d{2})\.(txt|csv)$"
    county = F.array_join(F.transform(F.filter(F.split(F.lower(F.regexp_extract(name, pattern, 1)), "[ _-]+"), lambda w: w != ""), F.initcap), " ")
    return F.when(name.rlike(pattern), F.struct(county.alias("county"), F.regexp_extract(name, pattern, 2).alias("date")))


def latest_roll_file(spark: SparkSession, folder: str) -> str | None:
    """The path of the roll file in a folder with the latest date in its name; the listing reads no file."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    best = files.withColumn("f", roll_file(F.col("name"))).filter("f is not null").agg(F.max_by("path", F.struct("f.date", "name")).alias("path")).first()
    return best["path"]


def separator_of(first_line: str) -> str:
    """A comma or a tab, whichever the header has more of."""
    return "\t" if first_line.count("\t") > first_line.count(",") else ","


def without_blank_rows(df: DataFrame) -> DataFrame:
    """Rows with something in any column."""
    return df.filter(F.trim(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in df.columns])) != "")


def latest_date(ballots: DataFrame, as_of: str) -> DataFrame:
    """One row: the latest issue or return (yyyy-mm-dd texts) not after as_of, empty without any; later dates are typing errors."""
    day = F.explode(F.array("issued", "returned"))
    return ballots.select(day.alias("d")).filter((F.col("d") != "") & (F.col("d") <= as_of)).agg(F.coalesce(F.max("d"), F.lit("")).alias("latest"))


def file_info(spark: SparkSession, path: str, rows: int, ballots: DataFrame, as_of: str) -> dict:
    """rows, voters, returned, latest and sha256 of a ballot file and what was read from it."""
    sums = ballots.agg(F.count_distinct("id").alias("voters"), count_if(F.col("returned") != "").alias("returned")).first()
    sha = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]
    return {"rows": rows, "voters": sums["voters"], "returned": sums["returned"], "latest": latest_date(ballots, as_of).first()["latest"], "sha256": sha}


def replacement(old: dict | None, new: dict) -> str:
    """Whether a new file takes an old one's place: "replace", "same" (equal bytes) or "older" (it ends earlier)."""
    if old is None:
        return "replace"
    return "same" if old["sha256"] == new["sha256"] else "older" if new["latest"] < old["latest"] else "replace"


def stats_document(voters: DataFrame, elections: list[Election], live: Election, as_of: str, in_person: list[str]) -> DataFrame:
    """One row with the column `doc`, JSON of the roll by status and party, elections, baseline and early votes by category and day. Returns after as_of are in the totals, on no day.

    Each part is one aggregate over the voters; maps and lists are as long as there are parties, categories or days.
    """

    def counts(df: DataFrame, key: str) -> DataFrame:
        by = df.groupBy(F.coalesce(key, F.lit("none")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("m"))

    issued = voters.filter("ballot is not null")
    back = issued.filter("ballot = 'returned'")
    dated = back.filter(F.to_date("returned") <= F.lit(as_of).cast("date"))
    days = dated.groupBy(F.date_format("returned", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("returned"), count_if(F.col("category").isin(*in_person)).alias("in_person"))
    person = F.col("category").isin(*in_person)
    totals = issued.agg(F.count(F.lit(1)).alias("issued"), count_if(F.col("ballot") == "returned").alias("returned"), count_if((F.col("ballot") == "returned") & person).alias("in_person"), count_if((F.col("ballot") == "returned") & (F.to_date("returned") > F.lit(as_of).cast("date"))).alias("undated"))
    base = baseline_of(elections, live)
    parts = {
        "on_file": voters.agg(F.count(F.lit(1)).alias("m")), "by_party": counts(voters, "party"), "by_ballot": counts(voters, "ballot"), "by_category": counts(issued, "category"), "returned_by_category": counts(back, "category"),
        "by_day": days.agg(F.sort_array(F.collect_list(F.struct("date", "returned", "in_person"))).alias("m")), "early": totals.select(F.struct("*").alias("m")),
    }
    row = None
    for name, part in parts.items():
        part = part.withColumnRenamed("m", name)
        row = part if row is None else row.crossJoin(F.broadcast(part))
    labels = F.array(*[F.struct(F.lit(e.label).alias("label"), F.lit(e.season).alias("season"), F.lit(e.provisional).alias("provisional")) for e in elections])
    return row.select(F.to_json(F.struct(*parts, labels.alias("elections"), F.lit(base.label if base else None).alias("baseline"))).alias("doc"))


def app_table(rows: DataFrame) -> DataFrame:
    """fips, county, url sorted by fips; an error for a fips that is not of the state, a missing county, an address that is not https with a slash at the end, or two rows of one fips."""
    bad = F.when(~F.coalesce(F.col("fips"), F.lit("")).rlike(r"^39\d{3}$"), "bad fips").when(F.coalesce("county", F.lit("")) == "", "no county").when(~F.coalesce(F.col("url"), F.lit("")).rlike(r"^https://.+/$"), "bad url")
    twice = rows.groupBy("fips").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").first()
    wrong = rows.withColumn("why", bad).filter("why is not null").first()
    if wrong or twice:
        raise ValueError(f"{wrong['why']}: {wrong['fips']}" if wrong else f"two rows for {twice['fips']}")
    return rows.select("fips", "county", "url").orderBy("fips")


def coverage_lines(profile: DataFrame) -> DataFrame:
    """line: the columns of a profile (column, blank, zero, blank_pct, absent) as text for a report."""
    pct = F.when(F.col("blank_pct").isNull(), "  n/a").otherwise(F.concat(F.lpad(F.format_string("%.1f", F.col("blank_pct")), 5, " "), F.lit("%")))
    return profile.select(F.concat(F.rpad("column", 26, " "), F.lit(" blank "), F.lpad(F.col("blank").cast("string"), 7, " "), F.lit(" ("), pct, F.lit(") zero "), F.lpad(F.col("zero").cast("string"), 7, " "), F.when(F.col("absent"), " ! absent from every row").otherwise("")).alias("line"))


def form_fields(html: Column) -> Column:
    """name and value of a page's inputs and of the chosen options of its selects."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf'(?i)\b{name}\s*=\s*["\']([^"\']*)["\']', 1)
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    inputs = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)(<input\b[^>]*>)"), F.lit(1)), lambda t: pair(attribute(t, "name"), attribute(t, "value")))
    selects = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)(<select\b.*?</select>)"), F.lit(1)), lambda t: pair(attribute(t, "name"), attribute(F.regexp_extract(t, r"(?i)(<option\b[^>]*\bselected\b[^>]*>)", 1), "value")))
    return F.filter(F.concat(inputs, selects), lambda f: f["name"] != "")


def csv_lines(df: DataFrame) -> tuple[str, DataFrame]:
    """A header and lines (line) of a table in which every cell is quoted."""
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return ",".join(f'"{c}"' for c in df.columns), df.select(F.concat_ws(",", *map(cell, df.columns)).alias("line"))


def write_quoted(df: DataFrame, path: str) -> None:
    """Text files that make one quoted CSV in the order of their names: a mark of byte order and the header first, lines end in CR LF."""
    header, lines = csv_lines(df)
    first = df.sparkSession.createDataFrame([("﻿" + header,)], "line string").coalesce(1)
    first.unionByName(lines).write.option("lineSep", "\r\n").text(path)


def parcel_export(parcels: DataFrame, owner: bool = False, valuation: bool = True) -> DataFrame:
    """Parcels (n, o, f, j, z, class, u, a, lm, bm, tm, ta, s, d, y, x) under the export's headings; owner and values only if asked for, coordinates only together."""
    has = F.col("y").isNotNull() & F.col("x").isNotNull()
    columns = {"ParcelNumber": "n", **({"Owner": "o"} if owner else {}), "Address": "f", "Jurisdiction": "j", "State": None, "Zip": "z", "Class": "class", "LandUseCode": "u", "Acres": "a"}
    columns |= {"LandMarket": "lm", "BuildingMarket": "bm", "TotalMarket": "tm", "TotalAssessed": "ta"} if valuation else {}
    columns |= {"SaleDate": "s", "Description": "d"}
    out = [(F.lit("OH") if c is None else F.col(c)).alias(k) for k, c in columns.items()]
    return parcels.select(*out, F.when(has, F.col("y")).alias("Latitude"), F.when(has, F.col("x")).alias("Longitude"))


def voter_export(voters: DataFrame, labels: list[str], ballots: bool = False) -> DataFrame:
    """Voters under the export's headings: a Y or N for each election, their number, and with `ballots` the early vote."""
    from civlake.sources.files import election_flags

    head = {"Voter ID": "id", "Last Name": "last", "First Name": "first", "Precinct": "precinct", "Street": "street", "City": "city", "State": "state", "ZIP": "zip", "Jurisdiction": "jurisdiction", "Registered": "registered", "Party": "party"}
    flags = [c.alias("Elections Voted") if k == len(labels) else c for k, c in enumerate(election_flags(voters, labels))]
    early = [F.when(F.col("ballot_status") == "returned", "Voted early").when(F.col("ballot_status") == "out", "Ballot out").otherwise("").alias("Early Voting")]
    early += [F.coalesce(F.col(f"ballot.{c}"), F.lit("")).alias(f"Ballot {c.capitalize()}") for c in ("category", "issued", "returned")]
    return voters.select(*[F.col(c).alias(k) for k, c in head.items()], *flags, *(early if ballots else []), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"))


def months_back(as_of: str, months: int) -> list[str]:
    """The last months as yyyy-mm, the newest first."""
    year, month = (int(x) for x in re.match(r"(\d{4})-(\d{2})", as_of).groups())
    return [f"{(n := year * 12 + month - 1 - k) // 12:04d}-{n % 12 + 1:02d}" for k in range(months)]


def read_recent_runs(spark: SparkSession, folder: str, as_of: str, months: int = 3) -> DataFrame:
    """The run logs <yyyy-mm>.jsonl of the last months; a month without a file is empty, torn lines are left out."""
    from civlake.sources.files import RUNS

    names = [f"{m}.jsonl" for m in months_back(as_of, months)]
    rows = spark.read.schema(RUNS).option("mode", "DROPMALFORMED").option("pathGlobFilter", f"{{{','.join(names)}}}").json(folder)
    return rows.filter("id is not null")


def read_workflows(spark: SparkSession, folder: str) -> DataFrame:
    """file, name, crons and dispatchable of the .yml and .yaml files in a folder."""
    from civlake.operators.jobs import parsed_workflow

    text = spark.read.option("pathGlobFilter", "*.{yml,yaml}").text(folder, wholetext=True)
    return text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), parsed_workflow(F.col("value")).alias("w")).select("file", "w.*")
