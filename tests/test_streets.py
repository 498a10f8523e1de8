"""Words of addresses, addresses in one text, names of places and schedules in words, case by case."""

import pytest
from pyspark.sql import functions as F

from civlake.functions.columns import place_key
from civlake.functions.streets import compound_addresses, street_tokens
from civlake.operators import jobs

#: What a text's words become.
WORDS = {
    "": "", "5": "5", "APT 4": "", "Rear 5 Pine Rd": "", "0071 Pine  Rd.": "71 PINE RD", "71 1/2 Pine Rd": "71 PINE RD", "71 1 2 e pine rd": "71 E PINE RD", "71B Pine Rd": "71 PINE RD", "71-B Pine Rd": "71 PINE RD", "71 B Pine Rd": "71 PINE RD",
    "71 B Rd": "71 B RD", "71 N Pine Rd": "71 N PINE RD", "71 B N Pine Rd": "71 N PINE RD", "71 B C St": "71 B C ST", "71 Y & Z Rd": "71 Y Z RD", "71 Salt and Pepper Rd": "71 SALT PEPPER RD", "71 And": "71 AND",
    "71 Pine Rd, 3rd Floor": "71 PINE RD", "71 Pine Rd 1st & 2nd Fl": "71 PINE RD", "71 Pine Rd Suites B": "71 PINE RD", "71 Pine Rd Box 9": "71 PINE RD", "71 Box Elder Rd": "71 BOX ELDER RD", "71 Pine Rd RR3": "71 PINE RD", "71 Pine Rd #3, OH": "71 PINE RD", "71 Pine (SR 9) Rd": "71 PINE RD",
    "71 W 19th St": "71 W 19 ST", "71 Nineteenth Street": "71 19 ST", "9th St": "9TH ST", "71 9 Mile Dr": "71 9 MILE DR", "71 No 9th St": "71 N 9 ST", "71 No": "71 NO", "71 Old Hill Pk SW": "71 OLD HILL PIKE SW", "71 N Park Ave": "71 N PARK AVE", "71 Pk": "71 PK",
    "71 SR9": "71 SR 9", "71 St Rte 9": "71 SR 9", "71 State Route 9N": "71 SR 9N", "71 SR9N": "71 SR 9 N", "71 OH-9 East": "71 SR 9 E", "71 US 9": "71 SR 9", "71 U.S. Highway 9": "71 SR 9", "U S Rt 9": "SR 9", "71 US Grant Rd": "71 US GRANT RD", "71 S.R. 9": "71 SR 9", "71 Rt 9 St": "71 SR 9 ST",
    "71 CR9A": "71 CO RD 9A", "71 County Road 9-A": "71 CO RD 9A", "71 Co 9 Rd": "71 CO RD 9", "71 S County Rd 9": "71 S CO RD 9", "71 Twp 9 Road": "71 TWP RD 9", "71 TR 9": "71 TWP RD 9", "71 Township Rd 9 NE": "71 TWP RD 9 NE", "71 County Line Rd": "71 COUNTY LINE RD",
}
COMPOUND = {
    "": [""], "71 Pine Rd": ["71 PINE RD"], "7110-12 Pine Rd": ["7110 PINE RD", "7112 PINE RD"], "71-190 Pine Rd": ["71 PINE RD"], "71-60 Pine Rd": ["71 PINE RD"], "71-3-5 Pine Rd": ["71 PINE RD", "73 PINE RD", "75 PINE RD"], "7100,02,04 Pine Rd": ["7100 PINE RD", "7102 PINE RD", "7104 PINE RD"],
    "710 714 Pine Rd": ["710 PINE RD", "714 PINE RD"], "710 9 Mile Rd": ["710 9 MILE RD"], "710 714 9th St": ["710 714 9TH ST"], "71 & 75 Pine Rd": ["71 PINE RD", "75 PINE RD"], "71 and 75 & 79 Pine Rd": ["71 PINE RD", "75 PINE RD", "79 PINE RD"], "71 1/2 & 75 Pine Rd": ["71 PINE RD", "75 PINE RD"],
    "71 Pine Rd & 10-12 Fir Ct": ["71 PINE RD", "10 FIR CT", "12 FIR CT"], "71 Pine Rd & Patio": ["71 PINE RD"], "71 Y & Z Rd": ["71 Y & Z RD"], "71 & 75 Pine Rd and deck": ["71 PINE RD", "75 PINE RD"], "71 Pine Rd\nAKA 9 Fir Ct": ["71 PINE RD", "9 FIR CT"],
    "Big Hall\r\n 71 Pine Rd": ["BIG HALL", "71 PINE RD"], "Big Hall, 71 Pine Rd, unit 2": ["71 PINE RD"], "71 Pine Rd\n71 pine rd": ["71 PINE RD"], "71-B Pine Rd": ["71-B PINE RD"], "71 & 75": ["71", "75"],
}
PLACES = {"": "", "Far Twp": "FAR", "FAR TOWNSHIP": "FAR", "The Village of Far Hills": "FAR HILLS", "City of Far, Ohio": "FAR", "Far Hgts": "FAR HTS", "Mount Far OH": "MT FAR", "St. Far": "ST FAR", "saint far": "ST FAR", "City": "CITY", "Far city": "FAR", "Village of": "", "The Pines": "THE PINES", "Ohio": "OHIO", "Ohio City": "OHIO"}


def answers(spark, cases, rule):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(cases)], "k int, s string")
    return {list(cases)[r["k"]]: r["a"] for r in df.select("k", rule(F.col("s")).alias("a")).collect()}


def test_words_of_streets(spark):
    assert answers(spark, WORDS, lambda s: F.array_join(street_tokens(s), " ")) == WORDS
    assert spark.range(1).select(street_tokens(F.lit(None).cast("string")).alias("t")).first()["t"] == []


def test_addresses_in_one_text(spark):
    assert answers(spark, COMPOUND, compound_addresses) == COMPOUND


def test_names_of_places(spark):
    assert answers(spark, PLACES, place_key) == PLACES


@pytest.mark.parametrize("expr", ["17 7 * * *", "*/20 1-6,22 1,15-20/2 JAN-mar Sun,5-7", "0 0 29 2 *", "5/10 * */4 * 6", "60 * * * *", "* * * *", "x * * * *", "1-2-3 * * * *", "9-3 * * * *", "*/0 * * * *", "1//2 * * * *", ", * * * *"])
def test_schedules_parse_in_columns_as_one_by_one(spark, expr):
    got = spark.createDataFrame([(expr,)], "e string").select(jobs.cron_fields(F.col("e")).alias("f")).first()["f"]
    try:
        want = jobs.parse_cron(expr)
    except ValueError:
        assert got is None
    else:
        assert [got[c] for c in ("minutes", "hours", "doms", "months", "dows")] == want
        assert (got["any_dom"], got["any_dow"]) == tuple(expr.split()[k].startswith("*") for k in (2, 4))


def test_schedules_in_words(spark):
    cases = {
        "9 6 * * *": "daily at 1:09 AM", "30 5 * * 2": "Tuesdays at 12:30 AM", "30 4 * * 2": "Tuesdays at 11:30 PM (the evening before, local)", "30 4 * * *": "daily at 11:30 PM", "0 13 * * 1-5": "weekdays at 8:00 AM", "0 13 * * 0,6": "weekends at 8:00 AM", "0 13 * * 1,3,4": "Mondays, Wednesdays and Thursdays at 8:00 AM",
        "9 * * * *": "hourly at :09", "*/8 * * * *": "every 7.5 minutes", "*/15 * * * 3": "Wednesdays every 15 minutes (the evening before, local)", "0 1-9 * * *": "9 times a day", "0 12,14,20 * * *": "daily at 7:00 AM, 9:00 AM and 3:00 PM", "0 17 2 * *": "monthly on the 2nd at 12:00 PM",
        "0 17 11-13,21,22 4 *": "on the 11th–13th, 21st and 22nd in Apr at 1:00 PM", "0 17 3 * 0": "monthly on the 3rd or Sundays at 12:00 PM",
    }
    df = spark.createDataFrame([(e,) for e in cases], "e string").select("e", jobs.cron_fields(F.col("e")).alias("f")).select("e", "f.*")
    assert {r["e"]: r["words"] for r in jobs.described(df, "America/New_York", "2024-01-10 00:00:00").collect()} == cases
