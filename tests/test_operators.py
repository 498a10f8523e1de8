"""Operators on small rows made up here."""

import datetime as dt
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from civlake.functions import columns as C
from civlake.operators import address, ingest, jobs, ranking, reports, spatial
from civlake.operators.elections import Election, eligibility
from civlake.operators.selection import Selection, facet_counts, voted_in
from civlake.plans.adapter import ELECTIONS, voters
from civlake.sources import files
from civlake.streaming import refresh

SMALL = "/root/testdata/sf0.001"


def value(spark, column, **row):
    return spark.createDataFrame([Row(**row)]).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [("mcdonald-o hara", "McDonald-O Hara"), ("  LAKE   view ", "Lake View"), ("mc", "Mc"), ("", "")])
def test_title_case(spark, raw, want):
    assert value(spark, C.title_case(F.col("x")), x=raw) == want


@pytest.mark.parametrize("raw, want", [("3/4/2026", "2026-03-04"), ("11/02/25", "2025-11-02"), ("2026-01-02", ""), ("", "")])
def test_iso_date(spark, raw, want):
    assert value(spark, C.iso_date(F.col("x")), x=raw) == want


def test_general_election_day(spark):
    assert value(spark, C.general_election_day(F.col("y")), y=2026) == dt.date(2026, 11, 3)
    assert value(spark, C.general_election_day(F.col("y")), y=2022) == dt.date(2022, 11, 8)


@pytest.mark.parametrize("raw, want", [("12 North Main Street, Apt 3", "12 N MAIN ST"), ("7 State Route 82", "7 SR 82"), ("9 Oak & Pine Av.", "9 OAK PINE AVE"), ("050 W 117th St # 4", "50 W 117 ST"), ("610 1/2 N Park Ave, OH", "610 N PARK AVE"), ("18334-B Bagley Rd", "18334 BAGLEY RD"), ("5 CR 25-A", "5 CO RD 25A"), ("5TH ST", "5TH ST"), ("", "")])
def test_normalised_address(spark, raw, want):
    assert value(spark, address.normalised(F.col("x")), x=raw) == want


def test_half_up_rounding(spark):
    assert [value(spark, C.rounded(F.col("x")), x=x) for x in (-2.5, 2.5, 2.4)] == [-2, 3, 2]


def test_upper_median_and_empty(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, None)] + [("b", 7.0)], "k string, v double")
    assert {r["k"]: r["upper_median"] for r in ranking.upper_median(df, ["k"], "v").collect()} == {"a": 3.0, "b": 7.0}
    assert ranking.upper_median(df.filter("false"), ["k"], "v").count() == 0


def test_reissues_take_the_latest_and_any_return(spark):
    rows = spark.createDataFrame([(1, "2026-01-01", "2026-01-05", 1, "A"), (1, "2026-01-03", None, 2, "B"), (1, "2026-01-03", None, 3, "C")], "id long, issued string, returned string, seq long, kind string")
    got = ingest.collapse_reissues(rows, ["id"]).first()
    assert (got["issued"], got["returned"], got["kind"]) == ("2026-01-03", "2026-01-05", "C")


def test_upsert_twice_is_once(spark):
    roll = spark.createDataFrame([(1,), (2,)], "id long")
    ballots = spark.createDataFrame([(2, "x"), (3, "y")], "id long, ballot string")
    once = ingest.upsert(roll, ballots, "id", "ballot")
    twice = ingest.upsert(once.filter("not added"), ballots, "id", "ballot")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select(once.columns).collect()))


def test_drill_count_is_its_rows(spark):
    v = voters(spark, SMALL).cache()
    for row in reports.cascade(v, ELECTIONS).collect():
        drill = Selection(drills=(("voted", voted_in([ELECTIONS[row["bit"]]])),))
        assert drill.apply(v).count() == row["hits"]
    histogram = reports.profile_histogram(v, ELECTIONS).collect()
    assert sum(r["n"] for r in histogram) == v.count()
    both = {(r["a"], r["b"]): r["both"] for r in reports.retention(v, ELECTIONS).collect()}
    assert all(both[r["bit"], r["bit"]] == r["hits"] for r in reports.cascade(v, ELECTIONS).collect())


def test_facets_ignore_their_own_choice(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "y")], "p string, q string")
    got = {(r["facet"], r["value"]): r["n"] for r in facet_counts(df, Selection(facets={"p": ["a"]}), ["p", "q"]).collect()}
    assert got == {("p", "a"): 2, ("p", "b"): 1, ("p", None): 1, ("q", "x"): 1, ("q", "y"): 1}


def test_eligibility_by_scope(spark):
    e = [Election(0, "2020", "general"), Election(1, "2021", "special", scope=(5,)), Election(2, "2022", "general", provisional=True)]
    df = spark.createDataFrame([(5, 0), (6, 0), (6, 2), (6, 4)], "precinct int, mask int")
    assert [r[0] for r in df.select(eligibility(F.col("precinct"), F.col("mask"), e)).collect()] == [3, 1, 3, 5]


def test_polygon_with_hole(spark):
    p = spatial.Polygon("p", 0, (((0, 0), (4, 0), (4, 4), (0, 4)), ((1, 1), (2, 1), (2, 2), (1, 2))))
    points = [(0.5, 0.5, True), (1.5, 1.5, False), (3.0, 3.0, True), (5.0, 1.0, False)]
    df = spark.createDataFrame(points, "x double, y double, want boolean")
    assert df.filter(spatial.inside(p, F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_cron(spark):
    assert jobs.parse_cron("*/20 8-10 * JAN,mar 7") == [[0, 20, 40], [8, 9, 10], list(range(1, 32)), [1, 3], [0]]
    for bad in ("* * * *", "61 * * * *", "* * * FOO *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            jobs.parse_cron(bad)
    assert jobs.parse_cron("0 0 * * 1/3")[4] == [1, 4] and jobs.parse_cron("0 0 * * 4/3")[4] == [4] and jobs.parse_cron("0 0 * * *")[4] == [0, 1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        jobs.parse_cron("0 0 * * JAN")
    started = [dt.datetime(2026, 3, 2, 7, 30), dt.datetime(2026, 3, 3, 6, 0), dt.datetime(2026, 3, 6, 6, 0)]
    runs = spark.createDataFrame([("j", "schedule", t) for t in started] + [("j", "workflow_dispatch", started[0]), ("k", "schedule", started[0])], "job string, event string, started timestamp")
    schedules = jobs.schedule_table(spark, [("j", "17 7 * * MON")])
    got = [(r["job"], r["event"], str(r["slot"]), r["delay_min"]) for r in jobs.with_delay(runs, schedules).orderBy("job", "event", "started").collect()]
    assert got == [("j", "schedule", "2026-03-02 07:17:00", 13), ("j", "schedule", "2026-03-02 07:17:00", 1363), ("j", "schedule", "None", None), ("j", "workflow_dispatch", "None", None), ("k", "schedule", "None", None)]


def test_missed_runs_of_rare_schedules(spark):
    runs = spark.createDataFrame([(j, "schedule", dt.datetime(2024, 1, 5)) for j in ("monthly", "leap", "never")], "job string, event string, started timestamp")
    schedules = jobs.schedule_table(spark, [("monthly", "0 12 8 * *"), ("leap", "0 0 29 2 *"), ("never", "0 0 30 2 *")])
    got = {r["job"]: (str(r["next_slot"]), r["missed"]) for r in jobs.missed_runs(runs, schedules, "2026-01-05").collect()}
    assert got == {"monthly": ("2024-01-08 12:00:00", True), "leap": ("2024-02-29 00:00:00", True), "never": ("None", False)}


def _addresses(spark, rows, *more):
    names = ["seq", "street", "city", "zip", "lat", "lon", *more]
    return address.with_forms(spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'seq' else 'double' if n in ('lat', 'lon') else 'string'}" for n in names)))


def test_address_tiers(spark):
    points = _addresses(spark, [(1, "10 OAK AVE NE", "A", "44001", 40.0, -83.0), (2, "10 ELM ST", "A", "44001", 40.1, -83.0), (3, "10 ELM ST", "A", "44001", 40.2, -83.0), (4, "20 N HIGH RD", "A", "44001", 40.3, -83.0), (5, "20 S HIGH RD", "A", "44001", 40.4, -83.0)])
    parcels = _addresses(spark, [(6, "30 N PINE ST", "", "44001", 40.5, -83.0, "A", "P1"), (7, "40 MAPLE ST", "", "", 40.6, -83.0, "Bath Township", "P2"), (8, "50 ASH ST", "", "", 40.7, -83.0, "B", "P3")], "jurisdiction", "parcel_id")
    asked = [
        (1, "10 Oak Ave NE", "A", "", ""), (2, "10 Oak Ave", "A", "", ""), (3, "10 Elm St", "A", "", ""), (4, "20 N High St", "B", "44001", ""), (5, "99 Oak Ave", "A", "", ""), (6, "20 High Rd", "A", "44001", ""),
        (7, "30 Pine St", "", "44001", ""), (8, "40 Maple St", "C", "", ""), (9, "50 Ash St", "C", "", ""), (10, "50 Ash St", "", "", "City of B"),
    ]
    df = address.with_forms(spark.createDataFrame(asked, "id long, street string, city string, zip string, muni string"))
    got = {r["id"]: (r["tier"], r["lat"], r["parcel_id"], r["settled"]) for r in address.match_keys(df, address.key_table(points, parcels)).collect()}
    # the first of scattered candidates; N High never meets S High; one direction left off; a township as the last resort; another town is none
    assert got == {1: (1, 40.0, None, True), 2: (2, 40.0, None, True), 3: (1, 40.1, None, True), 4: (3, 40.3, None, True), 7: (5, 40.5, "P1", True), 8: (5, 40.6, "P2", False), 10: (5, 40.7, "P3", True)}


def test_nearest_number_and_side(spark):
    point = "source int, number string, core string, zip string, side string, lat double, lon double"
    points = spark.createDataFrame([(0, "20", "HIGH", "1", None, 40.3, -83.0), (0, "59", "PARK", "1", "E", 40.0, -83.0), (0, "61", "PARK", "1", "W", 41.0, -83.0), (1, "70", "HIGH", "", None, 42.0, -83.0), (0, "5", "OAK", "1", None, None, None)], point)
    points = points.withColumn("city", F.lit("")).withColumn("jurisdiction", F.when(F.col("number") == "70", "Far Township"))
    asked = spark.createDataFrame([(1, "12", "HIGH", "1", None), (2, "90", "HIGH", "1", None), (3, "60", "PARK", "1", "W"), (4, "59", "PARK", "1", None), (5, "5", "OAK", "1", None)], "id long, number string, core string, zip string, side string")
    asked = asked.withColumn("bare", F.lit(None).cast("string")).withColumn("city", F.lit("")).withColumn("muni", F.when(F.col("id") == 2, "Far Twp"))
    got = {r["id"]: (r["distance"], r["lat"]) for r in address.match_nearest(asked, points).collect()}
    assert got == {1: (8.0, 40.3), 2: (20.0, 42.0), 3: (1.5, 41.0), 4: (0.0, 40.0)}


@pytest.mark.parametrize("name, wanted, want", [("RIVER", "RIVERSIDE", True), ("OAK HILL", "OAK", True), ("OAK", "OAKS", False), ("E", "E MAIN", False), ("E", "E", True), ("MAIN", "ELM", False)])
def test_name_prefixes(spark, name, wanted, want):
    assert value(spark, address.is_prefix(F.split("a", " "), F.split("b", " ")), a=name, b=wanted) == want


def test_chunks_count_and_html(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"c{k}.json").write_text(json.dumps([{"n": str(k), "y": 40.0}] * 2))
    paths = [str(tmp_path / f"c{k}.json") for k in range(2)]
    assert files.read_chunks(spark, paths, 4).count() == 4
    with pytest.raises(ValueError, match="5 records"):
        files.read_chunks(spark, paths, 5)
    with pytest.warns(UserWarning):
        files.read_chunks(spark, paths, 5, "warn")
    with pytest.raises(FileNotFoundError, match="c9.json"):
        files.read_chunks(spark, [*paths, str(tmp_path / "c9.json")])
    (tmp_path / "h.json").write_text("<html>no</html>")
    with pytest.raises(ValueError, match="HTML"):
        files.read_chunks(spark, [str(tmp_path / "h.json")])


def test_roll_and_csv_round_trip(spark, tmp_path):
    header = "COUNTY_ID,LAST_NAME,FIRST_NAME,DATE_OF_BIRTH,REGISTRATION_DATE,VOTER_STATUS,PARTY_AFFILIATION,RESIDENTIAL_ADDRESS1,RESIDENTIAL_ZIP,PRECINCT_NAME,GENERAL-11/05/2024,PRIMARY-03/19/2024,GENERAL-11/06/2018"
    rows = ['7,doe,"Jo ""J""",1990-01-01,2001-02-03,,,1 MAIN ST,44001-123,P1,X,,X', "x,a,b,,,,,,,,,,", "7,doe,joan,,2001-02-03,ACTIVE,R,2 MAIN ST,44002,P2,X,R,"]
    (tmp_path / "roll.csv").write_text("\n".join([header, *rows]) + "\n")
    roll, names = files.read_roll(spark, str(tmp_path / "roll.csv"))
    assert names == ["PRIMARY-03/19/2024", "GENERAL-11/05/2024"]
    assert not any("BIRTH" in c.upper() for c in roll.columns)
    got = roll.collect()
    assert [(r["id"], r["first"], r["zip"], r["mask"]) for r in got] == [(7, "JOAN", "44002", 3)]
    with pytest.raises(ValueError, match="PRECINCT"):
        files.read_delimited(spark, str(tmp_path / "roll.csv"), ("PRECINCT",))
    odd = spark.createDataFrame([(1, 'a "quoted", text'), (2, "two\nlines"), (3, "")], "id int, t string")
    files.write_csv(odd, str(tmp_path / "out"), quote_all=True, line_end="\n")
    assert sorted(map(tuple, files.read_csv_back(spark, str(tmp_path / "out"), odd.schema).fillna("").collect())) == sorted(map(tuple, odd.collect()))


def test_ballot_layout_last_row_counts(spark):
    rows = [("5", "1/2/2026", "1/9/2026", "MAIL", "CIV", "VALID"), ("5", "1/3/2026", "", "NOT RECEIVED", "CIV", "CHALLENGED"), ("x", "", "", "", "", "")]
    df = spark.createDataFrame(rows, "CNTYIDNUM string, AVSENTDATE string, AVRECVDATE string, AVRECVMETH string, AVAPPTYPE string, AVBALSTAT string").coalesce(1)
    assert files.is_ballot_layout(df.columns)
    got = files.ballots(df, F.monotonically_increasing_id()).collect()
    assert [(r["id"], r["issued"], r["returned"], r["issue"]) for r in got] == [(5, "2026-01-03", False, "CHALLENGED")]


def test_run_log_and_geocoder(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": 1, "conclusion": "success", "startedAt": "2026-01-01T00:00:00Z"}\n{"id": 2, "concl\n')
    assert [r["id"] for r in files.read_runs(spark, str(tmp_path / "log.jsonl")).collect()] == [1]
    body = json.dumps({"result": {"addressMatches": [{"matchedAddress": "A", "coordinates": {"x": -83.0, "y": 40.0}}, {"matchedAddress": "B"}]}})
    got = files.read_geocoder(spark.createDataFrame([(1, body), (2, "not json"), (3, None)], "k int, body string")).collect()
    assert [(r["k"], r["matched"]) for r in got] == [(1, "A")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, dt.datetime(2026, 1, 1 + k % 5, k % 24), f"u{k % 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, user string")
    for k in range(3):
        df.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    merge = refresh.merge_into(str(tmp_path / "latest"), ["user"], ["ts", "id"])
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "latest/v2"))
    want = refresh.latest_rows(df, ["user"], ["ts", "id"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    q = refresh.daily_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "user", "30 days").writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = refresh.daily_counts(df, "ts", "user")
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, batch.collect()))
