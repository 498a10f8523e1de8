"""Files, documents, guards and search on small rows made up here."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from civlake.functions import display, names
from civlake.operators import elections, search, spatial
from civlake.operators.elections import Election
from civlake.operators.reports import yardsticks
from civlake.operators.selection import voted_in
from civlake.sources import files, layouts, rolls
from civlake.streaming import refresh


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column).first()[0]


def test_csv_with_mark_line_ends_and_accents(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿NAME,T\r\nJosé,\"a \"\"b\"\", c\"\r\n,\r\n".encode())
    df = rolls.without_blank_rows(files.read_delimited(spark, str(tmp_path / "a.csv")))
    assert [tuple(r) for r in df.collect()] == [("José", 'a "b", c')] and df.columns == ["NAME", "T"]
    (tmp_path / "b.csv").write_bytes(b"NAME\tT\rx\ty\r")
    assert rolls.separator_of("NAME\tT") == "\t" and rolls.separator_of("A,B\tC,D") == ","
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "b.csv"), sep="\t").collect()] == [("x", "y")]


def test_latest_roll_file_and_recent_logs(spark, tmp_path):
    for n in ("SOS_LIMA_2026-01-02.txt", "SOS_LIMA_2026-03-01.csv", "other.txt"):
        (tmp_path / n).write_text("x")
    assert rolls.latest_roll_file(spark, str(tmp_path)).endswith("SOS_LIMA_2026-03-01.csv")
    logs = tmp_path / "logs"
    logs.mkdir()
    for m, k in (("2026-01", 1), ("2025-12", 2), ("2025-08", 3)):
        (logs / f"{m}.jsonl").write_text(f'{{"id": {k}}}\n{{"id": 9')
    assert rolls.months_back("2026-01-15", 3) == ["2026-01", "2025-12", "2025-11"]
    assert sorted(r["id"] for r in rolls.read_recent_runs(spark, str(logs), "2026-01-15").collect()) == [1, 2]


def test_workflow_folder(spark, tmp_path):
    (tmp_path / "a.yml").write_text("name: 'Nightly'\non:\n  workflow_dispatch:\n  schedule:\n    - cron: '17 7 * * *' # early\n")
    (tmp_path / "b.txt").write_text("name: no\n")
    got = rolls.read_workflows(spark, str(tmp_path)).collect()
    assert [(r["file"], r["name"], [tuple(c) for c in r["crons"]], r["dispatchable"]) for r in got] == [("a.yml", "Nightly", [("17 7 * * *", "early")], True)]


def test_roll_document_round_trip(spark, tmp_path):
    row = (7, "P1", 'O"Neil', "Jo", "1 OAK", "LIMA", "45801", "2001-02-03", "D", 2, None, None, "Lima", "ACTIVE", "EV", "2026-10-01", "2026-10-05")
    other = (3, "P2", "Adams", "Al", "2 ELM", "FAIRMONT, WV", "26554", "", "--", 0, 40.5, -83.5, None, "ACTIVE", None, None, None)
    schema = "id long, precinct string, last string, first string, street string, city string, zip string, registered string, party string, mask int, lat double, lon double, jurisdiction string, status string, category string, issued string, returned string"
    lines, words = rolls.roll_tuples(spark.createDataFrame([row, other], schema))
    listed = lambda name: [r["value"] for r in words[name].orderBy("index").collect()]
    doc = {"county": "Lima", "elections": [{"label": "a", "countyWide": True}, {"label": "b", "countyWide": False, "scope": ["P2"]}, {"label": "c", "provisional": True}]}
    doc |= {k: listed(n) for k, n in (("precincts", "precinct"), ("cities", "city"), ("zips", "zip"), ("parties", "party"), ("jurisdictions", "jurisdiction"), ("ballotCategories", "category"), ("statuses", "status"))}
    doc["voters"] = [json.loads(r["line"]) for r in lines.collect()]
    (tmp_path / "v.json").write_text(json.dumps(doc))
    got = {r["id"]: r for r in rolls.expanded_roll(rolls.read_roll_document(spark, str(tmp_path / "v.json"))).collect()}
    assert [got[7][c] for c in ("precinct", "last", "city", "state", "party", "jurisdiction", "mask", "elig", "status", "ballot_status")] == ["P1", 'O"Neil', "LIMA", "OH", "D", "Lima", 2, 3, "ACTIVE", "returned"]
    assert (got[7]["ballot"]["category"], got[7]["ballot"]["issued"], got[7]["ballot"]["returned"]) == ("EV", "2026-10-01", "2026-10-05")
    assert [got[3][c] for c in ("city", "state", "jurisdiction", "elig", "ballot", "ballot_status", "lat")] == ["FAIRMONT", "WV", "Unassigned", 3, None, "none", 40.5]
    export = rolls.voter_export(rolls.expanded_roll(rolls.read_roll_document(spark, str(tmp_path / "v.json"))), ["a", "b", "c"], True)
    assert export.columns[11:19] == ["a", "b", "c", "Elections Voted", "Early Voting", "Ballot Category", "Ballot Issued", "Ballot Returned"]
    files.write_csv(export.coalesce(1), str(tmp_path / "csv"), line_end="\r\n")
    text = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    assert text.count("\r\n") == 3 and '"O""Neil"' in text and ",2 ELM," in text
    assert [tuple(r)[11:16] for r in export.orderBy("Voter ID").collect()] == [("N", "N", "N", 0, ""), ("N", "Y", "N", 1, "Voted early")]


def test_quoted_export_begins_with_the_mark(spark, tmp_path):
    parcels = spark.createDataFrame([("1", "Lee", "1 Oak", "Lima", "45801", "Homes", "510", 0.5, 1.0, 2.0, 3.0, 1.05, "", 'say "hi"', 40.0, None)], "n string, o string, f string, j string, z string, class string, u string, a double, lm double, bm double, tm double, ta double, s string, d string, y double, x double")
    rolls.write_quoted(rolls.parcel_export(parcels, owner=True, valuation=False), str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode()
    assert text.startswith('﻿"ParcelNumber","Owner","Address"') and text.endswith("\r\n") and '"say ""hi"""' in text and "LandMarket" not in text
    assert text.split("\r\n")[1].endswith('"",""')


def test_file_guard(spark, tmp_path):
    (tmp_path / "f.csv").write_text("x")
    ballots = spark.createDataFrame([(1, "2026-10-01", ""), (1, "2026-10-02", "2029-01-01"), (2, "", "2026-10-05")], "id long, issued string, returned string")
    info = rolls.file_info(spark, str(tmp_path / "f.csv"), 3, ballots, "2026-12-01")
    assert (info["rows"], info["voters"], info["returned"], info["latest"], len(info["sha256"])) == (3, 2, 2, "2026-10-05", 64)
    assert [rolls.replacement(old, info) for old in (None, info, {**info, "sha256": "a"}, {"sha256": "a", "latest": "2026-10-06"})] == ["replace", "same", "replace", "older"]


def test_guarded_stream_publishes_new_files_only(spark, tmp_path):
    seen = []
    step = refresh.guarded(str(tmp_path / "out"), lambda b: dict(zip(("sha256", "latest"), b.agg(F.min("sha"), F.max("day")).first(), strict=True)), lambda b, i: seen.append(i["latest"]))
    for k, (sha, day) in enumerate([("a", "2026-01-02"), ("a", "2026-01-02"), ("b", "2026-01-01"), ("c", "2026-01-03")]):
        step(spark.createDataFrame([(sha, day)], "sha string, day string"), k)
    assert seen == ["2026-01-02", "2026-01-03"]


def test_run_once_takes_each_file_once(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = refresh.run_once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_app_table(spark):
    row = lambda *xs: spark.createDataFrame(list(xs), "fips string, county string, url string")
    assert [r["fips"] for r in rolls.app_table(row(("39003", "B", "https://b.test/"), ("39001", "A", "https://a.test/"))).collect()] == ["39001", "39003"]
    for bad in ((("38001", "A", "https://a.test/"),), (("39001", "", "https://a.test/"),), (("39001", "A", "http://a.test/"),), (("39001", "A", "https://a.test/"),) * 2):
        with pytest.raises(ValueError):
            rolls.app_table(row(*bad))


@pytest.mark.parametrize(
    "text, required, zips",
    [("4761 Waterloo Rd, Atwater, OH 44201-1234", ["4761", "waterloo"], ["44201"]), ("123 main st north jackson oh 44451", ["123", "main"], ["44451"]), ("Randolph Township, OH", ["randolph", "township"], []), ("OH", [], []), ("12 N Elm", ["12", "elm"], [])],
)
def test_read_query(text, required, zips):
    q = search.read_query(text)
    assert (q.required, q.zips) == (required, zips)


def test_election_rules(spark):
    assert elections.described_file("2023 November Sample County General.csv") == {"id": "2023-11-general-sample", "label": "November 2023 Sample General", "year": 2023, "season": "general", "month": 11, "qualifier": "Sample"}
    assert elections.described_file("voted_primary_2024_absentee.csv")["label"] == "2024 Primary" and elections.described_file("notes.csv") is None
    es = [Election(k, str(2019 + k), "general" if k % 2 == 0 else "primary") for k in range(4)] + [Election(4, "2023", "general", provisional=True)]
    y = yardsticks(es, es[-1])
    assert (y.baseline, y.previous, y.primary) == (es[2], es[0], es[3]) and yardsticks([], es[-1]).baseline is None
    v = spark.createDataFrame([(1, 0, 1, None), (2, 0, 1, "out"), (3, 1, 3, None)], "id int, mask int, elig int, ballot string")
    ids = lambda *a, **k: sorted(r["id"] for r in v.filter(voted_in(*a, **k)).collect())
    assert ids([es[0]]) == [3] and ids([es[0]], never=True) == [1, 3] and ids([es[0], es[4]], live=es[4]) == [2, 3] and ids([es[0]], "all", never=True) == [3] and ids([], "all", never=True) == [1]


def test_plane_zone_origin_and_errors(spark):
    z = spatial.zone_of("north")
    x, y = spark.range(1).select(*spatial.to_feet(F.lit(-82.5), F.lit(39.6666666666667), z)).first()
    assert x == pytest.approx(1968500.0, abs=1e-3) and y == pytest.approx(0.0, abs=1e-3)
    with pytest.raises(ValueError):
        spatial.zone_of("east")


def test_dashed_keys_and_links(spark):
    assert one(spark, display.dashed_key(F.col("x")), "A1234567890123") == "A12-3-456-78-901-23"
    with pytest.raises(Exception, match="letter and 13 digits"):
        one(spark, display.dashed_key(F.col("x")), "123")
    assert one(spark, display.read_deep_link(F.col("x")), "https://x.test/?lat=95&lon=1") is None
    assert tuple(one(spark, display.read_deep_link(F.col("x")), "https://x.test/?q=1+Oak%2C+Lima&lat=40.5&lon=-83")) == ("1 Oak, Lima", 40.5, -83.0)


def test_split_name_and_mdy(spark):
    assert tuple(one(spark, names.split_name(F.col("x")), None)) == ("", "", "", "")
    assert [one(spark, layouts.mdy(F.col("x")), t) for t in ("09/1/26 12:30", "10/06/2026 12:00:00 AM", "2026-10-24", "soon", None)] == ["9/1/2026", "10/6/2026", "10/24/2026", "", ""]


def test_sheet_without_its_header_has_no_rows(spark):
    cells = spark.createDataFrame([(0, ["a", "b"]), (1, ["1", "2"])], "seq long, cells array<string>")
    assert layouts.sheet_rows(cells, "Category/Org").count() == 0
    assert [r["row"] for r in layouts.sheet_rows(cells, "A").collect()] == [{"a": "1", "b": "2"}]


def test_implausible_dates(spark):
    rows = spark.createDataFrame([(dt.datetime(2026, 1, 1),), (dt.datetime(4206, 1, 1),), (dt.datetime(1900, 1, 1),), (None,)], "ts timestamp")
    assert refresh.plausible(rows, "ts", "2020-01-01", "2026-12-31").count() == 1
    assert {r["why"]: r["n"] for r in refresh.implausible_counts(rows, "ts", "2020-01-01", "2026-12-31").collect()} == {"late": 1, "early": 1, "undated": 1}
