"""Queries against their SQL on small tables made for what the given ones lack."""

import datetime as dt
import json
import os
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from civlake.functions import display
from civlake.plans.queries import ORACLE_SQL, QUERIES

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "/root/testdata/sf0.001"


def differences(spark, folder, name, **tables):
    """Rows that only the query or only its SQL gives over the smallest tables with some of them replaced, by (schema, rows)."""
    folder = str(folder)
    for f in os.listdir(TABLES):
        if f.removesuffix(".parquet") not in tables:
            os.symlink(f"{TABLES}/{f}", f"{folder}/{f}")
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    got = QUERIES[name](spark, folder).toPandas()
    con = duckdb.connect()
    for f in os.listdir(folder):
        files = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{files}'")
    con.register("got", got)
    cols = ", ".join(f'"{c}"' for c in got.columns)
    con.execute(f"CREATE TABLE wanted AS {ORACLE_SQL[name]}")
    return [con.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() for a, b in (("got", "wanted"), ("wanted", "got"))]


def test_clusters_of_ten_thousand(spark, tmp_path):
    parts = [(k, "a b", "B", "T", k % 50, 9.5) for k in (9, 9999, 10000, 1200000)]
    assert differences(spark, tmp_path, "display_values", part=(PART, parts)) == [[], []]
    counts = spark.createDataFrame([(9999,), (10000,)], "n int")
    assert [r[0] for r in counts.select(display.cluster_radius(counts.n)).collect()] == [32, 38]


def test_equal_rows_of_daily_files(spark, tmp_path):
    # two returned rows of one voter, day and file that were sent on different days
    day = lambda n: dt.datetime(2000, 1, n)
    orders = [(7 * k, 5, "F", 1.0, day(10 - 7 * k % 3), "1-URGENT") for k in range(11, 0, -1)]
    assert differences(spark, tmp_path, "layout_daily_files", orders=(ORDERS, orders)) == [[], []]


@pytest.mark.parametrize("name", ["roll_names", "split_names"])
def test_names_of_a_suffix_alone(spark, tmp_path, name):
    documents = [(k, text, "en", "web", 0) for k, text in enumerate(["", None, "1 2", "...", "Ann", "V I", "Ann Lee", "", None, "9"] * 3)]
    assert differences(spark, tmp_path, name, documents=(DOCUMENTS, documents)) == [[], []]


def test_calls_of_timers_grow_with_jobs_not_with_runs():
    from civlake.streaming import timers

    class Held:
        def __init__(self, calls):
            self.rows, self.calls = [], calls

        def appendList(self, rows):
            self.rows += rows
            self.calls.append("append")

    calls, hour = [], lambda n: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=n)
    watch = timers._Watch(1)
    watch.waiting, watch.handle = Held(calls), SimpleNamespace(registerTimer=lambda at: calls.append(at))
    runs = pd.DataFrame({"started": [hour(n % 50) for n in range(100)], "due": [hour(n % 50 + 1) for n in range(100)]})
    list(watch.handleInputRows(("a",), iter([runs]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert calls == ["append", timers._ms(hour(0).to_pydatetime())] and len(watch.waiting.rows) == 50


def test_equal_addresses_are_asked_once(spark):
    from civlake.operators import address

    seen = []
    df = spark.createDataFrame([(k, "1 A ST", "1", "A ST", None) for k in range(20)] + [(20, "2 A ST", "2", "A ST", None)], "id long, street string, number string, core string, bare string")
    once = address._asked_once(lambda a, extra: (seen.append(a.count()), a.select("id", (a.number.cast("int") * extra).alias("x")))[1])
    assert sorted(tuple(r) for r in once(df, 10).collect()) == [*[(k, 10) for k in range(20)], (20, 20)] and seen == [2]


def test_a_collection_with_a_feature_a_line_is_read_in_pieces(spark, tmp_path):
    from civlake.sources import features

    made = spark.range(200).select(F.col("id").alias("seq"), F.create_map(F.lit("NAME"), F.col("id").cast("string")).alias("properties"), F.expr("array(array(array(named_struct('x', id * 1D, 'y', 0D), named_struct('x', id + 1D, 'y', 0D), named_struct('x', id + 1D, 'y', 1D))))").alias("parts"))
    (tmp_path / "a.json").write_text("\n".join(r["line"] for r in features.collection_lines(made).collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        whole, pieces = (features.read_features(spark, str(tmp_path / "a.json"), lines=x) for x in (False, True))
        assert pieces.rdd.getNumPartitions() > 3
        ordered = lambda df: [tuple(r) for r in df.orderBy("file", "seq").select("file", "properties", "parts", "west", "north").collect()]
        assert ordered(pieces) == ordered(whole) and len(ordered(whole)) == 200
        assert [r["properties"]["NAME"] for r in features.in_viewport(pieces, (50.5, 0, 300, 1), 3).collect()] == ["50", "51", "52"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_batch_is_passed_on_in_as_many_files_as_it_has_tasks(spark, tmp_path):
    from civlake.streaming import refresh

    for _ in range(2):
        spark.range(0, 100, 1, 4).write.mode("append").parquet(f"{tmp_path}/in")
        refresh.admitted(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda batch, number: batch.repartition(3).filter(f"{number} = 0"), f"{tmp_path}/new", f"{tmp_path}/marks").awaitTermination()
    new = spark.read.option("recursiveFileLookup", True).schema("id long").parquet(f"{tmp_path}/new")
    assert new.count() == 100 and len([f for f in new.inputFiles() if "batch-000000000" in f]) == 3


def test_a_published_roll_is_read_in_pieces(spark, tmp_path):
    from civlake.sources import publish, rolls

    text = lambda x, n: F.concat(F.lit(x), (F.col("id") % n).cast("string"))
    voters = spark.range(300).select("id", text('P "1", [', 7).alias("precinct"), text("], N\n", 50).alias("last"), F.lit("A").alias("first"), F.lit("1 Oak").alias("street"), text("C", 3).alias("city"), F.lit("45801").alias("zip"), F.lit("2020-01-01").alias("registered"), F.lit("D").alias("party"), (F.col("id") % 4).cast("int").alias("mask"),
        F.lit(None).cast("double").alias("lat"), F.lit(1.5).alias("lon"), F.when(F.col("id") % 2 == 0, "J").alias("jurisdiction"), F.lit("ACTIVE").alias("status"), F.when(F.col("id") % 3 == 0, "EV").alias("category"), F.lit("").alias("issued"), F.lit("2024-03-01").alias("returned"))
    path = str(tmp_path / "roll.json")
    publish.publish_roll(voters.unionByName(voters.filter("id = 0")), path, {"county": "T"}, [{"label": "a", "countyWide": False, "scope": ['P "1", [3']}], ["id"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        doc, tuples = rolls.read_roll_lines(spark, path)
        assert tuples.rdd.getNumPartitions() > 3
        ordered = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
        pieces = ordered(rolls.expanded_roll(doc, tuples))
        assert pieces == ordered(rolls.expanded_roll(rolls.read_roll_document(spark, path))) and len(pieces) == 301
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_sheet_is_matched_in_one_pass(spark):
    from civlake.operators import ingest
    from civlake.sources import layouts

    head = ["x", " Category/ORG", "AV  ID", "Name", "name", "Mailed To", "City", "Precinct", "Issued"]
    body = [["", "MIL", str(n), f"Lee{n}, Ann B.", "no", "1 Oak", "Lima OH 44001", "C1", "3/1/24"] for n in (1, 2, 2, 3)]
    cells = spark.createDataFrame([(0, ["Org of the Category"]), (1, head), *enumerate([*body, ["", "", "9" * 30], ["short"]], 2)], "seq long, cells array<string>")
    roll = spark.createDataFrame([(7, "LEE1", "ANN", "1", "44001", "W1"), (8, "LEE2", "ANN", "5", "44001", None), (ingest.SYNTHETIC_FROM + 3, "KIM", "BO", "1", "44001", "W9")], "id long, last string, first string, house string, zip string, precinct string")
    got = layouts.sheet_ballots(cells, roll)
    # a number that two rows have gives two rows; a new voter's number that someone on the roll has tells no precinct
    want = [(7, "house", "W1", "M", "2024-03-01", ""), (8, "name", "W1", "M", "2024-03-01", ""), (8, "name", "W1", "M", "2024-03-01", ""), (ingest.SYNTHETIC_FROM + 3, "new", "W1", "M", "2024-03-01", "")]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "cells" not in got._jdf.queryExecution().optimizedPlan().toString()  # the sheet itself is not read again


def test_dates_matched_once_are_the_same(spark):
    from civlake.functions import columns
    from civlake.sources import layouts

    texts = ["3/1/24", "03/01/2024", "13/45/1999 12:00", "2024-03-01", "2024-03-01T10:00", "3/1/2024x", "3/1/202", "24-3-1", "2024-3-1", "", "soon", "0/0/00", "3/1/20245", "1/2/24 - 5"]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", F.col("a").alias("b"), columns.iso_date(F.col("a")).alias("x"), columns.iso_date(layouts.mdy(F.col("a"))).alias("y"))
    got = columns.with_iso_dates(columns.with_iso_dates(rows, ("a",)), ("b",), columns.ANY_DAY).collect()
    assert [r["a"] for r in got] == [r["x"] for r in got] and [r["b"] for r in got] == [r["y"] for r in got] and len({r["b"] for r in got}) > 4


def test_positional_rows_meet_in_one_aggregate(spark):
    from civlake.sources import layouts

    row = lambda n, name, issued, back: (n, [""] * 9 + ["", name, "St", "", "", "", "", "ev", issued, back, " 5", ""])
    rows = spark.createDataFrame([row(1, "A", "1/2/2024", "1/5/2024"), row(2, "B", "1/3/2024", ""), row(3, "C", "1/3/2024", ""), row(4, "D", "soon", "1/4/2024"), (5, ["x"])], "seq long, cells array<string>")
    got = layouts.positional_ballots(rows)
    assert [tuple(r) for r in got.collect()] == [(5, "C", "", "St", "", "", "--", "EV", "2024-01-03", "2024-01-04")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_equal_polygons_are_met_once(spark, tmp_path):
    from civlake.operators import spatial
    from civlake.sources import features

    keys = [k + 840 * n for k in (0, 1, 60, 301, 420) for n in range(40)]  # an outline comes again after 840 keys
    assert differences(spark, tmp_path, "located_in_features", supplier=("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(k, f"S{k * 7 % 1000:03d}", 0, 0.0) for k in keys])) == [[], []]
    square = lambda w, e: f"array(array(array(named_struct('x', {w}D, 'y', 0D), named_struct('x', {e}D, 'y', 0D), named_struct('x', {e}D, 'y', 9D), named_struct('x', {w}D, 'y', 9D))))"
    told = spark.range(300).select(F.lit("a").alias("file"), F.col("id").alias("seq"), F.expr(f"CASE WHEN id < 200 THEN {square(0, 9)} WHEN id < 299 THEN {square(-1, 8)} END").alias("parts"))
    edges = features.edges_of(told, F.concat(F.lit("P"), (F.col("seq") % 50).cast("string")), 9 - (F.col("seq") % 7).cast("int"), once=True)
    assert sorted((r["n"], r["alike"]) for r in edges.groupBy("shape", "alike").agg(F.count("*").alias("n")).collect()) == [(4, 99), (4, 200)]
    # a cell inside both is one shape, of all that hold it
    shapes = {(r["cx"], r["cy"]): r["shapes"] for r in spatial.cell_cover(edges, 1.0, each=False).collect()}
    assert [(s["rank"], s["alike"], s["edges"]) for s in shapes[4, 4]] == [(3, 299, [])]
    points = spark.createDataFrame([(1, 4.5, 4.5), (2, 8.5, 4.5), (3, -0.5, 0.5), (4, 99.0, 4.5)], "id long, lon double, lat double")
    assert sorted((r["id"], r["holders"]) for r in spatial.locate_counted(points, edges, cell=1.0).collect()) == [(1, 299), (2, 200), (3, 99)]


def test_features_in_order_are_written_so(spark):
    from civlake.sources import features

    parts = F.expr("array(array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D))))").alias("parts")
    mixed = spark.range(500).orderBy(F.hash("id")).repartitionByRange(4, "id").sortWithinPartitions("id")
    lines = [r["line"] for r in features.collection_lines(mixed.select(F.col("id").alias("seq"), F.create_map(F.lit("N"), F.col("id").cast("string")).alias("properties"), parts), ordered=True).collect()]
    assert [f["properties"]["N"] for f in json.loads("".join(lines))["features"]] == [str(k) for k in range(500)]
