"""Paged sources, workbooks, the publishing sink and the streams, on what goes wrong."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from civlake.sources import files, paged, publish, rolls, stores, workbook
from civlake.streaming import refresh, timers

KIND = "id long, name string"


def pages_of(path, number, ids, answers, batches=(), listed=None, span=100):
    folder = f"{path}/range-{number}-{number * span}-{(number + 1) * span - 1}"
    body = lambda rows: json.dumps({"features": [{"attributes": {"id": i, "name": f"n{i}"}} for i in rows]}).encode()
    for offset, rows in answers.items():
        stores.write_bytes(f"{folder}/page-{offset}.json", body(rows))
    for k, rows in enumerate(batches):
        stores.write_bytes(f"{folder}/batch-{k}.json", body(rows))
    if listed is not None:
        stores.write_bytes(f"{folder}/ids.json", json.dumps(listed).encode())
    return paged.IdRange(number, number * span, (number + 1) * span - 1, folder)


def ids_of(part):
    return [r["id"] for rows in paged.read_range(part, "id") for r in rows]


def test_a_range_goes_on_behind_the_rows_that_came(tmp_path):
    part = pages_of(tmp_path, 0, [], {0: [1, 2, 3], 3: [4], 4: [5, 6, 7], 7: []})
    assert ids_of(part) == [1, 2, 3, 4, 5, 6, 7]
    again = pages_of(tmp_path / "b", 0, [], {0: [1, 2], 2: [2, 3], 4: [4]})
    assert ids_of(again) == [1, 2, 3, 4]  # a row on two pages counts once


def test_what_pages_left_out_comes_from_answers_by_id(tmp_path):
    part = pages_of(tmp_path, 0, [], {0: [1, 2], 2: [4]}, [[9, 3], [2, 5]], [1, 2, 3, 4, 5])
    assert ids_of(part) == [1, 2, 4, 3, 5]
    short = pages_of(tmp_path / "b", 0, [], {0: [1]}, [[2]], [1, 2, 3])
    with pytest.raises(paged.HarvestError, match="1 ids were never answered, 3 among them"):
        ids_of(short)


def test_a_service_that_ignores_the_offset_is_told(tmp_path):
    with pytest.raises(paged.HarvestError, match="not heeded"):
        ids_of(pages_of(tmp_path, 0, [], {0: [1, 2], 2: [1, 2]}))
    with pytest.raises(paged.HarvestError, match="not in the range"):
        ids_of(pages_of(tmp_path / "b", 0, [], {0: [1, 200]}))
    bad = pages_of(tmp_path / "c", 0, [], {})
    stores.write_bytes(f"{bad.folder}/page-0.json", b'{"error": {"code": 400}}')
    with pytest.raises(paged.HarvestError, match="no answer with features"):
        ids_of(bad)


def test_ranges_are_partitions_and_filters_choose_them(spark, tmp_path):
    for n in range(4):
        pages_of(tmp_path, n, [], {0: [n * 100 + 1, n * 100 + 2]})
    spark.dataSource.register(paged.LandedPages)
    load = lambda **o: spark.read.format("landed_pages").schema(KIND).options(key="id", **o).load(str(tmp_path))
    assert load().rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in load().collect()) == [(n * 100 + k, f"n{n * 100 + k}") for n in range(4) for k in (1, 2)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = load(prune="true").filter("id >= 200 and id < 300")
        assert some.rdd.getNumPartitions() == 1 and [r["id"] for r in some.orderBy("id").collect()] == [201, 202]
        assert load(prune="true").filter("id > 900").collect() == []
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="key must name a column"):
        spark.read.format("landed_pages").schema(KIND).option("key", "other").load(str(tmp_path)).collect()


def test_a_harvest_taken_up_again_is_the_unbroken_one(spark, tmp_path):
    rows = spark.range(950).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    told = paged.land_pages(rows, "id", f"{tmp_path}/all", 100, 30, held_back=F.col("id") % 7 == 0, short=lambda o: 11).collect()
    assert sum(r["by_id"] for r in told) == 136 and len(told) == 10
    spark.dataSource.register(paged.LandedPages)
    stream = lambda: spark.readStream.format("landed_pages").schema(KIND).option("key", "id").load(f"{tmp_path}/some")
    for some in ("0", "1"), ("3",), ("2", "4", "5", "6", "7", "8", "9"):
        for n in some:  # range 3 lands before range 2 and waits for it
            os.makedirs(f"{tmp_path}/some", exist_ok=True)
            name = f"range-{n}-{int(n) * 100}-{int(n) * 100 + 99}"
            os.rename(f"{tmp_path}/all/{name}", f"{tmp_path}/some/{name}")
        refresh.run_once(stream(), f"{tmp_path}/out", f"{tmp_path}/marks").awaitTermination()
        if some == ("3",):
            assert spark.read.parquet(f"{tmp_path}/out").count() == 200
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows.collect())


def test_workbooks_hold_all_kinds_of_cells(spark, tmp_path):
    rows = [["Id", "Name & <more>"], [7, None, "x", 2.5], [], ["é\u0001", " two  spaces "]]
    body = workbook.workbook(rows, 'A "sheet"')
    assert [(s, n, c) for s, n, c in workbook.rows_of(body)] == [('A "sheet"', 1, ["Id", "Name & <more>"]), ('A "sheet"', 2, ["7", None, "x", "2.5"]), ('A "sheet"', 3, []), ('A "sheet"', 4, ["é", " two  spaces "])]
    assert list(workbook.rows_of(body, "other")) == []
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(body)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            text = old.read(name)
            if name.endswith("sheet1.xml"):
                cells = b'<row><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r><rPh sb="0" eb="1"><t>said</t></rPh></is></c><c t="b"><v>1</v></c><c r="AB9"><f>1+1</f><v>2</v></c></row>'
                text = text.replace(b"</sheetData>", cells + b"</sheetData>")
            new.writestr(name, text)
    _, number, cells = list(workbook.rows_of(out.getvalue()))[-1]
    assert number == 5 and cells[:2] == ["inline", "TRUE"] and cells[27] == "2" and set(cells[2:27]) == {None}
    (tmp_path / "a.xlsx").write_bytes(body)
    (tmp_path / "b.xlsx").write_bytes(out.getvalue())
    got = workbook.read_workbooks(spark, str(tmp_path)).collect()
    assert len(got) == 9 and {r["file"] for r in got} == {"a.xlsx", "b.xlsx"}
    (tmp_path / "c.xlsx").write_bytes(b"<html>")
    with pytest.raises(Exception, match="c.xlsx is no workbook"):
        workbook.read_workbooks(spark, str(tmp_path)).collect()


def test_a_file_is_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    df = spark.range(50, numPartitions=4).select((49 - F.col("id")).alias("id"), F.when(F.col("id") % 5 == 0, 'a "b", c').when(F.col("id") % 5 == 1, "line\nend").alias("name"))
    publish.publish_csv(df, path, ["id"], quote_all=False)
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfid,name\r\n0,") and raw.endswith(b"\r\n") and raw.count(b'"a ""b"", c"') == 10 and raw.count(b'"line\nend"') == 10 and b"\r\n1,\r\n" in raw
    assert [int(r["id"]) for r in files.read_csv_back(spark, path, df.schema).collect()] == list(range(50))
    assert os.listdir(tmp_path) == ["out.csv"]
    broken = df.select(F.when(F.col("id") < 49, F.col("name")).otherwise(F.raise_error(F.lit("lost"))).alias("line"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(broken, path)
    assert open(path, "rb").read() == raw and os.listdir(tmp_path) == ["out.csv"]
    with pytest.raises(Exception, match="one column of text"):
        publish.publish(df, path)
    publish.publish_csv(df.limit(0), path, ["id"])
    assert open(path, "rb").read() == b'\xef\xbb\xbf"id","name"\r\n'


def test_a_large_file_stays_in_parts_that_are_checked(spark, tmp_path):
    path = str(tmp_path / "parts.json")
    for n in (30, 40):
        publish.publish(spark.range(n, numPartitions=3).select(F.col("id").cast("string").alias("line")), path, single=False)
        parts = publish.published_parts(path)
        assert len(parts) == 3 and sum(p["rows"] for p in parts) == n
        assert b"".join(stores.read_bytes(p["file"]) for p in parts).decode().split() == [str(k) for k in range(n)]
    with open(parts[0]["file"], "ab") as f:
        f.write(b"more")
    with pytest.raises(ValueError, match="is not what was published"):
        publish.published_parts(path)


def test_a_roll_of_nobody_is_a_document_too(spark, tmp_path):
    columns = "id long, precinct string, last string, first string, street string, city string, zip string, registered string, party string, mask int, lat double, lon double, jurisdiction string, status string, category string, issued string, returned string"
    path = str(tmp_path / "roll.json")
    publish.publish_roll(spark.createDataFrame([], columns), path, {"county": "Test"}, [], ["id"])
    assert json.load(open(path)) == {"county": "Test", "elections": [], "fields": ["id"], "precincts": [], "cities": [], "zips": [], "parties": [], "statuses": [], "jurisdictions": [], "ballotCategories": [], "voters": []}
    row = (5, "P", "O'Neil \"Q\"", "A", "1 Oak", "LIMA", "45801", "2020-01-01", "D", 3, None, 1.5, "J", "ACTIVE", None, None, None)
    publish.publish_roll(spark.createDataFrame([row], columns), path, {"county": "Test"}, [], ["id"])
    doc = json.load(open(path))
    assert doc["voters"] == [[5, 0, "O'Neil \"Q\"", "A", "1 Oak", 0, 0, "2020-01-01", 0, 3, None, 1.5, 0, 0, 0, 0]] and doc["precincts"] == ["P"]
    assert [r["last"] for r in rolls.expanded_roll(rolls.read_roll_document(spark, path)).collect()] == ["O'Neil \"Q\""]


def test_missed_slots_are_told_once_whatever_the_order(spark, tmp_path):
    from civlake.operators.jobs import schedule_table

    plan = schedule_table(spark, [("a", "0 6 * * *"), ("b", "0 0 30 2 *")])
    drops = [
        [("a", "schedule", "2024-01-01 06:00:00"), ("a", "schedule", "2024-01-03 06:00:00"), ("b", "schedule", "2024-01-03 00:00:00")],
        [("a", "schedule", "2024-01-02 07:00:00"), ("a", "workflow_dispatch", "2024-01-04 06:00:00"), (None, "schedule", "2024-01-06 12:00:00")],  # the first is late, within the day allowed
        [("a", "schedule", "2024-01-02 08:00:00"), ("c", "schedule", "2024-01-06 00:00:00"), (None, "schedule", "2024-01-09 00:00:00")],  # the first is too late
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    told = []
    try:
        for rows in drops:
            spark.createDataFrame(rows, "job string, event string, started string").withColumn("started", F.col("started").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/runs")
            stream = spark.readStream.schema("job string, event string, started timestamp").parquet(f"{tmp_path}/runs")
            refresh.run_once(timers.missed_run_stream(stream, plan), f"{tmp_path}/told", f"{tmp_path}/marks").awaitTermination()
            told.append(sorted((r["job"], str(r["last_started"]), str(r["next_slot"])) for r in spark.read.schema(timers.MISSES).parquet(f"{tmp_path}/told").collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    # 2 January's slot was kept an hour late, 3 January's kept; 4 January's was missed by 12 hours past 6 o'clock
    assert told == [[], [("a", "2024-01-03 06:00:00", "2024-01-04 06:00:00")], [("a", "2024-01-03 06:00:00", "2024-01-04 06:00:00")]]
