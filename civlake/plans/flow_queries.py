"""Registered queries of sources, sinks and streams: the given tables go out as pages, workbooks, documents and files that land one by one, and come back."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from civlake.operators.ranking import best_row
from civlake.plans.adapter import ELECTIONS, V, table, voters
from civlake.plans.job_queries import _R, AS_OF, _runs, _schedules
from civlake.plans.registry import query
from civlake.scratch import new_path
from civlake.sources import layouts, publish, rolls, workbook
from civlake.sources.paged import LandedPages, land_pages
from civlake.streaming import refresh, timers

_PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@contextmanager
def configured(spark, **settings):
    """Some settings of the session for as long as the block runs."""
    names = {k.replace("_", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _landed(rows, key: str, path: str, span: int, first: int = 0):
    """Pages of which some are short without being the last, and with rows that only an answer by id holds."""
    return land_pages(rows, key, path, span, 100, first, held_back=F.pmod(F.xxhash64(key), F.lit(97)) == 0, short=lambda offset: 37 if offset % 3 == 0 else 100)


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def paged_harvest(spark, d):
    path = new_path(spark, "pages")
    _landed(table(spark, d, "part"), "p_partkey", path, 500).collect()
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").schema(_PART).option("key", "p_partkey").load(path)


@query("SELECT p_partkey, p_name, p_size FROM part")
def resumed_harvest(spark, d):
    """A harvest as a stream: some ranges land and are taken, then the others, from the same checkpoint."""
    path, out, checkpoint = (new_path(spark, x) for x in ("landing", "harvest", "checkpoint"))
    spark.dataSource.register(LandedPages)
    part = table(spark, d, "part")
    low, high = part.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    span = max(1, (high - low) // 4 + 1)
    for first_run in (True, False):
        half = F.floor((F.col("p_partkey") - low) / span) < 2
        _landed(part.filter(half if first_run else ~half), "p_partkey", path, span, low).collect()
        pages = spark.readStream.format("landed_pages").schema(_PART).option("key", "p_partkey").load(path)
        refresh.run_once(pages, out, checkpoint).awaitTermination()
    return spark.read.schema(_PART).parquet(out).select("p_partkey", "p_name", "p_size")


@query("""SELECT c_custkey AS id, c_name AS last, c_mktsegment AS first, n_name AS precinct, c_custkey || ' Oak St' AS street, r_name AS city, lpad((c_nationkey + 44000)::VARCHAR, 5, '0') AS zip,
  strftime(DATE '1899-12-30' + (36000 + c_custkey % 9000)::INTEGER, '%Y-%m-%d') AS registered, CASE WHEN c_custkey % 3 = 0 THEN '--' ELSE 'R' END AS party FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def workbook_roll(spark, d):
    """A workbook a nation with a title, a header, and numbers, texts and blanks as cells."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "n_name", k.alias("id"), F.concat("c_name", F.lit(", "), "c_mktsegment").alias("name"), F.col("n_name").alias("precinct"), F.concat(k.cast("string"), F.lit(" Oak St")).alias("street"),
        F.concat("r_name", F.lit(", OH "), F.lpad((F.col("c_nationkey") + 44000).cast("string"), 5, "0")).alias("csz"), (36000 + k % 9000).alias("day"), F.when(k % 3 > 0, "R").alias("party"),
    )
    path = new_path(spark, "workbooks")
    workbook.write_workbooks(rows, path, "n_name", "id", ["id", "name", "precinct", "street", "csz", "day", "party"], ["Id", "Name", "Precinct", "Street", "City", "Registered", "Party"]).collect()
    return layouts.spreadsheet_roll(workbook.read_workbooks(spark, path))


@query("SELECT p_partkey, concat_ws('', p_name, ' ', chr(34), 'é', chr(34), ',', chr(10)) AS name, CASE WHEN p_size % 3 > 0 THEN p_size END::INTEGER AS size FROM part")
def published_csv(spark, d):
    """A published file with a mark, CR LF and quoted cells, in the place of an older one."""
    from civlake.sources.files import read_csv_back

    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(' "é",\n')).alias("name"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("size"))
    path = f"{new_path(spark, 'published')}/roll.csv"
    publish.publish_csv(p, path, ["p_partkey"], quote_all=True)
    publish.publish_csv(p, path, ["name", "p_partkey"], quote_all=False)
    return read_csv_back(spark, path, p.schema)


@query(V + """SELECT id, precinct_name AS precinct, name AS last, party, mask, (elig & 31 | mask)::INTEGER AS elig, coalesce(ballot, 'none') AS ballot_status, coalesce(category, '') AS category, coalesce(strftime(returned, '%Y-%m-%d'), '') AS returned, jurisdiction FROM v""")
def published_roll(spark, d):
    """Voters out as one document with its dictionaries and back as rows."""
    v = voters(spark, d)
    asked = v.select(
        "id", F.col("precinct_name").alias("precinct"), F.col("name").alias("last"), F.col("party").alias("first"), F.lit('1 "Oak" St').alias("street"), F.lit("LIMA").alias("city"), F.lit("45801").alias("zip"), F.date_format("registered", "yyyy-MM-dd").alias("registered"), "party", "mask",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "jurisdiction", F.lit("ACTIVE").alias("status"), "category", F.lit("").alias("issued"), F.date_format("returned", "yyyy-MM-dd").alias("returned"),
    )
    path = f"{new_path(spark, 'published')}/roll.json"
    told = [{"label": e.label, "countyWide": e.scope is None, "scope": [] if e.scope is not None else None, "provisional": e.provisional} for e in ELECTIONS]
    publish.publish_roll(asked, path, {"county": "Test", "runDate": AS_OF[:10]}, told, ["id", "precinct", "lastName"])
    got = rolls.expanded_roll(*rolls.read_roll_lines(spark, path))
    return got.select("id", "precinct", "last", "party", "mask", "elig", "ballot_status", F.coalesce("ballot.category", F.lit("")).alias("category"), F.coalesce("ballot.returned", F.lit("")).alias("returned"), "jurisdiction")


def _in_drops(spark, rows, at: str, path: str, cuts: list[str]):
    """Land rows drop by drop, by time, and hand on after each."""
    bounds = ["0001-01-01", *cuts, "9999-12-31"]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        rows.filter((F.col(at) >= F.lit(low).cast("timestamp")) & (F.col(at) < F.lit(high).cast("timestamp"))).write.mode("append").parquet(path)
        yield


@query(_R + f""", s AS (SELECT DISTINCT job, kind, started FROM r WHERE event = 'schedule'), a AS (SELECT s.*, lead(started) OVER (PARTITION BY job ORDER BY started) AS later FROM s), n AS (SELECT a.*, x.due FROM a ASOF JOIN slot x ON a.kind = x.kind AND x.due > a.started)
SELECT job, strftime(started, '%Y-%m-%d %H:%M:%S') AS last_started, strftime(due, '%Y-%m-%d %H:%M') AS next_slot FROM n WHERE due + INTERVAL 12 HOURS < coalesce(later, TIMESTAMP '{AS_OF}')""")
def missed_run_timers(spark, d):
    """Events land in three drops; the stream stops after each and goes on from its checkpoint. A last row without a job tells that time has passed."""
    path, out, checkpoint = (new_path(spark, x) for x in ("drops", "misses", "checkpoint"))
    kind = "job string, event string, started timestamp"
    runs = _runs(spark, d).select("job", "event", "started")
    clock = spark.range(1).select(F.lit(None).cast("string").alias("job"), F.lit("schedule").alias("event"), (F.lit(AS_OF).cast("timestamp") + F.expr("interval 1 day")).alias("started"))
    with configured(spark, **{"spark_sql_streaming_stateStore_providerClass": timers.ROCKSDB}):
        for _ in _in_drops(spark, runs.unionByName(clock), "started", path, ["2024-01-08", "2024-01-21"]):
            stream = spark.readStream.schema(kind).parquet(path)
            refresh.run_once(timers.missed_run_stream(stream, _schedules(spark, d)), out, checkpoint).awaitTermination()
    told = spark.read.schema(timers.MISSES).parquet(out)
    return told.select("job", F.date_format("last_started", "yyyy-MM-dd HH:mm:ss").alias("last_started"), F.date_format("next_slot", "yyyy-MM-dd HH:mm").alias("next_slot"))


_LATE = "CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL 2000 YEARS ELSE ts END"


@query(f"""WITH e AS (SELECT {_LATE} AS ts, event_type FROM events), k AS (SELECT *, CASE WHEN ts > TIMESTAMP '2024-02-01' THEN 'late' WHEN ts < TIMESTAMP '2024-01-03' THEN 'early' END AS why FROM e)
SELECT coalesce(why, 'counted') AS kind, CASE WHEN why IS NULL THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS day, CASE WHEN why IS NULL THEN event_type ELSE '' END AS event_type, count(*) AS n FROM k GROUP BY 1, 2, 3""")
def refreshed_days(spark, d):
    """Two drops and a repeated one through a stream of daily counts with a watermark, merged batch by batch; the last batch is run once more; implausible rows are counted beside."""
    e = table(spark, d, "events")
    typed = e.select("event_id", "event_type", F.when(F.col("event_id") % 50 == 0, F.col("ts") + F.expr("interval 2000 years")).otherwise(F.col("ts")).cast("timestamp").alias("ts"))
    path, days, beside, marks = (new_path(spark, x) for x in ("drops", "days", "beside", "checkpoint"))
    counts = lambda s: refresh.daily_counts(s, "ts", "event_type", "40 days", "2024-01-03", "2024-02-01")
    publish_once = refresh.once_each(f"{days}/taken", ["event_id"])
    for drop in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1, F.col("event_id") % 2 == 1):
        typed.filter(drop).write.mode("append").parquet(path)
        rows = spark.readStream.schema(typed.schema).parquet(path)
        refresh.admitted(rows, publish_once, f"{days}/new", f"{marks}/admitted").awaitTermination()
        new = spark.readStream.schema(typed.schema).option("recursiveFileLookup", True).parquet(f"{days}/new")
        refresh.upserted(counts(new), f"{days}/counts", ["day", "event_type"], f"{marks}/counts").awaitTermination()
        refresh.replay_last(spark, f"{marks}/counts")
        refresh.upserted(counts(new), f"{days}/counts", ["day", "event_type"], f"{marks}/counts").awaitTermination()
        refresh.beside(new, "ts", "2024-01-03", "2024-02-01", beside, f"{marks}/beside").awaitTermination()
    good = best_row(refresh.versions(spark, f"{days}/counts", "day timestamp, event_type string, n long"), ["day", "event_type"], [F.col("batch")])
    bad = refresh.versions(spark, beside, "why string, n long").groupBy("why").agg(F.sum("n").alias("n"))
    return good.select(F.lit("counted").alias("kind"), F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n").unionByName(bad.select(F.col("why").alias("kind"), F.lit("").alias("day"), F.lit("").alias("event_type"), "n"))
