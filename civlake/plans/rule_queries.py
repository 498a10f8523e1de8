"""Registered queries of orders as people sort, dates, names, merges, drills and what readers leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from civlake.functions import columns as C
from civlake.operators import ingest, parcels, ranking, reports
from civlake.plans.adapter import V, table, voters
from civlake.plans.registry import query
from civlake.scratch import new_path
from civlake.sources import files, publish, rolls

#: The first two words of a text as a person's names, some of them in capitals.
_PERSONS = r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(replace(coalesce(text, ''), 'ß', 's'), '\p{L}+') AS w FROM documents), n AS (SELECT id, CASE WHEN id % 3 = 0 THEN upper(coalesce(w[1], '')) WHEN id % 3 = 1 THEN lower(coalesce(w[1], '')) ELSE coalesce(w[1], '') END AS last, coalesce(w[2], '') AS first FROM w)"""


def _persons(spark, d):
    w = F.regexp_extract_all(F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("s")), F.lit(r"\p{L}+"), F.lit(0))
    last = F.coalesce(F.get(w, F.lit(0)), F.lit(""))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.upper(last)).when(F.col("doc_id") % 3 == 1, F.lower(last)).otherwise(last).alias("last"), F.coalesce(F.get(w, F.lit(1)), F.lit("")).alias("first")
    )


@query(_PERSONS + ' SELECT id, last, first FROM n ORDER BY last COLLATE "en", first COLLATE "en", id LIMIT 50 OFFSET 50')
def collated_page(spark, d):
    p = _persons(spark, d)
    order = ranking.voters_order(ranking.alphabetic(F.col("last")))
    return ranking.page(p, order, 2, 50)


@query(_PERSONS + """ SELECT last[1] AS value, count(*) AS n, (row_number() OVER (ORDER BY last[1] COLLATE "en"))::INTEGER AS place FROM n GROUP BY 1""")
def collated_counts(spark, d):
    p = _persons(spark, d).select(F.left("last", F.lit(1)).alias("letter"))
    return ranking.count_by(p, "letter", "name", collated=True)


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN strftime(ts - INTERVAL 80 YEARS, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def sale_dates(spark, d):
    """Milliseconds of events: never, no number, before 1900, before 1970, and as they are."""
    ms, k = F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id") % 6
    back = lambda years: F.unix_millis(F.col("ts").cast("timestamp") - F.expr(f"interval {years} years"))
    raw = F.when(k == 0, "0").when(k == 1, "n/a").when(k == 2, back(130).cast("string")).when(k == 3, back(80).cast("string")).when(k == 4, F.concat(F.lit(" "), ms.cast("string"))).otherwise(ms.cast("string"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), C.sale_date(raw).alias("day"))


@query("""WITH r AS (SELECT c_custkey AS id, 'L' || (c_custkey % 40) AS last, 'F' || (c_custkey % 25) AS first, c_custkey % 11 AS house, c_nationkey AS zip FROM customer),
b AS (SELECT event_id AS seq, 'L' || (user_id % 45) AS last, 'F' || (user_id % 25) AS first, event_id % 11 AS house, (event_id % 25)::INTEGER AS zip FROM events),
x AS (SELECT last, first, house, min(id) AS a FROM r GROUP BY ALL HAVING count(*) = 1), y AS (SELECT last, first, min(id) AS n FROM r GROUP BY ALL HAVING count(*) = 1), z AS (SELECT last, first, zip, min(id) AS c FROM r GROUP BY ALL HAVING count(*) = 1)
SELECT seq, coalesce(a, n, c, seq + 9000000)::BIGINT AS voter_id, CASE WHEN a IS NOT NULL THEN 'house' WHEN n IS NOT NULL OR c IS NOT NULL THEN 'name' ELSE 'new' END AS how FROM b LEFT JOIN x USING (last, first, house) LEFT JOIN y USING (last, first) LEFT JOIN z USING (last, first, zip)""")
def person_match_zip(spark, d):
    """Of several voters of a name the one in the ballot's ZIP."""
    named = lambda k, m: [F.concat(F.lit("L"), F.expr(f"{k} % {m}").cast("string")).alias("last"), F.concat(F.lit("F"), F.expr(f"{k} % 25").cast("string")).alias("first")]
    roll = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *named("c_custkey", 40), F.expr("c_custkey % 11").alias("house"), F.col("c_nationkey").alias("zip"))
    ballots = table(spark, d, "events").select(F.col("event_id").alias("seq"), *named("user_id", 45), F.expr("event_id % 11").alias("house"), (F.col("event_id") % 25).cast("int").alias("zip"))
    return ingest.match_persons(ballots, roll)


@query("""WITH k AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' Township' ELSE r_name || ' Village' END AS known FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) || ' township' WHEN 1 THEN left(c_mktsegment, (c_custkey % 5 + 1)::INTEGER) || ' Township' WHEN 2 THEN left(r_name, 1) || ' village' ELSE r_name || ' City' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT name, string_split(lower(name), ' ') AS a FROM q), v AS (SELECT known, string_split(lower(known), ' ') AS b FROM k),
p AS (SELECT name, min(known) AS known FROM w JOIN v ON len(a) = len(b) AND a[2:] = b[2:] AND starts_with(b[1], a[1]) GROUP BY 1 HAVING count(*) = 1)
SELECT q.name, coalesce(k.known, p.known, q.name) AS known FROM q LEFT JOIN k ON lower(q.name) = lower(k.known) LEFT JOIN p ON p.name = q.name""")
def canonical_names(spark, d):
    """Townships of segments and villages of regions, asked for whole, cut short, and by a name that none has."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("c_custkey")
    known = rows.select(F.when(k % 2 == 0, F.concat("c_mktsegment", F.lit(" Township"))).otherwise(F.concat("r_name", F.lit(" Village"))).alias("name"))
    cut = F.left("c_mktsegment", (k % 5 + 1).cast("int"))
    asked = rows.select(F.when(k % 4 == 0, F.concat(F.lower("c_mktsegment"), F.lit(" township"))).when(k % 4 == 1, F.concat(cut, F.lit(" Township"))).when(k % 4 == 2, F.concat(F.left("r_name", F.lit(1)), F.lit(" village"))).otherwise(F.concat("r_name", F.lit(" City"))).alias("name"))
    return ingest.canonical_names(asked, known)


@query("""WITH l AS (SELECT user_id, event_id, event_type, 1 << (event_id % 9)::INTEGER AS bit, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, arg_max(event_type, event_id) AS event_type, bit_or(bit)::INTEGER AS mask, count(*) FILTER (p IS NOT NULL AND p <> event_type) AS event_type_changes FROM l GROUP BY 1""")
def merge_masks(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.expr("shiftleft(1, cast(event_id % 9 as int))").alias("mask"))
    return ingest.merge_exports(e, "user_id", "event_id", ["event_type"])


_EARLY = {"day and party": "ballot = 'returned' AND returned::DATE = DATE '2001-02-03' AND party = 'BUILDING'", "month": "strftime(registered, '%Y-%m') = '1995-03'", "pace": "ballot = 'returned' AND DATE '2001-06-30' - returned::DATE >= 30", "place": "ballot = 'returned' AND jurisdiction = 'ASIA'"}


@query(V + " UNION ALL ".join(f"SELECT '{k}' AS drill, count(*) AS n, min(id) AS least, max(id) AS most FROM v WHERE {rule}" for k, rule in _EARLY.items()))
def early_drills(spark, d):
    rules = reports.early_drills("2001-02-03", "BUILDING", "1995-03", 30, "ASIA", "2001-06-30")
    return reports.drill_counts(voters(spark, d), rules, list(_EARLY))


@query("""SELECT CASE WHEN c_custkey % 7 IN (1, 2) THEN 'width' ELSE 'id' END AS why, count(*) AS n FROM customer WHERE c_custkey % 7 IN (1, 2, 3) GROUP BY 1""")
def rows_left_out(spark, d):
    """A roll of customers with rows too short and too long, and with ids that are none."""
    k = F.col("c_custkey")
    text = k.cast("string")
    line = F.when(k % 7 == 1, text).when(k % 7 == 2, F.concat_ws(",", text, "c_name", F.lit("D"), F.lit("more"))).when(k % 7 == 3, F.concat_ws(",", F.concat(F.lit("x"), text), "c_name", F.lit("D"))).otherwise(F.concat_ws(",", text, F.concat(F.lit('"'), "c_name", F.lit(', ""x"""')), F.lit("")))
    lines = table(spark, d, "customer").select(k, line.alias("line"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("COUNTY_ID,LAST_NAME,PARTY").alias("line"))
    path = f"{new_path(spark, 'roll')}/roll.csv"
    publish.publish(head.unionByName(lines).orderBy("c_custkey").select("line"), path)
    return files.rows_left_out(spark, path)


@query("SELECT c_custkey::VARCHAR AS COUNTY_ID, c_name || ', é' AS LAST_NAME, c_mktsegment AS PARTY FROM customer")
def carriage_returns(spark, d):
    """A file with a mark of byte order whose lines end in CR alone."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("COUNTY_ID"), F.concat("c_name", F.lit(", é")).alias("LAST_NAME"), F.col("c_mktsegment").alias("PARTY"))
    path = f"{new_path(spark, 'roll')}/roll.csv"
    publish.publish_csv(c, path, ["COUNTY_ID"], quote_all=False, line_end="\r")
    return files.read_delimited(spark, path, ("COUNTY_ID",))


_REPORTED = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query(" UNION ALL ".join(f"""SELECT concat(rpad('{c}', 26, ' '), ' blank ', lpad(count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '')::VARCHAR, 7, ' '), ' (', lpad(printf('%.1f', count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '') * 100.0 / count(*)), 5, ' '), '%) zero ', lpad(count(*) FILTER (try_cast({c} AS DOUBLE) = 0)::VARCHAR, 7, ' ')) AS line FROM customer""" for c in _REPORTED) + " UNION ALL SELECT concat(rpad('c_phone', 26, ' '), ' blank ', lpad(count(*)::VARCHAR, 7, ' '), ' (100.0%) zero ', lpad('0', 7, ' '), ' ! absent from every row') FROM customer")
def coverage_report(spark, d):
    return rolls.coverage_lines(parcels.column_profile(table(spark, d, "customer"), [*_REPORTED, "c_phone"]))
