"""The registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from civlake.functions import columns as C
from civlake.operators import address, elections, ingest, parcels, ranking, reports, spatial
from civlake.operators.selection import Selection, facet_counts, word_prefixes
from civlake.plans import address_queries, flow_queries, job_queries, layout_queries, map_queries, roll_queries, rule_queries, text_queries  # noqa: F401  register their queries
from civlake.plans.adapter import ELECTIONS, V, table, voters, votes
from civlake.plans.registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]

BITS = "(SELECT unnest(range(7))::INTEGER AS bit) b"
NV, NE = "bit_count(mask & 63)", "bit_count(elig & 63)"
DONE = [e for e in ELECTIONS if not e.provisional]
LIVE = ELECTIONS[-1]
IN_PERSON = ["1-URGENT"]


@query(V + f"""SELECT bit, (1995 + bit)::VARCHAR AS label, hits, eligible, round(hits / greatest(1, max(hits) OVER ())::DOUBLE, 6) AS share_of_max,
  round(CASE WHEN eligible = 0 THEN 0 ELSE hits / eligible::DOUBLE END, 6) AS share_of_eligible
FROM (SELECT bit, count(*) FILTER (mask >> bit & 1 = 1) AS hits, count(*) FILTER (bit = 6 OR elig >> bit & 1 = 1) AS eligible FROM v, {BITS} GROUP BY bit)""")
def cascade(spark, d):
    return reports.cascade(voters(spark, d), ELECTIONS)


@query(V + """SELECT a, b, count(*) FILTER (mask >> a & 1 = 1) AS total, count(*) FILTER (mask >> a & 1 = 1 AND mask >> b & 1 = 1) AS both,
  round(coalesce(count(*) FILTER (mask >> a & 1 = 1 AND mask >> b & 1 = 1) / nullif(count(*) FILTER (mask >> a & 1 = 1), 0)::DOUBLE, 0), 6) AS share
FROM v, (SELECT unnest(range(7))::INTEGER AS a), (SELECT unnest(range(7))::INTEGER AS b) GROUP BY a, b""")
def retention(spark, d):
    return reports.retention(voters(spark, d), ELECTIONS)


@query(V + f"""SELECT count(*) AS n, count(*) FILTER (bit_count(elig) > 0 AND bit_count(mask) = bit_count(elig)) AS every_eligible, count(*) FILTER (bit_count(mask) = 1) AS exactly_one, count(*) FILTER (mask & 63 = 63) AS every_on_file,
  sum(bit_count(mask))::BIGINT AS voted, sum(bit_count(elig))::BIGINT AS could, round(sum(bit_count(mask)) / sum(bit_count(elig))::DOUBLE, 6) AS mean_rate,
  count(*) FILTER (mask & 21 > 0 AND mask & 10 > 0) AS both_habits, count(*) FILTER (mask & 21 > 0 AND mask & 10 = 0) AS general_only,
  count(*) FILTER (mask & 21 = 0 AND mask & 10 > 0) AS primary_only, count(*) FILTER (mask & 31 = 0 AND mask & 32 > 0) AS special_only FROM v""")
def profile(spark, d):
    return reports.profile(voters(spark, d), ELECTIONS)


@query(V + "SELECT k, count(*) FILTER (bit_count(mask) = k) AS n FROM v, (SELECT unnest(range(8))::INTEGER AS k) GROUP BY k")
def profile_histogram(spark, d):
    return reports.profile_histogram(voters(spark, d), ELECTIONS)


@query(V + f"""SELECT precinct_name, count(*) AS n, sum(bit_count(mask))::BIGINT AS voted, sum(bit_count(elig))::BIGINT AS could, round(sum(bit_count(mask)) / sum(bit_count(elig))::DOUBLE, 6) AS rate,
  count(*) FILTER (bit_count(elig) > 0 AND bit_count(mask) >= bit_count(elig) * 0.8::DOUBLE) AS faithful, count(*) FILTER (bit_count(mask) = 1) AS once_only FROM v GROUP BY 1 HAVING count(*) >= 50""")
def geography(spark, d):
    return reports.geography(voters(spark, d), "precinct_name", ELECTIONS, 50)


@query(V + """SELECT (CASE WHEN year(registered) >= 1996 THEN year(registered) ELSE year(registered) // 10 * 10 END)::INTEGER AS cohort, count(*) AS n, sum(bit_count(mask))::BIGINT AS voted
FROM v WHERE registered IS NOT NULL GROUP BY 1""")
def cohorts(spark, d):
    return reports.cohorts(voters(spark, d), 1996)


@query(V + "SELECT strftime(registered, '%Y-%m') AS month, count(*) AS n FROM v WHERE strftime(registered, '%Y-%m') >= '1995-06' GROUP BY 1")
def registrations_by_month(spark, d):
    return reports.registrations_by_month(voters(spark, d), "1995-06")


@query(V + "SELECT party, count(*) AS n, count(*) FILTER (balance < 0) AS unplaced, round(count(*) FILTER (balance < 0) / count(*)::DOUBLE, 6) AS rate FROM v GROUP BY 1 HAVING count(*) >= 200")
def address_quality(spark, d):
    return reports.unplaced_rate(voters(spark, d), "party", "balance >= 0")


@query(V + """SELECT day, in_person, mail, total, (sum(total) OVER (ORDER BY day))::BIGINT AS running FROM (SELECT returned::DATE AS day, count(*) FILTER (category = '1-URGENT') AS in_person,
  count(*) FILTER (category <> '1-URGENT') AS mail, count(*) AS total FROM v WHERE ballot = 'returned' GROUP BY 1)""")
def early_days(spark, d):
    return reports.early_days(voters(spark, d), IN_PERSON)


@query(V + """SELECT *, round(coalesce(mail_returned / nullif(mail_issued, 0)::DOUBLE, 0), 6) AS mail_rate FROM (SELECT party, count(*) AS issued, count(*) FILTER (ballot = 'returned') AS returned,
  count(*) FILTER (ballot = 'returned' AND category = '1-URGENT') AS in_person, count(*) FILTER (category <> '1-URGENT') AS mail_issued,
  count(*) FILTER (ballot = 'returned' AND category <> '1-URGENT') AS mail_returned FROM v WHERE ballot IS NOT NULL GROUP BY 1)""")
def early_party(spark, d):
    return reports.early_party(voters(spark, d), IN_PERSON)


@query(V + """SELECT precinct_name, early, baseline, round(early / baseline::DOUBLE, 6) AS pace FROM (SELECT precinct_name, count(*) FILTER (ballot = 'returned') AS early,
  count(*) FILTER (mask & 16 > 0) AS baseline FROM v GROUP BY 1) WHERE baseline >= 30""")
def early_pace(spark, d):
    return reports.pace(voters(spark, d), "precinct_name", reports.baseline_of(ELECTIONS, LIVE), 30)


@query(V + f"SELECT {NV}::INTEGER AS prior, count(*) AS n, count(*) FILTER (mask & 16 = 0) AS skipped_baseline FROM v WHERE ballot = 'returned' GROUP BY 1")
def early_profile(spark, d):
    return reports.early_profile(voters(spark, d), ELECTIONS, reports.baseline_of(ELECTIONS, LIVE))


@query(V + "SELECT coalesce(ballot, 'none') AS status, party, count(*) AS n FROM v GROUP BY GROUPING SETS ((coalesce(ballot, 'none')), (party), (coalesce(ballot, 'none'), party))")
def stats_roll(spark, d):
    return reports.roll_stats(voters(spark, d).withColumn("ballot", F.coalesce("ballot", F.lit("none"))), "ballot", "party")


@query(V + """SELECT count(*) FILTER (ballot = 'returned') AS returned, count(*) FILTER (returned::DATE > DATE '2001-05-01') AS undated,
  strftime(max(returned::DATE) FILTER (returned::DATE <= DATE '2001-05-01'), '%Y-%m-%d') AS latest FROM v""")
def stats_undated(spark, d):
    return reports.undated_returns(voters(spark, d), "2001-05-01")


_PER = V + ", s AS (SELECT precinct, count(*) AS n FROM v GROUP BY 1), t AS (SELECT year(o_orderdate) - 1995 AS election, c_nationkey AS precinct, count(*) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), u AS (SELECT * FROM t JOIN s USING (precinct)) "


def _ballots(spark, d):
    base = voters(spark, d)
    sizes = base.groupBy("precinct").agg(F.count(F.lit(1)).alias("n"))
    return votes(spark, d).join(base.select("id", "precinct"), "id").select(F.col("bit").alias("election"), "precinct"), sizes


@query(_PER + """SELECT election::INTEGER AS election, sum(b)::BIGINT AS ballots, coalesce(sum(b) FILTER (b >= n * 1.4::DOUBLE), 0)::BIGINT AS in_turnout,
  coalesce(sum(b) FILTER (b >= n * 1.4::DOUBLE), 0) >= sum(b) * 0.5::DOUBLE AS keep FROM u GROUP BY 1""")
def keep_elections(spark, d):
    ballots, sizes = _ballots(spark, d)
    return elections.keep_test(ballots, sizes, 1.4)


@query(_PER + """, r AS (SELECT election, b / n::DOUBLE AS turnout, row_number() OVER (PARTITION BY election ORDER BY b / n::DOUBLE) - 1 AS k, count(*) OVER (PARTITION BY election) AS c FROM u),
m AS (SELECT election, turnout AS upper_median FROM r WHERE k = c // 2)
SELECT election::INTEGER AS election, round(upper_median, 6) AS upper_median, count(*) FILTER (turnout >= upper_median * 0.95::DOUBLE) AS in_scope, count(*) FILTER (turnout >= upper_median * 0.95::DOUBLE) >= 15 AS county_wide
FROM r JOIN m USING (election) GROUP BY election, upper_median""")
def scope_floor(spark, d):
    ballots, sizes = _ballots(spark, d)
    return elections.scope_floor(elections.turnout_by_precinct(ballots, sizes), 25, 0.95, 0.6)


@query(V + "SELECT id, elig, mask, bit_count(elig)::INTEGER AS n_open FROM v")
def eligible_mask(spark, d):
    return voters(spark, d).select("id", "elig", "mask", elections.n_bits(F.col("elig")).alias("n_open"))


CHOICE = Selection(facets={"party": ["BUILDING", "MACHINERY"], "jurisdiction": ["ASIA", "EUROPE"]})


@query(V + """SELECT facet, value, n FROM (
SELECT 'party' AS facet, party AS value, count(*) FILTER (jurisdiction IN ('ASIA', 'EUROPE')) AS n FROM v GROUP BY party UNION ALL
SELECT 'jurisdiction', jurisdiction, count(*) FILTER (party IN ('BUILDING', 'MACHINERY')) FROM v GROUP BY jurisdiction UNION ALL
SELECT 'ballot', ballot, count(*) FILTER (party IN ('BUILDING', 'MACHINERY') AND jurisdiction IN ('ASIA', 'EUROPE')) FROM v GROUP BY ballot)""")
def facet_count(spark, d):
    return facet_counts(voters(spark, d), CHOICE, ["party", "jurisdiction", "ballot"])


@query(V + "SELECT id FROM v WHERE ballot = 'out' AND mask & 16 > 0 AND party = 'BUILDING'")
def drill_stack(spark, d):
    chosen = Selection(facets={"party": ["BUILDING"]}, drills=(("out", F.col("ballot") == "out"), ("voted 1999", elections.voted(ELECTIONS[4]))))
    return chosen.apply(voters(spark, d)).select("id")


@query(V + "SELECT id, name, balance FROM v ORDER BY balance DESC, name, id LIMIT 50 OFFSET 50")
def page_sorted(spark, d):
    return ranking.page(voters(spark, d).select("id", "name", "balance"), [F.desc("balance"), F.asc("name"), F.asc("id")], 2, 50)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'on') AND contains(lower(text), 'the ')")
def text_search(spark, d):
    docs = table(spark, d, "documents").withColumn("search", F.lower("text"))
    return Selection(text="ON the").apply(docs).filter(F.contains("search", F.lit("the "))).select("doc_id")


@query("""SELECT doc_id FROM (SELECT doc_id, ' ' || regexp_replace(translate(lower(text), 'àâäáãåçèéêëìíîïñòóôöõùúûüÿ', 'aaaaaaceeeeiiiinooooouuuuy'), '[^a-z0-9]+', ' ', 'g') AS t FROM documents)
WHERE contains(t, ' ele') AND contains(t, ' ou')""")
def word_prefix_search(spark, d):
    return table(spark, d, "documents").filter(word_prefixes(F.col("text"), "Ele ou")).select("doc_id")


@query("SELECT coalesce(nullif(trim(user_id::VARCHAR), ''), '(blank)') AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 12")
def top_k_distinct(spark, d):
    return ranking.top_values(table(spark, d, "events"), "user_id", 12)


@query("SELECT p_partkey, p_size FROM part WHERE p_retailprice >= 920 AND p_retailprice <= 960 AND p_size <= 20")
def range_filter(spark, d):
    return table(spark, d, "part").filter(parcels.in_ranges({"p_retailprice": (920, 960), "p_size": (None, 20)})).select("p_partkey", "p_size")


@query("SELECT coalesce(nullif(regexp_extract(p_brand, '(\\d)', 1), '')::INTEGER, 0) AS class, count(*) AS n FROM part GROUP BY 1")
def class_counts(spark, d):
    return parcels.class_counts(table(spark, d, "part"), C.first_digit(F.col("p_brand")))


@query("""SELECT district, n, (row_number() OVER (ORDER BY district = 'Unassigned', district))::INTEGER AS place FROM
(SELECT coalesce(nullif(trim(CASE WHEN p_size > 10 THEN p_type END), ''), 'Unassigned') AS district, count(*) AS n FROM part GROUP BY 1)""")
def district_counts(spark, d):
    return parcels.district_counts(table(spark, d, "part").withColumn("district", F.when(F.col("p_size") > 10, F.col("p_type"))), "district")


_E = "WITH e AS (SELECT event_id AS seq, user_id, event_type, ts AS issued, CASE WHEN event_id % 3 = 0 THEN ts END AS returned, value FROM events) "


def _reissues(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), "user_id", "event_type", F.col("ts").alias("issued"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("returned"), "value")


@query(_E + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY issued DESC, seq DESC) AS k, max(returned) OVER (PARTITION BY user_id, event_type) AS back FROM e)
SELECT user_id, event_type, seq, strftime(issued, '%Y-%m-%d %H:%M:%S') AS issued, strftime(coalesce(returned, back), '%Y-%m-%d %H:%M:%S') AS returned, round(value, 6) AS value FROM r WHERE k = 1""")
def dedupe_reissue(spark, d):
    out = ingest.collapse_reissues(_reissues(spark, d), ["user_id", "event_type"])
    return out.select("user_id", "event_type", "seq", F.date_format("issued", "yyyy-MM-dd HH:mm:ss").alias("issued"), F.date_format("returned", "yyyy-MM-dd HH:mm:ss").alias("returned"), "value")


@query(_E + """SELECT user_id, event_type, seq, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY returned IS NOT NULL DESC, issued DESC, seq DESC) AS k FROM e) WHERE k = 1""")
def dedupe_ranked(spark, d):
    out = ranking.best_row(_reissues(spark, d), ["user_id", "event_type"], [F.col("returned").isNotNull(), F.col("issued"), F.col("seq")])
    return out.select("user_id", "event_type", "seq", "value")


@query("""SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY 1, 2) WHERE k = 1""")
def majority_vote(spark, d):
    return ranking.majority(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) FILTER (p IS NOT NULL AND p <> event_type) AS event_type_changes FROM l GROUP BY 1""")
def merge_conflicts(spark, d):
    return ingest.merge_exports(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_type"])


@query("""WITH r AS (SELECT c_custkey AS id, c_nationkey % 4 AS street, CASE WHEN c_custkey % 3 = 0 THEN ['P' || c_nationkey] ELSE ['P' || c_nationkey, 'P' || (c_nationkey + 1)] END AS candidates FROM customer),
h AS (SELECT c_custkey AS id, 'P' || c_nationkey AS held FROM customer WHERE c_custkey % 5 = 0), s AS (SELECT DISTINCT n_nationkey % 4 AS street, 'P' || n_nationkey AS precinct FROM nation),
n AS (SELECT r.id, count(*) AS k, min(s.precinct) AS near FROM r JOIN s ON r.street = s.street AND list_contains(candidates, s.precinct) GROUP BY 1)
SELECT r.id, CASE WHEN len(candidates) = 1 THEN candidates[1] WHEN list_contains(candidates, held) THEN held WHEN k = 1 THEN near ELSE list_min(candidates) END AS precinct,
  CASE WHEN len(candidates) = 1 THEN 'single' WHEN coalesce(list_contains(candidates, held), false) THEN 'prior' WHEN k = 1 THEN 'street' ELSE 'bare' END AS reason FROM r LEFT JOIN h ON r.id = h.id LEFT JOIN n ON r.id = n.id""")
def precinct_resolve(spark, d):
    c = table(spark, d, "customer")
    p = lambda k: F.concat(F.lit("P"), F.expr(k).cast("string"))
    rows = c.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 4).alias("street"), F.when(F.col("c_custkey") % 3 == 0, F.array(p("c_nationkey"))).otherwise(F.array(p("c_nationkey"), p("c_nationkey + 1"))).alias("candidates"))
    prior = c.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), p("c_nationkey").alias("precinct"))
    near = table(spark, d, "nation").select((F.col("n_nationkey") % 4).alias("street"), p("n_nationkey").alias("precinct"))
    return ingest.resolve_precinct(rows, prior, near)


@query("""WITH r AS (SELECT c_custkey AS id, 'L' || (c_custkey % 40) AS last, 'F' || (c_custkey % 25) AS first, c_custkey % 11 AS house FROM customer),
b AS (SELECT event_id AS seq, 'L' || (user_id % 45) AS last, 'F' || (user_id % 25) AS first, event_id % 11 AS house FROM events),
x AS (SELECT last, first, house, min(id) AS a FROM r GROUP BY ALL HAVING count(*) = 1), y AS (SELECT last, first, min(id) AS n FROM r GROUP BY ALL HAVING count(*) = 1)
SELECT seq, coalesce(a, n, seq + 9000000)::BIGINT AS voter_id, CASE WHEN a IS NOT NULL THEN 'house' WHEN n IS NOT NULL THEN 'name' ELSE 'new' END AS how FROM b LEFT JOIN x USING (last, first, house) LEFT JOIN y USING (last, first)""")
def person_match(spark, d):
    named = lambda k, m: [F.concat(F.lit("L"), F.expr(f"{k} % {m}").cast("string")).alias("last"), F.concat(F.lit("F"), F.expr(f"{k} % 25").cast("string")).alias("first")]
    roll = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *named("c_custkey", 40), F.expr("c_custkey % 11").alias("house"))
    ballots = table(spark, d, "events").select(F.col("event_id").alias("seq"), *named("user_id", 45), F.expr("event_id % 11").alias("house"))
    return ingest.match_persons(ballots, roll)


@query("""WITH k AS (SELECT n_name AS known FROM nation), q AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT left(n_name, 3) || 'X' FROM nation WHERE n_nationkey % 2 = 1),
l AS (SELECT name, min(known) AS known FROM q JOIN k ON left(split_part(upper(name), ' ', 1), 3) = left(split_part(upper(known), ' ', 1), 3)
  AND substr(upper(name), length(split_part(name, ' ', 1)) + 2) = substr(upper(known), length(split_part(known, ' ', 1)) + 2) GROUP BY 1 HAVING count(*) = 1)
SELECT q.name, coalesce(k.known, l.known) AS known FROM q LEFT JOIN k ON upper(q.name) = upper(k.known) LEFT JOIN l ON q.name = l.name""")
def alias_match(spark, d):
    n = table(spark, d, "nation")
    asked = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name")).unionByName(n.filter("n_nationkey % 2 = 1").select(F.concat(F.substring("n_name", 1, 3), F.lit("X")).alias("name")))
    return ingest.alias_match(asked, n.select(F.col("n_name").alias("name")))


@query("SELECT p_partkey, (floor(p_retailprice * 0.35::DOUBLE / 10 + 0.5::DOUBLE) * 10)::BIGINT AS assessed FROM part")
def assessed_value(spark, d):
    return table(spark, d, "part").select("p_partkey", C.assessed(F.col("p_retailprice")).alias("assessed"))


@query("""WITH t AS (SELECT try_cast(CASE o_orderkey % 10 WHEN 0 THEN 'n/a' WHEN 1 THEN '' WHEN 2 THEN '1900-01-01' WHEN 3 THEN '1903-02-0' || (o_orderkey % 9 + 1) WHEN 4 THEN '1970-01-01' WHEN 5 THEN '2001-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS d FROM orders)
SELECT count(d) AS parsed, count(*) - count(d) AS unparsed, strftime(min(d), '%Y-%m-%d') AS first, strftime(max(d), '%Y-%m-%d') AS last, count(*) FILTER (d <= DATE '1900-01-01') AS floor, count(*) FILTER (d > DATE '1900-01-01' AND d < DATE '1911-01-01') AS decade, count(*) FILTER (d = DATE '1970-01-01') AS epoch FROM t""")
def date_profile(spark, d):
    """Order dates as texts, some of them placeholders and some no dates."""
    k = F.col("o_orderkey") % 10
    text = F.when(k == 0, "n/a").when(k == 1, "").when(k == 2, "1900-01-01").when(k == 3, F.concat(F.lit("1903-02-0"), (F.col("o_orderkey") % 9 + 1).cast("string"))).when(k == 4, "1970-01-01").when(k == 5, "2001-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return parcels.date_profile(table(spark, d, "orders").select(text.alias("day")), "day")


@query("SELECT upper(trim(event_type)) AS value, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM events)::DOUBLE, 6) AS pct FROM events WHERE upper(trim(event_type)) IN ('ERROR', 'CLICK', 'UNKNOWN') GROUP BY 1")
def placeholder_values(spark, d):
    return parcels.placeholder_values(table(spark, d, "events"), "event_type", ["ERROR", "CLICK", "UNKNOWN"])


_PAIRS = [(a, b) for a in ("l_quantity", "l_discount", "l_tax") for b in ("l_quantity", "l_discount", "l_tax") if a != b]


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({b} / nullif({a}, 0), 6) AS r FROM lineitem" for a, b in _PAIRS) + """),
k AS (SELECT a, b, r, row_number() OVER (PARTITION BY a, b ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY a, b) AS n FROM p WHERE r IS NOT NULL)
SELECT a, b, r AS upper_median, CASE WHEN r BETWEEN 0.995 AND 1.001 THEN 'same' WHEN r BETWEEN 0.34 AND 0.36 THEN 'assessed' ELSE 'other' END AS kind FROM k WHERE i = n // 2 AND r >= 0.05 AND r < 1.001""")
def ratio_median(spark, d):
    return parcels.ratio_medians(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


_M = "WITH m AS (SELECT vec_id, label, -83 + embedding[1]::DOUBLE AS lon, 40 + embedding[2]::DOUBLE AS lat FROM embeddings) "


def _points(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", (F.lit(-83.0) + F.col("embedding")[0].cast("double")).alias("lon"), (F.lit(40.0) + F.col("embedding")[1].cast("double")).alias("lat"))


@query(_M + """, o AS (SELECT greatest(-83.1 - lon, lon + 82.9, 39.9 - lat, lat - 40.1, 0)::DOUBLE AS d FROM m)
SELECT count(*) AS n, count(*) FILTER (d > 0.05) AS outside, round(max(d), 6) AS worst FROM o""")
def outside_box(spark, d):
    return parcels.outside_box(_points(spark, d), (-83.1, 39.9, -82.9, 40.1), 0.05)


@query("SELECT p_partkey, unnest(CASE WHEN hi > lo AND hi - lo <= 12 THEN range(lo, hi + 1, CASE WHEN (hi - lo) % 2 = 0 THEN 2 ELSE 1 END) ELSE [lo] END)::INTEGER AS number FROM (SELECT p_partkey, p_size AS lo, p_size + (p_partkey % 20 - 3)::INTEGER AS hi FROM part)")
def range_expand(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("lo"), (F.col("p_size") + (F.col("p_partkey") % 20 - 3).cast("int")).alias("hi"))
    return p.select("p_partkey", F.explode(address.expanded_range(F.col("lo"), F.col("hi"))).alias("number"))


@query(_M + """SELECT vec_id FROM (SELECT vec_id, lon - 0.01 AS west, lon + 0.01 AS east, lat - 0.01 AS south, lat + 0.01 AS north FROM m) WHERE west <= -82.9 AND east >= -83.1 AND south <= 40.1 AND north >= 39.9 ORDER BY vec_id LIMIT 3000""")
def bbox_viewport(spark, d):
    p = _points(spark, d).select("vec_id", (F.col("lon") - 0.01).alias("west"), (F.col("lon") + 0.01).alias("east"), (F.col("lat") - 0.01).alias("south"), (F.col("lat") + 0.01).alias("north"))
    return p.filter(spatial.in_box((-83.1, 39.9, -82.9, 40.1))).select("vec_id").orderBy("vec_id").limit(3000)


@query(_M + """, c AS (SELECT zoom, floor((lon + 180) / 360 * (256 * 2.0 ** zoom) / 60)::BIGINT AS cx,
  floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * (256 * 2.0 ** zoom) / 60)::BIGINT AS cy, lat, lon, label FROM m, (SELECT unnest(range(9, 16))::INTEGER AS zoom)),
g AS (SELECT zoom, cx, cy, label, count(*) AS n, sum(lat) AS slat, sum(lon) AS slon FROM c GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY zoom, cx, cy ORDER BY n DESC, label) AS r FROM g)
SELECT zoom, cx, cy, round(sum(slat) / sum(n), 6) AS lat, round(sum(slon) / sum(n), 6) AS lon, sum(n)::BIGINT AS n, max(label) FILTER (r = 1) AS dominant FROM k GROUP BY 1, 2, 3""")
def cluster_pyramid(spark, d):
    return spatial.cluster_pyramid(_points(spark, d), "label")


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), i AS (SELECT user_id, d, d - (row_number() OVER (PARTITION BY user_id ORDER BY d))::INTEGER AS g FROM d)
SELECT user_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM i GROUP BY user_id, g""")
def gaps_islands(spark, d):
    return ranking.runs_of_days(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["user_id"], "day")


@query("""SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS href
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)""")
def link_extract(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("h"))
    return links.select("page_id", C.decoded_entities(F.col("h")).alias("href"))


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) WHERE k % greatest(1, n // 300) = 0 AND k < greatest(1, n // 300) * 300""")
def spread_sample(spark, d):
    return ranking.spread_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 300)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)")
def missing_ids(spark, d):
    seen = table(spark, d, "lineitem").filter("l_quantity > 20")
    o = table(spark, d, "orders")
    return o.join(seen, o.o_orderkey == seen.l_orderkey, "left_anti").select("o_orderkey")
