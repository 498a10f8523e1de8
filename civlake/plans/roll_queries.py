"""Registered queries of searches, selections, rolls, elections and source profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from civlake.functions.columns import parcel_key
from civlake.operators import elections, ingest, parcels, ranking, reports, search
from civlake.operators.selection import Selection, election_options, grouped_topics, voted_in
from civlake.plans.adapter import ELECTIONS, V, table, voters
from civlake.plans.registry import query
from civlake.plans.text_queries import nth

LIVE = ELECTIONS[-1]
_ADDRESSES = ["{} WATERLOO, Randolph Township, OH 44201", "{} MAPLE ST, Kent", "{} ST RT 224", "{} N MAIN ST, Ravenna, OH 44266", "{} MAIN, Ravenna", "{} S MAIN ST"]
_ZIPS = ["44201", "44240", "44202", "44266", "44266", "44266"]


def _parcels(spark, d):
    k = F.col("p_partkey")
    pick = lambda vs: F.element_at(F.array(*map(F.lit, vs)), (k % len(vs) + 1).cast("int"))
    return table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("01-"), F.lpad(k.cast("string"), 6, "0")).alias("number"), F.replace(pick(_ADDRESSES), F.lit("{}"), (k % 50).cast("string")).alias("address"), pick(_ZIPS).alias("zip"), F.col("p_name").alias("owner"))


_P = f"WITH p AS (SELECT p_partkey AS id, '01-' || lpad(p_partkey::VARCHAR, 6, '0') AS number, replace({nth(_ADDRESSES)}, '{{}}', (p_partkey % 50)::VARCHAR) AS address, {nth(_ZIPS)} AS zip, p_name AS owner, p_partkey % 50 AS n, p_partkey % 6 AS kind FROM part) "
#: A query, then which address kinds answer it by word, and the number in front.
_ASKS = [
    ("7 Waterloo Rd, Atwater, OH 44201", "n = 7 AND kind = 0"), ("7 Maple Ave", "false"), ("7 maple street", "n = 7 AND kind = 1"), ("8 State Route 224", "n = 8 AND kind = 2"), ("9 North Main St Ravenna oh 44266", "n = 9 AND kind IN (3, 4)"),
    ("9 main st", "n = 9 AND kind IN (3, 4, 5)"), ("OH", "false"), ("Randolph Township, OH", "kind = 0"), ("01-0000", "false"), ("main, 44266-1234", "kind IN (3, 4, 5)"),
]


@query(_P + " UNION ALL ".join(f"SELECT '{q}' AS asked, id FROM p WHERE contains(lower(number), '{q.lower()}') OR contains(lower(address), '{q.lower()}') OR contains(zip, '{q.lower()}') OR ({rule})" for q, rule in _ASKS))
def address_query_match(spark, d):
    p = _parcels(spark, d)
    asked = F.array(*[F.when(search.parcel_search(q, F.col("number"), F.col("address"), F.col("zip")), F.lit(q)) for q, _ in _ASKS])
    return p.select(F.explode(F.array_compact(asked)).alias("asked"), "id")


@query(_P + "SELECT id FROM p WHERE contains(lower(owner), 'goldenrod') OR contains(lower(address), 'goldenrod')")
def owner_search(spark, d):
    return _parcels(spark, d).filter(search.parcel_search(" GoldenRod ", F.col("number"), F.col("address"), F.col("zip"), F.col("owner"))).select("id")


@query(_P + "SELECT id, number, address FROM p WHERE contains(lower(address), '7 n main') ORDER BY id LIMIT 1")
def find_first(spark, d):
    hit = search.parcel_search("7 N Main", F.col("number"), F.col("address"), F.col("zip"))
    return search.first_match(_parcels(spark, d), hit, [F.asc("id")]).select("id", "number", "address")


@query("""SELECT p_partkey AS id, p_size % 3 <> 0 AND p_size % 4 <> 0 AS mapped, contains(lower(p_type), 'steel') AS wanted, translate(lower('Ç' || p_name || 'ŘÉñ'), 'çřéñ', 'cren') AS plain FROM part""")
def row_predicates(spark, d):
    lat, lon = F.when(F.col("p_size") % 3 != 0, 40.0), F.when(F.col("p_size") % 4 != 0, -83.0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), search.is_mapped(lat, lon).alias("mapped"), search.option_search(F.col("p_type"), " STEEL ").alias("wanted"), search.folded(F.concat(F.lit("Ç"), "p_name", F.lit("ŘÉñ"))).alias("plain"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::INTEGER AS size, 'none' AS remark FROM part")
def projected_fields(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"), "p_name")
    return search.fields_or(p, {"id": 0, "size": 0, "remark": "none", "p_name": ""}, drop=("p_name",))


@query("SELECT 'balance' AS what, max(abs(c_acctbal)) < 200 AS degrees FROM customer UNION ALL SELECT 'size', max(p_size) < 200 FROM part")
def degrees_or_feet(spark, d):
    one = search.in_degrees(table(spark, d, "customer"), "c_acctbal").withColumn("what", F.lit("balance"))
    return one.unionByName(search.in_degrees(table(spark, d, "part"), "p_size").withColumn("what", F.lit("size"))).select("what", "degrees")


_SILENT = "(mask = 0 AND coalesce(ballot, '') <> 'out')"


@query(V + f"SELECT id, mask FROM v WHERE CASE WHEN {_SILENT} THEN true ELSE mask & 36 > 0 END")
def election_any(spark, d):
    return voters(spark, d).filter(voted_in([ELECTIONS[2], ELECTIONS[5]], "any", never=True, live=LIVE)).select("id", "mask")


@query(V + f"SELECT id, mask FROM v WHERE NOT {_SILENT} AND (mask & 68 > 0 OR coalesce(ballot, '') = 'out')")
def election_live(spark, d):
    return voters(spark, d).filter(voted_in([ELECTIONS[2], LIVE], "any", live=LIVE)).select("id", "mask")


@query(V + f"SELECT id, mask FROM v WHERE NOT {_SILENT} AND elig & 36 > 0 AND mask & (elig & 36) = elig & 36")
def election_all(spark, d):
    return voters(spark, d).filter(voted_in([ELECTIONS[2], ELECTIONS[5]], "all", never=True)).select("id", "mask")


@query(V + f"SELECT id FROM v WHERE {_SILENT}")
def election_never(spark, d):
    return voters(spark, d).filter(voted_in([], "all", never=True)).select("id")


@query(V + f"""SELECT label, n FROM (SELECT (1995 + bit)::VARCHAR AS label, count(*) FILTER (mask >> bit & 1 = 1) AS n FROM (SELECT * FROM v WHERE party = 'BUILDING'), (SELECT unnest(range(7))::INTEGER AS bit) GROUP BY bit
UNION ALL SELECT 'none', count(*) FILTER ({_SILENT}) FROM v WHERE party = 'BUILDING')""")
def election_option_counts(spark, d):
    return election_options(voters(spark, d), Selection(facets={"party": ["BUILDING"]}), ELECTIONS)


_DRILLS = {"turnout": "mask & 4 > 0", "cell": "mask & 4 > 0 AND mask & 1 > 0", "exactly 2": "bit_count(mask) = 2", "faithful": "bit_count(elig) > 0 AND bit_count(mask) >= bit_count(elig) * 0.8", "cohort": "year(registered) = 1996", "unplaced": "balance < 0", "day of a party": "ballot = 'returned' AND party = 'BUILDING' AND strftime(returned, '%d') = '01'"}


@query(V + " UNION ALL ".join(f"SELECT '{k}' AS drill, count(*) AS n, min(id) AS least, max(id) AS most FROM v WHERE {rule}" for k, rule in _DRILLS.items()))
def report_drills(spark, d):
    v = voters(spark, d)
    rules = reports.drills(ELECTIONS, ELECTIONS[2], ELECTIONS[0], 2, 1996, F.col("balance") >= 0, "BUILDING")
    return reports.drill_counts(v, {**rules, "day of a party": rules["party back"] & (F.dayofmonth("returned") == 1)}, list(_DRILLS))


@query(V + "SELECT returned::DATE AS day, party, count(*) AS n FROM v WHERE ballot = 'returned' GROUP BY 1, 2")
def early_days_party(spark, d):
    return reports.early_days_party(voters(spark, d))


@query(V + """SELECT count(*) AS voted, count(*) FILTER (mask & 63 = 0) AS first_vote, count(*) FILTER (mask & 16 > 0 AND mask & 4 > 0) AS both_generals, count(*) FILTER (mask & 8 > 0) AS last_primary,
  count(*) FILTER (mask & 63 > 0 AND mask & 16 = 0) AS skipped_baseline FROM v WHERE ballot = 'returned'""")
def early_profile_totals(spark, d):
    return reports.early_profile_totals(voters(spark, d), ELECTIONS, LIVE)


def _flagged(spark, d):
    return voters(spark, d).withColumn("issue", F.when(F.col("id") % 11 == 0, "NO ID").otherwise("")).withColumn("from_file", F.col("id") % 4 != 0)


@query(V + """SELECT count(*) AS issued, count(*) FILTER (ballot = 'returned') AS returned, count(*) FILTER (ballot = 'returned' AND id % 11 = 0) AS flagged, count(*) FILTER (ballot = 'returned' AND returned::DATE > DATE '2001-05-01') AS undated, count(*) FILTER (id % 4 <> 0) AS from_file,
  count(*) FILTER (ballot = 'returned' AND category = '1-URGENT') AS in_person, count(*) FILTER (ballot = 'returned' AND category <> '1-URGENT') AS mail FROM v WHERE ballot IS NOT NULL""")
def early_block(spark, d):
    return reports.early_block(_flagged(spark, d), "2001-05-01", ["1-URGENT"])


@query(V + "SELECT party, count(*) AS n, count(*) FILTER (mask & 4 > 0 AND balance >= 0) AS mapped FROM v GROUP BY 1")
def party_tallies(spark, d):
    v = voters(spark, d).withColumn("placed", F.col("balance") >= 0)
    return reports.tallies(v, v.filter("mask & 4 > 0"))


@query(V + "SELECT id FROM v WHERE mask & 4 > 0 AND balance >= 0")
def map_mask(spark, d):
    v = voters(spark, d)
    return v.filter("balance >= 0").join(v.filter("mask & 4 > 0").select("id"), "id", "left_semi").select("id")


@query(V + """SELECT id, (bit_count(elig & 127))::INTEGER AS n_open, array_to_string(list_transform(range(6, -1, -1), lambda b: (1995 + b) || CASE WHEN mask >> b & 1 = 1 THEN 'v' ELSE '-' END || CASE WHEN elig >> b & 1 = 1 THEN 'e' ELSE '-' END || CASE WHEN b = 6 THEN 'l' ELSE '-' END), ' ') AS history FROM v""")
def voter_history(spark, d):
    flag = lambda c, x: F.when(c, x).otherwise("-")
    h = reports.history_of(voters(spark, d), ELECTIONS)
    return h.select("id", "n_open", F.array_join(F.transform("history", lambda e: F.concat(e["label"], flag(e["voted"], "v"), flag(e["eligible"], "e"), flag(e["live"], "l"))), " ").alias("history"))


@query(V + """SELECT coalesce(category, 'none') AS category, count(*) AS issued, count(*) FILTER (ballot = 'returned') AS returned, count(*) FILTER (id % 2 = 0) AS matched, count(*) FILTER (id % 2 = 1) AS added FROM v GROUP BY 1""")
def ballot_summary(spark, d):
    v = voters(spark, d).withColumn("category", F.coalesce("category", F.lit("none"))).withColumn("matched", F.col("id") % 2 == 0).withColumn("added", F.col("id") % 2 == 1)
    return ingest.ballot_summary(v)


@query(V + """, e AS (SELECT user_id * 7 AS id, count(*) AS ballots FROM events GROUP BY 1)
SELECT coalesce(v.id, e.id) AS id, ballots, ((coalesce(mask, 0) & 63) | CASE WHEN ballots > 70 THEN 64 ELSE 0 END)::INTEGER AS mask, v.id IS NOT NULL AND e.id IS NOT NULL AS matched, v.id IS NULL AS added FROM (SELECT id, mask FROM v) v FULL JOIN (SELECT id, CASE WHEN ballots > 70 THEN ballots END AS ballots FROM e) e ON v.id = e.id""")
def upsert_merge(spark, d):
    roll = voters(spark, d).select("id", "mask")
    ballots = table(spark, d, "events").groupBy((F.col("user_id") * 7).alias("id")).agg(F.count(F.lit(1)).alias("ballots")).withColumn("ballots", F.when(F.col("ballots") > 70, F.col("ballots")))
    once = ingest.upsert(roll, ballots, "id", "ballots", 6)
    return ingest.upsert(once, ballots, "id", "ballots", 6).select("id", "ballots", "mask", "matched", "added")


@query("""SELECT a.p_partkey, b.ps AS p_size FROM (SELECT p_partkey, upper(regexp_replace(p_brand || '-' || p_partkey, '[^A-Za-z0-9]', '', 'g')) AS k FROM part) a
JOIN (SELECT p_size AS ps, upper(regexp_replace(lower(p_brand) || ' ' || (p_partkey + p_size % 2), '[^A-Za-z0-9]', '', 'g')) AS k FROM part) b ON a.k = b.k""")
def parcel_key_join(spark, d):
    p = table(spark, d, "part")
    key = p.select("p_partkey", parcel_key(F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))).alias("k"))
    other = p.select("p_size", parcel_key(F.concat_ws(" ", F.lower("p_brand"), (F.col("p_partkey") + F.col("p_size") % 2).cast("string"))).alias("k"))
    return key.join(other, "k").select("p_partkey", "p_size")


@query("""SELECT x.election, CASE WHEN count(DISTINCT r_name) = 1 AND count(*) = count(r_name) THEN min(r_name) ELSE '' END AS qualifier
FROM (SELECT n_regionkey AS election, n_nationkey AS precinct FROM nation UNION ALL SELECT 10 + n_nationkey % 3, n_nationkey FROM nation UNION ALL SELECT 20, 99 UNION ALL SELECT 20, 1) x
LEFT JOIN nation ON n_nationkey = precinct LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def election_qualifiers(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    scopes = n.select(F.col("n_regionkey").alias("election"), F.col("n_nationkey").alias("precinct")).unionByName(n.select((10 + F.col("n_nationkey") % 3).alias("election"), F.col("n_nationkey").alias("precinct")))
    scopes = scopes.unionByName(spark.createDataFrame([(20, 99), (20, 1)], scopes.schema))
    places = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("precinct"), F.col("r_name").alias("jurisdiction"))
    return elections.qualifiers(scopes, places)


@query("""WITH e AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE day(o_orderdate) IN (3, 17) AND month(o_orderdate) IN (5, 11)), s AS (SELECT day, CASE month(day) WHEN 11 THEN 'general' ELSE 'primary' END AS season, CASE WHEN year(day) % 2 = 0 AND day(day) = 3 THEN 'Town A' ELSE '' END AS qualifier FROM e),
c AS (SELECT *, count(*) FILTER (season = 'primary') OVER (PARTITION BY year(day)) AS primaries FROM s), r AS (SELECT *, season = 'general' OR primaries = 1 AS regular FROM c),
a AS (SELECT *, count(*) OVER (PARTITION BY year(day), season, qualifier, regular) > 1 AS alike FROM r)
SELECT day, concat_ws(' ', CASE WHEN NOT regular THEN strftime(day, '%B') END, CASE WHEN alike THEN day(day) || ' ' || year(day) ELSE year(day)::VARCHAR END, nullif(qualifier, ''), CASE season WHEN 'general' THEN 'General' ELSE 'Primary' END) AS label,
  concat_ws('-', CASE WHEN alike THEN strftime(day, '%Y-%m-%d') ELSE strftime(day, '%Y-%m') END, season, nullif(replace(lower(qualifier), ' ', '-'), '')) AS slug FROM a""")
def election_labels(spark, d):
    day = F.to_date("o_orderdate")
    e = table(spark, d, "orders").select(day.alias("day")).distinct().filter("day(day) in (3, 17) and month(day) in (5, 11)")
    e = e.withColumn("season", F.when(F.month("day") == 11, "general").otherwise("primary")).withColumn("qualifier", F.when((F.year("day") % 2 == 0) & (F.dayofmonth("day") == 3), "Town A").otherwise(""))
    return elections.labels(e).select("day", "label", "slug")


_COLS = {"c_custkey": 0, "c_name": 2, "c_nationkey": 0, "c_acctbal": 0, "c_mktsegment": 2}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '') AS blank, count(*) FILTER (try_cast({c} AS DOUBLE) = 0) AS zero, round(count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '') * 100.0::DOUBLE / count(*), 6) AS blank_pct, round(avg(length({c}::VARCHAR)), 6) + {q} AS avg_bytes, false AS absent FROM customer" for c, q in _COLS.items() if c != "c_acctbal") + " UNION ALL SELECT 'c_phone', count(*), count(*), 0, 100, 2, true FROM customer")
def column_profile(spark, d):
    return parcels.column_profile(table(spark, d, "customer"), [c for c in _COLS if c != "c_acctbal"] + ["c_phone"])


@query("SELECT 'p_retailprice_tot' AS \"column\", count(*) FILTER (p_size % 3 > 0) AS numbers, count(*) AS rows FROM part")
def value_column_candidates(spark, d):
    p = table(spark, d, "part")
    return parcels.value_columns(p.select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("p_retailprice_tot"), F.col("p_name").alias("LAND_USE")))


@query("SELECT * FROM (SELECT p_size::VARCHAR AS value, count(*) AS n, (SELECT count(DISTINCT p_size) FROM part) AS \"distinct\" FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 30) UNION ALL SELECT p_name, 1, 0 FROM part WHERE false")
def gated_distincts(spark, d):
    p = table(spark, d, "part")
    many = parcels.distinct_values(p.withColumn("p_name", F.concat("p_name", F.col("p_partkey").cast("string"))), "p_name")
    return parcels.distinct_values(p, "p_size").unionByName(many)


@query("SELECT count(*) AS rows, count(*) FILTER (p_size % 3 > 0) AS pinned, round(count(*) FILTER (p_size % 3 > 0) * 100.0::DOUBLE / count(*), 6) AS pct FROM part")
def pin_coverage(spark, d):
    return parcels.pin_coverage(table(spark, d, "part").select(F.when(F.col("p_size") % 3 > 0, 40.0).otherwise(0.0).alias("lat"), F.lit(-83.0).alias("lon")))


@query("SELECT event_type AS value, count(*) AS n, (row_number() OVER (ORDER BY event_type))::INTEGER AS place FROM events GROUP BY 1")
def counts_by_name(spark, d):
    return ranking.count_by(table(spark, d, "events"), "event_type", "name")


@query("SELECT user_id AS value, (row_number() OVER (ORDER BY min(event_id)) - 1)::INTEGER AS index FROM events GROUP BY 1")
def first_seen_index(spark, d):
    return ranking.first_seen_index(table(spark, d, "events"), "user_id", "event_id")


@query(V + ", n AS (SELECT id, split_part(name, '#', 2) AS last, party AS first, ballot, strftime(returned, '%Y-%m-%d') AS returned, balance FROM v) SELECT id, balance FROM n ORDER BY balance DESC, last, first, id LIMIT 60 OFFSET 60")
def sorted_voters(spark, d):
    return ranking.page(_named(spark, d), ranking.voters_order(F.col("balance"), True), 2, 60).select("id", "balance")


def _named(spark, d):
    return voters(spark, d).select("id", F.split("name", "#")[1].alias("last"), F.col("party").alias("first"), "ballot", F.date_format("returned", "yyyy-MM-dd").alias("returned"), F.lit(None).cast("string").alias("issued"), "balance")


@query(V + "SELECT id, ballot FROM v ORDER BY CASE ballot WHEN 'returned' THEN 0 WHEN 'out' THEN 1 ELSE 2 END, coalesce(strftime(returned, '%Y-%m-%d'), '') DESC, id LIMIT 100")
def ballot_sorted(spark, d):
    return ranking.page(_named(spark, d), ranking.ballot_order(), 1, 100).select("id", "ballot")


@query("SELECT coalesce(\"group\", '') AS \"group\", (row_number() OVER (ORDER BY min(seq)))::INTEGER AS place, array_to_string(list(id ORDER BY seq), ',') AS ids FROM (SELECT n_nationkey AS seq, n_name AS id, CASE WHEN n_regionkey = 2 THEN NULL ELSE 'R' || n_regionkey END AS \"group\" FROM nation) GROUP BY 1")
def topic_groups(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("id"), F.when(F.col("n_regionkey") != 2, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("group"))
    return grouped_topics(t).withColumn("ids", F.array_join("ids", ","))
