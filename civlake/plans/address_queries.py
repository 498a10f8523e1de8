"""Registered queries of address matching: customers ask, parts are the points, parcels and voters they may find."""

from __future__ import annotations

from pyspark.sql import functions as F

from civlake.operators import address
from civlake.plans.adapter import table
from civlake.plans.registry import query
from civlake.plans.text_queries import nth

#: raw, then words of the street, without quadrant, core, core without its direction, direction at the end
ASKED = [
    ("Main Street", "MAIN ST", "MAIN ST", "MAIN", None, None), ("North High St.", "N HIGH ST", "N HIGH ST", "N HIGH", "HIGH", None), ("Oak Ave NE Apt 4", "OAK AVE NE", "OAK AVE", "OAK", None, "NE"),
    ("Elm Drive", "ELM DR", "ELM DR", "ELM", None, None), ("South Park Road West", "S PARK RD W", "S PARK RD", "S PARK", "PARK", "W"), ("River Lane", "RIVER LN", "RIVER LN", "RIVER", None, None),
    ("Linden Street", "LINDEN ST", "LINDEN ST", "LINDEN", None, None), ("Pine Avenue W", "PINE AVE W", "PINE AVE", "PINE", None, "W"), ("State Route 42", "SR 42", "SR 42", "SR 42", None, None),
]
KNOWN = [
    ("MAIN ST", "MAIN ST", "MAIN ST", "MAIN", None, None), ("HIGH ST", "HIGH ST", "HIGH ST", "HIGH", None, None), ("OAK AVE", "OAK AVE", "OAK AVE", "OAK", None, None), ("ELM CT", "ELM CT", "ELM CT", "ELM", None, None),
    ("S PARK RD E", "S PARK RD E", "S PARK RD", "S PARK", "PARK", "E"), ("RIVERSIDE LN", "RIVERSIDE LN", "RIVERSIDE LN", "RIVERSIDE", None, None), ("N LINDEN ST", "N LINDEN ST", "N LINDEN ST", "N LINDEN", "LINDEN", None),
    ("PINE AVE W", "PINE AVE W", "PINE AVE", "PINE", None, "W"), ("RT 42", "SR 42", "SR 42", "SR 42", None, None), ("N HIGH ST", "N HIGH ST", "N HIGH ST", "N HIGH", "HIGH", None), ("OAK AVE SW", "OAK AVE SW", "OAK AVE", "OAK", None, "SW"),
]


def _choice(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _customers(spark, d):
    k = F.col("c_custkey")
    raw = F.concat_ws(" ", (100 + k * 7 % 40).cast("string"), _choice([r[0] for r in ASKED], "c_custkey"))
    town = F.concat(F.lit("Town"), (k % 5).cast("string"))
    return table(spark, d, "customer").select(k.alias("id"), raw.alias("street"), town.alias("city"), F.concat(F.lit("4400"), (k % 7).cast("string")).alias("zip"), F.when(k % 4 == 0, F.concat(F.lit("Town"), (k % 3).cast("string"), F.lit(" Township"))).alias("muni"))


def _asked(spark, d):
    return address.with_forms(_customers(spark, d))


def _parts(spark, d):
    k = F.col("p_partkey")
    raw = F.concat_ws(" ", (100 + k * 11 % 40).cast("string"), _choice([r[0] for r in KNOWN], "p_partkey"))
    n = (k % 5).cast("string")
    j = F.when(k % 4 == 0, F.concat(F.lit("TOWN"), n, F.lit(" TWP"))).when(k % 4 == 1, F.concat(F.lit("Town"), n)).when(k % 4 == 2, "Unassigned").otherwise("OTHER TOWNSHIP")
    return table(spark, d, "part").select(
        k.alias("seq"), (k % 3).alias("kind"), raw.alias("street"), F.concat(F.lit("TOWN"), n).alias("city"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("4400"), (k % 7).cast("string"))).alias("zip"), (40 + (k % 97) / 20000).alias("lat"), (-83 - (k % 89) / 20000).alias("lon"),
        F.when(k % 3 == 1, j).alias("jurisdiction"), F.when(k % 3 == 1, F.concat(F.lit("P"), k.cast("string"))).alias("parcel_id"), F.when(k % 3 == 2, F.concat(F.lit("W"), (k % 10).cast("string"))).alias("precinct"),
    )


def _known(spark, d):
    return address.with_forms(_parts(spark, d))


def _forms(rows, key: str) -> str:
    return ", ".join(f"{nth([r[k] for r in rows], key)} AS {c}" for k, c in enumerate(("w_full", "quad", "core", "bare", "side")) for k in (k + 1,))


_SHORT = "('N','S','E','W','NE','NW','SE','SW')"
_LED = f"CASE WHEN side IS NOT NULL AND split_part(core, ' ', 1) NOT IN {_SHORT} THEN side || ' ' || core END AS led"
_AP = f"""WITH a AS (SELECT *, {_LED}, list_distinct(list_filter([city, muni], lambda x: x IS NOT NULL)) AS unordered, city AS p1, CASE WHEN muni <> city THEN muni END AS p2 FROM (SELECT c_custkey AS id, (100 + c_custkey * 7 % 40)::VARCHAR AS number, {_forms(ASKED, "c_custkey")},
  'TOWN' || (c_custkey % 5) AS city, '4400' || (c_custkey % 7) AS zip, CASE WHEN c_custkey % 4 = 0 THEN 'TOWN' || (c_custkey % 3) END AS muni FROM customer)),
p AS (SELECT *, {_LED}, regexp_replace(upper(jurisdiction), ' (TWP|TOWNSHIP)$', '') AS place FROM (SELECT p_partkey AS seq, p_partkey % 3 AS kind, (100 + p_partkey * 11 % 40)::VARCHAR AS number, {_forms(KNOWN, "p_partkey")}, 'TOWN' || (p_partkey % 5) AS city,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '4400' || (p_partkey % 7) END AS zip, 40 + (p_partkey % 97) / 20000.0::DOUBLE AS lat, -83 - (p_partkey % 89) / 20000.0::DOUBLE AS lon,
  CASE WHEN p_partkey % 3 = 1 THEN CASE p_partkey % 4 WHEN 0 THEN 'TOWN' || (p_partkey % 5) || ' TWP' WHEN 1 THEN 'Town' || (p_partkey % 5) WHEN 2 THEN 'Unassigned' ELSE 'OTHER TOWNSHIP' END END AS jurisdiction,
  CASE WHEN p_partkey % 3 = 1 THEN 'P' || p_partkey END AS parcel_id, CASE WHEN p_partkey % 3 = 2 THEN 'W' || (p_partkey % 10) END AS precinct FROM part))
"""


def _keys_sql() -> str:
    parts = [(0, "ae", "w_full", "city"), (0, "ae", "w_full", "zip"), (0, "aq", "quad", "city"), (0, "aq", "quad", "zip"), (0, "ac", "core", "city"), (0, "ac", "core", "zip"), (0, "aa", "core", None)]
    parts += [(1, "pc", f, g) for f in ("core", "led") for g in ("zip", "place")] + [(1, "pa", "core", None), (1, "pa", "led", None), (2, "vc", "core", "city"), (2, "vc", "core", "zip"), (2, "va", "core", None)]
    rows = " UNION ALL ".join(f"SELECT '{k}|' || number || '|' || {f}" + (f" || '|' || {g}" if g else "") + f" AS key, seq, kind, lat, lon, city, jurisdiction, place, parcel_id, precinct FROM p WHERE kind = {kind} AND {f} IS NOT NULL" + (f" AND {g} <> ''" if g else "") for kind, k, f, g in parts)
    agreed = ", ".join(f"CASE WHEN min(coalesce({c}, '')) = max(coalesce({c}, '')) THEN min({c}) END AS {c}" for c in ("parcel_id", "jurisdiction", "precinct"))
    return f"""k AS (SELECT key, count(*) AS candidates, arg_min(lat, seq) AS flat, arg_min(lon, seq) AS flon, avg(lat) AS lat, avg(lon) AS lon, greatest(max(lat) - min(lat), max(lon) - min(lon)) AS spread,
  list(CASE WHEN kind = 1 THEN nullif(place, 'UNASSIGNED') ELSE city END) FILTER (CASE WHEN kind = 1 THEN place <> 'UNASSIGNED' ELSE true END) AS towns, bool_or(coalesce(jurisdiction, '') LIKE '%TWP' OR coalesce(jurisdiction, '') LIKE '%TOWNSHIP') AS township, {agreed} FROM ({rows}) GROUP BY 1)"""


def _probes_sql() -> str:
    places, rows = ("p1", "p2"), []
    add = lambda tier, rule, d, kind, form, place=None: rows.append((tier, rule, d, kind, form, place))
    for tier, rule, kind, form in ((1, "first", "ae", "w_full"), (2, "near", "aq", "quad"), (3, "near", "ac", "core"), (3, "near", "ac", "bare")):
        add(tier, rule, "", kind, form, "city")
        add(tier, rule, "", kind, form, "zip")
    add(4, "veto", "", "aa", "core")
    for form in ("led", "core", "bare"):
        for place in ("zip", *places):
            add(5, "near", "", "pc", form, place)
        if form != "led":
            add(5, "veto", "", "pa", form)
    for d in "NSEW":
        form = f"(CASE WHEN split_part(core, ' ', 1) NOT IN {_SHORT} THEN '{d} ' || core END)"
        for tier, kind in ((5, "pc"), (7, "vc")):
            for place in ("zip", *places):
                add(tier, "direction", d, kind, form, place)
    for place in ("city", "zip", *places):
        add(7, "near", "", "vc", "core", place)
    for tier, rule, kind in ((7, "veto", "va"), (5, "last", "pa")):
        for form in ("core", "bare"):
            add(tier, rule, "", kind, form)
    return " UNION ALL ".join(f"SELECT id, unordered, {n} AS priority, {t} AS tier, '{r}' AS rule, '{d}' AS dir, '{k}|' || number || '|' || {f}" + (f" || '|' || {g}" if g else "") + f" AS key FROM a WHERE {f} IS NOT NULL" + (f" AND {g} IS NOT NULL" if g else "") for n, (t, r, d, k, f, g) in enumerate(rows))


_TIERS = _keys_sql() + f""", q AS ({_probes_sql()}),
m AS (SELECT q.*, k.*, spread < 0.004 AS together, len(coalesce(towns, [])) > 0 AND NOT list_has_any(towns, unordered) AS far FROM q JOIN k USING (key)),
h AS (SELECT *, CASE WHEN rule = 'direction' THEN 1 WHEN rule = 'last' THEN 3 WHEN tier = 7 THEN 2 ELSE 0 END AS step FROM m WHERE rule = 'first' OR (together AND (rule IN ('near', 'direction') OR (rule = 'veto' AND NOT far) OR (rule = 'last' AND far AND township)))),
g AS (SELECT *, count(*) OVER (PARTITION BY id, step) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id, step, dir ORDER BY priority) AS r FROM h) WHERE r = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step, priority) AS r2 FROM g WHERE step <> 1 OR n = 1),
tiers AS (SELECT id, tier, round(CASE WHEN rule = 'first' THEN flat ELSE lat END, 6) AS lat, round(CASE WHEN rule = 'first' THEN flon ELSE lon END, 6) AS lon, CASE WHEN rule = 'first' THEN 1 ELSE candidates END AS candidates, parcel_id, jurisdiction, precinct, step FROM b WHERE r2 = 1)"""


@query(_AP + ", " + _TIERS + " SELECT * EXCLUDE (step), step < 2 AS settled FROM tiers")
def match_tiers(spark, d):
    p = _known(spark, d)
    keys = address.key_table(p.filter("kind = 0"), p.filter("kind = 1"), p.filter("kind = 2"))
    return address.match_keys(_asked(spark, d), keys)


_PREFIX = f"""pb AS (SELECT id, unordered, number, zip, 0 AS loose, core, bare FROM a UNION ALL SELECT id, unordered, number, '', 1, core, bare FROM a), pf AS (SELECT *, 0 AS form, core AS want FROM pb UNION ALL SELECT *, 1, bare FROM pb WHERE bare IS NOT NULL),
pn AS (SELECT *, core AS name FROM p WHERE kind < 2 UNION ALL SELECT *, led FROM p WHERE kind = 1 AND led IS NOT NULL),
pm AS (SELECT pf.id, unordered, pn.kind AS source, loose, form, name, lat, lon, CASE WHEN pn.kind = 1 THEN nullif(place, 'UNASSIGNED') END AS town, string_split(name, ' ') AS x, string_split(want, ' ') AS y FROM pf JOIN pn ON pf.number = pn.number AND pf.zip = pn.zip),
pg AS (SELECT id, unordered, source, loose, form, count(*) AS candidates, avg(lat) AS lat, avg(lon) AS lon, greatest(max(lat) - min(lat), max(lon) - min(lon)) AS spread, count(DISTINCT name) AS names, list(town) FILTER (town IS NOT NULL) AS towns FROM pm
  WHERE (len(x) = 1 AND x[1] IN {_SHORT}) = (len(y) = 1 AND y[1] IN {_SHORT}) AND len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: NOT (x[i] = y[i] OR (length(x[i]) >= 4 AND length(y[i]) >= 4 AND (starts_with(x[i], y[i]) OR starts_with(y[i], x[i])))))) = 0 GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY id, source, loose ORDER BY form) AS f FROM pg WHERE spread < 0.004 AND (loose = 0 OR names = 1)),
pr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, loose) AS k FROM pk WHERE f = 1 AND NOT (source = 1 AND loose = 1 AND len(coalesce(towns, [])) > 0 AND NOT list_has_any(towns, unordered))),
prefixed AS (SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, candidates FROM pr WHERE k = 1)"""


@query(_AP + ", " + _PREFIX + " SELECT * FROM prefixed")
def match_prefix(spark, d):
    return address.match_prefix(_asked(spark, d), _known(spark, d).filter("kind < 2").withColumn("source", F.col("kind")))


_NEAREST = """nz AS (SELECT *, zip AS geo FROM p UNION ALL SELECT *, CASE WHEN kind = 1 THEN place ELSE city END FROM p), nc AS (SELECT core || '|' || geo AS street, coalesce(side, '') AS side, number::BIGINT AS n, lat, lon FROM nz WHERE coalesce(geo, '') <> ''),
ns AS (SELECT street, count(DISTINCT side) AS sides FROM nc GROUP BY 1),
nf AS (SELECT id, number::BIGINT AS want, coalesce(side, '') AS own, f, form, unnest([0, 1, 2]) AS gk, unnest([zip, p1, p2]) AS geo FROM (SELECT *, 0 AS f, core AS form FROM a UNION ALL SELECT *, 1, bare FROM a WHERE bare IS NOT NULL)),
nq AS (SELECT id, want, own, f * 10 + gk AS k, form || '|' || geo AS street FROM nf WHERE coalesce(geo, '') <> ''),
nm AS (SELECT id, k, abs(n - want) + CASE WHEN (n - want) % 2 <> 0 THEN 0.5::DOUBLE ELSE 0 END AS distance, lat, lon, side = own AS mine, sides FROM nq JOIN nc USING (street) JOIN ns USING (street)),
nx AS (SELECT *, 1 AS pool FROM nm UNION ALL SELECT *, 0 FROM nm WHERE mine AND sides > 1),
nt AS (SELECT id, k, pool, distance, count(*) AS c, avg(lat) AS lat, avg(lon) AS lon, greatest(max(lat) - min(lat), max(lon) - min(lon)) AS spread, row_number() OVER (PARTITION BY id, k, pool ORDER BY distance) AS r FROM nx WHERE distance <= 12 GROUP BY 1, 2, 3, 4),
nr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, pool) AS j FROM nt WHERE r = 1 AND spread < CASE WHEN distance = 0 THEN 0.02 ELSE 0.012 END),
nearby AS (SELECT id, distance, round(lat, 6) AS lat, round(lon, 6) AS lon, c AS candidates FROM nr WHERE j = 1)"""


@query(_AP + ", " + _NEAREST + " SELECT * FROM nearby")
def match_nearest(spark, d):
    return address.match_nearest(_asked(spark, d), _known(spark, d).withColumn("source", F.col("kind")), 12)


@query(_AP + ", " + _TIERS + ", " + _PREFIX + ", " + _NEAREST + """, voters AS (SELECT number, core, min(lat) AS la, max(lat) AS lb, min(lon) AS oa, max(lon) AS ob, min(precinct) AS own, min(precinct) = max(precinct) AS one FROM p WHERE kind = 2 GROUP BY 1, 2),
f AS (SELECT a.id, a.number, a.core, CASE WHEN t.step < 2 THEN t.tier WHEN x.id IS NOT NULL THEN 6 WHEN t.step = 2 THEN 7 WHEN n.id IS NOT NULL THEN 8 WHEN t.step = 3 THEN 5 END AS tier, coalesce(t.step < 2 OR (x.id IS NULL AND (t.step = 2 OR (n.id IS NULL AND t.step = 3))), false) AS keyed, t.lat AS tlat, t.lon AS tlon, t.candidates AS tc, t.parcel_id, t.jurisdiction, t.precinct,
  x.lat AS xlat, x.lon AS xlon, x.candidates AS xc, n.lat AS nlat, n.lon AS nlon, n.candidates AS nc FROM a LEFT JOIN tiers t USING (id) LEFT JOIN prefixed x USING (id) LEFT JOIN nearby n USING (id)),
r AS (SELECT id, number, core, tier, CASE WHEN keyed THEN tlat WHEN tier = 6 THEN xlat ELSE nlat END AS lat, CASE WHEN keyed THEN tlon WHEN tier = 6 THEN xlon ELSE nlon END AS lon, CASE WHEN keyed THEN tc WHEN tier = 6 THEN xc ELSE nc END AS candidates,
  CASE WHEN keyed THEN parcel_id END AS parcel_id, CASE WHEN keyed THEN jurisdiction END AS jurisdiction, CASE WHEN keyed THEN precinct END AS precinct FROM f WHERE tier IS NOT NULL)
SELECT id, tier::INTEGER AS tier, lat, lon, candidates, parcel_id, jurisdiction, CASE WHEN tier < 8 THEN coalesce(precinct, CASE WHEN one AND greatest(greatest(lb, lat) - least(la, lat), greatest(ob, lon) - least(oa, lon)) < 0.004 THEN own END) END AS precinct FROM r LEFT JOIN voters USING (number, core)""")
def match_address(spark, d):
    p = _parts(spark, d)
    rows = lambda k: p.filter(f"kind = {k}").select("seq", "street", "city", "zip", "lat", "lon", "jurisdiction", "parcel_id", "precinct")
    return address.match_address(_customers(spark, d), rows(0), rows(1), rows(2), 12)


@query(_AP + "SELECT core || '|' || zip AS street, list_sort(list(DISTINCT precinct)) AS precincts FROM p WHERE kind = 2 GROUP BY 1")
def street_precincts(spark, d):
    roll = _known(spark, d).filter("kind = 2")
    return roll.groupBy(F.concat_ws("|", "core", "zip").alias("street")).agg(F.sort_array(F.collect_set("precinct")).alias("precincts"))
