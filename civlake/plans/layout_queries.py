"""Registered queries of county ballot layouts: orders stand for rows of ballot lists, customers for voters."""

from __future__ import annotations

from pyspark.sql import functions as F

from civlake.plans.adapter import table
from civlake.plans.registry import query
from civlake.sources import layouts

#: An order as a ballot row: voter k, seq, asked and back (dates, back null for half), status F, O or P, kind 0 to 6.
_B = """WITH b AS (SELECT o_orderkey AS seq, o_custkey AS k, o_orderdate::DATE AS asked, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate::DATE + (o_orderkey % 3)::INTEGER END AS back, o_orderstatus AS s, o_orderkey % 7 AS kind, o_custkey % 4 AS who FROM orders),
d AS (SELECT *, strftime(asked, '%-m/%-d/%Y') AS a, coalesce(strftime(back, '%-m/%-d/%Y'), '') AS r FROM b) """
_NAMES = "['Ann B. Lee', 'Lee, Ann B', 'Bo Cole Jr.', 'Cher']"
_LAST, _FIRST = "['LEE', 'LEE', 'COLE', 'CHER'][who + 1]", "['ANN', 'ANN', 'BO', ''][who + 1]"


def _rows(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    back = F.when(F.col("o_orderstatus") != "O", F.date_add(day, (k % 3).cast("int")))
    name = F.element_at(F.array(*map(F.lit, ("Ann B. Lee", "Lee, Ann B", "Bo Cole Jr.", "Cher"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(k.alias("seq"), F.col("o_custkey").alias("k"), day.alias("asked"), back.alias("back"), F.col("o_orderstatus").alias("s"), (k % 7).alias("kind"), name.alias("who"))


def _us(c, pattern: str = "M/d/yyyy"):
    return F.coalesce(F.date_format(c, pattern), F.lit(""))


def _pick(values, by="kind"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _lit(*names):
    return {n: F.lit("") for n in names}


_OUT = ("CNTYIDNUM", "LASTN", "FIRSTN", "AVSENTDATE", "AVRECVDATE", "AVRECVMETH", "AVAPPTYPE", "AVBALSTAT", "CITY", "STATE", "ZIPCODE")


def _vault(spark, d):
    r = _rows(spark, d)
    same = {"LAST NAME": F.lit("LEE"), "FIRST NAME": F.lit("ANN"), "PARTY": F.lit("Republican"), "VOTER ID": F.lpad(F.col("k").cast("string"), 9, "0"), "ADDRESS": F.lit("1 Oak St"), "CITY": F.lit("Lima"), "STATE": F.lit("OH"), "ZIP": F.lit("45801-1234"), "PRECINCT": F.lit("FAIR2WD3.0"), "REQUESTED DATE": _us("asked"), "BALLOT RETURNED": F.concat(_us("back"), F.when(F.col("back").isNotNull(), " 12:00:00 AM").otherwise(""))}
    cols = lambda df, extra: df.select(*[c.alias(n) for n, c in {**same, **extra}.items()])
    inside = cols(r.filter("kind = 0"), {"BALLOT ISSUED": _us("asked")})
    mail = cols(r.filter("kind > 0"), {"BALLOT MAILED": _us("asked"), "TYPE": _pick(("Absentee Ballot", "FPCA IN COUNTRY", "OTHER")), "CHALLENGE CODE": _pick(("VAL", "NOSIG", ""), "seq")})
    return layouts.election_vault(inside, mail)


@query(_B + """SELECT k::VARCHAR AS "CNTYIDNUM", 'REP' AS "PARTYAFFIL", a AS "AVSENTDATE", r AS "AVRECVDATE", CASE WHEN r = '' THEN 'NOT RECEIVED' WHEN kind = 0 THEN 'IN OFFICE' ELSE 'MAIL' END AS "AVRECVMETH",
  CASE WHEN kind = 0 THEN 'IN OFFICE' ELSE ['MAIL', 'MILITARY', 'OTHER'][kind % 3 + 1] END AS "AVAPPTYPE", CASE WHEN r = '' THEN '' WHEN kind = 0 THEN 'VALID' ELSE ['VALID', 'NO VOTER SIGNATURE', ''][seq % 3 + 1] END AS "AVBALSTAT", 'FAIR2WD3' AS "PRECNAME", CASE WHEN kind = 0 THEN 'in-person' ELSE 'mail' END AS "SOURCE" FROM d""")
def layout_vault(spark, d):
    return _vault(spark, d).select("CNTYIDNUM", "PARTYAFFIL", "AVSENTDATE", "AVRECVDATE", "AVRECVMETH", "AVAPPTYPE", "AVBALSTAT", "PRECNAME", "SOURCE")


@query(_B + "SELECT count(*) AS both FROM (SELECT k FROM d GROUP BY 1 HAVING count(*) FILTER (kind = 0) > 0 AND count(*) FILTER (kind > 0) > 0)")
def layout_vault_both(spark, d):
    return layouts.in_both_lists(_vault(spark, d))


@query(_B + """SELECT k::VARCHAR AS "CNTYIDNUM", CASE WHEN kind = 0 THEN r ELSE a END AS "AVSENTDATE", r AS "AVRECVDATE", CASE WHEN r = '' THEN 'NOT RECEIVED' WHEN kind IN (0, 3) THEN 'IN OFFICE' ELSE 'MAIL' END AS "AVRECVMETH", CASE WHEN kind IN (0, 3) THEN 'IN OFFICE' ELSE 'MAIL' END AS "AVAPPTYPE",
  CASE WHEN r = '' THEN '' WHEN kind = 0 THEN 'VALID' ELSE 'NO ID' END AS "AVBALSTAT", 'Apt 2 Box 9' AS "AVADDR2" FROM d""")
def layout_vault_long(spark, d):
    r = _rows(spark, d)
    same = {**_lit("LAST NAME", "FIRST NAME", "MIDDLE NAME", "SUFFIX NAME", "PARTY", "ADDRESS LINE 1", "CITY", "STATE", "ZIP", "PRECINCT_NAME"), "LOCAL_ID": F.col("k").cast("string"), "ADDRESS LINE 2": F.lit("Apt 2"), "ADDRESS LINE 3": F.lit(" "), "ADDRESS LINE 4": F.lit("Box 9")}
    cols = lambda df, extra: df.select(*[c.alias(n) for n, c in {**same, **extra}.items()])
    inside = cols(r.filter("kind = 0"), {"DATE VOTED": _us("back")})
    mail = cols(r.filter("kind > 0"), {"DATE MAILED": _us("asked", "M/d/yyyy h:mm:ss a"), "DATE RETURNED": _us("back"), "MAILED": F.when(F.col("kind") == 3, "I").otherwise("M"), "VAL/REJECTED": F.lit("noid"), "DATE_REQUESTED": _us("asked")})
    return layouts.election_vault_long(inside, mail).select("CNTYIDNUM", "AVSENTDATE", "AVRECVDATE", "AVRECVMETH", "AVAPPTYPE", "AVBALSTAT", "AVADDR2")


@query(_B + f""", m AS (SELECT k, a, who FROM d WHERE kind < 4 QUALIFY row_number() OVER (PARTITION BY k ORDER BY asked DESC, seq) = 1), t AS (SELECT k, a, r, kind, who FROM d WHERE kind >= 3 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1),
x AS (SELECT coalesce(m.k, t.k) AS k, coalesce(m.who, t.who) AS who, m.k IS NOT NULL AS asked, coalesce(m.a, t.a) AS a, coalesce(r, '') AS r, CASE kind WHEN 3 THEN 'IN OFFICE' WHEN 4 THEN 'UOCAVA EMAIL' WHEN 5 THEN 'HAND CARRY' WHEN 6 THEN 'ZZ|ZZ' ELSE 'MAIL' END AS app FROM m FULL JOIN t ON m.k = t.k)
SELECT k::VARCHAR AS "CNTYIDNUM", {_LAST} AS "LASTN", {_FIRST} AS "FIRSTN", a AS "AVSENTDATE", r AS "AVRECVDATE", CASE WHEN r = '' THEN 'NOT RECEIVED' WHEN app = 'IN OFFICE' THEN 'CAST IN PERSON' WHEN app = 'HAND CARRY' THEN 'O T C/ PERSONAL DELIVERY' ELSE 'MAILED' END AS "AVRECVMETH", app AS "AVAPPTYPE", CASE WHEN r = '' THEN '' ELSE 'VALID' END AS "AVBALSTAT",
  CASE WHEN asked THEN 'LIMA' ELSE 'BAY VILLAGE' END AS "CITY", 'OH' AS "STATE", '44140' AS "ZIPCODE" FROM x""")
def layout_requests_returns(spark, d):
    r = _rows(spark, d)
    same = {"Voter ID": F.col("k").cast("string"), "seq": F.col("seq"), "Name": F.col("who"), "Party": F.lit("NOPTY"), "Precinct": F.lit("P")}
    cols = lambda df, extra: df.select(*[c.alias(n) for n, c in {**same, **extra}.items()])
    mailing = cols(r.filter("kind < 4"), {"Date Entered": _us("asked", "M/d/yyyy HH:mm"), "Address": F.lit("1 Oak"), "Apt Number": F.lit(""), "City": F.lit("Lima"), "State": F.lit("Ohio"), "Zip": F.lit("44140")})
    codes = [("", ""), ("", ""), ("", ""), ("EV", "x"), ("MIL", "EML"), ("NF", "HAND"), ("ZZ", "ZZ")]
    tracking = cols(r.filter("kind >= 3"), {"Returned": _us("back"), "Issued": _us("asked"), "Category": _pick([c[0] for c in codes]), "Org": _pick([c[1] for c in codes]), "Mailed To": F.lit("2 Elm"), "City State Zip": F.lit("Bay Village Oh 44140")})
    return layouts.requests_and_returns(mailing, tracking).select(*_OUT)


@query(_B + """, m AS (SELECT k, a FROM d WHERE kind < 4 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1), t AS (SELECT k, r, kind FROM d WHERE kind >= 4 QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1),
x AS (SELECT coalesce(m.k, t.k) AS k, coalesce(a, r) AS a, coalesce(r, '') AS r, coalesce(kind, 0) AS kind FROM m FULL JOIN t ON m.k = t.k)
SELECT (k + 1000000)::VARCHAR AS "CNTYIDNUM", a AS "AVSENTDATE", r AS "AVRECVDATE", CASE WHEN r = '' THEN 'NOT RECEIVED' WHEN kind = 5 THEN 'CAST IN PERSON' ELSE 'MAILED' END AS "AVRECVMETH", CASE WHEN kind = 5 THEN 'IN OFFICE' ELSE 'MAIL' END AS "AVAPPTYPE", CASE WHEN r = '' THEN '' ELSE 'VALID' END AS "AVBALSTAT" FROM x WHERE k % 5 > 0""")
def layout_sheets_returns(spark, d):
    r = _rows(spark, d).withColumn("id", F.concat(F.lit("oh"), F.col("k").cast("string"))).withColumn("entered", _us("asked")).withColumn("returned", _us("back"))
    r = r.withColumn("type", F.when(F.col("kind") == 5, "OFF").otherwise("M")).withColumns(_lit("last", "first", "party", "cat", "street", "csz", "precinct"))
    ids = table(spark, d, "customer").filter("c_custkey % 5 > 0").select(F.concat(F.lit("OH"), F.col("c_custkey").cast("string")).alias("sos"), (F.col("c_custkey") + 1000000).alias("county"))
    return layouts.sheets_and_returns([r.filter("kind < 2"), r.filter("kind in (2, 3)")], r.filter("kind >= 4"), ids).select("CNTYIDNUM", "AVSENTDATE", "AVRECVDATE", "AVRECVMETH", "AVAPPTYPE", "AVBALSTAT")


@query(_B + """, x AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY back IS NOT NULL DESC, coalesce(back, asked) DESC, kind DESC, seq DESC) = 1), y AS (SELECT *, CASE WHEN kind = 1 THEN 'UOCAVA MAIL' WHEN kind = 2 THEN 'HAND CARRY' WHEN back = asked THEN 'IN OFFICE' ELSE 'MAIL' END AS app FROM x)
SELECT k::VARCHAR AS "CNTYIDNUM", a AS "AVSENTDATE", r AS "AVRECVDATE", CASE WHEN r = '' THEN 'NOT RECEIVED' WHEN app = 'IN OFFICE' THEN 'CAST IN PERSON' ELSE 'MAILED' END AS "AVRECVMETH", app AS "AVAPPTYPE", CASE WHEN kind = 1 THEN 'CANADA' ELSE '' END AS "COUNTRY", CASE WHEN kind = 1 THEN 'APT' WHEN kind = 3 THEN 'APT LINE 3' ELSE 'APT' END AS "AVADDR2", 'day' || kind AS "SOURCE" FROM y""")
def layout_daily_files(spark, d):
    """Files list the latest order first."""
    r = _rows(spark, d)
    serial = lambda c: F.coalesce(F.datediff(F.col(c), F.lit("1899-12-30").cast("date")).cast("string"), F.lit(""))
    cells = {**_lit(*[f"c{k}" for k in range(18)]), "c1": F.col("k").cast("string"), "c7": F.lit("Apt"), "c8": F.when(F.col("kind") == 1, "Canada").when(F.col("kind") == 3, "Line 3").otherwise(""), "c15": serial("asked"), "c16": serial("back"), "c17": _pick(("", "Uocava", "carry out", "", "", "", ""))}
    return layouts.daily_files(r.select((-F.col("seq")).alias("seq"), F.concat(F.lit("day"), F.col("kind").cast("string")).alias("file"), *[c.alias(n) for n, c in cells.items()])).select("CNTYIDNUM", "AVSENTDATE", "AVRECVDATE", "AVRECVMETH", "AVAPPTYPE", "COUNTRY", "AVADDR2", "SOURCE")


@query(_B + """, x AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY back IS NOT NULL DESC, CASE WHEN back IS NULL THEN asked END DESC, seq) = 1),
y AS (SELECT *, ['IN OFFICE', 'HAND CARRY', 'MAIL', 'NURSING HOME', 'UOCAVA EMAIL', 'MILITARY', 'Q|Q'][kind + 1] AS app FROM x)
SELECT k::VARCHAR AS "CNTYIDNUM", a AS "AVSENTDATE", r AS "AVRECVDATE", CASE WHEN r = '' THEN 'NOT RECEIVED' WHEN kind = 0 THEN 'CAST IN PERSON' WHEN kind = 1 THEN 'O T C/ PERSONAL DELIVERY' ELSE 'MAILED' END AS "AVRECVMETH", app AS "AVAPPTYPE", CASE WHEN r = '' THEN '' WHEN kind = 2 THEN 'NO ID' ELSE 'VALID' END AS "AVBALSTAT", CASE WHEN kind = 5 THEN 'PERU' ELSE '' END AS "COUNTRY" FROM y""")
def layout_returned_mailed(spark, d):
    r = _rows(spark, d)
    cells = {
        **_lit("name_last", "name_first", "Party", "Mail_Street", "Mail_City", "Mail_State", "Mail_Zip", "Consolidation_Name"), "voter_id": F.col("k").cast("string"), "date_entered": _us("asked", "M/d/yyyy HH:mm"), "Date_Returned": _us("back", "MM/dd/yyyy"),
        "Category": _pick(("TSX", "NF", "NF", "NH", "CO", "AF", "Q")), "Source": _pick(("x", "HAND", "MAIL", "x", "EMAIL", "MAIL", "Q")), "Challenged": F.when(F.col("kind") == 2, "NO ID").otherwise(""), "Mail_Country": _pick(("USA", "", "us", "", "", "Peru", "")),
    }
    return layouts.returned_then_mailed(r.select("seq", *[c.alias(n) for n, c in cells.items()])).select("CNTYIDNUM", "AVSENTDATE", "AVRECVDATE", "AVRECVMETH", "AVAPPTYPE", "AVBALSTAT", "COUNTRY")


@query(_B + """, x AS (SELECT *, coalesce(back = asked, false) AS same FROM d) SELECT k::VARCHAR AS "CNTYIDNUM", a AS "AVSENTDATE", r AS "AVRECVDATE", CASE WHEN r = '' THEN 'NOT RECEIVED' WHEN same THEN 'IN OFFICE' ELSE 'MAIL' END AS "AVRECVMETH", CASE WHEN same THEN 'IN OFFICE' ELSE 'MAIL' END AS "AVAPPTYPE",
  'ANN' AS "FIRSTN", 'MARY B' AS "MIDDLEN", CASE WHEN kind = 0 THEN 'LIMA' ELSE 'NEW LIMA' END AS "CITY", CASE WHEN kind = 0 THEN '' ELSE 'OH' END AS "STATE", CASE WHEN same THEN 'in-person' ELSE 'mail' END AS "SOURCE" FROM x""")
def layout_same_day(spark, d):
    r = _rows(spark, d)
    cells = {**_lit("LASTNAME", "SUFFIXNAME", "VOTERPARTY", "ADDRESS1", "ADDRESS2", "ADDRESS3", "ZIP", "PRECINCTNAME"), "VOTERID": F.lpad(F.col("k").cast("string"), 8, "0"), "FIRSTNAME": F.lit("ANN MARY B"), "CITYSTATE": F.when(F.col("kind") == 0, "LIMA").otherwise("NEW LIMA OH"), "REQUEST APPLICATION DATE": _us("asked", "yyyy-MM-dd"), "RETURN BALLOT DATE": _us("back", "yyyy-MM-dd")}
    return layouts.same_day_in_person(r.select(*[c.alias(n) for n, c in cells.items()])).select("CNTYIDNUM", "AVSENTDATE", "AVRECVDATE", "AVRECVMETH", "AVAPPTYPE", "FIRSTN", "MIDDLEN", "CITY", "STATE", "SOURCE")


@query(_B + f""", x AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY back IS NOT NULL DESC, asked DESC, seq) = 1) SELECT k::VARCHAR AS "CNTYIDNUM", {_LAST} AS "LASTN", {_FIRST} AS "FIRSTN", a AS "AVSENTDATE", r AS "AVRECVDATE",
  CASE WHEN r = '' THEN 'NOT RECEIVED' WHEN kind = 0 THEN 'CAST IN PERSON' ELSE 'MAILED' END AS "AVRECVMETH", CASE kind WHEN 0 THEN 'IN OFFICE' WHEN 1 THEN 'QQ' ELSE 'MAIL' END AS "AVAPPTYPE", CASE WHEN r = '' THEN '' WHEN kind = 3 THEN 'NO ID' ELSE 'VALID' END AS "AVBALSTAT",
  CASE WHEN kind = 4 THEN 'RENO' ELSE 'BAY VILLAGE' END AS "CITY", CASE WHEN kind = 4 THEN 'NV' ELSE 'OH' END AS "STATE", CASE WHEN kind = 4 THEN '89501' ELSE '44140' END AS "ZIPCODE", CASE WHEN kind = 5 THEN 'C/O KIM' ELSE '' END AS "AVADDR2" FROM x""")
def layout_reissued(spark, d):
    r = _rows(spark, d)
    away = lambda v: F.when(F.col("kind") == 4, v).otherwise("")
    cells = {
        **_lit("PARTY", "PRECINCT", "MAILCOUNTRY"), "VOTER ID": F.col("k").cast("string"), "VOTER NAME": F.col("who"), "ADDRESS1": F.lit("1 Oak"), "ADDRESS2": F.lit("Bay Village Oh 44140"), "CATEGORY": _pick(("IP", "QQ", "M", "M", "M", "M", "M")), "CHALLENGED": F.when(F.col("kind") == 3, "No ID").otherwise(""),
        "DATEISSUED": _us("asked"), "DATERETURNED": _us("back"), "MAILSTREET": away("9 Elm"), "MAILCITY": away("Reno"), "MAILSTATE": away("Nv"), "MAILZIP": away("89501-1111"), "CAREOF": F.when(F.col("kind") == 5, "Kim").otherwise(""),
    }
    return layouts.reissued_list(r.select("seq", *[c.alias(n) for n, c in cells.items()]), {"IP": "IN OFFICE", "M": "MAIL"}).select(*_OUT, "AVADDR2")


@query(_B + """, x AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY back IS NOT NULL DESC, asked DESC, seq) = 1) SELECT k::VARCHAR AS "CNTYIDNUM", a AS "AVSENTDATE", r AS "AVRECVDATE", CASE WHEN r = '' THEN 'NOT RECEIVED' WHEN kind = 1 THEN 'O T C/ PERSONAL DELIVERY' ELSE 'MAILED' END AS "AVRECVMETH",
  CASE WHEN r = '' THEN '' WHEN kind = 2 THEN 'NO VOTER SIGNATURE' WHEN kind = 3 THEN 'ODD' ELSE 'VALID' END AS "AVBALSTAT", CASE WHEN kind = 4 THEN 'RENO' ELSE 'LIMA' END AS "CITY", CASE WHEN kind = 5 THEN 'DEM' ELSE '' END AS "PARTYAFFIL" FROM x""")
def layout_validity(spark, d):
    r = _rows(spark, d)
    away = lambda v: F.when(F.col("kind") == 4, v).otherwise("")
    cells = {
        **_lit("LASTNAME", "FIRSTNAME", "PRECINCTLABEL", "DATEREQUESTED", "ABSENTEEREQUESTSTATUS", "BALLOTMAILEDSTATE", "BALLOTMAILEDZIP5"), "VOTERID": F.col("k").cast("string"), "PARTYDESC": F.when(F.col("kind") == 5, "Democratic").otherwise("Purple"), "BALLOTMAILEDADDR1": away("1 Elm"), "BALLOTMAILEDCITY": away("Reno"),
        "RESADDR1": F.lit("1 Oak"), "RESCITYDESC": F.lit("Lima"), "RESSTATE": F.lit("OH"), "RESZIP5": F.lit("45801"), "DATEMAILED": _us("asked", "yyyy-MM-dd"), "DATERETURNED": _us("back", "yyyy-MM-dd"), "VALIDITYCODE": _pick(("", "VAL-P", "NOSIG-M", "ODD", "VAL-M", "VAL", "VAL-Z")),
    }
    return layouts.validity_coded(r.select("seq", *[c.alias(n) for n, c in cells.items()])).select("CNTYIDNUM", "AVSENTDATE", "AVRECVDATE", "AVRECVMETH", "AVBALSTAT", "CITY", "PARTYAFFIL")


@query(_B + """, x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY asked DESC, seq DESC) AS n, arg_max(back, seq) FILTER (back IS NOT NULL) OVER (PARTITION BY k) AS ever FROM d)
SELECT k AS id, ['Ann B. Lee', 'Lee, Ann B', 'Bo Cole Jr.', 'Cher'][who + 1] AS name, CASE WHEN kind = 2 THEN 'C/O KIM' ELSE '' END AS care_of, '--' AS party, 'EV' AS category, strftime(asked, '%Y-%m-%d') AS issued, coalesce(strftime(ever, '%Y-%m-%d'), '') AS returned FROM x WHERE n = 1""")
def layout_positional(spark, d):
    care = F.col("kind") == 2
    cells = [F.lit("")] * 9 + [F.when(care, F.col("who")).otherwise(""), F.when(care, "C/O KIM").otherwise(F.col("who"))] + [F.lit("")] * 5 + [F.lit("ev"), _us("asked"), _us("back"), F.col("k").cast("string"), F.lit("")]
    rows = _rows(spark, d).select("seq", F.array(*cells).alias("cells"))
    return layouts.positional_ballots(rows).select("id", "name", "care_of", "party", "category", "issued", "returned")


@query(_B + """, x AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1), y AS (SELECT *, r <> '' AND kind NOT IN (1, 2) AND kind <> 3 AS b FROM x)
SELECT k AS id, 'ANN B LEE JR' AS name, 'JR ANN B' AS first_name, '1 OAK # 2' AS mail_to, 'LIMA, OH 45801' AS csz, ['D', 'R', '--'][kind % 3 + 1] AS party, ['A', 'EV', 'OTHER'][kind % 3 + 1] AS category, strftime(asked, '%Y-%m-%d') AS issued, CASE WHEN b THEN strftime(back, '%Y-%m-%d') ELSE '' END AS returned, CASE WHEN b AND kind = 4 THEN 'NO ID' ELSE '' END AS issue FROM y""")
def platform_returned(spark, d):
    r = _rows(spark, d)
    cells = {
        **_lit("COUNTRY", "PRECNAME", "AVAPPDATE", "SOURCE"), "LASTN": F.lit("LEE"), "FIRSTN": F.lit("ANN"), "MIDDLEN": F.lit(" B "), "SUFFIXN": F.lit("JR"), "PARTYAFFIL": _pick(("dem", "REP", "XYZ")), "CNTYIDNUM": F.col("k").cast("string"), "AVADDR1": F.lit("1 OAK"), "AVADDR2": F.lit("2"), "CITY": F.lit("LIMA"), "STATE": F.lit("oh"),
        "ZIPCODE": F.lit("45801-1"), "AVSENTDATE": _us("asked"), "AVRECVDATE": _us("back"), "AVRECVMETH": _pick(("Mail", "Undeliverable", "", "MAIL", "MAIL", "MAIL", "MAIL")), "AVAPPTYPE": _pick(("mail", "IN OFFICE", "other")), "AVBALSTAT": _pick(("", "", "", "REFUSED TO VOTE", "No ID", "VALID", "")),
    }
    return layouts.platform_ballots(r.select("seq", *[c.alias(n) for n, c in cells.items()])).select("id", "name", "first_name", "mail_to", "csz", "party", "category", "issued", "returned", "issue")


@query("""WITH r AS (SELECT c_custkey AS id, 'LEE' || (c_custkey % 300) AS last, 'ANN' AS first, (c_custkey % 900)::VARCHAR AS house, '4400' || (c_custkey % 9) AS zip, 'W' || (c_custkey % 5) AS precinct FROM customer),
b AS (SELECT o_orderkey AS av, 'LEE' || (o_custkey % 400) AS last, (o_custkey % 900)::VARCHAR AS house, '4400' || (o_custkey % 9) AS zip, 'C' || (o_custkey % 5) AS code, strftime(o_orderdate, '%Y-%m-%d') AS issued FROM orders),
h AS (SELECT last, house, min(id) AS a FROM r GROUP BY 1, 2 HAVING count(*) = 1), n AS (SELECT last, min(id) AS b FROM r GROUP BY 1 HAVING count(*) = 1), z AS (SELECT last, zip, min(id) AS c FROM r GROUP BY 1, 2 HAVING count(*) = 1),
m AS (SELECT b.*, coalesce(a, n.b, c) AS v, a FROM b LEFT JOIN h USING (last, house) LEFT JOIN n USING (last) LEFT JOIN z USING (last, zip)), p AS (SELECT m.*, r.precinct AS held FROM m LEFT JOIN r ON v = r.id),
u AS (SELECT code, held AS usual FROM (SELECT code, held, count(*) AS c, min(av) AS f FROM p WHERE held IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY code ORDER BY c DESC, f) = 1)
SELECT coalesce(v, av + 9000000) AS voter_id, CASE WHEN a IS NOT NULL THEN 'house' WHEN v IS NOT NULL THEN 'name' ELSE 'new' END AS how, coalesce(held, usual, code) AS precinct, 'EV' AS category, issued FROM p LEFT JOIN u USING (code)""")
def layout_sheet(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    cells = F.array(F.lit("EVOFF"), F.lit("x"), _us("o_orderdate"), text(F.col("o_orderkey")), F.lit(""), F.concat(F.lit("Lee"), text(k % 400), F.lit(", Ann B.")), F.concat(text(k % 900), F.lit(" Oak")), F.concat(F.lit("LIMA OH 4400"), text(k % 9)), F.concat(F.lit("C"), text(k % 5)))
    head = ["Category/Org", "", "Issued", "AV  ID", "Returned", "Name", "Mailed To", "City", "Precinct"]
    sheet = o.select((F.col("o_orderkey") + 10).alias("seq"), cells.alias("cells")).unionByName(spark.createDataFrame([(0, ["Report of"] + [""] * 8), (1, head)], "seq bigint, cells array<string>"))
    c, i = table(spark, d, "customer"), F.col("c_custkey")
    roll = c.select(i.alias("id"), F.concat(F.lit("LEE"), text(i % 300)).alias("last"), F.lit("ANN").alias("first"), text(i % 900).alias("house"), F.concat(F.lit("4400"), text(i % 9)).alias("zip"), F.concat(F.lit("W"), text(i % 5)).alias("precinct"))
    return layouts.sheet_ballots(sheet, roll).select("voter_id", "how", "precinct", "category", "issued")


@query("""SELECT c_custkey AS id, 'LEE' AS last, 'ANN B' AS first, 'LIMA' AS city, '45801' AS zip, '2024-03-01' AS registered, CASE WHEN c_custkey % 2 = 0 THEN '--' ELSE 'D' END AS party FROM customer WHERE c_custkey % 10 > 0""")
def layout_spreadsheet(spark, d):
    k = F.col("c_custkey")
    cells = F.array(F.when(k % 10 == 0, "Total").otherwise(k.cast("string")), F.lit(" LEE,  ANN B "), F.lit("P"), F.lit("1 OAK"), F.lit("LIMA, OH 45801-2"), F.when(k % 3 == 0, "45352").otherwise("3/1/2024"), F.when(k % 2 == 0, "").otherwise("D"))
    return layouts.spreadsheet_roll(table(spark, d, "customer").select(k.alias("seq"), cells.alias("cells"))).select("id", "last", "first", "city", "zip", "registered", "party")
