"""How values are shown and linked: money, acres, dates, links, messages and look-ups of codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civlake.functions.columns import clean, parcel_key, rounded

NONE = "—"
MAX_QUERY = 200
#: Ballot categories by application type (fixed values of the ballot layout); what is not listed keeps its own text.
APP_TYPES = {
    "MAIL": "A", "IN OFFICE": "EV", "IN OFFICE OTHER": "EV", "NURSING HOME": "N", "CURBSIDE": "CB", "UOCAVA EMAIL": "UE", "UOCAVA MAIL": "UM", "PROBLEM APP": "PA",
    "HAND CARRY": "HC", "ACCESSIBLE BALLOT": "AB", "JAIL": "JL", "HOSPITAL": "HO", "CIVILIAN OVERSEAS": "CO", "MILITARY": "M", "MILITARY OVERSEAS": "MO",
}
#: One-letter party codes by the ballot layout's (fixed values).
PARTIES = {"DEM": "D", "REP": "R", "LIB": "L", "GRE": "G", "CON": "C", "SOC": "S"}
#: Ballot flags by a vault's challenge codes (fixed values).
CHALLENGES = {
    "VAL": "VALID", "IDNOMATCH": "ID DOES NOT MATCH", "SIGNOMATCH": "SIGNATURE DOES NOT MATCH", "NOSIG": "NO VOTER SIGNATURE", "NHR": "NHR (BOARD CODE)",
    "NOID": "NO ID", "REFUSED": "REFUSED TO VOTE", "NAMECHG": "NAME CHANGE", "SPRET": "SPOILED - RETURNED",
}
#: The ballot layout's application types by a vault's (fixed values).
VAULT_TYPES = {"ABSENTEE BALLOT": "MAIL", "NURSING HOME": "NURSING HOME", "FPCA CIVILIAN OVERSEAS": "CIVILIAN OVERSEAS", "FPCA MILITARY OVERSEAS": "MILITARY OVERSEAS", "FPCA IN COUNTRY": "MILITARY"}
#: Two-letter states (fixed values) that may end an address behind a comma.
STATES = tuple("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split())


def coded(text: Column, codes: dict[str, str]) -> Column:
    """The code of an upper-cased text, or the text itself."""
    key = F.upper(clean(text))
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def finite(text: Column) -> Column:
    """A number, 0 for anything that is none."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def money(amount: Column) -> Column:
    """Whole dollars with thousands separated; a dash for null."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(rounded(amount).cast("double"), 0)), F.lit(NONE))


def acres(area: Column) -> Column:
    """At most two places, four for what is below a hundredth; no trailing zeroes."""
    places = lambda n: F.regexp_replace(F.regexp_replace(F.format_number(area, n), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.concat(F.when((area > 0) & (area < 0.01), places(4)).otherwise(places(2)), F.lit(" ac")), F.lit(NONE))


def or_dash(text: Column) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", NONE).otherwise(text)


def format_date(iso: Column) -> Column:
    """"2024-03-19" as "Mar 19, 2024"; a dash for the empty text, anything else as it is."""
    date = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when(F.coalesce(iso, F.lit("")) == "", NONE).otherwise(F.coalesce(F.date_format(date, "MMM d, yyyy"), iso))


def registered_year(iso: Column) -> Column:
    return F.regexp_extract(iso, r"^\s*(\d{1,4})", 1).try_cast("int")


def cluster_radius(count: Column) -> Column:
    return F.when(count < 10, 16).when(count < 100, 20).when(count < 1000, 26).when(count < 10000, 32).otherwise(38)


def point_radius(zoom: Column) -> Column:
    return F.when(zoom <= 16, 8).when(zoom == 17, 11).when(zoom == 18, 14).otherwise(16)


def same_place(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, apart: float = 1e-5) -> Column:
    return (F.abs(lat_a - lat_b) < apart) & (F.abs(lon_a - lon_b) < apart)


def is_point(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def deep_link(base: Column, query: Column, lat: Column, lon: Column) -> Column:
    """base with ?q=..&lat=..&lon=..; a blank query and a missing or impossible point are left out."""
    q = F.trim(F.coalesce(query, F.lit("")))
    point = F.when(is_point(lat, lon), F.concat(F.lit("lat="), F.format_string("%.6f", lat), F.lit("&lon="), F.format_string("%.6f", lon)))
    search = F.concat_ws("&", F.when(q != "", F.concat(F.lit("q="), F.url_encode(q))), point)
    return F.when(search == "", base).otherwise(F.concat(base, F.lit("?"), search))


def read_deep_link(url: Column) -> Column:
    """q (at most MAX_QUERY characters), lat and lon of a link; null if it has neither a query nor a point."""
    part = lambda k: F.parse_url(url, F.lit("QUERY"), F.lit(k))
    q = F.substring(F.trim(F.coalesce(F.try_url_decode(part("q")), F.lit(""))), 1, MAX_QUERY)
    lat, lon = part("lat").try_cast("double"), part("lon").try_cast("double")
    point = is_point(lat, lon)
    return F.when((q != "") | point, F.struct(q.alias("q"), F.when(point, lat).alias("lat"), F.when(point, lon).alias("lon")))


def retry_address(address: Column, state: str = "OH") -> Column:
    """The address with the state behind it, for a second try; null where it already has a ZIP or a state."""
    a = F.regexp_replace(clean(address), r"[,.\s]+$", "")
    ends = a.rlike(r"\b\d{5}(?:-\d{4})?$") | a.rlike(r"(?i)[,\s](oh|ohio)$") | F.upper(F.regexp_extract(a, r"(?i),\s*([a-z]{2})$", 1)).isin(*STATES)
    return F.when((a != "") & ~ends, F.concat(a, F.lit(f", {state}")))


def geocoder_query(address: Column, most: int = MAX_QUERY) -> Column:
    """The address as a geocoder's request names it."""
    return F.concat(F.lit("address="), F.url_encode(F.substring(F.trim(address), 1, most)), F.lit("&benchmark=Public_AR_Current&vintage=Current_Current&layers=Counties&format=json"))


def dashed_key(number: Column) -> Column:
    """A parcel number of a letter and 13 digits as L##-#-###-##-###-##; any other is an error."""
    bare = parcel_key(F.coalesce(number, F.lit("")))
    dashed = F.regexp_replace(bare, r"^(...)(.)(...)(..)(...)(..)$", "$1-$2-$3-$4-$5-$6")
    return F.when(bare.rlike(r"^[A-Z]\d{13}$"), dashed).otherwise(F.raise_error(F.concat(F.lit("no letter and 13 digits: "), F.coalesce(number, F.lit("")))))


def query_key(number: Column, form: str) -> Column:
    """A parcel number as the statewide layer of a county holds it: as it is, stripped or dashed."""
    if form not in ("as-is", "stripped", "dashed"):
        raise ValueError(f"no key of the form {form}")
    return {"as-is": F.trim, "stripped": parcel_key, "dashed": dashed_key}[form](number)


def count_difference(ids: Column, total: Column) -> Column:
    """What to say of more or fewer ids than were reported; null if they agree."""
    n = F.format_number(F.abs(ids - total).cast("double"), 0)
    return F.when(ids > total, F.concat(n, F.lit(" more ids than the reported count"))).when(ids < total, F.concat(n, F.lit(" fewer ids than the reported count")))


def count_message(n: Column, one: str, many: str) -> Column:
    """What a screen reader says of a result of n rows."""
    return F.when(n == 0, f"No {many} match").when(n == 1, f"1 {one} matches").otherwise(F.concat(F.format_number(n.cast("double"), 0), F.lit(f" {many} match")))
