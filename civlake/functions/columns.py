"""Column expressions that the operators share: ratios, masks, text and rounding rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where the whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << bit)) != 0


def count_if(condition: Column) -> Column:
    """How many rows hold, as a long that is 0 and not null for none."""
    return F.count(F.when(condition, F.lit(1)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def clean(text: Column) -> Column:
    """Trimmed, with each run of white space (no-break space and mark included) as one space; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ﻿]+", " "))


def rounded(x: Column) -> Column:
    """Half up towards plus infinity."""
    return F.floor(x + 0.5)


#: What names of places write in several ways, and the words that say of what kind a place is (fixed values).
PLACE_WORDS = {"HEIGHTS": "HTS", "HGTS": "HTS", "MOUNT": "MT", "SAINT": "ST"}
STATE_WORDS, PLACE_KINDS = ("OH", "OHIO"), ("TOWNSHIP", "TWP", "CITY", "VILLAGE")


def place_key(name: Column) -> Column:
    """A place's name to compare by: its upper-case words without punctuation, "the city of", the state and the kind of place at the end."""
    words = F.regexp_extract_all(F.upper(F.coalesce(name, F.lit(""))), F.lit("[A-Z0-9]+"), F.lit(0))
    at = lambda ws, k: F.coalesce(F.get(ws, k), F.lit(""))
    named = lambda ws, k: at(ws, k).isin("CITY", "VILLAGE") & (at(ws, k + 1) == "OF")

    def own(ws: Column) -> Column:
        kept = F.filter(ws, lambda w, i: ~(named(ws, i) | ((w == "OF") & named(ws, i - 1)) | ((w == "THE") & named(ws, i + 1))))
        return F.transform(kept, lambda w: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PLACE_WORDS.items() for x in pair]), w), w))

    def without(ws: Column, *ends: str) -> Column:
        return F.when((F.size(ws) > 1) & at(ws, F.size(ws) - 1).isin(*ends), F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0)))).otherwise(ws)

    short = F.transform(F.transform(F.transform(F.array(words), own), lambda ws: without(ws, *STATE_WORDS)), lambda ws: without(ws, *PLACE_KINDS))
    return F.array_join(short[0], " ")


def title_case(name: Column) -> Column:
    """Each word capitalised, the letter after Mc too; "-on-", "-the-" and "-of-" inside hyphens stay small."""
    # a word begins behind anything that is not a letter, a digit or an underscore
    words = F.split(F.lower(clean(name)), "(?<=[^a-z0-9_])(?=[a-z0-9_])")
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    begin = lambda w: F.concat(F.translate(F.substring(w, 1, 1), small, large), F.substring(w, 2, 1 << 20))
    word = lambda w: F.when(w.rlike("^mc[a-z]"), F.concat(F.lit("Mc"), begin(F.substring(w, 3, 1 << 20)))).otherwise(begin(w))
    named = F.array_join(F.transform(words, word), "")
    for w in ("On", "The", "Of"):
        named = F.regexp_replace(named, f"-{w}(?=-)", f"-{w.lower()}")
    return named


def parcel_key(raw: Column) -> Column:
    """A parcel number to join by: letters and digits only, upper case."""
    return F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))


def first_digit(code: Column) -> Column:
    """The first digit anywhere in a land-use code, 0 where there is none."""
    return F.coalesce(F.try_to_number(F.regexp_extract(code, r"(\d)", 1), F.lit("9")).cast("int"), F.lit(0))


def assessed(value: Column, rate: float = 0.35) -> Column:
    """The taxed share of a market value to the nearest ten."""
    return rounded(value * rate / 10) * 10


def assessed_value(land: Column, building: Column, total: Column, rule: str) -> Column:
    """By "components", land and building each rounded, or by "total"; counties differ."""
    if rule not in ("components", "total"):
        raise ValueError(f"no rule {rule}")
    return assessed(total) if rule == "total" else assessed(land) + assessed(building)


def general_election_day(year: Column) -> Column:
    """The Tuesday after the first Monday in November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "Mon"), 1)


def iso_date(text: Column) -> Column:
    """m/d/y or m/d/yy as yyyy-MM-dd; anything else as the empty text."""
    m, d, y = (F.regexp_extract(F.trim(text), r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", k) for k in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    return F.when(y == "", F.lit("")).otherwise(F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


#: Days as m/d/y with a year of two or four digits; and these or yyyy-mm-dd, with anything behind that does not begin with a digit.
US_DAY = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
ANY_DAY = r"^(?:(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})|(\d{4})-(\d{2})-(\d{2}))(?:\D.*)?$"


def with_iso_dates(df: DataFrame, names: tuple[str, ...], pattern: str = US_DAY) -> DataFrame:
    """df with clean texts of the columns named as iso_date() gives them, or for ANY_DAY iso_date() of mdy(); a text is matched once and the rest is cut from what was found."""
    # a clean text does not begin with a space, so that what does was found
    df = df.withColumns({c: F.regexp_replace(c, pattern, " $3$4-$1$5-$2$6" if pattern == ANY_DAY else " $3-$1-$2") for c in names})
    part = lambda c, k: F.substring_index(F.substring_index(F.substring(c, 2, 10), "-", k), "-", -1)
    year = lambda c: F.when(F.length(part(c, 1)) == 2, F.concat(F.lit("20"), part(c, 1))).otherwise(part(c, 1))
    return df.withColumns({c: F.when(F.startswith(c, F.lit(" ")), F.concat_ws("-", year(c), F.lpad(part(c, 2), 2, "0"), F.lpad(part(c, 3), 2, "0"))).otherwise("") for c in names})


def any_date(value: Column) -> Column:
    """iso_date, and days since the end of 1899 as spreadsheets count them, and yyyymmdd; anything else as the empty text."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    days = F.regexp_extract(text, r"^(\d{5})(?:\.\d+)?$", 1).try_cast("int")
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(days.isNotNull(), F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), days), "yyyy-MM-dd")).when(text.rlike(r"^\d{8}$"), compact).otherwise(iso_date(text))


def sale_date(value: Column) -> Column:
    """The day (UTC) of milliseconds since 1970, as yyyy-MM-dd; the empty text for 0, which is never, for days up to 1900-01-01, beyond what a calendar has, and for what is no number."""
    ms = F.trim(value.cast("string")).try_cast("double")
    fits = ms.isNotNull() & ~F.isnan(ms) & (ms != 0) & (F.abs(ms) <= 8.64e15)
    day = F.date_format(F.timestamp_millis(F.when(fits & (F.abs(ms) < 2.5e14), ms).cast("long")), "yyyy-MM-dd")
    return F.when(day > "1900-01-01", day).otherwise("")


def decoded_entities(html: Column) -> Column:
    """The five named entities, the no-break space and decimal numbers of ASCII characters as characters; the ampersand last."""
    codes = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"&#(\d{2,3});"), F.lit(1)), lambda n: n.cast("int")))
    html = F.aggregate(F.filter(codes, lambda n: (n > 31) & (n < 127)), html, lambda done, n: F.replace(done, F.concat(F.lit("&#"), n.cast("string"), F.lit(";")), F.char(n)))
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        html = F.replace(html, F.lit(name), F.lit(plain))
    return html
