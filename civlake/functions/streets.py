"""Street addresses as words, each of which is read by where it stands.

A text is cut into words once. A word's neighbours tell whether it begins a unit, belongs to the house number, names a route or a road by number, or is part of
the street's name; each rule is a condition on positions, and all of them are applied to a whole list of words at a time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of directions, street types, ordinals and other words (fixed values: postal abbreviations and what rolls write).
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
TYPES = {
    "ROAD": "RD", "STREET": "ST", "AVENUE": "AVE", "AV": "AVE", "TR": "TRL", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "BOULEVARD": "BLVD", "CIRCLE": "CIR", "PLACE": "PL",
    "TERRACE": "TER", "TRAIL": "TRL", "PARKWAY": "PKWY", "HIGHWAY": "HWY", "SQUARE": "SQ", "BL": "BLVD", "WY": "WAY", "CR": "CIR", "LP": "LOOP", "PW": "PKWY", "PI": "PIKE",
    "TE": "TER", "BRIDGE": "BRG", "SAINT": "ST", "CROSSING": "XING",
}
NAME_WORDS = {"CENTER": "CTR", "CENTRE": "CTR", "PLAZA": "PLZ", "HEIGHTS": "HTS", "HGTS": "HTS", "MOUNT": "MT"}
ORDINALS = {
    "FIRST": "1", "SECOND": "2", "THIRD": "3", "FOURTH": "4", "FIFTH": "5", "SIXTH": "6", "SEVENTH": "7", "EIGHTH": "8", "NINTH": "9", "TENTH": "10", "ELEVENTH": "11", "TWELFTH": "12", "THIRTEENTH": "13",
    "FOURTEENTH": "14", "FIFTEENTH": "15", "SIXTEENTH": "16", "SEVENTEENTH": "17", "EIGHTEENTH": "18", "NINETEENTH": "19", "TWENTIETH": "20",
}
SHORT = ("N", "S", "E", "W", "NE", "NW", "SE", "SW")
SUFFIXES = ("RD", "ST", "AVE", "DR", "LN", "CT", "BLVD", "CIR", "PL", "TER", "TRL", "PKWY", "HWY", "SQ", "WAY", "RUN", "PT", "LOOP", "PATH", "XING", "PIKE", "BRG")
#: Words behind which an address says where in a building (fixed values), and those of floors.
UNITS = ("APT", "APTS", "UNIT", "UNITS", "STE", "STES", "SUITE", "SUITES", "LOT", "LOTS", "TRLR", "RM", "BLDG", "BLDGS", "REAR", "BSMT", "BASEMENT", "PATIO", "FL", "FLS", "FLOOR", "FLOORS")
FLOORS = UNITS[-4:]
#: Words of routes and of roads by number (fixed values).
ROUTES = ("ROUTE", "RTE", "RT")
HIGHWAYS = ("HIGHWAY", "HWY", *ROUTES)
ROADS = ("RD", "ROAD")
#: A letter behind a house number is no unit if one of these follows: then it is the street's name.
AFTER_NAME = ("ST", "STREET", "AVE", "AVENUE", "RD", "ROAD", "DR", "DRIVE", "CT", "LN", "PL", "BLVD", "WAY", "AND", "&")
#: Words that roads() may read as something else.
_SPEAKING = ("&", "STATE", "ST", "US", "U", "S", "OH", "USR", "CO", "CR", "CTY", "COUNTY", "TWP", "TR", "TOWNSHIP", *ROADS, *HIGHWAYS)
_ORDINAL, _NUMBER = r"^\d+(?:ST|ND|RD|TH)$", r"^\d+[A-Z]?$"


def held(value: Column, use) -> Column:
    """use(value), worked out once however often use reads it."""
    return F.transform(F.array(value), use)[0]


def word(words: Column, k) -> Column:
    """The word at an index from 0, empty outside."""
    return F.coalesce(F.get(words, k), F.lit("")) if not isinstance(k, int) else F.coalesce(F.get(words, F.lit(k)), F.lit(""))


def without_last(words: Column) -> Column:
    return F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def tail_cut(words: Column, drop) -> Column:
    """words up to the last one for which drop(word, index) does not hold."""
    keep = F.transform(words, lambda w, i: F.when(drop(w, i), 0).otherwise(i + 1))
    return F.slice(words, 1, F.coalesce(F.array_max(keep), F.lit(0)))


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def raw_words(street: Column) -> Column:
    """Upper-case words of letters and digits, and "&"; without remarks in brackets, what follows a number sign, and a state behind a comma.

    A number and its letter are one word ("25-A"), a route's letters and its number two ("SR598").
    """
    text = F.regexp_replace(F.upper(F.coalesce(street, F.lit(""))), r"\([^)]*\)|#.*$|,\s*[A-Z]{2}\s*$", " ")
    text = F.regexp_replace(text, r"(?<=\d)\s*-\s*(?=[A-Z]\b(?!\s*-))|(?<=\bS)\.\s?(?=R\.\s*\d)|(?<=\bU)\.\s?(?=S\.\s)", "")
    text = F.regexp_replace(text, r"\b(SR|USR|US|OH|CR|TR)\s*-?\s*(?=\d{1,4}[A-Z]?\b)", "$1 ")
    return F.regexp_extract_all(text, F.lit("[A-Z0-9]+|&"), F.lit(0))


def before_units(words: Column) -> Column:
    """The words in front of the first that begins a unit; an ordinal in front of a floor begins one."""

    def begins(w: Column, i: Column) -> Column:
        after, second, third = (word(words, i + k) for k in (1, 2, 3))
        floor = after.isin(*FLOORS) | (after.isin("&", "AND") & second.rlike(_ORDINAL) & third.isin(*FLOORS))
        ordinal = w.rlike(_ORDINAL) | w.isin("FIRST", "SECOND", "THIRD")
        return w.isin(*UNITS) | (w.isin("BOX", "RR") & after.rlike(r"^\d+$")) | w.rlike(r"^RR\d+$") | (ordinal & floor)

    at = F.array_min(F.transform(words, lambda w, i: F.when(begins(w, i), i)))
    return F.when(at.isNull(), words).otherwise(F.slice(words, 1, F.coalesce(at, F.lit(0))))


def tidy_number(words: Column) -> Column:
    """The house number without leading zeroes, halves and letters of units; N, S, E and W are directions."""
    first, size = word(words, 0), F.size(words)
    number = F.regexp_replace(first, r"^0+(?=\d)", "")
    number = F.when((size > 1) & number.rlike(r"^\d+[A-Z]$"), F.regexp_replace(number, "[A-Z]$", "")).otherwise(number)
    half = first.rlike(r"^\d+$") & (word(words, 1) == "1") & (word(words, 2) == "2") & (size > 3)
    at = F.when(half, 3).otherwise(1)
    follows, beyond = word(words, at + 1), word(words, at + 2)
    one_letter = follows.rlike("^[A-Z]$") & ((beyond == "") | beyond.isin("RD", "ROAD", "ST", "AVE"))
    letter = number.rlike(r"^\d+$") & word(words, at).rlike("^[A-DF-MO-RT-VX-Z]$") & (follows != "") & ~follows.isin(*AFTER_NAME) & ~one_letter
    rest = F.slice(words, at + 1 + F.when(letter, 1).otherwise(0), F.greatest(size, F.lit(1)))
    return F.when(size == 0, words).otherwise(F.concat(F.array(number), rest))


def roads(words: Column) -> Column:
    """State and federal routes as SR, county and township roads by number as CO RD and TWP RD; without "&"."""
    says = lambda *ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")

    def read(w: Column, i: Column) -> Column:
        p2, p1, n1, n2, n3 = (word(words, i + k) for k in (-2, -1, 1, 2, 3))
        number, digit = lambda x: x.rlike(_NUMBER), lambda x: x.rlike(r"^\d")
        plain = ~w.isin(*_SPEAKING) & ~w.rlike("^\\d+[NSEW]$")
        by_number = F.when(plain, F.array(w)).when(w == "&", says())
        # of several words that name a route the last speaks
        by_number = by_number.when(w.isin("STATE", "ST") & n1.isin(*ROUTES), says()).when((w == "US") & n1.isin(*HIGHWAYS, "SR") & digit(n2), says())
        by_number = by_number.when((w == "U") & (n1 == "S") & n2.isin(*HIGHWAYS) & digit(n3), says()).when((w == "S") & (p1 == "U") & n1.isin(*HIGHWAYS) & digit(n2), says())
        federal = w.isin("HIGHWAY", "HWY") & digit(n1) & ((p1 == "US") | ((p1 == "S") & (p2 == "U")))
        by_number = by_number.when(w.isin(*ROUTES) | federal | ((w == "US") & digit(n1)) | (w.isin("OH", "USR") & n1.rlike(r"^\d{1,4}[A-Z]?$")), says("SR"))
        for kind, before_road, before_number, alone in (("CO", ("CO", "CR", "CTY", "COUNTY"), ("CO", "CTY", "COUNTY"), ("CR",)), ("TWP", ("TWP", "TR", "TOWNSHIP"), ("TWP", "TOWNSHIP"), ("TR", "TWP"))):
            by_number = by_number.when(w.isin(*before_road) & n1.isin(*ROADS) & number(n2), says(kind))
            by_number = by_number.when((w.isin(*before_number) & number(n1) & n2.isin(*ROADS)) | (w.isin(*alone) & number(n1)), says(kind, "RD"))
            by_number = by_number.when(w.isin(*ROADS) & number(p1) & p2.isin(*before_number), says())
        sided = w.rlike(r"^\d{1,4}[NSEW]$") & p1.isin("SR", "US", "USR", "OH", "CR", "TR")
        return by_number.when(sided, F.array(F.regexp_replace(w, "[A-Z]$", ""), F.right(w, F.lit(1)))).otherwise(F.array(w))

    return F.flatten(F.transform(words, read))


def spelled(words: Column) -> Column:
    """Directions, types, names and ordinals in one spelling. The first word is the number or all there is, and keeps its ordinal; PK at the end, before directions, is a pike."""
    names, ordinals = _lookup(DIRECTIONS | TYPES | NAME_WORDS), _lookup(ORDINALS)
    plain = lambda w: F.coalesce(F.try_element_at(names, w), w)
    numbered = lambda w: F.coalesce(F.try_element_at(names, w), F.try_element_at(ordinals, w), F.regexp_replace(w, r"^(\d+)(?:ST|ND|RD|TH)$", "$1"))
    read = F.transform(words, lambda w, i: F.when(i == 0, plain(w)).otherwise(numbered(w)))
    # an AND inside a name is said or not
    read = held(read, lambda ws: F.filter(ws, lambda w, i: (w != "AND") | (i < 2) | (i == F.size(ws) - 1)))

    def at_ends(ws: Column) -> Column:
        named = F.size(tail_cut(ws, lambda w, i: w.isin(*SHORT) & (i > 1))) - 1
        return held(named, lambda last: F.transform(ws, lambda w, i: F.when(w.isin("NO", "SO") & (i < F.size(ws) - 1), F.left(w, F.lit(1))).when((w == "PK") & (i == last) & (i > 1), "PIKE").otherwise(w)))

    return held(read, at_ends)


def street_tokens(street: Column) -> Column:
    """The words of an address: upper case, no unit, directions, types, ordinals and routes in one spelling; null has none."""
    return held(raw_words(street), lambda raw: held(before_units(raw), lambda ws: held(tidy_number(ws), lambda numbered: held(roads(numbered), spelled))))


def without_quadrant(words: Column) -> Column:
    """The street without directions at its end."""
    return tail_cut(words, lambda w, i: w.isin(*SHORT))


def _complete(text: Column) -> Column:
    """Whether a text is a number, a name and a type of street."""
    return held(without_quadrant(street_tokens(text)), lambda ws: (F.size(ws) > 2) & word(ws, F.size(ws) - 1).isin(*SUFFIXES))


def _segments(line: Column) -> Column:
    """The parts of a line that "&" or AND joins and that begin with a number; what such a word adds to a complete address is left out."""
    pieces = F.split(line, r"\s+(?:&|AND)\s+")

    def cut(ps: Column) -> Column:
        named = F.array_min(F.transform(ps, lambda p, i: F.when((i > 0) & ~p.rlike(r"^\d"), i)))
        head = F.slice(ps, 1, F.coalesce(named, F.lit(0)))
        return F.when(named.isNotNull() & F.array_join(head, " & ").rlike(r"^\d+\s+\S") & _complete(F.array_join(head, " & ")), head).otherwise(F.split(line, r"\s+(?:&|AND)\s+(?=\d)"))

    return held(pieces, cut)


def _of_segment(segment: Column, others: Column, most: int) -> Column:
    """The addresses of a segment: each number with the segment's street, or with the first street of the other segments if it has none."""
    run, half = r"^(\d+(?:\s*[-,&]\s*\d+)*)(?:\s+(.*))?$", r"^1\s*[/ ]\s*2$"
    spaced = r"^(\d+)\s+(\d{3,})\s+([A-Z].*)$"
    by_space = F.length(F.regexp_extract(segment, spaced, 1)) == F.length(F.regexp_extract(segment, spaced, 2))
    is_spaced = segment.rlike(spaced) & by_space
    joined = F.when(is_spaced, F.concat_ws(" ", F.regexp_extract(segment, spaced, 1), F.regexp_extract(segment, spaced, 2))).otherwise(F.regexp_extract(segment, run, 1))
    street = F.when(is_spaced, F.regexp_extract(segment, spaced, 3)).otherwise(F.regexp_extract(segment, run, 2))
    numbers = F.slice(F.regexp_extract_all(joined, F.lit(r"\d+"), F.lit(0)), 1, 5)

    def read(ns: Column) -> Column:
        first, count = word(ns, 0), F.size(ns)
        # a shorter number has the first one's beginning
        full = F.transform(ns, lambda n: F.concat(F.left(first, F.greatest(F.length(first) - F.length(n), F.lit(0))), n))
        each = F.transform(full, lambda n: F.concat_ws(" ", n, street))
        low, high = first.try_cast("long"), word(full, 1).try_cast("long")
        pair = F.when((high > low) & (high - low <= most), each).otherwise(F.slice(each, 1, 1))
        alone = (F.size(others) > 1) & ((street == "") | street.rlike(half)) & (count == 1)
        lent = F.get(F.filter(F.transform(others, lambda o: F.regexp_extract(o, r"^\d+(?:\s*-\s*\d+)?\s+(.+)$", 1)), lambda o: (o != "") & ~o.rlike(half)), F.lit(0))
        several = (street != "") & (is_spaced | ((count > 2) & ~street.rlike(r"^\d+(?:ST|ND|RD|TH)\b")))
        return F.when(alone, F.array(F.concat_ws(" ", first, lent))).when(several, each).when((count == 2) & (street != "") & joined.rlike("-"), pair).otherwise(F.array(segment))

    return held(numbers, read)


def compound_addresses(street: Column, most: int = 12) -> Column:
    """The single addresses of a text that names several: lines, numbers joined by "&", AND, hyphens and commas, and two numbers side by side.

    A shortened number takes its beginning from the first of its row; of a pair with a hyphen the second counts if it is at most `most` above the first. A line that begins with a name gives the
    part behind a comma that begins with a number. The same address comes once; without any, the text itself.
    """
    text = F.upper(F.trim(F.coalesce(street, F.lit(""))))
    numbered = lambda s: F.get(F.filter(F.split(s, r",\s*"), lambda p: p.rlike(r"^\d+\s+\S")), F.lit(0))
    bare = F.transform(F.split(text, r"[\r\n]+"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(?:AKA|AND|&)\s+", "")))
    lines = F.transform(F.filter(bare, lambda s: s != ""), lambda s: F.when(s.rlike(r"^\d"), s).otherwise(F.coalesce(numbered(s), s)))
    found = F.flatten(F.transform(lines, lambda s: held(_segments(s), lambda parts: F.flatten(F.transform(parts, lambda p: _of_segment(p, parts, most))))))
    found = F.array_distinct(F.filter(F.transform(found, lambda a: F.trim(F.regexp_replace(a, r"\s+", " "))), lambda a: a != ""))
    return held(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(text)))
