"""Text search over parcels and options: a query is read once, on the driver, and becomes one predicate."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civlake.functions.columns import all_of, any_of

#: Spellings of street types, directions and words (fixed values); the first of a group is the usual one.
STREET_TYPES = tuple(tuple(g.split()) for g in ("rd road", "st street str", "ave av avenue", "dr drive", "ln lane", "ct court", "blvd boulevard", "pkwy parkway", "cir circle", "pl place", "trl trail", "hwy highway", "ter terrace"))
DIRECTIONS = tuple(tuple(g.split()) for g in ("n north", "s south", "e east", "w west", "ne northeast", "nw northwest", "se southeast", "sw southwest"))
IGNORED = ("oh", "ohio", "usa")
VARIANTS = {"state": ("st",), "route": ("rt", "rte"), "rte": ("rt", "route"), "rt": ("route", "rte")}
_TYPE = {w: g for g in STREET_TYPES for w in g}
_DIRECTION = {w: g for g in DIRECTIONS for w in g}


@dataclass
class AddressQuery:
    """What a typed address asks for: words that must match, groups of spellings that must not be contradicted, ZIPs."""

    required: list[str] = field(default_factory=list)
    types: list[tuple[str, ...]] = field(default_factory=list)
    directions: list[tuple[str, ...]] = field(default_factory=list)
    zips: list[str] = field(default_factory=list)


def read_query(text: str) -> AddressQuery:
    """A typed or pasted address: the street before the first comma, the rest as a hint of which only a ZIP counts.

    Without a comma, words behind the last street type are the place if there are only words and a ZIP.
    """
    words = lambda s: [w for w in re.split("[^a-z0-9]+", s) if w and w not in IGNORED]
    head, comma, tail = re.sub(r"\b(\d{5})-\d{4}\b", r"\1", text.strip().lower()).partition(",")
    street, place = words(head), words(tail)
    ends = [i for i, w in enumerate(street) if w in _TYPE]
    if not comma and ends:
        behind = street[ends[-1] + 1 :]
        if behind and all(re.fullmatch(r"[a-z]+|\d{5}", w) for w in behind):
            street, place = street[: ends[-1] + 1], behind
    out = AddressQuery(zips=[w for w in place if re.fullmatch(r"\d{5}", w)])
    for w in street:
        if w in _TYPE:
            out.types.append(_TYPE[w])
        elif w in _DIRECTION:
            out.directions.append(_DIRECTION[w])
        else:
            out.required.append(w)
    if not out.required and not out.zips:
        out.required = place
    return out


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _begins(word: str):
    return lambda x: x.startswith(word)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def address_matches(query: AddressQuery, address: Column, zip_code: Column, owner: Column | None = None) -> Column:
    """Whether an address answers the query word by word; a query that asks for nothing is answered by none."""
    if not query.required and not query.zips:
        return F.lit(False)
    zip_code = F.coalesce(zip_code, F.lit(""))
    found = F.concat(_words(address), F.array(zip_code), *([_words(owner)] if owner is not None else []))
    tests = [F.substring(zip_code, 1, 5).isin(*query.zips)] if query.zips else []
    for w in query.required:
        hits = [F.array_contains(found, w)]
        if not w.isdecimal():
            hits.append(F.exists(found, _begins(w)))
        if w in VARIANTS:
            hits.append(F.arrays_overlap(found, _array(VARIANTS[w])))
        tests.append(any_of(hits))
    street = _words(F.split(F.coalesce(address, F.lit("")), ",")[0])
    typed = F.coalesce(F.try_element_at(street, F.lit(-1)).isin(*_TYPE), F.lit(False))
    directed = F.arrays_overlap(street, _array(_DIRECTION))
    tests += [F.arrays_overlap(street, _array(g)) | ~typed for g in query.types]
    tests += [F.arrays_overlap(street, _array(g)) | ~directed for g in query.directions]
    return all_of(tests)


def parcel_search(text: str, number: Column, address: Column, zip_code: Column, owner: Column | None = None) -> Column:
    """Whether a parcel answers a query: part of its number, address or ZIP, else its address word by word. Owners are searched only if given."""
    q = text.strip().lower()
    if not q:
        return F.lit(True)
    inside = lambda c, case=True: F.contains(F.lower(F.coalesce(c, F.lit(""))) if case else F.coalesce(c, F.lit("")), F.lit(q))
    literal = [inside(number), inside(address), inside(zip_code, False)] + ([inside(owner)] if owner is not None else [])
    return any_of(literal) | address_matches(read_query(q), address, zip_code, owner)


def first_match(df: DataFrame, condition: Column, order: list[Column]) -> DataFrame:
    """The first row in an order for which the condition holds; none if there is none."""
    return df.filter(condition).orderBy(*order).limit(1)


def is_mapped(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def option_search(label: Column, text: str) -> Column:
    """Whether an option's label holds the typed text, in any case."""
    return F.contains(F.lower(F.coalesce(label, F.lit(""))), F.lit(text.strip().lower()))


def folded(text: Column) -> Column:
    """Lower case, letters of Latin scripts without their accents and without combining marks."""
    plain: dict[str, str] = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(c) == 1 and base != c and len(base) == 1:
            plain[c] = base
    return F.regexp_replace(F.translate(F.lower(text), "".join(plain), "".join(plain.values())), "[̀-ͯ]", "")


def fields_or(df: DataFrame, wanted: dict[str, object], drop: tuple[str, ...] = ()) -> DataFrame:
    """The wanted columns with a value for null and for columns that df lacks, without those to drop."""
    named = lambda c, v: (F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)).alias(c)
    return df.select(*[named(c, v) for c, v in wanted.items() if c not in drop])


def in_degrees(df: DataFrame, *columns: str) -> DataFrame:
    """One row: whether the columns' numbers look like degrees, that is, none is 200 or more from zero; null without numbers."""
    worst = F.max(F.greatest(*[F.abs(F.col(c).try_cast("double")) for c in columns], F.lit(0.0)))
    some = F.count(F.coalesce(*[F.col(c).try_cast("double") for c in columns]))
    return df.agg(F.when(some > 0, worst < 200).alias("degrees"))
