"""Selections: facets, election choices and drills compile to one filter; counts and the rows behind them share predicates."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civlake.functions.columns import all_of, any_of, count_if, has_bit
from civlake.operators.elections import Election, voted
from civlake.operators.search import folded


@dataclass(frozen=True)
class Selection:
    """facets: column -> chosen values (none: all); drills: (label, predicate), the first of a label counts; text: words that all occur in the search column."""

    facets: dict[str, list] = field(default_factory=dict)
    drills: tuple[tuple[str, Column], ...] = ()
    text: str = ""
    search: str = "search"

    def without(self, facet: str) -> Selection:
        return replace(self, facets={k: v for k, v in self.facets.items() if k != facet})

    def predicate(self) -> Column:
        words = [F.contains(F.col(self.search), F.lit(w)) for w in self.text.lower().split()]
        chosen = [F.col(k).isin(*v) for k, v in self.facets.items() if v]
        drills = list({label: p for label, p in reversed(self.drills)}.values())
        return all_of([*chosen, *words, *drills])

    def apply(self, df: DataFrame) -> DataFrame:
        """df itself if nothing is chosen."""
        return df.filter(self.predicate()) if any(self.facets.values()) or self.text.strip() or self.drills else df


def facet_counts(df: DataFrame, selection: Selection, facets: list[str]) -> DataFrame:
    """facet, value, n: each value of each facet's whole domain, counted under all other choices; zeroes included.

    One scan: a row is exploded to one (facet, value, counts) each, summed before the shuffle.
    """
    pairs = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"), F.coalesce(selection.without(f).predicate(), F.lit(False)).alias("counts")) for f in facets]
    return df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.facet", "p.value").agg(count_if(F.col("p.counts")).alias("n"))


def voted_in(elections: list[Election], mode: str = "any", never: bool = False, live: Election | None = None) -> Column:
    """any: voted in one of the chosen elections, or has a ballot out if the live one is chosen; all: in each that was open to the voter, at least one.

    Who has no vote at all and no ballot out is asked for by `never` alone; in mode "all" only if no election is chosen beside it. No
    election chosen means no voter but these.
    """
    out = F.coalesce(F.col("ballot") == "out", F.lit(False))
    silent = (F.col("mask") == 0) & ~out
    if not elections:
        return silent if never else F.lit(False)
    hits = [voted(e) for e in elections]
    if mode == "any":
        chosen = any_of([*hits, out] if live in elections else hits)
    else:
        open_to = [has_bit(F.col("elig"), e.bit) for e in elections]
        chosen = any_of(open_to) & all_of([v | ~o for v, o in zip(hits, open_to, strict=True)])
    return F.when(silent, F.lit(never and mode == "any")).otherwise(chosen)


def election_options(df: DataFrame, selection: Selection, elections: list[Election]) -> DataFrame:
    """label, n: voters in each election under all other choices, and those without any; one scan."""
    base = selection.apply(df)
    out = F.coalesce(F.col("ballot") == "out", F.lit(False))
    rows = [(e.label, voted(e)) for e in elections] + [("none", (F.col("mask") == 0) & ~out)]
    counts = base.agg(*[count_if(c).alias(f"n{k}") for k, (_, c) in enumerate(rows)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"n{k}").alias("n")) for k, (label, _) in enumerate(rows)])))


def word_prefixes(text: Column, query: str) -> Column:
    """Every word of the query begins a word of the text, whatever the case or accents."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(folded(text), "[^a-z0-9]+", " "))
    words = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return all_of([F.contains(spaced, F.lit(" " + w)) for w in re.split("[^a-z0-9]+", words) if w])


def grouped_topics(topics: DataFrame) -> DataFrame:
    """group, place, ids of topics (seq, id, group): groups in the order of their first topic, topics in theirs; no group is the empty one."""
    group = F.coalesce("group", F.lit(""))
    by = topics.groupBy(group.alias("group")).agg(F.min("seq").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "id"))), lambda t: t["id"]).alias("ids"))
    return by.withColumn("place", F.row_number().over(Window.orderBy("first"))).select("group", "place", "ids")
