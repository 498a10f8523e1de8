"""Language identification by compression.

For each language a bounded sample of its training texts becomes a raw-content zstandard dictionary.
A text is compressed block by block with each of them; the language whose dictionary leaves the
fewest bytes wins, and a narrow margin over the second is a reason to reject.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civlake.llm.common import documents, slices

#: One training text is taken for each language and part of its training rows; of each, a window of so many characters; so many bytes a dictionary; so many languages, the most frequent ones.
SAMPLE_PARTS, SAMPLE_CHARS, DICTIONARY_BYTES, LANGUAGES = 128, 1200, 110 << 10, 256
BLOCK_BYTES, LEVEL = 2048, 5
#: Letters with the marks that belong to them make words; digits, signs and everything else part them.
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
UNKNOWN = "und"


def letters_only(text: str) -> str:
    """Lower-cased words with single spaces between them; empty if the text has no letter (of Unicode's category L)."""
    return _OTHER.sub(" ", text.lower()).strip() if _LETTER.search(text) else ""


def train(labelled: DataFrame, parts: int = SAMPLE_PARTS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each language, the most frequent first, from rows (doc_id, text, lang); those without lang or text are left out, and so are languages without a letter in their sample.

    The sample is bounded: the row with the smallest hash (of id and text, so that null and repeated ids count like others) of each of `parts` parts of a language's
    rows, a window of `chars` characters of each that lies anywhere in its text, `size` bytes a language, for the `languages` languages with
    the most rows. It reaches the driver; nothing else does. An empty table gives no dictionary; further columns are ignored.
    """
    order = F.xxhash64("doc_id", "text")
    usable = labelled.filter("lang is not null and text is not null")
    start = F.pmod(F.xxhash64("text", F.lit(5)), F.greatest(F.length("text") - chars + 1, F.lit(1))) + 1
    window = F.substring("text", start.cast("int"), F.lit(chars))
    picked = usable.groupBy("lang", F.pmod(order, F.lit(parts)).alias("part")).agg(F.min_by(window, order).alias("t"), F.count(F.lit(1)).alias("n"))
    kept = picked.groupBy("lang").agg(F.sum("n").alias("total"), F.collect_list(F.struct("part", "t", "n")).alias("sample")).orderBy(F.desc("total"), "lang").limit(languages)
    samples: dict[str, list[str]] = {}
    rows: dict[str, int] = {}
    for lang, _, t, n in sorted((r["lang"], *s) for r in kept.collect() for s in r["sample"]):
        samples.setdefault(lang, []).append(letters_only(t)[:chars])
        rows[lang] = rows.get(lang, 0) + n
    samples = {lang: samples[lang] for lang in sorted(rows, key=lambda x: (-rows[x], x))}
    joined = {lang: " ".join(ts).encode("utf-8", "replace") for lang, ts in samples.items()}
    # each as much as it has: a dictionary of another language leaves more bytes than none, so that size alone does not win
    return {lang: text[:size] for lang, text in joined.items() if text.strip()}


@lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int):
    import zstandard

    out = []
    for lang, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress))
    return out


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], level: int = LEVEL, block: int = BLOCK_BYTES) -> tuple[str, float]:
    """(language, margin): bytes saved against the second smallest, as a share of it; the more frequent of equals."""
    own = letters_only(text or "").encode("utf-8", "replace")
    if not own or not dictionaries:
        return UNKNOWN, 0.0
    sizes = [0] * len(dictionaries)
    tools = _compressors(dictionaries, level)
    for at in range(0, len(own), block):
        part = own[at : at + block]
        for k, (_, compress) in enumerate(tools):
            sizes[k] += len(compress(part))
    best = min(range(len(sizes)), key=sizes.__getitem__)
    if len(sizes) == 1:
        return tools[0][0], 1.0
    second = min(s for k, s in enumerate(sizes) if k != best)
    return tools[best][0], 1 - sizes[best] / second


def identify(docs: DataFrame, dictionaries: dict[str, bytes], reject_below: float = 0.005, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1: how clear the choice is) and rejected (the margin is under reject_below).

    A null text or one without a letter is `und` with score 0, and rejected; so is every text if there is no dictionary. `rejected` does not change
    lang_pred: a caller that wants few errors takes rejected rows for `und`. Very long texts are compressed whole, block by block. Of languages
    that leave equally many bytes the more frequent one wins. Each row is judged by its text alone, so null and repeated ids do not matter;
    an empty table gives an empty result. Columns of these names are replaced; others are kept.
    """
    held = tuple(dictionaries.items())
    rows = docs.drop("lang_pred", "score", "rejected")
    schema = docs.drop("lang_pred", "score", "rejected").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        for whole in batches:
            for b in slices(whole, text_col):
                found = [classify(t, held) for t in b.column(text_col).to_pylist()]
                b = b.append_column("lang_pred", pa.array([f[0] for f in found], pa.string()))
                # a margin of one per cent is an even bet of 0.5
                b = b.append_column("score", pa.array([f[1] / (f[1] + 0.01) if f[1] > 0 else 0.0 for f in found], pa.float64()))
                yield b.append_column("rejected", pa.array([f[1] < reject_below for f in found], pa.bool_()))

    return rows.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from those whose crc32(doc_id) mod 5 is not 0; a row without an id is held out."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    dictionaries = train(docs.select("doc_id", "text", "lang").filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, dictionaries).drop("text")
