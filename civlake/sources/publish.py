"""One file out of many tasks, published at once: parts beside it, then a rename.

    spark.dataSource.register(PublishedFile)
    lines.write.format("published_file").option("path", ...).mode("overwrite").save()

Lines (a text column) stand in the order of the table's partitions, so a range sort before orders the whole file. A task writes its own part; only when all have,
the parts are joined under another name and that takes the old file's place. If a task fails for good, its parts and the others' go and the old file stays. Joining passes
the parts through in small pieces; with the option single=false they stay a folder of parts with a list of them, which is what takes the old list's place.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

from civlake.sources.rolls import csv_lines, placed_tuples
from civlake.sources.stores import read_bytes, store_of, write_bytes

#: Bytes that pass through at once when parts are joined.
PIECE = 8 << 20
MARK = "﻿"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int
    size: int
    sha256: str


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, line_end: str, single: bool):
        self.path, self.line_end, self.single = path, line_end, single
        self.run = f"{path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        file = f"{self.run}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        store, at = store_of(file)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        rows = size = 0
        digest = hashlib.sha256()
        with store.open_output_stream(at) as out:
            for b in iterator:
                if not b.num_rows:
                    continue
                body = (self.line_end.join(pc.fill_null(b.column(0), "").to_pylist()) + self.line_end).encode()
                out.write(body)
                digest.update(body)
                rows, size = rows + b.num_rows, size + len(body)
        return Part(context.partitionId(), file, rows, size, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.partition)
        if not self.single:
            listed = [{"file": p.file, "rows": p.rows, "bytes": p.size, "sha256": p.sha256} for p in parts if p.rows]
            write_bytes(self.path, json.dumps({"rows": sum(p.rows for p in parts), "parts": listed}).encode())
            return
        store, at = store_of(self.path)
        with store.open_output_stream(f"{at}.part") as out:
            for p in parts:
                with store.open_input_stream(store_of(p.file)[1]) as f:
                    while piece := f.read(PIECE):
                        out.write(piece)
        store.move(f"{at}.part", at)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = store_of(self.run)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class PublishedFile(DataSource):
    """Options: path; lineEnd, a line feed unless given; single, whether parts become one file."""

    @classmethod
    def name(cls) -> str:
        return "published_file"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if len(schema) != 1 or not isinstance(schema[0].dataType, StringType):
            raise ValueError("published_file takes one column of text")
        return FileWriter(self.options["path"], self.options.get("lineEnd", "\n"), str(self.options.get("single", "true")).lower() != "false")


def publish(lines: DataFrame, path: str, line_end: str = "\n", single: bool = True) -> None:
    """Write a column of lines as the file at `path`, in the place of what is there, when all of it is written."""
    lines.sparkSession.dataSource.register(PublishedFile)
    lines.write.format("published_file").option("path", path).option("lineEnd", line_end).option("single", single).mode("overwrite").save()


def published_parts(path: str) -> list[dict]:
    """The parts of a file published with single=False, checked against their digests."""
    parts = json.loads(read_bytes(path))["parts"]
    for p in parts:
        if hashlib.sha256(read_bytes(p["file"])).hexdigest() != p["sha256"]:
            raise ValueError(f"{p['file']} is not what was published")
    return parts


def publish_csv(df: DataFrame, path: str, order: list[str], quote_all: bool = True, line_end: str = "\r\n", mark: bool = True, single: bool = True) -> None:
    """df as one CSV in the order of columns `order`: a mark of byte order, the header, lines that end in CR LF; cells quoted all, or where they hold a comma, a quote or a line end."""
    header, lines = csv_lines(df) if quote_all else sparing_lines(df)
    body = df.select(*order).limit(0).columns  # fails here, not in a task, if a column is not there
    placed = df.select(F.lit(1).alias("__k"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(body)], cell_line(df, quote_all).alias("line"))
    first = df.sparkSession.range(1).select(F.lit(0).alias("__k"), *[F.lit(None).cast(df.schema[c].dataType).alias(f"__o{k}") for k, c in enumerate(body)], F.lit((MARK if mark else "") + header).alias("line"))
    whole = first.unionByName(placed).orderBy("__k", *[F.asc_nulls_first(f"__o{k}") for k in range(len(body))])
    publish(whole.select("line"), path, line_end, single)


def cell_line(df: DataFrame, quote_all: bool = True):
    """A row as a line of CSV."""

    def cell(c: str):
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return quoted if quote_all else F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *map(cell, df.columns))


def sparing_lines(df: DataFrame) -> tuple[str, DataFrame]:
    """csv_lines() with quotes only where a cell needs them, the header's cells too."""
    needs = lambda c: any(x in c for x in '",\r\n')
    header = ",".join('"' + c.replace('"', '""') + '"' if needs(c) else c for c in df.columns)
    return header, df.select(cell_line(df, quote_all=False).alias("line"))


def roll_document_lines(voters: DataFrame, head: dict, elections: list[dict], fields: list[str]) -> DataFrame:
    """Lines, in order, of one JSON document: the head's members, elections, names of the tuples' fields, the dictionaries and the tuples of voters (as roll_tuples() takes them), a voter a line.

    Dictionaries and tuples stay tables; of each list the first entry has no comma before it.
    """
    spark = voters.sparkSession
    tuples, dictionaries = placed_tuples(voters)
    names = {"precinct": "precincts", "city": "cities", "zip": "zips", "party": "parties", "status": "statuses", "jurisdiction": "jurisdictions", "category": "ballotCategories"}
    start = json.dumps(head | {"elections": elections, "fields": fields}, ensure_ascii=False)[:-1]
    fixed = [(0, start)]
    sections = []
    for k, (name, words) in enumerate(dictionaries.items()):
        fixed += [(3 * k + 1, f', "{names[name]}": ['), (3 * k + 3, "]")]
        entry = F.concat(F.when(F.col("index") > 0, ",").otherwise(""), F.regexp_replace(F.to_json(F.array("value")), r"^\[|\]$", ""))
        sections.append(words.select(F.lit(3 * k + 2).alias("section"), F.col("index").cast("long").alias("place"), entry.alias("line")))
    end = 3 * len(dictionaries) + 1
    fixed += [(end, ', "voters": ['), (end + 2, "]}")]
    least = tuples.agg(F.min("place").alias("__least"))
    body = tuples.crossJoin(F.broadcast(least)).withColumn("line", F.concat(F.when(F.col("place") == F.col("__least"), "").otherwise(","), F.col("line")))
    whole = spark.createDataFrame(fixed, "section int, line string").select("section", F.lit(0).cast("long").alias("place"), "line")
    for s in [*sections, body.select(F.lit(end + 1).alias("section"), "place", "line")]:
        whole = whole.unionByName(s)
    return whole.orderBy("section", "place").select("line")


def publish_roll(voters: DataFrame, path: str, head: dict, elections: list[dict], fields: list[str]) -> None:
    """A roll as one JSON document at `path`, in the place of an older one once it is whole; read_roll_lines() reads it in pieces, read_roll_document() as one row."""
    publish(roll_document_lines(voters, head, elections, fields), path)
