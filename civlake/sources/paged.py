"""Answers of a paged record service, landed as files, as a data source of Spark.

A folder holds one folder a range of ids, `range-<number>-<first id>-<last id>`; ranges are a read's partitions. In it `page-<offset>.json` is the answer to the request
from that offset on, and `batch-<number>.json` the answer to a list of ids; `ids.json`, if there, lists the ids the service says it has. An answer is
{"features": [{"attributes": {...}}, ...]}. Read it as

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").schema(...).option("key", "id").load(folder)

or as a stream, in which each trigger takes the ranges that have landed since, told by their numbers, and a restart goes on where the checkpoint stands.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from civlake.sources.stores import exists, listing, read_bytes, write_bytes

_RANGE = re.compile(r"range-(\d+)-(-?\d+)-(-?\d+)")
#: Rows of a batch handed to Spark.
BATCH_ROWS = 10_000


class HarvestError(ValueError):
    """A range that cannot be read whole."""


@dataclass
class IdRange(InputPartition):
    """The ids of one folder."""

    number: int
    first: int
    last: int
    folder: str


def ranges_of(path: str) -> list[IdRange]:
    found = [(m, f.base_name) for f in listing(path) if (m := _RANGE.fullmatch(f.base_name))]
    return sorted((IdRange(*map(int, m.groups()), f"{path.rstrip('/')}/{name}") for m, name in found), key=lambda r: r.number)


def _features(path: str) -> list[dict]:
    answer = json.loads(read_bytes(path))
    if "features" not in answer:
        raise HarvestError(f"{path} is no answer with features: {str(answer)[:200]}")
    return [f["attributes"] for f in answer["features"]]


def read_range(part: IdRange, key: str) -> Iterator[list[dict]]:
    """The records of a range, a page at a time, each id once.

    The next page is the one behind the rows that came, however many were asked for: a short page ends nothing, an empty or missing one does. A page that begins
    as the first one did shows a service that does not heed the offset, and is an error, as are rows outside the range. Ids that ids.json lists and no page
    held are taken from the batches by id; if some are still missing, that is an error too.
    """
    offset, seen, opening = 0, set(), None
    while exists(at := f"{part.folder}/page-{offset}.json"):
        rows = _features(at)
        if not rows:
            break
        if offset and rows[0][key] == opening:
            raise HarvestError(f"{at} begins with the first page's row: the offset was not heeded")
        opening = rows[0][key] if not offset else opening
        offset += len(rows)
        yield _new(rows, key, seen, part)
    if exists(f"{part.folder}/ids.json"):
        missing = set(json.loads(read_bytes(f"{part.folder}/ids.json"))) - seen
        for f in listing(part.folder) if missing else ():
            if f.base_name.startswith("batch-"):
                rows = [r for r in _features(f"{part.folder}/{f.base_name}") if r[key] in missing]
                yield _new(rows, key, seen, part)
        if missing - seen:
            raise HarvestError(f"{part.folder}: {len(missing - seen)} ids were never answered, {min(missing - seen)} among them")


def _new(rows: list[dict], key: str, seen: set, part: IdRange) -> list[dict]:
    out = []
    for r in rows:
        if not part.first <= r[key] <= part.last:
            raise HarvestError(f"{part.folder}: id {r[key]} is not in the range")
        if r[key] not in seen:
            seen.add(r[key])
            out.append(r)
    return out


def _batches(part: IdRange, key: str, schema: StructType) -> Iterator[pa.RecordBatch]:
    kinds, held = to_arrow_schema(schema), []
    for rows in read_range(part, key):
        held += [{f: r.get(f) for f in kinds.names} for r in rows]
        if len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, kinds)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, kinds)


class PagesReader(DataSourceReader):
    """A partition a range."""

    def __init__(self, schema: StructType, path: str, key: str):
        self.schema, self.path, self.key, self.kept = schema, path, key, []

    def partitions(self):
        found = [r for r in ranges_of(self.path) if all(test(r, v) for test, v in self.kept)]
        return found or [IdRange(0, 0, -1, f"{self.path}/none")]

    def read(self, partition: IdRange):
        return _batches(partition, self.key, self.schema)


class PrunedReader(PagesReader):
    """Comparisons of the key with numbers leave out ranges that cannot hold a row. Spark asks for this only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]):
        tests = {EqualTo: lambda r, v: r.first <= v <= r.last, GreaterThan: lambda r, v: r.last > v, GreaterThanOrEqual: lambda r, v: r.last >= v, LessThan: lambda r, v: r.first < v, LessThanOrEqual: lambda r, v: r.first <= v}
        for f in filters:
            if type(f) in tests and f.attribute == (self.key,):
                self.kept.append((tests[type(f)], f.value))
            yield f  # rows are still judged by Spark


class PagesStream(DataSourceStreamReader):
    """Offsets are the number of the next range; they only grow. Ranges count as landed in the order of their numbers, up to the first gap."""

    def __init__(self, schema: StructType, path: str, key: str):
        self.schema, self.path, self.key = schema, path, key

    def initialOffset(self) -> dict:
        return {"range": 0}

    def latestOffset(self) -> dict:
        numbers, upto = {r.number for r in ranges_of(self.path)}, 0
        while upto in numbers:
            upto += 1
        return {"range": upto}

    def partitions(self, start: dict, end: dict):
        return [r for r in ranges_of(self.path) if start["range"] <= r.number < end["range"]]

    def read(self, partition: IdRange):
        return _batches(partition, self.key, self.schema)

    def commit(self, end: dict) -> None:
        """Landed files stay where they are."""


class LandedPages(DataSource):
    """Options: path; key, the whole-number column that ids stand in; prune, whether filters of the key choose the ranges."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self):
        raise HarvestError("landed_pages needs a schema")

    def _opened(self, kind, schema: StructType):
        if self.options.get("key") not in schema.names:
            raise HarvestError(f"the option key must name a column, not {self.options.get('key')!r}")
        return kind(schema, self.options["path"], self.options["key"])

    def reader(self, schema: StructType):
        return self._opened(PrunedReader if str(self.options.get("prune", "")).lower() == "true" else PagesReader, schema)

    def streamReader(self, schema: StructType):
        return self._opened(PagesStream, schema)


def land_pages(rows: DataFrame, key: str, path: str, span: int = 10_000, page: int = 1000, first: int = 0, held_back=None, short=None) -> DataFrame:
    """Write rows as the pages that a service would answer, a range of `span` ids a task; one row a range: number, pages, by_id.

    held_back is a condition on rows that pages leave out and a batch by id holds; short(offset) makes a page as short as the service pleases.
    """
    number = F.floor((F.col(key) - first) / span)
    asked = rows.select(number.cast("long").alias("__range"), (held_back if held_back is not None else F.lit(False)).alias("__back"), *rows.columns)

    def land(table: pa.Table) -> pa.Table:
        n = table.column("__range")[0].as_py()
        records = sorted(table.drop_columns(["__range"]).to_pylist(), key=lambda r: r[key])
        folder = f"{path}/range-{n}-{first + n * span}-{first + (n + 1) * span - 1}"
        answer = lambda some: json.dumps({"features": [{"attributes": {k: v for k, v in r.items() if k != "__back"}} for r in some]}, default=str).encode()
        paged, back = [r for r in records if not r["__back"]], [r for r in records if r["__back"]]
        offset = pages = 0
        while offset < len(paged):
            some = paged[offset : offset + (min(page, max(1, short(offset))) if short else page)]
            write_bytes(f"{folder}/page-{offset}.json", answer(some))
            offset, pages = offset + len(some), pages + 1
        write_bytes(f"{folder}/ids.json", json.dumps([r[key] for r in records]).encode())
        for k in range(0, len(back), page):
            write_bytes(f"{folder}/batch-{k // page}.json", answer(back[k : k + page]))
        return pa.table({"number": [n], "pages": [pages], "by_id": [len(back)]})

    return asked.groupBy("__range").applyInArrow(land, "number long, pages long, by_id long")
