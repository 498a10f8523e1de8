"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the operators on words see it, as a Java and RE2 class body.
SPACE = r"\x20\x09-\x0D"
#: No slice of a batch that goes through numpy holds more text than this, but for a single longer row.
SLICE_BYTES = 8 << 20
#: Whether a write that ends drops the shuffle files it made.
_DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where the run that is under way in this thread notes the folders it writes; none if no run asked for it.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A key with more rows than this, and more than one in HOT_KEYS of all rows, is hot; so there are at most HOT_KEYS of them.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one is set in local mode (tests); on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="civlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and is computed once."""
    return stashed(df, name)[0]


def stashed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """stash(), and the folder it wrote."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _dropping_shuffles(spark):
        df.write.parquet(path)
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def _dropping_shuffles(spark: SparkSession):
    """Shuffle files of what is written in this block go when the write ends, not when the driver happens to collect its garbage; nothing reads them again."""
    before = spark.conf.get(_DROPS, "false")
    if before == "true":  # by the user, or by another thread's write
        yield
        return
    spark.conf.set(_DROPS, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROPS, before)


@contextmanager
def noting():
    """The folders that stash() writes in this block and thread, as a list that grows; those of other threads and runs are not in it."""
    before, own = _NOTED.get(), []
    token = _NOTED.set(own)
    try:
        yield own
    finally:
        _NOTED.reset(token)
        if before is not None:
            before.extend(own)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that stash() wrote, once nothing reads them any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int, largest: int | None = None) -> DataFrame:
    """The inner join of rows and keyed, which has one row a key and tells in the column `size` how many of the rows have it.

    Keys with more than HOT_ROWS rows and more than one in HOT_KEYS of all `total` rows are at most HOT_KEYS; these are broadcast, so
    that their rows are not shuffled and never meet in one task. The others are joined by a shuffle; so are all, without a broadcast, if even
    `largest`, which no size exceeds, is not hot. Without `largest` it is not asked.
    """
    most = max(HOT_ROWS, total // HOT_KEYS)
    if largest is not None and largest <= most:
        return rows.join(keyed.hint("merge"), keys)
    hot, cold = keyed.filter(F.col(size) > most), keyed.filter(F.col(size) <= most)
    apart = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(apart.join(cold.hint("merge"), keys))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `limit` bytes of the column's text and at most so many rows."""
    _, offsets = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as its bytes and offsets (null: empty); the offsets start at 0."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def pieces_of(total_bytes: int, each: int, most: int = 1 << 16) -> int:
    """How many groups of about `each` bytes hold the total."""
    return int(min(max(1, -(-total_bytes // each)), most))
