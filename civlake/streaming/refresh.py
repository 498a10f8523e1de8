"""Incremental refresh of reports: the same rules over a stream as over a batch.

A sink's step gets a batch and its number, and writes under that number: a batch that is run again, after a failure or on purpose, writes the same again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from civlake.sources.rolls import replacement


def plausible(events: DataFrame, ts: str, first: str, as_of: str) -> DataFrame:
    """Events dated from `first` to `as_of`. A single date far in the future would move a watermark past all others, so this goes before one."""
    at = F.col(ts).cast("timestamp")
    return events.filter((at >= F.lit(first).cast("timestamp")) & (at <= F.lit(as_of).cast("timestamp")))


def implausible_counts(events: DataFrame, ts: str, first: str, as_of: str) -> DataFrame:
    """why, n of the events that plausible() leaves out: undated, early and late ones."""
    at = F.col(ts).cast("timestamp")
    why = F.when(at.isNull(), "undated").when(at < F.lit(first).cast("timestamp"), "early").when(at > F.lit(as_of).cast("timestamp"), "late")
    return events.withColumn("why", why).filter("why is not null").groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def daily_counts(events: DataFrame, ts: str, key: str, late: str = "2 days", first: str | None = None, as_of: str | None = None) -> DataFrame:
    """day, key, n by tumbling days; on a stream, rows later than the watermark are dropped. With `first` and `as_of`, implausible dates are left out before it."""
    at = plausible(events, ts, first, as_of) if first and as_of else events
    at = at.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark(ts, late)
    out = at.groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("day"), key, "n")


def latest_rows(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, held as state on a stream (complete or update mode)."""
    rest = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take in all that has arrived, then stop; a restart with the same checkpoint takes each file once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def merge_into(path: str, keys: list[str], order: list[str]):
    """A foreachBatch function that keeps the latest row of each key in a folder of Parquet versions, one a batch.

    A batch that is run again writes its version again, so that the result is the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_rows(batch, keys, order)
        if number > 0:
            new = latest_rows(spark.read.parquet(f"{path}/v{number - 1}").unionByName(new), keys, order)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return merge


def guarded(path: str, info, publish):
    """A foreachBatch function that passes a batch on to publish(batch, info) only if it is new: not the bytes of the last one, nor older.

    info(batch) gives {"sha256", "latest"}; what was published last is kept beside the data as JSON, so that a restart knows it.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        new = info(batch)
        try:
            old = spark.read.schema("sha256 string, latest string, number long").json(f"{path}/published").orderBy(F.desc("number")).first()
        except AnalysisException:
            old = None
        if replacement(old.asDict() if old else None, new) == "replace":
            publish(batch, new)
            spark.createDataFrame([(new["sha256"], new["latest"], number)], "sha256 string, latest string, number long").coalesce(1).write.mode("append").json(f"{path}/published")

    return step


def _numbered(path: str, number: int) -> str:
    return f"{path}/batch={number}"


def once_each(path: str, keys: list[str]):
    """A function (batch, number) that gives the rows of a batch whose keys no batch before it had, each once, and keeps the keys under the batch's number."""

    def fresh(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        own = batch.dropDuplicates(keys)
        taken = versions(spark, path, ", ".join(f"`{k}` {batch.schema[k].dataType.simpleString()}" for k in keys)).filter(F.col("batch") < number)
        new = own.join(taken.select(*keys), keys, "left_anti")
        new.select(*keys).write.mode("overwrite").parquet(_numbered(path, number))
        return spark.read.schema(own.select(*keys).schema).parquet(_numbered(path, number)).join(own, keys).select(*batch.columns)

    return fresh


def admitted(rows: DataFrame, fresh, path: str, checkpoint: str) -> StreamingQuery:
    """Pass on what is new of a stream, as a folder a batch at `path` (to be read with recursiveFileLookup); a file that lands a second time adds nothing."""

    def step(batch: DataFrame, number: int) -> None:
        # a batch's files go in at once: a batch run again after that changes nothing
        fresh(batch, number).write.mode("overwrite").parquet(f"{path}.batches/{number}")
        _moved(batch.sparkSession, f"{path}.batches/{number}", f"{path}/batch-{number:09d}")

    _folder(rows.sparkSession, path)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _folder(spark, path: str) -> None:
    store, at = _fs(spark, path)
    store.mkdirs(at)


def _moved(spark, folder: str, to: str) -> None:
    """A written folder under its own name, once; one that is there already stays."""
    store, at = _fs(spark, to)
    if store.exists(at):
        store.delete(_fs(spark, folder)[1], True)
    else:
        store.rename(_fs(spark, folder)[1], at)


def upserted(counts: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Changed rows of an aggregate, a folder a batch; of a key's rows the one of the latest batch holds."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.groupBy(*keys).count().filter("count > 1").isEmpty():
            batch.write.mode("overwrite").parquet(_numbered(path, number))
        else:
            raise ValueError(f"batch {number} has several rows of one key")

    return counts.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def beside(rows: DataFrame, ts: str, first: str, as_of: str, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of implausible rows, a folder a batch."""

    def step(batch: DataFrame, number: int) -> None:
        implausible_counts(batch, ts, first, as_of).write.mode("overwrite").parquet(_numbered(path, number))

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark, path: str, schema: str) -> DataFrame:
    """All batches' rows with their batch; none if nothing has been written."""
    store, at = _fs(spark, path)
    if not store.exists(at):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(path)


def replay_last(spark, checkpoint: str) -> int:
    """Take back the mark that a stopped stream's last batch is done, so that the next start runs it again; its number, -1 if there was none."""
    store, at = _fs(spark, f"{checkpoint}/commits")
    numbers = [int(f.getPath().getName()) for f in store.listStatus(at) if f.getPath().getName().isdigit()] if store.exists(at) else []
    if numbers:
        store.delete(_fs(spark, f"{checkpoint}/commits/{max(numbers)}")[1], False)
    return max(numbers, default=-1)
