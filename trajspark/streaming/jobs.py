"""Structured Streaming jobs over inputs that grow: manifest ingest, latest-wins merge, collapse monitor.

Every micro-batch is written under its own ``batch_id`` folder with overwrite, so a replayed batch
replaces itself. The current table is the latest record per key over those folders; ``compact`` folds
them into one table from time to time, so reads do not grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trajspark.operators.diagnostics import collapse_alarm
from trajspark.operators.manifest import latest_wins
from trajspark.schema import SOLVE_INFO


def table_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over a Parquet file or folder. The bracketed last letter makes Spark treat it as a pattern."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    transform: Callable[[DataFrame, int], DataFrame] | None = None,
    mode: str = "update",
) -> StreamingQuery:
    """Process everything available now into ``out/batch_id=N`` folders, then stop."""

    def save(batch: DataFrame, batch_id: int) -> None:
        done = transform(batch, batch_id) if transform else batch
        done.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()
    return query


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers N of the ``folder/name=N`` folders, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
    return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{name}="))


def _merged(spark: SparkSession, out: str, key: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Latest record per key with its batch_id, from the newest compaction and the batches after it."""
    bases = _numbers(spark, f"{out}/_base", "upto")
    upto = bases[-1] if bases else -1
    batches = [n for n in _numbers(spark, out, "batch_id") if n > upto]
    parts = [spark.read.parquet(f"{out}/_base/upto={upto}")] if bases else []
    if batches:
        paths = [f"{out}/batch_id={n}" for n in batches]
        parts.append(spark.read.option("basePath", out).parquet(*paths).withColumn("batch_id", F.col("batch_id").cast("long")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return latest_wins(rows, key, ["batch_id", *order]), max([upto, *batches])


def current_table(spark: SparkSession, out: str, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Latest record per key over all batches written so far."""
    return _merged(spark, out, key, order)[0].drop("batch_id")


def compact(spark: SparkSession, out: str, key: str, order: Sequence[str] = ()) -> int:
    """Folds the batches so far into one table, which later reads start from; returns the last batch folded.

    A compaction never changes batch folders, so a replay of an older batch after it has no effect and a
    lost compaction can be made again. Batches up to the returned number may be deleted.
    """
    rows, upto = _merged(spark, out, key, order)
    if upto not in _numbers(spark, f"{out}/_base", "upto"):
        rows.write.parquet(f"{out}/_base/upto={upto}")
    return upto


def ingest_manifest(
    spark: SparkSession,
    csv_glob: str,
    out: str,
    checkpoint: str,
    build: Callable[[Sequence[str]], DataFrame],
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Add manifest records of files that arrived since the last run.

    Only paths are streamed (file contents are pruned), at most ``files_per_trigger`` per batch;
    ``build`` scans those paths. The hash split is stateless, so arrival order cannot change it.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(csv_glob)
        .select("path", "length")
    )

    def batch(df: DataFrame, batch_id: int) -> DataFrame:
        return build([r["path"] for r in df.select("path").collect()])  # bounded by the trigger limit

    return run_available(files, out, checkpoint, batch, mode="append")


def merge_solve_info(
    spark: SparkSession, json_dir: str, out: str, checkpoint: str, files_per_trigger: int | None = None
) -> StreamingQuery:
    """Latest solver record per stem within each batch; later batches win in ``current_table``."""
    reader = spark.readStream.schema(SOLVE_INFO)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.json(json_dir).select(
        "*",
        F.col("_metadata.file_modification_time").alias("_time"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
    )

    def batch(df: DataFrame, batch_id: int) -> DataFrame:
        order = ["_time", "_path", "_block", "_line"]
        return latest_wins(
            df.withColumn("_line", F.monotonically_increasing_id()), "stem", order
        ).drop(*order)

    return run_available(lines, out, checkpoint, batch, mode="append")


def running_manifest(rows: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Mergeable per-key measurements of a row stream: counts, time bounds and the last record id."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n_timesteps"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.max(order).alias("last_id"),
    )


def running_latest(rows: DataFrame, key: str, order: Column, fields: Sequence[str]) -> DataFrame:
    """Latest record per key by an ingest sequence, as a streaming aggregate."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_r")).select(key, "_r.*")


def first_collapse(log: DataFrame, run: str = "run", **thresholds) -> DataFrame:
    """First epoch that trips the alarm per run, with its reasons. Works on batch and streaming input.

    The log carries effective_rank, latent_dim, variance_mean and pairwise_distance_mean columns.
    """
    alarms = collapse_alarm(log, **{"distance": "pairwise_distance_mean", **thresholds}).where("triggered")
    return (
        alarms.groupBy(run)
        .agg(F.min_by(F.struct("epoch", "reasons"), F.col("epoch")).alias("_f"))
        .select(run, "_f.epoch", "_f.reasons")
    )


#: Groups of runs whose state is read and written together. A stream's state is bound to the number it began with.
BUCKETS = 1024
#: Stands for a missing epoch, which comes after all others.
NO_EPOCH = 2**63 - 1


class CollapseMonitor(StatefulProcessor):
    """One alarm per run: state exists for runs that have alarmed, until ``ttl`` after their last epoch.

    The earliest tripped epoch of the batch that first trips is the alarm; later epochs of the run only move
    its time on. When the watermark passes that, the run is forgotten, and would alarm again.

    A key is a bucket of runs, so calls to the state store grow with buckets and batches, not with runs. Its timer is
    at or before the first of its runs' times, and is set anew when it fires.
    """

    def __init__(self, ttl: timedelta, run: str = "run"):
        self.ttl, self.run = int(ttl.total_seconds() * 1000), run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarmed = handle.getValueState("alarmed", "timer long, runs array<string>, until array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, *known = self.alarmed.get() or (None, (), ())
        until = dict(zip(*known))
        latest, first = {}, {}
        for part in rows:
            for run, epoch, at, why in zip(*(part[c].tolist() for c in (self.run, "epoch", "at_ms", "why"))):
                run = run if isinstance(run, str) else None
                latest[run] = max(latest.get(run, 0), at)
                if why and (run not in first or epoch < first[run][0]):
                    first[run] = epoch, why
        new = [run for run in first if run not in until]
        moved = {run: at + self.ttl for run, at in latest.items() if (run in until or run in first) and at + self.ttl > until.get(run, 0)}
        if moved:
            until.update(moved)
            soonest = min(moved.values())
            if timer is None or soonest < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(soonest)
                timer = soonest
            self.alarmed.update((timer, list(until), list(until.values())))
        if new:
            epochs, reasons = zip(*(first[run] for run in new))
            yield pd.DataFrame({self.run: new, "epoch": epochs, "reasons": reasons})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        _, *known = self.alarmed.get()
        until = {run: t for run, t in zip(*known) if t > passed}
        if until:
            timer = min(until.values())
            self.handle.registerTimer(timer)
            self.alarmed.update((timer, list(until), list(until.values())))
        else:
            self.alarmed.clear()
        yield from ()


def collapse_alarms(
    log: DataFrame,
    run: str = "run",
    time: str = "time",
    delay: str = "1 hour",
    ttl: timedelta = timedelta(days=7),
    buckets: int = BUCKETS,
    **thresholds,
) -> DataFrame:
    """run, epoch, reasons (comma-joined) of each run's alarm, emitted once, over a stream of epochs.

    ``time`` is an epoch's event time: epochs later than ``delay`` behind the stream are dropped, and a run is
    forgotten ``ttl`` after its last epoch, so state does not grow with the runs of the past. Start the query
    inside ``keyed_state``.
    """
    flagged = collapse_alarm(log.withWatermark(time, delay), **{"distance": "pairwise_distance_mean", **thresholds})
    kind = log.schema[run].dataType
    binary = kind.typeName() == "binary"
    slim = flagged.select(
        F.pmod(F.xxhash64(run), F.lit(buckets)).alias("bucket"),
        (F.base64(run) if binary else F.col(run).cast("string")).alias(run),
        F.coalesce(F.col("epoch").cast("long"), F.lit(NO_EPOCH)).alias("epoch"),
        time,
        F.coalesce(F.unix_millis(time), F.lit(0)).alias("at_ms"),
        F.array_join("reasons", ",").alias("why"),
    )
    alarms = slim.groupBy("bucket").transformWithStateInPandas(
        CollapseMonitor(ttl, run), outputStructType=f"`{run}` string, epoch long, reasons string", outputMode="append", timeMode="eventTime"
    )
    return alarms.select(
        (F.unbase64(run) if binary else F.col(run).cast(kind)).alias(run), F.nullif("epoch", F.lit(NO_EPOCH)).alias("epoch"), "reasons"
    )


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB, as timers and typed state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class ProgressCallback(StreamingQueryListener):
    """Calls ``on_result(batch_id, rows)`` after every micro-batch."""

    def __init__(self, on_result: Callable[[int, int], None]):
        self.on_result = on_result

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.on_result(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
