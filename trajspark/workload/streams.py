"""Streaming queries: each drains the table through Structured Streaming and returns the final state."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from trajspark.functions.hashing import split_of, unit_md5
from trajspark.plans.scratch import scratch_path
from trajspark.streaming import jobs
from trajspark.workload.registry import query
from trajspark.workload.views import SPLIT_SQL, unit_sql, utc_micros


BATCHES = 4


def _drain(spark, stream, key, mode="update"):
    out = scratch_path(spark, "stream")
    jobs.run_available(stream, f"{out}/table", f"{out}/state", mode=mode)
    jobs.compact(spark, f"{out}/table", key)
    return jobs.current_table(spark, f"{out}/table", key)


def _events(spark, sf):
    """The events in order of their ids, as files that arrive one per batch."""
    path = scratch_path(spark, "arrivals")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.repartitionByRange(BATCHES, "event_id").write.parquet(path)
    return jobs.table_stream(spark, path, files_per_trigger=1)


@query(
    "stream_manifest",
    f"""SELECT user_id AS stem, count(*) AS n_timesteps, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
  max(event_id) AS last_id, {SPLIT_SQL.format(u=unit_sql("user_id"))} AS split FROM events GROUP BY user_id""",
)
def stream_manifest(spark, sf):
    rows = _events(spark, sf).withColumnRenamed("user_id", "stem")
    done = _drain(spark, jobs.running_manifest(rows, "stem", "ts", "event_id"), "stem")
    return done.select(
        "stem", "n_timesteps", utc_micros(done, "first_time").alias("first_us"),
        utc_micros(done, "last_time").alias("last_us"), "last_id",
        split_of(unit_md5(F.col("stem"), 0)).alias("split"),
    )


@query(
    "stream_latest_wins",
    """SELECT user_id AS stem, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
FROM events GROUP BY user_id""",
)
def stream_latest_wins(spark, sf):
    rows = _events(spark, sf).withColumnRenamed("user_id", "stem")
    return _drain(
        spark, jobs.running_latest(rows, "stem", F.col("event_id"), ["event_type", "value"]), "stem"
    )


@query(
    "stream_collapse",
    """WITH a AS (SELECT user_id AS run, event_id AS epoch, concat_ws(',', CASE WHEN value / 10 < 2 THEN 'effective_rank' END,
   CASE WHEN value / 1e7 < 1e-6 THEN 'variance_mean' END, CASE WHEN value / 1e5 < 1e-4 THEN 'pairwise_distance_mean' END) AS reasons
   FROM events)
SELECT run, min(epoch) AS epoch, arg_min(reasons, epoch) AS reasons FROM a WHERE reasons <> '' GROUP BY run""",
)
def stream_collapse(spark, sf):
    """Epochs that arrive in four parts, in order; each part is drained by a query that resumes the one before."""
    out = scratch_path(spark, "alarms")
    events = spark.read.parquet(f"{sf}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * BATCHES / F.lit(last + 1))
    value = F.col("value")
    for k in range(BATCHES):
        events.where(part == k).write.mode("append").parquet(f"{out}/log")
        log = jobs.table_stream(spark, f"{out}/log").select(
            F.col("user_id").alias("run"),
            F.col("event_id").alias("epoch"),
            F.col("ts").cast("timestamp").alias("time"),
            (value / 10).alias("effective_rank"),
            F.lit(24).alias("latent_dim"),
            (value / 1e7).alias("variance_mean"),
            (value / 1e5).alias("pairwise_distance_mean"),
        )
        with jobs.keyed_state(spark):
            alarms = jobs.collapse_alarms(log, delay="36500 days", ttl=timedelta(days=36500))  # no epoch is late
            jobs.run_available(alarms, f"{out}/table", f"{out}/state", mode="append")
    return spark.read.parquet(f"{out}/table").select("run", "epoch", "reasons")


@query(
    "stream_solve_info",
    """SELECT 's' || user_id AS stem, arg_max(event_type, event_id) AS solver_status, arg_max(value, event_id) AS solve_time_s
FROM events GROUP BY user_id""",
)
def stream_solve_info(spark, sf):
    """Solver records that arrive as files in three batches; each is merged by a run of its own."""
    root = scratch_path(spark, "sidecars")
    events = spark.read.parquet(f"{sf}/events.parquet")
    last = events.agg(F.max("event_id")).first()[0] or 0
    batch = F.floor(F.col("event_id") * 3 / F.lit(last + 1))
    for k in range(3):
        rows = events.where(batch == k).select(
            F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("stem"), F.col("event_type").alias("solver_status"),
            F.col("value").alias("solve_time_s"), "event_id",
        )
        # a file's lines are its records in order
        rows.repartitionByRange(1, "event_id").sortWithinPartitions("event_id").drop("event_id").write.mode("append").json(f"{root}/in")
        jobs.merge_solve_info(spark, f"{root}/in", f"{root}/table", f"{root}/state")
    jobs.compact(spark, f"{root}/table", "stem")
    return jobs.current_table(spark, f"{root}/table", "stem").select("stem", "solver_status", "solve_time_s")
