import json

from pyspark.sql import functions as F

from trajspark.operators.manifest import apply_splits, latest_wins
from trajspark.sources import manifests
from trajspark.streaming import jobs


def test_manifest_ingest_equals_batch_over_growing_files(spark, tmp_path):
    root = tmp_path / "csvs" / "forests"
    root.mkdir(parents=True)

    def add(k, n):
        body = "".join(f"{0.1 * i!r},{0.3 * i!r},0.0,0.0\n" for i in range(n))
        (root / f"forest_{k:03d}_f0_g_s{k // 2}.csv").write_text("time,sol_x_0,sol_x_1,sol_x_2\n" + body)

    def build(paths):
        from trajspark.operators.manifest import measure, with_identity
        from trajspark.sources.corpus import scan_csv, to_steps

        scan = scan_csv(spark, list(paths), manifests.MEASURED)
        m = measure(to_steps(scan.rows), "csv_path").withColumn(
            "stem", F.regexp_extract("csv_path", r"([^/]+)\.csv$", 1)
        )
        return apply_splits(with_identity(m), 0).drop("csv_path")

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for first in (0, 3):
        for k in range(first, first + 3):
            add(k, 30 + k)
        jobs.ingest_manifest(spark, str(root.parent), out, state, build, files_per_trigger=2)
    stream = jobs.current_table(spark, out, "stem")
    batch = build([str(root)])
    assert stream.count() == 6
    cols = sorted(batch.columns)
    assert stream.select(cols).exceptAll(batch.select(cols)).isEmpty()


def test_solve_info_merge_keeps_the_latest(spark, tmp_path):
    src = tmp_path / "info"
    src.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    waves = [[("x", "bad"), ("y", "bad"), ("x", "mid")], [("x", "good"), ("z", "good")]]
    for k, wave in enumerate(waves):
        (src / f"{k}.jsonl").write_text("\n".join(json.dumps({"stem": s, "solver_status": v}) for s, v in wave))
        jobs.merge_solve_info(spark, str(src), out, state)
    got = {r["stem"]: r["solver_status"] for r in jobs.current_table(spark, out, "stem").collect()}
    assert got == {"x": "good", "y": "bad", "z": "good"}
    batch = manifests.read_solve_info(spark, [str(src / f"{k}.jsonl") for k in range(2)])
    assert {r["stem"]: r["solver_status"] for r in batch.collect()} == got


def test_collapse_monitor_keeps_the_first_trigger(spark, tmp_path):
    rows = spark.range(200).select(
        F.concat(F.lit("r"), F.col("id") % 5).alias("run"), F.col("id").alias("epoch"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(9)) == 0, 1.0).otherwise(5.0).alias("effective_rank"),
        F.lit(24).alias("latent_dim"), F.lit(1.0).alias("variance_mean"), F.lit(1.0).alias("pairwise_distance_mean"),
    )
    src = str(tmp_path / "log")
    rows.repartition(6).write.parquet(src)
    stream = jobs.table_stream(spark, src, files_per_trigger=2)
    out = str(tmp_path / "out")
    jobs.run_available(jobs.first_collapse(stream), out, str(tmp_path / "state"))
    got = jobs.current_table(spark, out, "run")
    want = jobs.first_collapse(rows)
    assert len({r["batch_id"] for r in spark.read.parquet(out).select("batch_id").distinct().collect()}) > 1
    assert got.select("run", "epoch", "reasons").exceptAll(want).isEmpty() and got.count() == want.count()


def test_running_latest_matches_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), F.xxhash64("id").alias("v"))
    rows.repartition(5).write.parquet(str(tmp_path / "t"))
    stream = jobs.table_stream(spark, str(tmp_path / "t"), files_per_trigger=1)
    out = str(tmp_path / "out")
    jobs.run_available(jobs.running_latest(stream, "k", F.col("seq"), ["v"]), out, str(tmp_path / "state"))
    want = latest_wins(rows, "k", ["seq"]).select("k", "v")
    assert jobs.current_table(spark, out, "k").select("k", "v").exceptAll(want).isEmpty()


def test_progress_callback(spark, tmp_path):
    seen = []
    listener = jobs.ProgressCallback(lambda batch, rows: seen.append(rows))
    spark.streams.addListener(listener)
    try:
        spark.range(50).write.parquet(str(tmp_path / "t"))
        jobs.run_available(jobs.table_stream(spark, str(tmp_path / "t")), str(tmp_path / "o"), str(tmp_path / "s"), mode="append")
        import time

        for _ in range(50):
            if sum(seen) == 50:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(seen) == 50


def test_compaction_and_replay(spark, tmp_path):
    out = str(tmp_path / "t")

    def write(batch, rows):
        spark.createDataFrame(rows, "k string, v int").write.mode("overwrite").parquet(f"{out}/batch_id={batch}")

    def read():
        return {r["k"]: r["v"] for r in jobs.current_table(spark, out, "k").collect()}

    write(0, [("a", 0), ("b", 0)])
    write(1, [("a", 1)])
    assert jobs.compact(spark, out, "k") == 1 and jobs.compact(spark, out, "k") == 1
    assert read() == {"a": 1, "b": 0}
    write(2, [("b", 2), ("c", 2)])
    write(2, [("b", 2), ("c", 2)])  # the last batch again
    assert read() == {"a": 1, "b": 2, "c": 2}
    assert jobs.compact(spark, out, "k") == 2 and read() == {"a": 1, "b": 2, "c": 2}


def epochs(spark, rows):
    """(run, epoch, minutes, rank) as a log of epochs."""
    table = spark.createDataFrame(rows, "run string, epoch long, minute long, effective_rank double")
    return table.select(
        "run", "epoch", F.timestamp_seconds((F.col("minute") + 10_000) * 60).alias("time"), "effective_rank",
        F.lit(24).alias("latent_dim"), F.lit(1.0).alias("variance_mean"), F.lit(1.0).alias("pairwise_distance_mean"),
    )


def test_alarm_once_per_run_with_restarts_and_expiry(spark, tmp_path):
    """Each append is drained by a query of its own, so the state goes through a restart every time."""
    from datetime import timedelta

    src, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    appends = [
        [("a", 1, 0, 5.0), ("b", 1, 0, 1.0), ("b", 2, 1, 1.5)],
        [("a", 2, 5, 1.0), ("a", 3, 6, 0.5), ("b", 3, 6, 1.0), ("c", 1, 6, 9.0)],
        [("a", 4, 9, 0.1), ("late", 1, 1, 0.1), ("c", 2, 9, 1.0)],
        [("d", 1, 500, 9.0)],  # the watermark passes the last epochs of a, b and c
        [("d", 2, 501, 9.0), ("late", 2, 2, 0.1)],  # hours behind: dropped
        [("a", 9, 502, 0.2)],  # a run come back after its state has expired
    ]
    left = []
    for rows in appends:
        epochs(spark, rows).coalesce(1).write.mode("append").parquet(src)
        with jobs.keyed_state(spark):
            alarms = jobs.collapse_alarms(jobs.table_stream(spark, src), delay="20 minutes", ttl=timedelta(minutes=60))
            query = jobs.run_available(alarms, out, state, mode="append")
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r["run"], r["epoch"], r["reasons"]) for r in spark.read.parquet(out).collect())
    why = "effective_rank"
    assert got == [("a", 2, why), ("a", 9, why), ("b", 1, why), ("c", 2, why), ("late", 1, why)]
    assert max(left[:3]) > 0 and left[4] < max(left[:3])  # nothing is kept for runs that are over or never tripped


def test_runs_share_state_but_not_alarms(spark, tmp_path):
    """Calls to the state store grow with the buckets; runs of a bucket alarm and expire each for itself."""
    from datetime import timedelta

    src, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    appends = [
        [(f"r{k}", 1, k % 3, 1.0) for k in range(300)] + [(None, 7, 0, 1.0), ("quiet", 1, 0, 9.0)],
        [(f"r{k}", 2, 50, 1.0) for k in range(0, 300, 2)] + [(None, 8, 50, 1.0), ("none", None, 50, 1.0)],
        [("w", 1, 100, 9.0)],  # the odd runs are over, the even ones and the one without a name are not
        [(f"r{k}", 3, 101, 1.0) for k in range(300)] + [(None, 9, 101, 1.0), ("quiet", 2, 101, 1.0)],
    ]
    kept = []
    for rows in appends:
        epochs(spark, rows).repartition(3).write.mode("append").parquet(src)
        with jobs.keyed_state(spark):
            alarms = jobs.collapse_alarms(jobs.table_stream(spark, src), delay="20 minutes", ttl=timedelta(minutes=60), buckets=2)
            query = jobs.run_available(alarms, out, state, mode="append")
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r["run"] or "", r["epoch"]) for r in spark.read.parquet(out).collect())
    odd = [(f"r{k}", e) for k in range(1, 300, 2) for e in (1, 3)]
    assert got == sorted([("", 7), ("none", None), ("quiet", 2), *odd, *((f"r{k}", 1) for k in range(0, 300, 2))])
    assert max(kept) <= 2 * 3  # of a bucket: its runs, its timer by key and by time


def test_runs_keep_their_type(spark, tmp_path):
    big = 2**60 + 1
    rows = epochs(spark, [("x", 1, 0, 1.0)]).crossJoin(spark.createDataFrame([(big,), (big + 1,), (None,)], "number long"))
    for name, run in (("long", F.col("number")), ("binary", F.unhex(F.concat(F.lit("FF"), F.hex("number"))))):
        src, out, state = (str(tmp_path / f"{name}-{n}") for n in ("log", "out", "state"))
        want = rows.withColumn("run", run)
        want.write.parquet(src)
        with jobs.keyed_state(spark):
            jobs.run_available(jobs.collapse_alarms(jobs.table_stream(spark, src)), out, state, mode="append")
        got = spark.read.parquet(out).select("run", "epoch")
        assert got.schema["run"].dataType == want.schema["run"].dataType
        assert got.exceptAll(want.select("run", "epoch")).isEmpty() and got.count() == 3
