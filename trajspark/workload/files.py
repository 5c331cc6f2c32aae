"""File round trips: the tables are written in each supported layout and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions.flatmap import flat_map
from trajspark.operators import dataset, report
from trajspark.operators.windows import WindowConfig, extract_windows
from trajspark.plans.scratch import scratch_path
from trajspark.sources import corpus, manifests
from trajspark.workload.manifests import log_lines
from trajspark.workload.motion import TARGETS_SQL
from trajspark.workload.registry import q6, query, r6
from trajspark.workload.views import EPOCHS, MANIFEST_SQL, PHYS, RUNS, epoch_log, manifest_view, phys_steps, run_results, table


@query(
    "csv_scan_by_name",
    f"""WITH {PHYS} SELECT count(*) AS n, {q6("sum(time)", 4)} AS time, {q6("sum(p0)", 4)} AS x, {q6("sum(p1)", 4)} AS y,
  {q6("sum(p2)", 4)} AS z, 0 AS bad_files FROM ph""",
)
def csv_scan_by_name(spark, sf):
    """Columns in another order and with an extra one still land under their own names."""
    path = scratch_path(spark, "csv")
    steps = phys_steps(spark, sf).select(
        F.col("p")[2].alias("sol_x_2"), "time", "step", F.col("p")[0].alias("sol_x_0"),
        F.col("p")[1].alias("sol_x_1"),
    )
    manifests.write_table_csv(steps, path)
    scan = corpus.scan_csv(spark, [path], manifests.MEASURED)
    totals = scan.rows.agg(
        F.count("*").alias("n"),
        *[r6(F.sum(c), 4).alias(k) for c, k in zip(manifests.MEASURED, ("time", "x", "y", "z"))],
    )
    return totals.withColumn("bad_files", F.lit(scan.bad_files.count()).cast("int"))


@query(
    "csv_scan_mixed_headers",
    f"""WITH {PHYS}, k AS (SELECT time, p0, p1, p2 FROM ph WHERE step % 4 < 2)
SELECT count(*) AS n, {q6("sum(time)", 4)} AS time, {q6("sum(p0)", 4)} AS x, {q6("sum(p1)", 4)} AS y,
  {q6("sum(p2)", 4)} AS z, 1 AS short_files, 1 AS text_files FROM k""",
)
def csv_scan_mixed_headers(spark, sf):
    """Two good layouts, files without a column (a quarter of the steps) and files with a text cell (another)."""
    root = scratch_path(spark, "mixed")
    p = {f"sol_x_{i}": F.col("p")[i] for i in range(3)}
    steps = phys_steps(spark, sf).select("time", "step", *[v.alias(k) for k, v in p.items()])
    quarter = F.col("step") % 4
    layouts = {
        "a": ["time", "sol_x_0", "sol_x_1", "sol_x_2"],
        "b": ["step", "sol_x_2", "time", "sol_x_1", "sol_x_0"],
        "short": ["time", "sol_x_0", "sol_x_2"],
        "text": ["time", "sol_x_0", F.lit("none").alias("sol_x_1"), "sol_x_2"],
    }
    for k, (name, columns) in enumerate(layouts.items()):
        manifests.write_table_csv(steps.where(quarter == k).select(*columns), f"{root}/{name}")
    scan = corpus.scan_csv(spark, [root], manifests.MEASURED)
    totals = scan.rows.agg(
        F.count("*").alias("n"),
        *[r6(F.sum(c), 4).alias(k) for c, k in zip(manifests.MEASURED, ("time", "x", "y", "z"))],
    )
    kinds = [r["kind"] for r in scan.bad_files.select(
        F.concat_ws("|", F.element_at(F.split("csv_path", "/"), -2), F.regexp_extract("error", "(missing|not numeric)", 1)).alias("kind")
    ).distinct().collect()]
    return totals.withColumns({
        "short_files": F.lit(int("short|missing" in kinds)), "text_files": F.lit(int("text|not numeric" in kinds)),
    })


@query(
    "manifest_roundtrip",
    f"""WITH {MANIFEST_SQL} SELECT stem, source, env_id, solver_status, iterations, {q6("path_length_m", 4)} AS path_length_m,
  n_timesteps, forest_type::BIGINT AS forest_type, env_seed::BIGINT AS env_seed, uid::VARCHAR AS uid FROM man""",
)
def manifest_roundtrip(spark, sf):
    """JSON lines out and in; ``uid`` is no manifest field, so it comes back inside ``extra``."""
    path = scratch_path(spark, "manifest")
    manifests.write_manifest(manifest_view(spark, sf), path)
    back = manifests.read_manifest(spark, path)
    return back.select(
        "stem", "source", "env_id", "solver_status", "iterations",
        r6("path_length_m", 4).alias("path_length_m"), "n_timesteps", "forest_type", "env_seed",
        F.col("extra")["uid"].alias("uid"),
    )


@query(
    "solve_info_files",
    """SELECT 's' || user_id AS stem, arg_max(event_type, event_id) AS solver_status, arg_max(value, event_id) AS solve_time_s
FROM events GROUP BY user_id""",
)
def solve_info_files(spark, sf):
    """Two appends to one sidecar, the second holding the later records, and a sidecar that does not exist."""
    root = scratch_path(spark, "solve")
    info = table(spark, sf, "events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("stem"),
        F.col("event_type").alias("solver_status"),
        F.col("value").alias("solve_time_s"),
        "event_id",
    )
    last = F.max("event_id")
    recent = info.groupBy("stem").agg(last.alias("event_id"))
    manifests.append_solve_info(info.join(recent, ["stem", "event_id"], "left_anti"), root)
    manifests.append_solve_info(info.join(recent, ["stem", "event_id"], "left_semi"), root)
    merged = manifests.read_solve_info(spark, [root, f"{root}-none"])
    return merged.select("stem", "solver_status", "solve_time_s")


@query(
    "solver_log_files",
    """SELECT count(*) AS n_solves, count(DISTINCT event_id) AS n_stems FROM events WHERE event_type = 'purchase'""",
)
def solver_log_files(spark, sf):
    """Log text written to files; every anchor line closes one solve."""
    path = scratch_path(spark, "logs")
    lines = log_lines(spark, sf)
    lines.sortWithinPartitions("log", "line_no").select("line").write.text(path)
    solves = manifests.solve_info_from_logs(spark, path)
    return solves.agg(F.count("*").alias("n_solves"), F.count_distinct("stem").alias("n_stems"))


@query(
    "dataset_roundtrip",
    f"""WITH {TARGETS_SQL} SELECT split, count(*) AS n_windows, {q6("avg(y[1])", 3)} AS v0, {q6("avg(y[22])", 3)} AS margin
FROM tg GROUP BY split""",
)
def dataset_roundtrip(spark, sf):
    """Normalised float windows on disk, read back per split and denormalised."""
    path = scratch_path(spark, "dataset")
    w = extract_windows(flat_map(phys_steps(spark, sf)), WindowConfig(), targets=True, carry=["split"])
    dataset.write_dataset(w, path)
    out = None
    for split in ("train", "val", "test"):
        data = dataset.WindowedDataset(spark, path, split).denormalised()
        row = data.groupBy("split").agg(
            F.count("*").alias("n_windows"),
            r6(F.avg(F.col("targets")[0]), 3).alias("v0"),
            r6(F.avg(F.col("targets")[21]), 3).alias("margin"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "results_roundtrip",
    f"""WITH {RUNS} SELECT target, arm, count(*) AS n, {q6("avg(r2)", 5)} AS r2 FROM long GROUP BY target, arm""",
)
def results_roundtrip(spark, sf):
    """Results as JSON arrays, one to a file, as runs leave them, packed as a run is about 1.6 KB of text."""
    path = scratch_path(spark, "results")
    manifests.write_result_arrays(run_results(spark, sf), path, compression="gzip")
    long = report.recovery_long(manifests.read_results(spark, path))
    return long.groupBy("target", "arm").agg(F.count("*").alias("n"), r6(F.avg("r2"), 5).alias("r2"))


@query(
    "epoch_log_scan",
    f"WITH {EPOCHS} SELECT run::VARCHAR AS run, count(*) AS epochs, {q6('min(loss)')} AS best FROM log WHERE stage = 1 GROUP BY run",
)
def epoch_log_scan(spark, sf):
    path = scratch_path(spark, "epochs")
    epoch_log(spark, sf).withColumn("run", F.col("run").cast("string")).write.json(path)
    log = manifests.read_epoch_log(spark, path, stage=1)
    return log.groupBy("run").agg(F.count("*").alias("epochs"), r6(F.min("val.loss")).alias("best"))


@query(
    "manifest_build",
    f"""WITH {PHYS}, f AS (SELECT 'a' AS sub, * FROM ph UNION ALL SELECT 'b' AS sub, * FROM ph WHERE step % 2 = 0),
d AS (SELECT *, sqrt((p0 - lag(p0) OVER w)**2 + (p1 - lag(p1) OVER w)**2 + (p2 - lag(p2) OVER w)**2) AS hop
      FROM f WINDOW w AS (PARTITION BY sub, stem ORDER BY step)),
m AS (SELECT sub, stem, count(*) AS n, max(time) - min(time) AS total, coalesce(sum(hop), 0e0) AS path FROM d GROUP BY sub, stem),
s AS (SELECT user_id AS stem, arg_max(event_type, event_id) AS status FROM events WHERE user_id % 3 <> 1 GROUP BY user_id)
SELECT sub AS subdir, 'maze_' || stem || '_x' AS stem, 'maze_' || stem AS env_id,
  CASE WHEN sub = 'b' AND stem % 5 = 0 THEN NULL ELSE n END AS n_timesteps,
  CASE WHEN sub = 'b' AND stem % 5 = 0 THEN NULL ELSE {q6("path", 4)} END AS path_length_m,
  CASE WHEN sub = 'b' AND stem % 5 = 0 THEN NULL ELSE status END AS solver_status, sub = 'a' AND stem % 3 = 0 AS has_params,
  CASE WHEN sub = 'b' AND stem % 5 = 0 THEN 'unknown' WHEN status IS NULL THEN 'unknown' ELSE 'solver_log' END AS status_source,
  sub = 'b' AND stem % 5 = 0 AS bad
FROM m LEFT JOIN s USING (stem)""",
)
def manifest_build(spark, sf):
    """One named CSV file per trajectory in two subfolders that share stems (one with every second step, where
    every fifth file lacks a column), parameter files for some, and solver records for most."""
    root = scratch_path(spark, "corpus")
    name = F.concat(F.lit("maze_"), F.col("stem").cast("string"), F.lit("_x"))
    steps = phys_steps(spark, sf).select("stem", name.alias("name"), "step", "time", *[F.col("p")[i].alias(f"sol_x_{i}") for i in range(3)])
    copies = F.explode(F.when(F.col("step") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    files = steps.withColumn("sub", copies)
    short = (F.col("sub") == "b") & (F.col("stem") % 5 == 0)
    layout = lambda c: F.when(F.col("step") == 0, F.concat(F.lit(",".join(c) + "\n"), F.concat_ws(",", *c))).otherwise(F.concat_ws(",", *c))
    line = F.when(short, layout(["time", "sol_x_0"])).otherwise(layout(["sol_x_2", "time", "sol_x_0", "sol_x_1"]))
    corpus.write_files(files.select("sub", "name", F.col("step").alias("at"), line.alias("value")), f"{root}/csv", "csv")
    params = files.where("sub = 'a' AND stem % 3 = 0 AND step = 0")
    corpus.write_files(params.select("sub", "name", F.col("step").alias("at"), F.lit("mass_quad: 1").alias("value")), f"{root}/params", "yaml")
    events = table(spark, sf, "events").where("user_id % 3 <> 1")
    last = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("solver_status"))
    manifests.append_solve_info(last.select(F.concat(F.lit("maze_"), F.col("user_id").cast("string"), F.lit("_x")).alias("stem"), "solver_status"), f"{root}/info")
    built = manifests.build_manifest(
        spark, f"{root}/csv", f"{root}/params", ["a", "b"], manifests.read_solve_info(spark, [f"{root}/info"])
    )
    return built.select(
        "subdir", "stem", "env_id", "n_timesteps", r6("path_length_m", 4).alias("path_length_m"), "solver_status",
        F.col("yaml_path").isNotNull().alias("has_params"), "status_source",
        F.map_contains_key("extra", "csv_read_error").alias("bad"),
    )
