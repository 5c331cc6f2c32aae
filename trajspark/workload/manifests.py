"""Manifest, split, coverage and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions.flatmap import tension_margin
from trajspark.functions.text import parent_dir, tag
from trajspark.functions.vectors import parts
from trajspark.operators import logs, manifest
from trajspark.operators.kinematics import row_delta
from trajspark.operators.windows import WindowConfig, window_count
from trajspark.plans.quantiles import quantiles
from trajspark.workload.registry import q6, query, r6
from trajspark.workload.views import (
    EV,
    FLAT,
    MANIFEST_SQL,
    PHYS,
    SPLIT_SQL,
    ev_steps,
    manifest_view,
    phys_steps,
    table,
    unit_sql,
    utc_micros,
)

RULES = {"h": 30, "t": 40}

ISSUES_SQL = (
    MANIFEST_SQL
    + """,
iss AS (
  SELECT *, list_filter([
     CASE WHEN csv_path IS NULL THEN 'missing_csv' END,
     CASE WHEN solver_status NOT IN ('Solve_Succeeded', 'Solved_To_Acceptable_Level') THEN 'solver_status' END,
     CASE WHEN iterations >= 99999 THEN 'solver_iteration_sentinel' END,
     CASE WHEN path_length_m IS NULL THEN 'missing_path_length' END,
     CASE WHEN abs(path_length_m - 999) <= 1e-9 THEN 'path_length_sentinel' END,
     CASE WHEN abs(path_length_m - 999) > 1e-9 AND path_length_m < 1e-2 THEN 'degenerate_path' END,
     CASE WHEN total_time_s >= 1000 THEN 'total_time_sentinel' END,
     CASE WHEN total_time_s <= 0 THEN 'degenerate_duration' END,
     CASE WHEN n_timesteps < 70 THEN 'too_short_for_window' END], lambda x: x IS NOT NULL) AS issues
  FROM man)"""
)


@query(
    "trajectory_measurements",
    f"""WITH {PHYS},
d AS (SELECT *, sqrt((p0 - lag(p0) OVER w)**2 + (p1 - lag(p1) OVER w)**2 + (p2 - lag(p2) OVER w)**2) AS hop
      FROM ph WINDOW w AS (PARTITION BY stem ORDER BY step)),
m AS (SELECT stem, count(*) AS n_timesteps, max(time) - min(time) AS total, coalesce(sum(hop), 0e0) AS path
      FROM d GROUP BY stem)
SELECT stem, n_timesteps, {q6("total")} AS total_time_s, {q6("total / (n_timesteps - 1)")} AS dt_s,
  {q6("(n_timesteps - 1) / total")} AS sample_rate_hz, {q6("path")} AS path_length_m
FROM m""",
)
def trajectory_measurements(spark, sf):
    m = manifest.measure(phys_steps(spark, sf))
    return m.select(
        "stem", "n_timesteps",
        *[r6(c).alias(c) for c in ("total_time_s", "dt_s", "sample_rate_hz", "path_length_m")],
    )


@query(
    "median_dt_rate_mode",
    f"""WITH {EV},
g AS (SELECT stem, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY stem ORDER BY step)) / 1e6 / 86400 AS gap FROM ev),
m AS (SELECT stem, median(gap) AS dt FROM g GROUP BY stem),
r AS (SELECT round_even(1 / dt, 0)::BIGINT AS hz, count(*) AS n FROM m GROUP BY 1)
SELECT hz, n, hz = (SELECT hz FROM r ORDER BY n DESC, hz LIMIT 1) AS is_mode FROM r""",
)
def median_dt_rate_mode(spark, sf):
    ev = ev_steps(spark, sf)
    gaps = row_delta(ev.withColumn("us", utc_micros(ev, "ts")), "us", "gap_us").withColumn(
        "gap", F.col("gap_us") / 1e6 / 86400
    )
    rates = quantiles(gaps, ["stem"], {"gap": {"dt": 0.5}}).select(
        F.bround(1.0 / F.col("dt"), 0).cast("bigint").alias("hz")
    )
    counts = rates.groupBy("hz").agg(F.count("*").alias("n"))
    counts = counts.withColumn("_k", F.lit(0))
    mode = counts.groupBy("_k").agg(F.max_by("hz", F.struct("n", -F.col("hz"))).alias("mode"))
    return counts.join(mode, "_k").select("hz", "n", (F.col("hz") == F.col("mode")).alias("is_mode"))


@query(
    "stem_parse",
    f"""WITH {MANIFEST_SQL}
SELECT stem, source, env_id, forest_type::BIGINT AS forest_type, env_seed::BIGINT AS env_seed,
  replace(replace(cast(round(total_time_s, 2) AS VARCHAR), '.', 'p'), '-', 'n') AS tag,
  coalesce(split_part(csv_path, '/', 1), '') AS parent FROM man""",
)
def stem_parse(spark, sf):
    return manifest_view(spark, sf).select(
        "stem", "source", "env_id", "forest_type", "env_seed",
        tag(F.round("total_time_s", 2)).alias("tag"),
        F.coalesce(parent_dir(F.col("csv_path")), F.lit("")).alias("parent"),
    )


@query(
    "quality_issues",
    f"WITH {ISSUES_SQL} SELECT stem, len(issues)::INT AS n_issues, array_to_string(issues, ',') AS issues FROM iss",
)
def quality_issues(spark, sf):
    issues = manifest.quality_issues(**RULES)
    return manifest_view(spark, sf).select(
        "stem", F.size(issues).alias("n_issues"), F.array_join(issues, ",").alias("issues")
    )


@query(
    "quality_reason_counts",
    f"WITH {ISSUES_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(issues) AS reason FROM iss) GROUP BY reason",
)
def quality_reason_counts(spark, sf):
    return manifest.reason_counts(manifest_view(spark, sf), **RULES)


@query(
    "rejected_records",
    f"WITH {ISSUES_SQL} SELECT stem, array_to_string(issues, ',') AS reasons FROM iss WHERE len(issues) > 0 ORDER BY stem",
)
def rejected_records(spark, sf):
    return (
        manifest.rejected(manifest_view(spark, sf), **RULES)
        .select("stem", F.array_join("reasons", ",").alias("reasons"))
        .orderBy("stem")
    )


@query(
    "manifest_summary",
    f"""WITH {ISSUES_SQL},
sp AS (SELECT *, {SPLIT_SQL.format(u=unit_sql("env_id"))} AS split FROM iss),
ok AS (SELECT * FROM sp WHERE len(issues) = 0)
SELECT 'totals' AS section, 'n_records' AS value, count(*) AS n FROM sp
UNION ALL SELECT 'totals', 'n_pass', count(*) FROM ok
UNION ALL SELECT 'totals', 'n_fail', count(*) FROM sp WHERE len(issues) > 0
UNION ALL SELECT 'totals', 'n_environments', count(DISTINCT env_id) FROM sp
UNION ALL SELECT 'totals', 'n_environments_pass', count(DISTINCT env_id) FROM ok
UNION ALL SELECT 'sources', source, count(*) FROM sp GROUP BY source
UNION ALL SELECT 'solver_status', coalesce(solver_status, '<unrecorded>'), count(*) FROM sp GROUP BY 2
UNION ALL SELECT 'status_source', status_source, count(*) FROM sp GROUP BY 2
UNION ALL SELECT 'splits_trajectories', split, count(*) FROM ok GROUP BY 2
UNION ALL SELECT 'splits_environments', split, count(DISTINCT env_id) FROM ok GROUP BY 2
UNION ALL SELECT 'rejection_reasons', reason, count(*) FROM (SELECT unnest(issues) AS reason FROM sp) GROUP BY 2
UNION ALL SELECT 'sample_rate_hz', cast(round_even(sample_rate_hz, 3) AS VARCHAR), count(*) FROM sp GROUP BY 2""",
)
def manifest_summary(spark, sf):
    env = manifest_view(spark, sf)
    split = manifest.apply_splits(env, 0, hash_fn="md5", heldout_sources=())
    return manifest.summary_counts(split, **RULES)


@query(
    "nearest_rank_quantiles",
    f"""WITH r AS (SELECT o_orderpriority AS grp, o_totalprice AS v,
   row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k,
   count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT grp, {q6("min(v)")} AS min, {q6("max(v)")} AS max, {q6("avg(v)", 4)} AS mean,
  max(CASE WHEN k = round_even(25e-2 * (n - 1), 0) THEN v END) AS p25,
  max(CASE WHEN k = round_even(5e-1 * (n - 1), 0) THEN v END) AS median,
  max(CASE WHEN k = round_even(75e-2 * (n - 1), 0) THEN v END) AS p75
FROM r GROUP BY grp""",
)
def nearest_rank_quantiles(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("v")
    )
    out = manifest.summary_quantiles(rows, "v", ["grp"])
    return out.select(
        "grp", r6("min").alias("min"), r6("max").alias("max"), r6("mean", 4).alias("mean"),
        "p25", "median", "p75",
    )


@query(
    "manifest_quantiles",
    f"""WITH {ISSUES_SQL},
m AS (SELECT unnest(['duration_s', 'path_length_m', 'n_timesteps']) AS metric,
   unnest([total_time_s, path_length_m, n_timesteps::DOUBLE]) AS v FROM iss WHERE len(issues) = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY metric) AS n
   FROM m WHERE v IS NOT NULL)
SELECT metric, {q6("min(v)")} AS min, {q6("max(v)")} AS max, {q6("avg(v)", 4)} AS mean,
  {q6("max(CASE WHEN k = round_even(25e-2 * (n - 1), 0) THEN v END)")} AS p25,
  {q6("max(CASE WHEN k = round_even(5e-1 * (n - 1), 0) THEN v END)")} AS median,
  {q6("max(CASE WHEN k = round_even(75e-2 * (n - 1), 0) THEN v END)")} AS p75
FROM r GROUP BY metric""",
)
def manifest_quantiles(spark, sf):
    """Duration, path length and step count of the records that are kept."""
    metrics = {"duration_s": "total_time_s", "path_length_m": "path_length_m", "n_timesteps": "n_timesteps"}
    out = manifest.kept_quantiles(manifest_view(spark, sf), metrics, **RULES)
    return out.select("metric", r6("mean", 4).alias("mean"), *[r6(c).alias(c) for c in ("min", "max", "p25", "median", "p75")])


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("stem"),
        F.col("o_custkey").alias("env_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "maze").otherwise("forest").alias("source"),
    )


@query(
    "hash_split_md5",
    f"SELECT DISTINCT o_custkey AS env_id, {SPLIT_SQL.format(u=unit_sql('o_custkey'))} AS split FROM orders",
)
def hash_split_md5(spark, sf):
    return manifest.environment_splits(_orders(spark, sf), 0, hash_fn="md5")


@query(
    "split_counts",
    f"""WITH s AS (SELECT o_custkey AS env_id, {SPLIT_SQL.format(u=unit_sql('o_custkey'))} AS split FROM orders)
SELECT split, count(*) AS n_trajectories, count(DISTINCT env_id) AS n_environments FROM s GROUP BY split""",
)
def split_counts(spark, sf):
    rows = manifest.apply_splits(_orders(spark, sf), 0, hash_fn="md5", heldout_sources=())
    return rows.groupBy("split").agg(
        F.count("*").alias("n_trajectories"), F.count_distinct("env_id").alias("n_environments")
    )


@query(
    "shuffle_split_exact",
    """WITH e AS (SELECT DISTINCT o_custkey AS env_id FROM orders),
r AS (SELECT env_id, row_number() OVER (ORDER BY md5('7|' || env_id)) - 1 AS k, count(*) OVER () AS n FROM e),
c AS (SELECT *, floor(n * 8e-1)::BIGINT AS a, floor(n * 1e-1)::BIGINT AS b FROM r),
x AS (SELECT *, n - a - 2 * b AS extra FROM c)
SELECT env_id, CASE WHEN k < a + least(extra, 1) THEN 'train'
  WHEN k < a + least(extra, 1) + b + greatest(least(extra - 1, 1), 0) THEN 'val' ELSE 'test' END AS split FROM x""",
)
def shuffle_split_exact(spark, sf):
    return manifest.environment_splits(_orders(spark, sf), 7, method="shuffle")


@query(
    "heldout_semi_anti",
    """WITH h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
s AS (SELECT CASE WHEN h.o_custkey IS NULL THEN 'splittable' ELSE 'heldout' END AS side, o.o_custkey
      FROM orders o LEFT JOIN h ON o.o_custkey = h.o_custkey)
SELECT side, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_environments FROM s GROUP BY side""",
)
def heldout_semi_anti(spark, sf):
    held, rest = manifest.split_heldout(_orders(spark, sf))
    rows = held.withColumn("side", F.lit("heldout")).unionByName(
        rest.withColumn("side", F.lit("splittable"))
    )
    return rows.groupBy("side").agg(
        F.count("*").alias("n_rows"), F.count_distinct("env_id").alias("n_environments")
    )


@query(
    "apply_splits",
    f"""WITH h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey AS stem, o.o_custkey AS env_id, CASE WHEN h.o_custkey IS NOT NULL THEN 'heldout'
  ELSE {SPLIT_SQL.format(u=unit_sql('o.o_custkey', 5))} END AS split
FROM orders o LEFT JOIN h ON o.o_custkey = h.o_custkey""",
)
def apply_splits(spark, sf):
    return manifest.apply_splits(_orders(spark, sf), 5, hash_fn="md5").select("stem", "env_id", "split")


@query(
    "split_leak_audit",
    f"""WITH s AS (SELECT o_custkey AS env_id, {SPLIT_SQL.format(u=unit_sql('o_orderkey'))} AS split FROM orders)
SELECT env_id, count(DISTINCT split) AS n_splits, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits
FROM s GROUP BY env_id HAVING count(DISTINCT split) > 1""",
)
def split_leak_audit(spark, sf):
    from trajspark.functions.hashing import split_of, unit_md5

    wrong = _orders(spark, sf).withColumn("split", split_of(unit_md5(F.col("stem"), 0)))
    return manifest.split_leaks(wrong).withColumn("splits", F.array_join("splits", ","))


@query(
    "solve_info_latest_wins",
    """SELECT user_id AS stem, arg_max(event_type, event_id) AS solver_status, arg_max(value, event_id) AS solve_time_s,
  max(event_id) AS seq FROM events GROUP BY user_id""",
)
def solve_info_latest_wins(spark, sf):
    info = table(spark, sf, "events").select(
        F.col("user_id").alias("stem"),
        F.col("event_type").alias("solver_status"),
        F.col("value").alias("solve_time_s"),
        F.col("event_id").alias("seq"),
    )
    return manifest.latest_wins(info, "stem", ["seq"])


@query(
    "manifest_with_solve_info",
    """WITH i AS (SELECT user_id AS stem, arg_max(event_type, event_id) AS solver_status,
   arg_max(event_id, event_id) AS iterations FROM events WHERE value > 100 GROUP BY user_id)
SELECT c.c_custkey AS stem, i.solver_status, i.iterations,
  CASE WHEN i.stem IS NULL THEN 'unknown' ELSE 'solver_log' END AS status_source
FROM customer c LEFT JOIN i ON c.c_custkey = i.stem""",
)
def manifest_with_solve_info(spark, sf):
    info = table(spark, sf, "events").where(F.col("value") > 100).select(
        F.col("user_id").alias("stem"),
        F.col("event_type").alias("solver_status"),
        F.col("event_id").alias("iterations"),
        F.col("value").alias("solve_time_s"),
        F.lit(None).cast("string").alias("status_source"),
        F.col("event_id").alias("seq"),
    )
    latest = manifest.latest_wins(info, "stem", ["seq"])
    stems = table(spark, sf, "customer").select(F.col("c_custkey").alias("stem"))
    return manifest.with_solve_info(stems, latest).select(
        "stem", "solver_status", "iterations", "status_source"
    )


@query(
    "log_segmentation",
    f"""WITH {EV},
b AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY stem ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM ev)
SELECT stem, block::BIGINT AS block, count(*) AS n,
  arg_max(value, step) FILTER (event_type = 'view') AS last_view,
  arg_max(value, step) FILTER (event_type = 'error') AS last_error
FROM b GROUP BY stem, block HAVING bool_or(event_type = 'purchase')""",
)
def log_segmentation(spark, sf):
    ev = ev_steps(spark, sf, "event_type")
    kind = F.col("event_type")
    return logs.closed_blocks(
        ev,
        "stem",
        kind == "purchase",
        {
            "last_view": F.when(kind == "view", F.col("value")),
            "last_error": F.when(kind == "error", F.col("value")),
        },
        size="n",
    )


LINES_SQL = (
    EV
    + """,
typed AS (
  SELECT stem, step, CASE WHEN event_type = 'view' THEN value END AS solve_time,
     CASE WHEN event_type = 'signup' THEN CASE WHEN value < 50 THEN 'Solve_Succeeded' ELSE 'Search_Limit' END
          WHEN event_type = 'error' AND value < 60 THEN 'Solver_Failed' END AS status,
     CASE WHEN event_type = 'click' THEN event_id WHEN event_type = 'error' AND value < 60 THEN 99999 END AS iters,
     CASE WHEN event_type = 'error' AND value >= 60 THEN value END AS total,
     CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 100 THEN 'saved' ELSE 'failed' END END AS anchor,
     CASE WHEN event_type = 'purchase' THEN 's' || event_id END AS name
  FROM ev),
blk AS (SELECT *, coalesce(sum((anchor IS NOT NULL)::INT) OVER (PARTITION BY stem ORDER BY step
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM typed)"""
)


@query(
    "solver_log_parse",
    f"""WITH {LINES_SQL},
g AS (SELECT stem AS log, block::BIGINT AS block, max(name) AS stem, max(anchor) AS anchor,
   arg_max(status, step) FILTER (status IS NOT NULL) AS solver_status,
   arg_max(iters, step) FILTER (iters IS NOT NULL) AS iterations,
   arg_max(solve_time, step) FILTER (solve_time IS NOT NULL) AS solve_time_s,
   arg_max(total, step) FILTER (total IS NOT NULL) AS total_time_s
 FROM blk GROUP BY 1, 2)
SELECT log, block, stem, solver_status, iterations, solve_time_s, total_time_s,
  CASE WHEN anchor = 'failed' THEN false WHEN solver_status IS NULL THEN NULL
       ELSE solver_status IN ('Solve_Succeeded', 'Solved_To_Acceptable_Level') END AS succeeded
FROM g WHERE anchor IS NOT NULL""",
)
def solver_log_parse(spark, sf):
    return logs.parse_solver_log(log_lines(spark, sf)).drop("status_source")


def log_lines(spark, sf):
    """Events written out as solver-log text, one log per user."""
    ev = ev_steps(spark, sf, "event_type")
    kind, value = F.col("event_type"), F.col("value")
    name = F.concat(F.lit("s"), F.col("event_id").cast("string"))
    line = (
        F.when(kind == "view", F.concat(F.lit("  Optimization completed in "), value.cast("string"), F.lit(" seconds")))
        .when(kind == "click", F.concat(F.lit("Number of iterations: "), F.col("event_id").cast("string")))
        .when(
            kind == "signup",
            F.concat(F.lit("Solver Return Status: "), F.when(value < 50, "Solve_Succeeded").otherwise("Search_Limit")),
        )
        .when((kind == "error") & (value < 60), F.lit("Solver failed: restoration"))
        .when(kind == "error", F.concat(F.lit("Total time = "), value.cast("string")))
        .when(value < 100, F.concat(F.lit("file_dir: runs/"), name, F.lit(".yaml")))
        .otherwise(F.concat(F.lit("optimization failed for "), name))
    )
    return ev.select(F.col("stem").alias("log"), F.col("step").alias("line_no"), line.alias("line"))


GRID_SQL = """grid(idx, suffix) AS (VALUES
  (0, 'g15_0_0_m0p5_v0_0_0'), (1, 'g15_0_0_m0p5_v1_0_0'), (2, 'g15_n3_0_m0p5_v0_0_0'), (3, 'g15_n3_0_m0p5_v1_0_0'),
  (4, 'g15_3_0_m0p5_v0_0_0'), (5, 'g15_3_0_m0p5_v1_0_0'), (6, 'g15_0_0_m0p6_v0_0_0'), (7, 'g15_n3_0_m0p6_v0_0_0'),
  (8, 'g15_3_0_m0p6_v0_0_0')),
want AS (SELECT c_custkey AS env_seed, c_nationkey AS forest_type, idx,
   'forest_' || lpad(idx::VARCHAR, 3, '0') || '_f' || c_nationkey || '_' || suffix || '_s' || c_custkey AS stem
  FROM customer, grid),
made AS (SELECT w.stem, max(CASE WHEN o_totalprice < 20000 THEN 0 ELSE floor(o_totalprice)::BIGINT END) AS length
  FROM orders o JOIN want w ON w.env_seed = o.o_custkey AND w.idx = o.o_orderkey % 9 GROUP BY w.stem)"""


def _grid(spark, sf):
    seeds = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("env_seed"), F.col("c_nationkey").alias("forest_type")
    )
    return manifest.expected_grid(seeds)


def _made(spark, sf):
    price = F.col("o_totalprice")
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("env_seed"),
        (F.col("o_orderkey") % 9).cast("int").alias("idx"),
        F.when(price < 20000, 0).otherwise(F.floor(price)).cast("bigint").alias("length"),
    )
    # the grid has nine rows a customer, far more than the size Spark infers from the file: never broadcast it
    return orders.join(_grid(spark, sf).hint("merge"), ["env_seed", "idx"]).select("stem", "length")


@query("expected_grid", f"WITH {GRID_SQL} SELECT stem, idx, env_seed, forest_type FROM want")
def expected_grid(spark, sf):
    return _grid(spark, sf).select("stem", "idx", "env_seed", "forest_type")


@query(
    "coverage_audit",
    f"""WITH {GRID_SQL}
SELECT env_seed, count(*) AS n_expected, count(length) AS n_produced, count(*) - count(length) AS n_missing,
  bool_and(coalesce(length > 0, false)) AS complete
FROM want LEFT JOIN made USING (stem) GROUP BY env_seed""",
)
def coverage_audit(spark, sf):
    return manifest.coverage(_grid(spark, sf), _made(spark, sf), "env_seed")


@query(
    "coverage_missing",
    f"WITH {GRID_SQL} SELECT stem FROM want EXCEPT SELECT stem FROM made",
)
def coverage_missing(spark, sf):
    return manifest.missing_stems(_grid(spark, sf), _made(spark, sf))


@query(
    "coverage_produced",
    f"WITH {GRID_SQL} SELECT stem FROM want INTERSECT SELECT stem FROM made",
)
def coverage_produced(spark, sf):
    return manifest.produced_stems(_grid(spark, sf), _made(spark, sf))


@query(
    "grid_head",
    f"WITH {GRID_SQL} SELECT stem FROM want ORDER BY env_seed, idx LIMIT 12",
)
def grid_head(spark, sf):
    """Dry-run listing: the first few expected stems."""
    return _grid(spark, sf).orderBy("env_seed", "idx").select("stem").limit(12)


@query(
    "generation_accounting",
    """WITH j AS (SELECT o_custkey AS job, count(*) AS n, max(o_orderstatus = 'P') AS timed_out,
   min(o_orderkey) % 5 AS returncode, list(o_orderkey) FILTER (o_orderstatus = 'F') AS produced,
   list(o_orderkey) FILTER (o_orderstatus = 'O') AS missing, min(o_orderkey) % 11 = 0 AS skipped
  FROM orders GROUP BY o_custkey)
SELECT count(*) AS n_jobs, count(*) FILTER (NOT skipped) AS n_run,
  count(*) FILTER (NOT skipped AND (returncode <> 0 OR timed_out OR produced IS NULL)) AS n_failed,
  coalesce(sum(len(produced)) FILTER (NOT skipped), 0)::BIGINT AS n_produced,
  coalesce(sum(len(missing)) FILTER (NOT skipped), 0)::BIGINT AS n_missing FROM j""",
)
def generation_accounting(spark, sf):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    jobs = orders.groupBy(F.col("o_custkey").alias("job")).agg(
        F.max(status == "P").alias("timed_out"),
        (F.min(key) % 5).alias("returncode"),
        (F.min(key) % 11 == 0).alias("skipped"),
    )
    stems = orders.where(status.isin("F", "O")).select(
        F.col("o_custkey").alias("job"), key.alias("stem"), (status == "F").alias("produced")
    )
    return manifest.generation_accounting(jobs, stems)


@query(
    "timestep_check",
    f"""WITH {MANIFEST_SQL}, d AS (SELECT stem, dt_s / 40 AS dt, round(sample_rate_hz * 40, 1) AS hz FROM man)
SELECT stem, concat_ws(',', CASE WHEN dt <= 0 THEN 'dt_not_positive' END,
  CASE WHEN dt > 0 AND NOT dt BETWEEN 1e-2 AND 5e-1 THEN 'dt_out_of_bounds' END,
  CASE WHEN dt > 0 AND abs(dt - 1 / hz) > 1e-4 * greatest(1 / hz, 1e-12) THEN 'dt_mismatch' END) AS problems FROM d""",
)
def timestep_check(spark, sf):
    rows = manifest_view(spark, sf).select(
        "stem",
        (F.col("dt_s") / 40).alias("dt"),
        F.round(F.col("sample_rate_hz") * 40, 1).alias("hz"),
    )
    problems = manifest.timestep_check(F.col("dt"), F.col("hz"), F.lit(1), rtol=1e-4)
    return rows.select("stem", F.array_join(problems, ",").alias("problems"))


@query(
    "slack_and_windows_by_split",
    f"""WITH {FLAT},
w AS (SELECT stem, split, step, count(*) OVER f AS c, count(*) FILTER (NOT valid) OVER f AS b FROM flat
      WINDOW f AS (PARTITION BY stem ORDER BY step ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)),
k AS (SELECT split, count(*) AS n_windows FROM w WHERE c = 30 AND b = 0 GROUP BY split),
m AS (SELECT split, count(*) AS n_steps, count(DISTINCT stem) AS n_trajectories, {q6("min(margin)")} AS min_margin,
      count(*) FILTER (margin < 0.3) AS n_near_slack FROM flat GROUP BY split)
SELECT split, n_trajectories, n_steps, min_margin, n_near_slack, coalesce(n_windows, 0) AS n_windows
FROM m LEFT JOIN k USING (split)""",
)
def slack_and_windows_by_split(spark, sf):
    """How close each split comes to the slack boundary, and how many training windows survive."""
    from trajspark.functions.flatmap import flat_map
    from trajspark.operators.dataset import surviving_windows

    steps = phys_steps(spark, sf)
    mapped = flat_map(steps)
    config = WindowConfig()
    alive = surviving_windows(mapped, config, "stem", "step", "valid")
    near = tension_margin(parts("a"))
    per = steps.groupBy("stem", "split").agg(
        F.count("*").alias("n"), F.min(near).alias("m"), F.count_if(near < 0.3).alias("s")
    )
    return (
        per.join(alive, "stem", "left")
        .groupBy("split")
        .agg(
            F.count("*").alias("n_trajectories"),
            F.sum("n").alias("n_steps"),
            r6(F.min("m")).alias("min_margin"),
            F.sum("s").alias("n_near_slack"),
            F.coalesce(F.sum("n_valid"), F.lit(0)).alias("n_windows"),
        )
    )


@query(
    "window_counts",
    f"WITH {EV} SELECT stem, greatest(count(*) - 29, 0) AS n_windows, "
    "ceil(count(*) / 3e0)::BIGINT AS resampled FROM ev GROUP BY stem",
)
def window_counts(spark, sf):
    from trajspark.operators.windows import resampled_length

    n = ev_steps(spark, sf).groupBy("stem").agg(F.count("*").alias("n"))
    return n.select(
        "stem",
        window_count(F.col("n"), WindowConfig()).alias("n_windows"),
        resampled_length(F.col("n"), 3).alias("resampled"),
    )
