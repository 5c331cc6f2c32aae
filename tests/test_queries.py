"""Registered queries against their SQL on the smallest tables (all of them with ALL_QUERIES=1)."""

import gzip
import json
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from trajspark.workload import files

SF = "/root/testdata/sf0.001"
SOME = [
    "slack_and_windows_by_split", "flat_map", "quaternion_continuity", "gradient_edge2", "anchor_relative",
    "norm_stats", "build_report", "rollout_forecast", "margin_summary", "per_traj_margin", "histogram",
    "quality_issues", "manifest_summary", "shuffle_split_exact", "apply_splits", "coverage_audit",
    "solver_log_parse", "ridge_probe", "label_permutation", "latent_spread", "epps_pulley_axes", "seed_spread",
    "lambda_table", "block_subsample", "stream_collapse", "csv_scan_by_name", "dataset_roundtrip",
]
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 7) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(x is None, str(type(x)), 0 if x is None else x) for x in r])


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_matches_sql(spark, db, name):
    compare(spark, db, name)


def compare(spark, db, name):
    got = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(cur.fetchall(), names)


@pytest.mark.parametrize("name", ["sliding_windows", "quaternion_continuity", "margin_summary", "per_traj_margin", "solver_log_parse", "trajectory_audit"])
def test_query_is_unchanged_when_every_key_is_hot(tiny, db, name):
    compare(tiny, db, name)


def test_entry(spark):
    assert {r["split"] for r in entry.entry(spark).collect()} <= {"train", "val", "test"}


@pytest.mark.parametrize("name", ["coverage_produced", "coverage_audit", "coverage_missing"])
def test_coverage_broadcasts_no_stems(spark, name):
    """The grid is inferred far smaller than it is, so a plan that broadcasts it fails on large tables."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_result_files_are_packed(spark, db, tmp_path, monkeypatch):
    """A run is about 1.6 KB of text, so plain files took 90 times the disk of the orders they come from."""
    monkeypatch.setattr(files, "scratch_path", lambda _, name: str(tmp_path / name))
    compare(spark, db, "results_roundtrip")
    parts = list((tmp_path / "results").glob("part-*"))
    runs = db.execute("SELECT count(*) FROM orders").fetchone()[0]
    assert sum(p.stat().st_size for p in parts) < 300 * runs
    seeds = [r["seed"] for p in parts for r in json.loads(gzip.decompress(p.read_bytes()))]
    assert sorted(seeds) == [k for (k,) in db.execute("SELECT o_orderkey FROM orders ORDER BY 1").fetchall()]
