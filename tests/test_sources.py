import json
import math

import pytest
from pyspark.sql import functions as F

from trajspark.operators.kinematics import flat_outputs
from trajspark.operators.logs import parse_solver_log
from trajspark.schema import SystemParams, TRAJECTORY_COLUMNS
from trajspark.sources import corpus, manifests

LOG = """
EXIT: noise
Solver Return Status: Solve_Succeeded
Number of iterations: 143
Optimization completed in 6.51 seconds
Total time = 3.92
file_dir: experiments/forest_000_s1.yaml
Solver Return Status: Maximum_Iterations_Exceeded
optimization failed for forest_001_s1
Solver failed: restoration
  file_dir: experiments/maze_3.yaml
file_dir: experiments/quiet
Number of iterations: 5
"""


def write_csv(path, n, columns=None, extra=False, t0=0.0):
    columns = list(columns or TRAJECTORY_COLUMNS)
    lines = [",".join(columns + (["more"] if extra else []))]
    for i in range(n):
        t = t0 + 0.1 * i
        value = {c: 0.0 for c in TRAJECTORY_COLUMNS}
        value |= {"time": t, "sol_x_0": math.sin(t), "sol_x_1": math.cos(t), "sol_x_2": 2 + 0.1 * t}
        value |= {"sol_x_3": math.cos(t), "sol_x_4": -math.sin(t), "sol_x_5": 0.1}
        value |= {"sol_x_6": -math.sin(t), "sol_x_7": -math.cos(t), "sol_u_0": -math.cos(t), "sol_u_1": math.sin(t)}
        lines.append(",".join([repr(value[c]) for c in columns] + (["x"] if extra else [])))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


@pytest.fixture
def corpus_dir(tmp_path):
    root = tmp_path / "csvs"
    for k in range(3):
        write_csv(root / "forests" / f"forest_00{k}_f0_g_s{k}.csv", 60)
    write_csv(root / "forests" / "forest_009_f0_g_s9.csv", 40, reversed(TRAJECTORY_COLUMNS), extra=True)
    write_csv(root / "mazes" / "maze_1_a.csv", 8)
    write_csv(root / "mazes" / "maze_2_empty.csv", 0)
    (root / "mazes" / "other_bad.csv").write_text("not,a,valid\nheader\n")
    return root


def test_scan_by_name_and_bad_files(spark, corpus_dir):
    scan = corpus.scan_csv(spark, [str(corpus_dir)])
    steps = corpus.to_steps(scan.rows)
    sizes = {r["stem"]: r["count"] for r in steps.groupBy("stem").count().collect()}
    assert sizes == {"forest_000_f0_g_s0": 60, "forest_001_f0_g_s1": 60, "forest_002_f0_g_s2": 60, "forest_009_f0_g_s9": 40, "maze_1_a": 8}
    bad = {r["csv_path"].rsplit("/", 1)[1]: r["error"] for r in scan.bad_files.collect()}
    assert set(bad) == {"other_bad.csv"}
    assert "missing columns" in bad["other_bad.csv"]
    for stem in ("forest_000_f0_g_s0", "forest_009_f0_g_s9"):
        rows = steps.where(F.col("stem") == stem).orderBy("step").collect()
        assert [r["time"] for r in rows] == pytest.approx([0.1 * i for i in range(len(rows))])
        assert rows[5]["p"] == pytest.approx([math.sin(0.5), math.cos(0.5), 2.05])
        assert rows[5]["j"][0] == pytest.approx(-math.cos(0.5)) and len(rows[5]["rot_cols"]) == 6
    f = flat_outputs(steps.where("stem = 'forest_000_f0_g_s0'"))
    assert f.where("valid").count() == 60


def test_text_in_a_number_column_is_reported(spark, tmp_path):
    write_csv(tmp_path / "a" / "ok.csv", 5)
    write_csv(tmp_path / "a" / "bad.csv", 5)
    p = tmp_path / "a" / "bad.csv"
    lines = p.read_text().splitlines()
    lines[3] = "oops" + lines[3][lines[3].index(",") :]
    p.write_text("\n".join(lines) + "\n")
    scan = corpus.scan_csv(spark, [str(tmp_path / "a")])
    assert [r["stem"] for r in scan.rows.select("stem").distinct().collect()] == ["ok"]
    assert "not numeric" in scan.bad_files.first()["error"]


def test_discovery(spark, corpus_dir):
    root = str(corpus_dir)
    assert corpus.discover(spark, [root, f"{root}/mazes"]).count() == 7
    assert corpus.discover(spark, [f"{root}/mazes/maze_1_a.csv"]).count() == 1


def test_manifest_build_and_round_trip(spark, corpus_dir, tmp_path):
    params = tmp_path / "params" / "forests"
    params.mkdir(parents=True)
    (params / "forest_000_f0_g_s0.yaml").write_text("mass_quad: 1\n")
    info = spark.createDataFrame(
        [("forest_000_f0_g_s0", "Solve_Succeeded", 12, 3.5, None, True, None), ("other_bad", "Solve_Succeeded", 1, 1.0, None, True, None)],
        "stem string, solver_status string, iterations bigint, solve_time_s double, total_time_s double, succeeded boolean, status_source string",
    )
    m = manifests.build_manifest(spark, str(corpus_dir), str(tmp_path / "params"), solve_info=info, seed=0)
    rows = {r["stem"]: r for r in m.collect()}
    assert len(rows) == 7
    a = rows["forest_000_f0_g_s0"]
    assert (a["n_timesteps"], a["env_id"], a["status_source"], a["iterations"]) == (60, "forest_f0_s0", "solver_log", 12)
    assert a["yaml_path"].endswith(".yaml") and rows["forest_001_f0_g_s1"]["yaml_path"] is None
    assert a["sample_rate_hz"] == pytest.approx(10.0) and a["split"] in ("train", "val", "test")
    bad = rows["other_bad"]
    assert bad["n_timesteps"] is None and "csv_read_error" in bad["extra"] and bad["solver_status"] is None
    assert rows["maze_2_empty"]["n_timesteps"] == 0 and rows["maze_2_empty"]["path_length_m"] is None
    assert rows["maze_1_a"]["split"] == "heldout"
    path = str(tmp_path / "manifest")
    manifests.write_manifest(m, path)
    back = {r["stem"]: r for r in manifests.read_manifest(spark, path).collect()}
    for stem, r in rows.items():
        assert back[stem].asDict() == r.asDict()


def test_read_manifest_folds_unknown_keys(spark, tmp_path):
    rows = [{"stem": "a", "n_timesteps": 3, "weird": 1, "note": "x", "extra": {"note": "kept"}}, {"stem": "b"}]
    (tmp_path / "m.jsonl").write_text("\n".join(["", *[json.dumps(r) for r in rows], "  "]))
    out = {r["stem"]: r for r in manifests.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert out["a"]["extra"] == {"weird": "1", "note": "kept"} and out["a"]["n_timesteps"] == 3
    assert out["b"]["extra"] == {} and out["b"]["status_source"] == "unknown"


def test_solve_info_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"stem":"x","solver_status":"Solver_Failed"}\n\n{"stem":"x","solver_status":"mid"}\n{"iterations":3}\n')
    (tmp_path / "b.jsonl").write_text('{"stem":"x","solver_status":"Solve_Succeeded"}\n{"stem":"y","solver_status":"Solve_Succeeded"}\n')
    out = manifests.read_solve_info(spark, [str(tmp_path / n) for n in ("a.jsonl", "b.jsonl", "none.jsonl")])
    assert {r["stem"]: r["solver_status"] for r in out.collect()} == {"x": "Solve_Succeeded", "y": "Solve_Succeeded"}
    only = manifests.read_solve_info(spark, [str(tmp_path / "a.jsonl")])
    assert only.first()["solver_status"] == "mid"


def test_later_append_wins(spark, tmp_path):
    path = str(tmp_path / "info")
    for k in range(4):
        manifests.append_solve_info(spark.createDataFrame([("x", f"v{k}")], "stem string, solver_status string"), path)
    assert manifests.read_solve_info(spark, [path]).first()["solver_status"] == "v3"


def test_many_writers_append_at_once(spark, tmp_path):
    """Concurrent writers get numbers of their own; what crashed writers leave behind is not read."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "info")

    def write(k):
        rows = [("shared", f"v{k}"), (f"own{k}", f"v{k}")]
        return k, manifests.append_solve_info(spark.createDataFrame(rows, "stem string, solver_status string"), path)

    first = write(99)[1]
    (tmp_path / "info" / "_pending-dead").mkdir()
    (tmp_path / "info" / "_pending-dead" / "part.json").write_text('{"stem":"shared","solver_status":"dead"}\n')
    (tmp_path / "info" / "_claims" / "000003").touch()  # claimed by a writer that died before its rename
    with ThreadPoolExecutor(4) as pool:
        numbers = dict(pool.map(write, range(8)))
    taken = sorted(numbers.values())
    assert first == 1 and len(set(taken)) == 8 and 3 not in taken
    out = {r["stem"]: r["solver_status"] for r in manifests.read_solve_info(spark, [path]).collect()}
    last = max(numbers, key=numbers.get)
    assert out == {"shared": f"v{last}", "own99": "v99", **{f"own{k}": f"v{k}" for k in range(8)}}


def test_many_headers(spark, tmp_path):
    for k in range(1500):
        (tmp_path / f"f{k}.csv").write_text(f"extra{k},time\n1,{k}\n")
    scan = corpus.scan_csv(spark, [str(tmp_path)], ["time"])
    assert scan.rows.agg(F.sum("time")).first()[0] == sum(range(1500)) and scan.bad_files.isEmpty()


def test_same_stem_in_two_folders(spark, tmp_path, smooth):
    from trajspark.operators.dataset import build_windows
    from trajspark.operators.windows import WindowConfig

    steps = smooth(40, ("s",)).withColumn("n", F.explode(F.array(F.lit("a"), F.lit("b"))))
    steps = steps.withColumn("csv_path", F.concat_ws("/", "n", F.lit("s.csv"))).drop("n")
    manifest = spark.createDataFrame([("a/s.csv", "train"), ("b/s.csv", "test")], "csv_path string, split string")
    w = build_windows(steps, manifest, WindowConfig(4, 3))
    assert {r["split"]: r["count"] for r in w.groupBy("split").count().collect()} == {"train": 34, "test": 34}


@pytest.mark.parametrize("small", [False, True])
def test_solver_log(tiny, tmp_path, small):
    if not small:
        tiny.conf.set("spark.trajspark.groupRows", "1000")
    (tmp_path / "run.log").write_text(LOG)
    if small:
        tiny.conf.set("spark.trajspark.groupRows", "4")
    got = manifests.solve_info_from_logs(tiny, str(tmp_path / "run.log")).orderBy("block").collect()
    assert [(r["stem"], r["solver_status"], r["iterations"], r["solve_time_s"], r["total_time_s"], r["succeeded"]) for r in got] == [
        ("forest_000_s1", "Solve_Succeeded", 143, 6.51, 3.92, True),
        ("forest_001_s1", "Maximum_Iterations_Exceeded", None, None, None, False),
        ("maze_3", "Solver_Failed", 99999, None, None, False),
        ("quiet", None, None, None, None, None),
    ]


def test_empty_log_has_no_solves(spark):
    lines = spark.createDataFrame([("l", 0, "noise"), ("l", 1, "")], "log string, line_no bigint, line string")
    assert parse_solver_log(lines).isEmpty()


def test_params(spark, tmp_path):
    p = tmp_path / "base.yaml"
    p.write_text("mass_quad: 0.8  # kg\nmass_load: 0.2\nname: x\ncable_length: 0.5\nnested:\n  gravity: 1\n")
    assert manifests.read_params(spark, str(p)) == SystemParams(0.8, 0.2, 0.5)
    p.write_text("mass_quad: 0.8\n")
    with pytest.raises(KeyError):
        manifests.read_params(spark, str(p))
    with pytest.raises(ValueError):
        SystemParams(mass_quad=0)


def bytes_scanned(spark, run):
    """Bytes that Spark's scans read while ``run`` works."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).inputBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_text_is_read_once_and_heads_by_their_first_bytes(spark, tmp_path):
    root = tmp_path / "big"
    for k in range(4):
        write_csv(root / f"f{k}.csv", 4000, extra=k == 3)
    size = sum(p.stat().st_size for p in root.iterdir())
    heads = corpus.headers(spark, [str(root)])
    rows = heads.collect()
    assert len(rows) == 4 and sum(r["bytes"] for r in rows) <= 4 * corpus.HEAD_BYTES < size / 20
    scanned = bytes_scanned(spark, lambda: corpus.scan_csv(spark, [str(root)], ["time"], heads=heads))
    assert size <= scanned < 1.5 * size, (scanned, size)  # the text once, and the small copy of one column


def test_files_that_arrive_during_a_scan_wait_for_the_next(spark, tmp_path):
    """Larger files, with another layout too, repack the splits between listing and reading."""
    root = tmp_path / "grows"
    for k in range(6):
        write_csv(root / f"g{k}.csv", 50 + k, reversed(TRAJECTORY_COLUMNS) if k == 2 else None)
    heads = corpus.headers(spark, [str(root)])
    write_csv(root / "a_new.csv", 3000)
    write_csv(root / "z_new.csv", 2000, reversed(TRAJECTORY_COLUMNS), extra=True)
    (root / "m_new.csv").write_text("other,header\n1,2\n")
    scan = corpus.scan_csv(spark, [str(root)], heads=heads)
    sizes = {r["stem"]: r["count"] for r in scan.rows.groupBy("stem").count().collect()}
    assert sizes == {f"g{k}": 50 + k for k in range(6)} and scan.bad_files.count() == 0
    again = corpus.scan_csv(spark, [str(root)])
    assert again.rows.count() == sum(sizes.values()) + 5000
    assert [r["csv_path"].rsplit("/", 1)[1] for r in again.bad_files.collect()] == ["m_new.csv"]
    steps = corpus.to_steps(again.rows).where("stem = 'g2'").orderBy("step").collect()
    assert [r["time"] for r in steps] == pytest.approx([0.1 * i for i in range(52)])


def test_files_of_many_splits_keep_their_order(spark, tmp_path):
    write_csv(tmp_path / "long" / "one.csv", 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        scan = corpus.scan_csv(spark, [str(tmp_path / "long")])
        assert scan.rows.select("_block").distinct().count() > 4
        steps = corpus.to_steps(scan.rows).select("step", "time").orderBy("step").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["time"] for r in steps] == pytest.approx([0.1 * i for i in range(5000)])


def test_heads_of_a_store_that_tasks_cannot_open(spark, tmp_path):
    """Headers then come from the text reader; long, blank, marked and odd heads are read alike both ways."""
    root = tmp_path / "odd names"
    root.mkdir()
    cases = {
        "long": "x" * 50_000 + ",time\n1,2\n", "mark": "\ufefftime\n1\n", "crlf": "time,b\r\n1,2\r\n", "cr": "time\r1\r",
        "blank": "\ntime\n1\n", "alone": "time", "twice": "time\n1\ntime\n2\n", "one two": "time\n3\n",
    }
    for name, text in cases.items():
        (root / f"{name}.csv").write_bytes(text.encode())
    (root / "none.csv").write_text("")

    def closed(path):
        raise OSError(path)

    read = []
    for heads in (corpus.headers(spark, [str(root)]), corpus.headers(spark, [str(root)], opener=closed)):
        assert heads.count() == len(cases)
        scan = corpus.scan_csv(spark, [str(root)], ["time"], heads=heads)
        rows = sorted((r["stem"], r["time"]) for r in scan.rows.collect())
        bad = sorted((r["csv_path"].rsplit("/", 1)[1], r["error"]) for r in scan.bad_files.collect())
        read.append((rows, bad))
    rows, bad = read[0]
    assert read[1] == read[0]
    assert [s.replace("%20", " ") for s, _ in rows] == ["cr", "crlf", "long", "mark", "one two"]
    assert [b for b, _ in bad] == ["blank.csv", "twice.csv"] and "missing" in bad[0][1] and bad[1][1].endswith("time")


@pytest.mark.parametrize("reached", [True, False])
def test_write_files(spark, tmp_path, monkeypatch, reached):
    """Tasks name their files themselves; the driver moves them one by one only in stores that Arrow cannot write."""

    def refuse(*_):
        raise OSError("not here")

    monkeypatch.setattr(corpus, "_move_named" if reached else "_store", refuse)
    lines = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("sub"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"),
        (100 - F.col("id")).alias("at"), F.concat(F.lit("é,"), F.col("id")).alias("value"),
    )
    corpus.write_files(lines, str(tmp_path / "out"), "csv")
    found = {f"{f.parent.name}/{f.name}": f.read_text() for f in (tmp_path / "out").glob("[ab]/*") if not f.name.endswith(".crc")}
    assert set(found) == {f"{s}/n{i}.csv" for s in "ab" for i in range(3)}
    for place, text in found.items():
        ids = [i for i in range(59, -1, -1) if i % 2 == "ab".index(place[0]) and i % 3 == int(place[3])]
        assert text == "".join(f"é,{i}\n" for i in ids)
