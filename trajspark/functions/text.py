"""String rules: stem identity, file names, tags and solver-log line fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajspark.schema import GOOD_STATUSES, ITERATION_SENTINEL

# Fixed patterns of stems and of solver-log lines.
FOREST_STEM = r"^forest_(\d+)_f(\d+)_.*_s(\d+)$"
MAZE_STEM = r"^(maze_\d+)"
LOG_SOLVE_TIME = r"Optimization completed in ([\d.eE+-]+) seconds"
LOG_STATUS = r"Solver Return Status:\s*(\S+)"
LOG_ITERATIONS = r"Number of iterations:\s*(\d+)"
LOG_SOLVER_FAILED = r"^Solver failed:"
LOG_TOTAL_TIME = r"Total time = ([\d.eE+-]+)"
LOG_SAVED = r"^file_dir:\s*(\S+)"
LOG_FAILED = r"^optimization failed for (\S+)"


def stem_identity(stem: Column) -> dict[str, Column]:
    """source, env_id, forest_type and env_seed of a stem."""
    forest = stem.rlike(FOREST_STEM)
    maze = stem.rlike(MAZE_STEM)
    kind = F.regexp_extract(stem, FOREST_STEM, 2).try_cast("bigint")
    seed = F.regexp_extract(stem, FOREST_STEM, 3).try_cast("bigint")
    return {
        "source": F.when(forest, "forest").when(maze, "maze").otherwise("other"),
        "env_id": F.when(forest, F.concat(F.lit("forest_f"), kind, F.lit("_s"), seed))
        .when(maze, F.regexp_extract(stem, MAZE_STEM, 1))
        .otherwise(stem),
        "forest_type": F.when(forest, kind),
        "env_seed": F.when(forest, seed),
    }


def file_name_stem(path: Column) -> Column:
    """Last path component without its final suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parent_dir(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def tag(value: Column) -> Column:
    return F.translate(value.cast("string"), ".-", "pn")


def forest_stem(
    idx: int, kind: Column, goal: Sequence[int], margin: float, velocity: Sequence[int], seed: Column
) -> Column:
    """Stem of one grid entry. All but the kind and the seed is fixed text, made once."""
    word = lambda v: str(v).translate(str.maketrans(".-", "pn"))
    fixed = f"_g{'_'.join(map(word, goal))}_m{word(margin)}_v{'_'.join(map(word, velocity))}_s"
    return F.concat(F.lit(f"forest_{idx:03d}_f"), kind.cast("string"), F.lit(fixed), seed.cast("string"))


def log_line_fields(line: Column) -> dict[str, Column]:
    """Typed fields of one log line; the first matching rule claims the line, the rest stay NULL."""
    line = F.trim(line)
    solve = line.rlike(LOG_SOLVE_TIME)
    status = ~solve & line.rlike(LOG_STATUS)
    iters = ~solve & ~status & line.rlike(LOG_ITERATIONS)
    aborted = ~solve & ~status & ~iters & line.rlike(LOG_SOLVER_FAILED)
    before = solve | status | iters | aborted
    total = ~before & line.rlike(LOG_TOTAL_TIME)
    saved = ~before & ~total & line.rlike(LOG_SAVED)
    failed = ~before & ~total & ~saved & line.rlike(LOG_FAILED)
    return {
        "f_solve_time": F.when(solve, F.regexp_extract(line, LOG_SOLVE_TIME, 1).try_cast("double")),
        "f_status": F.when(status, F.regexp_extract(line, LOG_STATUS, 1)).when(
            aborted, F.lit("Solver_Failed")
        ),
        "f_iterations": F.when(
            iters, F.regexp_extract(line, LOG_ITERATIONS, 1).try_cast("bigint")
        ).when(aborted, F.lit(ITERATION_SENTINEL).cast("bigint")),
        "f_total_time": F.when(total, F.regexp_extract(line, LOG_TOTAL_TIME, 1).try_cast("double")),
        "f_anchor": F.when(saved, F.lit("saved")).when(failed, F.lit("failed")),
        "f_anchor_path": F.when(saved, F.regexp_extract(line, LOG_SAVED, 1)).when(
            failed, F.regexp_extract(line, LOG_FAILED, 1)
        ),
    }


def solve_succeeded(anchor: Column, status: Column) -> Column:
    """A failed anchor is a failure; otherwise the status decides, and no status means unknown."""
    return F.when(anchor == "failed", F.lit(False)).when(
        status.isNotNull(), status.isin(GOOD_STATUSES)
    )
