"""Linear probes of feature tables: ridge with alpha selection, controls and the raw-window audit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.arrow import matrix, strings
from trajspark.operators.linalg import collect_parts, r2_from_sums, ridge_solve, split_means, summed_parts
from trajspark.operators.windows import flat_history, target_slices
from trajspark.plans.ordering import hash_rank
from trajspark.schema import RIDGE_ALPHAS, TARGETS

SHUFFLED = "shuffled_labels"


def permute_labels(
    df: DataFrame,
    key: Column,
    label: str,
    seed: int,
    out: str,
    split: str = "split",
    source_split: str = "train",
) -> DataFrame:
    """``out`` = labels of the source split in a seeded random order; other splits keep their own.

    Rows are ranked in two independent hash orders and matched rank to rank, so the result is a true
    permutation that does not depend on partitioning.
    """
    train = df.where(F.col(split) == source_split)
    left = hash_rank(train, F.concat(F.lit(f"{seed}|to|"), key.cast("string")), "_rank")
    right = hash_rank(
        train.select(key.cast("string").alias("_key"), F.col(label).alias(out)),
        F.concat(F.lit(f"{seed}|from|"), F.col("_key")),
        "_rank",
    ).select("_rank", out)
    moved = left.join(right, "_rank").drop("_rank")
    rest = df.where(F.col(split) != source_split).withColumn(out, F.col(label))
    return moved.unionByName(rest)


class _Fit:
    """Training moments of every (features, labels) pair a probe run needs."""

    def __init__(self, df: DataFrame, pairs: dict[str, tuple[str, str]], split: str, train: str):
        self.pairs, self.split = pairs, split
        self.arrays = list(dict.fromkeys(a for xy in pairs.values() for a in xy))
        self.means = split_means(df, self.arrays, split)
        if train not in self.means:
            raise ValueError(f"no rows in split {train!r}")
        mean = self.means[train]

        def reduce_batch(batch):
            pick = strings(batch, split) == train
            data = {a: matrix(batch, a)[pick] - mean[a] for a in self.arrays}
            out = {}
            for x, y in self.pairs.values():
                if f"{x}|" not in out:
                    out[f"{x}|"] = data[x].T @ data[x]
                if f"{x}|{y}" not in out:
                    out[f"{x}|{y}"] = data[x].T @ data[y]
            return out

        sums = collect_parts(summed_parts(df, [split, *self.arrays], reduce_batch))
        self.mean = mean
        self.xx = {x: sums[f"{x}|"].reshape(len(mean[x]), -1) for x, _ in pairs.values()}
        self.xy = {
            (x, y): sums[f"{x}|{y}"].reshape(len(mean[x]), len(mean[y])) for x, y in pairs.values()
        }

    def weights(self, alphas: Sequence[float]) -> dict[tuple[str, str], np.ndarray]:
        """(pairs) -> stacked weights of every alpha, shape (alphas, d, targets)."""
        return {
            (x, y): np.stack([ridge_solve(self.xx[x], self.xy[x, y], a) for a in alphas])
            for x, y in self.xy
        }

    def residuals(self, df: DataFrame, weights, truth: dict[str, str], splits: Sequence[str]):
        """Residual and total sums of squares per (split, pair) in one pass over the rows.

        ``truth`` names the label column a pair is scored against (shuffled labels are only fitted).
        """
        mean, means = self.mean, self.means
        scored = list(dict.fromkeys([*self.arrays, *truth.values()]))

        def reduce_batch(batch):
            labels, out = strings(batch, self.split), {}
            data = {a: matrix(batch, a) for a in scored}
            for s in splits:
                pick = labels == s
                if not pick.any():
                    continue
                for x, y in weights:
                    actual = data[truth[y]][pick]
                    guess = (data[x][pick] - mean[x]) @ weights[x, y] + mean[y]
                    out[f"{s}|{x}|{y}|res"] = ((actual - guess) ** 2).sum(axis=1)
                    out[f"{s}|{x}|{y}|tot"] = ((actual - means[s][truth[y]]) ** 2).sum(axis=0)
            return out

        sums = collect_parts(summed_parts(df, [self.split, *scored], reduce_batch))
        return sums


def _mean(values: np.ndarray) -> float:
    live = values[~np.isnan(values)]
    return float(live.mean()) if len(live) else float("nan")


def recovery(
    df: DataFrame,
    arms: dict[str, str],
    labels: str,
    slices: dict[str, tuple[int, int]],
    key: Column,
    alphas: Sequence[float] = RIDGE_ALPHAS,
    shuffle_seed: int = 0,
    split: str = "split",
    splits: tuple[str, str, str] = ("train", "val", "test"),
    control: bool = True,
) -> DataFrame:
    """Probe every target slice from every feature arm, plus a shuffled-label chance floor.

    ``arms`` maps arm name -> feature array column; ``labels`` is one packed array. Alpha is chosen per
    (target, arm) by validation R² (first best wins) and the test score is reported; a target that is
    constant on the validation split keeps its row, with NULL scores. Three passes over
    the rows cover all arms, targets and alphas together.
    """
    train, val, test = splits
    pairs = {name: (col, labels) for name, col in arms.items()}
    work = df
    if control:
        work = permute_labels(df, key, labels, shuffle_seed, "_shuffled", split, train)
        pairs[SHUFFLED] = (next(iter(arms.values())), "_shuffled")
    work = work.select(
        split, *dict.fromkeys([*arms.values(), labels] + (["_shuffled"] if control else []))
    ).persist()
    try:
        fit = _Fit(work, pairs, split, train)
        weights = fit.weights(alphas)
        truth = {labels: labels, "_shuffled": labels}
        absent = [s for s in (val, test) if s not in fit.means]
        if absent:
            raise ValueError(f"no rows in split {absent[0]!r}")
        sums = fit.residuals(work, weights, {y: truth[y] for _, y in weights}, [val, test])
    finally:
        work.unpersist()
    rows = []
    for target, (at, width) in slices.items():
        for arm, (x, y) in pairs.items():
            score = {}
            for s in (val, test):
                tot = sums[f"{s}|{x}|{y}|tot"][at : at + width]
                res = sums[f"{s}|{x}|{y}|res"].reshape(len(alphas), -1)[:, at : at + width]
                score[s] = [r2_from_sums(r, tot, np.nan) for r in res]
            val_means = [_mean(v) for v in score[val]]
            best = None
            for i, m in enumerate(val_means):
                if not np.isnan(m) and (best is None or m > val_means[best]):
                    best = i
            if best is None:  # a constant target has no score to select alpha by
                rows.append((target, arm, None, [None] * width, None, None, width))
                continue
            channels = score[test][best]
            rows.append(
                (
                    target,
                    arm,
                    _mean(channels),
                    [None if np.isnan(c) else float(c) for c in channels],
                    float(alphas[best]),
                    float(val_means[best]),
                    int(np.isnan(channels).sum()),
                )
            )
    return df.sparkSession.createDataFrame(
        rows,
        "target string, arm string, r2 double, r2_per_channel array<double>, alpha double, "
        "val_r2 double, n_constant_channels int",
    )


def ridge_probe(
    df: DataFrame, features: str, labels: str, width: int, key: Column, **kwargs
) -> DataFrame:
    """``recovery`` for a single arm and one target, without the control."""
    return recovery(
        df, {"features": features}, labels, {"target": (0, width)}, key, control=False, **kwargs
    )


def linear_audit(
    windows: DataFrame,
    alpha: float = 1e-3,
    threshold: float = 0.9,
    split: str = "split",
    hist: str = "state_hist",
    packed: str = "targets",
) -> DataFrame:
    """Test R² of each packed target from the flattened history window; constant channels count as 0.

    ``disqualified`` marks targets a linear map already recovers; ``surprise`` marks those whose
    declared kind disagrees with that.
    """
    work = windows.select(split, flat_history(hist).alias("_x"), F.col(packed).alias("_y")).where(
        F.col(split).isin("train", "test")
    ).persist()
    try:
        fit = _Fit(work, {"raw": ("_x", "_y")}, split, "train")
        if "test" not in fit.means:
            raise ValueError("no rows in split 'test'")
        sums = fit.residuals(work, fit.weights([alpha]), {"_y": "_y"}, ["test"])
    finally:
        work.unpersist()
    r2 = r2_from_sums(sums["test|_x|_y|res"], sums["test|_x|_y|tot"], 0.0)
    rows = []
    for name, width, kind, _ in TARGETS:
        at = target_slices()[name][0]
        score = float(np.mean(r2[at : at + width]))
        out = score > threshold
        rows.append((name, kind, width, score, out, (kind == "linear_trivial") != out))
    return windows.sparkSession.createDataFrame(
        rows,
        "target string, expected_kind string, width int, r2_raw_window double, disqualified boolean, "
        "surprise boolean",
    )

