"""Exact order statistics whose memory use does not grow with the group.

The keys and values are written to the checkpoint folder once, whatever query they come from. Groups
under the row limit are sorted as one bounded array. Larger groups are narrowed instead: count values per
bin, keep the bin that holds the wanted rank, bin again inside it, until what is left fits the limit.
Bins are on a signed log scale while a bracket spans magnitudes, linear afterwards, so any distribution
narrows in a handful of scans of those values, all columns in each. Brackets stay in a table as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.vectors import is_finite
from trajspark.plans.ordering import group_limit, split_hot
from trajspark.plans.scratch import cut_lineage

BINS = 4096


def _position(n: Column, p: float) -> Column:
    return F.lit(p) * (n - 1).cast("double")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, dict[str, float]],
    method: str = "linear",
) -> DataFrame:
    """``keys`` plus the named quantiles of each value column: {value: {output: probability}}.

    Non-finite values are ignored. ``linear`` interpolates between neighbours, ``nearest`` takes the
    round-half-even position.
    """
    keys = list(keys)
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], wanted, method).drop("_all")
    values = {c: F.col(c).cast("double") for c in wanted}
    rows = cut_lineage(df.select(*keys, *[F.when(is_finite(x), x).alias(c) for c, x in values.items()]))
    cold, hot = split_hot(rows, keys)
    small = cold.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(c)).alias(c) for c in wanted]  # nulls are skipped
    )
    picked = small.select(
        *keys,
        *[
            F.when(
                F.size(c) > 0,
                _pick(_position(F.size(c), p), method, lambda i, c=c: F.try_element_at(c, (i + 1).cast("int"))),
            ).alias(name)
            for c, probs in wanted.items()
            for name, p in probs.items()
        ],
    )
    if hot is None:
        return picked
    entries = [F.struct(F.lit(c).alias("_c"), F.col(c).alias("_x")) for c in wanted]
    found = _narrowed(hot.select(*keys, F.inline(F.array(*entries))).where("_x IS NOT NULL"), keys, wanted, method)
    return picked.unionByName(hot.select(*keys).distinct().join(found, keys, "left"))


def _pick(pos: Column, method: str, at) -> Column:
    if method == "nearest":
        return at(F.bround(pos, 0).cast("bigint"))
    lo, hi = at(F.floor(pos)), at(F.ceil(pos))
    return lo + (hi - lo) * (pos - F.floor(pos))


def _scaled(x: Column) -> Column:
    """Monotone map of any finite double onto [-2100, 2100]."""
    size = F.greatest(F.log2(F.abs(x)) + 1075.0, F.lit(0.0))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * size)


def _narrowed(rows: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]], method: str) -> DataFrame:
    """``keys`` and the outputs from long rows (keys, _c: column name, _x: value)."""
    limit = group_limit(rows.sparkSession)
    group, x, lo, hi = [*keys, "_c"], F.col("_x"), F.col("_lo"), F.col("_hi")
    totals = cut_lineage(rows.groupBy(*group).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_n")))
    probes = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(float(p)).alias("p")) for c, of in wanted.items() for p in of.values()])

    def ranks(probe: Column) -> Column:
        pos = _position(F.col("_n"), probe["p"])
        places = [F.bround(pos, 0)] if method == "nearest" else [F.floor(pos), F.ceil(pos)]
        return F.array(*[x.cast("bigint") for x in places])

    asked = F.flatten(F.transform(F.filter(probes, lambda s: s["c"] == F.col("_c")), ranks))
    state = totals.select(
        *group, F.explode(F.array_distinct(asked)).alias("_r"), "_lo", "_hi",
        F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_inside"),
    )
    wide = _scaled(hi) - _scaled(lo) > 1.0
    share = F.when(wide, (_scaled(x) - _scaled(lo)) / (_scaled(hi) - _scaled(lo))).otherwise((x - lo) / (hi - lo))
    frame = Window.partitionBy(*group, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    narrow = (lo == hi) | (F.col("_inside") <= limit)
    while True:
        state = cut_lineage(state)
        open_ = state.where(~narrow)
        if open_.isEmpty():
            break
        bins = (
            rows.join(open_.select(*group, "_lo", "_hi", "_below").distinct(), group)
            .where(x.between(lo, hi))
            .withColumn("_bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
            .groupBy(*group, "_lo", "_hi", "_below", "_bin")
            .agg(F.count("*").alias("_count"), F.min("_x").alias("_nlo"), F.max("_x").alias("_nhi"))
            .withColumn("_nb", F.col("_below") + F.coalesce(F.sum("_count").over(frame), F.lit(0)))
            .drop("_below")
        )
        hits = open_.join(bins, [*group, "_lo", "_hi"]).where(
            (F.col("_r") >= F.col("_nb")) & (F.col("_r") < F.col("_nb") + F.col("_count"))
        )
        state = state.where(narrow).unionByName(
            hits.select(*group, "_r", F.col("_nlo").alias("_lo"), F.col("_nhi").alias("_hi"), F.col("_nb").alias("_below"), F.col("_count").alias("_inside"))
        )
    flat = state.where(lo == hi).select(*group, "_r", lo.alias("_value"))
    left = state.where(lo < hi)
    sorted_ = (
        rows.join(left.select(*group, "_lo", "_hi").distinct(), group)
        .where(x.between(lo, hi))
        .groupBy(*group, "_lo", "_hi")
        .agg(F.sort_array(F.collect_list("_x")).alias("_s"))  # at most the row limit
    )
    exact = left.join(sorted_, [*group, "_lo", "_hi"]).select(
        *group, "_r", F.element_at("_s", (F.col("_r") - F.col("_below") + 1).cast("int")).alias("_value")
    )
    by_rank = flat.unionByName(exact).groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_value"))).alias("_m"))
    ranked = by_rank.join(totals.select(*group, "_n"), group).groupBy(*keys).agg(
        *[F.first(F.when(F.col("_c") == c, F.struct("_m", "_n")), ignorenulls=True).alias(f"_of_{i}") for i, c in enumerate(wanted)]
    )

    def at(i: int):
        return lambda pos: F.element_at(F.col(f"_of_{i}._m"), pos.cast("bigint"))

    return ranked.select(
        *keys,
        *[
            _pick(_position(F.col(f"_of_{i}._n"), p), method, at(i)).alias(name)
            for i, of in enumerate(wanted.values())
            for name, p in of.items()
        ],
    )
