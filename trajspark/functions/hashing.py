"""Stable hashes in [0, 1), split assignment and seeded draws."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trajspark.schema import SPLIT_FRACTIONS, SPLIT_NAMES


def unit_md5(key: Column, seed: int) -> Column:
    """JVM-only unit hash: the first 32 bits of md5("seed|key")."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def unit_blake2b(key: Column, seed: int) -> Column:
    """Unit hash from an 8-byte blake2b digest (no JVM builtin, so an Arrow UDF over unique keys)."""

    @F.pandas_udf("double")
    def digest(keys: pd.Series) -> pd.Series:
        def one(k: str) -> float:
            raw = hashlib.blake2b(f"{seed}|{k}".encode(), digest_size=8).digest()
            return int.from_bytes(raw, "big") / 2.0**64

        return keys.map(one, na_action="ignore")

    return digest(key.cast("string"))


def check_fractions(fractions: Sequence[float], names: Sequence[str]) -> None:
    if len(fractions) != len(names):
        raise ValueError(f"{len(fractions)} fractions for {len(names)} split names")
    if min(fractions) < 0 or abs(math.fsum(fractions) - 1.0) > 1e-9:
        raise ValueError(f"split fractions must be non-negative and sum to 1: {fractions}")


def split_of(
    u: Column,
    fractions: Sequence[float] = SPLIT_FRACTIONS,
    names: Sequence[str] = SPLIT_NAMES,
) -> Column:
    """First split whose cumulative fraction exceeds ``u``, else the last one."""
    check_fractions(fractions, names)
    out, edge = None, 0.0
    for name, fraction in zip(names, fractions):
        edge += fraction
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return out.otherwise(names[-1])


def environment_seed(base_seed: Column) -> Column:
    """First 32-bit Mersenne Twister draw for each base seed."""

    @F.pandas_udf("bigint")
    def draw(seeds: pd.Series) -> pd.Series:
        return seeds.map(lambda s: random.Random(int(s)).getrandbits(32))

    return draw(base_seed)
