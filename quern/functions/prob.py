"""Exact two-sided binomial test at one half, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_test_p(better: Column, worse: Column) -> Column:
    """min(1, 2 * P(X <= min)); null without non-tied pairs. Terms are built from logarithms, so large n stays finite."""
    n = (better + worse).cast("int")
    k = F.least(better, worse).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(acc, i):
        t = acc["t"] + F.log((n - i + 1) / i)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step)["s"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))
