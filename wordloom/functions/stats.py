"""Statistics over tables: rank correlation, t-tests, softmax by group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def average_ranks(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """value, group and average rank: from counts of distinct values, so that only these are ordered."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(value)
    return counts.select(*by, value, (F.sum("n").over(w) - (F.col("n") - 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, rho; null where one side has a single value."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx, ry = (average_ranks(df, c, by).withColumnRenamed("rank", f"_{k}") for c, k in ((x, "rx"), (y, "ry")))
    return df.join(rx, [*by, x]).join(ry, [*by, y]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _ratio(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("rho"))


def t_test(df: DataFrame, value: str, flag: str, by: list[str], pooled: bool = True) -> DataFrame:
    """by, t, dof for values with flag 0 against 1: equal variances (pooled), or Welch's; null without spread or with too few values."""
    s = df.groupBy(*by).agg(*[f(F.when(F.col(flag) == k, F.col(value).cast("double"))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = _ratio(F.col("v0"), F.col("n0")), _ratio(F.col("v1"), F.col("n1"))
    if pooled:
        dof = (F.col("n0") + F.col("n1") - 2).cast("double")
        var = _ratio((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), dof)
        error = F.sqrt(var * (_ratio(F.lit(1.0), F.col("n0")) + _ratio(F.lit(1.0), F.col("n1"))))
    else:
        dof = _ratio((a + b) * (a + b), _ratio(a * a, F.col("n0") - 1) + _ratio(b * b, F.col("n1") - 1))
        error = F.sqrt(a + b)
    return s.select(*by, _ratio(F.col("m0") - F.col("m1"), error).alias("t"), dof.alias("dof"))


def softmax(x: Column, theta: float, by: list[str]) -> Column:
    """Share of exp(theta * x) in its group; the group's largest is subtracted first, so that no value overflows."""
    w = Window.partitionBy(*by)
    e = F.exp(x * theta - F.max(x * theta).over(w))
    return e / F.sum(e).over(w)


def mean_of_numbers(c: str) -> Column:
    """Mean without NaN."""
    return F.avg(F.when(~F.isnan(c), F.col(c)))


def weighted_mean(m: str, n: str) -> Column:
    """Mean of means m of n values each; null without values."""
    return F.try_divide(F.sum(F.col(m) * F.col(n)), F.sum(n))


def supported(value: Column, least: int = 10) -> Column:
    """An aggregate, null for groups of fewer than least rows."""
    return F.when(F.count(F.lit(1)) >= least, value)


def with_p_value(tests: DataFrame) -> DataFrame:
    """tests (t, dof) with p, two-sided; null where one of them is."""

    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else t_p_value(float(a), float(b)) for a, b in zip(t, dof, strict=True)], dtype=float)

    return tests.withColumn("p", p("t", "dof"))


def t_p_value(t: float, dof: float) -> float:
    """Two-sided p value by the continued fraction of the incomplete beta function."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / ((1 + num * d) or 1e-300), (1 + num / c) or 1e-300
                h *= d * c
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b
