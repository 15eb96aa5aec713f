"""Sampling, assignment and filters of studies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.chars import uniform
from .tokens import numbered


def sample_per_group(df: DataFrame, by: list[str], key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group, by a keyed draw."""
    order = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def replicated(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, with copy from 1."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def balanced_assignment(df: DataFrame, truth: str, key: str, lists: int) -> DataFrame:
    """df with list (0 to lists - 1, or null for a row without a place): the shortest list first that lacks the row's truth.

    The order is part of the meaning, so the rows of a study (a few thousand stimuli) meet in one task.
    """
    types = dict(df.dtypes)

    def assign(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        held: list[set] = [set() for _ in range(lists)]
        size, out = [0] * lists, []
        for t in g[truth]:
            fit = [i for i in range(lists) if t not in held[i]]
            place = min(fit, key=lambda i: (size[i], i)) if fit else None
            if place is not None:
                held[place].add(t)
                size[place] += 1
            out.append(place)
        return pd.DataFrame({key: g[key], truth: g[truth], "list": pd.array(out, "Int64")})

    return df.select(key, truth).groupBy(F.lit(0).alias("all")).applyInPandas(assign, f"{key} {types[key]}, {truth} {types[truth]}, list long")


def round_robin(df: DataFrame, truth: str, key: str, lists: int) -> DataFrame:
    """df with list: the rows of a truth go to lists in turn, from a keyed start; near equal lists, none with a truth twice while it has no more rows than there are lists. No task holds more than one truth."""
    turn = F.row_number().over(Window.partitionBy(truth).orderBy(key)) - 1
    return df.select(key, truth).withColumn("list", F.pmod(F.floor(uniform("list", F.col(truth)) * lists) + turn, F.lit(lists)).cast("long"))


def submitted(trials: DataFrame, who: str, status: str, done: str, barred: list) -> DataFrame:
    """The rows of participants who have a row with the done status and aren't barred."""
    finished = trials.filter(F.col(status) == done).select(who).distinct()
    out = trials.join(finished, who, "left_semi")
    return out.filter(~F.col(who).isin(barred)) if barred else out


def answers(eav: DataFrame, who: str, question: str, answer: str, questions: list[str]) -> DataFrame:
    """One row for each participant, one column for each question: the number of answers and their mean."""
    return eav.groupBy(who).pivot(question, questions).agg(F.count(F.lit(1)).alias("n"), F.avg(answer).alias("mean"))


def last_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of each group that is last in order."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_chunks(df: DataFrame, order: str, n: int, ranges: int = 256) -> DataFrame:
    """df with chunk (0 to n - 1): contiguous by a number or a string, near equal; nulls first, ties in any order.

    Rows are ordered inside ranges only: those between quantiles of the numbers, or of strings with equal first characters.
    """
    if isinstance(df.schema[order].dataType, T.NumericType):
        bounds = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
        place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
        place = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(place)
    else:
        place = F.coalesce(F.substring(order, 1, 3), F.lit(""))
    rows = df.withColumn("_range", place)
    total = rows.count()
    small, more = divmod(total, n)
    ranked = numbered(rows, ["_range"], [F.col("_range")], order)
    edge = more * (small + 1)
    chunk = F.when(F.col("rank") < edge, F.floor(F.col("rank") / (small + 1))).otherwise(more + F.floor((F.col("rank") - edge) / max(1, small)))
    return ranked.select(*df.columns, chunk.cast("int").alias("chunk"))


def keyed_shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(uniform(seed, F.col(key)), key)
