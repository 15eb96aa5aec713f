"""Mixing of sources to target weights by pivotal dependent rounding of copy counts.

A source takes target / size copies of each of its documents: the whole part for all, and the fraction by
dependent rounding. Pairs of fractional documents exchange mass (words) at random until one of them is
integral, so that expectations hold for each document and the sum of words for the source. Large documents
go first, so that the one left over is small. The work is a
reduction tree: groups of bounded size reduce to one fractional document each, and these meet in the next
level, until one is left for each source, which goes to the nearer side; what this adds or lacks passes on to
other documents of the last group. So a source misses its target by about a small document.

Defined cases: null and empty texts have size 0 and are taken 0 times; rows of equal doc_id, source and
size are pre-aggregated and share one decision; null sources are a source of their own, last in order;
null doc_ids are kept; extra columns pass through, but for those called size, source_size, target or copies, which the result has anew; an
empty table gives an empty result. Draws are hashes of the seed and the rows, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, forget, fresh, n_words

WEIGHTS, MOST_COPIES, GROUP = (1, 2, 3), 3.0, 2048


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of total by weight, none above most * size; what a full source can't take is shared by the others."""
    target, full = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    while not full.all():
        left = total - target[full].sum()
        share = left * weights / weights[~full].sum()
        over = ~full & (share > most * sizes)
        if not over.any():
            target[~full] = share[~full]
            break
        target[over], full = most * sizes[over], full | over
    return target


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: one row for each source of sized (source, size).

    Weights repeat over the sources by code point, null last. The table of sources, one row each, meets in
    one task; the rows of a source are summed before.
    """

    def plan(batch: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(batch["source"], batch["source_size"], strict=True), key=lambda r: (r[0] is None, r[0] or ""))
        size = np.array([r[1] for r in rows], float)
        weight = np.array([weights[i % len(weights)] for i in range(len(rows))], float)
        return pd.DataFrame({"source": [r[0] for r in rows], "source_size": [r[1] for r in rows], "target": water_fill(size, weight, size.sum(), most)})

    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return by_source.groupBy(F.lit(0).alias("all")).applyInPandas(plan, "source string, source_size long, target double")


def _draw(*key: object) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little") / 2**64


def _against(p: list[float], mass: list[float], keys: list, i: int, rest: range, seed: int) -> None:
    """Exchanges mass between i and all of rest together, in equal proportion whichever way, as far as their room goes."""
    room = [min(p[k], 1 - p[k]) for k in rest]
    total = sum(r * mass[k] for r, k in zip(room, rest, strict=True))
    up, down = min((1 - p[i]) * mass[i], total), min(p[i] * mass[i], total)
    if not total or not 0 < p[i] < 1:
        return
    moved = up if _draw(seed, "all", keys[i]) * (up + down) < down else -down
    p[i] = _snap(p[i] + moved / mass[i])
    for r, k in zip(room, rest, strict=True):
        p[k] = _snap(p[k] - moved * r / total)


def _snap(x: float) -> float:
    return float(round(x)) if min(x, 1 - x) < 1e-9 else x


def rounded(p: list[float], mass: list[float], keys: list, seed: int) -> list[float]:
    """p, in order of falling mass, with all but one rounded: the one left is of the smallest documents.

    The larger half is rounded by pairs, what is left of it gives way to the smaller half as a whole, and so on.
    """
    p, at = list(p), 0
    while len(p) - at > 8:
        half = at + (len(p) - at) // 2
        p[at:half] = pivotal(p[at:half], mass[at:half], keys[at:half], seed)
        for i in range(at, half):
            if 0 < p[i] < 1:
                _against(p, mass, keys, i, range(half, len(p)), seed)
                if 0 < p[i] < 1:  # the smaller half is used up: its rest is paired with this one
                    return pivotal(p, mass, keys, seed)
        at = half
    return p[:at] + pivotal(p[at:], mass[at:], keys[at:], seed)


def pivotal(p: list[float], mass: list[float], keys: list, seed: int) -> list[float]:
    """One pass of pairwise exchanges; all but one of the results are 0 or 1."""
    p = list(p)
    open_ = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if open_ < 0:
            open_ = i
            continue
        j = open_
        up = min((1 - p[i]) * mass[i], p[j] * mass[j])  # words from j to i
        down = min(p[i] * mass[i], (1 - p[j]) * mass[j])
        moved = up if _draw(seed, keys[i], keys[j]) * (up + down) < down else -down
        a, b = p[i] + moved / mass[i], p[j] - moved / mass[j]
        p[i], p[j] = _snap(a), _snap(b)
        open_ = next((k for k in (i, j) if 0 < p[k] < 1), -1)
    return p


def settled(start: list[float], p: list[float], mass: list[float], close: float = 1e-3) -> list[float]:
    """p with the last fraction rounded; its residual passes on to other documents until it is at most close times the sum.

    Each step changes the one document, or exchanges the two, that bring the sum nearest to that of start. Only
    documents that came in as fractions change.
    """
    p, m, s = np.array([float(x >= 0.5) for x in p]), np.array(mass), np.array(start)
    free = np.flatnonzero((s > 0) & (s < 1))
    over, enough = float(((p - s) * m).sum()), close * float((s * m).sum())
    for _ in range(64):
        if abs(over) <= enough:
            break
        on, off = ((x := free[p[free] == side])[np.argsort(m[x], kind="stable")] for side in (1, 0))
        best: tuple = (abs(over), ())
        for i in (*on, *off):
            best = min(best, (abs(over + m[i] * (1 - 2 * p[i])), (i,)), key=lambda x: x[0])
        if len(off):
            for i in on:
                at = int(np.searchsorted(m[off], m[i] - over))
                for j in off[max(0, at - 1) : at + 1]:
                    best = min(best, (abs(over - m[i] + m[j]), (i, j)), key=lambda x: x[0])
        if not best[1]:
            break
        for i in best[1]:
            over += m[i] * (1 - 2 * p[i])
            p[i] = 1 - p[i]
    return p.tolist()


def _level(seed: int, last: bool):
    def reduce(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["mass", "doc_id", "size"], ascending=[False, True, True], na_position="last")
        keys = list(zip(g["source"], g["doc_id"].astype(str), g["size"], strict=True))
        start, mass = g["p"].tolist(), g["mass"].tolist()
        p = rounded(start, mass, keys, seed)
        return g.assign(p=settled(start, p, mass) if last else p)

    return reduce


def copies(docs: DataFrame, seed: int = 7, weights: tuple = WEIGHTS, most: float = MOST_COPIES, group: int = GROUP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row for each distinct (doc_id, source, size) of docs; a written table."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size")
    units, n = counted(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    plan = cut(targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, most))
    planned = units.join(plan, units["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = planned.withColumn("q", F.when(F.col("size") > 0, share).otherwise(F.lit(0.0)))
    planned = planned.withColumn("whole", F.floor(F.col("q") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("q") - F.col("whole"))).withColumn("mass", (F.col("size") * F.col("rows")).cast("double"))
    level = planned.select("doc_id", "source", "size", "source_size", "target", "whole", "p", "mass")
    levels = [units, plan]
    done: list[DataFrame] = []
    while True:
        groups = max(1, -(-n // group))
        dealt = level.groupBy("source", F.pmod(F.xxhash64("doc_id", "size"), F.lit(groups)).alias("deal"))
        level = cut(dealt.applyInPandas(_level(seed, groups == 1), "doc_id long, source string, size long, source_size long, target double, whole long, p double, mass double"))
        levels.append(level)
        done.append(level.filter("p = 0 or p = 1"))
        if groups == 1:
            break
        level, n = level.filter("p > 0 and p < 1"), groups
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = cut(out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies")))
    forget(*levels)
    return out


def _with_copies(docs: DataFrame, plan: DataFrame, size) -> DataFrame:
    """docs joined with their rows of the plan."""
    d, s, n = (fresh(x, docs.columns) for x in ("_doc", "_source", "_size"))
    plan = plan.select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n), "size", "source_size", "target", "copies")
    on = docs["doc_id"].cast("long").eqNullSafe(plan[d]) & docs["source"].eqNullSafe(plan[s]) & (size == plan[n])
    return docs.join(plan, on).drop(d, s, n)


def mixed(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with size, source_size, target and copies.

    The plan needs ids, sources and sizes only; texts meet it in one join, in which they are shuffled once where the plan is too large to broadcast.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    size = n_words(docs[text])
    return _with_copies(docs, copies(docs.select("doc_id", "source", size.alias("size")), **how), size)


def mixed_sizes(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of docs, without texts, which are read once."""
    sized = cut(docs.select("doc_id", "source", n_words(F.col(text)).alias("size")))
    bare = sized.withColumnRenamed("size", "_words")
    return _with_copies(bare, copies(sized, **how), bare["_words"]).drop("_words")
