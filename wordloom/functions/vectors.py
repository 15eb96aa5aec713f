"""Vectors against vectors: a stated set of queries, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries to a block: what a task holds and what is broadcast at once (4,096 vectors of 64 doubles are 2 MB).
BLOCK = 4096


def _blocks(queries: DataFrame, key: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, block by block; the driver holds one at a time."""
    ids: list[int] = []
    rows: list[list[float]] = []
    for r in queries.select(key, vector).toLocalIterator(prefetchPartitions=True):
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == BLOCK:
            yield np.array(ids), np.array(rows, float)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, float)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, neighbour, distance: the k nearest rows of each query among all others, ties by id.

    Every task keeps its own best k of each query, so that tasks times queries times k rows meet.
    """

    def part(ids: np.ndarray, q: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = pd.DataFrame({"q": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "d": pd.Series(dtype=float)})
            for b in batches:
                if not len(b):
                    continue
                x, own = np.array(b["v"].tolist(), float).reshape(len(b), -1), b["id"].to_numpy()
                for at in range(0, len(q), 256):
                    d = np.stack([np.sqrt(((r - x) ** 2).sum(-1)) for r in q[at : at + 256]])
                    d[ids[at : at + 256, None] == own[None]] = np.inf
                    limit = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                    row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
                    best = pd.concat([best, pd.DataFrame({"q": ids[at + row], "n": own[col], "d": d[row, col]})])
                best = best.sort_values(["q", "d", "n"]).groupby("q").head(k)
            yield best

        return run

    source, out = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")), None
    for ids, q in _blocks(queries, key, vector):
        own = source.mapInPandas(part(ids, q), "q long, n long, d double")
        out = own if out is None else out.unionByName(own)
    if out is None:
        return source.select(F.col("id").alias(key), F.col("id").alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
    top = out.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy("d", "n"))).filter(F.col("k") <= k)
    return top.select(F.col("q").alias(key), F.col("n").alias("neighbour"), F.col("d").alias("distance"))


def cosine_range(vectors: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """least, mean, most: cosine of the queries with all other rows; rows without length are left out. One row."""

    def part(ids: np.ndarray, q: np.ndarray):
        unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.array(b["v"].tolist(), float).reshape(len(b), -1)
                c = unit @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T if len(b) else np.empty((len(q), 0))
                c = c[ids[:, None] != b["id"].to_numpy()[None]]
                if len(c):
                    yield pd.DataFrame({"lo": [c.min()], "total": [c.sum()], "hi": [c.max()], "n": [len(c)]})

        return run

    source, out = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")), None
    for ids, q in _blocks(queries, key, vector):
        own = source.mapInPandas(part(ids, q), "lo double, total double, hi double, n long")
        out = own if out is None else out.unionByName(own)
    out = source.select(F.lit(0.0).alias("lo"), F.lit(0.0).alias("total"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("n")).limit(0) if out is None else out
    return out.agg(F.min("lo").alias("least"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"), F.max("hi").alias("most"))


def mean_vectors(df: DataFrame, by: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """by, i, mean: the weighted mean of each element over the rows of a group."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    e = df.select(*by, w.alias("_w"), F.posexplode(vector).alias("i", "x"))
    return e.groupBy(*by, "i").agg(F.try_divide(F.sum(F.col("x").cast("double") * F.col("_w")), F.sum("_w")).alias("mean"))


def closest(rows: DataFrame, letters: DataFrame, key: str, vector: str, name: str, most: int = 10_000) -> DataFrame:
    """key, name: of the letters (name, vector; at most most of them, which is checked) the one of largest cosine with each row."""
    if letters.count() > most:
        raise ValueError(f"more than {most} letters")
    from .metrics import cosine

    every = letters.agg(F.collect_list(F.struct(F.col(name).alias("l"), F.col(vector).alias("x"))).alias("_letters"))
    pairs = rows.select(key, F.col(vector).alias("_v")).join(F.broadcast(every), F.lit(True))
    best = F.array_max(F.transform("_letters", lambda s: F.struct(cosine(F.col("_v"), s["x"]).alias("c"), s["l"].alias("l"))))
    return pairs.select(key, best["l"].alias(name), best["c"].alias("cosine"))


def relaxed_mover(ref: DataFrame, hyp: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by, distance: the mean over a hypothesis' vectors of the distance to the nearest vector of its reference (rows of equal by)."""
    from .metrics import euclid

    pairs = hyp.select(*by, F.monotonically_increasing_id().alias("_h"), F.col(vector).alias("_x")).join(ref.select(*by, F.col(vector).alias("_y")), by)
    near = pairs.groupBy(*by, "_h").agg(F.min(euclid(F.col("_x"), F.col("_y"))).alias("d"))
    return near.groupBy(*by).agg(F.avg("d").alias("distance"))
