"""Similarity of drawn characters: forms of a bitmap, match scores, and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a rotated or mirrored form counts.
TURNED = 0.9


def forms(bitmap: np.ndarray) -> list[np.ndarray]:
    """The 8 rotations and reflections, the bitmap itself first."""
    return [np.rot90(b, k) for b in (bitmap, np.fliplr(bitmap)) for k in range(4)]


def match(a: np.ndarray, b: np.ndarray) -> float:
    """Common ink over the mean ink, the best over the forms of b; 0 without ink."""
    ink = (a.sum() + b.sum()) / 2
    return max(float((a & f).sum()) / ink * (1.0 if k == 0 else TURNED) for k, f in enumerate(forms(b)) if f.shape == a.shape) if ink else 0.0


def best_letters(glyphs: DataFrame, letters: list[tuple[str, list[int]]]) -> DataFrame:
    """code, letter, score: of the letters (name, bits of a square bitmap by rows; a short list) the best match of each glyph (code, bits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [(n, np.array(b, bool).reshape(int(len(b) ** 0.5), -1)) for n, b in letters]
        for b in batches:
            best = []
            for bits in b["bits"]:
                g = np.array(bits, bool)
                g = g.reshape(int(len(g) ** 0.5), -1)
                best.append(max(((match(g, x), n) for n, x in own), key=lambda s: (s[0], s[1])))
            yield pd.DataFrame({"code": b["code"], "letter": [n for _, n in best], "score": [s for s, _ in best]})

    return glyphs.select("code", "bits").mapInPandas(run, "code long, letter string, score double")


def similarities(glyphs: DataFrame, vector: str, parts: int, rounds: int = 20) -> DataFrame:
    """glyphs with vector in few parts: rounds of normalising and centring, then principal components."""
    from pyspark.ml.feature import PCA, Normalizer, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = glyphs.withColumn("_v", array_to_vector(F.col(vector)))
    for _ in range(rounds):
        df = Normalizer(inputCol="_v", outputCol="_n").transform(df).drop("_v")
        df = StandardScaler(inputCol="_n", outputCol="_v", withMean=True, withStd=False).fit(df).transform(df).drop("_n")
    return PCA(k=parts, inputCol="_v", outputCol="_p").fit(df).transform(df).withColumn(vector, vector_to_array("_p")).drop("_v", "_p")
