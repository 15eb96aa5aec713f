"""Row-local operators on a stream of sentences: attack, tokens and scores need no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import edit_distance
from ..operators.perturb import composed
from ..operators.tokens import sentence_tokens


def attacked(stream: DataFrame, key: str, text: str, attacks: Sequence[tuple[str, float]], seed: int = 0) -> DataFrame:
    """The stream with attacked text, its tokens and the edit distance; works on batches alike."""
    new = composed(F.col(text), attacks, F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return stream.withColumn("attacked", new).withColumns({"tokens": sentence_tokens(F.col("attacked")), "distance": edit_distance(F.col(text), F.col("attacked"))})
