"""The spell-checker baseline, and cleaners that plug in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A cleaner maps a table (key..., text) to (key..., text).
Cleaner = Callable[[DataFrame], DataFrame]


def corrections(tokens: DataFrame, words: DataFrame, most: int = 2) -> DataFrame:
    """token, correction, distance: of each distinct token the word (word, freq) of least distance up to most, then frequency.

    Words of near length only meet a token: an equi-join on length, each token at 2 * most + 1 lengths.
    """
    t = tokens.select("token").distinct()
    near = t.withColumn("len", F.explode(F.sequence(F.length("token") - most, F.length("token") + most))).join(words.withColumn("len", F.length("word")), "len")
    d = near.withColumn("d", F.levenshtein("token", "word", most)).filter("d >= 0")
    return d.groupBy("token").agg(F.min_by("word", F.struct("d", -F.col("freq"), "word")).alias("correction"), F.min("d").cast("long").alias("distance"))


def corrected(texts: DataFrame, key: list[str], text: str, words: DataFrame, most: int = 2) -> DataFrame:
    """key, text: in lower case, split at spaces, each unknown token replaced by its correction; tokens without one stay."""
    t = texts.select(*key, F.posexplode(F.split(F.lower(text), " ")).alias("pos", "token"))
    better = corrections(t.filter("token != ''"), words, most).select("token", "correction")
    new = t.join(better, "token", "left").withColumn("token", F.coalesce("correction", "token"))
    return new.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), " ").alias(text))


def cleaned(pairs: DataFrame, key: list[str], text: str, attack: Callable, cleaner: Cleaner) -> DataFrame:
    """key, attacked, cleaned: the texts after an attack (a function of columns) and after a cleaner."""
    attacked = pairs.select(*key, attack(F.col(text)).alias(text))
    return attacked.withColumnRenamed(text, "attacked").join(cleaner(attacked).select(*key, F.col(text).alias("cleaned")), key)
