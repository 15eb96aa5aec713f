"""Evaluation of documents, of people, and of both against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import metrics, stats
from ..functions.chars import uniform
from ..functions.stems import stems
from .study import last_wins


def normal(text: Column) -> Column:
    """Lower case, without spaces around and one final full stop."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\.\z", "")


def scored(pairs: DataFrame, ref: str = "text", hyp: str = "attacked", stemmed: bool = False) -> DataFrame:
    """pairs with bleu, rouge1, rouge4, rougel, distance and perfect, over tokens between spaces; the rouge scores over their stems if asked for."""
    r, h = F.split(ref, " "), F.split(hyp, " ")
    x, y = (stems(r), stems(h)) if stemmed else (r, h)
    return pairs.withColumns({
        "bleu": metrics.bleu(r, h), "rouge1": metrics.rouge_n_precision(x, y, 1), "rouge4": metrics.rouge_n_precision(x, y, 4),
        "rougel": metrics.rouge_l_precision(x, y), "distance": metrics.edit_distance(F.col(ref), F.col(hyp)), "perfect": normal(F.col(ref)) == normal(F.col(hyp)),
    })


def document_scores(scored: DataFrame, by: Sequence[str], names: Sequence[str] = ("bleu", "rouge1", "rouge4", "rougel", "distance")) -> DataFrame:
    """by, the mean of each score, the share and number of perfect pairs, and the number of pairs."""
    return scored.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names], F.avg(F.col("perfect").cast("double")).alias("perfect_share"), F.count_if("perfect").alias("n_perfect"), F.count(F.lit(1)).alias("n"))


def members(rows: DataFrame, chosen: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows that are among the chosen the first of each by order."""
    w = Window.partitionBy(*on).orderBy(*order)
    return rows.join(chosen.select(*on).distinct(), list(on), "left_semi").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def subset_scores(scored: DataFrame, chosen: DataFrame, by: Sequence[str], on: Sequence[str], value: str, least: int = 10) -> DataFrame:
    """by and the mean of a value over the chosen rows; null for fewer than least of them."""
    own = scored.join(chosen.select(*on).distinct(), list(on), "left_semi")
    return own.groupBy(*by).agg(stats.supported(F.avg(value), least).alias(value), F.count(F.lit(1)).alias("n"))


def beside_machine(human: DataFrame, machine: DataFrame, attack: str = "attack", truth: str = "truth") -> DataFrame:
    """human (attack, truth, ...) with the machine's cleaned text of the same attack and truth (attack, truth, cleaned); rows of equal truth in normal form meet, the least text if there are several."""
    m = machine.groupBy(attack, normal(F.col(truth)).alias("_truth")).agg(F.min("cleaned").alias("cleaned"))
    return human.withColumn("_truth", normal(F.col(truth))).join(m, [attack, "_truth"]).drop("_truth")


def replaced(results: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """results with the new ones added; those of a key that is there already take its place."""
    both = results.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    return last_wins(both, list(key), ["_turn"]).drop("_turn")


def beside_mean(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """df with the mean of a value over its group, NaN left aside."""
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    return df.withColumn(f"mean_{value}", F.avg(clean).over(Window.partitionBy(*by)))


def participants(trials: DataFrame, who: str, status: str, done: str, level: str, value: str) -> DataFrame:
    """level, n_people, n_trials, mean: the trials of people who have one with the done status, by level."""
    finished = trials.filter(F.col(status) == done).select(who).distinct()
    return trials.join(finished, who, "left_semi").groupBy(level).agg(F.count_distinct(who).alias("n_people"), F.count(F.lit(1)).alias("n_trials"), F.avg(value).alias("mean"))


def turnout(trials: DataFrame, who: str, status: str, done: str) -> DataFrame:
    """n_people, n_done, n_rejected, per_person: one row."""
    own = trials.groupBy(who).agg(F.max((F.col(status) == done).cast("int")).alias("d"), F.count(F.lit(1)).alias("n"))
    return own.agg(F.count(F.lit(1)).alias("n_people"), F.sum("d").cast("long").alias("n_done"), (F.count(F.lit(1)) - F.sum("d")).cast("long").alias("n_rejected"), F.avg("n").alias("per_person"))


def one_dropped(people: DataFrame, condition: str, who: str, seed: int = 0) -> DataFrame:
    """people (condition, who) without one, by a keyed draw, of each condition that has several."""
    w = Window.partitionBy(condition)
    draw = F.row_number().over(w.orderBy(uniform(seed, F.col(condition), F.col(who)), who))
    return people.select(condition, who).distinct().withColumns({"_n": F.count(F.lit(1)).over(w), "_k": draw}).filter("_n = 1 or _k > 1").drop("_n", "_k")


def search_space(spark, n: int, seed: int = 0) -> DataFrame:
    """trial, top_n (1 to 10), bert_theta and gtp_theta (below 1 and 0.02): keyed draws for a random search."""
    t = spark.range(n).withColumnRenamed("id", "trial")
    return t.select("trial", (F.floor(uniform(seed, "top", F.col("trial")) * 10) + 1).cast("long").alias("top_n"), uniform(seed, "bert", F.col("trial")).alias("bert_theta"), (uniform(seed, "gtp", F.col("trial")) * 0.02).alias("gtp_theta"))
