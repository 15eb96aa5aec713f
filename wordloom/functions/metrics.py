"""Scores of a hypothesis against a reference, as Column functions; token arrays where they compare tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(ref: Column, hyp: Column) -> Column:
    return F.levenshtein(F.lower(ref), F.lower(hyp)).cast("long")


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array, joined by spaces; none if it is shorter."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _occurrence(grams: Column) -> Column:
    """Grams with the number of their occurrence so far, so that clipped overlap is that of sets: sorted, then numbered within runs."""
    ordered = F.array_sort(grams)
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, g: Column) -> Column:
        n = F.when(acc["last"] == g, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("last"), n.alias("n"), F.concat(acc["out"], F.array(F.concat_ws("#", g, n.cast("string")))).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: acc["out"])


def clipped(ref: Column, hyp: Column, n: int) -> Column:
    """How many n-grams of hyp are in ref, each as often as it is there at most."""
    return F.size(F.array_intersect(_occurrence(ngrams(hyp, n)), _occurrence(ngrams(ref, n)))).cast("double")


def ngram_precision(ref: Column, hyp: Column, n: int) -> Column:
    return F.when(F.size(hyp) >= n, clipped(ref, hyp, n) / (F.size(hyp) - n + 1)).otherwise(F.lit(0.0))


def bleu(ref: Column, hyp: Column, most: int = 4) -> Column:
    """Geometric mean of clipped precisions up to most, times the brevity penalty; no smoothing, so 0 if one of them is."""
    parts = [ngram_precision(ref, hyp, n) for n in range(1, most + 1)]
    mean = F.exp(sum((F.log(p) for p in parts[1:]), F.log(parts[0])) / most)
    brevity = F.when(F.size(hyp) >= F.size(ref), F.lit(1.0)).otherwise(F.exp(1 - F.size(ref) / F.size(hyp)))
    zero = F.least(*parts) <= 0 if most > 1 else parts[0] <= 0
    return F.when(zero, F.lit(0.0)).otherwise(mean * brevity)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row."""
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        start = F.array(F.lit(0))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), start, lambda acc, j: F.concat(acc, F.array(F.when(F.element_at(b, j) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(acc, j))))))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(a, zero, row), -1)).cast("long")


def rouge_n_precision(ref: Column, hyp: Column, n: int) -> Column:
    return ngram_precision(ref, hyp, n)


def rouge_l_precision(ref: Column, hyp: Column) -> Column:
    """With weight 1, rouge-w is the same."""
    return F.when(F.size(hyp) > 0, common_subsequence(ref, hyp) / F.size(hyp)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def letter_counts(word: Column) -> Column:
    """Counts of A-Z and a-z, in that order."""
    letters = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
    return F.transform(letters, lambda c: F.length(word) - F.length(F.replace(word, c, F.lit(""))))


def anagram_score(source: Column, target: Column) -> Column:
    """1 + 2 for each unknown character and each missing or surplus letter; less if first or last characters agree."""
    unknown = F.length(F.regexp_replace(source, "[A-Za-z]", ""))
    gap = F.aggregate(F.zip_with(letter_counts(source), letter_counts(target), lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)
    same = lambda i, f: F.when(F.substring(source, i, 1) == F.substring(target, i, 1), F.lit(f)).otherwise(F.lit(1.0))
    return (1 + 2 * unknown + 2 * gap) * same(1, 0.7) * same(-1, 0.8)
