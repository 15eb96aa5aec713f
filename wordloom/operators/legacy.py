"""Earlier variants of the distance, the prior and the posterior."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.chars import LETTERS, PUNCTUATIONS, chars, glyph_similarity
from .posterior import Provider, Slot
from .prior import softmax

# Marks that end a sentence.
ENDS = "?!;.\""


def contains_each(haystack: Column, needle: Column) -> Column:
    """All characters of the needle are in the haystack."""
    return F.size(F.array_except(chars(needle), chars(haystack))) == 0


def all_equal(word: Column) -> Column:
    return F.size(F.array_distinct(chars(word))) <= 1


def like_anagram(source: Column, target: Column) -> Column:
    """Equal length, and every character of the source occurs in the target."""
    return (F.length(source) == F.length(target)) & contains_each(target, source)


def has_vowel(word: Column) -> Column:
    return word.rlike("[AEIOUaeiou]")


def distance(source: str, target: str, anagrams: bool = True, cheap_sub: bool = True, cheap_swap: float = 0.3, plain_swap: float = 1.0) -> float:
    """The whole of the source against the whole of the target: unit costs, neighbouring characters swapped at plain_swap, or cheap_swap if one is an anagram of the other; characters that look like a letter cost less."""
    swap = cheap_swap if anagrams and len(source) == len(target) and set(source) <= set(target) else plain_swap
    before: list[float] = []
    row = [float(j) for j in range(len(target) + 1)]
    for i, s in enumerate(source, 1):
        new = [float(i)]
        for j, t in enumerate(target, 1):
            cost = 0.0 if s == t else min((1 - glyph_similarity(s, t)) * 2, 1.0) if cheap_sub and s not in LETTERS else 1.0
            best = min(row[j] + 1, new[-1] + 1, row[j - 1] + cost)
            if i > 1 and j > 1 and s == target[j - 2] and source[i - 2] == t and s != t:
                best = min(best, before[j - 2] + swap)
            new.append(best)
        before, row = row, new
    return row[-1]


def distances(pairs: DataFrame, source: str = "source", target: str = "target", **how) -> DataFrame:
    """pairs with distance; equal pairs are solved once for each batch."""

    @F.pandas_udf("double")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple, float] = {}
        return pd.Series([memo[x] if x in memo else memo.setdefault(x, distance(*x, **how)) for x in zip(a, b, strict=True)], dtype=float)

    return pairs.withColumn("distance", solve(source, target))


def word_prior(pairs: DataFrame, source: str = "source", theta: float = 27.0) -> DataFrame:
    """pairs (distance) with p: softmax of 1 / (distance + 1) over the targets of a source."""
    return pairs.withColumn("p", stats.softmax(1 / (F.col("distance") + 1), theta, [source]))


def rank_prior(ranks: DataFrame, theta: float = 1e-5) -> DataFrame:
    """ranks (word, rank) with p: softmax of how many words come after."""
    n = ranks.agg(F.count(F.lit(1)).alias("_n"))
    e = ranks.join(F.broadcast(n), F.lit(True)).withColumn("_e", F.exp((F.col("_n") - F.col("rank")) * theta))
    total = e.agg(F.sum("_e").alias("_t"))
    return e.join(F.broadcast(total), F.lit(True)).select(*ranks.columns, (F.col("_e") / F.col("_t")).alias("p"))


def reweighted(df: DataFrame, p: str, weight: str, by: list[str]) -> DataFrame:
    """df with p times weight, of the same mass in each group."""
    w = Window.partitionBy(*by)
    joint = F.col(p) * F.col(weight)
    return df.withColumn(p, F.try_divide(joint * F.sum(p).over(w), F.sum(joint).over(w)))


def pieces(source: str, first: Sequence[tuple[str, float]], morphemes: Sequence[str], least: float = 0.01) -> list[tuple[float, list[str]]]:
    """Readings (probability, pieces) of a word: a first piece that starts it, then morphemes that consume the rest; chains below least, or half of the best at their step, end."""
    layer = [(p, [w], source[len(w) :]) for w, p in first if source.startswith(w)]
    done = [(p, w) for p, w, rest in layer if not rest]
    layer = [x for x in layer if x[2]]
    while layer:
        grown = [(p / (1 + len(rest) - len(m)), [*w, f"##{m}"], rest[len(m) :]) for p, w, rest in layer for m in morphemes if m and rest.startswith(m)]
        best = max((p for p, _, _ in grown), default=0.0)
        grown = [x for x in grown if x[0] >= max(least, best / 2)]
        done += [(p, w) for p, w, rest in grown if not rest]
        layer = [x for x in grown if x[2]]
    return sorted(done, key=lambda x: (-x[0], x[1]))


def replacements(word: str, options: dict[str, Sequence[tuple[str, float]]]) -> Iterator[tuple[float, str]]:
    """(similarity, word) by falling summed similarity, lazily: each character as one of its options (best first), those without stay."""
    ways = [sorted(options[c], key=lambda x: -x[1]) if c in options else [(c, 0.0)] for c in word]
    at = tuple(0 for _ in ways)
    heap, seen = [(-sum(w[0][1] for w in ways), at)], {at}
    while heap:
        cost, at = heapq.heappop(heap)
        yield -cost, "".join(w[i][0] for w, i in zip(ways, at, strict=True))
        for k, i in enumerate(at):
            after = (*at[:k], i + 1, *at[k + 1 :])
            if i + 1 < len(ways[k]) and after not in seen:
                seen.add(after)
                heapq.heappush(heap, (cost + ways[k][i][1] - ways[k][i + 1][1], after))


def replaced(text: Column, closest: dict[str, str]) -> Column:
    """The text with each character that is no letter, digit or usual mark as the letter it looks like most."""
    known = {c: v for c, v in closest.items() if c not in LETTERS and c not in PUNCTUATIONS}
    return F.translate(text, "".join(known), "".join(known.values())) if known else text


def end_slots(sentences: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, mark, p: for each sentence whose last character ends none, a slot that is uniform over the marks that do."""
    open_ = sentences.filter(~F.substring(text, -1, 1).isin(list(ENDS)))
    return open_.select(*key, F.explode(F.array(*[F.lit(c) for c in ENDS])).alias("mark")).withColumn("p", F.lit(1.0 / len(ENDS)))


def carried_over(solved: DataFrame, other: DataFrame, pair: str, token: str = "token", longer: int = 3) -> DataFrame:
    """other (pair, pos, token) with word and p = 1 where the other sentence of the pair has solved the same token (pair, token, word, sure)."""
    sure = solved.filter(F.col("sure") & (F.length(token) > longer)).groupBy(pair, token).agg(F.min("word").alias("word"))
    return other.join(sure, [pair, token]).select(pair, "pos", token, "word", F.lit(1.0).alias("p"))


def posterior(slots: Sequence[Slot], provider: Provider, how: str = "rounds", rounds: int = 3, theta: float = 0.5) -> list[Slot]:
    """rounds: all slots at once, the posterior is the next prior. live: slots from left to right see those already solved. old: as live, with only the best word of each neighbour as context."""
    now = [list(s) for s in slots]

    def solved(context: Sequence[Slot], at: int) -> Slot:
        words = [w for w, _ in now[at]]
        like = softmax(provider.slot_scores(context, at, words), theta)
        joint = [p * x for (_, p), x in zip(now[at], like, strict=True)]
        total = sum(joint) or 1.0
        return [(w, j / total) for w, j in zip(words, joint, strict=True)]

    if how == "rounds":
        for _ in range(rounds):
            now = [solved(now, i) for i in range(len(now))]
        return now
    for i in range(len(now)):
        now[i] = solved([[(max(s, key=lambda c: c[1])[0], 1.0)] for s in now] if how == "old" else now, i)
    return now
