"""The fuzzy prior: words that a token may stand for, whole or in pieces, with probabilities.

Kernel. A weighted semi-global edit distance of one token against all dictionary words of one length at a time, in
numpy; cells carry the set of match starts as bits. From distances and spans come edges of a lattice over the
token, from these the best ways to cut it. Tokens are solved once each (distinct), the dictionary, which is bounded by
MOST_WORDS, goes to the tasks as a broadcast.

Defined cases: tokens longer than 63 characters and empty tokens stand for themselves; an empty dictionary leaves
every token as it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.chars import ALL_CHARS, LETTERS, NUMBERS, SMALL_LETTERS, VOWELS, glyph_similarity

#: Words of a dictionary that may be broadcast.
MOST_WORDS = 200_000
FAR = 100.0


@dataclass(frozen=True)
class Config:
    """Hyper-parameters; the switches turn single discounts off."""

    del_scaler: float = 0.75
    num_hyps: int = 10
    min_prob: float = 0.07
    prob_softmax: float = 1.0
    hyp_softmax: float = 10.0
    freq_scale: float = 2.0
    top_n: int = 4
    cheap_ins: bool = True
    cheap_sub: bool = True
    cheap_del: bool = True
    anagrams: bool = True
    swaps: bool = True
    pieces: int = 4


def softmax(x: Sequence[float], theta: float = 1.0) -> np.ndarray:
    e = np.exp(np.asarray(x, float) * theta)
    return e / e.sum() if e.sum() else np.full(len(e), 1 / max(1, len(e)))


class Words:
    """A dictionary in order of length, with frequency ranks, and morphemes."""

    def __init__(self, words: Sequence[str], ranks: dict[str, int], morphemes: Sequence[str] = ()) -> None:
        self.words, self.ranks, self.morphemes = list(words), ranks, list(morphemes)
        self.buckets = self._bucketed(self.words)
        self.piece_buckets = self._bucketed(self.morphemes)
        self.first, self.last = np.array([w[:1] for w in self.words], str), np.array([w[-1:] for w in self.words], str)
        self.letters = np.array([[w.count(c) for c in LETTERS] for w in self.words], np.int16).reshape(-1, len(LETTERS))

    @staticmethod
    def _bucketed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and characters (padded) of the words, by rising length."""
        lengths = np.array([len(w) for w in words], int)
        at = np.argsort(lengths, kind="stable")
        at = at[lengths[at] > 0]
        out = np.zeros((len(at), int(lengths.max(initial=0))), np.int32)
        for r, i in enumerate(at):
            out[r, : lengths[i]] = [ord(c) for c in words[i]]
        return at, lengths[at], out


class Costs:
    def __init__(self, source: str, config: Config) -> None:
        self.source, self.config = source, config
        self.no_vowels = all(c not in VOWELS and c in ALL_CHARS for c in source)
        self.seen: dict[str, int] = {}
        for c in source:
            self.seen[c] = self.seen[c] + 1 if c in self.seen else 1 if c in LETTERS else 3

    def insert(self, c: str) -> float:
        return 0.3 if self.config.cheap_ins and self.no_vowels and c in VOWELS else 1.0

    def delete(self, c: str) -> float:
        return self.config.del_scaler ** (self.seen[c] - 1) if self.config.cheap_del else 1.0

    def substitute(self, target: str, source: str) -> float:
        if not self.config.cheap_sub or source in ALL_CHARS or target not in SMALL_LETTERS + NUMBERS:
            return 1.0
        return max(0.0, min(1.0, (0.8 - glyph_similarity(source, target)) * 3))


def _solve(costs: Costs, targets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least cost of each target (padded rows by rising length) inside the source, whether it ends at each place, and the starts of each end as bits.

    All lengths advance together; at each character only the targets that still have one take part.
    """
    source, one = costs.source, np.uint64(1)
    n, k = len(source), len(targets)
    src = np.array([ord(c) for c in source], np.int32)
    known = np.unique(targets)
    code = np.searchsorted(known, targets)
    names = [chr(c) for c in known]
    insert = np.array([costs.insert(c) for c in names])[code] if k else np.zeros(targets.shape)
    sub = np.array([[0.0 if t == s else costs.substitute(t, s) for s in source] for t in names]).reshape(len(names), n)
    delete = [costs.delete(c) for c in source]
    best, ends, starts = np.empty(k), np.empty((k, n + 1), bool), np.empty((k, n + 1), np.uint64)
    last_cost = np.zeros((n + 1, k))
    last_start = np.repeat((one << np.arange(n + 1, dtype=np.uint64))[:, None], k, axis=1)
    older: tuple[np.ndarray, np.ndarray] | None = None
    done = 0
    for i in range(1, int(lengths.max(initial=0)) + 1):
        skip = int(np.searchsorted(lengths, i)) - done
        if skip:
            done += skip
            last_cost, last_start = last_cost[:, skip:], last_start[:, skip:]
            older = (older[0][:, skip:], older[1][:, skip:]) if older else None
        ins, letter, now = insert[done:, i - 1], code[done:, i - 1], targets[done:, i - 1]
        c, s = np.empty((n + 1, k - done)), np.empty((n + 1, k - done), np.uint64)
        c[0], s[0] = last_cost[0] + ins, one
        for j in range(1, n + 1):
            ways = [(last_cost[j] + ins, last_start[j]), (last_cost[j - 1] + sub[letter, j - 1], last_start[j - 1]), (c[j - 1] + delete[j - 1], s[j - 1])]
            if costs.config.swaps and i > 2 and j > 2:
                crossed = (now == src[j - 2]) & (targets[done:, i - 2] == src[j - 1])
                if crossed.any():
                    ways.append((np.where(crossed, older[0][j - 2] + 1, np.inf), older[1][j - 2]))
            least = np.minimum(np.minimum(ways[0][0], ways[1][0]), ways[2][0])
            if len(ways) > 3:
                least = np.minimum(least, ways[3][0])
            bits = np.zeros(k - done, np.uint64)
            for w, b in ways:
                bits |= b * (w == least)
            c[j], s[j] = least, bits
        to = int(np.searchsorted(lengths, i, "right"))
        own = slice(0, to - done)
        if to > done:
            best[done:to] = c[:, own].min(axis=0)
            ends[done:to] = (c[:, own] == best[done:to]).T
            starts[done:to] = s[:, own].T
        older, last_cost, last_start = (last_cost, last_start), c, s
    return best, ends, starts


def _spans(ends: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """All (start, end) of one target."""
    own = []
    for e in np.flatnonzero(ends).tolist():
        b = int(starts[e])
        while b:
            low = b & -b
            own.append((low.bit_length() - 1, e))
            b ^= low
    return own


def _longest(ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length of the longest span of each target: its first start is the lowest bit."""
    low = starts & (~starts + np.uint64(1))
    first = np.log2(np.maximum(low, np.uint64(1)).astype(float)).astype(int)
    return np.where(ends & (starts > 0), np.arange(ends.shape[1]) - first, 0).max(axis=1, initial=0)


def distances(costs: Costs, targets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Least cost of each target (rows of equal length) inside the source, and all its (start, end) spans."""
    best, ends, starts = _solve(costs, targets, np.full(len(targets), targets.shape[1]))
    return best, [_spans(e, s) for e, s in zip(ends, starts, strict=True)]


def anagram_scores(source: str, words: Words) -> np.ndarray:
    own = np.array([source.count(c) for c in LETTERS])
    unknown = sum(c not in LETTERS for c in source)
    score = 1.0 + 2 * unknown + 2 * np.abs(words.letters - own).sum(axis=1)
    first, last = words.first == source[0], words.last == source[-1]
    return score * np.where(first, 0.7, 1.0) * np.where(last, 0.8, 1.0)


Slot = list[tuple[str, float]]
Hypothesis = tuple[list[int], float, list[Slot]]


def word_hypotheses(source: str, words: Words, config: Config, with_slots: bool = True) -> list[Hypothesis]:
    """(cuts, cost, slots) of the best ways to read the source, at most num_hyps; a slot holds all its (word, probability), best first.

    Only words that the search never reached (distance FAR) are left out of a whole token's slot, if its best is below FAR / 2: their mass
    is less than their number times exp((best - FAR) * prob_softmax).
    """
    if not source or len(source) > 63 or not words.words:
        return [([0, len(source)], 0.0, [[(source, 1.0)]])]
    costs, n = Costs(source, config), len(source)
    whole = np.full(len(words.words), FAR)
    ana = anagram_scores(source, words) if config.anagrams else None
    edges: dict[tuple[int, int], list[tuple[float, str]]] = {}
    least = np.inf

    def enter(spans: list[tuple[int, int]], cost: float, word: str, morpheme: bool) -> None:
        cost += 0.5
        if morpheme:
            cost += 0.3
        elif word in words.ranks:
            cost += words.ranks[word] / len(words.ranks) * config.freq_scale / len(word)
        elif any(c.isalnum() for c in word):
            cost += config.freq_scale / len(word)
        for a, b in spans:
            if b - a >= n or cost >= b - a or (morpheme and a == 0):
                continue
            for to in range(max(a + 1, b - 1), min(b + 2, n + 1)):
                moved = sum(map(costs.delete, source[to:b])) if to < b else sum(map(costs.insert, source[b:to]))
                edges.setdefault((a, to), []).append((cost + moved, f"##{word}" if morpheme else word))

    at, lengths, targets = words.buckets
    low = 0
    while low < len(at):
        over = int(lengths[low]) - n
        if not costs.no_vowels and over > least + 1:
            break
        # the lengths up to a little above the source's at once, then some more at a time; without an early stop all
        high = len(at) if costs.no_vowels else int(np.searchsorted(lengths, max(n + 1, int(lengths[low]) + 2), "right"))
        cost, ends, starts = _solve(costs, targets[low:high, : int(lengths[high - 1])], lengths[low:high])
        longest = _longest(ends, starts)
        fill = n - longest
        full = cost + fill
        if ana is not None:
            full = np.minimum(full, ana[at[low:high]])
        stop = False
        for a in np.unique(lengths[low:high]):
            x, y = np.searchsorted(lengths[low:high], a), np.searchsorted(lengths[low:high], a, "right")
            over = int(a) - n
            if not costs.no_vowels and over > least + 1:
                stop = True
                break
            running = np.minimum.accumulate(np.concatenate(([least], full[x:y])))
            reach = y - x if costs.no_vowels else int(np.argmax(np.append(over > running[:-1] + 1, True)))
            whole[at[low + x : low + x + reach]] = full[x : x + reach]
            least = float(running[reach])
            for r in np.flatnonzero((fill[x : x + reach] > 0) & (cost[x : x + reach] + 0.5 < longest[x : x + reach])) + x:
                enter(_spans(ends[r], starts[r]), float(cost[r]), words.words[at[low + r]], False)
        if stop:
            break
        low = high
    at, lengths, targets = words.piece_buckets
    if len(at):
        cost, ends, starts = _solve(costs, targets, lengths)
        longest = _longest(ends, starts)
        for r in np.flatnonzero(cost + 0.8 < longest):
            enter(_spans(ends[r], starts[r]), float(cost[r]), words.morphemes[at[r]], True)
    best = float(whole.min())
    nearest: dict[int, list[tuple[int, float]]] = {}
    for (a, b), found in sorted(edges.items()):
        d = min(found)[0]
        if d < best:
            nearest.setdefault(a, []).append((b, d))
    paths = k_best_paths(nearest, n, config.num_hyps, config.pieces)
    ranked = sorted([([0, n], best), *paths], key=lambda p: p[1])[: config.num_hyps]
    out = []
    for cuts, cost in ranked:
        slots = []
        for a, b in zip(cuts, cuts[1:], strict=False) if with_slots else ():
            pairs = list(zip(whole, words.words, strict=True)) if (a, b) == (0, n) else edges[a, b]
            p = softmax([-d for d, _ in pairs], config.prob_softmax)
            top = np.argsort(-p, kind="stable")
            if (a, b) == (0, n) and best < FAR / 2:
                top = top[whole[top] < FAR]
            slots.append([(pairs[i][1], float(p[i])) for i in top])
        out.append((cuts, cost, slots))
    return out


def k_best_paths(edges: dict[int, list[tuple[int, float]]], n: int, k: int, pieces: int) -> list[tuple[list[int], float]]:
    """The k cheapest chains of up to pieces edges from 0; characters after the last one cost 1 each. The empty chain counts."""
    layer: dict[int, list[tuple[float, list[int]]]] = {0: [(0.0, [0])]}
    found = [(float(n), [0])]
    for _ in range(pieces):
        grown: dict[int, list[tuple[float, list[int]]]] = {}
        for a, paths in layer.items():
            for b, d in edges.get(a, ()):
                grown.setdefault(b, []).extend((c + d, [*cuts, b]) for c, cuts in paths)
        layer = {b: heapq.nsmallest(k, paths) for b, paths in grown.items()}
        found += [(c + n - b, cuts) for b, paths in layer.items() for c, cuts in paths]
    return [(cuts, c) for c, cuts in heapq.nsmallest(k, found)]


def k_best_sums(lists: Sequence[Sequence[float]], k: int) -> list[tuple[float, list[int]]]:
    """The k smallest sums that take one value of each list, exactly, with the places taken; ties by the places."""
    best: list[tuple[float, list[int]]] = [(0.0, [])]
    for values in lists:
        best = heapq.nsmallest(k, [(c + v, [*at, i]) for c, at in best for i, v in enumerate(values)])
    return best


SLOT = "struct<word:string,p:double>"
WORD_HYPS = f"token string, hyps array<struct<cuts:array<int>,cost:double,slots:array<array<{SLOT}>>>>"


def _refuse_large(words: Words) -> None:
    if len(words.words) > MOST_WORDS:
        raise ValueError(f"the dictionary has more than {MOST_WORDS} words")


def solve_tokens(tokens: DataFrame, words: Words, config: Config | None = None, slots: bool = True) -> DataFrame:
    """token, hyps for the distinct tokens of a frame (token); without slots, which hold the whole dictionary, where only cuts and costs count."""
    config = config or Config()
    _refuse_large(words)
    held = tokens.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["token"]:
                out.append([{"cuts": c, "cost": d, "slots": [[{"word": w, "p": p} for w, p in s] for s in own]} for c, d, own in word_hypotheses(t, held.value, config, slots)])
            yield pd.DataFrame({"token": b["token"], "hyps": out})

    distinct = tokens.select("token").filter("token is not null").distinct()
    return distinct.repartition(4 * distinct.sparkSession.sparkContext.defaultParallelism, "token").mapInPandas(run, WORD_HYPS)


def within(tokens: DataFrame, words: Words, most: float, config: Config | None = None) -> DataFrame:
    """token, word, cost: the words whose best match inside a distinct token costs most at the highest, before any anagram score.

    Tokens above 63 characters and empty ones have no row.
    """
    config = config or Config()
    _refuse_large(words)
    held = tokens.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lengths, targets = held.value.buckets
        for b in batches:
            for t in b["token"]:
                best = _solve(Costs(t, config), targets, lengths)[0]
                near = np.flatnonzero(best <= most)
                if len(near):
                    yield pd.DataFrame({"token": [t] * len(near), "word": [held.value.words[i] for i in at[near]], "cost": best[near]})

    distinct = tokens.select("token").filter(F.length("token").between(1, 63)).distinct()
    return distinct.repartition(4 * distinct.sparkSession.sparkContext.defaultParallelism, "token").mapInPandas(run, "token string, word string, cost double")


def best_sums(costs: DataFrame, by: list[str], place: str, cost: str, k: int = 10) -> DataFrame:
    """by, k (from 0), cost, picks: the k cheapest ways to take one cost at each place of a group, with the costs that they take.

    A group is a sentence, whose length bounds what meets in one row; ties go to the cheaper pick at the first place that differs.
    """
    at = costs.groupBy(*by, place).agg(F.sort_array(F.collect_list(cost)).alias("_costs"))
    lists = at.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(place, "_costs"))).alias("_lists"))
    schema = T.StructType([*[lists.schema[c] for c in by], T.StructField("k", T.LongType()), T.StructField("cost", T.DoubleType()), T.StructField("picks", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for own in b.to_pylist():
                values = [x["_costs"] for x in own["_lists"]]
                rows += [{**{c: own[c] for c in by}, "k": i, "cost": c_, "picks": [v[j] for v, j in zip(values, places, strict=True)]} for i, (c_, places) in enumerate(k_best_sums(values, k))]
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    return lists.mapInArrow(run, schema)


_SLOTS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("p", T.DoubleType())])))
HYPS = T.ArrayType(T.StructType([T.StructField("p", T.DoubleType()), T.StructField("cost", T.DoubleType()), T.StructField("slots", _SLOTS)]))


def sentence_words(tokens: DataFrame, solved: DataFrame, key: list[str]) -> DataFrame:
    """key, words: the solutions of each sentence's tokens in order. They meet in one row, which the sentence's length and the dictionary bound."""
    return tokens.join(solved, "token").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "hyps"))).alias("words"))


def readings(words: list[dict], config: Config) -> list[dict]:
    """The most probable readings of a sentence's words; readings share their slots."""
    lists = [w["hyps"] for w in words]
    sums = k_best_sums([[h["cost"] for h in hyps] for hyps in lists], config.num_hyps)
    p = softmax([-c for c, _ in sums], config.hyp_softmax)
    keep = [i for i in sorted(range(len(p)), key=lambda i: (-p[i], i)) if p[i] >= config.min_prob * p.max()]
    return [{"p": float(p[i]), "cost": sums[i][0], "slots": [s for hyps, j in zip(lists, sums[i][1], strict=True) for s in hyps[j]["slots"]]} for i in keep]


def sentence_hypotheses(tokens: DataFrame, solved: DataFrame, key: list[str], config: Config | None = None) -> DataFrame:
    """key, hyps: the most probable readings of each sentence from tokens (key, pos, token) and their solutions."""
    config = config or Config()
    joined = sentence_words(tokens, solved, key)
    schema = T.StructType([*[tokens.schema[k] for k in key], T.StructField("hyps", HYPS)])
    kind = to_arrow_type(HYPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], pa.array([readings(w, config) for w in b.column("words").to_pylist()], kind)], [*key, "hyps"])

    return joined.mapInArrow(run, schema)


def likely(costs: DataFrame, by: list[str], key: str, cost: str, theta: float = 1.0, least: float = 0.07, k: int = 10) -> DataFrame:
    """by, key, p: of each group the k hypotheses of largest probability (softmax of -cost), if it is at least a share of the largest; ties by key."""
    w = Window.partitionBy(*by)
    t = costs.withColumn("p", stats.softmax(-F.col(cost), theta, by)).withColumns({"_most": F.max("p").over(w), "_k": F.row_number().over(w.orderBy(F.desc("p"), key))})
    return t.filter((F.col("p") >= least * F.col("_most")) & (F.col("_k") <= k)).select(*by, key, "p")


def lattice_paths(edges: DataFrame, by: str, k: int = 10, pieces: int = 4, length: int = 10) -> DataFrame:
    """by, k, cost: the k cheapest chains of up to pieces edges (a, b, d) from 0 in each lattice; what is left up to length costs 1 a character.

    By joins and windows: each step keeps the best k for each place, for tables of lattices; :func:`k_best_paths` solves one.
    """
    step = edges.select(by).distinct().select(by, F.lit(0).alias("to"), F.lit(0.0).alias("cost"))
    every = step
    for _ in range(pieces):
        grown = step.join(edges, (step[by] == edges[by]) & (step["to"] == edges["a"])).select(step[by], F.col("b").alias("to"), (F.col("cost") + F.col("d")).alias("cost"))
        step = grown.withColumn("_n", F.row_number().over(Window.partitionBy(by, "to").orderBy("cost"))).filter(F.col("_n") <= k).drop("_n")
        every = every.unionByName(step)
    ranked = every.select(by, (F.col("cost") + length - F.col("to")).alias("cost")).withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("cost")).cast("long"))
    return ranked.filter(F.col("k") <= k).select(by, "k", "cost")


def truth_ranks(candidates: DataFrame, source: str, truth: str, target: str, score: str) -> DataFrame:
    """source, rank (from 0): how many candidates score below the true word."""
    own = candidates.filter(F.col(truth) == F.col(target)).select(source, F.col(score).alias("_own"))
    return candidates.join(own, source).groupBy(source).agg(F.count_if(F.col(score) < F.col("_own")).alias("rank"))


def plain_prior(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """The ablation baseline: tokens with known (in the dictionary) and p of each candidate: 1, or 1 over the dictionary's size."""
    size = words.agg(F.count(F.lit(1)).alias("n_words"))
    flagged = tokens.join(words.select(F.col("word").alias("token"), F.lit(True).alias("hit")), "token", "left")
    return flagged.crossJoin(F.broadcast(size)).select(*tokens.columns, F.coalesce("hit", F.lit(False)).alias("known"), F.when(F.col("hit"), F.lit(1.0)).otherwise(1.0 / F.col("n_words")).alias("p"))
