"""Bayesian re-ranking of readings: slots by a masked likelihood, sentences by their score.

A provider gives likelihoods; the default counts bigrams of a corpus. Providers for language models can be plugged in:
anything that has slot_scores and sentence_score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.chars import let
from .prior import Config, Slot, readings, softmax

#: Distinct pairs of words that a bigram provider may hold on the driver and in a task.
MOST_PAIRS = 2_000_000


class Provider(Protocol):
    def slot_scores(self, slots: Sequence[Slot], at: int, words: Sequence[str]) -> list[float]: ...

    def sentence_score(self, words: Sequence[str]) -> float: ...


class Bigrams:
    """Add-k bigram likelihoods; soft context: neighbours count by their probability."""

    def __init__(self, pairs: dict[tuple[str, str], int], k: float = 0.1) -> None:
        self.pairs, self.k = pairs, k
        self.left: dict[str, int] = {}
        self.next: dict[str, dict[str, int]] = {}
        self.last: dict[str, dict[str, int]] = {}
        for (a, b), n in pairs.items():
            self.left[a] = self.left.get(a, 0) + n
            self.next.setdefault(a, {})[b] = self.last.setdefault(b, {})[a] = n
        self.size = max(1, len({b for _, b in pairs}))

    def log(self, a: str, b: str) -> float:
        return math.log((self.pairs.get((a, b), 0) + self.k) / (self.left.get(a, 0) + self.k * self.size))

    def slot_scores(self, slots: Sequence[Slot], at: int, words: Sequence[str]) -> list[float]:
        before = slots[at - 1] if at else [("<s>", 1.0)]
        after = slots[at + 1] if at + 1 < len(slots) else [("</s>", 1.0)]
        none, rest = math.log(self.k), self.k * self.size
        start = sum(p * (none - math.log(self.left.get(a, 0) + rest)) for a, p in before)
        mass = sum(p for _, p in after)
        known = [(d, p) for d, p in [*((self.next.get(a), p) for a, p in before), *((self.last.get(b), p) for b, p in after)] if d]
        out = []
        for w in words:
            score = start + mass * (none - math.log(self.left.get(w, 0) + rest))
            for d, p in known:
                if w in d:
                    score += p * (math.log(d[w] + self.k) - none)
            out.append(score)
        return out

    def sentence_score(self, words: Sequence[str]) -> float:
        """Minus the perplexity."""
        chain = ["<s>", *words, "</s>"]
        return -math.exp(-sum(self.log(a, b) for a, b in zip(chain, chain[1:], strict=False)) / (len(chain) - 1))


def bigram_counts(tokens: DataFrame) -> DataFrame:
    """a, b, n from a column of token arrays, with sentence ends."""
    t = F.concat(F.array(F.lit("<s>")), F.col("tokens"), F.array(F.lit("</s>")))
    pairs = let(t, lambda t: F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    return tokens.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def bigram_provider(tokens: DataFrame) -> Bigrams:
    """A provider of the corpus; raises where its pairs exceed MOST_PAIRS."""
    rows = bigram_counts(tokens).limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"the corpus has more than {MOST_PAIRS} pairs of words; pass a provider")
    return Bigrams({(r.a, r.b): r.n for r in rows})


def _gap(s: Slot) -> float | None:
    if len(s) < 2:
        return None
    p = heapq.nlargest(2, (x for _, x in s))
    return 100.0 if p[0] - p[1] == 1 or p[0] == 0 else p[0] - p[1]


def _context(s: Slot, top_n: int) -> Slot:
    """The top_n words of a slot, normalised."""
    top = heapq.nlargest(top_n, s, key=lambda c: c[1])
    total = sum(p for _, p in top)
    return [(w, p / total) for w, p in top] if total else top


def most_uncertain(slots: Sequence[Slot], masked: Sequence[int]) -> int | None:
    """The slot of the least gap between its two best, plus how often it was taken; the first of equals. None if no slot has two."""
    return _least([_gap(s) for s in slots], masked)


def _least(gaps: Sequence[float | None], masked: Sequence[int]) -> int | None:
    best, place = math.inf, None
    for i, gap in enumerate(gaps):
        if gap is not None and gap + masked[i] < best:
            best, place = gap + masked[i], i
    return place


def least_gap_slots(slots: DataFrame, by: list[str], slot: str, p: str) -> DataFrame:
    """by, slot, gap: the most uncertain slot of each group, for tables of slots (by, slot, p), by the rule of :func:`most_uncertain` before any masking."""
    top = slots.withColumn("_k", F.row_number().over(Window.partitionBy(*by, slot).orderBy(F.desc(p)))).filter("_k <= 2")
    two = top.groupBy(*by, slot).agg(F.max(F.when(F.col("_k") == 1, F.col(p))).alias("_a"), F.max(F.when(F.col("_k") == 2, F.col(p))).alias("_b")).filter("_b is not null")
    t = two.withColumn("gap", F.when((F.col("_a") - F.col("_b") == 1) | (F.col("_a") == 0), F.lit(100.0)).otherwise(F.col("_a") - F.col("_b")))
    return t.groupBy(*by).agg(F.min_by(slot, F.struct("gap", slot)).alias(slot), F.min("gap").alias("gap"))


def slot_posterior(slots: Sequence[Slot], provider: Provider, theta: float = 0.25, rounds: int | None = None, top_n: int = 4) -> list[Slot]:
    """Slots after rounds (one for each slot if none are given) of masking the most uncertain one; prior times likelihood, normalised.

    All words of a slot take part; only the context that its neighbours see is cut to their top_n.
    """
    prior, now, masked = [list(s) for s in slots], [list(s) for s in slots], [0] * len(slots)
    gaps, context = [_gap(s) for s in now], [_context(s, top_n) for s in now]
    for _ in range(len(slots) if rounds is None else rounds):
        at = _least(gaps, masked)
        if at is None:
            break
        masked[at] += 1
        words = [w for w, _ in prior[at]]
        like = softmax(provider.slot_scores(context, at, words), theta)
        joint = [p * x for (_, p), x in zip(prior[at], like, strict=True)]
        total = sum(joint) or 1.0
        now[at] = [(w, j / total) for w, j in zip(words, joint, strict=True)]
        gaps[at], context[at] = _gap(now[at]), _context(now[at], top_n)
    return now


def read_out(slots: Sequence[Slot]) -> list[str]:
    """The most probable word of each slot; ##pieces and hyphens join."""
    out: list[str] = []
    for s in slots:
        word = max(s, key=lambda c: c[1])[0] if s else ""
        piece = word.startswith("##")
        word = word[2:] if piece else word
        if out and (piece or word == "-" or out[-1].endswith("-")):
            out[-1] += word
        else:
            out.append(word)
    return out


def sentence_posterior(hyps: Sequence[tuple[float, Sequence[Slot]]], provider: Provider | None, slot_theta: float = 0.25, theta: float = 0.005, use_slots: bool = True, use_sentence: bool = True, top_n: int = 4) -> list[tuple[float, str]]:
    """(posterior, sentence), best first."""
    read = [read_out(slot_posterior(s, provider, slot_theta, top_n=top_n) if provider and use_slots else s) for _, s in hyps]
    like = softmax([provider.sentence_score(w) for w in read], theta) if provider and use_sentence else [1.0] * len(read)
    joint = [p * x for (p, _), x in zip(hyps, like, strict=True)]
    total = sum(joint) or 1.0
    return sorted(((j / total, " ".join(w)) for j, w in zip(joint, read, strict=True)), reverse=True)


def restored(hyps: DataFrame, key: list[str], provider: Provider | None, **how) -> DataFrame:
    """key, posterior, sentence: the best reading of each row of hyps (key, hyps)."""
    held = hyps.sparkSession.sparkContext.broadcast(provider)
    schema = T.StructType([*[hyps.schema[k] for k in key], T.StructField("posterior", T.DoubleType()), T.StructField("sentence", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [sentence_posterior([(h["p"], [[(c["word"], c["p"]) for c in s] for s in h["slots"]]) for h in hs], held.value, **how)[0] for hs in b.column("hyps").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], pa.array([p for p, _ in best], pa.float64()), pa.array([s for _, s in best], pa.string())], [*key, "posterior", "sentence"])

    return hyps.mapInArrow(run, schema)


def restored_words(words: DataFrame, key: list[str], provider: Provider | None, config: Config | None = None, **how) -> DataFrame:
    """key, posterior, sentence: the best reading of each row of words (key, words), without a table of readings, which would repeat their slots."""
    config = config or Config()
    held = words.sparkSession.sparkContext.broadcast(provider)
    schema = T.StructType([*[words.schema[k] for k in key], T.StructField("posterior", T.DoubleType()), T.StructField("sentence", T.StringType())])

    def read(row: list[dict]) -> tuple[float, str]:
        for w in row:
            for h in w["hyps"]:
                h["slots"] = [[(c["word"], c["p"]) for c in s] for s in h["slots"]]
        return sentence_posterior([(r["p"], r["slots"]) for r in readings(row, config)], held.value, top_n=config.top_n, **how)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [read(w.as_py()) for w in b.column("words")]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], pa.array([p for p, _ in best], pa.float64()), pa.array([s for _, s in best], pa.string())], [*key, "posterior", "sentence"])

    return words.mapInArrow(run, schema)
