"""Restoration of attacked sentences: tokens, prior of distinct tokens, readings, posterior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import posterior, prior
from ..operators.tokens import exploded, sentence_tokens


def words_from(tokens: DataFrame, least_piece: int = 2) -> prior.Words:
    """The dictionary of a frame (word), a row for each occurrence: words in order of length, frequency ranks; endings of frequent words as morphemes.

    The distinct words come to the driver, so a frame with more than MOST_WORDS of them is refused.
    """
    counted = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "word").limit(prior.MOST_WORDS + 1).collect()
    if len(counted) > prior.MOST_WORDS:
        raise ValueError("the corpus has too many distinct words; pass a dictionary")
    ranks = {r.word: i for i, r in enumerate(counted)}
    known = [r.word for r in counted if r.word.isalpha()]
    ends: dict[str, int] = {}
    for w in known:
        for n in range(least_piece, min(4, len(w) - 2) + 1):
            ends[w[-n:]] = ends.get(w[-n:], 0) + 1
    pieces = sorted(sorted(ends, key=lambda e: (-ends[e], e))[:40])
    return prior.Words(sorted(ranks, key=lambda w: (len(w), w)), ranks, pieces)


def words_of(corpus: DataFrame, text: str = "text", least_piece: int = 2) -> prior.Words:
    """The dictionary of a clean corpus, from its ASCII words and signs."""
    tokens = corpus.select(F.explode(sentence_tokens(F.col(text))).alias("word")).filter(F.col("word").rlike("^[a-z0-9]+$|^[^a-z0-9A-Z]$"))
    return words_from(tokens, least_piece)


def restore(sentences: DataFrame, key: list[str], text: str, words: prior.Words, provider: posterior.Provider | None, config: prior.Config | None = None, **how) -> DataFrame:
    """key, posterior, sentence for each sentence that has a token."""
    tokens = exploded(sentences, key, sentence_tokens(F.col(text)))
    solved = prior.solve_tokens(tokens, words, config)
    return posterior.restored_words(prior.sentence_words(tokens, solved, key), key, provider, config, **how)
