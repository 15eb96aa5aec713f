"""Phonetic respelling: letters that stand for phonemes, with counts and back-off by context."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chars import ascii_lower, let, uniform

#: A small aligned table (letters and phones of equal length, with weights); callers bring their own for real use.
ALIGNED = (("through", "t|h|r|ou|gh", "TH|-|R|UW|-", 9), ("true", "t|r|ue", "T|R|UW", 7), ("blue", "b|l|ue", "B|L|UW", 5), ("few", "f|ew", "F|UW", 4), ("phone", "ph|o|n|e", "F|OW|N|-", 6), ("fun", "f|u|n", "F|AH|N", 8), ("enough", "e|n|ou|gh", "IH|N|AH|F", 5), ("no", "n|o", "N|OW", 20), ("know", "kn|ow", "N|OW", 10), ("the", "th|e", "DH|AH", 50), ("run", "r|u|n", "R|AH|N", 6), ("sun", "s|u|n", "S|AH|N", 5), ("cell", "c|e|ll", "S|EH|L", 3), ("sell", "s|e|ll", "S|EH|L", 4))
SCHEMA = "word string, letters array<string>, phones array<string>, freq long"


def aligned_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, a.split("|"), p.split("|"), f) for w, a, p, f in ALIGNED], SCHEMA)


def level(p: float) -> tuple[float, float]:
    """(softmax parameter, chance of a change) of a severity."""
    return 0.5 + 2 ** ((1 - p) * 5) / 8, 1 - 1 / (20 * p + 1)


def slots(p: float, aligned=ALIGNED, least: int = 8) -> dict[str, list[tuple[str, list[tuple[str, float]]]]]:
    """Of each word its letters by phoneme, and the letters that may stand there with cumulative probabilities.

    Letters are counted at the longest context (3, 2, 1 phonemes) that occurs least times; their chance is in proportion to exp(theta * share).
    For a small table of pronunciations, which becomes a literal; :func:`respelled` does the same by joins.
    """
    theta, counts = level(p)[0], {}
    contexts = lambda ph, i: [(1, tuple(ph[i : i + 1])), (2, tuple(ph[i - 1 : i + 1])), (3, tuple(ph[i - 1 : i + 2]))]
    framed = [(w, a.split("|"), ["[START]", *b.split("|"), "[END]"], f) for w, a, b, f in aligned]
    for _, letters, ph, f in framed:
        for i, x in enumerate(letters, 1):
            for c in contexts(ph, i):
                own = counts.setdefault(c, {})
                own[x] = own.get(x, 0) + f
    out = {}
    for w, letters, ph, _ in framed:
        out[w] = []
        for i, x in enumerate(letters, 1):
            own = next(counts[c] for c in reversed(contexts(ph, i)) if c[0] == 1 or sum(counts[c].values()) >= least)
            total = sum(own.values())
            weight = {y: math.exp(theta * n / total) for y, n in sorted(own.items())}
            at, list_ = 0.0, []
            for y, v in weight.items():
                at += v / sum(weight.values())
                list_.append((y, round(at, 9)))
            out[w].append((x, [*list_[:-1], (list_[-1][0], 1.0)]))
    return out


def respelled_text(text: Column, key: Column, p: float, aligned=ALIGNED) -> Column:
    """The text with known words rebuilt from their phonemes: each word, and of it each phoneme, with the chance of the level. A first capital stays one."""
    chance = level(p)[1]
    table = F.create_map(*[x for w, ss in slots(p, aligned).items() for x in (F.lit(w), F.array(*[F.struct(F.lit(own).alias("own"), F.array(*[F.struct(F.lit(y).alias("y"), F.lit(q).alias("q")) for y, q in list_]).alias("ways")) for own, list_ in ss]))])

    def rebuilt(t: Column) -> Column:
        def word(x: Column, i: Column) -> Column:
            drawn = lambda s, j: F.when(uniform("ph", key, i, j) < chance, F.get(F.filter(s["ways"], lambda y: y["q"] >= uniform("way", key, i, j)), F.lit(0))["y"]).otherwise(s["own"])
            new = F.array_join(F.transform(F.element_at(t, ascii_lower(x)), drawn), "")
            new = F.when(x.rlike(r"\A[A-Z]"), F.concat(F.upper(F.substring(new, 1, 1)), F.substr(new, F.lit(2)))).otherwise(new)
            return F.when(F.element_at(t, ascii_lower(x)).isNotNull() & (uniform("word", key, i) < chance), new).otherwise(x)

        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)[a-zA-Z']+|."), F.lit(0)), word), "")

    return let(table, rebuilt)


def statistics(aligned: DataFrame) -> DataFrame:
    """n, phones (n-gram, joined by spaces), letters (at its middle place), support: weights of the words that spell it so."""
    a = F.concat(F.array(F.lit("[START]")), F.col("phones"), F.array(F.lit("[END]")))
    base = aligned.select("freq", "letters", a.alias("ph"), F.posexplode("letters").alias("i", "letter"))
    out = None
    for n, back in ((1, 0), (2, 1), (3, 1)):
        grams = base.select(F.lit(n).cast("long").alias("n"), F.array_join(F.slice("ph", F.col("i") + 2 - back, F.lit(n)), " ").alias("phones"), "letter", "freq")
        out = grams if out is None else out.unionByName(grams)
    return out.groupBy("n", "phones", F.col("letter").alias("letters")).agg(F.sum("freq").cast("long").alias("support"))


def respelled(aligned: DataFrame, stats: DataFrame, least: int = 8, theta: float | None = None) -> DataFrame:
    """word, respelled: each phoneme by the letters of the longest context (3, 2, 1) with support; the most frequent, or a keyed draw by softmax."""
    a = F.concat(F.array(F.lit("[START]")), F.col("phones"), F.array(F.lit("[END]")))
    slots = aligned.select("word", a.alias("ph"), F.posexplode("phones").alias("i", "phone"))
    wanted = slots.select("word", "i", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.array_join(F.slice("ph", F.col("i") + 2 - b, F.lit(n)), " ").alias("phones")) for n, b in ((1, 0), (2, 1), (3, 1))])).alias("g")).select("word", "i", "g.*")
    totals = stats.groupBy("n", "phones").agg(F.sum("support").alias("total"))
    found = wanted.join(stats, ["n", "phones"]).join(totals, ["n", "phones"]).filter((F.col("total") >= least) | (F.col("n") == 1))
    longest = found.withColumn("_m", F.max("n").over(Window.partitionBy("word", "i"))).filter("n = _m")
    score: Column = F.col("support").cast("double")
    if theta is not None:
        score = F.log(uniform("phon", F.col("word"), F.col("i"), F.col("letters")) + 1e-12) / F.exp(F.col("support") / F.col("total") * theta)
    best = longest.groupBy("word", "i").agg(F.max(F.struct(score.alias("s"), F.col("letters"))).alias("b"))
    return best.groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("b.letters").alias("l")))), lambda s: s["l"]), "").alias("respelled"))
