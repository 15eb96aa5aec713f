"""Characters that look like a letter, found by their Unicode names."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import LETTERS

# The last code that takes part, codes that never do, and words of names of other scripts or uses.
LAST_CODE, BAD_CODES = 30000, (1311, 4580)
BARRED = frozenset("TAG MALAYALAM BAMUM HIRAGANA RUNIC TAI SUNDANESE BATAK LEPCHA CHAM TELUGU DEVANGARARI BUGINESE MYANMAR LINEAR SYLOTI PHAGS-PA CHEROKEE CANADIAN YI LYCIAN HANGUL KATAKANA JAVANESE ARABIC KANNADA BUHID TAGBANWA DESERET REJANG BOPOMOFO PERMIC OSAGE TAGALOG MEETEI CARIAN UGARITIC ORIYA ELBASAN CYPRIOT HANUNOO GUJARATI LYDIAN MONGOLIAN AVESTAN MEROITIC KHAROSHTHI HUNGARIAN KHUDAWADI ETHIOPIC PERSIAN OSMANYA TIBETAN BENGALI TURKIC THROWING HANIFI BRAHMI KAITHI LIMBU LAO CHAKMA COPTIC GEORGIAN THAI PAU".split())
#: Variants of a letter at most.
MOST = 20


def hex_code(c: Column) -> Column:
    """The code point of the first character, in four or more hexadecimal digits."""
    code = F.hex(F.ascii(c).cast("long"))
    return F.when(F.length(code) < 4, F.lpad(code, 4, "0")).otherwise(code)


def names(spark: SparkSession, last: int = LAST_CODE) -> DataFrame:
    """code, char, name: the named characters up to a code, from the Unicode tables of Python."""
    return spark.createDataFrame([(i, chr(i), n) for i in range(33, last + 1) if (n := unicodedata.name(chr(i), ""))], "code int, char string, name string")


def names_list(spark: SparkSession, path: str, skip: int = 16) -> DataFrame:
    """code, name of a tab-separated list of names, whose first lines are skipped; rows without both are dropped."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    head = lines.orderBy("_n").limit(skip).select("_n")
    p = lines.join(F.broadcast(head), "_n", "left_anti").select(F.split("value", "\t").alias("p"))
    return p.filter("size(p) >= 2").select(F.col("p")[0].alias("code"), F.col("p")[1].alias("name")).filter("code != '' and name != ''")


def usable(names: DataFrame) -> DataFrame:
    """names with letter (the single-character word of the name) and small; characters of other scripts and barred codes go."""
    word = F.split("name", " ")
    single = F.filter(word, lambda w: F.length(w) == 1)
    df = names.withColumns({"letter": F.get(single, F.lit(0)), "small": F.array_contains(word, "SMALL"), "capital": F.array_contains(word, "CAPITAL")})
    return df.filter(F.col("letter").isNotNull() & ~F.arrays_overlap(word, F.array(*[F.lit(w) for w in sorted(BARRED)])) & (F.col("code") <= LAST_CODE) & ~F.col("code").isin(list(BAD_CODES)))


def variations(names: DataFrame) -> DataFrame:
    """char, variant, distance: other characters of the same letter and case; the distance is that of the sets of words in their names."""
    u = usable(names).withColumn("words", F.array_distinct(F.split("name", " ")))
    a, b = (u.select("letter", "small", "capital", F.col("char").alias(c), F.col("words").alias(w)) for c, w in (("char", "x"), ("variant", "y")))
    own = a.filter(F.col("char").rlike("^[A-Za-z]$")).join(b, ["letter", "small", "capital"]).filter("char != variant")
    return own.select("char", "variant", F.sqrt((F.size(F.array_except("x", "y")) + F.size(F.array_except("y", "x"))).cast("double")).alias("distance"))


@cache
def table(letters: str = LETTERS, most: int = MOST) -> dict[str, list[tuple[str, float]]]:
    """For each letter its nearest variants with cumulative probabilities, in proportion to exp(-distance / 2): the same as :func:`variations`, on the driver."""
    groups: dict[tuple, list[tuple[str, frozenset]]] = {}
    for i in range(33, LAST_CODE + 1):
        words = unicodedata.name(chr(i), "").split(" ")
        letter = next((w for w in words if len(w) == 1), None)
        if letter and i not in BAD_CODES and not BARRED & set(words):
            groups.setdefault((letter, "SMALL" in words, "CAPITAL" in words), []).append((chr(i), frozenset(words)))
    out = {}
    for group in groups.values():
        for c, own in group:
            if c in letters:
                near = sorted((math.sqrt(len(own ^ w)), v) for v, w in group if v != c)[:most]
                total, at = sum(math.exp(-d / 2) for d, _ in near), 0.0
                out[c] = []
                for d, v in near:
                    at += math.exp(-d / 2) / total
                    out[c].append((v, round(at, 9)))
                if near:
                    out[c][-1] = (near[-1][1], 1.0)
    return {c: out[c] for c in sorted(out) if out[c]}


def name_vectors(names: DataFrame, most: int = 1000) -> DataFrame:
    """names with vector: counts of the words of a name, for the most frequent words."""
    from pyspark.ml.feature import CountVectorizer

    words = names.withColumn("_words", F.split("name", " "))
    return CountVectorizer(inputCol="_words", outputCol="vector", vocabSize=most).fit(words).transform(words).drop("_words")


def side_by_side(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """The columns of both, by key."""
    return left.join(right, list(key))
