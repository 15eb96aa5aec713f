"""Tokens of sentences and sentences of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.chars import ascii_lower, chars, let

_MARK = r"""[,";:']\z"""
_END = r"(?s)\A(.*[^.])\.\z|\A(.+)[?!]\z"


# The conventions of Penn Treebank tokens, as (pattern, replacement) in order; they hold in Java's and RE2's syntax.
TREEBANK = (
    (r'\A"', "`` "),
    (r'([ (\[{<])"', "$1 `` "),
    (r"(?s)\A(.*)\z", " $1 "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&?!])", " $1 "),
    (r"""([^.])(\.)([\])}>"']*[ \t\n\f\r]*)\z""", "$1 $2 $3"),
    (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"--", " -- "),
    (r'"', " '' "),
    (r"([^ '])('[sSmMdD]) ", "$1 $2 "),
    (r"([^ '])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(gon|wan)(na)\b", "$1 $2"),
    (r"(?i)\b(got)(ta)\b", "$1 $2"),
    (r"(?i)\b(gim|lem)(me)\b", "$1 $2"),
    (r"(?i) ('t)(is|was)\b", " $1 $2"),
)
#: And back, over tokens joined by single spaces with one before and after.
TREEBANK_BACK = (
    (r"(?i) (can) (not) ", " $1$2 "),
    (r"(?i) (gon|wan) (na) ", " $1$2 "),
    (r"(?i) (got) (ta) ", " $1$2 "),
    (r"(?i) (gim|lem) (me) ", " $1$2 "),
    (r"(?i) ('t) (is|was) ", " $1$2 "),
    (r"([^ ']) ('[sSmMdD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1$2 "),
    (r" '' ", "\" "),
    (r" `` ", " \""),
    (r" -- ", "--"),
    (r" ([,:;?!.%\])}>])", "$1"),
    (r"([(\[{<#$]) ", "$1"),
    (r"\A +| +\z", ""),
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _word_tokens(word: Column, last: Column) -> Column:
    """One leading quote, the stem, and its trailing marks one by one; sentence ends come off the last word only."""
    w = ascii_lower(word)
    lead = F.when(w.rlike(r"""\A["']"""), F.substring(w, 1, 1)).otherwise(F.lit(""))
    rest = F.substr(w, F.length(lead) + 1)
    stem = rest
    for _ in range(3):
        stem = F.regexp_replace(stem, _MARK, "")
        stem = F.when(last, F.regexp_replace(stem, _END, "$1$2")).otherwise(stem)
    return let(stem, lambda s: F.filter(F.concat(F.array(lead, s), chars(F.substr(rest, F.length(s) + 1))), lambda x: x != ""))


def sentence_tokens(text: Column) -> Column:
    """The tokens of a sentence: words between single spaces in ASCII lower case, marks apart."""
    return let(F.split(strip(text), " "), lambda words: F.flatten(F.transform(words, lambda w, i: _word_tokens(w, i == F.size(words) - 1))))


def phonetic_tokens(text: Column) -> Column:
    """Runs of ASCII letters and apostrophes in lower case, other characters one by one."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)[a-zA-Z']+|."), F.lit(0)), ascii_lower)


def capitals(text: Column) -> Column:
    """Places (from 0) of the phonetic tokens that start with a capital."""
    p = F.regexp_extract_all(text, F.lit(r"(?s)[a-zA-Z']+|."), F.lit(0))
    return F.filter(F.transform(p, lambda x, i: F.when(x.rlike(r"\A[A-Z]"), i)), lambda i: i.isNotNull())


def word_tokens(text: Column) -> Column:
    """Words (with inner hyphens, apostrophes and dots) and other visible characters one by one: a plain form of Treebank tokens."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:['.\-][\p{L}\p{N}]+)*|[^\s]"), F.lit(0))


def _rewritten(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def treebank_tokens(text: Column) -> Column:
    """Penn Treebank tokens of one sentence: marks, brackets and quotes (as `` and '') apart, contractions split."""
    return F.filter(F.split(_rewritten(text, TREEBANK), r"[ \t\n\f\r]+"), lambda w: w != "")


def treebank_text(tokens: Column) -> Column:
    """The sentence of :func:`treebank_tokens`; what spaces stood around marks is not known any more."""
    return _rewritten(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), TREEBANK_BACK)


def detokenized(tokens: Column) -> Column:
    """Tokens joined by spaces, without one before closing or after opening marks."""
    joined = F.array_join(tokens, " ")
    return F.regexp_replace(F.regexp_replace(joined, r" ([.,:;?!%)\]}])", "$1"), r"([(\[{$#]) ", "$1")


def glued(tokens: Column) -> Column:
    """Word pieces: ##x joins the token before it, a hyphen joins both sides."""
    return F.regexp_replace(F.regexp_replace(F.array_join(tokens, " "), " ##", ""), " ?- ?", "-")


def exploded(df: DataFrame, key: list[str], tokens: Column) -> DataFrame:
    """key, pos (from 0), token."""
    return df.select(*key, F.posexplode(tokens).alias("pos", "token"))


def ranked(df: DataFrame, lead: str, word: str, falling: bool = False, prefix: int = 3) -> DataFrame:
    """df with rank from 0, by lead and then word.

    Rows are ordered in groups of one lead and the first characters of the word; only the table of these groups, with their numbers
    of rows, is ordered as a whole.
    """
    rows = df.withColumn("_head", F.substring(word, 1, prefix))
    return numbered(rows, [lead, "_head"], [F.desc(lead) if falling else F.col(lead), F.col("_head")], word).select(*df.columns, "rank")


def numbered(df: DataFrame, groups: list[str], order: list[Column], inside: str) -> DataFrame:
    """df with rank from 0: groups (without nulls) in order, rows inside a group by a column. Only the table of groups is ordered in one task."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*groups, (F.sum("_n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*groups).orderBy(inside)) - 1
    return df.join(before, groups).withColumn("rank", (F.col("_before") + at).cast("long")).drop("_before")


def frequency_rank(tokens: DataFrame, word: str = "token") -> DataFrame:
    """word, freq, rank from 0 by falling frequency, then word."""
    counted = tokens.groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    return ranked(counted, "freq", "word", falling=True).select("word", "freq", "rank")


def known_or_frequent(ranks: DataFrame, known: DataFrame, most: int = 1000) -> DataFrame:
    """word, freq, rank anew: of the ranked words those that are known (word) or rank below most."""
    flagged = ranks.join(known.select("word").distinct().withColumn("_known", F.lit(True)), "word", "left")
    kept = flagged.filter(F.col("_known").isNotNull() | (F.col("rank") < most)).select("word", "freq")
    return ranked(kept, "freq", "word", falling=True)


def full_dictionary(lists: list[DataFrame]) -> DataFrame:
    """word, len, list, place, idx: the words of the lists (word, place) by length, then list, then place in it."""
    every = None
    for i, words in enumerate(lists):
        own = words.select("word", F.lit(i).alias("list"), F.col("place").cast("long").alias("place"), F.length("word").cast("long").alias("len"))
        every = own if every is None else every.unionByName(own)
    every = every.withColumn("_order", F.concat_ws("|", F.lpad(F.col("list").cast("string"), 4, "0"), F.lpad(F.col("place").cast("string"), 12, "0")))
    return ranked(every, "len", "_order", prefix=11).select("word", "len", "list", "place", F.col("rank").alias("idx"))


def token_class(word: Column) -> Column:
    """trash, number, morpheme, punct or letter."""
    return (
        F.when(word.rlike(r"^\[.*\]$") | word.rlike(r"""[^A-Za-z0-9\-' #/\\(){}\[\]%$€@,:&?!;."]"""), "trash")
        .when(word.rlike("^[0-9]+$"), "number")
        .when(word.startswith("##"), "morpheme")
        .when(word.rlike("[A-Za-z0-9]"), "letter")
        .otherwise("punct")
    )


def dictionary(words: DataFrame, word: str = "word") -> DataFrame:
    """word, kind, len, idx: distinct words, by length then word; idx is the identity and the tie-break."""
    d = words.select(F.col(word).alias("word")).filter("word != ''").distinct().withColumns({"kind": token_class(F.col("word")), "len": F.length("word").cast("long")})
    return ranked(d, "len", "word").withColumnRenamed("rank", "idx")


def islands(lines: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """Blocks of lines between blank ones: key, block (from 0), n_lines, joined text."""
    w = Window.partitionBy(*key).orderBy(order)
    blank = F.trim(F.col(text)) == ""
    numbered = lines.withColumn("block", F.sum(blank.cast("long")).over(w)).filter(~blank)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ")
    return numbered.groupBy(*key, "block").agg(F.count(F.lit(1)).alias("n_lines"), joined.alias("block_text"))
