"""Quality rules: learned decision lists, with DataFrame and SQL functions only.

Statistics of whole texts are Spark expressions. Sequential covering then learns, on the driver, from the
statistics of labelled documents (a bounded sample by a hash of doc_id): each rule grows threshold conditions while
its precision gains information, is pruned on the other part of the labels, and the rows that it covers are set aside.
The list is emitted as one ordered conditional expression.

Defined cases: null and empty texts have all statistics 0 and fail the base rules; repeated rows are
judged alike; documents without label are only judged; without labels of both kinds the list is empty and
keeps everything that the base rules keep; extra columns pass through, but for those that have the name of a statistic or of base_failed, rule
or kept, which the result has anew; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh

SAMPLE, BINS, MOST_RULES, MOST_CONDITIONS, MIN_PRECISION, MIN_COVER = 12_000, 24, 12, 4, 0.8, 5
WINDOW = 5
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "exclaim_ratio", "distinct_ratio", "line_words")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(w: Column, narrow: int = 1 << 24) -> Column:
    """Number of words that lie in windows of WINDOW words which occur twice or more.

    Hashes of windows are sorted as plain longs to find repeated ones. Only if there are any, a second sort
    of (40 bits of hash, position) finds their places: those whose neighbour has the same full hash. Texts of 2 ** 24 windows or more,
    whose positions take more bits, are sorted as structs.
    """
    n = F.size(w)
    at = lambda i: F.element_at(w, i)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)]))

    def places(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 24), 24).bitwiseOR(i.cast("long"))))
        place = lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
        value = lambda s, j: F.element_at(h, place(F.element_at(s, j)) + 1)

        def twin(s: Column) -> Column:
            last = F.size(s)
            return F.filter(F.transform(s, lambda x, j: F.when(((j > 0) & (value(s, F.greatest(j, F.lit(1))) == F.element_at(h, place(x) + 1))) | ((j + 1 < last) & (value(s, F.least(j + 2, last)) == F.element_at(h, place(x) + 1))), place(x))), lambda p: p.isNotNull())

        def wide(s: Column) -> Column:
            same = lambda j, k: F.element_at(s, j)["x"] == F.element_at(s, k)["x"]
            last = F.size(s)
            return F.filter(F.transform(s, lambda v, j: F.when(((j > 0) & same(j + 1, F.greatest(j, F.lit(1)))) | ((j + 1 < last) & same(j + 1, F.least(j + 2, last))), v["i"])), lambda p: p.isNotNull())

        structs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.cast("int").alias("i"))))
        return F.sort_array(F.when(F.size(h) < F.lit(narrow), _let(packed, twin)).otherwise(_let(structs, wide)))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.when(j + 1 < F.size(p), F.least(F.lit(WINDOW), F.element_at(p, F.least(j + 2, F.size(p))) - x)).otherwise(F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    def any_twice(s: Column) -> Column:
        return F.exists(F.zip_with(s, F.slice(s, 2, 1 << 30), lambda x, y: x == y), lambda e: F.coalesce(e, F.lit(False)))

    def count(h: Column) -> Column:
        return F.when(_let(F.sort_array(h), any_twice), _let(places(h), covered)).otherwise(F.lit(0))

    return F.when(n >= WINDOW, _let(hashes, count)).otherwise(F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and other counts under _names."""
    t = F.coalesce(F.col(text), F.lit(""))
    _t, _w, _lines = (fresh(x, docs.columns) for x in ("_t", "_w", "_lines"))
    df = docs.withColumn(_t, t).withColumn(_w, words(F.col(_t))).withColumn(_lines, F.filter(F.split(_t, "\n"), lambda x: x.rlike(WORD)))
    size = lambda pattern: F.regexp_count(_t, F.lit(pattern)).cast("long")
    return df.withColumns({
        "n_words": F.size(_w).cast("long"),
        "word_chars": F.length(F.translate(_t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(_t) - F.length(F.translate(_t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(_lines) - F.size(F.array_distinct(_lines))).cast("long"),
        "n_repeat_words": repeated_words(F.col(_w)),
        "_n_lines": F.size(_lines).cast("long"),
        "_upper": size("[A-Z]"),
        "_digits": size("[0-9]"),
        "_exclaim": size("[!?]"),
        "_distinct": F.size(F.array_distinct(_w)).cast("long"),
    }).drop(_t, _w, _lines)


def feature_columns() -> dict[str, Column]:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return dict(zip(FEATURES, (F.col("n_words").cast("double"), ratio("word_chars", "n_words"), ratio("n_symbols", "word_chars"), ratio("n_dup_lines", "_n_lines"), ratio("n_repeat_words", "n_words"), ratio("_upper", "word_chars"), ratio("_digits", "word_chars"), ratio("_exclaim", "word_chars"), ratio("_distinct", "n_words"), ratio("n_words", "_n_lines")), strict=True))


Condition = tuple[int, bool, float]  # feature, whether at most, threshold


def _holds(row: Sequence[float], rule: Sequence[Condition]) -> bool:
    return all((row[f] <= t) == low for f, low, t in rule)


def _grow(rows: list, cuts: list[list[float]]) -> list[Condition]:
    """Adds the condition of most information gain (over the bad rows) until only bad rows are covered."""
    rule: list[Condition] = []
    while rows and len(rule) < MOST_CONDITIONS:
        p = sum(r[-1] for r in rows)
        n, best = len(rows), (1e-9, None)
        if p == n:
            break
        base = math.log2(p / n) if p else 0.0
        for f, edges in enumerate(cuts):
            ordered = sorted((r[f], r[-1]) for r in rows)
            i = bad = 0
            for t in edges:
                while i < n and ordered[i][0] <= t:
                    bad += ordered[i][1]
                    i += 1
                for low, q, m in ((True, bad, i), (False, p - bad, n - i)):
                    if q >= MIN_COVER:
                        gain = q * (math.log2(q / m) - base)
                        if gain > best[0]:
                            best = (gain, (f, low, t))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if _holds(r, [best[1]])]
    return rule


def _worth(rule: Sequence[Condition], rows: list) -> float:
    covered = [r[-1] for r in rows if _holds(r, rule)]
    return (2 * sum(covered) - len(covered)) / len(covered) if covered else -1.0


def learn(rows: list[tuple], share: int = 3) -> list[list[Condition]]:
    """An ordered list of rules for bad rows from (features..., bad)."""
    if not 0 < sum(r[-1] for r in rows) < len(rows):
        return []
    cuts = []
    for f in range(len(rows[0]) - 1):
        v = sorted({r[f] for r in rows})
        mid = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
        bad = sorted(r[f] for r in rows if r[-1])
        mine = {mid[i * (len(mid) - 1) // BINS] for i in range(BINS + 1)} if mid else set()
        mine |= {bad[i * (len(bad) - 1) // BINS] for i in range(BINS + 1)}
        cuts.append(sorted(mine))
    left, rules = list(rows), []
    while len(rules) < MOST_RULES:
        growing, pruning = [r for i, r in enumerate(left) if i % share], [r for i, r in enumerate(left) if not i % share]
        rule = _grow(growing, cuts)
        while len(rule) > 1 and _worth(rule[:-1], pruning) >= _worth(rule, pruning):
            rule = rule[:-1]
        covered = [r[-1] for r in left if _holds(r, rule)]
        if not rule or len(covered) < MIN_COVER or sum(covered) < MIN_PRECISION * len(covered):
            return rules
        rules.append(rule)
        left = [r for r in left if not _holds(r, rule)]
    return rules


def list_column(rules: Sequence[Sequence[Condition]]) -> tuple[Column, Column]:
    """Number of the first rule that fits (0: none), and whether the row is kept."""
    f, first = list(feature_columns().values()), F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        fits = F.lit(True)
        for i, low, t in rule:
            fits = fits & ((f[i] <= t) if low else (f[i] > t))
        first = F.when(fits, F.lit(k)).otherwise(first)
    return first, first == 0


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules from statistics of documents and labels (doc_id, quality: 0 is bad)."""
    labelled = stats.join(labels.select("doc_id", "quality").filter("quality in (0, 1)").dropDuplicates(["doc_id"]), "doc_id")
    labelled = labelled.filter(~base_failed()).select("doc_id", *[c.alias(n) for n, c in feature_columns().items()], (F.col("quality") == 0).cast("int").alias("bad")).persist()
    n = labelled.count()
    if n > sample:
        labelled_some = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * sample / n)))
    else:
        labelled_some = labelled
    rows = sorted(tuple(r) for r in labelled_some.collect())
    labelled.unpersist()
    return learn([r[1:] for r in rows])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(stats: DataFrame, rules: Sequence[Sequence[Condition]]) -> DataFrame:
    """stats with base_failed, rule (the first of the list that fits, 0 if none) and kept."""
    rule, kept = list_column(rules)
    return stats.withColumns({"base_failed": base_failed(), "rule": rule}).withColumn("kept", ~F.col("base_failed") & kept)
