"""Operators without SQL: earlier variants, lookalikes, glyphs, stores, statistics, rankings."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import metrics, stats, vectors
from wordloom.operators import evaluation, glyphs, legacy, lookalike, perturb, phonetic, posterior, spelling, study, tokens
from wordloom.sources import readers


def test_cosine_and_softmax_stay_finite(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 800.0), (1, [1.0, 0.0], 799.0)], "g int, v array<double>, x double")
    got = df.select(metrics.cosine(F.col("v"), F.col("v")).alias("c"), stats.softmax(F.col("x"), 1.0, ["g"]).alias("p")).collect()
    assert [r.c for r in got if r.c is not None] == [1.0] and sum(r.p for r in got) == pytest.approx(1)


def test_p_values(spark):
    df = spark.createDataFrame([(2.228, 10.0), (0.0, 5.0), (None, 3.0)], "t double, dof double")
    p = [r.p for r in stats.with_p_value(df).orderBy("dof").collect()]
    assert p[0] is None and p[1] == pytest.approx(1) and p[2] == pytest.approx(0.05, abs=1e-4)
    sums = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, 4.0)], "g int, x double").groupBy("g").agg(stats.mean_of_numbers("x").alias("m"), stats.supported(F.max("g"), 10).alias("s")).first()
    assert sums.m == 3 and sums.s is None


def test_all_names_attack(spark):
    df = spark.createDataFrame([(1, "The phone rang through the night, but few know the true cell.")], "id int, text string")
    for name in (*perturb.NAMES, "segment"):
        got = df.select(perturb.perturb(F.col("text"), name, 0.9, F.lit("k")).alias("t")).first().t
        assert got and (got != df.first().text or name in ("natural-typo",)), name
    with pytest.raises(ValueError):
        perturb.perturb(F.col("text"), "unknown", 0.1, F.lit("k"))
    assert df.select(perturb.perturb(F.col("text"), "phonetic", 0.0, F.lit("k")).alias("t")).first().t == df.first().text


def test_lookalikes(spark):
    n = lookalike.names(spark, 1000)
    near = {(r.char, r.variant) for r in lookalike.variations(n).collect()}
    assert ("a", "à") in near and ("A", "À") in near and ("a", "À") not in near and all(c != v for c, v in near)
    assert all(vs[-1][1] == 1.0 and [p for _, p in vs] == sorted(p for _, p in vs) and len(vs) <= lookalike.MOST for vs in lookalike.table().values())
    assert spark.createDataFrame([("é",), ("a",), ("😀",)], "c string").select(lookalike.hex_code(F.col("c")).alias("h")).collect() == [("00E9",), ("0061",), ("1F600",)]
    v = lookalike.name_vectors(n.limit(50)).first()
    assert v.vector.size > 5 and lookalike.side_by_side(n, n.select("code", F.lit(1).alias("x")), ["code"]).count() == n.count()


def test_names_list(spark, tmp_path):
    (tmp_path / "n.txt").write_text("\n".join(["; head"] * 16 + ["0041\tLATIN CAPITAL LETTER A", "no tab", "0042\tLATIN CAPITAL LETTER B"]), encoding="utf-8")
    assert [r.code for r in lookalike.names_list(spark, str(tmp_path / "n.txt")).orderBy("code").collect()] == ["0041", "0042"]


def test_phonetic_slots_follow_counts():
    slots = phonetic.slots(0.3)
    assert [own for own, _ in slots["phone"]] == ["ph", "o", "n", "e"] and all(ways[-1][1] == 1.0 for ss in slots.values() for _, ways in ss)
    assert {y for y, _ in phonetic.slots(0.3)["fun"][0][1]} <= {"f", "ph", "gh"}


def test_earlier_distance():
    assert legacy.distance("abc", "acb") == pytest.approx(0.3) and legacy.distance("abcd", "abdx", anagrams=False) == 2 and legacy.distance("é", "e") == 0
    assert legacy.distance("", "abc") == 3 == legacy.distance("abc", "")


def test_pieces_and_replacements():
    got = legacy.pieces("walking", [("walk", 0.9), ("wal", 0.4), ("x", 1.0)], ["ing", "king", "k", "in", "g"])
    assert got[0] == (0.9, ["walk", "##ing"]) and all("".join(w).replace("##", "") == "walking" for _, w in got)
    options = {"a": [("a", 1.0), ("o", 0.5)], "b": [("b", 0.9), ("d", 0.8), ("p", 0.1)]}
    ways = list(legacy.replacements("abc", options))
    want = sorted((round(x[1] + y[1], 6) for x, y in itertools.product(options["a"], options["b"])), reverse=True)
    assert [round(s, 6) for s, _ in ways] == want and ways[0][1] == "abc" and len({w for _, w in ways}) == 6


def test_replaced_characters(spark):
    got = spark.createDataFrame([("Ð€llo é!",)], "t string").select(legacy.replaced(F.col("t"), {"Ð": "D", "é": "e", "l": "x"}).alias("t")).first().t
    assert got == "D€llo e!"


class _Provider:
    def slot_scores(self, slots, at, words):
        seen = {w for i, s in enumerate(slots) if i != at for w, p in s if p > 0.4}
        return [1.0 if any(w[0] == x[0] for x in seen) else 0.0 for w in words]

    def sentence_score(self, words):
        return 0.0


@pytest.mark.parametrize("how", ["rounds", "live", "old"])
def test_earlier_posteriors(how):
    slots = [[("aa", 0.5), ("bb", 0.5)], [("ab", 0.6), ("cb", 0.4)], [("ac", 0.3), ("dd", 0.7)]]
    got = legacy.posterior(slots, _Provider(), how, theta=2.0)
    assert all(sum(p for _, p in s) == pytest.approx(1) for s in got) and dict(got[0])["aa"] > 0.5
    assert legacy.posterior([], _Provider(), how) == []


def test_glyphs(spark):
    a = np.array([[1, 0, 0], [1, 0, 0], [1, 1, 0]], bool)
    assert glyphs.match(a, a) == 1 and glyphs.match(a, np.rot90(a)) == pytest.approx(0.9) and glyphs.match(a * 0 > 0, a * 0 > 0) == 0 and len(glyphs.forms(a)) == 8
    df = spark.createDataFrame([(1, [int(x) for x in a.ravel()])], "code long, bits array<int>")
    assert glyphs.best_letters(df, [("L", a.ravel().tolist()), ("o", [1] * 9)]).first().letter == "L"
    r = np.random.default_rng(1)
    v = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(30)], "id int, vector array<double>")
    assert len(glyphs.similarities(v, "vector", 3, rounds=2).first().vector) == 3


def test_stores(spark, tmp_path):
    store = spark.createDataFrame([("a", ["x", "y"])], "key string, values array<string>")
    more = readers.added(store, spark.createDataFrame([("a", "z"), ("b", "q")], "key string, value string"))
    readers.write_store(more, str(tmp_path / "s"))
    back = {r.key: r["values"] for r in readers.perturbation_store(spark, str(tmp_path / "s")).collect()}
    assert back == {"a": ["x", "y", "z"], "b": ["q"]}
    seen = readers.observed(spark.createDataFrame([("a", "x"), ("a", "q")], "k string, v string"), store, "k", "v").orderBy("v").collect()
    assert [r.seen for r in seen] == [False, True]
    calls = []
    solve = lambda: calls.append(1) or store
    assert [readers.solved_or_stored(spark, str(tmp_path / "p"), solve).count() for _ in range(2)] == [1, 1] and len(calls) == 1
    readers.write_indexed(spark.createDataFrame([(7, "x"), (3, "y"), (11, "z")], "id int, s string"), "id", "s", str(tmp_path / "i"))
    rows = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "i"))
    assert {(r["index"], r.sentence) for r in rows.collect()} == {("0", "y"), ("1", "x"), ("2", "z")}
    readers.write_attacked(spark.createDataFrame([(1.0, "a", "b")], "score double, first string, second string"), "# [('truncate', 0.3)]", str(tmp_path / "w"))
    assert readers.attack_headers(spark, str(tmp_path / "w" / "header")).count() == 1 and readers.labelled_pairs(spark, str(tmp_path / "w" / "pairs")).first().second == "b"
    (tmp_path / "pron.txt").write_text("ph|o|n|e|\tF|OW|N|-|\n", encoding="utf-8")
    aligned = readers.pronunciations(spark, str(tmp_path / "pron.txt"))
    assert phonetic.respelled(aligned, phonetic.statistics(aligned), least=1).first().respelled == "phone"
    (tmp_path / "t.txt").write_text("1.0\tA dog, here.\n", encoding="utf-8")
    assert readers.tokenized(spark, str(tmp_path / "t.txt")).first().fields[1] == ["a", "dog", ",", "here", "."]


def test_ranks_equal_sorting(spark):
    r = random.Random(4)
    rows = list({("".join(r.choice("abé") for _ in range(r.randint(1, 6))), r.randint(1, 4)) for _ in range(300)})
    got = tokens.ranked(spark.createDataFrame(rows, "word string, freq long"), "freq", "word", falling=True, prefix=2).collect()
    assert [(x.word, x.freq) for x in sorted(got, key=lambda x: x["rank"])] == sorted(rows, key=lambda x: (-x[1], x[0].encode()))


def test_nearest_of_nothing_and_of_one(spark):
    e = spark.createDataFrame([(0, [1.0, 2.0])], "id long, v array<double>")
    assert vectors.nearest(e, e, "id", "v", 3).count() == 0 and vectors.nearest(e, e.limit(0), "id", "v", 3).count() == 0
    assert vectors.cosine_range(e, e.limit(0), "id", "v").first().mean is None


def test_round_robin_is_near_equal(spark):
    rows = study.replicated(spark.range(60).withColumnRenamed("id", "item"), 3).withColumn("key", F.col("item") * 3 + F.col("copy"))
    got = study.round_robin(rows, "item", "key", 7).collect()
    assert len({(r.item, r.list) for r in got}) == 180
    sizes = [sum(r.list == k for r in got) for k in range(7)]
    assert max(sizes) - min(sizes) < 30


def test_cleaners_plug_in(spark):
    df = spark.createDataFrame([(1, "the cat sat"), (2, "")], "id int, text string")
    words = spark.createDataFrame([("the", 3), ("cat", 2), ("sat", 1)], "word string, freq long")
    cleaner = lambda d: spelling.corrected(d, ["id"], "text", words)
    got = {r.id: r for r in spelling.cleaned(df, ["id"], "text", lambda t: F.replace(t, F.lit("cat"), F.lit("caat")), cleaner).collect()}
    assert got[1].attacked == "the caat sat" and got[1].cleaned == "the cat sat" and got[2].cleaned == ""
    s = evaluation.scored(df.withColumn("attacked", F.col("text"))).filter("id = 1").first()
    assert s.bleu == 0 and s.rouge1 == 1 and s.perfect and s.distance == 0 and math.isclose(s.rougel, 1)


def test_least_gap_equals_rule(spark):
    rows = [(0, 0, 0.5), (0, 0, 0.4), (0, 1, 0.9), (0, 1, 0.85), (0, 2, 1.0), (1, 0, 1.0), (1, 0, 0.0), (1, 1, 0.6), (1, 1, 0.1)]
    got = {r.g: r.slot for r in posterior.least_gap_slots(spark.createDataFrame(rows, "g int, slot int, p double"), ["g"], "slot", "p").collect()}
    want = {g: posterior.most_uncertain([[(str(i), p) for i, (h, s, p) in enumerate(rows) if h == g and s == k] for k in range(3)], [0, 0, 0]) for g in (0, 1)}
    assert got == want
