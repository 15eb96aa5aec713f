"""Operators that SQL can't express, against plain scalar versions."""

from __future__ import annotations

import itertools
import math
import random
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import metrics, stats, stems
from wordloom.functions.chars import ascii_lower
from wordloom.operators import evaluation, perturb, phonetic, posterior, prior, report, study, tokens
from wordloom.plans import restore
from wordloom.sources import readers
from wordloom.streaming import sentences

LETTERS = "abcdefg"


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def column(spark, values, expr):
    """expr of each value, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", expr(F.col("s")).alias("r")).collect()
    return [r.r for r in sorted(rows)]


def word_list(seed=0, n=60):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeiou-'XY1") for _ in range(r.randint(1, 9))) for _ in range(n)]


# ---- tokens ----

def scalar_tokens(s):
    out, ws = [], s.strip(" \t\n\r\f\x0b").split(" ")
    for i, w in enumerate(ws):
        w = "".join(c.lower() if c in string.ascii_uppercase else c for c in w)
        if w[:1] in ("'", '"') and w:
            out.append(w[0])
            w = w[1:]
        stem = w
        for _ in range(3):
            if stem and stem[-1] in ',";:\'':
                stem = stem[:-1]
            if i == len(ws) - 1 and len(stem) > 1 and (stem[-1] in "?!" or (stem[-1] == "." and stem[-2] != ".")):
                stem = stem[:-1]
        out += ([stem] if stem else []) + list(w[len(stem) :])
    return out


def test_sentence_tokens(spark):
    r = random.Random(1)
    texts = ["", " ", "A 'quoted' word.", "wait..", "Hi, \"you\"!?", "für  Ämter;"] + ["".join(r.choice("ab.,;:!?'\" ") for _ in range(r.randint(0, 14))) for _ in range(300)]
    assert column(spark, texts, tokens.sentence_tokens) == [scalar_tokens(t) for t in texts]


def test_ascii_lower_and_detokenized(spark):
    assert column(spark, ["ÄBc"], ascii_lower) == ["Äbc"]
    assert column(spark, ["It's (one), a-b. 3.5!"], lambda c: tokens.detokenized(tokens.word_tokens(c))) == ["It's (one), a-b. 3.5!"]
    assert column(spark, ["play ##ing well - known"], lambda c: tokens.glued(F.split(c, " "))) == ["playing well-known"]


# ---- perturbations ----

@pytest.mark.parametrize("method", sorted(perturb.METHODS))
def test_number_of_changed_words(spark, method):
    texts = [" ".join(w for w in word_list(k, 12) if w[0] not in "-'" and w[-1] not in "-'" and "--" not in w and "-'" not in w and "'-" not in w and "''" not in w) for k in range(12)]
    words = column(spark, texts, tokens.word_tokens)
    new = [t.split(" ") for t in column(spark, texts, lambda c: perturb.perturb(c, method, 0.3, F.lit("k")))]
    every = [t.split(" ") for t in column(spark, texts, lambda c: perturb.perturb(c, method, 1.0, F.lit("k")))]
    for w, some, whole in zip(words, new, every, strict=True):
        changeable = sum(a != b for a, b in zip(w, whole, strict=True))
        assert sum(a != b for a, b in zip(w, some, strict=True)) == min(changeable, math.ceil(len(w) * 0.3))


def test_swaps_keep_characters(spark):
    for f, least in ((perturb.full_swap, 3), (perturb.inner_swap, 4)):
        out = column(spark, word_list(3), lambda c, f=f: f(c, F.lit("x")))
        for a, b in zip(word_list(3), out, strict=True):
            assert Counter(a) == Counter(b) and (len(a) >= least or a == b)
            assert f is perturb.full_swap or (a[0] == b[0] and a[-1] == b[-1])


def test_deterministic_methods(spark):
    assert column(spark, ["hello", "at", "eau", "Apple"], lambda c: perturb.disemvowel(c, c)) == ["hll", "at", "eau", "ppl"]
    assert column(spark, ["hello", "abc", "ab", ""], lambda c: perturb.truncate(c, c)) == ["hell", "abc", "ab", ""]
    assert column(spark, ["the cat"], lambda c: perturb.perturb(c, "natural-typo", 1.0, F.lit("k"))) == ["teh cat"]
    with pytest.raises(ValueError):
        perturb.perturb(F.lit("a"), "none", 0.1, F.lit("k"))


def test_random_composition_is_repeatable(spark):
    texts = ["some words to change here", "und noch mehr davon"]
    run = lambda: column(spark, texts, lambda c: perturb.composed(c, [("rand", 0.5), ("intrude", 0.2)], c))
    assert run() == run() and run() != texts


def test_respelling(spark):
    a = phonetic.aligned_table(spark)
    out = {r.word: r.respelled for r in phonetic.respelled(a, phonetic.statistics(a), least=8).collect()}
    assert set(out) == {w for w, *_ in phonetic.ALIGNED} and out["the"] == "the" and out["sell"][1:] == "ell"


def test_treebank_tokens_and_back(spark):
    cases = {
        "They'll save and invest more.": "They 'll save and invest more .",
        'He said, "I can\'t do that" (twice).': "He said , `` I ca n't do that '' ( twice ) .",
        "You cannot pay $3,000 at 10:30, can you?": "You can not pay $ 3,000 at 10:30 , can you ?",
        "It's Mr. Smith's dog... I'm gonna go!": "It 's Mr. Smith 's dog ... I 'm gon na go !",
        "one -- two": "one -- two", "": "",
    }
    got = column(spark, list(cases), tokens.treebank_tokens)
    assert [" ".join(t) for t in got] == list(cases.values())
    back = column(spark, list(cases), lambda c: tokens.treebank_text(tokens.treebank_tokens(c)))
    assert back[1] == 'He said, "I can\'t do that" (twice).' and back[2] == "You cannot pay $3,000 at 10:30, can you?" and back[0] == "They'll save and invest more."
    assert column(spark, [None], tokens.treebank_tokens) == [None]


# ---- prior ----

def scalar_distance(source, target, costs):
    """The recurrence cell by cell, with sets of starts."""
    n, m = len(source), len(target)
    d, s = [[0.0] * (n + 1) for _ in range(m + 1)], [[{j} for j in range(n + 1)]] + [[set() for _ in range(n + 1)] for _ in range(m)]
    for i in range(1, m + 1):
        d[i][0], s[i][0] = d[i - 1][0] + costs.insert(target[i - 1]), {0}
        for j in range(1, n + 1):
            t, c = target[i - 1], source[j - 1]
            ways = [(d[i - 1][j] + costs.insert(t), s[i - 1][j]), (d[i - 1][j - 1] + costs.substitute(t, c), s[i - 1][j - 1]), (d[i][j - 1] + costs.delete(c), s[i][j - 1])]
            if t == c:
                ways.append((d[i - 1][j - 1], s[i - 1][j - 1]))
            if i > 2 and j > 2 and t == source[j - 2] and target[i - 2] == c:
                ways.append((d[i - 2][j - 2] + 1, s[i - 2][j - 2]))
            d[i][j] = min(w for w, _ in ways)
            s[i][j] = set().union(*(x for w, x in ways if w == d[i][j]))
    best = min(d[m])
    return best, {(a, j) for j in range(n + 1) if d[m][j] == best for a in s[m][j]}


@pytest.mark.parametrize("config", [prior.Config(), prior.Config(cheap_ins=False, cheap_sub=False, cheap_del=False)])
def test_kernel_equals_recurrence(config):
    r = random.Random(7)
    for _ in range(120):
        source = "".join(r.choice("abeté.1") for _ in range(r.randint(1, 7)))
        m = r.randint(1, 6)
        targets = ["".join(r.choice("abet1") for _ in range(m)) for _ in range(5)]
        costs = prior.Costs(source, config)
        best, spans = prior.distances(costs, np.array([[ord(c) for c in t] for t in targets], np.int32))
        for k, t in enumerate(targets):
            want, pairs = scalar_distance(source, t, costs)
            assert abs(best[k] - want) < 1e-12 and set(spans[k]) == pairs


def test_substring_costs_nothing():
    costs = prior.Costs("xxhelloyy", prior.Config())
    best, spans = prior.distances(costs, np.array([[ord(c) for c in "hello"]], np.int32))
    assert best[0] == 0 and spans[0] == [(2, 7)]


def test_k_best_sums_and_paths():
    r = random.Random(2)
    lists = [sorted(r.random() for _ in range(4)) for _ in range(4)]
    want = sorted(sum(c) for c in itertools.product(*lists))[:7]
    assert np.allclose([c for c, _ in prior.k_best_sums(lists, 7)], want)
    edges = {a: [(b, r.random()) for b in range(a + 1, 6)] for a in range(5)}
    every = [(5.0, [0])]
    todo = [([0], 0.0)]
    while todo:
        cuts, c = todo.pop()
        for b, d in edges.get(cuts[-1], []):
            if len(cuts) <= 4:
                todo.append(([*cuts, b], c + d))
                every.append((c + d + 5 - b, [*cuts, b]))
    assert np.allclose([c for _, c in prior.k_best_paths(edges, 5, 6, 4)], [c for c, _ in sorted(every)[:6]])


def test_words_within_a_distance_of_part_of_a_token(spark):
    def least(word, token):
        return min(_levenshtein(word, token[i:j]) for i in range(len(token) + 1) for j in range(i, len(token) + 1))

    words = ["a", "ab", "cab", "face", "deed", "gaffe", "abcdefg"]
    odd = [None, "", "x" * 64, "face", "face", "xxdeedxx", "ba", "gfa", "\u00e9a"]
    plain = prior.Config(cheap_ins=False, cheap_sub=False, cheap_del=False, swaps=False)
    frame = spark.createDataFrame([(t, i) for i, t in enumerate(odd)], "token string, cost int")
    got = {(r.token, r.word): r.cost for r in prior.within(frame, prior.Words(words, {}), 1.0, plain).collect()}
    want = {(t, w): float(d) for t in set(odd) if t and len(t) < 64 for w in words if (d := least(w, t)) <= 1}
    assert got == want
    assert prior.within(frame, prior.Words([], {}), 1.0).count() == 0 and prior.within(frame.limit(0), prior.Words(words, {}), 1.0).count() == 0


def test_best_sums_of_groups(spark):
    r = random.Random(5)
    costs = {g: [[r.randint(0, 6) / 4 for _ in range(r.randint(1, 4))] for _ in range(4)] for g in range(5)}
    rows = [(g, i, c) for g, lists in costs.items() for i, own in enumerate(lists) for c in own]
    got = prior.best_sums(spark.createDataFrame(rows, "g long, at int, c double"), ["g"], "at", "c", 6).orderBy("g", "k").collect()
    for g, lists in costs.items():
        own = [x for x in got if x.g == g]
        assert [x.cost for x in own] == sorted(sum(p) for p in itertools.product(*lists))[:6]
        assert all(sum(x.picks) == x.cost and len(x.picks) == 4 for x in own)
    assert prior.best_sums(spark.createDataFrame([], "g long, at int, c double"), ["g"], "at", "c").count() == 0


def test_softmax_is_uniform_where_all_vanish():
    assert prior.softmax([-1e9, -1e9]).tolist() == [0.5, 0.5] and abs(prior.softmax([1, 2, 3]).sum() - 1) < 1e-12


def words():
    known = ["the", "cat", "sat", "on", "mat", "house", "running", "."]
    return prior.Words(sorted(known, key=lambda w: (len(w), w)), {w: i for i, w in enumerate(known)}, ["ing", "er"])


def test_words_and_segmentation():
    best = prior.word_hypotheses("hosue", words(), prior.Config())[0]
    assert best[2][0][0][0] == "house"
    cuts = [h[0] for h in prior.word_hypotheses("thecatsat", words(), prior.Config())]
    assert [0, 3, 6, 9] in cuts
    assert prior.word_hypotheses("", words(), prior.Config())[0][2] == [[("", 1.0)]]
    assert prior.word_hypotheses("x" * 70, words(), prior.Config())[0][2][0][0][0] == "x" * 70


def test_shuffled_words_rank_high():
    w, r, ranks = words(), random.Random(4), []
    for word in ("house", "running"):
        for _ in range(5):
            inner = list(word[1:-1])
            r.shuffle(inner)
            top = [c for c, _ in prior.word_hypotheses(word[0] + "".join(inner) + word[-1], w, prior.Config())[0][2][0]]
            ranks.append(top.index(word) if word in top else 99)
    assert np.mean(ranks) < 1


# ---- posterior ----

def test_fifth_word_of_the_prior_can_win():
    known = ["cot", "cut", "cat", "cab", "car", "can", "cap"]
    w = prior.Words(known, {x: i for i, x in enumerate(known)})
    slots = [s for t in ("the", "ct", "sat") for s in ([[(t, 1.0)]] if t != "ct" else prior.word_hypotheses(t, w, prior.Config())[0][2])]
    assert {x for x, _ in slots[1]} == set(known)
    last = slots[1][-1][0]
    p = posterior.Bigrams({("the", last): 10**6, (last, "sat"): 10**6, ("the", "x"): 1})
    after = posterior.slot_posterior(slots, p, theta=1.0)
    assert max(after[1], key=lambda c: c[1])[0] == last
    scores = p.slot_scores(slots, 1, known)
    assert scores == pytest.approx([p.log("the", x) + p.log(x, "sat") for x in known])


def test_posterior_prefers_known_pairs():
    p = posterior.Bigrams({("<s>", "the"): 5, ("the", "cat"): 9, ("cat", "</s>"): 5, ("the", "mat"): 1})
    slots = [[("the", 1.0)], [("mat", 0.5), ("cat", 0.5)]]
    after = posterior.slot_posterior(slots, p, theta=1.0)
    assert abs(sum(x for _, x in after[1]) - 1) < 1e-12 and max(after[1], key=lambda c: c[1])[0] == "cat"
    assert posterior.most_uncertain([[("a", 1.0)]], [0]) is None and posterior.slot_posterior([[("a", 1.0)]], p) == [[("a", 1.0)]]
    ranked = posterior.sentence_posterior([(0.5, slots), (0.5, [[("mat", 1.0)]])], p)
    assert abs(sum(x for x, _ in ranked) - 1) < 1e-12 and ranked[0][1] == "the cat"
    assert posterior.read_out([[("play", 1.0)], [("##ing", 1.0)], [("-", 1.0)], [("on", 1.0)]]) == ["playing-on"]


def test_restore_end_to_end(spark):
    corpus = spark.createDataFrame([(i, "the cat sat on the mat.") for i in range(3)], "id long, text string")
    provider = posterior.bigram_provider(corpus.select(tokens.sentence_tokens(F.col("text")).alias("tokens")))
    w = restore.words_of(corpus)
    got = restore.restore(spark.createDataFrame([(1, "teh ct st on the mat."), (2, "the cat sat")], "id long, text string"), ["id"], "text", w, provider).collect()
    assert {r.id: r.sentence for r in got}[2] == "the cat sat" and len(got) == 2
    assert restore.restore(spark.createDataFrame([], "id long, text string"), ["id"], "text", w, None).count() == 0


# ---- metrics ----

def scalar_bleu(r, h):
    logs = []
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (r, h))
        hit, all_ = sum((a & b).values()), max(len(h) - n + 1, 0)
        if not hit:
            return 0.0
        logs.append(math.log(hit / all_))
    return math.exp(sum(logs) / 4) * (1 if len(h) >= len(r) else math.exp(1 - len(r) / len(h)))


def scalar_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_metrics_equal_scalar_versions(spark):
    r = random.Random(9)
    pairs = [([r.choice("abc") for _ in range(r.randint(1, 12))], [r.choice("abc") for _ in range(r.randint(1, 12))]) for _ in range(80)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, r array<string>, h array<string>")
    got = sorted(df.select("i", metrics.bleu(F.col("r"), F.col("h")), metrics.common_subsequence(F.col("r"), F.col("h"))).collect())
    for (_, bleu, lcs), (a, b) in zip(got, pairs, strict=True):
        assert abs(bleu - scalar_bleu(a, b)) < 1e-9 and lcs == scalar_lcs(a, b)


def test_statistics(spark):
    df = spark.createDataFrame([(0, float(x), x % 2) for x in range(10)], "g int, x double, f int")
    assert stats.t_test(df, "x", "f", ["g"]).first().dof == 8
    assert abs(stats.t_p_value(2.228, 10) - 0.05) < 1e-3 and stats.t_p_value(0.0, 5) == 1.0
    assert abs(stats.spearman(df.withColumn("y", -F.col("x")), "x", "y", ["g"]).first().rho + 1) < 1e-12


# ---- studies, reports, files, streams ----

def test_balanced_assignment(spark):
    rows = spark.createDataFrame([(i, f"t{i % 5}") for i in range(20)], "k long, truth string")
    got = study.balanced_assignment(rows, "truth", "k", 4).collect()
    assert all(Counter((r.list, r.truth) for r in got)[x] == 1 for x in {(r.list, r.truth) for r in got})
    assert {sum(r.list == i for r in got) for i in range(4)} == {5}
    assert sum(r.list is None for r in study.balanced_assignment(rows, "truth", "k", 3).collect()) == 5


def test_report(spark):
    df = spark.createDataFrame([("m", "a", 0.1234), ("m", "b", 1.0)], "m string, a string, v double")
    assert report.markdown(report.pivoted(df, "m", "a", "v", ["a", "b"])) == "| m | a | b |\n| --- | --- | --- |\n| m | 0.123 | 1.0 |"


def test_files(spark, tmp_path):
    p = tmp_path / "pairs.txt"
    p.write_text("# [('visual', 0.3)]\n4.0\t A b\tC \"d\n", encoding="utf-8")
    got = readers.labelled_pairs(spark, str(p)).collect()
    assert [tuple(r) for r in got] == [(4.0, "a b", 'c "d')] and readers.attack_headers(spark, str(p)).count() == 1
    readers.write_pairs(spark.createDataFrame([(1.0, "x", "y")], "score double, first string, second string"), str(tmp_path / "out"))
    assert readers.labelled_pairs(spark, str(tmp_path / "out")).collect()[0].first == "x"
    (tmp_path / "p.txt").write_text("t|h|e|\tDH|-|AH|\n")
    assert readers.pronunciations(spark, str(tmp_path / "p.txt")).first().phones == ["DH", "-", "AH"]
    (tmp_path / "t.csv").write_text("v1,0,0,\"{'phase': 'Experiment', 'status': 'submit'}\"\n")
    assert readers.trials(spark, str(tmp_path / "t.csv")).first().phase == "Experiment"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "some words here"), (2, "und mehr")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    q = sentences.attacked(stream, "id", "text", [("disemvowel", 0.5)]).writeStream.format("memory").queryName("attacked_stream").start()
    q.processAllAvailable()
    q.stop()
    batch = sentences.attacked(spark.read.parquet(str(tmp_path / "in")), "id", "text", [("disemvowel", 0.5)])
    assert sorted(map(str, spark.table("attacked_stream").collect())) == sorted(map(str, batch.collect()))


def test_chunks_are_contiguous_and_near_equal(spark):
    r = random.Random(4)
    numbers = [None, None, *[r.randint(-5, 5) for _ in range(60)], *range(100, 140)]
    words = [None, "", "\u00e9", *["".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(50)]]
    for values, kind in ((numbers, "int"), (words, "string"), ([1, 2], "int"), ([None], "double"), ([], "string"), ([], "long")):
        got = study.in_chunks(spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"v {kind}, i int"), "v", 4, ranges=8).collect()
        assert sorted(x.i for x in got) == list(range(len(values)))
        own = [sorted(((x.v is not None, x.v) for x in got if x.chunk == c), key=lambda t: (t[0], t[1] if t[0] else 0)) for c in range(4)]
        assert [len(c) for c in own] == [len(values) // 4 + (c < len(values) % 4) for c in range(4)]
        flat = [v for c in own for _, v in c]
        assert [v for v in flat if v is not None] == sorted(v for v in values if v is not None) and all(v is None for v in flat[: values.count(None)])


def test_stems_of_published_examples(spark):
    examples = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
    troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
    rational ration valenci valenc digitizer digit radically radic vileli vile operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal
    sensitiviti sensit triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin
    adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect
    bowdlerize bowdler probate probat rate rate cease ceas controlling control roll roll generalizations gener oscillators oscil""".split()
    words, want = examples[::2], examples[1::2]
    assert column(spark, words, stems.stem) == want
    assert column(spark, ["", "is", None, "7", "42nd"], stems.stem) == ["", "is", None, "7", "42nd"]
    assert column(spark, ["Cats RUNNING its"], lambda c: stems.stems(F.split(c, " "))) == [["cat", "run", "its"]]
    pair = spark.createDataFrame([("he was running home", "he was runs home")], "text string, attacked string")
    assert evaluation.scored(pair, stemmed=True).head().rouge1 == 1.0 and evaluation.scored(pair).head().rouge1 == 0.75
