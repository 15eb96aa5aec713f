"""Corpus operators against brute force, round trips and held-out labels, with nulls, empties, ties and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import chat, html_extract, media, mixing, near_dups, packing, pii, pii_labels, quality, toxicity, url_filter, url_labels
from wordloom.llm.common import ascii_lower, words_of
from wordloom.llm.components import components
from wordloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    out = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60))), f"s{i % 3}") for i in range(n)]
    for k in range(10):  # near copies
        w = out[k][1].split()
        w[len(w) // 2] = "changed"
        out.append((n + k, " ".join(w), "s0"))
    return [*out, (200, None, None), (201, "", "s1"), (202, "one", "s1"), (203, "One", "s2"), (204, out[3][1], "s2"), (204, out[3][1], "s2"), (None, "no id at all here", "s1")]


# ---- near duplicates ----

@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = corpus()
    sets, ids = {}, sorted({i for i, _, _ in rows if i is not None})
    for i, t, _ in rows:
        w = words_of(ascii_lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    group = {i: i for i in ids}
    for _ in ids:
        for a, b in itertools.combinations(ids, 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    got = near_dups.near_duplicates(documents(spark, rows).withColumn("key", F.lit(1)), k=k).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (group[r.doc_id], len(sets[r.doc_id]), r.doc_id == group[r.doc_id])


def test_near_duplicates_in_large_buckets(spark):
    """A hot group of near copies, all in the same buckets, beside another that shares most bands."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i % 7}"]), "s") for i in range(120)] + [(500 + i, " ".join([*base[:30], *(f"y{j}" for j in range(30)), f"z{i}"]), "s") for i in range(50)]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(documents(spark, rows), k=2).collect()}
    assert {got[i] for i in range(120)} == {0} and {got[500 + i] for i in range(50)} == {500}


def test_near_duplicates_of_one_document_with_two_texts(spark):
    rows = [(5, "a b c d", "s"), (5, "x y z w", "s"), (3, "x y z w", "s"), (9, "p q r s", "s")]
    got = near_dups.near_duplicates(documents(spark, rows), k=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(documents(spark, [])).count() == 0


def test_components_equal_brute_force(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)]
    group = {i: i for e in edges for i in e}
    for _ in range(len(group)):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: g for i, g in group.items() if i != g and any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- packing ----

def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    rows = [*corpus(), (300, "long text " * 3000, "s"), (301, "Ünï cödé \u3042 $%& don't 12,5\n\tx", "s")]
    got = packing.pack(documents(spark, rows), tokenizer_path()).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    want = sorted(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, _ in rows)
    by_doc, by_sequence = {}, {}
    for p in got:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    seen = []
    for (doc, n), pieces in by_doc.items():
        pieces.sort(key=lambda p: p.start)
        ids = [tuple(np.frombuffer(p.ids, "<u4").tolist()) for p in pieces]
        joined = sum(ids, ())
        while joined:  # repeated rows of one doc_id
            seen.append(joined[:n]) if doc != 204 else None
            joined = joined[n:] if doc != 204 else ()
    assert {x for x in want} >= set(seen) and sum(p.length for p in got) == sum(map(len, want))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1] and sum(p.length for p in pieces) <= 2048
    least = -(-sum(map(len, want)) // 2048)
    assert len(by_sequence) <= least + 2


def test_differencing_is_near_equal():
    r = random.Random(5)
    sizes = [r.randint(1, 500) for _ in range(200)]
    sets = packing.difference(sizes, 12)
    assert sorted(sum(sets, [])) == list(range(200))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) - min(sums) <= 5
    assert packing.difference([], 3) == [[], [], []]


def test_window_count_rises_when_capacity_is_exceeded():
    windows = packing.fill([70, 70, 70], 100)
    assert all(sum(m for _, _, m in w) <= 100 for w in windows)
    assert sum(m for w in windows for _, _, m in w) == 210


# ---- mixing ----

def test_water_fill():
    t = mixing.water_fill(np.array([10.0, 1000.0, 100.0]), np.array([1.0, 2.0, 3.0]), 1110.0, 3.0)
    assert t[0] == 30 and t[2] == 300 and abs(t.sum() - 1110) < 1e-9


def test_mix_is_near_targets_and_repeats(spark):
    rows = [*corpus(200), (400, "big " * 2000, "s2")]
    docs = documents(spark, rows).withColumns({"copies": F.lit("clash"), "size": F.lit(-1), "target": F.lit("x"), "_doc": F.lit(1), "other": F.lit("stays")})
    one = mixing.mixed(docs).select("doc_id", "source", "size", "target", "copies").collect()
    two = mixing.mixed(docs.repartition(7)).select("doc_id", "source", "size", "target", "copies").collect()
    three = mixing.mixed_sizes(docs).select("doc_id", "source", "size", "target", "copies").collect()
    assert sorted(map(str, one)) == sorted(map(str, three))
    assert {r.other for r in mixing.mixed(docs).collect()} == {"stays"} and mixing.mixed(docs).filter("_doc = 1").count() == len(rows)
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == len(rows)
    for s in {r.source for r in one}:
        own = [r for r in one if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= max(60, 0.02 * own[0].target)
    assert all(0 <= r.copies <= 3 for r in one)
    assert mixing.mixed(documents(spark, [])).count() == 0


def test_mix_equals_brute_force(spark):
    """Sizes, targets and bounds done again on lists; copies are the whole part of the share, or one more."""
    rows = [*corpus(150), (400, "big " * 900, "s2"), (401, "tie a b", "s0"), (401, "tie a b", "s0"), (402, "x " * 5, "\u00e9")]
    sizes = [(i, s, len(words_of(t))) for i, t, s in rows]
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, x, n in sizes if x == s) for s in names}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    capped: set = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        target = {s: 3.0 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    got = mixing.mixed_sizes(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(i), str(s), n) for i, s, n in sizes)
    for r in got:
        share = target[r.source] / total[r.source] if total[r.source] and r.size else 0.0
        assert r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6 and int(share + 1e-9) <= r.copies <= min(3, int(share + 1e-9) + 1)
    for s in names:
        taken = sum(r.size * r.copies for r in got if r.source == s)
        assert abs(taken - target[s]) <= max([1, *(n for _, x, n in sizes if x == s)])


def test_pivotal_keeps_expectation():
    total = np.zeros(20)
    for seed in range(400):
        q = mixing.pivotal([0.3] * 20, [1.0 + i for i in range(20)], list(range(20)), seed)
        total += np.array([x if x in (0.0, 1.0) else x for x in q])
    assert np.abs(total / 400 - 0.3).max() < 0.12


# ---- toxicity ----

def test_toxicity_held_out(spark):
    r = random.Random(2)
    clean = [" ".join(r.choice(["river", "garden", "house", "music", "stone", "bread"]) for _ in range(30)) for _ in range(300)]
    rows = [(i, t + (" you stupid fool" if i % 4 == 0 else ""), int(i % 4 == 0)) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.filter("doc_id < 200"))
    got = {x.doc_id: x.predicted for x in toxicity.score(df.filter("doc_id >= 200"), model).collect()}
    assert sum(got[i] == int(i % 4 == 0) for i in got) >= 95
    assert toxicity.score(documents(spark, [(1, None, None), (2, "", None)]), model).count() == 2
    assert toxicity.keep(documents(spark, []), model).count() == 0


def test_scores_equal_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["river", "garden", "fool", "music"]) for _ in range(8)), 0) for i in range(60)]
    rows = [(i, t, int("fool" in t)) for i, t, _ in rows] + [(7, "river", 0), (7, "river", 0)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:60]], "doc_id long, toxic int")
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumns({"score": F.lit("clash"), "toxic": F.lit(9)})
    some = toxicity.training_rows(df, labels)
    assert some.count() == 60 and toxicity.training_rows(df, labels, sample=20).count() < 45
    model = toxicity.train(some)
    more = df.unionByName(spark.createDataFrame([(90, None), (91, ""), (92, "a fool " * 40000)], "doc_id long, text string").withColumns({"score": F.lit("x"), "toxic": F.lit(1)}))
    for x in toxicity.score(more, model).join(more.select("doc_id", "text").distinct(), "doc_id").filter("doc_id != 7").collect():
        present = {model.lookup[g] for g in toxicity.grams(x.text or "").tolist() if x.text and model.lookup[g] >= 0}
        z = sum(model.weights[f] for f in present) + model.intercept
        assert abs(x.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9 and x.predicted == int(x.score >= 0.3)
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_toxicity_with_one_class(spark):
    df = spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, toxic int")
    assert toxicity.score(df, toxicity.train(df)).first().predicted == 0


# ---- personal data ----

_PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    out = []
    for k, (name, pattern) in enumerate(_PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_patterns_equal_brute_force():
    r = random.Random(8)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1", "555-1234", " ", ".", "-", "..", "a@b.c@d.e", "+", "0"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 8)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_field_adds_spans_and_keeps_base(spark):
    field = pii.train(pii_labels.labelled_table())
    texts = ["write to anna.bergh (at) example.com please", "call (030) 555-1234 now", "plain words only", None, "", "mail a@b.org and 10.0.0.1"]
    found = pii.found(texts, field)
    assert [k for _, _, k in found[0][1]] == [0] and [k for _, _, k in found[1][1]] == [3] and found[2][1] == []
    assert set(found[5][0]) <= set(found[5][1]) and len(found[5][0]) == 2
    rows = pii.find(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), field).orderBy("doc_id").collect()
    assert rows[5].base_sha256 == hashlib.sha256(b"email:5:12,ip:17:25").hexdigest() and rows[5].redacted == "mail [EMAIL] and [IP]"
    out = pii.redacted(documents(spark, [(1, "x a@b.org", "s"), (2, None, "s")]), field).orderBy("doc_id").collect()
    assert out[0].text == "x [EMAIL]" and out[1].text is None


def test_parts_hold_all_that_whole_texts_give(monkeypatch):
    field, r = pii.train(pii_labels.labelled_table()), random.Random(3)
    fixed = ["10[.]0[.]0[.]1", "8 . 8 . 8 . 8", "127(.)0(.)0(.)1", "10 . 20 . 3 . 4"]
    made = [r.choice((" . ", "[.]", "(.)")).join(str(r.randint(0, n)) for _ in range(4)) for n in (9, 99, 255) for _ in range(100)]
    texts = [f"{' '.join(r.choice(pii_labels._WORDS) for _ in range(k))} {x} and so on" for x in fixed + made for k in (3, 30)]
    assert all(pii._parts(x) for x in fixed)
    near = [every for _, every in pii.found(texts, field)]
    monkeypatch.setattr(pii, "_parts", lambda t: [(0, len(t))])
    whole = [every for _, every in pii.found(texts, field)]
    assert near == whole and sum(map(bool, whole)) > 100


def test_addresses_with_leading_zeros():
    t = "0" * 5000 + "1.2.3.0255 and 1.2.3.0256"
    assert pii.base_spans(t) == [(0, 5010, 1)] == brute_spans(t[:4000] + t[4990:])[:1] or pii.base_spans(t)[0] == (0, 5010, 1)


def test_field_on_held_out_rows():
    """Precision and recall of whole entities on rows of another seed."""
    field, held = pii.train(pii_labels.labelled_table()), pii_labels.labelled_table(400, 23)
    found = [{(a, b) for a, b, _ in every} for _, every in pii.found([t for t, _ in held], field)]
    gold = [{(t.index(x), t.index(x) + len(x)) for _, x in entities} for t, entities in held]
    hit = sum(len(f & g) for f, g in zip(found, gold, strict=True))
    assert hit / sum(map(len, found)) >= 0.9 and hit / sum(map(len, gold)) >= 0.8, (hit / sum(map(len, found)), hit / sum(map(len, gold)))


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(0)
    e, move = r.normal(size=(1, 4, 3)), r.normal(size=(3, 3))
    best = max(itertools.product(range(3), repeat=4), key=lambda p: sum(e[0, i, x] for i, x in enumerate(p)) + sum(move[a, b] for a, b in itertools.pairwise(p)))
    assert tuple(pii.viterbi(e, move, [4])[0]) == best


# ---- quality ----

def brute_stats(t):
    t = t or ""
    w = words_of(t)
    windows = {}
    for i in range(len(w) - 4):
        windows.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_quality_statistics_equal_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", " ", "a", "a b c d e a b c d e", "x\nx\n\n \nx", "a a a a a a a", "# $ a|b <c>\r\nd"] + [" ".join(r.choice("ab c\n") for _ in range(r.randint(0, 60))) for _ in range(60)]
    got = quality.statistics(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_stats(texts[x.doc_id]), texts[x.doc_id]


def test_wide_positions_and_clashing_columns(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(30)]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumns({"_t": F.lit("mine"), "_w": F.lit(2), "n_words": F.lit("x")})
    got = quality.statistics(df).withColumn("wide", quality.repeated_words(quality.words(F.col("text")), narrow=1)).collect()
    assert all(x.n_repeat_words == x.wide and x["_t"] == "mine" and x["_w"] == 2 and isinstance(x.n_words, int) for x in got)
    assert quality.judge(quality.statistics(documents(spark, [])), []).count() == 0


def test_list_column_equals_rules(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["word", "Xy", "#", "12"]) for _ in range(r.randint(0, 30))) for _ in range(80)]
    stats = quality.statistics(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    rules = [[(0, True, 5.0), (2, False, 0.1)], [(1, False, 2.5)], [(6, False, 0.2), (8, True, 0.5)]]
    got = quality.judge(stats, rules).select("rule", "kept", "base_failed", *[c.alias(f"f{i}") for i, c in enumerate(quality.feature_columns().values())]).collect()
    for x in got:
        first = next((k for k, rule in enumerate(rules, 1) if quality._holds([x[f"f{i}"] for i in range(10)], rule)), 0)
        assert x.rule == first and x.kept == (not first and not x.base_failed)


def test_decision_list_learns_and_emits_one_expression(spark):
    r = random.Random(6)
    rows = [(*([r.random()] * 9), r.random(), 0) for _ in range(300)]
    rows = [(*x[:2], x[2], *x[3:-1], int(x[2] > 0.7)) for x in rows]
    rules = quality.learn(rows)
    assert rules and all(any(quality._holds(x, rule) for rule in rules) == bool(x[-1]) for x in rows[:200] if abs(x[2] - 0.7) > 0.05)
    assert quality.learn([(1.0, 0)]) == []


# ---- urls ----

def rules_by_brute_force():
    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = ascii_lower(host)
        fit = [(r, v) for r, v in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, max(fit, key=lambda x: len(x[0]))[0] if fit else None

    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x", "http://x.com/de/3#y", "http://x.com/fr/", "http://com/fr/x", "http://aorg/", "http://b.org", "http://b.org/", None, "", "no scheme", "http://", "a://b://c/d", "http://x.com?/de/"]
    return urls, [brute(u) for u in urls]


def test_urls_by_rule_and_features(spark):
    urls, want = rules_by_brute_force()
    model = url_filter.train(url_labels.labelled_urls())
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.judge(df, model).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule) for r in got] == want
    labelled = url_labels.labelled_urls()
    train, held = labelled[::2], labelled[1::2]
    m = url_filter.train(train)
    assert np.mean((m.margins([u for u, _ in held]) > 0) == np.array([v for _, v in held])) > 0.9
    column = url_filter.judge(spark.createDataFrame([(u,) for u, _ in held[:100]], "url string"), m).select("url", "block_margin").collect()
    assert np.allclose([r.block_margin for r in column], m.margins([r.url for r in column]))
    names = {url_filter.FEATURES[t.feature] for tree in m.trees for t in (tree, tree.left, tree.right) if t is not None and t.left is not None}
    assert {"parameters", "suffix", "digit_ratio"} <= names
    plain = ["https://stratford-upon-avon.org/visit/map", "https://co-op-bank.net/about/history", "https://www.city-library.de/", "http://old-mill-press.com/poetry"]
    odd = ["http://lucky8812.top/go?id=8382137&aff=77&sub=9x7f&u=a8f3kd92", "http://q8x7kd02jf.xyz/a9s8d7f6g5h4/?click=kd93jf84&token=83kd93kf93", "https://card-q9z8x7w6.click/h3j4k5l6m7?sid=9f8e7d6c5b&ref=x8&u=k2"]
    assert (m.margins(plain) < 0).all() and (m.margins(odd) > 0).all()
    clash = url_filter.judge(spark.createDataFrame([(plain[0], "h", 1)], "url string, host string, _given int"), m).first()
    assert clash.host == "stratford-upon-avon.org" and clash["_given"] == 1
    assert url_filter.judge(spark.createDataFrame([], "url string"), m).count() == 0


# ---- pages ----

def test_main_text_of_marked_pages():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three</p><script>x()</script><div class='comments'>nice</div><ul><li>x<li>y</ul></article><footer>f</footer></body></html>"
    assert html_extract.extract(page) == "A & B\n\none two three\n\nx\n\ny"
    assert html_extract.extract(None) == "" == html_extract.extract("<p></p>") and html_extract.extract("plain") == "plain"


def test_site_style_tree_removes_templates_inside_articles(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><article><h1>Title {i}</h1><p>text number {i} of many</p><div class=box>Read this offer</div></article></body>") for i in range(12)]
    got = html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Title {i}\n\ntext number {i} of many" for i in range(12)}


def test_site_style_tree_removes_templates(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class=top>Site name</div><div class=body><p>text number {i} of many</p></div><div class=end>All rights</div></body>") for i in range(12)]
    pages += [(20, "http://other.example/", "<body><div class=top>alone</div></body>"), (21, None, None), (20, "http://other.example/", "<body><div class=top>alone</div></body>")]
    got = html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 15 and text[3] == "text number 3 of many" and text[20] == "alone" and text[21] == ""


def test_names_do_not_judge_articles_and_headings():
    assert html_extract.extract('<article class="social-history"><h2 id="comments-on-law">Law</h2><p>x</p><div class="share">no</div></article>') == "Law\n\nx"


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "<article><p>in</p><nav>out</nav></article>" + "</div>" * 3000 + "</b>" * 3000
    assert html_extract.extract(deep) == "in"
    assert html_extract.extract("<article>" + "<p>a b</p>" * 20000 + "</article>") == "\n\n".join(["a b"] * 20000)


def test_style_tree_equals_brute_force(spark):
    r = random.Random(7)
    pages = []
    for i in range(60):
        boxes = "".join(f"<div class=b{k}>{'same' if r.random() < k / 6 else r.random()}</div>" for k in range(6) if r.random() < 0.9)
        pages.append((i, f"http://h{i % 3}.example/{i}", f"<body><article><p>own {i}</p>{boxes}<ul><li>x</li><li>{i % 2}</li></ul></article></body>"))
    pages.append(pages[0])
    trees = {}
    for host, html in {(u.split("/")[2], h) for _, u, h in pages}:
        def walk(node, path):
            here = (*path, node.kind)
            kids = [k for k in node.items if isinstance(k, html_extract.Node) and not k.noise]
            text = " ".join(" ".join(x for x in node.items if isinstance(x, str)).split())
            below = [c for k in kids if (c := walk(k, here))]
            content = (text, tuple(below)) if text or below else None
            trees.setdefault((host, here), set()).add((html, tuple(dict.fromkeys(k.kind for k in kids)), content))  # noqa: B023
            return content

        walk(html_extract.parse(html), ())

    def entropy(values):
        n = {v: values.count(v) for v in values}
        return -sum(c / len(values) * np.log(c / len(values)) for c in n.values()) / np.log(len(values)) if len(values) > 1 else 1.0

    want = set()
    for (host, path), seen in trees.items():
        importance = max(entropy([p for _, p, _ in seen]), html_extract.DAMPING * entropy([c for _, _, c in seen]))
        if len({h for h, _, _ in seen}) >= html_extract.MIN_PAGES and importance < html_extract.THRESHOLD:
            key = 0
            for kind in path:
                key = html_extract._step(key, kind)
            want.add((host, key))
    df = spark.createDataFrame([(u.split("/")[2], h) for _, u, h in pages], "host string, html string")
    assert {(x.host, x.path) for x in html_extract.template_paths(html_extract.elements(df)).collect()} == want and len(want) >= 3
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- chat ----

def test_chat_round_trip(spark):
    odd = "\\### Assistant: </turn> <turn:user> \\l \\\\ > ok"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", ""), (1, 3, "a<b>", None), (2, 0, None, "x"), (None, None, "user", "y"), (2, 0, None, "x")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", odd), ("assistant", odd), ("assistant", ""), ("a<b>", "")]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "x"), ("", "x")] and got[None].turns[0].text == "y"
    at = loss = 0
    for run in got[1].loss_runs:
        loss += run.chars if run.loss else 0
        at += run.chars
    assert at == len(got[1].formatted) and loss == len(odd.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g"))
    under = {r.conv_id: r.t for r in formatted.select("conv_id", chat.text_under_loss(F.col("formatted"), F.col("loss_runs")).alias("t")).collect()}
    assert under == {1: odd, 2: "", None: ""}
    wrong = F.transform("loss_runs", lambda r: F.struct(r["chars"].alias("chars"), (r["bytes"] - 1).alias("bytes"), r["loss"].alias("loss")))
    assert formatted.filter("conv_id = 1").select(chat.text_under_loss(F.col("formatted"), wrong)).first()[0] != odd
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(none)).count() == 0


def test_chat_of_a_long_conversation_with_repeated_and_clashing_columns(spark):
    rows = [(7, i % 400, "user" if i % 7 else "assistant", f"ä<{i}>" * (2000 if i == 5 else 1)) for i in range(800)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "formatted": F.lit("x")})
    f = chat.format_conversations(df)
    got = chat.read_back(f).select("turns", chat.text_under_loss(F.col("formatted"), F.col("loss_runs")).alias("t")).first()
    ordered = [(r, t) for _, r, t in sorted((t, r, x) for _, t, r, x in rows)]
    assert [(t.role, t.text) for t in got.turns] == sorted(ordered, key=lambda x: 0) and got.t == "".join(t for r, t in ordered if r == "assistant")


# ---- images ----

def test_image_copies_are_linked(spark):
    r = np.random.default_rng(1)
    base = [media.resize(r.random((8, 8)) * 255, 48, 48).round().astype(np.uint8) for _ in range(12)]
    images = [(i, *b.shape, b.tobytes()) for i, b in enumerate(base)]
    images += [(100 + i, *b.shape, np.clip(b * 0.9 + 10, 0, 255).astype(np.uint8).tobytes()) for i, b in enumerate(base)]
    images += [(200 + i, 45, 44, b[3:, 4:].copy().tobytes()) for i, b in enumerate(base)]
    images += [(300, *base[0].shape, base[0].tobytes()), (301, 0, 0, None), (302, 2, 2, b"abcd"), (303, 2, 2, b"abcd")]
    got = {r.id: r for r in media.image_copies(spark.createDataFrame(images, "id long, height int, width int, pixels binary")).collect()}
    assert len(got) == len(images) and all(got[i].component_id == i for i in range(12))
    assert sum(got[100 + i].component_id == i for i in range(12)) == 12 and sum(got[200 + i].component_id == i for i in range(12)) >= 11
    assert got[300].component_id == 0 and got[301].component_id == 301 and got[303].component_id == 302


def test_images_of_nothing_ties_and_clashes(spark):
    none = spark.createDataFrame([], "id long, height int, width int, pixels binary")
    assert media.image_copies(none).count() == 0
    flat = [(i, 40, 40, bytes(1600)) for i in (3, 1, 1, 2)]
    got = media.image_copies(spark.createDataFrame(flat, "id long, height int, width int, pixels binary").withColumns({"members": F.lit(1), "n": F.lit("x")})).collect()
    assert len(got) == 4 and {r.component_id for r in got} == {1}


def test_noisy_and_rescaled_copies_are_compared(spark):
    import pandas as pd

    r = np.random.default_rng(1)
    base = [media.resize(r.random((8, 8)) * 255, 48, 48).round().astype(np.uint8) for _ in range(12)]
    edited = [np.clip(b + r.normal(0, 6, b.shape), 0, 255).astype(np.uint8) for b in base]
    edited += [media.resize(b.astype(float), 40, 40).round().astype(np.uint8) for b in base]
    edited += [np.clip(media.resize(b[3:, 4:].astype(float), 52, 50) + r.normal(0, 3, (52, 50)), 0, 255).round().astype(np.uint8) for b in base]
    images = base + edited
    d = [media.descriptors(x) for x in images]
    linkable = [(i, j) for j in range(len(d)) for i in range(j) if media.agree(d[i], d[j]) >= max(media.MIN_AGREE, media.SHARE * min(len(d[i]), len(d[j])))]
    rows = [(i, *x.shape, x.tobytes()) for i, x in enumerate(images)]
    got = {x.id: x.component_id for x in media.image_copies(spark.createDataFrame(rows, "id long, height int, width int, pixels binary")).collect()}
    assert len(linkable) >= 30 and np.mean([got[i] == got[j] for i, j in linkable]) >= 0.9
    cell = pd.DataFrame({"id": [0, 1], "component": [0, 1], "part": [0, 0]})
    alone = [len(media._block(cell.assign(members=[d[i].tobytes(), d[j].tobytes()]))) for i, j in linkable]
    assert np.mean(alone) >= 0.9  # each pair on its own, not by way of others


def test_cells_of_two_parts_link_between_them():
    import pandas as pd

    b = media.resize(np.random.default_rng(3).random((8, 8)) * 255, 48, 48).round().astype(np.uint8)
    d = media.descriptors(b).tobytes()
    cell = pd.DataFrame({"id": [1, 2], "component": [1, 2], "part": [0, 1], "members": [d, d]})
    assert media._block(cell)[["a", "b"]].to_numpy().tolist() in ([[2, 1]], [[1, 2]])


def _edited_images():
    r = np.random.default_rng(8)
    base = [media.resize(r.random((8, 8)) * 255, 48, 48).round().astype(np.uint8) for _ in range(14)]
    noisy = [np.clip(b + r.normal(0, 5, b.shape), 0, 255).round().astype(np.uint8) for b in base]
    small = [media.resize(b.astype(float), 40, 40).round().astype(np.uint8) for b in base]
    family = [np.clip(base[0] + r.normal(0, 5, base[0].shape), 0, 255).round().astype(np.uint8) for _ in range(8)]
    images = base + noisy + small + [np.rot90(b).copy() for b in base] + family
    return [images[k] for k in r.permutation(len(images))]


def _all_links(members):
    return {(i, j) for j in range(len(members)) for i in range(j) if media._linked(members[i], members[j])}


def test_every_link_of_a_cell_is_found():
    import pandas as pd

    d = [media.descriptors(x).tobytes() for x in _edited_images()]
    links = _all_links(d)
    cell = pd.DataFrame({"id": range(len(d)), "component": range(len(d)), "part": 0, "members": d})
    found = [tuple(x) for x in media._block(cell.sample(frac=1, random_state=1))[["a", "b"]].to_numpy().tolist()]
    assert len(links) > 60 and sorted(found) == sorted(links)
    cell["part"] = cell["id"] % 3 // 2
    found = [tuple(x) for x in media._block(cell)[["a", "b"]].to_numpy().tolist()]
    assert sorted(found) == sorted((i, j) for i, j in links if i % 3 // 2 != j % 3 // 2)


def test_links_at_the_limits_of_distance_and_number():
    """Each match is as far as it may be, by the same bits, which lie in all of 24 sets of 16 (once the keys of the search)."""
    import pandas as pd

    r = np.random.default_rng(2)
    sets = [set(np.random.default_rng(9 + t).permutation(256)[:16].tolist()) for t in range(24)]
    flip = []
    while left := [s for s in sets if not s & set(flip)]:
        flip.append(max(range(256), key=lambda b: sum(b in s for s in left)))
    flip += [b for b in range(256) if b not in flip][: media.MAX_DISTANCE - len(flip)]
    for n, last in ((media.MIN_AGREE, None), (media.CORNERS, 255)):
        a = np.zeros(n, media._RECORD)
        bits = r.integers(0, 2, (n, 256), dtype=np.uint8)
        if last:
            bits[-1] = 1
        a["x"], a["y"], a["d"] = r.random(n) * 200, r.random(n) * 200, np.packbits(bits, axis=1)
        b, far = a.copy(), a.copy()
        bits[:, flip] ^= 1
        b["d"] = np.packbits(bits, axis=1)
        bits[: n - int(np.ceil(max(media.MIN_AGREE, media.SHARE * n))) + 1, [k for k in range(256) if k not in flip][0]] ^= 1
        far["d"] = np.packbits(bits, axis=1)
        b["x"] += 3
        cell = pd.DataFrame({"id": [1, 2], "component": [1, 2], "part": [0, 0]})
        assert media._linked(a.tobytes(), b.tobytes()) and not media._linked(a.tobytes(), far.tobytes())
        assert len(media._block(cell.assign(members=[a.tobytes(), b.tobytes()]))) == 1
        assert len(media._block(cell.assign(members=[a.tobytes(), far.tobytes()]))) == 0
        assert len(media._block(cell.assign(members=[a.tobytes(), a.tobytes()]))) == 1


def test_numbers_of_links_are_whole(spark):
    images = _edited_images()
    links = _all_links([media.descriptors(x).tobytes() for x in images])
    rows = [(i, *x.shape, x.tobytes()) for i, x in enumerate(images)]
    rows += [(100 + i, *images[5].shape, images[5].tobytes()) for i in range(3)] + [(None, *images[5].shape, images[5].tobytes())]
    size = {i: 4 if i == 5 else 1 for i in range(len(images))}
    expected = {i: size[i] - 1 + sum(size[b if a == i else a] for a, b in links if i in (a, b)) for i in range(len(images))}
    got = media.image_copies(spark.createDataFrame(rows, "id long, height int, width int, pixels binary")).collect()
    assert len(got) == len(rows) and {r.id: r.n_links for r in got} == expected | {100 + i: expected[5] for i in range(3)} | {None: 0}
    assert [r.component_id for r in got if r.id is None] == [None]


def _closure(links, n):
    near = {i: {i} for i in range(n)}
    for i, j in links:
        joined = near[i] | near[j]
        near.update(dict.fromkeys(joined, joined))
    return {(i, j) for i in near for j in near[i]}


def test_links_on_the_jvm_are_those_of_the_rule(spark, monkeypatch):
    """Also where the distance, the number and the error of matches are as large as they may be."""
    r = np.random.default_rng(4)
    members = [media.descriptors(x).tobytes() for x in _edited_images()]
    for shift in (3, 3.001):
        a = np.zeros(media.MIN_AGREE, media._RECORD)
        bits = r.integers(0, 2, (len(a), 256), dtype=np.uint8)
        a["x"], a["y"], a["d"] = r.random(len(a)) * 200, r.random(len(a)) * 200, np.packbits(bits, axis=1)
        b, far = a.copy(), a.copy()
        bits[:, : media.MAX_DISTANCE] ^= 1
        b["d"] = np.packbits(bits, axis=1)
        bits[0, media.MAX_DISTANCE] ^= 1
        far["d"] = np.packbits(bits, axis=1)
        b["x"][-1] = np.float32(a["x"][-1] + shift)
        members += [x.tobytes() for x in (a, b, far)]
    members += [members[0], members[0][: -media._RECORD.itemsize]]  # equal descriptors of unequal pixels, and a part of them
    links = _all_links(members)
    expected = {i: sum(1 + (b if a == i else a) % 3 for a, b in links if i in (a, b)) for i in range(len(members))}
    rows = [(i, bytes([i]), 1 + i % 3, m) for i, m in enumerate(members)]
    classes = spark.createDataFrame(rows, "id long, pixel_hash binary, rows long, members binary")
    monkeypatch.setattr(media, "_summary", None)  # blocks of arrays take no part
    for least in (64, 16):
        monkeypatch.setattr(media, "BLOCK_ROWS", least)
        got = media._links(classes).collect()
        total = dict.fromkeys(expected, 0)
        for x in got:
            total[x.pixel_hash[0]] += x.links
        assert total == expected and len(links) > 60
        assert _closure([(x.a, x.b) for x in got], len(members)) == _closure(links, len(members))


def test_numbers_of_links_do_not_depend_on_blocks(spark, monkeypatch):
    rows = [(i, *x.shape, x.tobytes()) for i, x in enumerate(_edited_images())]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary")
    whole = sorted(tuple(r) for r in media.image_copies(df).collect())
    monkeypatch.setattr(media, "BLOCK_ROWS", 16)
    assert sorted(tuple(r) for r in media.image_copies(df).collect()) == whole and sum(r[3] for r in whole) > 120
