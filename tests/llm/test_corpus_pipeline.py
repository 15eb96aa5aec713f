"""The pipeline: columns between stages, decisions that take effect, awkward rows."""

from __future__ import annotations

import corpus_pipeline as cp
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def rows():
    base = [(i, " ".join(f"w{(i * 31 + j * j) % 997}" for j in range(40)), "en", f"s{i % 2}", 1) for i in range(80)]
    toxic = [(100 + i, f"w{i} you stupid fool stupid fool " * 4 + " ".join(f"v{(i * 17 + j) % 500}" for j in range(30)), "en", "s0", 1) for i in range(40)]
    return [*base, *toxic, (300, base[0][1], "en", "s1", 1), (301, "mail a@b.org " + base[5][1][::-1], "en", "s1", 1), (302, None, None, None, None), (None, "", None, None, 0)]


def test_stages(spark, tmp_path):
    data = rows()
    d = folder(spark, tmp_path, data, [(i, 1, 0) for i in range(80)] + [(100 + i, 0, 1) for i in range(40)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = cp.drop_toxic(spark, docs, d)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == list(cp.COLUMNS) and not any(100 <= i < 140 for i in left if i is not None) and set(range(80)) <= left
    single = cp.drop_near_duplicates(spark, clean, d)
    assert 300 not in {r.doc_id for r in single.collect()} and {r.doc_id for r in single.collect()} >= set(range(80))
    private = {r.doc_id: r for r in cp.redact_personal_data(spark, single, d).collect()}
    assert private[301].text.startswith("mail [EMAIL] ") and private[301].n_chars == len(private[301].text) and private[302].text is None
    mixed = cp.mix_sources(spark, single, d)
    assert mixed.columns == list(cp.COLUMNS) and mixed.count() > 0


def test_run_and_empty_tables(spark, tmp_path):
    d = folder(spark, tmp_path / "a", rows(), [(i, 1, 0) for i in range(80)] + [(100 + i, 0, 1) for i in range(40)])
    assert cp.run(spark, d).count() > 0
    e = folder(spark, tmp_path / "b", [], [])
    assert cp.run(spark, e).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage done again on lists, but for the trained models and the draws of the mix, which are taken as they are."""
    import itertools
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    from wordloom.llm import mixing, pii, pii_labels, toxicity
    from wordloom.llm.common import ascii_lower, words_of
    from wordloom.llm.queries import labelled, tokenizer_path

    data = [*rows(), (310, rows()[7][1], "en", "s0", 1), (311, " ".join([*rows()[9][1].split()[:39], "other"]), "en", "s1", 1), (301, "another text of the same document", "en", "s1", 1)]
    labels = [(i, 1, 0) for i in range(80)] + [(100 + i, 0, 1) for i in range(40)]
    d = folder(spark, tmp_path, data, labels)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(labelled(docs, spark.read.parquet(f"{d}/labels.parquet"), held_out=False))
    left = [r for r in data if not r[1] or not r[1].strip() or model.score(r[1]) < toxicity.CUTOFF]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words_of(ascii_lower(r[1] or ""))) else set() for r in left]
    group = {r[0]: r[0] for r in left if r[0] is not None}
    for _ in group:
        for i, j in itertools.combinations(range(len(left)), 2):
            a, b = left[i][0], left[j][0]
            if a is not None and b is not None and (a == b or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))):
                group[a] = group[b] = min(group[a], group[b])
    single = {}
    for r in left:
        if r[0] is None or group[r[0]] == r[0]:
            single[r[0]] = min(single.get(r[0], r), r, key=lambda x: (x[1] is not None, x[1] or ""))
    field = pii.train(pii_labels.labelled_table())
    clean = [(i, pii.redact(t, pii.found([t], field)[0][1]), s) for i, (_, t, _, s, _) in single.items()]
    plan = mixing.copies(spark.createDataFrame([(i, s, len(words_of(t))) for i, t, s in clean], "doc_id long, source string, size long"))
    times = {(r.doc_id, r.source): r.copies for r in plan.collect()}
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter(i for i, t, s in clean for _ in range(times[i, s]))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in clean}
    tokens, filled = Counter(), {}
    for p in cp.run(spark, d).collect():
        own = np.frombuffer(p.ids, "<u4").tolist()
        assert own == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        tokens[p.doc_id] += p.length
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert tokens == Counter({i: n * len(ids[i]) for i, n in want.items() if n}) and sum(want.values()) > 60
    assert all(sum(n for _, n in f) <= 2048 and [o for o, _ in sorted(f)] == [0, *itertools.accumulate(n for _, n in sorted(f))][:-1] for f in filled.values())
