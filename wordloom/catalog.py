"""Queries over the driver's tables, with their SQL where it can express them (the others have brute-force tests)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, stats, vectors
from .functions.chars import LETTERS, ascii_lower
from .operators import evaluation, lookalike, perturb, phonetic, posterior, prior, report, spelling, study, tokens
from .plans import restore

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEED, LEVEL = 0, 0.3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(c: Column) -> Column:
    return F.md5(c.cast("binary"))


# ---- tokens ----

_WORDS = r"""
t AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\A\s+|\s+\z', '', 'g'), ' ') AS ws FROM conversations WHERE text IS NOT NULL),
w0 AS (SELECT conv_id, turn, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
w1 AS (SELECT conv_id, turn, i, i = n AS last, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM w0),
w2 AS (SELECT *, CASE WHEN regexp_matches(w, '\A["'']') THEN left(w, 1) ELSE '' END AS lead_ FROM w1),
r0 AS (SELECT *, substr(w, length(lead_) + 1) AS rest, substr(w, length(lead_) + 1) AS s0 FROM w2)"""
for _i in range(3):
    _WORDS += rf""",
a{_i} AS (SELECT *, regexp_replace(s{_i}, '[,";:'']\z', '') AS m{_i} FROM {'r0' if _i == 0 else f'b{_i - 1}'}),
b{_i} AS (SELECT *, CASE WHEN last THEN regexp_replace(m{_i}, '(?s)\A(.*[^.])\.\z|\A(.+)[?!]\z', '\1\2') ELSE m{_i} END AS s{_i + 1} FROM a{_i})"""
_WORDS += r""",
toks AS (SELECT conv_id, turn, i, list_filter(list_concat([lead_, s3], string_split(substr(rest, length(s3) + 1), '')), lambda x: x <> '') AS ts FROM b2)"""


@query(f"""WITH {_WORDS}
SELECT conv_id, turn, CAST(sum(len(ts)) AS BIGINT) AS n_tokens, md5(string_agg(array_to_string(ts, ' '), ' ' ORDER BY i) FILTER (len(ts) > 0)) AS tokens_md5 FROM toks GROUP BY conv_id, turn""")
def tokenize_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens.sentence_tokens(F.col("text"))
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", F.size("t").cast("long").alias("n_tokens"), F.when(F.size("t") > 0, digest(F.array_join("t", " "))).alias("tokens_md5"))


@query("""SELECT item_id, CAST(len(p) AS BIGINT) AS n_tokens, md5(array_to_string(list_transform(p, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '|')) AS tokens_md5
FROM (SELECT item_id, regexp_extract_all(text, '(?s)[a-zA-Z'']+|.') AS p FROM benchmark)""")
def tokenize_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "benchmark").select("item_id", tokens.phonetic_tokens(F.col("text")).alias("p"))
    return p.select("item_id", F.size("p").cast("long").alias("n_tokens"), digest(F.array_join("p", "|")).alias("tokens_md5"))


@query("SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS lower_md5 FROM documents")
def ascii_lower_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", digest(ascii_lower(F.col("text"))).alias("lower_md5"))


@query(r"SELECT conv_id, turn, regexp_replace(trim(lower(text)), '\.\z', '') AS cleaned FROM conversations")
def clean_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", evaluation.normal(F.col("text")).alias("cleaned"))


_BENCH_WORDS = "w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)"


def bench_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


@query(f"WITH {_BENCH_WORDS} SELECT word, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS rank FROM w GROUP BY word")
def vocab_frequency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.frequency_rank(bench_words(spark, sf_dir), "word")


_CLASSES = r"""
d AS (SELECT DISTINCT unnest(string_split_regex(text, '\s+')) AS word FROM documents),
c AS (SELECT word, CASE WHEN regexp_matches(word, '^\[.*\]$') OR regexp_matches(word, '[^A-Za-z0-9\-'' #/\\(){}\[\]%$€@,:&?!;."]') THEN 'trash' WHEN regexp_matches(word, '^[0-9]+$') THEN 'number'
  WHEN starts_with(word, '##') THEN 'morpheme' WHEN regexp_matches(word, '[A-Za-z0-9]') THEN 'letter' ELSE 'punct' END AS kind, length(word) AS len FROM d WHERE word <> '')"""


@query(f"WITH {_CLASSES} SELECT kind, count(*) AS n_words, CAST(sum(len) AS BIGINT) AS n_chars, max(len) AS longest FROM c GROUP BY kind")
def dictionary_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).filter("word != ''").distinct()
    return words.select(tokens.token_class(F.col("word")).alias("kind"), F.length("word").cast("long").alias("len")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_words"), F.sum("len").alias("n_chars"), F.max("len").alias("longest"))


@query(f"WITH {_BENCH_WORDS}, u AS (SELECT DISTINCT word FROM w) SELECT word, length(word) AS len, row_number() OVER (ORDER BY length(word), word) - 1 AS idx FROM u")
def dictionary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.dictionary(bench_words(spark, sf_dir)).select("word", "len", "idx")


# ---- perturbations: word level with exact SQL, documents as a whole against brute force ----

def _tokens_sql(source: str = "benchmark") -> str:
    return rf"tok AS (SELECT item_id, unnest(ts) AS w, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT item_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''.\-][\p{{L}}\p{{N}}]+)*|[^\s]') AS ts FROM {source}))"


_TOKENS = _tokens_sql()


def bench_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.exploded(table(spark, sf_dir, "benchmark"), ["item_id"], tokens.word_tokens(F.col("text")))


def _attacked_words(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """item_id, attacked: the words that change at LEVEL, and the text that results."""
    key = F.concat_ws("|", F.lit(str(SEED)), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", perturb.perturb(F.col("text"), method, LEVEL, key).alias("attacked"))


def _attack_sql(method: str, new: str, level: float = LEVEL, source: str = "benchmark", key: str = f"{SEED}|") -> str:
    return rf"""WITH {_tokens_sql(source)},
n AS (SELECT item_id, w, pos, '{method}|{key}' || item_id AS k, count(*) OVER (PARTITION BY item_id) AS n FROM tok),
c AS (SELECT *, {new} AS new_ FROM n),
o AS (SELECT *, md5('order|' || k || '|' || pos) || lpad(pos::VARCHAR, 9, '0') AS u FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, w <> new_ ORDER BY u) AS turn_ FROM o),
j AS (SELECT item_id, string_agg(CASE WHEN w <> new_ AND turn_ <= ceil(n * CAST({level} AS DOUBLE)) THEN new_ ELSE w END, ' ' ORDER BY pos) AS s FROM r GROUP BY item_id)
SELECT item_id, regexp_replace(regexp_replace(s, ' ([.,:;?!%)\]}}])', '\1', 'g'), '([(\[{{$#]) ', '\1', 'g') AS attacked FROM j"""


_DISEMVOWEL_SQL = "CASE WHEN length(w) < 3 OR regexp_replace(w, '[AEIOUaeiou]', '', 'g') = '' THEN w ELSE regexp_replace(w, '[AEIOUaeiou]', '', 'g') END"


@query(_attack_sql("disemvowel", _DISEMVOWEL_SQL))
def attack_disemvowel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "disemvowel")


@query(_attack_sql("truncate", "substr(w, 1, greatest(least(length(w), 3), length(w) - 1))"))
def attack_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "truncate")


_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_LISTED = "(map {" + ", ".join(f"'{a}': {b.split(' ')!r}" for a, b in perturb.TYPOS.items()) + "}[w])"


@query(_attack_sql("natural-typo", f"coalesce({_LISTED}[CAST(floor({_U.format(chr(39) + 'typo|' + chr(39) + ' || k || ' + chr(39) + '|' + chr(39) + ' || pos')} * len({_LISTED})) AS INT) + 1], w)"))
def attack_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "natural-typo")


_KEYS = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in perturb.KEYBOARD.items()) + "}"
_AT = f"CAST(floor({_U.format(chr(39) + 'at|' + chr(39) + ' || k || ' + chr(39) + '|' + chr(39) + ' || pos')} * length(w)) AS INT) + 1"
_NEAR = f"{_KEYS}[lower(substr(w, {_AT}, 1))]"
_KU = _U.format("'key|' || k || '|' || pos")


_KEYBOARD_SQL = f"coalesce(substr(w, 1, {_AT} - 1) || substr({_NEAR}, CAST(floor({_KU} * length({_NEAR})) AS INT) + 1, 1) || substr(w, {_AT} + 1), w)"


@query(_attack_sql("keyboard-typo", _KEYBOARD_SQL))
def attack_keyboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "keyboard-typo")


@query(_attack_sql("full-swap", "CASE WHEN length(w) < 3 THEN w ELSE coalesce(list_filter(list_transform(range(10), lambda t: array_to_string(list_transform(list_sort(list_transform(range(1, length(w) + 1), lambda i: md5(k || '|' || pos || '|' || t || '|' || (i - 1)) || substr(w, i, 1))), lambda x: substr(x, 33)), '')), lambda x: x <> w)[1], w) END"))
def attack_full_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "full-swap")


_INNER = "substr(w, 2, length(w) - 2)"


@query(_attack_sql("inner-swap", f"CASE WHEN length(w) < 4 THEN w ELSE left(w, 1) || coalesce(list_filter(list_transform(range(10), lambda t: array_to_string(list_transform(list_sort(list_transform(range(1, length(w) - 1), lambda i: md5(k || '|' || pos || '|' || t || '|' || (i - 1)) || substr({_INNER}, i, 1))), lambda x: substr(x, 33)), '')), lambda x: x <> {_INNER})[1], {_INNER}) || right(w, 1) END"))
def attack_inner_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "inner-swap")


_MARKS_SQL = "'" + perturb.MARKS.replace("'", "''") + "'"
_MARK = f"substr({_MARKS_SQL}, CAST(floor({_U.format(chr(39) + 'mark|' + chr(39) + ' || k || ' + chr(39) + '|' + chr(39) + ' || pos')} * 32) AS INT) + 1, 1)"
_GAP = f"(CAST(floor({_U.format(chr(39) + 'gap|' + chr(39) + ' || k || ' + chr(39) + '|' + chr(39) + ' || pos')} * (length(w) - 1)) AS INT) + 1)"
_PUT = _U.format("'put|' || k || '|' || pos || '|' || t || '|' || (i - 1)")
_ONE = f"substr(w, 1, {_GAP}) || {_MARK} || substr(w, {_GAP} + 1)"


@query(_attack_sql("intrude", rf"CASE WHEN length(w) < 2 OR NOT regexp_matches(w, '[\p{{L}}\p{{N}}]') THEN w WHEN length(w) = 2 THEN {_ONE} ELSE coalesce(list_filter(list_transform(range(10), lambda t: array_to_string(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN i > 1 AND {_PUT} < CAST({LEVEL} AS DOUBLE) THEN {_MARK} ELSE '' END || substr(w, i, 1)), '')), lambda x: x <> w)[1], {_ONE}) END"))
def attack_intrude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "intrude")


_LIKE = "map {" + ", ".join(f"'{c}': [" + ", ".join("{{'v': '{}', 'p': {!r}::DOUBLE}}".format(v.replace("'", "''"), p) for v, p in vs) + "]" for c, vs in lookalike.table().items()) + "}"
_VU, _WU = (_U.format(f"'{x}|' || k || '|' || i") for x in "vw")


@query(f"""WITH m AS (SELECT {_LIKE} AS m), c AS (SELECT item_id, '{SEED}|' || item_id AS k, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM benchmark)
SELECT item_id, string_agg(CASE WHEN m[c] IS NOT NULL AND {_VU} < CAST({LEVEL} AS DOUBLE) THEN list_filter(m[c], lambda x: x.p >= {_WU})[1].v ELSE c END, '' ORDER BY i) AS attacked FROM c, m GROUP BY item_id""")
def attack_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "visual")


def _segmentation_sql(level: float = LEVEL, key: str = f"{SEED}|") -> str:
    u = lambda x: _U.format(f"'{x}|' || k || '|' || i")
    return f"""WITH c AS (SELECT item_id, '{key}' || item_id AS k, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM benchmark)
SELECT item_id, string_agg(CASE WHEN c = ' ' AND {u('drop')} < CAST({level} AS DOUBLE) THEN '' WHEN c <> ' ' AND {u('add')} < CAST({level} AS DOUBLE) / 10 THEN ' ' || c ELSE c END, '' ORDER BY i) AS attacked FROM c GROUP BY item_id"""


@query(_segmentation_sql())
def attack_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "segmentation")


_STEP1 = f"(SELECT item_id, attacked AS text FROM ({_segmentation_sql(0.2, f'0|{SEED}|')}))"
_STEP2 = f"(SELECT item_id, attacked AS text FROM ({_attack_sql('disemvowel', _DISEMVOWEL_SQL, 0.3, _STEP1, f'1|{SEED}|')}))"


@query(_attack_sql("keyboard-typo", _KEYBOARD_SQL, 0.2, _STEP2, f"2|{SEED}|"))
def attack_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", F.lit(str(SEED)), F.col("item_id").cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", perturb.composed(F.col("text"), [("segmentation", 0.2), ("disemvowel", 0.3), ("keyboard-typo", 0.2)], key).alias("attacked"))


_PHON = "VALUES " + ", ".join(f"('{w}', string_split('{a}', '|'), string_split('{p}', '|'), {f})" for w, a, p, f in phonetic.ALIGNED)


@query(f"""WITH a(word, letters, phones, freq) AS ({_PHON}), s AS (SELECT freq, unnest(letters) AS letters, generate_subscripts(letters, 1) AS i, list_concat(['[START]'], phones, ['[END]']) AS ph FROM a),
g AS (SELECT 1 AS n, array_to_string(ph[i + 1:i + 1], ' ') AS phones, letters, freq FROM s UNION ALL SELECT 2, array_to_string(ph[i:i + 1], ' '), letters, freq FROM s UNION ALL SELECT 3, array_to_string(ph[i:i + 2], ' '), letters, freq FROM s)
SELECT CAST(n AS BIGINT) AS n, phones, letters, CAST(sum(freq) AS BIGINT) AS support FROM g GROUP BY ALL""")
def phoneme_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phonetic.statistics(phonetic.aligned_table(spark))


_SLOTS = "map {" + ", ".join(f"'{w}': [" + ", ".join(f"{{'own': '{own}', 'ways': [" + ", ".join(f"{{'y': '{y}', 'q': {q!r}::DOUBLE}}" for y, q in ways) + "]}" for own, ways in ss) + "]" for w, ss in phonetic.slots(LEVEL).items()) + "}"
_CHANCE = repr(phonetic.level(LEVEL)[1]) + "::DOUBLE"
_PH, _WAY, _WORD = (_U.format(x) for x in ("'ph|' || k || '|' || i || '|' || (j - 1)", "'way|' || k || '|' || i || '|' || (j - 1)", "'word|' || k || '|' || i"))


@query(f"""WITH m AS (SELECT {_SLOTS} AS m), p AS (SELECT item_id, '{SEED}|' || item_id AS k, regexp_extract_all(text, '(?s)[a-zA-Z'']+|.') AS p FROM benchmark),
x AS (SELECT item_id, k, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM p),
n AS (SELECT *, array_to_string(list_transform(m[lower(x)], lambda s, j: CASE WHEN {_PH} < {_CHANCE} THEN list_filter(s.ways, lambda y: y.q >= {_WAY})[1].y ELSE s.own END), '') AS new_ FROM x, m)
SELECT item_id, string_agg(CASE WHEN m[lower(x)] IS NOT NULL AND {_WORD} < {_CHANCE} THEN CASE WHEN regexp_matches(x, '^[A-Z]') THEN upper(left(new_, 1)) || substr(new_, 2) ELSE new_ END ELSE x END, '' ORDER BY i) AS attacked FROM n GROUP BY item_id""")
def attack_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "phonetic")


# ---- scores of attacked texts ----

def attacked_pairs(spark: SparkSession, sf_dir: str, method: str = "disemvowel") -> DataFrame:
    """item_id, ref and hyp: T1 tokens of the texts and of the attacked texts."""
    t = table(spark, sf_dir, "benchmark").join(_attacked_words(spark, sf_dir, method), "item_id")
    return t.select("item_id", "text", "attacked", tokens.sentence_tokens(F.col("text")).alias("ref"), tokens.sentence_tokens(F.col("attacked")).alias("hyp"))


@query("WITH a AS (" + ORACLE_SQL["attack_truncate"] + r") SELECT item_id, levenshtein(regexp_replace(lower(text), '[^\x01-\x7f]', '', 'g'), regexp_replace(lower(attacked), '[^\x01-\x7f]', '', 'g')) AS distance FROM benchmark JOIN a USING (item_id)")
def edit_distance_attacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\x01-\x7f]", "")
    pairs = table(spark, sf_dir, "benchmark").join(_attacked_words(spark, sf_dir, "truncate"), "item_id")
    return pairs.select("item_id", F.levenshtein(plain("text"), plain("attacked")).cast("long").alias("distance"))


_PAIR_TOKENS = "p AS (SELECT a.item_id, string_split(text, ' ') AS r, string_split(attacked, ' ') AS h FROM benchmark JOIN a USING (item_id))"


def _overlap_sql(n: int) -> str:
    g = lambda c: f"SELECT item_id, unnest(list_transform(range(1, len({c}) - {n} + 2), lambda i: array_to_string({c}[i:i + {n} - 1], ' '))) AS g FROM p"
    return f"o{n} AS (SELECT item_id, CAST(sum(least(x.c, y.c)) AS DOUBLE) AS o FROM (SELECT item_id, g, count(*) AS c FROM ({g('h')}) GROUP BY ALL) x JOIN (SELECT item_id, g, count(*) AS c FROM ({g('r')}) GROUP BY ALL) y USING (item_id, g) GROUP BY item_id)"


@query("WITH a AS (" + ORACLE_SQL["attack_natural"] + f"), {_PAIR_TOKENS}, " + ", ".join(map(_overlap_sql, (1, 2, 3, 4))) + """
SELECT item_id, round(CASE WHEN least(p1, p2, p3, p4) <= 0 THEN 0 ELSE exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) * CASE WHEN len(h) >= len(r) THEN 1 ELSE exp(1 - len(r)::DOUBLE / len(h)) END END, 6) AS bleu, round(p1, 6) AS rouge_1, round(p4, 6) AS rouge_4
FROM (SELECT item_id, r, h, coalesce(o1.o / len(h), 0) AS p1, coalesce(o2.o / (len(h) - 1), 0) AS p2, coalesce(o3.o / (len(h) - 2), 0) AS p3, coalesce(o4.o / (len(h) - 3), 0) AS p4 FROM p LEFT JOIN o1 USING (item_id) LEFT JOIN o2 USING (item_id) LEFT JOIN o3 USING (item_id) LEFT JOIN o4 USING (item_id))""")
def bleu_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "benchmark").join(_attacked_words(spark, sf_dir, "natural-typo"), "item_id")
    r, h = F.split("text", " "), F.split("attacked", " ")
    return pairs.select("item_id", F.round(metrics.bleu(r, h), 6).alias("bleu"), F.round(metrics.rouge_n_precision(r, h, 1), 6).alias("rouge_1"), F.round(metrics.rouge_n_precision(r, h, 4), 6).alias("rouge_4"))


def _scores_sql(method: str, attack: str) -> str:
    precision = ", ".join(f"coalesce(o{n}.o / (len(h) - {n - 1}), 0) AS p{n}" for n in (1, 2, 3, 4))
    joins = " ".join(f"LEFT JOIN o{n} USING (item_id)" for n in (1, 2, 3, 4))
    norm = lambda c: rf"regexp_replace(trim(lower({c})), '\.\z', '')"
    plain = lambda c: rf"regexp_replace(lower({c}), '[^\x01-\x7f]', '', 'g')"
    return f"""SELECT * FROM (WITH a AS ({attack}), {_PAIR_TOKENS}, {", ".join(map(_overlap_sql, (1, 2, 3, 4)))},
s AS (SELECT item_id, r, h, {precision} FROM p {joins})
SELECT '{method}' AS method, round(avg(CASE WHEN least(p1, p2, p3, p4) <= 0 THEN 0 ELSE exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) * CASE WHEN len(h) >= len(r) THEN 1 ELSE exp(1 - len(r)::DOUBLE / len(h)) END END), 6) AS bleu,
round(avg(p1), 6) AS rouge1, round(avg(p4), 6) AS rouge4, round(avg(levenshtein({plain('text')}, {plain('attacked')})), 6) AS distance, round(avg(CASE WHEN {norm('text')} = {norm('attacked')} THEN 1.0 ELSE 0.0 END), 6) AS perfect_share,
count(*) FILTER ({norm('text')} = {norm('attacked')}) AS n_perfect, count(*) AS n FROM s JOIN a USING (item_id) JOIN benchmark USING (item_id))"""


_SCORED = {"disemvowel": "disemvowel", "truncate": "truncate", "full-swap": "full_swap", "inner-swap": "inner_swap", "intrude": "intrude", "keyboard-typo": "keyboard", "natural-typo": "natural", "segmentation": "segmentation", "phonetic": "phonetic", "visual": "visual"}


@query(" UNION ALL ".join(_scores_sql(m, ORACLE_SQL[f"attack_{f}"]) for m, f in _SCORED.items()))
def scores_of_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of the benchmark after each of the ten methods; the distance is that of the ASCII characters."""
    every = None
    for m in _SCORED:
        own = table(spark, sf_dir, "benchmark").join(_attacked_words(spark, sf_dir, m), "item_id").withColumn("method", F.lit(m))
        every = own if every is None else every.unionByName(own)
    names = ("bleu", "rouge1", "rouge4", "distance")
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\x01-\x7f]", "")
    pairs = evaluation.scored(every).withColumn("distance", metrics.edit_distance(plain("text"), plain("attacked")))
    s = evaluation.document_scores(pairs, ["method"], names)
    return s.select("method", *[F.round(n, 6).alias(n) for n in (*names, "perfect_share")], "n_perfect", "n")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(metrics.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("""SELECT vec_id, neighbour, round(dist, 4) AS distance FROM (SELECT q.vec_id, e.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), e.vec_id) AS k
FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE k <= 20""")
def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each query (ids divisible by 100) among all vectors; queries meet the vectors in blocks."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 20).withColumn("distance", F.round("distance", 4))


# ---- statistics ----

_LAB = "l AS (SELECT d.doc_id, d.lang, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(quality AS DOUBLE) AS quality, toxic FROM documents d JOIN labels USING (doc_id))"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), "toxic"), "doc_id")


@query(f"""WITH {_LAB}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS x, rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2.0 AS y FROM l)
SELECT lang, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS rho FROM r GROUP BY lang""")
def spearman_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(labelled(spark, sf_dir), "n_chars", "quality", ["lang"]).withColumn("rho", F.round("rho", 6))


_TT = f"WITH {_LAB}, s AS (SELECT lang, avg(n_chars) FILTER (toxic = 0) AS m0, avg(n_chars) FILTER (toxic = 1) AS m1, var_samp(n_chars) FILTER (toxic = 0) AS v0, var_samp(n_chars) FILTER (toxic = 1) AS v1, count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1 FROM l GROUP BY lang)"


@query(_TT + " SELECT lang, round((m0 - m1) / nullif(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / nullif(n0 + n1 - 2, 0) * (1.0 / nullif(n0, 0) + 1.0 / nullif(n1, 0))), 0), 6) AS t, CAST(n0 + n1 - 2 AS DOUBLE) AS dof FROM s")
def ttest_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.t_test(labelled(spark, sf_dir), "n_chars", "toxic", ["lang"]).withColumn("t", F.round("t", 6))


@query(_TT + " SELECT lang, round((m0 - m1) / nullif(sqrt(v0 / n0 + v1 / n1), 0), 6) AS t, round((v0 / n0 + v1 / n1) * (v0 / n0 + v1 / n1) / nullif(v0 / n0 * v0 / n0 / nullif(n0 - 1, 0) + v1 / n1 * v1 / n1 / nullif(n1 - 1, 0), 0), 4) AS dof FROM s")
def ttest_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.t_test(labelled(spark, sf_dir), "n_chars", "toxic", ["lang"], pooled=False).withColumns({"t": F.round("t", 6), "dof": F.round("dof", 4)})


@query(f"WITH {_LAB} SELECT lang, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM l GROUP BY lang")
def accuracy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("lang").agg(F.round(F.avg((F.col("quality") == 1 - F.col("toxic")).cast("double")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


# ---- prior ----

@query(f"WITH {_BENCH_WORDS}, u AS (SELECT DISTINCT word FROM w), c AS (SELECT word, unnest(string_split(word, '')) AS letter FROM u) SELECT letter, count(*) AS n, count(DISTINCT word) AS n_words FROM c GROUP BY letter")
def char_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bench_words(spark, sf_dir).select("word").distinct().select(F.posexplode(metrics.letter_counts(F.col("word"))).alias("i", "n")).filter("n > 0")
    return c.groupBy(F.substr(F.lit(LETTERS), F.col("i") + 1, F.lit(1)).alias("letter")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_words"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target: dictionary words next to each other in the order of length and word."""
    d = tokens.dictionary(bench_words(spark, sf_dir)).select("idx", "word")
    return d.select((F.col("idx") + 1).alias("idx"), F.col("word").alias("source")).join(d.select("idx", F.col("word").alias("target")), "idx").select("source", "target")


@query(f"""WITH {_BENCH_WORDS}, u AS (SELECT word, row_number() OVER (ORDER BY length(word), word) AS idx FROM (SELECT DISTINCT word FROM w)), p AS (SELECT a.word AS source, b.word AS target FROM u a JOIN u b ON b.idx = a.idx + 1)
SELECT source, target, round((1 + 2 * list_sum(list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: abs((length(source) - length(replace(source, c, ''))) - (length(target) - length(replace(target, c, ''))))))) * CASE WHEN left(source, 1) = left(target, 1) THEN 0.7 ELSE 1.0 END::DOUBLE * CASE WHEN right(source, 1) = right(target, 1) THEN 0.8 ELSE 1.0 END::DOUBLE, 6) AS score FROM p""")
def anagram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir).withColumn("score", F.round(metrics.anagram_score(F.col("source"), F.col("target")), 6))


@query(f"""WITH {_TOKENS.replace('tok AS', 'tok0 AS')}, tok AS (SELECT item_id, pos, lower(w) AS token FROM tok0), {_BENCH_WORDS}, u AS (SELECT DISTINCT word FROM w)
SELECT item_id, count(*) AS n_tokens, count(word) AS n_known, round(sum(CASE WHEN word IS NULL THEN 1.0 / (SELECT count(*) FROM u) ELSE 1.0 END::DOUBLE), 6) AS mass FROM tok LEFT JOIN u ON token = word GROUP BY item_id""")
def stupid_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bench_tokens(spark, sf_dir).withColumn("token", F.lower("token"))
    p = prior.plain_prior(t, bench_words(spark, sf_dir).select("word").distinct())
    return p.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("known")).alias("n_known"), F.round(F.sum("p"), 6).alias("mass"))


def _solved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, prior.Words]:
    words = restore.words_of(table(spark, sf_dir, "benchmark"))
    toks = tokens.exploded(_attacked_words(spark, sf_dir, "disemvowel"), ["item_id"], tokens.sentence_tokens(F.col("attacked")))
    return toks, prior.solve_tokens(toks, words, slots=False), words


@query()
def candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, rank, cost, cuts of the readings of every distinct token of the attacked benchmark."""
    _, solved, _ = _solved(spark, sf_dir)
    h = solved.select("token", F.posexplode("hyps").alias("rank", "h"))
    return h.select("token", F.col("rank").cast("long").alias("rank"), F.round("h.cost", 6).alias("cost"), F.array_join(F.col("h.cuts").cast("array<string>"), ",").alias("cuts"))


_EDGES = f"e AS (SELECT doc_id % 97 AS g, CAST(doc_id % 7 AS INT) AS a, CAST(doc_id % 7 + 1 + n_chars % 4 AS INT) AS b, min(CAST(n_chars % 13 AS DOUBLE) / 8) AS d FROM documents GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_EDGES}, p(g, to_, cost, steps) AS (SELECT DISTINCT g, 0, CAST(0 AS DOUBLE), 0 FROM e UNION ALL SELECT p.g, e.b, p.cost + e.d, p.steps + 1 FROM p JOIN e ON e.g = p.g AND e.a = p.to_ WHERE p.steps < 4)
SELECT g, k, cost FROM (SELECT g, cost + 10 - to_ AS cost, row_number() OVER (PARTITION BY g ORDER BY cost + 10 - to_) AS k FROM p) WHERE k <= 10""")
def lattice_best_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 cheapest chains of up to 4 edges in each of 97 lattices made from all documents, by joins and windows: each step keeps the best 10 for each place."""
    d = table(spark, sf_dir, "documents")
    e = d.select((F.col("doc_id") % 97).alias("g"), (F.col("doc_id") % 7).cast("int").alias("a"), (F.col("doc_id") % 7 + 1 + F.col("n_chars") % 4).cast("int").alias("b"), ((F.col("n_chars") % 13).cast("double") / 8).alias("d")).groupBy("g", "a", "b").agg(F.min("d").alias("d"))
    return prior.lattice_paths(e, "g")


_SCORES = "s AS (SELECT user_id AS g, event_id, CAST(event_id % 1000 AS DOUBLE) / 100 AS x FROM events)"


@query(f"""WITH {_SCORES}, m AS (SELECT *, exp(-x) / sum(exp(-x)) OVER (PARTITION BY g) AS p FROM s), t AS (SELECT *, max(p) OVER (PARTITION BY g) AS most, row_number() OVER (PARTITION BY g ORDER BY p DESC, event_id) AS k FROM m)
SELECT g, event_id, round(p, 6) AS p FROM t WHERE p >= 0.07 * most AND k <= 10""")
def hypothesis_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), "event_id", ((F.col("event_id") % 1000).cast("double") / 100).alias("x"))
    return prior.likely(s, ["g"], "event_id", "x").withColumn("p", F.round("p", 6))


@query(f"""WITH {_SCORES}, m AS (SELECT *, exp(-x) / sum(exp(-x)) OVER (PARTITION BY g, event_id % 3) AS p, event_id % 3 AS slot FROM s), k AS (SELECT g, slot, p, row_number() OVER (PARTITION BY g, slot ORDER BY p DESC) AS k FROM m),
t AS (SELECT g, slot, max(p) FILTER (k = 1) - max(p) FILTER (k = 2) AS gap FROM k WHERE k <= 2 GROUP BY g, slot) SELECT g, arg_min(slot, (gap, slot)) AS slot, round(min(gap), 6) AS gap FROM t WHERE gap IS NOT NULL GROUP BY g""")
def slot_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of the least gap between its two best candidates; slots are thirds of a user's events."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), (F.col("event_id") % 3).alias("slot"), ((F.col("event_id") % 1000).cast("double") / 100).alias("x"))
    m = s.withColumn("p", stats.softmax(-F.col("x"), 1.0, ["g", "slot"]))
    return posterior.least_gap_slots(m, ["g"], "slot", "p").withColumn("gap", F.round("gap", 6))


@query(f"""WITH {_WORDS}, f AS (SELECT conv_id, turn, list_concat(['<s>'], flatten(list(ts ORDER BY i)), ['</s>']) AS t FROM toks GROUP BY conv_id, turn), p AS (SELECT unnest(list_zip(t[1:len(t) - 1], t[2:len(t)])) AS z FROM f)
SELECT z[1] AS a, z[2] AS b, count(*) AS n FROM p GROUP BY ALL""")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter("text is not null").select(tokens.sentence_tokens(F.col("text")).alias("tokens"))
    return posterior.bigram_counts(t)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_end_to_end(spark, sf_dir)


@query()
def clean_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attacked benchmark restored, with its edit distance before and after."""
    bench = table(spark, sf_dir, "benchmark")
    words = restore.words_of(bench)
    provider = posterior.bigram_provider(bench.select(tokens.sentence_tokens(F.col("text")).alias("tokens")))
    attacked = _attacked_words(spark, sf_dir, "disemvowel")
    out = restore.restore(attacked, ["item_id"], "attacked", words, provider)
    plain = F.array_join(tokens.sentence_tokens(F.col("text")), " ")
    both = bench.join(attacked, "item_id").join(out, "item_id")
    return both.select("item_id", F.round("posterior", 6).alias("posterior"), metrics.edit_distance(plain, F.array_join(tokens.sentence_tokens(F.col("attacked")), " ")).alias("before"), metrics.edit_distance(plain, F.col("sentence")).alias("after"), "sentence")


# ---- reports and studies ----

_DOCS3 = "VALUES ('full_priors/a.txt', '# [(''disemvowel'', 0.3)]'), ('spell/b.txt', '# [(''keyboard-typo'', 0.2), (''truncate'', 0.2)]'), ('other/c.txt', '# [(''rand'', 0.3)]')"


@query(f"""WITH d(document, header) AS ({_DOCS3}) SELECT document, CASE WHEN contains(document, 'priors') THEN 'priors' WHEN contains(document, 'spell') THEN 'spell checker' END AS method,
CASE document WHEN 'full_priors/a.txt' THEN 'dv:0.3' WHEN 'spell/b.txt' THEN 'kt:0.2,tr:0.2' ELSE 'rd:0.3' END AS label FROM d""")
def report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.sql(f"SELECT * FROM ({_DOCS3.replace(chr(39) * 2, chr(92) + chr(39))}) AS t(document, header)")
    return d.select("document", report.method_of(F.col("document"), [("priors", "priors"), ("spell", "spell checker")]).alias("method"), report.attack_label(F.col("header")).alias("label"))


@query("SELECT lang, " + ", ".join(f"round(avg(n_chars) FILTER (toxic = {k}), 3) AS toxic_{k}" for k in (0, 1)) + " FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir).withColumn("k", F.concat(F.lit("toxic_"), F.col("toxic").cast("string")))
    return report.pivoted(d, "lang", "k", "n_chars", ["toxic_0", "toxic_1"])


@query(f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 20")
def sample_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.sample_per_group(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], "doc_id", 20, SEED)


@query("SELECT item_id, copy FROM benchmark, (SELECT unnest([1, 2, 3]) AS copy)")
def replicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.replicated(table(spark, sf_dir, "benchmark").select("item_id"), 3)


@query("SELECT item_id, item_id * 3 + copy AS row_key, (row_number() OVER (ORDER BY item_id, copy) - 1) % 7 AS list FROM benchmark, (SELECT unnest([1, 2, 3]) AS copy)")
def balanced_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of each benchmark item on seven lists, none twice on one."""
    rows = study.replicated(table(spark, sf_dir, "benchmark").select("item_id"), 3)
    return study.balanced_assignment(rows.withColumn("row_key", F.col("item_id") * 3 + F.col("copy")), "item_id", "row_key", 7)


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS n_{e}" for e in ("click", "view", "purchase")) + " FROM events GROUP BY user_id")
def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = study.answers(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ["click", "view", "purchase"])
    return wide.select("user_id", *[F.coalesce(f"{e}_n", F.lit(0)).cast("long").alias(f"n_{e}") for e in ("click", "view", "purchase")])


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND user_id NOT IN (1, 2) GROUP BY user_id")
def participant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.submitted(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type", "purchase", [1, 2]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""WITH b AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations)
SELECT conv_id, CAST(block AS BIGINT) AS block, count(*) AS n_lines FROM b WHERE role <> 'user' GROUP BY ALL""")
def islands_conll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of turns between those of users, which stand for blank lines."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("role")).alias("line"))
    return tokens.islands(lines, ["conv_id"], "turn", "line").select("conv_id", "block", "n_lines")


@query(f"""WITH {_TOKENS.replace('tok AS', 'tok0 AS')}, a AS ({ORACLE_SQL['attack_truncate']}), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(attacked), '[a-z]+')) AS token FROM a), {_BENCH_WORDS}, u AS (SELECT word, count(*) AS freq FROM w GROUP BY word),
c AS (SELECT token, word, freq, levenshtein(token, word) AS d FROM t JOIN u ON abs(length(token) - length(word)) <= 2 AND levenshtein(token, word) <= 2)
SELECT token, arg_min(word, (d, -freq, word)) AS correction, min(d) AS distance FROM c GROUP BY token""")
def spell_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct token of the attacked benchmark with its nearest known word: least distance up to 2, then frequency."""
    t = _attacked_words(spark, sf_dir, "truncate").select(F.explode(F.regexp_extract_all(F.lower("attacked"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    u = bench_words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return spelling.corrections(t, u)
