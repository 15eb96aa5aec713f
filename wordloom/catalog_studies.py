"""Further queries over the driver's tables: evaluation, studies, earlier variants, vectors; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _BENCH_WORDS, _LAB, _PAIR_TOKENS, _TOKENS, _U, _WORDS, LEVEL, ORACLE_SQL, SEED, _attacked_words, bench_tokens, bench_words, digest, labelled, neighbours, query, table
from .functions import metrics, stats, stems, vectors
from .operators import evaluation, legacy, lookalike, perturb, prior, spelling, study, tokens
from .plans import restore
from .sources import readers

_NEIGHBOURS = f"{_BENCH_WORDS}, u0 AS (SELECT word, row_number() OVER (ORDER BY length(word), word) AS idx FROM (SELECT DISTINCT word FROM w)), p AS (SELECT a.word AS source, b.word AS target FROM u0 a JOIN u0 b ON b.idx = a.idx + 1)"


# ---- characters and words ----

@query(f"WITH {_NEIGHBOURS} SELECT source, target, list_has_all(string_split(target, ''), string_split(source, '')) AS contained, len(list_distinct(string_split(source, ''))) <= 1 AS all_equal, length(source) = length(target) AND list_has_all(string_split(target, ''), string_split(source, '')) AS like_anagram, regexp_matches(source, '[aeiou]') AS has_vowel FROM p")
def word_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("source"), F.col("target")
    return neighbours(spark, sf_dir).select(s, t, legacy.contains_each(t, s).alias("contained"), legacy.all_equal(s).alias("all_equal"), legacy.like_anagram(s, t).alias("like_anagram"), legacy.has_vowel(s).alias("has_vowel"))


@query("SELECT code, count(*) AS n FROM (SELECT format('{:04X}', unicode(c)) AS code FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '') GROUP BY code")
def character_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).filter("c != ''").groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return c.select(lookalike.hex_code(F.col("c")).alias("code"), "n")


@query("SELECT item_id, list_transform(list_filter(list_transform(p, lambda x, i: CASE WHEN regexp_matches(x, '^[A-Z]') THEN i - 1 END), lambda i: i IS NOT NULL), lambda i: i::VARCHAR)::VARCHAR AS places FROM (SELECT item_id, regexp_extract_all(text, '(?s)[a-zA-Z'']+|.') AS p FROM benchmark)")
def capital_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.transform(tokens.capitals(F.col("text")), lambda i: i.cast("string"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("["), F.array_join(p, ", "), F.lit("]")).alias("places"))


def _rewritten_sql(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, new in rules:
        pattern, new = pattern.replace("'", "''"), new.replace("'", "''").replace("$", "\\")
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex({_rewritten_sql('text', tokens.TREEBANK)}, '[ \\t\\n\\f\\r]+'), lambda x: x <> '') AS ts FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, len(ts) AS n_tokens, md5(array_to_string(ts, '|')) AS tokens_md5, md5({_rewritten_sql("' ' || array_to_string(ts, ' ') || ' '", tokens.TREEBANK_BACK)}) AS text_md5 FROM t""")
def treebank_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", tokens.treebank_tokens(F.col("text")).alias("ts"))
    return t.select("conv_id", "turn", F.size("ts").cast("long").alias("n_tokens"), digest(F.array_join("ts", "|")).alias("tokens_md5"), digest(tokens.treebank_text(F.col("ts"))).alias("text_md5"))


_RANKS = f"{_BENCH_WORDS}, f AS (SELECT word, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS rank FROM w GROUP BY word)"


@query(f"WITH {_RANKS}, k AS (SELECT DISTINCT word FROM w WHERE item_id % 5 = 0) SELECT word, freq, row_number() OVER (ORDER BY freq DESC, word) - 1 AS rank FROM f WHERE rank < 100 OR word IN (SELECT word FROM k)")
def known_or_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks anew of words that are in a dictionary (those of every fifth item, which stands for a word list) or among the 100 most frequent."""
    w = bench_words(spark, sf_dir)
    return tokens.known_or_frequent(tokens.frequency_rank(w, "word"), w.filter("item_id % 5 = 0"), 100)


@query(f"WITH {_RANKS}, e AS (SELECT word, exp(1e-5::DOUBLE * ((SELECT count(*) FROM f) - rank)) AS e FROM f) SELECT word, round(e / (SELECT sum(e) FROM e), 9) AS p FROM e")
def rank_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.rank_prior(tokens.frequency_rank(bench_words(spark, sf_dir), "word")).select("word", F.round("p", 9).alias("p"))


@query("""WITH l AS (SELECT lang AS word, 0 AS list, min(doc_id) AS place FROM documents GROUP BY lang UNION ALL SELECT source, 1, min(doc_id) FROM documents GROUP BY source)
SELECT word, length(word) AS len, list, place, row_number() OVER (ORDER BY length(word), list, place) - 1 AS idx FROM l WHERE word IS NOT NULL""")
def full_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two word lists, of languages and of sources in the order of their first document, as one dictionary."""
    d = table(spark, sf_dir, "documents")
    return tokens.full_dictionary([d.filter(f"{c} is not null").groupBy(F.col(c).alias("word")).agg(F.min("doc_id").alias("place")) for c in ("lang", "source")])


_SHUFFLED = "CASE WHEN length(word) < 3 THEN word ELSE coalesce(list_filter(list_transform(range(10), lambda t: array_to_string(list_transform(list_sort(list_transform(range(1, length(word) + 1), lambda i: md5('shuffle|' || word || '|' || t || '|' || (i - 1)) || substr(word, i, 1))), lambda x: substr(x, 33)), '')), lambda x: x <> word)[1], word) END"


def shuffled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_words(spark, sf_dir).select("word").distinct().withColumn("shuffled", perturb.full_swap(F.col("word"), F.concat_ws("|", F.lit("shuffle"), F.col("word"))))


@query(f"WITH {_BENCH_WORDS} SELECT word, {_SHUFFLED} AS shuffled FROM (SELECT DISTINCT word FROM w)")
def shuffled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled_words(spark, sf_dir)


_ANAGRAM = "(1 + 2 * list_sum(list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: abs((length(shuffled) - length(replace(shuffled, c, ''))) - (length(target) - length(replace(target, c, ''))))))) * CASE WHEN left(shuffled, 1) = left(target, 1) THEN 0.7 ELSE 1.0 END::DOUBLE * CASE WHEN right(shuffled, 1) = right(target, 1) THEN 0.8 ELSE 1.0 END::DOUBLE"


@query(f"""WITH {_BENCH_WORDS}, d AS (SELECT word, {_SHUFFLED} AS shuffled FROM (SELECT DISTINCT word FROM w)), c AS (SELECT d.word, shuffled, t.word AS target FROM d JOIN (SELECT DISTINCT word FROM w) t ON length(t.word) = length(d.word)),
s AS (SELECT *, round({_ANAGRAM}, 6) AS score FROM c), r AS (SELECT s.word, count(*) FILTER (s.score < o.score) AS rank FROM s JOIN (SELECT word, score FROM s WHERE word = target) o USING (word) GROUP BY s.word) SELECT length(word) AS len, count(*) AS n, round(avg(rank), 6) AS mean_rank, count(*) FILTER (rank = 0) AS n_first FROM r GROUP BY length(word)""")
def true_word_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of its length score better than the true word of a shuffled one: mean rank by length."""
    d = shuffled_words(spark, sf_dir)
    c = d.withColumn("len", F.length("word")).join(d.select(F.col("word").alias("target"), F.length("word").alias("len")), "len")
    s = c.withColumn("score", F.round(metrics.anagram_score(F.col("shuffled"), F.col("target")), 6)).withColumn("truth", F.col("word"))
    r = prior.truth_ranks(s, "word", "truth", "target", "score")
    return r.groupBy(F.length("word").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.count_if(F.col("rank") == 0).alias("n_first"))


# ---- earlier variants ----

@query(f"WITH {_NEIGHBOURS} SELECT source, target, levenshtein(source, target)::DOUBLE AS distance FROM p")
def legacy_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier distance with its discounts off and swaps at their price as two substitutions: plain edit distance."""
    return legacy.distances(neighbours(spark, sf_dir), anagrams=False, cheap_sub=False, plain_swap=2.0)


@query(f"WITH {_NEIGHBOURS}, d AS (SELECT source, target, levenshtein(source, target)::DOUBLE AS d FROM p UNION ALL SELECT target, source, levenshtein(source, target) FROM p) SELECT source, target, round(exp(27 / (d + 1)) / sum(exp(27 / (d + 1))) OVER (PARTITION BY source), 6) AS p FROM d")
def legacy_word_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = neighbours(spark, sf_dir)
    both = n.unionByName(n.select(F.col("target").alias("source"), F.col("source").alias("target"))).withColumn("distance", F.levenshtein("source", "target").cast("double"))
    return legacy.word_prior(both).select("source", "target", F.round("p", 6).alias("p"))


@query("WITH s AS (SELECT user_id, event_id, 1.0 / (1 + event_id % 7) AS p, 1 + event_id % 5 AS f FROM events) SELECT user_id, event_id, round(p::DOUBLE * f * sum(p::DOUBLE) OVER (PARTITION BY user_id) / sum(p::DOUBLE * f) OVER (PARTITION BY user_id), 6) AS p FROM s")
def reweighted_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select("user_id", "event_id", (F.lit(1.0) / (1 + F.col("event_id") % 7)).alias("p"), (1 + F.col("event_id") % 5).alias("f"))
    return legacy.reweighted(s, "p", "f", ["user_id"]).select("user_id", "event_id", F.round("p", 6).alias("p"))


@query("SELECT conv_id, turn, unnest(['?', '!', ';', '.', '\"']) AS mark, 0.2::DOUBLE AS p FROM conversations WHERE right(text, 1) NOT IN ('?', '!', ';', '.', '\"')")
def sentence_end_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.end_slots(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


@query(f"""WITH {_WORDS}, x AS (SELECT conv_id, turn, unnest(ts) AS token, i FROM toks), s AS (SELECT DISTINCT conv_id, turn, token FROM x WHERE turn % 2 = 0 AND length(token) > 3)
SELECT x.conv_id, x.turn, x.token, count(*) AS n FROM x JOIN s ON s.conv_id = x.conv_id AND s.turn = x.turn - 1 AND s.token = x.token WHERE x.turn % 2 = 1 GROUP BY ALL""")
def words_carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of second turns that the first turn of the pair has solved: how often each takes over."""
    t = tokens.exploded(table(spark, sf_dir, "conversations").filter("text is not null"), ["conv_id", "turn"], tokens.sentence_tokens(F.col("text"))).withColumn("pair", F.concat_ws("|", "conv_id", F.floor(F.col("turn") / 2)))
    first, second = t.filter("turn % 2 = 0"), t.filter("turn % 2 = 1")
    out = legacy.carried_over(first.select("pair", "token", F.col("token").alias("word"), F.lit(True).alias("sure")), second, "pair")
    parts = F.split("pair", r"\|")
    return out.groupBy(parts[0].cast("long").alias("conv_id"), (parts[1].cast("long") * 2 + 1).alias("turn"), "token").agg(F.count(F.lit(1)).alias("n"))


# ---- attacks as workloads, spelling ----

_DRAW = lambda x: _U.format(f"'{x}|{SEED}|' || item_id")


@query(f"""WITH n AS (SELECT {list(perturb.NAMES)!r} AS names), d AS (SELECT item_id, CAST(floor({_DRAW('a')} * 10) AS INT) AS a, CAST(floor({_DRAW('b')} * 9) AS INT) AS b FROM benchmark),
p AS (SELECT item_id, names[a + 1] AS x, names[CASE WHEN b >= a THEN b + 1 ELSE b END + 1] AS y FROM d, n) SELECT item_id, CASE WHEN x = 'intrude' THEN y ELSE x END AS first, CASE WHEN x = 'intrude' THEN x ELSE y END AS second FROM p""")
def drawn_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = perturb.drawn_pair(F.concat_ws("|", F.lit(str(SEED)), F.col("item_id").cast("string")))
    return table(spark, sf_dir, "benchmark").select("item_id", pair[0]["method"].alias("first"), pair[1]["method"].alias("second"))


_MERGE = _U.format("'merge|' || k || '|' || (i - 1)")


@query(rf"""WITH t AS (SELECT item_id, '{SEED}|' || item_id AS k, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''.\-][\p{{L}}\p{{N}}]+)*|[^\s]') AS ts FROM benchmark)
SELECT item_id, rtrim(array_to_string(list_transform(ts, lambda w, i: w || CASE WHEN {_MERGE} < CAST({LEVEL} AS DOUBLE) THEN '' ELSE ' ' END), '')) AS attacked FROM t""")
def attack_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attacked_words(spark, sf_dir, "segment")


@query(f"""WITH a AS ({ORACLE_SQL['attack_truncate']}), {_BENCH_WORDS}, u AS (SELECT word, count(*) AS freq FROM w GROUP BY word), x0 AS (SELECT item_id, unnest(string_split(lower(attacked), ' ')) AS token, generate_subscripts(string_split(lower(attacked), ' '), 1) AS pos FROM a), x AS (SELECT item_id, CASE WHEN regexp_full_match(token, '[\\x01-\\x7f]*') THEN token ELSE '#' END AS token, pos FROM x0),
c AS (SELECT token, word, freq, levenshtein(token, word) AS d FROM (SELECT DISTINCT token FROM x WHERE token <> '') JOIN u ON abs(length(token) - length(word)) <= 2 AND levenshtein(token, word) <= 2), b AS (SELECT token, arg_min(word, (d, -freq, word)) AS correction FROM c GROUP BY token)
SELECT item_id, string_agg(coalesce(correction, token), ' ' ORDER BY pos) AS cleaned FROM x LEFT JOIN b USING (token) GROUP BY item_id""")
def spell_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truncated benchmark after the spelling baseline; tokens beyond ASCII, whose distance DuckDB counts in bytes, are # before."""
    a = _attacked_words(spark, sf_dir, "truncate")
    plain = F.array_join(F.transform(F.split(F.lower("attacked"), " "), lambda t: F.when(t.rlike(r"\A[\x01-\x7f]*\z"), t).otherwise("#")), " ")
    words = bench_words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return spelling.corrected(a.select("item_id", plain.alias("cleaned")), ["item_id"], "cleaned", words)


# ---- evaluation ----

@query(f"WITH a AS ({ORACLE_SQL['attack_truncate']}), c AS (SELECT item_id FROM benchmark ORDER BY md5('{SEED}|' || item_id), item_id LIMIT 40), s AS (SELECT item_id % 3 AS part, CASE WHEN text = attacked THEN 1.0 ELSE 0.0 END AS same, length(text) - length(attacked) AS lost FROM benchmark JOIN a USING (item_id) JOIN c USING (item_id)) SELECT part, CASE WHEN count(*) >= 10 THEN round(avg(lost), 6) END AS lost, count(*) AS n FROM s GROUP BY part")
def subset_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation on a keyed sample of 40 items, by part; null for fewer than 10."""
    b = table(spark, sf_dir, "benchmark")
    chosen = study.sample_per_group(b.select("item_id", F.lit(0).alias("_g")), ["_g"], "item_id", 40, SEED)
    s = b.join(_attacked_words(spark, sf_dir, "truncate"), "item_id").select("item_id", (F.col("item_id") % 3).alias("part"), (F.length("text") - F.length("attacked")).alias("lost"))
    return evaluation.subset_scores(s, chosen, ["part"], ["item_id"], "lost").withColumn("lost", F.round("lost", 6))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')) WHERE k = 1")
def first_of_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return evaluation.members(e, e.filter("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query(f"""WITH a AS ({ORACLE_SQL['attack_truncate']}), h AS (SELECT item_id, 'tr' AS attack, ' ' || upper(text) || '.' AS truth FROM benchmark), m AS (SELECT 'tr' AS attack, text AS truth, attacked AS cleaned FROM benchmark JOIN a USING (item_id)),
n AS (SELECT attack, regexp_replace(trim(lower(truth)), '\\.\\z', '') AS t, min(cleaned) AS cleaned FROM m GROUP BY ALL) SELECT item_id, md5(cleaned) AS cleaned_md5 FROM h JOIN n ON n.attack = h.attack AND n.t = regexp_replace(trim(lower(h.truth)), '\\.\\z', '')""".replace("\\\\", "\\"))
def human_beside_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    human = b.select("item_id", F.lit("tr").alias("attack"), F.concat(F.lit(" "), F.upper("text"), F.lit(".")).alias("truth"))
    machine = b.join(_attacked_words(spark, sf_dir, "truncate"), "item_id").select(F.lit("tr").alias("attack"), F.col("text").alias("truth"), F.col("attacked").alias("cleaned"))
    return evaluation.beside_machine(human, machine).select("item_id", F.md5(F.col("cleaned").cast("binary")).alias("cleaned_md5"))


@query("SELECT doc_id, n FROM (SELECT doc_id, n_chars AS n, 0 AS t FROM documents UNION ALL SELECT doc_id, -1, 1 FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT -doc_id - 1, 5, 1 FROM documents WHERE doc_id % 5 = 0) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t DESC) = 1")
def appended_or_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n"))
    new = d.filter("doc_id % 3 = 0").select("doc_id", F.lit(-1).cast("long").alias("n")).unionByName(d.filter("doc_id % 5 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit(5).cast("long").alias("n")))
    return evaluation.replaced(d, new, ["doc_id"]).select("doc_id", "n")


@query("SELECT event_type, count(DISTINCT user_id) AS n_people, count(*) AS n_trials, round(avg(value), 6) AS mean FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY event_type")
def participant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluation.participants(table(spark, sf_dir, "events").withColumn("level", F.col("event_type")), "user_id", "event_type", "purchase", "level", "value")
    return r.select(F.col("level").alias("event_type"), "n_people", "n_trials", F.round("mean", 6).alias("mean"))


@query("WITH u AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS d, count(*) AS n FROM events GROUP BY user_id) SELECT count(*) AS n_people, CAST(sum(d) AS BIGINT) AS n_done, CAST(count(*) - sum(d) AS BIGINT) AS n_rejected, round(avg(n), 6) AS per_person FROM u")
def turnout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.turnout(table(spark, sf_dir, "events"), "user_id", "event_type", "purchase").withColumn("per_person", F.round("per_person", 6))


@query("SELECT condition, who FROM (SELECT condition, who, count(*) OVER (PARTITION BY condition) AS n, row_number() OVER (PARTITION BY condition ORDER BY md5('0|' || condition || '|' || who)[1:8], who) AS k FROM (SELECT DISTINCT event_type AS condition, user_id AS who FROM events)) WHERE n = 1 OR k > 1")
def one_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.one_dropped(table(spark, sf_dir, "events").select(F.col("event_type").alias("condition"), F.col("user_id").alias("who")), "condition", "who")


_TRIAL = lambda x: _U.format(f"'0|{x}|' || trial")


@query(f"SELECT trial, CAST(floor({_TRIAL('top')} * 10) AS BIGINT) + 1 AS top_n, round({_TRIAL('bert')}, 9) AS bert_theta, round({_TRIAL('gtp')} * 0.02, 9) AS gtp_theta FROM (SELECT unnest(range(60)) AS trial)")
def search_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.search_space(spark, 60).select("trial", "top_n", F.round("bert_theta", 9).alias("bert_theta"), F.round("gtp_theta", 9).alias("gtp_theta"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, round(avg(value) FILTER (event_id % 7 <> 0), 6) AS mean_of_numbers, round(stddev_pop(value), 6) AS spread FROM events GROUP BY event_type")
def trial_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, the mean without NaN (every seventh value is one), and the population's standard deviation."""
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(stats.mean_of_numbers("v"), 6).alias("mean_of_numbers"), F.round(F.stddev_pop("value"), 6).alias("spread"))


@query("WITH m AS (SELECT lang, source, avg(n_chars) AS m, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, round(sum(m * n) / sum(n), 6) AS mean FROM m GROUP BY lang")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("m"), F.count(F.lit(1)).alias("n"))
    return m.groupBy("lang").agg(F.round(stats.weighted_mean("m", "n"), 6).alias("mean"))


@query(f"WITH {_LAB} SELECT lang, doc_id, round(avg(n_chars) OVER (PARTITION BY lang), 6) AS mean_n_chars FROM l")
def mean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.beside_mean(labelled(spark, sf_dir), ["lang"], "n_chars").select("lang", "doc_id", F.round("mean_n_chars", 6).alias("mean_n_chars"))


@query("SELECT split_part(regexp_replace(url, '^.*/', ''), '.', 1) AS name, count(*) AS n FROM pages WHERE NOT contains(url, 'page=') GROUP BY ALL")
def base_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = readers.without(table(spark, sf_dir, "pages").select("url"), "url", "page=")
    return p.groupBy(F.split(F.regexp_replace("url", "^.*/", ""), r"\.")[0].alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id, CAST(floor(" + _U.format("'list|' || item_id") + " * 7) AS BIGINT) AS start_, copy FROM benchmark, (SELECT unnest([1, 2, 3]) AS copy)")
def round_robin_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in turn from a keyed start: start_ and copy give the list, which the query checks back from the assignment."""
    rows = study.replicated(table(spark, sf_dir, "benchmark").select("item_id"), 3).withColumn("row_key", F.col("item_id") * 3 + F.col("copy"))
    a = study.round_robin(rows, "item_id", "row_key", 7).withColumn("copy", F.col("row_key") - F.col("item_id") * 3)
    return a.select("item_id", F.pmod(F.col("list") - (F.col("copy") - 1), F.lit(7)).cast("long").alias("start_"), F.col("copy").cast("int").alias("copy"))


# ---- vectors ----

@query("SELECT round(min(c), 6) AS least, round(avg(c), 6) AS mean, round(max(c), 6) AS most FROM (SELECT list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)")
def cosine_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the queries (ids divisible by 100) with all other vectors, in blocks."""
    e = table(spark, sf_dir, "embeddings")
    r = vectors.cosine_range(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding")
    return r.select(*[F.round(c, 6).alias(c) for c in ("least", "mean", "most")])


@query("SELECT label, CAST(i - 1 AS INT) AS i, round(sum(x * (1 + vec_id % 3)) / sum(1 + vec_id % 3), 6) AS mean FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("weight", 1 + F.col("vec_id") % 3)
    return vectors.mean_vectors(e, ["label"], "embedding", "weight").withColumn("mean", F.round("mean", 6))


@query("SELECT vec_id, arg_max(letter, (c, letter)) AS letter FROM (SELECT e.vec_id, l.vec_id AS letter, round(list_cosine_similarity(e.embedding::DOUBLE[], l.embedding::DOUBLE[]), 9) AS c FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id < 26) l ON true) GROUP BY vec_id")
def closest_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 26 vectors stand for letters."""
    e = table(spark, sf_dir, "embeddings")
    letters = e.filter("vec_id < 26").select(F.col("vec_id").alias("letter"), "embedding")
    return vectors.closest(e, letters, "vec_id", "embedding", "letter").select("vec_id", "letter")


@query("WITH g AS (SELECT vec_id // 5 AS g, vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT g, round(avg(d), 6) AS distance FROM (SELECT h.g, h.vec_id, min(list_distance(h.v, r.v)) AS d FROM g h JOIN g r ON r.g = h.g + 1 GROUP BY ALL) GROUP BY g")
def mover_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fives of vectors stand for sentences, each against the next."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("g"), "embedding")
    return vectors.relaxed_mover(e.withColumn("g", F.col("g") - 1), e, ["g"], "embedding").withColumn("distance", F.round("distance", 6))


@query("SELECT doc_id, n_chars, ntile(7) OVER (ORDER BY n_chars, doc_id) - 1 AS chunk FROM documents")
def documents_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven near equal parts of the documents by length, then id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").withColumn("_order", F.col("n_chars").cast("decimal(38,0)") * F.lit(10**12).cast("decimal(38,0)") + F.col("doc_id"))
    return study.in_chunks(d, "_order", 7).select("doc_id", "n_chars", F.col("chunk").cast("long").alias("chunk"))


# ---- prior, readings and scores against plain SQL ----

@query("WITH a AS (" + ORACLE_SQL["attack_disemvowel"] + f"""), t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(attacked), '[a-z]+')) AS token FROM a), {_BENCH_WORDS}, u AS (SELECT DISTINCT word FROM w),
i AS (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM t), n AS (SELECT token, i, unnest(range(1, length(token) - i + 2)) AS n FROM i), s AS (SELECT DISTINCT token, substr(token, i, n) AS sub FROM n)
SELECT token, word, CAST(min(levenshtein(word, sub)) AS DOUBLE) AS cost FROM s JOIN u ON abs(length(sub) - length(word)) <= 1 GROUP BY token, word HAVING min(levenshtein(word, sub)) <= 1""")
def semi_global_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark that some part of a disemvowelled token is at most one edit away from; all costs 1."""
    words = restore.words_from(bench_words(spark, sf_dir).select("word"))
    t = _attacked_words(spark, sf_dir, "disemvowel").select(F.explode(F.regexp_extract_all(F.lower("attacked"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    plain = prior.Config(cheap_ins=False, cheap_sub=False, cheap_del=False, swaps=False)
    return prior.within(t, words, 1.0, plain)


@query(f"""WITH RECURSIVE {_TOKENS}, v AS (SELECT item_id, pos, unnest([(length(w) % 3) / 8.0, (length(w) % 5 + 1) / 8.0, (pos % 7 + 2) / 8.0])::DOUBLE AS c FROM tok),
r(item_id, pos, cost) AS (SELECT DISTINCT item_id, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE) FROM tok UNION ALL SELECT item_id, pos, cost FROM (SELECT r.item_id, v.pos, r.cost + v.c AS cost, row_number() OVER (PARTITION BY r.item_id ORDER BY r.cost + v.c) AS k FROM r JOIN v ON v.item_id = r.item_id AND v.pos = r.pos + 1) WHERE k <= 10)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY cost) - 1 AS k, cost FROM r WHERE pos = (SELECT max(pos) FROM tok WHERE tok.item_id = r.item_id)""")
def kbest_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten cheapest readings of each benchmark text, whose words have three made costs each."""
    size = F.length("token")
    costs = F.array(size % 3 / 8, (size % 5 + 1) / 8, (F.col("pos") % 7 + 2) / 8)
    rows = bench_tokens(spark, sf_dir).select("item_id", "pos", F.explode(costs).alias("cost"))
    return prior.best_sums(rows, ["item_id"], "pos", "cost").drop("picks")


@query("WITH RECURSIVE a AS (" + ORACLE_SQL["attack_truncate"] + f"), {_PAIR_TOKENS}," + """
l(item_id, i, c) AS (SELECT item_id, 0, list_transform(range(0, len(r) + 1), lambda x: 0) FROM p UNION ALL
  SELECT l.item_id, i + 1, list_transform(range(1, len(c) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda j: CASE WHEN j > 1 AND r[j - 1] = h[i + 1] THEN c[j - 1] + 1 ELSE c[j] END))) FROM l JOIN p ON p.item_id = l.item_id WHERE i < len(h))
SELECT l.item_id, round(c[len(c)] / len(h)::DOUBLE, 6) AS rouge_l FROM l JOIN p ON p.item_id = l.item_id WHERE i = len(h)""")
def rouge_l_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "benchmark").join(_attacked_words(spark, sf_dir, "truncate"), "item_id")
    return pairs.select("item_id", F.round(metrics.rouge_l_precision(F.split("text", " "), F.split("attacked", " ")), 6).alias("rouge_l"))


@query(f"WITH {_BENCH_WORDS}, u AS (SELECT word, count(*) AS n FROM w GROUP BY word), {stems.stem_sql('u')} SELECT word, stem, n FROM stems_")
def stemmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = bench_words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return u.select("word", stems.stem(F.col("word")).alias("stem"), "n")
