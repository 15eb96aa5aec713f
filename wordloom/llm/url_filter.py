"""URL filters: rules, and gradient-boosted trees on lexical features for urls that no rule fits.

The trees are trained on the driver from a labelled table of urls (a bounded sample if it has more than
SAMPLE rows) and are emitted as Spark expressions, so that judging a table of urls is one narrow stage.

Defined cases: null urls and urls without :// have empty host and path, fit no rule and are judged by their
features; repeated rows are judged alike; extra columns pass through, but for those called host, path, rule, block_margin or verdict, which
the result has anew; an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SAMPLE, ROUNDS, DEPTH, RATE, BINS = 20_000, 40, 3, 0.3, 32

#: Host and path of a rule, verdict. The longest that fits wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.substr(url, F.locate("://", url) + 3)
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A([^?#]*)", 1)
    found = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(found, F.translate(host, upper, lower)).otherwise(""), F.when(found, path).otherwise("")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: len(x[0])):
        h, p = r.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


FEATURES = ("length", "host_length", "depth", "digit_ratio", "hyphens", "host_digits", "labels", "entropy", "parameters", "longest_label", "vowel_ratio", "suffix")


def suffix_of(host: str) -> str:
    return host.rsplit(".", 1)[-1] if "." in host else ""


def lexical(url: str | None, suffixes: dict[str, float], prior: float) -> list[float]:
    """The features of a url in Python, for training: the same as :func:`lexical_columns`."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    n = len(host)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(host).values()) if n else 0.0
    digits = len(re.findall("[0-9]", url))
    return [len(url), n, len(re.findall("/[^/]", path)), digits / len(url) if url else 0.0, host.count("-"), len(re.findall("[0-9]", host)), host.count("."), entropy, len(re.findall(r"[?&][^?&#]*=", url)), max(map(len, host.split("."))), len(re.findall("[aeiou]", host)) / n if n else 0.0, suffixes.get(suffix_of(host), prior)]


def lexical_columns(url: Column, host: Column, path: Column, suffixes: dict[str, float], prior: float) -> list[Column]:
    u, count = F.coalesce(url, F.lit("")), lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    n, size = F.length(host).cast("double"), F.length(u).cast("double")
    distinct = F.array_distinct(F.split(host, ""))
    share = lambda c: (n - F.length(F.replace(host, c, F.lit("")))) / n
    entropy = F.when(n > 0, F.aggregate(distinct, F.lit(0.0), lambda a, c: a - F.when(c == "", F.lit(0.0)).otherwise(share(c) * F.log2(share(c))))).otherwise(0.0)
    label = F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))).cast("double")
    suffix = F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1)).otherwise("")
    stat = F.lit(prior)
    for s, v in sorted(suffixes.items()):
        stat = F.when(suffix == s, F.lit(v)).otherwise(stat)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return [size, n, count(path, "/[^/]"), ratio(count(u, "[0-9]"), size), count(host, "-"), count(host, "[0-9]"), count(host, r"\."), entropy, count(u, r"[?&][^?&#]*="), label, ratio(count(host, "[aeiou]"), n), stat]


class Tree:
    """A split (feature, threshold, left, right), or a leaf (value)."""

    def __init__(self, value: float, feature: int = -1, threshold: float = 0.0, left: Tree | None = None, right: Tree | None = None) -> None:
        self.value, self.feature, self.threshold, self.left, self.right = value, feature, threshold, left, right

    def column(self, f: Sequence[Column]) -> Column:
        if self.left is None:
            return F.lit(self.value)
        return F.when(f[self.feature] <= self.threshold, self.left.column(f)).otherwise(self.right.column(f))

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.threshold, self.left.apply(x), self.right.apply(x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], depth: int) -> Tree:
    leaf = lambda m: float(-RATE * g[m].sum() / (h[m].sum() + 1.0))
    every = np.ones(len(g), bool)
    if not depth or len(g) < 8:
        return Tree(leaf(every))
    best, base = (1e-6, None), g.sum() ** 2 / (h.sum() + 1.0)
    for f, e in enumerate(edges):
        if not len(e):
            continue
        at = np.searchsorted(e, x[:, f], "left")  # value <= e[i] if at <= i
        gs, hs = np.cumsum(np.bincount(at, g, len(e) + 1)), np.cumsum(np.bincount(at, h, len(e) + 1))
        gain = gs[:-1] ** 2 / (hs[:-1] + 1.0) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1.0) - base
        gain[(hs[:-1] < 0.5) | (hs[-1] - hs[:-1] < 0.5)] = 0
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-12:
            best = (gain[i], (f, float(e[i])))
    if best[1] is None:
        return Tree(leaf(every))
    f, t = best[1]
    m = x[:, f] <= t
    return Tree(0.0, f, t, _grow(x[m], g[m], h[m], edges, depth - 1), _grow(x[~m], g[~m], h[~m], edges, depth - 1))


class Model:
    def __init__(self, base: float, trees: list[Tree], suffixes: dict[str, float], prior: float) -> None:
        self.base, self.trees, self.suffixes, self.prior = base, trees, suffixes, prior

    def margin(self, url: Column, host: Column, path: Column) -> Column:
        f = lexical_columns(url, host, path, self.suffixes, self.prior)
        total = F.lit(self.base)
        for t in self.trees:
            total = total + t.column(f)
        return total

    def margins(self, urls: Sequence[str | None]) -> np.ndarray:
        x = np.array([lexical(u, self.suffixes, self.prior) for u in urls], float).reshape(len(urls), len(FEATURES))
        return self.base + sum((t.apply(x) for t in self.trees), np.zeros(len(urls)))


def train(labelled: Sequence[tuple[str, int]], rounds: int = ROUNDS, depth: int = DEPTH) -> Model:
    """Trees for labelled urls (url, 1 for block); at most SAMPLE of them, evenly spaced, are used."""
    labelled = labelled[:: -(-len(labelled) // SAMPLE)] if len(labelled) > SAMPLE else labelled
    y = np.array([v for _, v in labelled], float)
    prior = float(y.mean()) if len(y) else 0.0
    hosts = [suffix_of(re.match(r"[^/?#]*", u.split("://", 1)[-1])[0].lower()) for u, _ in labelled]
    seen, bad = Counter(hosts), Counter(h for h, v in zip(hosts, y, strict=True) if v)
    suffixes = {h: (bad[h] + 10 * prior) / (c + 10) for h, c in seen.most_common(200)}
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    x = np.array([lexical(u, suffixes, prior) for u, _ in labelled], float).reshape(len(y), len(FEATURES))
    edges = []
    for c in x.T:
        v = np.unique(c)
        mid = (v[:-1] + v[1:]) / 2
        edges.append(mid if len(mid) <= BINS else np.unique(np.quantile(mid, np.linspace(0, 1, BINS))))
    z, trees = np.full(len(y), base), []
    for _ in range(rounds if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-z))
        trees.append(_grow(x, p - y, p * (1 - p), edges, depth))
        z += trees[-1].apply(x)
    return Model(base, trees, suffixes, prior)


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages (url, ...) with host, path, rule, block_margin and verdict."""
    host, path = host_path(F.col("url"))
    df = pages.drop("host", "path", "rule", "block_margin", "verdict").withColumns({"host": host, "path": path})
    given = fresh("_given", df.columns)
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumn("block_margin", model.margin(F.col("url"), F.col("host"), F.col("path"))).withColumns({"rule": rule, given: verdict})
    return df.withColumn("verdict", F.coalesce(given, F.when(F.col("block_margin") > 0, F.lit("block")).otherwise(F.lit("allow")))).drop(given)


def judge_sql(model: Model, table: str, key: str, rules: Sequence[tuple[str, str]] = RULES) -> str:
    """The same as :func:`judge` in DuckDB's SQL, with the trees as CASE expressions: key, host, path, rule, verdict."""
    count = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
    suffix = "CASE " + " ".join(f"WHEN x = '{s}' THEN {v!r}::DOUBLE" for s, v in sorted(model.suffixes.items())) + f" ELSE {model.prior!r}::DOUBLE END"
    features = {
        "length": "length(u)::DOUBLE", "host_length": "length(host)::DOUBLE", "depth": f"{count('path', '/[^/]')}::DOUBLE",
        "digit_ratio": f"CASE WHEN u <> '' THEN {count('u', '[0-9]')}::DOUBLE / length(u) ELSE 0 END", "hyphens": f"{count('host', '-')}::DOUBLE",
        "host_digits": f"{count('host', '[0-9]')}::DOUBLE", "labels": f"{count('host', '[.]')}::DOUBLE",
        "entropy": "CASE WHEN host = '' THEN 0 ELSE list_sum(list_transform(list_distinct(string_split(host, '')), lambda c: -((length(host) - length(replace(host, c, '')))::DOUBLE / length(host)) * log2((length(host) - length(replace(host, c, '')))::DOUBLE / length(host)))) END",
        "parameters": f"{count('u', '[?&][^?&#]*=')}::DOUBLE", "longest_label": "list_max(list_transform(string_split(host, '.'), lambda x: length(x)))::DOUBLE",
        "vowel_ratio": f"CASE WHEN host <> '' THEN {count('host', '[aeiou]')}::DOUBLE / length(host) ELSE 0 END", "suffix": suffix,
    }

    def tree(t: Tree) -> str:
        return repr(t.value) + "::DOUBLE" if t.left is None else f"CASE WHEN f_{FEATURES[t.feature]} <= {t.threshold!r}::DOUBLE THEN {tree(t.left)} ELSE {tree(t.right)} END"

    fits = lambda r: "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    longest = sorted(rules, key=lambda x: -len(x[0]))
    choice = lambda i: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{(r, v)[i]}'" for r, v in longest) + " END"
    return f"""WITH a AS (SELECT {key}, coalesce(url, '') AS u, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM {table}),
b AS (SELECT *, coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '') AS raw FROM a),
c AS (SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1), '') AS path FROM b),
d AS (SELECT *, CASE WHEN contains(host, '.') THEN string_split(host, '.')[-1] ELSE '' END AS x FROM c),
f AS (SELECT *, {", ".join(f"{sql} AS f_{name}" for name, sql in features.items())} FROM d)
SELECT {key}, host, path, {choice(0)} AS rule, coalesce({choice(1)}, CASE WHEN {model.base!r}::DOUBLE + {" + ".join(map(tree, model.trees)) or "0"} > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM f"""
