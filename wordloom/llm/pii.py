"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find plain e-mail addresses, ip addresses, card and phone numbers. The field is trained from a
small labelled table (pii_labels) and adds spans that the patterns miss, such as numbers without a country code and addresses with
written-out signs. It is decoded by Viterbi in numpy batches, over the parts of a text near a sign that every entity must have (an
at sign, written out or not, seven digits, or four short numbers with only signs or a written-out dot between them): words farther than 48 characters from one
aren't read.

Defined cases: null and empty texts have no spans; repeated rows and null ids are treated row by row; digits are ASCII; very long
runs are scanned in linear time; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
Span = tuple[int, int, int]  # start, end, kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
_NUMBER = re.compile("[0-9]+")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """At most 255, with any number of zeros before it."""
    bare = digits.lstrip("0")
    return len(bare) < 3 or (len(bare) == 3 and bare <= "255")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and without overlap within a kind, by start and kind."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _DOTTED.finditer(text):
            if "." in m[0]:
                parts = [(n.start(), n.end()) for n in _NUMBER.finditer(text, m.start(), m.end())]
                for i in range(0, len(parts) - 3, 4):
                    if all(_byte(text[a:b]) for a, b in parts[i : i + 4]):
                        out.append((parts[i][0], parts[i + 3][1], 1))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                s = m[0].rstrip(" ().-")
                if 10 <= len(_DIGITS.findall(s)) <= 15:
                    out.append((m.start(), m.start() + len(s), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s\w]|_|[^\W_]")
_SIGN = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|[0-9](?:[\s().\-/\[\]]{0,3}[0-9]){6,}|[0-9]{1,3}(?:(?:\W{1,7}|\W{0,3}dot\W{0,3})[0-9]{1,3}){3}", re.I)
_ADDRESS = re.compile(r"[\w.%+-]+(?:@|\s@\s|\s?[(\[{]\s?at\s?[)\]}]\s?)[\w-]+(?:\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|\bdot\b)\s?[\w-]+)+", re.I)
_NEAR = 48
_LEXICON = {w: i + 1 for i, w in enumerate("at dot com org net tel phone call mobile fax mail email e contact card visa ip host address version page section".split())}
_MARKS = {c: i for i, c in enumerate("@.-_+()[]{}/:=,;\"'#*%&|$<>!?")}
_WINDOW = 3
N_SHAPES, N_WORDS = 48, len(_LEXICON) + 1


def _shape(t: str) -> int:
    c = t[0]
    if "0" <= c <= "9":
        return min(len(t), 8) + (9 if len(t) <= 3 and int(t) > 255 else 0)  # 1 to 8; 12 above a byte
    if c.isalpha():
        return 13 + (0 if t.islower() else 3 if len(t) == 1 or t[1:].islower() else 6) + (0 if len(t) <= 2 else 1 if len(t) == 3 else 2)
    return 22 + _MARKS[c] if c in _MARKS and _MARKS[c] < 25 else 47


@cache
def _attributes(t: str) -> tuple[int, int]:
    return _shape(t), _LEXICON.get(t.lower(), 0)


def encode(text: str, start: int, end: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(shape, word, space before) of the tokens in a part of a text, and their places."""
    rows, places, before = [], [], start
    for m in _TOKEN.finditer(text, start, end):
        t = m[0]
        rows.append((*(_attributes(t) if len(t) < 24 else (_shape(t), 0)), int(m.start() > before)))
        places.append(m.span())
        before = m.end()
    return np.array(rows, np.int16).reshape(-1, 3), places


class Field:
    """Emission tables by offset and attribute, and transitions between labels."""

    def __init__(self, shape: np.ndarray, word: np.ndarray, space: np.ndarray, move: np.ndarray) -> None:
        self.tables, self.move = (shape, word, space), move

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """x: sequences, tokens, attributes; attribute -1 is beyond an end."""
        e = np.zeros((*x.shape[:2], len(LABELS)))
        for o in range(-_WINDOW, _WINDOW + 1):
            near = np.full_like(x, -1)
            if abs(o) < x.shape[1]:
                near[:, max(0, -o) : x.shape[1] - max(0, o)] = x[:, max(0, o) : x.shape[1] + min(0, o)]
            for a, table in enumerate(self.tables):
                e += table[o + _WINDOW][near[..., a]]  # -1 is the last row
        return e

    def decode(self, sequences: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over padded batches of sequences of similar length."""
        out: list = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(sequences[order[to]]) * (to - at + 1) <= 40_000:
                to += 1
            batch = order[at:to]
            x = _padded([sequences[i] for i in batch])
            e = self.emissions(x)
            e[:, 0] += _START
            for i, path in zip(batch, viterbi(e, self.move, [len(sequences[i]) for i in batch]), strict=True):
                out[i] = path
            at = to
        return out


def _padded(sequences: Sequence[np.ndarray]) -> np.ndarray:
    x = np.full((len(sequences), max(map(len, sequences)), 3), -1, np.int16)
    for i, s in enumerate(sequences):
        x[i, : len(s)] = s
    return x


def viterbi(e: np.ndarray, move: np.ndarray, lengths: Sequence[int]) -> list[np.ndarray]:
    n, t, k = e.shape
    back, score, ends = np.zeros((n, t, k), np.int8), e[:, 0].copy(), np.zeros((n, k))
    lengths = np.asarray(lengths)
    ends[lengths == 1] = score[lengths == 1]
    for i in range(1, t):
        step = score[:, :, None] + move
        back[:, i] = step.argmax(axis=1)
        score = step.max(axis=1) + e[:, i]
        ends[lengths == i + 1] = score[lengths == i + 1]
    out = []
    for s in range(n):
        path = np.zeros(lengths[s], np.int8)
        if len(path):
            path[-1] = ends[s].argmax()
            for i in range(len(path) - 1, 0, -1):
                path[i - 1] = back[s, i, path[i]]
        out.append(path)
    return out


#: No sequence starts inside an entity, in training and in decoding.
_START = np.array([-1e4 if label[0] == "I" else 0.0 for label in LABELS])
_BAR = np.array([[0.0 if b[0] != "I" or (a != "O" and a[2:] == b[2:]) else -1e4 for b in LABELS] for a in LABELS])


def train(table: Sequence[tuple[str, Sequence[tuple[str, str]]]], epochs: int = 90, decay: float = 2e-3) -> Field:
    """A field by maximum likelihood (forward-backward over the padded table, Adam) from texts with (kind, substring) labels."""
    xs, ys = [], []
    for text, entities in table:
        x, places = encode(text, 0, len(text))
        y = np.zeros(len(places), int)
        for kind, part in entities:
            a = text.index(part)
            inside = [i for i, (s, e) in enumerate(places) if a <= s and e <= a + len(part)]
            y[inside] = LABELS.index(f"I-{kind}")
            y[inside[0]] = LABELS.index(f"B-{kind}")
        xs.append(x)
        ys.append(y)
    k, x, lengths = len(LABELS), _padded(xs), np.array([len(y) for y in ys])
    n, t = x.shape[:2]
    gold, live = np.zeros((n, t), int), np.arange(t) < lengths[:, None]
    for i, y in enumerate(ys):
        gold[i, : len(y)] = y
    width = 2 * _WINDOW + 1
    params = [np.zeros((width, s + 1, k)) for s in (N_SHAPES, N_WORDS, 2)] + [np.zeros((k, k))]
    moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    places = {}  # attribute (the last row: beyond an end) at each offset of the live tokens
    for o in range(-_WINDOW, _WINDOW + 1):
        near = np.full_like(x, -1)
        near[:, max(0, -o) : t - max(0, o)] = x[:, max(0, o) : t + min(0, o)]
        for a, size in enumerate((N_SHAPES, N_WORDS, 2)):
            places[o + _WINDOW, a] = near[..., a][live] % (size + 1)
    hot = np.eye(k)[gold] * live[..., None]
    pair = np.zeros((k, k))
    np.add.at(pair, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
    for epoch in range(1, epochs + 1):
        e, move = Field(*params[:3], params[3]).emissions(x), np.exp(params[3] + _BAR)
        e = np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta, scale = np.zeros((n, t, k)), np.ones((n, t, k)), np.ones((n, t, 1))
        alpha[:, 0] = e[:, 0] * [label[0] != "I" for label in LABELS]
        alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            a = (alpha[:, i - 1] @ move) * e[:, i]
            scale[:, i] = np.where(live[:, i, None], a.sum(axis=1, keepdims=True), 1)
            alpha[:, i] = np.where(live[:, i, None], a / scale[:, i], alpha[:, i - 1])
        after = np.zeros((n, t, k))
        for i in range(t - 1, 0, -1):
            after[:, i] = e[:, i] * beta[:, i] / scale[:, i] * live[:, i, None]
            beta[:, i - 1] = np.where(live[:, i, None], after[:, i] @ move.T, 1)
        expected = np.einsum("nti,ntj->ij", alpha[:, :-1], after[:, 1:]) * move
        error, grads = ((alpha * beta) * live[..., None] - hot) / n, []
        flat = error[live]
        for a, size in enumerate((N_SHAPES, N_WORDS, 2)):
            g = np.stack([[np.bincount(places[o, a], flat[:, j], size + 1) for j in range(k)] for o in range(width)])
            grads.append(g.transpose(0, 2, 1) + decay * params[a])
        grads.append((expected - pair) / n + decay * params[3])
        for i, g in enumerate(grads):
            moment[i], second[i] = 0.9 * moment[i] + 0.1 * g, 0.99 * second[i] + 0.01 * g * g
            params[i] -= 0.1 * (moment[i] / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-8)
    return Field(*params[:3], params[3] + _BAR)


def _parts(text: str) -> list[tuple[int, int]]:
    """Parts of a text near signs of an entity, up to white space."""
    out: list[tuple[int, int]] = []
    for m in _SIGN.finditer(text):
        a, b = max(0, m.start() - _NEAR), min(len(text), m.end() + _NEAR)
        while a > 0 and a > m.start() - 2 * _NEAR and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b < m.end() + 2 * _NEAR and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _plausible(kind: int, s: str) -> bool:
    digits = "".join(_DIGITS.findall(s))
    if kind == 0:
        return len(s) <= 120 and _ADDRESS.fullmatch(s) is not None and "\n" not in s
    if kind == 1:
        numbers = _NUMBER.findall(s)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and bool(re.search(r"[\s()./-]", s))


def found(texts: Sequence[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans) of each text. Added spans don't overlap those of the patterns or each other."""
    base = [base_spans(t) if t else [] for t in texts]
    where = [(i, *part) for i, t in enumerate(texts) if t for part in _parts(t)]
    coded = [encode(texts[i], a, b) for i, a, b in where]
    paths = field.decode([x for x, _ in coded]) if coded else []
    extra: list[list[Span]] = [[] for _ in texts]
    for (i, _, _), (_, places), path in zip(where, coded, paths, strict=True):
        at = 0
        while at < len(path):
            if not path[at]:
                at += 1
                continue
            kind, to = (path[at] - 1) // 2, at + 1
            while to < len(path) and path[to] == 2 * kind + 2:
                to += 1
            a, b = places[at][0], places[to - 1][1]
            if kind == 0 and (m := _ADDRESS.search(texts[i], a, b)):
                a, b = m.span()  # without words before the address
            taken = [*base[i], *extra[i][-1:]]
            if _plausible(kind, texts[i][a:b]) and not any(s < b and a < e for s, e, _ in taken):
                extra[i].append((a, b, int(kind)))
            at = to
    return [(b, sorted([*b, *x], key=lambda s: (s[0], s[2]))) for b, x in zip(base, extra, strict=True)]


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str | None, spans: Sequence[Span]) -> str | None:
    """The text with every span (overlapping ones as one) in place of which stands its kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts and digest of pattern spans, all spans, and the redacted text, for every row of docs (doc_id, text)."""
    tables = (*field.tables, field.move)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Field(*tables)
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            spans = found(texts, own)
            counts = np.array([[sum(k == j for _, _, k in base) for j in range(4)] for base, _ in spans], np.int64).reshape(-1, 4)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], **{f"n_{k}": counts[:, j] for j, k in enumerate(KINDS)},
                "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in spans],
                "spans": [written(every) for _, every in spans], "redacted": [redact(t, every) for t, (_, every) in zip(texts, spans, strict=True)],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, _RESULT)


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """docs (text, ...) with the spans in text replaced by their kind."""
    tables = (*field.tables, field.move)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*tables)
        for b in batches:
            texts = b.column("text").to_pylist()
            new = [redact(t, every) for t, (_, every) in zip(texts, found(texts, own), strict=True)]
            i = b.schema.get_field_index("text")
            yield b.set_column(i, b.schema.field(i), pa.array(new, b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
