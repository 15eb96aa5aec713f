"""Near duplicates by MinHash: banded universal hash minima, exact verification, connected components.

Method. A document's set holds its distinct k-word shingles (ASCII-lower-cased; k is 5 by default). HASHES = BANDS * ROWS
universal hash minima are banded; two sets of similarity 0.8 share no band with probability
(1 - 0.8**6)**40 < 6e-6. Documents of equal words form one class, which takes part once. In each bucket of
a band every class is checked against the bucket's least member only; verified links are closed to
components. Pairs of one bucket whose components still differ are then all checked: in small buckets as
pairs, in large ones as blocks of sets that are compared inside a task. So no bucket is capped and
no pair list of a large group is ever made.

Defined cases: null or wordless texts have an empty set and link with nothing; fewer than k words give one
shingle; rows with the same doc_id count as one document (if their texts differ they are linked, whatever their words, and share a
component); a null doc_id stays, and is kept unless an equal text has an id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, counted, cut, forget, words_of
from .linkage import linked_components

BANDS, ROWS, THRESHOLD = 40, 6, 80
_MEMO = 250_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > _MEMO:  # only a memo: emptied when large
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(29))


def shingles(words: list[str], k: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = _mix(acc * _K1 + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return (r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None], r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)[:, None]


def minima(s: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Least value of each hash a*x + b mod 2**32 over the set."""
    x = (s >> np.uint64(32)).astype(np.uint32)[None, :]
    step = max(1, 120_000 // len(s))
    out = np.empty(len(mult), np.uint32)
    for i in range(0, len(mult), step):
        v = mult[i : i + step] * x
        v += add[i : i + step]
        out[i : i + step] = v.min(axis=1)
    return out


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(1, bands + 1, dtype=np.uint64) * _K2
    for col in m.reshape(bands, rows).astype(np.uint64).T:
        acc = _mix(acc * _K1 + col)
    return acc.view(np.int64)


def _signer(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, (mult, add) = _WordHashes(), _family(bands * rows)
        for b in batches:
            hashes, sizes, keys = [], [], []
            for text in b["text"]:
                w = words_of(ascii_lower(text)) if isinstance(text, str) else []
                s = shingles(w, k, memo)
                sizes.append(len(s))
                hashes.append(hashlib.md5(" ".join(w).encode("utf-8", "surrogatepass")).digest() if w else None)
                keys.append(band_keys(minima(s, mult, add), bands, rows) if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "word_hash": hashes, "n_shingles": sizes, "bands": keys})

    return sign


def _setter(k: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _WordHashes()
        for b in batches:
            s = [shingles(words_of(ascii_lower(t)), k, memo) for t in b["text"]]
            yield pd.DataFrame({"id": b["doc_id"], "n": [len(x) for x in s], "members": [x.tobytes() for x in s]})

    return sets


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    a, b = len(x), len(y)
    if 100 * min(a, b) < threshold * max(a, b):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (a + b - common)


def _checker(threshold: int):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.loc[ok, ["a", "b"]]

    return check


def _block(threshold: int):
    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        """Links between different components: of one part, or from the one part to the other. One for each document and component."""
        cell = cell.sort_values("id")
        ids, comp, part = (cell[c].to_numpy() for c in ("id", "component", "part"))
        sets = [np.frombuffer(x, np.uint64) for x in cell["members"]]
        size = np.array([len(s) for s in sets])
        vocabulary, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(where, kind="stable")
        posted, starts = owner[order], np.searchsorted(where[order], np.arange(len(vocabulary) + 1))
        offset = np.concatenate(([0], np.cumsum(size)))
        values, counts = np.unique(comp, return_counts=True)
        main = values[np.argmax(counts)]
        out = []
        for i in np.flatnonzero(comp != main):  # every pair of two components has a side outside the most frequent one
            terms = where[offset[i] : offset[i + 1]]
            lengths = starts[terms + 1] - starts[terms]
            at = np.repeat(starts[terms] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
            common = np.bincount(posted[at], minlength=len(sets))
            ok = (100 * common >= threshold * (size + size[i] - common)) & (comp != comp[i])
            found = np.flatnonzero(ok)
            if len(found):
                _, first = np.unique(comp[found], return_index=True)
                out += [(ids[i], ids[j]) for j in found[first]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return compare


def near_duplicates(docs: DataFrame, k: int = 5, bands: int = BANDS, rows: int = ROWS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept (it is the least), one row for each of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(docs.mapInPandas(_signer(k, bands, rows), "doc_id long, word_hash binary, n_shingles long, bands array<long>"))
    classes = cut(signed.filter("n_shingles > 0").groupBy("word_hash").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    buckets = classes.filter("id is not null").select("id", F.explode("bands").alias("key"))

    def sets(ids: DataFrame) -> DataFrame:
        own = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").filter("text is not null")
        return own.mapInPandas(_setter(k), "id long, n long, members binary")

    named = signed.filter("doc_id is not null and word_hash is not null")
    several, n = counted(named.groupBy("doc_id").agg(F.min("word_hash").alias("lo"), F.max("word_hash").alias("hi")).filter("lo != hi").select("doc_id"))
    known = None
    if n:  # texts of one document: their classes belong together
        known = named.join(several, "doc_id", "left_semi").join(classes, "word_hash").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    whole = linked_components(buckets, sets, _checker(threshold), _block(threshold), known)
    named = classes.select("word_hash", "id").join(whole, "id", "left").select("word_hash", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "word_hash", "n_shingles").join(named, "word_hash", "left")
    component = F.coalesce("component_id", "doc_id")
    done = cut(out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))
    forget(signed, classes, several, whole)
    return done
