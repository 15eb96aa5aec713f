"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows of the capacity, and a remainder. Remainders are dealt at random
(by a hash) into groups of bounded size; in each group differencing merges partial partitions with opposing
imbalances into near-equal windows. The window count starts at the least possible and rises while the
fullest window exceeds the capacity; beyond SLACK of waste, what stands above the capacity is cut off and fills the room of other windows.

Defined cases: null and empty texts give one piece that holds the end id only; rows with repeated or null
doc_id are documents of their own; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID = 2048, 1
#: Documents to a group of remainders, and the share of windows by which the count may rise before items are cut.
GROUP_DOCS, SLACK = 384, 0.008
#: Entries of the memos (about 200 bytes each, in every Python worker); texts with more distinct words are only slower.
_WORD_MEMO, _CHUNK_MEMO = 200_000, 250_000
PIECES = "doc string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_COLUMNS = [c.split(" ")[0] for c in PIECES.split(", ")]


class _Word(dict):
    """Packed ids of a lower-cased run that the tokenizer treats as one word, by its model alone."""

    def __init__(self, model) -> None:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}  # byte-level alphabet
        self.split = model.tokenize

    def __missing__(self, word: str) -> bytes:
        form = word if word.isascii() else word.encode().decode("latin-1").translate(self.bytes)
        v = array("H", [t.id for t in self.split(form)]).tobytes()
        if len(self) < _WORD_MEMO:
            self[word] = v
        return v


class _Chunk(dict):
    """Packed ids of a chunk between spaces; the tokenizer never joins text across them.

    ASCII words, also before one mark, are looked up at once; other chunks of ASCII and Latin-1 letters are taken apart here, the
    rest is left to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.word, self.encode = _Word(tokenizer.model), tokenizer.encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            v = b""
        elif chunk.isascii() and chunk[:-1].isalpha() and (chunk[-1] in _MARKS or chunk[-1].isalpha()):
            word = chunk.lower()
            v = self.word[word] if word[-1] not in _MARKS else self.word[word[:-1]] + self.word[word[-1]]
        elif _SIMPLE(chunk):
            v = b"".join(map(self.word.__getitem__, _RUNS(chunk.lower())))
        else:
            v = array("H", self.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(self) < _CHUNK_MEMO and len(chunk) < 200:
            self[chunk] = v
        return v


_MARKS = frozenset(",.;:!?")
_SIMPLE = re.compile("[!-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+").findall
END = array("H", [END_ID]).tobytes()


@cache
def chunk_ids(path: str) -> _Chunk:
    """One memo for all tasks of a Python worker."""
    return _Chunk(path)


def encode(text: str | None, memo: dict) -> bytes:
    """Ids of a text as unsigned 16-bit integers (the vocabulary has fewer than 65,536), with the end id."""
    if not text:
        return END
    for c in "\n\t\r":
        text = text.replace(c, " ")
    return b"".join(map(memo.__getitem__, text.split(" "))) + END


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp into k sets: the items of each. Merges the two partitions of largest spread, largest sums against smallest, until one is left."""
    if not sizes:
        return [[] for _ in range(k)]
    heap = [(-s, i, [(s, (i, None, None))]) for i, s in enumerate(sizes)]  # (-spread, tie, sums above zero in rising order)
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        meet = len(a) + len(b) - k
        if meet <= 0:
            merged = sorted(a + b, key=_sum)
        else:
            # a ascends and b descends: the least of a meet the greatest of b, after those that meet only zeros
            top = b[::-1]
            alone, facing = top[: len(b) - meet], top[len(b) - meet :]
            merged = alone + [(x[0] + y[0], (None, x[1], y[1])) for x, y in zip(a, facing, strict=False)] + a[meet:]
            merged.sort(key=_sum)
        if len(merged) == k and merged[0][0]:
            low = merged[0][0]
            merged = [(s - low, t) for s, t in merged]
        spread = merged[-1][0] - (merged[0][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    sets = [_items(t) for _, t in heap[0][2]]
    return sets + [[] for _ in range(k - len(sets))]


def _sum(x: tuple) -> int:
    return x[0]


def _items(t: tuple) -> list[int]:
    out, stack = [], [t]
    while stack:
        i, left, right = stack.pop()
        if i is not None:
            out.append(i)
        else:
            stack += [left, right]
    return out


def _repaired(sizes: list[int], sets: list[list[int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length): what stands above the capacity of a window is cut off and fills the rooms of others, in order."""
    windows, tails, room = [], [], []
    for w, s in enumerate(sets):
        over, own = sum(sizes[i] for i in s) - capacity, [(i, 0, sizes[i]) for i in s]
        if over < 0:
            room.append((w, -over))
        while over > 0:  # the longest item gives way, so that few items are cut
            i, a, n = max(own, key=lambda x: x[2])
            own.remove((i, a, n))
            cut = min(n, over)
            tails.append((i, a + n - cut, cut))
            if n > cut:
                own.append((i, a, n - cut))
            over -= cut
        windows.append(own)
    for w, free in room:
        while free and tails:
            i, a, n = tails.pop()
            m = min(n, free)
            windows[w].append((i, a, m))
            free -= m
            if n > m:
                tails.append((i, a + m, n - m))
    return windows


def fill(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length), none above the capacity.

    Differencing into the least possible number of windows; while one exceeds the capacity the number rises, by SLACK (one at
    least) at most. What still exceeds it then is cut off and moved to windows with room.
    """
    least = -(-sum(lengths) // capacity)
    most = least + max(1, math.floor(least * SLACK))
    for k in range(least, most + 1):
        sets = difference(lengths, k)
        if all(sum(lengths[i] for i in s) <= capacity for s in sets):
            break
    return [sorted(w) for w in _repaired(lengths, sets, capacity) if w]


def _tokenizer(path: str, capacity: int, groups: int):
    """Pieces of the documents, dealt to groups; full windows have their sequence, the remainders not yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, task, count, row, width = chunk_ids(path), TaskContext.get().partitionId(), 0, 0, 2 * capacity
        for b in batches:
            out = []
            for doc, text in zip(b["doc"], b["text"], strict=True):
                row += 1
                ids = encode(text if isinstance(text, str) else None, memo)
                n = len(ids) // 2
                for at in range(0, len(ids), width):
                    piece, full = ids[at : at + width], at + width <= len(ids)
                    out.append((doc, at // 2, len(piece) // 2, piece, n, (1 << 62) + (task << 36) + count if full else -1, zlib.crc32(f"{doc} {task} {row} {at}".encode()) % groups))
                    count += full
            frame = pd.DataFrame(out, columns=["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "deal"])
            yield frame

    return run


def _packer(capacity: int):
    def pack(g: pd.DataFrame) -> pd.DataFrame:
        done = g["sequence_id"] >= 0
        full, g = g[done].assign(offset=0), g[~done].sort_values(["doc", "start", "ids"])
        doc, start, ids, n = (g[c].tolist() for c in ("doc", "start", "ids", "doc_tokens"))
        out, first = [tuple(x) for x in full[_COLUMNS].itertuples(index=False)], (int(g["deal"].iloc[0]) << 24) if len(g) else 0
        for w, window in enumerate(fill(g["length"].tolist(), capacity)):
            at = 0
            for i, a, m in window:
                out.append((doc[i], start[i] + a, m, ids[i][2 * a : 2 * (a + m)], n[i], first + w, at))
                at += m
        frame = pd.DataFrame(out, columns=_COLUMNS)
        frame["ids"] = [np.frombuffer(x, np.uint16).astype("<u4").tobytes() for x in frame["ids"]]
        return frame

    return pack


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all docs (doc_id, text): doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    One pass encodes, one shuffle of 16-bit ids deals pieces out at random. A sequence_id is the task's
    number and a count for full windows, the group's number and a count for the others.
    """
    docs = docs.select(F.col("doc_id").cast("string").alias("doc"), "text")  # text, so that null ids don't turn into floats
    groups = max(1, -(-docs.count() // group_docs))
    pieces = docs.mapInPandas(_tokenizer(tokenizer, capacity, groups), "doc string, start long, length long, ids binary, doc_tokens long, sequence_id long, deal long")
    packed = pieces.groupBy("deal").applyInPandas(_packer(capacity), PIECES)
    return packed.select(F.col("doc").cast("long").alias("doc_id"), *_COLUMNS[1:])
