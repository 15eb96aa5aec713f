"""Copies of images by local descriptors, also where they are cropped or edited.

Corners (Harris) of a grey image are found at several scales; a patch around each is turned by its intensity
centroid and sampled by pairs of points, whose comparisons make a binary descriptor. Every pair of images is compared: descriptors
within MAX_DISTANCE that are nearest both ways are matched, and a similarity transform (shift, turn, scale) on which enough matches agree
makes a link. Links close to components. Images with equal pixels form one class, which takes part once. Classes are compared in blocks
of two parts of the table; a block gives what its links connect and their number for each class, no list of pairs.

Pairs are compared on the JVM (:mod:`.jvm`). In sessions without one of their own, distances of all descriptors are exact products of
matrices, and transforms of the pairs with enough matches are tried together. In both ways, what rounding could decide is left to `agree`,
which is the rule. So no link is lost, and work grows with the square of the table.

Defined cases: null, empty or too small images and those with fewer than MIN_AGREE corners have no descriptors and
link with exact copies only (null ones with nothing); repeated ids are linked; a null id stays alone; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jvm
from .common import cut
from .components import components

SCALES, CORNERS, BITS, PATCH, TURNS = (1.0, 0.75, 0.5), 40, 256, 7, 32
#: Images of up to 2 KB of descriptors to a block side at most, and parts into which also small tables are dealt.
BLOCK_ROWS, LEAST_PARTS = 4096, 4
#: Images of a side, pairs of descriptors that are compared at once, pairs of images whose matches wait for each other and are tried together.
SIDE, PRODUCT, WAITING, COLUMNS = 64, 1 << 19, 1 << 14, 2048
#: What makes a link: distance of matches, their number, its share of the corners, pixels of error.
MAX_DISTANCE, MIN_AGREE, SHARE, TOLERANCE = 56, 9, 0.45, 3.0
_RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("s", "<f4"), ("d", "u1", BITS // 8)])


def _pattern() -> np.ndarray:
    """Sampling points (turn, bit, end, xy), fixed."""
    p = np.clip(np.random.default_rng(5).normal(0, PATCH / 2.2, (BITS, 2, 2)), -PATCH + 1, PATCH - 1)
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    return np.stack((c * p[None, ..., 0] - s * p[None, ..., 1], s * p[None, ..., 0] + c * p[None, ..., 1]), -1).round().astype(int)


_POINTS = _pattern()
_YY, _XX = (g * ((a := np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1])[0] ** 2 + a[1] ** 2 <= PATCH**2) for g in np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1])


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear."""
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((h, img.shape[0]), (w, img.shape[1])))
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    top, low = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx, img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def _box(a: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(a, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    k = 2 * r + 1
    return (p[k:, k:] - p[:-k, k:] - p[k:, :-k] + p[:-k, :-k]) / (k * k)


def descriptors(img: np.ndarray) -> np.ndarray:
    """Records of the image's strongest corners over all scales."""
    found = []
    for scale in SCALES:
        h, w = round(img.shape[0] * scale), round(img.shape[1] * scale)
        if min(h, w) < 2 * PATCH + 4:
            break
        a = _box(resize(img.astype(float), h, w) if scale != 1 else img.astype(float), 1)
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = r[PATCH + 1 : -PATCH - 1, PATCH + 1 : -PATCH - 1]
        around = np.stack([r[PATCH + 1 + i : h - PATCH - 1 + i, PATCH + 1 + j : w - PATCH - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)]).max(0)
        y, x = np.nonzero((inner >= around) & (inner > 1e-6))
        found += [(inner[i, j], i + PATCH + 1, j + PATCH + 1, scale, a) for i, j in zip(y, x, strict=True)]
    found.sort(key=lambda f: (-f[0], f[3], f[1], f[2]))
    out = np.zeros(min(CORNERS, len(found)), _RECORD)
    for k, (_, i, j, scale, a) in enumerate(found[:CORNERS]):
        patch = a[i - PATCH : i + PATCH + 1, j - PATCH : j + PATCH + 1]
        turn = int(round(np.arctan2((patch * _YY).sum(), (patch * _XX).sum()) / (2 * np.pi) * TURNS)) % TURNS
        p = np.clip(_POINTS[turn], -PATCH, PATCH)
        v = patch[p[..., 1] + PATCH, p[..., 0] + PATCH]
        out[k] = ((j + 0.5) / scale, (i + 0.5) / scale, 1 / scale, np.packbits(v[:, 0] < v[:, 1]))
    return out


def _words(records: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(records["d"]).view(np.uint64)


def agree(a: np.ndarray, b: np.ndarray, least: float = MIN_AGREE) -> int:
    """How many matches agree on one similarity transform; 0 if there are less than least matches."""
    if min(len(a), len(b)) < MIN_AGREE:
        return 0
    d = np.bitwise_count(_words(a)[:, None] ^ _words(b)[None]).sum(-1, dtype=np.int32)
    near = d.argmin(1)
    i = np.flatnonzero((d.argmin(0)[near] == np.arange(len(a))) & (d[np.arange(len(a)), near] <= MAX_DISTANCE))
    if len(i) < least:
        return 0
    z, w = (r["x"][k].astype(float) + 1j * r["y"][k] for r, k in ((a, i), (b, near[i])))
    p, q = np.triu_indices(len(i), 1)
    far = np.abs(z[p] - z[q]) > 6
    p, q = p[far], q[far]
    if not len(p):
        return 0
    m = (w[p] - w[q]) / (z[p] - z[q])
    ok = (np.abs(m) > 0.4) & (np.abs(m) < 2.5)
    m, p = m[ok], p[ok]
    if not len(m):
        return 0
    error = np.abs(m[:, None] * (z[None] - z[p][:, None]) + w[p][:, None] - w[None])
    return int((error <= TOLERANCE).sum(1).max())


def _linked(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, _RECORD), np.frombuffer(y, _RECORD)
    least = max(MIN_AGREE, SHARE * min(len(a), len(b)))
    return agree(a, b, least) >= least


def _side(records: list[np.ndarray], which: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Images (their numbers, left and right factors of distances, weights, places and numbers of corners) of n corners at most.

    A product of a left and a right factor has the common bits of two descriptors in its second byte, exactly, as all sums
    are integers below 2 ** 24. Missing corners are far from all.
    """
    bits, place = np.zeros((n, len(which), BITS), np.float32), np.zeros((2, n, len(which)), np.float32)
    weight = np.full((n, len(which)), 200, np.int32)
    for k, i in enumerate(which.tolist()):
        r = records[i]
        bits[: len(r), k] = np.unpackbits(r["d"], axis=1)
        weight[: len(r), k] = bits[: len(r), k].sum(-1)
        place[:, : len(r), k] = r["x"], r["y"]
    x, y = bits[..., : BITS // 2], bits[..., BITS // 2 :]
    return which, x + 256 * y, y + 256 * x, weight, place, np.array([len(records[i]) for i in which])


def _sides(records: list[np.ndarray], which: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Sides of images with about as many corners."""
    padded = np.array([-(-len(records[i]) // 4) * 4 for i in which])
    groups = [(n, which[padded == n]) for n in np.unique(padded).tolist()]
    return [_side(records, own[at : at + SIDE], n) for n, own in groups for at in range(0, len(own), SIDE)]


def _matched(a: tuple, b: tuple, part: slice) -> tuple[np.ndarray, ...]:
    """Image pairs (x, y) of a part of a side and another that have enough matches, their numbers and least numbers, and places of all their matches, pair by pair."""
    (left, p, _, weight, z, size), (right, _, q, heavy, w, other) = a, b
    left, p, weight, z, size = left[part], p[:, part], weight[:, part], z[:, :, part], size[part]
    n, m = len(weight), len(heavy)
    # 4096 * distance + 64 * left corner + right corner, modulo 512 * 4096
    near = (p.reshape(n * len(left), -1) @ q.reshape(m * len(right), -1).T).astype(np.int32)
    near <<= 5
    near &= -8192
    np.subtract((4096 * weight + 64 * np.arange(n, dtype=np.int32)[:, None]).reshape(-1, 1), near, out=near)
    near += (4096 * heavy + np.arange(m, dtype=np.int32)[:, None]).reshape(-1)
    near &= 512 * 4096 - 1
    near = near.reshape(n, len(left), m, len(right))
    back, near = near.min(0), near.min(2)
    j = near & 63
    g, h = np.arange(len(left), dtype=np.int32)[:, None], np.arange(len(right), dtype=np.int32)
    match = (back.ravel().take((g * m + j) * len(right) + h) == near) & (near < 4096 * (MAX_DISTANCE + 1))
    count, least = match.sum(0, dtype=np.int32), np.maximum(MIN_AGREE, SHARE * np.minimum(size[:, None], other))
    g, h = np.nonzero(count >= least)
    of, i = np.nonzero(match[:, g, h].T)
    return left[g], right[h], count[g, h], least[g, h], z[:, i, g[of]], w[:, j[i, g[of], h[of]], h[of]]


def _agreeing(z: np.ndarray, w: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For columns of matches (xy, match, column), as many in each: whether least of them agree on a transform as in :func:`agree`, and whether that is too close to tell here."""
    linked, close = np.zeros(len(least), bool), np.zeros(len(least), bool)
    left, e = np.arange(len(least)), 1e-3 + 1e-5 * max(np.abs(z).max(initial=0), np.abs(w).max(initial=0))
    for p in range(z.shape[1]):
        (x, y), (u, v) = z - z[:, p : p + 1], w - w[:, p : p + 1]
        settled = np.zeros(len(left), bool)
        for q in range(p + 1, z.shape[1]):
            far = x[q] ** 2 + y[q] ** 2
            by = 1 / np.where(far > (6 - e) ** 2, far, np.inf)  # no turn and no scale where the matches are too near each other
            c, s = (u[q] * x[q] + v[q] * y[q]) * by, (v[q] * x[q] - u[q] * y[q]) * by
            scale = c**2 + s**2
            error = (c * x - s * y - u) ** 2 + (s * x + c * y - v) ** 2
            fit = ((error <= (TOLERANCE + e) ** 2).sum(0, dtype=np.int32) >= least) & (scale > (0.4 - e) ** 2) & (scale < (2.5 + e) ** 2) & ~settled
            t = np.flatnonzero(fit)
            if len(t):
                sure = ((error[:, t] <= (TOLERANCE - e) ** 2).sum(0) >= least[t]) & (far[t] > (6 + e) ** 2) & (scale[t] > (0.4 + e) ** 2) & (scale[t] < (2.5 - e) ** 2)
                settled[t[sure]] = linked[left[t[sure]]] = True
                close[left[t]] = True
                if settled.all():
                    break
        if settled.any():
            z, w, least, left = z[..., ~settled], w[..., ~settled], least[~settled], left[~settled]
            if not len(left):
                break
    return linked, close & ~linked


def _pairs(cell: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a cell (sorted by id and members; of two parts: one of each) that are linked, some at a time."""
    part, data = cell["part"].to_numpy(), cell["members"].tolist()
    between = part.min() != part.max()  # each part has a cell of its own besides
    records = [np.frombuffer(x, _RECORD) for x in data]
    able = np.flatnonzero([len(r) >= MIN_AGREE for r in records])
    lefts = _sides(records, able[part[able] == part.min()])
    rights = _sides(records, able[part[able] != part.min()]) if between else lefts
    waiting, held = {}, 0

    def settle() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for chunks in waiting.values():
            x, y, least, z, w = (np.concatenate(c, axis=-1) for c in zip(*chunks, strict=True))
            for at in range(0, len(x), COLUMNS):
                i, j = x[at : at + COLUMNS], y[at : at + COLUMNS]
                linked, close = _agreeing(z[..., at : at + COLUMNS], w[..., at : at + COLUMNS], least[at : at + COLUMNS])
                linked[close] = [_linked(data[k], data[o]) for k, o in zip(i[close].tolist(), j[close].tolist(), strict=True)]
                yield i[linked], j[linked]
        waiting.clear()

    for k, a in enumerate(lefts):
        for b in rights if between else rights[k:]:
            step = max(1, PRODUCT // (a[3].shape[0] * b[3].size))
            for at in range(0, len(a[0]), step):
                x, y, count, least, z, w = _matched(a, b, slice(at, at + step))
                start = np.cumsum(count) - count
                for n in np.unique(count).tolist():
                    own = np.flatnonzero((count == n) & ((x < y) | (a is not b)))
                    match, up = start[own] + np.arange(n)[:, None], x[own] < y[own]  # the transform leads from the row that comes first
                    u, v = z[:, match], w[:, match]
                    waiting.setdefault(n, []).append((np.minimum(x[own], y[own]), np.maximum(x[own], y[own]), least[own], np.where(up, u, v), np.where(up, v, u)))
                    held += len(own)
            if held >= WAITING:
                yield from settle()
                held = 0
    yield from settle()


def _ordered(cell: pd.DataFrame) -> pd.DataFrame:
    return cell.sort_values(["id", "members"], kind="stable", ignore_index=True)


def _block(cell: pd.DataFrame) -> pd.DataFrame:
    """All links of a cell."""
    cell = _ordered(cell)
    ids = cell["id"].to_numpy()
    a, b = (np.concatenate([np.empty(0, int), *x]) for x in (list(zip(*_pairs(cell), strict=True)) or [(), ()]))
    return pd.DataFrame({"a": ids[a], "b": ids[b]})


def _summary(cell: pd.DataFrame) -> pd.DataFrame:
    """What the links of a cell connect (a, b: least of what is connected there), and the number of links (by rows) of each class."""
    cell = _ordered(cell)
    ids, rows = cell["id"].to_numpy(), cell["rows"].to_numpy()
    links, least = np.zeros(len(ids), int), np.arange(len(ids))
    for a, b in _pairs(cell):
        np.add.at(links, a, rows[b])
        np.add.at(links, b, rows[a])
        while (apart := least[a] != least[b]).any():
            a, b = a[apart], b[apart]
            np.minimum.at(least, np.maximum(least[a], least[b]), np.minimum(least[a], least[b]))
            while (least != least[least]).any():
                least = least[least]
    of = np.flatnonzero(links)
    return pd.DataFrame({"a": ids[of], "b": ids[least[of]], "pixel_hash": cell["pixel_hash"].to_numpy()[of], "links": links[of]})


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of links as they are; pairs (x, y) that rounding could decide only if the rule links them."""
    for b in batches:
        yield b[[x is None or _linked(x, y) for x, y in zip(b["x"], b["y"], strict=True)]].drop(columns=["x", "y"])


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, p, h, w in zip(b["id"], b["pixels"], b["height"], b["width"], strict=True):
            whole = isinstance(p, bytes | bytearray | memoryview) and len(p) > 0 and len(p) == h * w
            r = descriptors(np.frombuffer(bytes(p), np.uint8).reshape(int(h), int(w))) if whole else np.empty(0, _RECORD)
            out.append((i, hashlib.md5(f"{h}x{w}:".encode() + bytes(p)).digest() if whole else None, len(r), r.tobytes()))
        yield pd.DataFrame(out, columns=["id", "pixel_hash", "n", "members"])


def _links(classes: DataFrame) -> DataFrame:
    """What links by blocks of two parts of the classes (id, pixel_hash, rows, members) connect, and their number."""
    n = classes.count()
    parts = max(1, -(-n // BLOCK_ROWS), min(LEAST_PARTS, n // 256))
    cells = classes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cells = cells.select(F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "part", "pixel_hash", "rows", "members")
    tasks = min(2 * parts * (parts + 1), 16 * cells.sparkSession.sparkContext.defaultParallelism)
    cells = cells.repartition(max(1, tasks), "i", "j")  # by number, as cells of few bytes and much work mustn't be coalesced
    compare = jvm.image_pairs(cells.sparkSession, record=_RECORD.itemsize, most=MAX_DISTANCE, least=MIN_AGREE, share=SHARE, tolerance=TOLERANCE)
    if not compare:
        return cells.groupBy("i", "j").applyInPandas(_summary, "a long, b long, pixel_hash binary, links long")
    whole = cells.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("id", "members", "pixel_hash", "rows", "part"))).alias("cell"))
    found = whole.select(F.explode_outer(F.call_udf(compare, "cell")).alias("l")).select("l.*").filter("a is not null")
    return found.mapInPandas(_settled, "a long, b long, pixel_hash binary, links long")


def image_copies(images: DataFrame) -> DataFrame:
    """id, n_corners, component_id (least id reachable), n_links (other rows it is linked with, those of equal pixels among them), for each row of images (id, height, width, pixels: grey bytes by rows)."""
    rows = images.select(F.col("id").cast("long").alias("id"), "pixels", "height", "width")
    described = cut(rows.mapInPandas(_describe, "id long, pixel_hash binary, n long, members binary"))
    known = described.withColumn("pixel_hash", F.when(F.col("id").isNotNull(), F.col("pixel_hash")))
    classes = cut(known.filter("pixel_hash is not null").groupBy("pixel_hash").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("members").alias("members")))
    links = cut(_links(classes.filter(F.col("n") >= MIN_AGREE).select(F.col("rep").alias("id"), "pixel_hash", "rows", "members")))
    whole = components(links.select("a", "b"))
    degree = links.groupBy("pixel_hash").agg(F.sum("links").alias("links"))
    named = classes.select("pixel_hash", "rep", "rows").join(whole.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "pixel_hash", "left")
    out = known.select("id", "pixel_hash", "n").join(named, "pixel_hash", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("rows") - 1, F.lit(0))
    return out.select("id", F.col("n").alias("n_corners"), F.coalesce("component", "rep", "id").alias("component_id"), n_links.cast("long").alias("n_links"))


def thumbnails(batches: Iterator[pd.DataFrame], side: int = 48) -> Iterator[pd.DataFrame]:
    """Vectors of a square number of values, drawn as grey images: the values by rows, stretched to the full range and enlarged smoothly."""
    for b in batches:
        pixels = []
        for v in b["embedding"]:
            n = 0 if v is None else int(len(v) ** 0.5)
            if n < 2 or not np.isfinite(v).all():
                pixels.append(None)
                continue
            a = np.asarray(v[: n * n], float).reshape(n, n)
            a = (a - a.min()) / max(a.max() - a.min(), 1e-9) * 255
            pixels.append(resize(a, side, side).round().astype(np.uint8).tobytes())
        yield pd.DataFrame({"id": b["vec_id"], "height": [0 if p is None else int(len(p) ** 0.5) for p in pixels], "width": [0 if p is None else int(len(p) ** 0.5) for p in pixels], "pixels": pixels})
