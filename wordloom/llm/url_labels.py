"""A labelled table of urls, 1 for block: drawn by a keyed generator, in which every feature overlaps between the labels. Hosts are invented."""

from __future__ import annotations

import random

_WORDS = "garden library harbour physics museum river bakery history ocean valley forest school concert bridge journal kitchen archive village weather climate atlas cinema orchard poetry council railway meadow lantern theatre market bonus deal lucky play offer card travel north press studio health sport news photo".split()
#: Suffixes with how often they occur among harmless and among blocked urls.
_SUFFIXES = {"org": (20, 5), "com": (30, 28), "net": (12, 12), "edu": (8, 0), "info": (5, 9), "de": (8, 4), "fr": (8, 4), "es": (6, 3), "top": (1, 12), "xyz": (1, 12), "click": (0, 8), "site": (1, 7)}
_KEYS = "id q page ref lang sort u aff sub sid campaign token click".split()


def _noise(r: random.Random, n: int) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))


def _url(r: random.Random, bad: bool) -> str:
    words = [r.choice(_WORDS) for _ in range(r.choice((1, 1, 2, 2, 3)))]
    if r.random() < (0.45 if bad else 0.05):
        words.append(_noise(r, r.randint(5, 12)))
    if r.random() < (0.4 if bad else 0.06):
        words[-1] += str(r.randint(1, 9999))
    host = ("-" if r.random() < 0.35 else "").join(words)  # hyphens say nothing
    front = r.choice(("", "", "www.", "blog.", "m.", "shop."))
    suffix = r.choices(list(_SUFFIXES), [w[bad] for w in _SUFFIXES.values()])[0]
    parts = [r.choice(_WORDS) if r.random() < (0.4 if bad else 0.8) else _noise(r, r.randint(6, 20)) if r.random() < (0.6 if bad else 0.1) else str(r.randint(1, 99999)) for _ in range(r.choice((0, 1, 2, 3)) + (r.random() < 0.3 and bad))]
    path = "/" + "/".join(parts) + r.choice(("", "", "/", ".html") if parts else ("",))
    count = r.choice((0, 1, 2, 3, 4, 5) if bad else (0, 0, 0, 0, 1, 2))
    query = "&".join(f"{r.choice(_KEYS)}={_noise(r, r.randint(3, 16)) if r.random() < (0.7 if bad else 0.2) else r.choice(_WORDS)}" for _ in range(count))
    return f"http{'s' * (r.random() < 0.7)}://{front}{host}.{suffix}{path}{'?' + query if query else ''}{'#top' if r.random() < 0.05 else ''}"


def labelled_urls(size: int = 6000, seed: int = 17) -> list[tuple[str, int]]:
    """The same rows at each call; two in five are to be blocked."""
    r = random.Random(seed)
    return [(_url(r, label), int(label)) for label in (r.random() < 0.4 for _ in range(size))]
