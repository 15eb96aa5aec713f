"""A small labelled table for the field: texts with (kind, substring). Names, hosts and numbers are invented."""

from __future__ import annotations

import random

_NAMES = "anna.bergh jo.miller k_ortiz mail2 info lena.ku73 p.duval sam contact.us rita-vos".split()
_HOSTS = "example.com mail8.example.com post.example.org corp.example.net my-site.example.com".split()
_WORDS = "the of and to reach me at write for please lyon strasse casa under details call thing over until das la noch avec para dot on with".split()


def _card(r: random.Random) -> str:
    d = [r.randint(1, 9), *(r.randint(0, 9) for _ in range(14))]
    total = sum(d[-2::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[::-2])
    return "".join(map(str, [*d, -total % 10]))


def _entity(kind: str, r: random.Random) -> str:
    n = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    if kind == "email":
        name, host = r.choice(_NAMES), r.choice(_HOSTS)
        at = r.choice(("@", " @ ", " (at) ", "(at)", " [at] ", "[at]", " {at} "))
        dot = r.choice((".", " (dot) ", " [dot] ", " dot ")) if at != "@" else "."
        return name + at + host.replace(".", dot)
    if kind == "ip":
        p = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice((".", ".", " . ", "[.]", "(.)")).join(p)
    if kind == "card":
        c = _card(r)
        return r.choice((" ", "-", ".", "/", "", " - ", "  ")).join(c[i : i + 4] for i in range(0, 16, 4))
    return r.choice((f"+{n(1)} ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"00{n(2)} {n(3)} {n(4)} {n(3)}", f"0{n(3)} / {n(6)}", f"+{n(2)} {n(3)} {n(7)}", f"1 ({n(3)}) {n(3)} {n(4)}", f"({n(3)}){n(3)}-{n(4)}"))


def _other(r: random.Random) -> str:
    n = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    hexa = "".join(r.choice("0123456789abcdef") for _ in range(40))
    return r.choice((f'token = "{hexa}"', f"CC BY-NC {n(1)}.0", f"version {n(1)}.{n(2)}.{n(1)}", f"20{n(2)}-0{n(1)}-1{n(1)}", f"{n(9)}", f"id {n(16)}", f"{n(2)}.{n(3)}.{n(3)} EUR", f"pages {n(3)}-{n(3)}", f"isbn 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"key: {hexa[:16]}", f"@{r.choice(_NAMES)}", f"a @ {n(2)} each", f"{n(7)}", f"{n(12)}", f"{n(1)},{n(3)},{n(3)}", f"{n(2)}:{n(2)}:{n(2)}", f"{n(4)} {n(4)} {n(2)}", "12345678901234567890"))


def labelled_table(size: int = 360, seed: int = 11) -> list[tuple[str, list[tuple[str, str]]]]:
    """The same rows at each call: one entity, or something that looks like one, between words."""
    r, out = random.Random(seed), []
    for i in range(size):
        left, right = (" ".join(r.choice(_WORDS) for _ in range(r.randint(0, 6))) for _ in range(2))
        kind = (*("email", "ip", "card", "phone") * 2, "phone", None, None, None, None)[i % 13]
        part = _entity(kind, r) if kind else _other(r)
        end = r.choice((" ", ". ", ", ", " "))
        out.append((f"{left} {part}{end}{right}".strip(" "), [(kind, part.strip())] if kind else []))
    return out
