"""Character classes, ASCII lower case, and draws keyed by a hash."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that decide costs and classes.
SMALL_LETTERS = "abcdefghijklmnopqrstuvwxyz"
BIG_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = BIG_LETTERS + SMALL_LETTERS
NUMBERS = "0123456789"
PUNCTUATIONS = "-' #/\\(){}[]%$€@,:&?!;.\""
ALL_CHARS = LETTERS + PUNCTUATIONS + NUMBERS
VOWELS = "AaEeOoUuiI"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(c, BIG_LETTERS, SMALL_LETTERS)


def uniform(*key: Column | str | int) -> Column:
    """A draw in [0, 1) that depends on the key alone: the first 32 bits of its md5."""
    text = F.concat_ws("|", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pick(n: Column | int, *key: Column | str | int) -> Column:
    """An index from 0 to n - 1."""
    return F.floor(uniform(*key) * n).cast("int")


def chars(c: Column) -> Column:
    """The characters of a text; none for an empty one."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def glyph_similarity(code: str, letter: str) -> float:
    """1 if the letter is what remains of the character without its marks, else 0."""
    return float(unicodedata.normalize("NFKD", code)[0].lower() == letter)
