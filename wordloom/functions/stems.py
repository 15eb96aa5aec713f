"""Porter's stemmer as Spark expressions: each step is an ordered list of rules, of which the first that fits the ending decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import let

# Consonants and vowels of the paper: y is a vowel after a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Beginnings of a stem whose measure is above 0, above 1, and of one with a vowel; whole stems of measure 1.
_SOME, _MORE, _VOWEL, _ONE = f"(?:{_C})?{_V}{_C}", f"(?:{_C})?{_V}{_C}{_V}{_C}", f"(?:{_C})?[aeiouy]", f"(?:{_C})?{_V}{_C}(?:{_V})?"
#: A whole stem of one consonant run, vowel and consonant, which takes an e.
_SHORT = f"{_C}[aeiouy][^aeiouwxy]"

# The endings of steps 2, 3 and 4 of the published algorithm.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

Rule = tuple[str, str, str]  # what the word must match, what is replaced, by what


def _ends(ending: str, stem: str, new: str) -> Rule:
    return f"{ending}$", f"^({stem}.*){ending}$", f"$1{new}"


def _steps() -> list[list[Rule]]:
    after = [("(at|bl|iz)\x01$", "\x01$", "e"), *((f"{c}{c}\x01$", f"{c}\x01$", "") for c in "bcdfghjkmnpqrtvwx"), (f"^{_SHORT}\x01$", "\x01$", "e"), ("\x01$", "\x01$", "")]
    return [
        [("sses$", "es$", ""), ("ies$", "es$", ""), ("ss$", "^$", ""), ("s$", "s$", "")],
        [("eed$", f"^({_SOME}.*)eed$", "$1ee"), (f"^{_VOWEL}.*ed$", "ed$", "\x01"), (f"^{_VOWEL}.*ing$", "ing$", "\x01")],
        after,
        [(f"^{_VOWEL}.*y$", "y$", "i")],
        [_ends(e, _SOME, n) for e, n in sorted(STEP_2.items(), key=lambda x: -len(x[0]))],
        [_ends(e, _SOME, n) for e, n in sorted(STEP_3.items(), key=lambda x: -len(x[0]))],
        [*(_ends(e, _MORE, "") for e in sorted(STEP_4, key=lambda e: -len(e))), ("[st]ion$", f"^({_MORE}.*)ion$", "$1")],
        [(f"^{_MORE}.*e$", "e$", ""), (f"^{_SHORT}e$", "^$", ""), (f"^{_ONE}e$", "e$", "")],
        [(f"^(?:{_SOME}.*[aeiouy]|{_MORE}.*)ll$", "l$", "")],
    ]


STEPS = _steps()


def stem(word: Column) -> Column:
    """The stem of a word in lower case; words of up to two characters stay."""
    def step(rules: list[Rule]) -> Callable[[Column], Column]:
        def first_fit(w: Column) -> Column:
            out = w
            for test, pattern, new in reversed(rules):
                out = F.when(w.rlike(test), F.regexp_replace(w, pattern, new)).otherwise(out)
            return out

        return first_fit

    out = word
    for rules in STEPS:
        out = let(out, step(rules))
    return F.when(F.length(word) < 3, word).otherwise(out)


def stems(tokens: Column, least: int = 4) -> Column:
    """The tokens in lower case, those of least characters or more as stems."""
    return F.transform(tokens, lambda t: F.when(F.length(t) < least, F.lower(t)).otherwise(stem(F.lower(t))))


def stem_sql(source: str, column: str = "word") -> str:
    """The same over a table in SQL: common tables, of which stems_ has the columns of source and stem."""
    quoted = lambda x: "'" + x.replace("'", "''").replace("$1", "\\1") + "'"
    parts, last = [f"stem_0 AS (SELECT *, {column} AS stem FROM {source})"], 0
    for rules in STEPS:
        cases = " ".join(f"WHEN regexp_matches(stem, {quoted(t)}) THEN regexp_replace(stem, {quoted(p)}, {quoted(n)})" for t, p, n in rules)
        parts.append(f"stem_{last + 1} AS (SELECT * REPLACE (CASE {cases} ELSE stem END AS stem) FROM stem_{last})")
        last += 1
    parts.append(f"stems_ AS (SELECT * REPLACE (CASE WHEN length({column}) < 3 THEN {column} ELSE stem END AS stem) FROM stem_{last})")
    return ", ".join(parts)
