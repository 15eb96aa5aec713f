"""Character-level perturbations of sentences, as Column functions with keyed draws.

Every method maps a word (and a key) to a new word. :func:`perturb` applies one to words of a sentence in a keyed
random order until ceil(n * level) words have changed. Equal keys give equal results on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import chars, let, pick, uniform
from . import lookalike, phonetic
from .tokens import detokenized, word_tokens

#: Neighbours of the keys of a US keyboard.
KEYBOARD = {
    "q": "wa", "w": "qes", "e": "wrd", "r": "etf", "t": "ryg", "y": "tuh", "u": "yij", "i": "uok", "o": "ipl", "p": "ol",
    "a": "qsz", "s": "awdx", "d": "sefc", "f": "drgv", "g": "fthb", "h": "gyjn", "j": "hukm", "k": "jil", "l": "kop",
    "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}
#: A small table of common misspellings; callers pass their own.
TYPOS = {"the": "teh hte", "and": "adn nad", "that": "taht htat", "for": "fro ofr", "with": "wiht wtih", "this": "tihs thsi", "from": "form fomr", "their": "thier theri", "have": "ahve hvae", "which": "wich whcih", "what": "waht whta", "has": "hsa ahs", "was": "wsa aws", "are": "aer rae", "were": "weer wree", "is": "si iss", "of": "fo off", "to": "ot too", "in": "ni inn", "only": "olny onyl"}
#: The marks that intrude.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
Method = Callable[[Column, Column, float], Column]


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def disemvowel(w: Column, key: Column, level: float = 1.0) -> Column:
    bare = F.regexp_replace(w, "[AEIOUaeiou]", "")
    return F.when((F.length(w) < 3) | (bare == ""), w).otherwise(bare)


def truncate(w: Column, key: Column, level: float = 1.0, minlen: int = 3, cutoff: int = 1) -> Column:
    return F.substr(w, F.lit(1), F.greatest(F.least(F.length(w), F.lit(minlen)), F.length(w) - cutoff))


def _shuffled(w: Column, key: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.transform(chars(w), lambda c, i: F.struct(F.md5(F.concat_ws("|", key, i.cast("string")).cast("binary")).alias("u"), c.alias("c")))), lambda s: s["c"]), "")


def full_swap(w: Column, key: Column, level: float = 1.0, tries: int = 10) -> Column:
    """Characters in a keyed order, that of the first of some draws that differs; words below 3 stay."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda t: _shuffled(w, F.concat_ws("|", key, t.cast("string"))))
    return F.when(F.length(w) < 3, w).otherwise(F.coalesce(F.get(F.filter(drawn, lambda x: x != w), F.lit(0)), w))


def inner_swap(w: Column, key: Column, level: float = 1.0) -> Column:
    """As full_swap, between the first and the last character; words below 4 stay."""
    n = F.length(w)
    inner = F.substr(w, F.lit(2), F.greatest(n - 2, F.lit(0)))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda t: _shuffled(inner, F.concat_ws("|", key, t.cast("string"))))
    new = F.coalesce(F.get(F.filter(drawn, lambda x: x != inner), F.lit(0)), inner)
    return F.when(n < 4, w).otherwise(F.concat(F.substring(w, 1, 1), new, F.substr(w, n, F.lit(1))))


def intrude(w: Column, key: Column, level: float = 1.0) -> Column:
    """One mark of a word between its characters: each gap has it with the chance level, drawn anew until one has.

    Words of two characters get it in between; words below 2 and those of marks only stay.
    """
    n = F.length(w)
    mark = F.substr(F.lit(MARKS), pick(len(MARKS), "mark", key) + 1, F.lit(1))
    put = lambda t: F.array_join(F.transform(chars(w), lambda c, i: F.when((i > 0) & (uniform("put", key, t, i) < level), F.concat(mark, c)).otherwise(c)), "")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(9)), put)
    sure = pick(n - 1, "gap", key) + 1
    one = F.concat(F.substr(w, F.lit(1), sure), mark, F.substr(w, sure + 1))
    return F.when((n < 2) | ~w.rlike("[\\p{L}\\p{N}]"), w).when(n == 2, one).otherwise(F.coalesce(F.get(F.filter(drawn, lambda x: x != w), F.lit(0)), one))


def keyboard_typo(w: Column, key: Column, level: float = 1.0) -> Column:
    """One keyed position gets a neighbouring key; characters that aren't on the table stay."""
    at = pick(F.length(w), "at", key) + 1
    near = F.element_at(_map(KEYBOARD), F.lower(F.substr(w, at, F.lit(1))))
    new = F.substr(near, pick(F.length(near), "key", key) + 1, F.lit(1))
    return F.coalesce(F.concat(F.substr(w, F.lit(1), at - 1), new, F.substr(w, at + 1)), w)


def natural_typo(w: Column, key: Column, level: float = 1.0, table: dict[str, str] = TYPOS) -> Column:
    """One of the listed misspellings of a known word."""
    listed = F.split(F.element_at(_map(table), w), " ")
    return F.coalesce(F.get(listed, pick(F.size(listed), "typo", key)), w)


def visual(text: Column, key: Column, level: float) -> Column:
    """Each letter becomes a character of a like name, with chance level, the nearer the likelier."""
    like = F.create_map(*[x for c, vs in lookalike.table().items() for x in (F.lit(c), F.array(*[F.struct(F.lit(v).alias("v"), F.lit(p).alias("p")) for v, p in vs]))])

    def swapped(table: Column) -> Column:
        def swap(c: Column, i: Column) -> Column:
            near = F.element_at(table, c)
            return F.when(near.isNotNull() & (uniform("v", key, i) < level), F.get(F.filter(near, lambda x: x["p"] >= uniform("w", key, i)), F.lit(0))["v"]).otherwise(c)

        return F.array_join(F.transform(chars(text), swap), "")

    return let(like, swapped)


METHODS: dict[str, Method] = {"disemvowel": disemvowel, "truncate": truncate, "full-swap": full_swap, "inner-swap": inner_swap, "intrude": intrude, "keyboard-typo": keyboard_typo, "natural-typo": natural_typo}


def segmentation(text: Column, key: Column, level: float, insert: bool = True) -> Column:
    """Each space goes with chance level; before other characters one comes with a tenth of it."""
    draw = lambda c, i: F.when((c == " ") & (uniform("drop", key, i) < level), F.lit("")).when(F.lit(insert) & (c != " ") & (uniform("add", key, i) < level / 10), F.concat(F.lit(" "), c)).otherwise(c)
    return F.array_join(F.transform(chars(text), draw), "")


def segment(text: Column, key: Column, level: float) -> Column:
    """The other segmentation: each word merges into the next with chance level."""
    words = word_tokens(text)
    return F.rtrim(F.array_join(F.transform(words, lambda t, i: F.concat(t, F.when(uniform("merge", key, i) < level, F.lit("")).otherwise(F.lit(" ")))), ""))


#: Methods that take the whole text.
WHOLE: dict[str, Callable[[Column, Column, float], Column]] = {"visual": visual, "segmentation": segmentation, "segment": segment, "phonetic": phonetic.respelled_text}
#: The ten methods that attacks draw from.
NAMES = ("visual", "phonetic", "full-swap", "inner-swap", "disemvowel", "truncate", "keyboard-typo", "natural-typo", "intrude", "segmentation")


def changes(words: Column, key: Column, method: Method, level: float = 1.0) -> Column:
    """Structs of word, new and u (the place in the keyed order) by position."""
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), method(w, F.concat_ws("|", key, i.cast("string")), level).alias("new"), F.concat(F.md5(F.concat_ws("|", F.lit("order"), key, i.cast("string")).cast("binary")), F.lpad(i.cast("string"), 9, "0")).alias("u")))


def perturb(text: Column, method: str, level: float, key: Column) -> Column:
    """The text with ceil(n * level) of its n words changed by the method, or all that can change."""
    if method in WHOLE:
        return WHOLE[method](text, key, level)
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    own = F.concat_ws("|", F.lit(method), key)

    def applied(d: Column) -> Column:
        limit = F.ceil(F.size(d) * F.lit(float(level))).cast("int")
        turns = F.slice(F.array_sort(F.transform(F.filter(d, lambda x: x["word"] != x["new"]), lambda x: x["u"])), F.lit(1), limit)
        return let(turns, lambda u: F.transform(d, lambda x: F.when((x["word"] != x["new"]) & F.array_contains(u, x["u"]), x["new"]).otherwise(x["word"])))

    return detokenized(let(changes(word_tokens(text), own, METHODS[method], level), applied))


def _drawn(names: Sequence[str], level: float, key: Column, text: Column) -> Column:
    """The text after one of the methods, by a keyed draw."""
    which, new = pick(len(names), "rand", key), text
    for i, m in enumerate(names):
        new = F.when(which == i, perturb(text, m, level, key)).otherwise(new)
    return new


def composed(text: Column, attacks: Sequence[tuple[str, float]], key: Column) -> Column:
    """Attacks one after the other; rand is one of the methods by a keyed draw, intrude only as the last."""
    for step, (method, level) in enumerate(attacks):
        own = F.concat_ws("|", F.lit(str(step)), key)
        if method == "rand":
            names = [m for m in NAMES if m != "intrude" or step == len(attacks) - 1]
            draw = partial(_drawn, names, level, own)
            text = let(text, lambda t: draw(t))  # noqa: B023 (called at once)
        else:
            text = perturb(text, method, level, own)
    return text


def perturb_pairs(pairs: DataFrame, attacks: Sequence[tuple[str, float]], key: str, seed: int = 0) -> DataFrame:
    """pairs (first, second, key) with both sides attacked."""
    return pairs.withColumns({c: composed(F.col(c), attacks, F.concat_ws("|", F.lit(f"{seed}|{c}"), F.col(key).cast("string"))) for c in ("first", "second")})


def drawn_pair(key: Column, level: float = 0.2) -> Column:
    """Two different methods by a keyed draw, as structs of method and level; intrude comes last."""
    names = F.array(*[F.lit(n) for n in NAMES])
    a, b = pick(len(NAMES), "a", key), pick(len(NAMES) - 1, "b", key)
    b = F.when(b >= a, b + 1).otherwise(b)
    first, second = F.get(names, a), F.get(names, b)
    step = lambda m: F.struct(m.alias("method"), F.lit(level).alias("level"))
    return F.when(first == "intrude", F.array(step(second), step(first))).otherwise(F.array(step(first), step(second)))


def merged_words(tokens: DataFrame, key: list[str], level: float) -> DataFrame:
    """The other segmentation: each word merges into the next with chance level. key, text."""
    kept = F.transform("tokens", lambda t, i: F.concat(t, F.when(uniform("merge", F.concat_ws("|", *[F.col(k).cast("string") for k in key]), i) < level, F.lit("")).otherwise(F.lit(" "))))
    return tokens.select(*key, F.rtrim(F.array_join(kept, "")).alias("text"))
