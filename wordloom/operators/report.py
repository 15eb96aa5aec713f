"""Labels of documents, pivots and markdown tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short codes of the perturbations in reports.
CODES = {"visual": "vi", "disemvowel": "dv", "intrude": "in", "truncate": "tr", "segmentation": "sg", "phonetic": "ph", "keyboard-typo": "kt", "full-swap": "fs", "inner-swap": "is", "natural-typo": "nt", "rand": "rd"}


def attack_label(header: Column) -> Column:
    """code:severity for each ('method', severity) of a header line, comma-joined; unknown methods keep their name."""
    table = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    found = F.regexp_extract_all(header, F.lit(r"\('[0-9a-zA-Z\-]+', ?[0-9.]+\)"), F.lit(0))

    def code(p: Column) -> Column:
        name = F.regexp_extract(p, "'([^']*)'", 1)
        return F.concat(F.coalesce(F.element_at(table, name), name), F.lit(":"), F.regexp_extract(p, r", ?([0-9.]+)\)", 1))

    return F.array_join(F.transform(found, code), ",")


def method_of(document: Column, methods: list[tuple[str, str]]) -> Column:
    """The name of the first (part, name) whose part the document's name contains; null if none."""
    out = F.lit(None).cast("string")
    for part, name in reversed(methods):
        out = F.when(F.contains(document, F.lit(part)), F.lit(name)).otherwise(out)
    return out


def pivoted(results: DataFrame, rows: str, columns: str, value: str, names: list[str], digits: int = 3) -> DataFrame:
    """One row for each method, one column for each attack."""
    wide = results.groupBy(rows).pivot(columns, names).agg(F.avg(value))
    return wide.select(rows, *[F.round(F.col(f"`{n}`"), digits).alias(n) for n in names])


def markdown(table: DataFrame) -> str:
    """A report's table (some rows and columns) as markdown."""
    rows = table.collect()
    lines = [table.columns, ["---"] * len(table.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
