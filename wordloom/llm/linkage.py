"""Links between members of buckets, closed to components, without any pair list of a large group.

Each member of a bucket is checked against the bucket's least member only. Pairs of one bucket whose components still
differ are then all checked: in buckets of up to SMALL members as pairs, in larger ones as blocks of members
that are compared inside a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, cut, forget
from .components import components

#: Buckets of up to so many members are resolved as pairs, larger ones in blocks.
SMALL = 32
#: A block side holds about so many members, and so many of their parts (n), at most.
BLOCK_ROWS, BLOCK_PARTS = 1024, 500_000


def verify(pairs: DataFrame, members: DataFrame, check: Callable) -> DataFrame:
    """The pairs (a, b) that check keeps: it maps frames of a, b and their payloads x, y to frames of a, b."""
    x, y = members.select(F.col("id").alias("a"), F.col("members").alias("x")), members.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInPandas(check, "a long, b long")


def _shared(pairs: DataFrame, votes: int) -> DataFrame:
    """The distinct pairs that occur votes times at least."""
    return pairs.distinct() if votes == 1 else pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= votes).select("a", "b")


def _large_buckets(left: DataFrame, members: DataFrame, block: Callable, block_rows: int) -> DataFrame:
    """Links across components inside large buckets, by blocks of the clusters which these buckets form."""
    cluster = components(left.select(F.col("id").alias("a"), F.col("lead").alias("b")))
    own = left.select("id", "component").distinct().join(cluster.withColumnRenamed("component", "cluster"), "id", "left")
    own = own.withColumn("cluster", F.coalesce("cluster", "id")).join(members, "id")
    sizes = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("terms"))
    parts = sizes.select("cluster", F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows), F.ceil(F.col("terms") / BLOCK_PARTS)).cast("int").alias("parts"))
    cells = own.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "component", "part", "members")
    return cells.groupBy("cluster", "i", "j").applyInPandas(block, "a long, b long")


def linked_components(buckets: DataFrame, members_of: Callable[[DataFrame], DataFrame], check: Callable, block: Callable, known: DataFrame | None = None, votes: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, component) of the linked ids but the least of each component.

    buckets: id and key. members_of: from a frame of ids to id, n and members (a binary payload). block: from a
    frame of id, component, part and members to links between different components. known: links (a, b) that need no check. votes: how
    many buckets a pair must share to be checked. block_rows: members to a block side. Intermediate tables are removed.
    """
    leads = buckets.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = cut(buckets.join(leads, "key"))
    members = cut(members_of(shared.select("id").distinct()))
    links = verify(_shared(shared.filter("id != lead").select(F.col("id").alias("a"), F.col("lead").alias("b")), votes), members, check)
    first = components(links if known is None else links.unionByName(known))
    labelled = shared.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    left = cut(labelled.join(mixed, "key", "left_semi"), small=F.count_if(F.col("size") <= SMALL), large=F.count_if(F.col("size") > SMALL))
    sizes, more = left._measured, []
    if sizes["small"]:
        small = left.filter(F.col("size") <= SMALL).select("key", "id", "component")
        pairs = small.select("key", F.col("id").alias("a"), F.col("component").alias("c")).join(small.select("key", F.col("id").alias("b"), F.col("component").alias("d")), "key")
        more.append(verify(_shared(pairs.filter("a < b and c != d").select("a", "b"), votes), members, check))
    if sizes["large"]:
        more.append(_large_buckets(left.filter(F.col("size") > SMALL), members, block, block_rows))
    if more:
        found, n = counted(more[0] if len(more) == 1 else more[0].unionByName(more[1]))
        if n:
            before, first = first, components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found))
            forget(before)
        forget(found)
    forget(shared, members, left)
    return first
