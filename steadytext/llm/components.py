"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steadytext.llm.storage import release, stored
from steadytext.operators.frames import join_lookup


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _attach(links: DataFrame, both_ways: bool) -> DataFrame:
    """Hang neighbours on the smallest node around them (one contraction step).

    ``both_ways``: the larger neighbours of every node go to the smallest node of its
    neighbourhood. Otherwise its smaller neighbours and itself do. The smallest is an
    aggregate joined back, so a node with very many links is never gathered in one task.
    """
    pairs = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"),
                                                           F.col("a").alias("b")))
    if not both_ways:
        pairs = pairs.where("b < a")
    low = pairs.groupBy("a").agg(F.min("b").alias("low"))
    if both_ways:
        low = low.withColumn("low", F.least("a", "low"))
        joined = join_lookup(pairs.where("b > a"), low, ["a"], "inner")
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        joined = join_lookup(pairs, low, ["a"], "inner")
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected link table; the smallest node names it.

    Links with a null end and links of a node to itself are left out; repeated links count once.
    The number of rounds grows with the logarithm of the largest component. Every
    round is a written table in the shared folder. No links, no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
                 .where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    state = _state(now)
    while state[0]:
        large = stored(_attach(now, True))
        after = stored(_attach(large, False))
        release(large)
        release(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(
        stars.select("component").distinct().select(F.col("component").alias("node"), "component"))
