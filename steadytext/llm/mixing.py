"""Mixing sources to target weights with a splitting tree of block quotas.

Each source's documents are dealt, in a seeded order, into blocks. A source's target says
how many passes over its blocks are whole and how much of the last one is taken. The exact
number of blocks of every source is then split among the output shards: the root holds all
quotas, and every node draws its left part's quotas from a multivariate hypergeometric
distribution, as if the blocks were shuffled and cut. Shards take disjoint runs of a
source's permuted blocks and shuffle their own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from steadytext.llm.storage import stored
from steadytext.operators.frames import join_lookup

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS,
            share: float = SHARE, most: float = MOST) -> dict:
    """Target per source. ``sizes`` in order: weights repeat along it.

    ``share`` of the sum of sizes is dealt out by weight; a target stops at ``most`` times
    its source's size, and the excess is dealt again by weight among the others until none is
    above. ``share`` beyond ``most`` leaves all at their bound.
    """
    weight = np.resize(np.array(weights, float), len(sizes))
    bound = np.array([most * n for _, n in sizes], float)
    out = np.zeros(len(sizes))
    left, free = share * float(sum(n for _, n in sizes)), np.ones(len(sizes), bool)
    while free.any():
        out[free] = left * weight[free] / weight[free].sum()
        above = free & (out > bound)
        if not above.any():
            break
        out[above] = bound[above]
        left -= bound[above].sum()
        free &= ~above
    return {source: float(t) for (source, _), t in zip(sizes, out)}


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources) blocks of every source in every shard.

    Shards differ by at most one block in size; columns sum to ``quotas``. A node's draw depends on
    the seed and its place in the tree only.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(counts: np.ndarray, low: int, high: int, node: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle = (low + high) // 2
        total = int(counts.sum())
        edge = [total * k // (high - low) for k in (0, middle - low)]
        draw = np.random.default_rng([seed, node])
        left = draw.multivariate_hypergeometric(counts, edge[1] - edge[0], method="marginals")
        split(left, low, middle, 2 * node)
        split(counts - left, middle, high, 2 * node + 1)

    split(np.asarray(quotas, np.int64), 0, shards, 1)
    return out


def _place(seed: int, *keys: Column) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
             most: float = MOST, shards: int = 16, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards) of every row of ``docs``.

    size: words of the text (null: none). taken: words the mix takes, repeats counted; a
    document wholly taken twice counts twice, and the one at the end of a source's quota in part,
    so a source's taken words are its target but for the fraction of a word. shards: the output
    shard of each take. Sources are ordered by code point, null last, as one source. Nulls in
    doc_id and repeated rows are rows like any other; among equals in doc_id and size it makes
    no difference which one is taken. An empty table gives no rows. Every choice is a hash of
    seed and row, so reruns agree.

    The driver holds one row per source: sizes, targets and quotas. A source of n documents has
    about sqrt(n) blocks of about sqrt(n) documents, so neither the window over a source's blocks
    nor the one over a block's documents gathers a large source.
    """
    spark = docs.sparkSession
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"),
                                            F.count("*").alias("docs")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([(r["source"], r["source_size"]) for r in per_source], weights, share, most)
    plan = []
    for r in per_source:
        size, words = r["source_size"], int(goal[r["source"]] + 1e-6)
        whole, rest = divmod(words, size) if size else (0, 0)
        plan.append((r["source"], size, goal[r["source"]], whole, rest,
                     max(1, int(r["docs"] ** 0.5))))
    table = spark.createDataFrame(
        plan, "source string, source_size long, target double, whole long, rest long, blocks long")
    dealt = _by_source(rows, table).withColumn(
        "place", _place(seed, F.col("doc_id"), F.col("size"))).withColumn(
        "block", F.pmod(F.col("place"), F.col("blocks")))
    # words of each block, and what lies before it in the source's order
    block = dealt.groupBy("source", "block", "whole", "rest", "blocks").agg(
        F.sum("size").alias("block_size"))
    block = block.selectExpr(
        "*", "coalesce(sum(block_size) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN "
        "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
        "row_number() OVER (PARTITION BY source ORDER BY block) - 1 AS nth",
        "count(*) OVER (PARTITION BY source) AS n_blocks").where("rest > 0 OR whole > 0")
    block = stored(block.select(
        "source", "block", "before", "nth", "n_blocks", "block_size", "whole", "rest",
        (F.col("before") < F.col("rest")).cast("long").alias("part")))
    count = {r["source"]: r for r in block.groupBy("source").agg(
        F.sum(F.col("whole") + F.col("part")).alias("quota"),
        F.max("n_blocks").alias("n_blocks")).collect()}
    names = [p[0] for p in plan]
    quota = np.array([count[n]["quota"] if n in count else 0 for n in names], np.int64)
    edges = np.cumsum(split_quotas(quota, shards, seed), axis=0)
    bounds = spark.createDataFrame(
        [(n, edges[:, i].tolist()) for i, n in enumerate(names)], "source string, edges array<long>")
    nth = F.expr("transform(sequence(0L, whole), p -> p * n_blocks + nth)")
    block = _by_source(block, bounds).withColumn("shards", F.transform(
        F.slice(nth, 1, (F.col("whole") + F.col("part")).cast("int")),
        lambda t: F.size(F.filter("edges", lambda e: e <= t))))
    # the block in which a quota ends is taken document by document
    last = F.col("part").cast("boolean") & (F.col("before") + F.col("block_size") > F.col("rest"))
    block = block.select(
        "source", "block", "shards", F.when(last, F.col("rest") - F.col("before")).alias("left"),
        F.col("part"))
    joined = _by_block(dealt, block)
    full = joined.where("left IS NULL").withColumn(
        "partial", F.coalesce(F.col("part"), F.lit(0)) * F.col("size"))
    ends = joined.where("left IS NOT NULL").selectExpr(
        "*", "greatest(0L, least(size, left - coalesce(sum(size) OVER (PARTITION BY source, block "
        "ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L))) AS partial")
    out = full.unionByName(ends)
    return out.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("partial")).alias("taken"),
        F.coalesce(F.slice("shards", 1, (F.col("whole") + (F.col("partial") > 0).cast("long"))
                           .cast("int")), F.array().cast("array<int>")).alias("shards"))


def _by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of one row per source, null matching null.

    The driver made the table, so it is the side to broadcast; Spark does not know its size and could take the rows.
    """
    return _matched(rows, F.broadcast(table), ["source"])


def _by_block(rows: DataFrame, block: DataFrame) -> DataFrame:
    return _matched(rows, block, ["source", "block"])


def _matched(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a null source is a key like any other, and hot keys can be split."""
    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))

    out = join_lookup(marked(rows), marked(table), keys)
    return out.withColumn("source", F.expr("CASE WHEN source <> '' THEN substring(source, 2) END"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        most: float = MOST, shards: int = 16, seed: int = 17) -> DataFrame:
    """The mixed rows: ``docs`` with every document as often as the plan takes it.

    Whole documents only: the one in which a source's quota ends counts if at least half of
    it is taken. Rows come in shards, shuffled inside each. A document without words is never
    taken. Rows that repeat a doc_id are taken alike, by the plan of the first of them.
    """
    plan = plan_mix(docs.select("doc_id", "source", "text"), weights, share, most, shards, seed)
    takes = plan.where("size > 0").select(
        "doc_id", "source", "size", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("n"),
        "shards").groupBy("doc_id", "source", "size").agg(
            F.max_by("n", "n").alias("n"), F.max_by("shards", "n").alias("shards")).where("n > 0")
    takes = takes.select(
        F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.posexplode(F.slice("shards", 1, F.col("n"))).alias("_take", "_shard"))
    size = word_count(F.col("text"))
    out = docs.join(takes, docs["doc_id"].eqNullSafe(F.col("_doc"))
                    & docs["source"].eqNullSafe(F.col("_source")) & (size == F.col("_size")))
    order = F.xxhash64(F.lit(seed), "_shard", "_take", "doc_id")
    return out.withColumn("_order", order).repartition(F.col("_shard"), F.pmod("_order", F.lit(8))) \
        .sortWithinPartitions("_shard", "_order").select(*docs.columns)
