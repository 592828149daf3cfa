"""Nearest neighbours by cosine with vantage-point trees per shard.

Vectors are dealt into shards of bounded size, and each shard becomes a vantage-point tree of
its unit vectors. Blocks of queries walk every shard's tree together: a branch is left out for
those queries for which the triangle inequality, relaxed by a factor, says that it holds nothing
nearer than what they have. With factor one the search is exact; a smaller factor leaves out more.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD_ROWS = 4096
BLOCK_ROWS = 512
LEAF = 64
FACTOR = 0.25        # recall 0.99 on almost uniform 64-dimensional vectors
HELD_BYTES = 1 << 27  # vectors and unit vectors of the trees that a task holds at once


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Every row times a power of two that brings its largest component near one.

    Cosines stay the same to the last bit, and squares of very large or small components
    neither overflow nor vanish.
    """
    if not vectors.size:
        return vectors
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def compact(vectors: np.ndarray) -> np.ndarray:
    """The same values in single precision where that changes none."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    return single if (single == vectors).all() else vectors


class Tree:
    """Vantage-point tree of unit vectors; distances are Euclidean, which order like cosines."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 0) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], scaled(vectors[order].astype(np.float64))
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.unit = self.vectors / self.norms[:, None]
        draw = np.random.default_rng(seed)
        # node: (rows of a leaf) or (vantage row, [(child, least, largest distance), ...])
        self.nodes: list = []
        self._build(np.arange(len(ids)), draw)

    def __getstate__(self) -> dict:
        """Travels without the unit vectors, which are made again."""
        return {k: v for k, v in self.__dict__.items() if k != "unit"} | {"vectors": compact(self.vectors)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, vectors=state["vectors"].astype(np.float64))
        self.unit = self.vectors / self.norms[:, None]

    def _build(self, rows: np.ndarray, draw) -> int:
        at = len(self.nodes)
        if len(rows) <= LEAF:
            self.nodes.append(rows)
            return at
        self.nodes.append(None)
        pick = draw.integers(len(rows))
        vantage, rows = rows[pick], np.delete(rows, pick)
        far = np.linalg.norm(self.unit[rows] - self.unit[vantage], axis=1)
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        parts = [(self._build(rows[p], draw), far[p].min(), far[p].max())
                 for p in (order[:half], order[half:])]
        self.nodes[at] = (vantage, parts)
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float,
               spare: int = 27):
        """Per query, rows and cosines of its k nearest found, the query's own id left out.

        The walk keeps ``k + spare`` candidates of every query by matrix products. Their cosines
        are then taken in double precision from the original vectors, row by row, so equal
        vectors have equal cosines; ties go to the smaller id. A query whose spare places are
        all taken by such ties is asked again with twice the places. ``seen`` is then the share
        of vectors looked at.
        """
        queries = scaled(queries)
        norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        unit = queries / norms[:, None]
        places = min(k + spare, len(self.ids))
        best = np.full((len(queries), places), -np.inf)
        rows = np.zeros((len(queries), places), np.int64)
        reach = np.full(len(queries), np.inf)        # distance of the k-th nearest so far
        self.seen = 0

        def offer(new: np.ndarray, asking: np.ndarray) -> None:
            self.seen += len(new) * len(asking)
            near = unit[asking] @ self.unit[new].T
            near[self.ids[new][None, :] == own[asking][:, None]] = -np.inf
            better = (near > best[asking].min(1)[:, None]).any(1)
            asking, near = asking[better], near[better]
            if not len(asking):
                return
            value = np.concatenate([best[asking], near], axis=1)
            row = np.concatenate([rows[asking], np.broadcast_to(new, near.shape)], axis=1)
            keep = np.argpartition(-value, places - 1, axis=1)[:, :places]
            best[asking] = value = np.take_along_axis(value, keep, 1)
            rows[asking] = np.take_along_axis(row, keep, 1)
            if places >= k:
                last = -np.partition(-value, k - 1, axis=1)[:, k - 1]
                reach[asking] = np.sqrt(np.maximum(2 - 2 * last, 0))

        def visit(node: int, asking: np.ndarray) -> None:
            if not len(asking):
                return
            if isinstance(self.nodes[node], np.ndarray):
                offer(self.nodes[node], asking)
                return
            vantage, parts = self.nodes[node]
            far = np.sqrt(np.maximum(2 - 2 * (unit[asking] @ self.unit[vantage]), 0))
            offer(np.array([vantage]), asking)
            # how far a branch is at least, by the triangle inequality
            gap = np.stack([np.maximum(np.maximum(low - far, far - high), 0)
                            for _, low, high in parts])
            inner_first = gap[0] <= gap[1]
            for turn in (0, 1):
                for b, (child, _, _) in enumerate(parts):
                    now = (inner_first == (b == 0)) == (turn == 0)
                    now &= gap[b] <= factor * reach[asking] + 1e-9
                    visit(child, asking[now])

        visit(0, np.arange(len(queries)))
        share = self.seen / max(len(queries) * len(self.ids), 1)
        out = []
        for q in range(len(queries)):
            row = rows[q][np.isfinite(best[q])]
            cosine = np.einsum("ij,j->i", self.vectors[row], queries[q]) / (
                self.norms[row] * norms[q])
            order = np.lexsort((self.ids[row], -cosine))
            row, cosine = row[order], cosine[order]
            if places < len(self.ids) and len(row) == places and \
                    cosine[-1] >= cosine[k - 1] - 1e-9:
                out += self.search(queries[q:q + 1], own[q:q + 1], k, factor, 2 * spare)
            else:
                out.append((row[:k], cosine[:k]))
        self.seen = share
        return out


def nearest_of(trees: list[Tree], queries: np.ndarray, own: np.ndarray, k: int,
               factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, cosine) of the k nearest that every query finds in all trees together."""
    query, ids, cosine = [], [], []
    for tree in trees:
        kept = tree.search(queries, own, k, factor)
        query.append(np.repeat(np.arange(len(queries)), [len(r) for r, _ in kept]))
        ids.append(tree.ids[np.concatenate([r for r, _ in kept])])
        cosine.append(np.concatenate([c for _, c in kept]))
    query, ids, cosine = map(np.concatenate, (query, ids, cosine))
    order = np.lexsort((ids, -cosine, query))
    query, ids, cosine = query[order], ids[order], cosine[order]
    near = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[near], ids[near], cosine[near]


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, factor: float = FACTOR,
            shard_rows: int = SHARD_ROWS, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query among all other rows.

    ``is_query`` makes the condition on the id that marks queries.
    score is the cosine of the original vectors in double precision; ties go to the smaller
    id. Rows with a null id and vectors that are null, empty, zero or hold a null or non-finite
    component take no part; rows that repeat an id count once (the smallest vector); vectors of
    different length are never compared. A query with fewer than k others has as many rows.
    Every shard and every block of queries is of bounded size. A task holds the trees of a few shards
    (``HELD_BYTES``), which all blocks of queries pass one by one: trees and blocks come as rows in that
    order, not by a join, of which Spark could broadcast the blocks, sized without their repeats.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    usable_rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))) \
        .select(F.col(key).cast("long").alias("id"),
                F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    rows = usable_rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    query = is_query(F.col("id"))
    # no vector is shuffled for the counts
    total, asked, most = usable_rows.groupBy("id").agg(F.max(F.size("v")).alias("dims")).agg(
        F.count("*"), F.count_if(query), F.max("dims")).first()
    shards, blocks = -(-total // shard_rows) or 1, -(-asked // BLOCK_ROWS) or 1
    place = F.xxhash64(F.lit(7), "id")
    # enough groups of shards for all cores, and for a group's trees to be held together
    held = max(1, HELD_BYTES // (16 * shard_rows * (most or 1)))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = min(shards, max(4 * cores, -(-shards // held)))

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        made = Tree(rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()))
        return pd.DataFrame({"dims": [rows["dims"].iloc[0]], "shard": [rows["shard"].iloc[0]],
                             "made": [cloudpickle.dumps(made)]})

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        made = rows["id"].to_numpy(), compact(np.stack(rows["v"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"dims": [rows["dims"].iloc[0]], "block": [rows["block"].iloc[0]],
                             "made": [pickle.dumps(made)]})

    trees = rows.withColumn("shard", F.pmod(place, F.lit(shards))).groupBy("dims", "shard") \
        .applyInPandas(tree, "dims int, shard long, made binary")
    asking = rows.where(query).withColumn("block", F.pmod(place, F.lit(blocks))) \
        .groupBy("dims", "block").applyInPandas(block, "dims int, block long, made binary")
    met = trees.select(F.pmod("shard", F.lit(groups)).cast("int").alias("group"), "dims",
                       F.lit(-1).cast("long").alias("block"), "made").unionByName(asking.select(
                           F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
                           "dims", "block", "made"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held = None, []
        for batch in batches:
            for group, dims, number, made in zip(*batch.columns):
                if where != (group.as_py(), dims.as_py()):
                    where, held = (group.as_py(), dims.as_py()), []
                made = pickle.loads(made.as_py())
                if number.as_py() < 0:
                    held.append(made)
                elif held:
                    ids, found = made
                    row, near, score = nearest_of(held, found.astype(np.float64), ids, k, factor)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row]), pa.array(near), pa.array(score)],
                        ["query_id", "vec_id", "score"])

    found = met.repartitionById(groups, F.col("group")).sortWithinPartitions("group", "dims", "block") \
        .mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
