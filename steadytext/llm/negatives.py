"""Hard-negative mining: rows of another label that score a set share of a positive's score.

Every positive of an anchor asks for a window of scores, and the windows of one anchor overlap.
Their upper limits cut the scores into disjoint slots. A row falls into one slot, tasks keep
the best few rows of every slot, and the answer of a window is read from its own slot and the
slots below it, in descending order. So the rows are scored once for all windows of an anchor.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from steadytext.llm.storage import release, stored

SHARD_ROWS = 4096
BLOCK_ROWS = 2048      # anchors that meet a shard together
_EXACT = 1 << 49       # scores below this leave room for a row's place in a 64-bit number
_LONG = np.iinfo(np.int64)


def usable(vector: Column) -> Column:
    """Not null and every component finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, held to the range of a long."""
    top = [max((abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))) for m in (anchors, rows)]
    if top[0] * top[1] * max(rows.shape[1], 1) < 1 << 53:    # every partial sum fits a double
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of every row, ties to the earlier column."""
    n = score.shape[1]
    k = min(k, n)
    if not score.size or not allowed.any():
        none = np.zeros(0, np.int64)
        return none, none
    if n <= 1 << 13 and max(abs(int(score.max())), abs(int(score.min()))) < _EXACT:
        order = np.where(allowed, (score << 13) + (n - 1 - np.arange(n)), _LONG.min)
        column = np.argpartition(order, n - k, axis=1)[:, n - k:]
        kept = np.take_along_axis(order, column, 1) != _LONG.min
        row = np.broadcast_to(np.arange(len(score))[:, None], column.shape)
        return row[kept], column[kept]
    row, column = [], []
    for i in range(len(score)):
        at = np.flatnonzero(allowed[i])
        at = at[np.lexsort((at, -score[i, at].astype(object)))][:k]
        row.append(np.full(len(at), i))
        column.append(at)
    return np.concatenate(row), np.concatenate(column)


def limits(positive_scores: list[int], low: int, high: int) -> tuple[list[int], int]:
    """Upper limits of the windows, distinct and falling, and the least score of any window.

    A window [low, high] percent of a negative score holds nothing.
    """
    asked = [int(s) for s in positive_scores if s >= 0]
    uppers = sorted({high * s // 100 for s in asked}, reverse=True)
    return uppers, min((-(-low * s // 100) for s in asked), default=0)


def _packed(rows: pd.DataFrame) -> dict:
    rows = rows.sort_values("id")
    vectors = np.stack(rows["c"].to_numpy()).astype(np.int64).reshape(len(rows), -1)
    for kind in (np.int16, np.int32):
        span = np.iinfo(kind)
        if vectors.size and span.min <= vectors.min() and vectors.max() <= span.max:
            vectors = vectors.astype(kind)
            break
    return {"id": rows["id"].to_numpy(np.int64), "label": rows["label"].to_numpy(),
            "vectors": vectors}


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dims": [rows["dims"].iloc[0]], "shard": [rows["shard"].iloc[0]],
                         "rows": [pickle.dumps(_packed(rows))]})


def _block(low: int, high: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        made = _packed(rows)
        if "positive_scores" in rows:
            asked = [limits([] if s is None else list(s), low, high)
                     for s in rows.sort_values("id")["positive_scores"]]
            slots = max((len(u) for u, _ in asked), default=0)
            # slot j holds scores in (upper[j + 1], upper[j]]; the last one reaches down to the floor
            upper = np.full((len(asked), slots + 1), _LONG.min)
            for i, (falling, floor) in enumerate(asked):
                upper[i, :len(falling)] = falling
                upper[i, len(falling):len(falling) + 1] = floor - 1
            made["upper"], made["slots"] = upper, np.array([len(u) for u, _ in asked])
        return pd.DataFrame({"dims": [rows["dims"].iloc[0]], "anchors": [pickle.dumps(made)]})

    return pack


def _positives_in(anchors: dict, rows: dict, k: int):
    score = scores(anchors["vectors"], rows["vectors"])
    allowed = (anchors["label"][:, None] == rows["label"]) & (anchors["id"][:, None] != rows["id"])
    row, column = best(score, allowed, k)
    yield np.zeros(len(row), np.int32), row, column, score[row, column]


def _slots_in(anchors: dict, rows: dict, k: int):
    score = scores(anchors["vectors"], rows["vectors"])
    other = anchors["label"][:, None] != rows["label"]
    upper = anchors["upper"]
    for slot in range(upper.shape[1] - 1):
        inside = other & (score <= upper[:, slot, None]) & (score > upper[:, slot + 1, None])
        inside &= (slot < anchors["slots"])[:, None]
        row, column = best(score, inside, k)
        yield np.full(len(row), slot, np.int32), row, column, score[row, column]


def _met(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, pick, k: int,
         low: int, high: int) -> DataFrame:
    """(anchor_id, slot, other_id, score): what ``pick`` finds where blocks of anchors meet shards."""
    place = F.xxhash64(F.lit(13), "id")
    held = rows.withColumn("shard", F.pmod(place, F.lit(shards))).groupBy("dims", "shard") \
        .applyInPandas(_shard, "dims int, shard long, rows binary")
    asking = anchors.withColumn("block", F.pmod(place, F.lit(blocks))).groupBy("dims", "block") \
        .applyInPandas(_block(low, high), "dims int, anchors binary").withColumn(
            "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, a in zip(batch.column("rows"), batch.column("anchors")):
                held, asks = pickle.loads(r.as_py()), pickle.loads(a.as_py())
                for slot, row, column, score in pick(asks, held, k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asks["id"][row]), pa.array(slot),
                         pa.array(held["id"][column]), pa.array(score)],
                        ["anchor_id", "slot", "other_id", "score"])

    # as many partitions as shards: scoring takes long for its few bytes
    keys = ["dims", "shard"]
    found = held.repartition(shards, *keys).join(asking.repartition(shards, *keys), keys) \
        .select("rows", "anchors").mapInArrow(
            run, "anchor_id long, slot int, other_id long, score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "other_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5,
                   negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, key: str = "vec_id",
                   label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` makes the condition on the id that marks anchors. A component x becomes
    floor(scale * x), held to the range of a long, and so is the score, the inner product of
    whole numbers. The positives of an anchor are the best other rows of its label; for each of
    them the best rows of other labels between ``low`` and ``high`` percent (bounds included) of
    its score are returned. Higher scores come first, ties go to the smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component take no part;
    zero and empty vectors do. Vectors of different length never meet. Rows that repeat an id
    count once (the smallest label, then the smallest vector). No rows or no anchors, no result.
    Every shard and block is of bounded size; what leaves a task is ``negatives`` rows per slot.
    """
    number = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    part = F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector))
    rows = vectors.where(part).select(
        F.col(key).cast("long").alias("id"),
        F.struct(F.col(label).alias("label"), number.alias("c")).alias("row")) \
        .groupBy("id").agg(F.min("row").alias("row")) \
        .select("id", "row.label", "row.c").withColumn("dims", F.size("c"))
    rows = stored(rows)     # read five times below
    anchors = rows.where(is_anchor(F.col("id")))
    total, asked = rows.agg(F.count("*"), F.count_if(is_anchor(F.col("id")))).first()
    shards, blocks = -(-total // shard_rows) or 1, -(-asked // block_rows) or 1

    near = stored(_met(rows, anchors, shards, blocks, _positives_in, positives, low, high).select(
        "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # an anchor has a handful of positives
    asked_scores = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.collect_list("positive_score").alias("positive_scores"))
    slots = _met(rows, anchors.join(asked_scores, "id"), shards, blocks, _slots_in, negatives, low, high)

    # at most ``negatives`` rows of each of at most ``positives`` slots of one anchor
    entry = F.struct("slot", F.col("place"), F.col("other_id").alias("id"), "score")
    falling = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(entry)).alias("falling"))
    wide = "decimal(38,0)"     # a percentage of a score may not fit a long
    score = F.col("positive_score").cast(wide)
    upper = Window.partitionBy("anchor_id").orderBy(F.desc(F.floor(score * high / 100)))
    windows = near.where("positive_score >= 0").withColumn("own", F.dense_rank().over(upper) - 1)
    suffix = F.slice(F.filter("falling", lambda e: e["slot"] >= F.col("own")), 1, negatives)
    met = windows.join(falling, "anchor_id").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(suffix).alias("at", "e"))
    return met.where(F.col("e.score").cast(wide) * 100 >= score * low).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"),
        F.col("e.id").alias("negative_id"), "positive_score",
        F.col("e.score").alias("negative_score"))


ORACLE_SQL = """
WITH held AS (
  SELECT vec_id AS id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, r.id AS other_id, a.label = r.label AS same,
         list_inner_product(a.c, r.c)::BIGINT AS score
  FROM held a JOIN held r ON a.id <> r.id WHERE a.id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                          ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
