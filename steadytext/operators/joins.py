"""Pair joins, label lookup and set operations with explicit order rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from steadytext.functions.hashing import digest
from steadytext.operators.frames import distinct_texts, join_by_text, join_lookup, text_key


def latest_label(rows: DataFrame, text: str = "text", label: str = "sentiment",
                 id_col: str = "sample_id") -> DataFrame:
    """One label per text: the one of the highest id wins."""
    return rows.where(F.col(text).isNotNull()).groupBy(text_key(text).alias("_text_key")).agg(
        F.first(text).alias(text), F.max_by(label, id_col).alias(label)).drop("_text_key")


def lookup_label(pairs: DataFrame, rows: DataFrame, on: str = "orig", text: str = "text",
                 label: str = "sentiment", id_col: str = "sample_id") -> DataFrame:
    """Add the label of the source text; an unknown source gets null."""
    lookup = latest_label(rows, text, label, id_col).withColumnRenamed(text, on)
    return join_by_text(pairs, lookup, on)


def first_pert(pairs: DataFrame, order: Sequence[str] = ("sample_id", "method_ord")) -> DataFrame:
    """One ``pert`` per ``orig``: the first in the given order."""
    return pairs.groupBy(text_key("orig").alias("_text_key")).agg(F.first("orig").alias("orig"), F.min_by(
        "pert", F.struct(*[F.col(c) for c in order])).alias("pert")).drop("_text_key")


def join_pairs(rows: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """Inner join of rows with the pairs of their text; equal texts all match."""
    return join_by_text(rows, pairs.withColumn(text, F.col("orig")), text, "inner")


def keep_known(pairs: DataFrame, rows: DataFrame, text: str = "text") -> DataFrame:
    """Pairs whose source text is among the rows.

    The texts are made distinct first, so a text held by very many rows counts once.
    """
    known = rows.filter(F.col(text).isNotNull()).select(text_key(text).alias("_text_key")).distinct()
    keyed = pairs.withColumn("_text_key", text_key("orig"))
    return join_lookup(keyed, known, ["_text_key"], "inner").select(*pairs.columns)


def drop_used(rows: DataFrame, used: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Rows whose id is not used; duplicates of unused rows stay."""
    return rows.join(used.select(id_col), id_col, "left_anti")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return distinct_texts(pairs, "orig", "pert")


def external_rewrite(rows: DataFrame, rewrites: DataFrame, text: str = "text",
                     out: str = "rewrite") -> DataFrame:
    """Supplied rewrite of each text, or the text itself where none is supplied."""
    supplied = rewrites.groupBy(text_key("orig").alias("_text_key")).agg(F.min("rewrite").alias("_rewrite"))
    joined = join_lookup(rows.withColumn("_text_key", text_key(text)), supplied, ["_text_key"])
    return joined.select(*rows.columns,
                         F.coalesce(F.col("_rewrite"), F.col(text)).alias(out))


def pick_one_pert(candidates: DataFrame, seed=0, id_col: str = "sample_id") -> DataFrame:
    """One random passed candidate per text, null where none passed."""
    rank = F.when(F.col("passed"), digest(seed, F.col(id_col), F.col("method")))
    return candidates.groupBy(id_col).agg(F.min_by("pert", rank).alias("pert"))
