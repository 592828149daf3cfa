"""Bounded samples of labelled rows, and fits in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from steadytext.llm.storage import stored


def fold(key: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the key as text, modulo ``parts``; null stays null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def sampled_by_class(rows: DataFrame, label: str, key: str, per_class: int,
                     seed: int = 11) -> DataFrame:
    """About ``per_class`` rows of every label, all of a rarer one; null labels take no part.

    A row is kept if its hash lies below the class's share, so the choice is the same on every
    run, and no class, however large, is sorted or gathered. The driver holds one count per label.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = rows.groupBy(label).count().collect()
    span = 1 << 40
    share = F.lit(0)
    for value, n in counts:
        share = F.when(F.col(label) == F.lit(value),
                       F.lit(min(span, span * per_class // n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(span))
    return rows.where(place < share)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str,
                    per_class: int) -> DataFrame:
    """(label, text) of about ``per_class`` labelled documents of every label.

    The labels are sampled before they meet the documents, so what is broadcast has at most
    about ``per_class`` rows of every label, and no text is shuffled. Labels without a document, null
    keys and null labels take no part. The result is a written table.
    """
    few = sampled_by_class(labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")),
                           "_label", "_key", per_class)
    return stored(docs.select(key, F.col(text).alias("_text")).join(
        F.broadcast(few), F.col(key) == F.col("_key")).select(
            F.col("_label").alias(label), F.col("_text").alias(text)))


def train_in_one_task(rows: DataFrame, train: Callable):
    """Call ``train`` with the tuples of a bounded table inside one task; return its model.

    Only the model comes to the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [row for batch in batches
                for row in zip(*(column.to_pylist() for column in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(seen))], pa.binary())],
                                         ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else train([])
