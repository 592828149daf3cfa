"""Toxicity severity by cumulative-link ordinal regression over hashed words.

P(grade <= j) = logistic(threshold_j - w.x): one weight vector is shared by all ordered
thresholds, and the expected severity is the sum of P(grade > j). Features are hashed words
and word beginnings that mark toxic texts far beyond chance; all others weigh exactly zero, so
the length of a clean text does not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from steadytext.llm.sampling import labelled_sample, train_in_one_task
from steadytext.llm.scan import Powers, byte_kinds, lower_bytes, pieces
from steadytext.llm.words import per_document, word_parts

BUCKETS = 1 << 22
SAMPLE_PER_LABEL = 3000
EVIDENCE = 25.0        # log-likelihood ratio from which a feature counts
FEATURES = 4096
CLEAN_KEPT = 0.9999    # share of clean texts of the fit below the rejection threshold
MARGIN = 1.1           # the threshold stands so far above them


def _parts(batches: Iterator[pa.RecordBatch], text: str):
    kinds, lowered, powers = byte_kinds(), lower_bytes(), Powers()
    for piece in pieces(batches, text):
        yield piece, *per_document(*word_parts(piece.column(text), lowered, kinds, powers,
                                               BUCKETS), BUCKETS)


def telling_features(labelled: DataFrame, text: str, label: str) -> np.ndarray:
    """Buckets that occur in more texts of label 1 than chance allows, the strongest first.

    A bucket's share of the texts of label 1 must be more than twice its share of the others,
    however many of either the sample holds. Texts are counted per bucket and label: each task
    counts its own, Spark sums them up.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, doc, bucket, _ in _parts(batches, text):
            y = piece.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
            key, ones = bucket[np.argsort(bucket, kind="stable")], None
            if not len(key):
                continue
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ones = np.add.reduceat(y[doc[order]], first)
            both = np.diff(np.append(first, len(key)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first]), pa.array(ones), pa.array(both)], ["bucket", "ones", "both"])

    rows = labelled.select(F.col(label).cast("long").alias(label), text)
    total = rows.agg(F.sum(label).alias("ones"), F.count("*").alias("both")).first()
    n1, n = float(total["ones"] or 0), float(total["both"])
    if not 0 < n1 < n:
        return np.zeros(0, np.int64)
    share = n1 / n
    counted = rows.mapInArrow(run, "bucket long, ones long, both long").groupBy("bucket").agg(
        F.sum("ones").alias("k"), F.sum("both").alias("m"))
    zeros = F.col("m") - F.col("k")
    gain = 2 * (F.col("k") * F.log(F.col("k") / (F.col("m") * share))
                + F.when(zeros > 0, zeros * F.log(zeros / (F.col("m") * (1 - share)))).otherwise(0.0))
    top = counted.where(F.col("k") * (n - n1) > 2 * zeros * n1).withColumn("gain", gain) \
        .where(F.col("gain") >= EVIDENCE).orderBy(F.desc("gain"), "bucket").limit(FEATURES)
    return np.array([r["bucket"] for r in top.select("bucket").collect()], np.int64)


def counts(docs: DataFrame, features: np.ndarray, text: str = "text",
           out: str = "features") -> DataFrame:
    """``docs`` without ``text``, with (feature number, count) pairs of the telling features."""
    kept = [c for c in docs.columns if c not in (text, out)]
    order = np.argsort(features)
    sorted_ = features[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, doc, bucket, count in _parts(batches, text):
            doc, number, count = _known(doc, bucket, count, sorted_, order)
            edge = np.searchsorted(doc, np.arange(piece.num_rows + 1))
            rows = [pickle.dumps((number[a:b], count[a:b])) for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in kept] + [pa.array(rows, pa.binary())], [*kept, out])

    schema = StructType([docs.schema[c] for c in kept])
    return docs.select(*kept, text).mapInArrow(run, schema.add(out, "binary"))


def _known(doc, bucket, count, sorted_, order):
    """The triples whose bucket is a feature, buckets replaced by feature numbers."""
    if not len(sorted_):
        none = np.zeros(0, np.int64)
        return none, none, none
    place = np.minimum(np.searchsorted(sorted_, bucket), len(sorted_) - 1)
    hit = sorted_[place] == bucket
    return doc[hit], order[place[hit]], count[hit]


def grades(rows: Sequence[tuple[int, bytes]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Severity grades of labelled rows: 0 clean, 1 toxic, 2 toxic with more marks than most.

    The table labels toxic or not. A toxic text's severity is its number of telling words: above
    the median of the toxic texts it is grade 2.
    """
    data = [(int(y), *pickle.loads(f)) for y, f in sorted(rows)]
    marks = [int(c.sum()) for y, _, c in data if y]
    middle = float(np.median(marks)) if marks else 0.0
    return [(y + (y and int(c.sum() > middle)), i, c) for y, i, c in data]


def fit_ordinal(data: Sequence[tuple[int, np.ndarray, np.ndarray]], n_features: int,
                share: float | None = None, steps: int = 400, rate: float = 0.5, l2: float = 1e-3) -> dict:
    """Shared weights and ordered thresholds by gradient descent (Adam) on the likelihood.

    data: (grade, feature numbers, counts); grades run from 0. A feature's value is
    log2(1 + count). ``share``: the share of grades above 0 in the population, if the rows are
    sampled otherwise; they are weighed to match it. ``cut`` is the probability of any toxicity from
    which a text is rejected: just above nearly all clean texts of the fit. Thresholds are kept in order by positive gaps. Without rows, or with one
    grade only, nothing is ever severe.
    """
    top = max((g for g, _, _ in data), default=0)
    if top == 0:
        return {"weight": np.zeros(n_features), "thresholds": np.full(1, 35.0), "cut": 0.5}
    grade = np.array([g for g, _, _ in data])
    row = np.repeat(np.arange(len(data)), [len(i) for _, i, _ in data])
    col = np.concatenate([i for _, i, _ in data]).astype(np.int64)
    value = np.log2(1 + np.concatenate([c for _, _, c in data]).astype(float))
    seen = (grade > 0).mean()
    weight_of = np.ones(len(data)) if share is None else np.where(
        grade > 0, share / seen, (1 - share) / max(1 - seen, 1e-9))
    par = np.zeros(n_features + top)             # weights, first threshold, log gaps
    par[n_features] = 1.0
    m, v = np.zeros_like(par), np.zeros_like(par)

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

    def thresholds():
        return par[n_features] + np.r_[0, np.cumsum(np.exp(par[n_features + 1:]))]

    for t in range(1, steps + 1):
        x = np.bincount(row, par[col] * value, len(data))
        edge = np.r_[-np.inf, thresholds(), np.inf]
        up, low = sigmoid(edge[grade + 1] - x), sigmoid(edge[grade] - x)
        p = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / p * weight_of, low * (1 - low) / p * weight_of
        d_up[grade == top], d_low[grade == 0] = 0, 0
        g = np.zeros_like(par)
        g[:n_features] = np.bincount(col, (d_up - d_low)[row] * value, n_features)
        d_edge = np.bincount(grade, -d_up, top + 1)[:top] + np.bincount(
            grade, d_low, top + 1)[1:top + 1]
        g[n_features] = d_edge.sum()
        for j in range(1, top):
            g[n_features + j] = d_edge[j:].sum() * np.exp(par[n_features + j])
        g = g / len(data)
        g[:n_features] += l2 * par[:n_features]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8) * 0.2
    clean = sigmoid(np.bincount(row, par[col] * value, len(data)) - par[n_features])[grade == 0]
    cut = min(0.5, MARGIN * float(np.quantile(clean, CLEAN_KEPT))) if len(clean) else 0.5
    return {"weight": par[:n_features].copy(), "thresholds": thresholds(), "cut": cut}


def fit_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic",
                 key: str = "doc_id", per_label: int = SAMPLE_PER_LABEL) -> dict:
    """Fit on about ``per_label`` documents of either label, weighed as all labels are shared out.

    Labels other than 0 and 1, null labels and null texts take no part.
    """
    rows = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias(label))
    share = rows.agg(F.avg(label)).first()[0]
    sample = labelled_sample(docs.where(F.col(text).isNotNull()), rows, label, key, text, per_label)
    features = telling_features(sample, text, label)
    found = counts(sample.select(label, text), features, text)
    model = train_in_one_task(found, lambda data: fit_ordinal(grades(data), len(features), share))
    return model | {"features": features}


def severity(docs: DataFrame, model: dict, text: str = "text", expected: str = "severity",
             toxic: str = "p_toxic", rejected: str = "rejected") -> DataFrame:
    """``docs`` with the expected severity grade, the probability of any toxicity, and whether it
    reaches the model's cut.

    A null or empty text has no feature, like any text without a telling word. Columns of
    these names are replaced.
    """
    kept = [c for c in docs.columns if c not in (expected, toxic, rejected)]
    schema = StructType([docs.schema[c] for c in kept] + [
        StructField(expected, DoubleType(), False), StructField(toxic, DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        order = np.argsort(known["features"])
        sorted_ = known["features"][order]
        marked = np.zeros(BUCKETS, bool)
        marked[sorted_] = True
        kinds, lowered, powers = byte_kinds(), lower_bytes(), Powers()
        for piece in pieces(batches, text):
            bucket, doc = word_parts(piece.column(text), lowered, kinds, powers, BUCKETS)
            hit = marked[bucket]
            doc, bucket, count = per_document(bucket[hit], doc[hit], BUCKETS)
            doc, number, count = _known(doc, bucket, count, sorted_, order)
            x = np.bincount(doc, known["weight"][number] * np.log2(1.0 + count), piece.num_rows)
            above = 1 / (1 + np.exp(np.clip(known["thresholds"][None, :] - x[:, None], -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in kept]
                + [pa.array(above.sum(1)), pa.array(above[:, 0])], [*kept, expected, toxic])

    return docs.select(*kept).mapInArrow(run, schema).withColumn(
        rejected, F.col(toxic) >= F.lit(model["cut"]))
