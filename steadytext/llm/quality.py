"""Quality scores by hashed word n-gram logistic regression, fitted by FTRL.

Words and word pairs are hashed into buckets; a text's features are its buckets' shares of
all its n-grams. Weights come from follow-the-regularised-leader updates, one text at a
time, which leave most weights exactly zero. A score is the logistic of a sparse dot product.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from steadytext.llm.sampling import labelled_sample, train_in_one_task
from steadytext.llm.scan import Powers, byte_kinds, pieces
from steadytext.llm.words import ngram_buckets, per_document

BUCKETS = 1 << 18
SAMPLE_PER_LABEL = 2000
GAIN = 10.0            # shares are small numbers; features are this multiple of them


def _features(batches: Iterator[pa.RecordBatch], text: str, label: str) -> Iterator[pa.RecordBatch]:
    kinds, powers = byte_kinds(), Powers()
    for piece in pieces(batches, text):
        doc, bucket, count = per_document(*ngram_buckets(piece.column(text), kinds, powers,
                                                         BUCKETS), BUCKETS)
        edge = np.searchsorted(doc, np.arange(piece.num_rows + 1))
        rows = [pickle.dumps((bucket[a:b].astype(np.int32), count[a:b].astype(np.float32)))
                for a, b in zip(edge, edge[1:])]
        yield pa.RecordBatch.from_arrays(
            [piece.column(label), pa.array(rows, pa.binary())], ["label", "features"])


def train(rows: Sequence[tuple[int, bytes]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0,
          l1: float = 0.05, l2: float = 0.1, seed: int = 3, ones: float | None = None) -> dict:
    """Weights and bias by FTRL-proximal; classes weigh alike in the fit.

    The bias is shifted afterwards so that the mean score of the rows is their share of ones.
    ``ones``: that share in the population, if the rows are sampled otherwise; they are weighed
    to match it. Without rows every score is 0.5.
    """
    data = [(int(y), *pickle.loads(f)) for y, f in sorted(rows)]
    data = [(y, i, GAIN * v / max(v.sum(), 1)) for y, i, v in data]
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    zb = nb = 0.0
    share = np.bincount([d[0] for d in data], minlength=2) / max(len(data), 1)
    draw = np.random.default_rng(seed)

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for k in draw.permutation(len(data)):
            y, at, value = data[k]
            w, b = weights(at), -zb / ((beta + nb ** 0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ value + b, -35, 35)))
            g = (p - y) * 0.5 / max(share[y], 1e-9)
            for_each = g * value
            s = (np.sqrt(n[at] + for_each ** 2) - np.sqrt(n[at])) / alpha
            z[at] += for_each - s * w
            n[at] += for_each ** 2
            zb += g - ((nb + g * g) ** 0.5 - nb ** 0.5) / alpha * b
            nb += g * g
    weight, bias = weights(slice(None)), -zb / ((beta + nb ** 0.5) / alpha)
    if len(data):
        raw = np.array([weight[i] @ v for _, i, v in data])
        y = np.array([d[0] for d in data])
        if ones is None or not 0 < share[1] < 1:
            ones = share[1]
        each = np.where(y == 1, ones / max(share[1], 1e-9), (1 - ones) / max(share[0], 1e-9))
        low, high = -50.0, 50.0
        for _ in range(60):
            bias = (low + high) / 2
            mean = (each / (1 + np.exp(-np.clip(raw + bias, -35, 35)))).mean()
            low, high = (bias, high) if mean < ones else (low, bias)
    return {"weight": weight.astype(np.float32), "bias": float(bias)}


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality",
                key: str = "doc_id", per_label: int = SAMPLE_PER_LABEL) -> dict:
    """Fit on about ``per_label`` documents of either label, drawn by a hash of ``key``.

    The mean score is set to the share of ones among all labels, whatever the sample holds. Labels other than 0 and 1, and null labels, take no part; a null text is empty.
    """
    rows = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias(label))
    ones = rows.agg(F.avg(label)).first()[0]
    found = labelled_sample(docs, rows, label, key, text, per_label).mapInArrow(
        lambda batches: _features(batches, text, label), "label int, features binary")
    return train_in_one_task(found, lambda data: train(data, ones=ones))


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """The other columns of ``docs`` with the score of the whole text, 0 to 1, in place of ``text``.

    A null or empty text has the bias alone. Equal texts have equal scores.
    """
    kept = [c for c in docs.columns if c not in (text, out)]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(out, DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value["weight"], shared.value["bias"]
        kinds, powers = byte_kinds(), Powers()
        for piece in pieces(batches, text):
            bucket, doc = ngram_buckets(piece.column(text), kinds, powers, BUCKETS)
            size = np.bincount(doc, minlength=piece.num_rows)
            dot = np.bincount(doc, weight[bucket], piece.num_rows)
            raw = GAIN * dot / np.maximum(size, 1) + bias
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in kept]
                + [pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))], [*kept, out])

    return docs.select(*kept, text).mapInArrow(run, schema)
