"""Language identification from averaged hashed subword embeddings.

A text is the mean of the embeddings of its subwords (hashed byte runs of two to four bytes,
word borders included); a linear softmax reads the language from the mean. Embeddings and
softmax are trained together by stochastic gradient descent in numpy. A temperature and a
rejection threshold are set by cross-fitting: on labelled texts, each kept out of the fit that scores it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from steadytext.llm.sampling import sampled_by_class, train_in_one_task
from steadytext.llm.scan import LETTER, byte_kinds, lower_bytes, pieces, text_bytes

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
SAMPLE_PER_LANGUAGE = 600
UNKNOWN = "und"


def subwords(column: pa.Array, buckets: int = BUCKETS) -> tuple[list, list]:
    """Per order, the bucket of every subword in order; and the bounds of the texts in it.

    ASCII letters are lowered; every byte that belongs to no letter-like run is a border.
    """
    data, offsets = text_bytes(column)
    n, pad = len(offsets) - 1, max(ORDERS) - 1
    kinds, lower = byte_kinds(), lower_bytes()
    letter = kinds == LETTER
    table = np.where(letter, lower, 0).astype(np.uint8)
    # borders stand before every text, so that no subword reaches into the next one
    at = np.arange(len(data)) + np.repeat(pad * np.arange(1, n + 1), np.diff(offsets))
    wide = np.zeros(len(data) + pad * (n + 1), np.uint8)
    wide[at] = table[data]
    bounds = offsets + pad * np.arange(n + 1)
    is_letter = wide != 0
    found, edges = [], []
    for order in ORDERS:
        count = len(wide) - pad
        key = np.zeros(count, np.uint32)
        for i in range(order):
            key = (key << np.uint32(8)) | wide[i:i + count]
        seen = np.flatnonzero(is_letter[:count] | is_letter[1:count + 1])
        key = key[seen] * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B * order & 0xFFFFFFFF)
        key ^= key >> np.uint32(15)
        found.append(((key * np.uint32(0x2C1B3C6D)) >> np.uint32(12)) % np.uint32(buckets))
        edges.append(np.searchsorted(seen, bounds))
    return found, edges


def _features(batches: Iterator[pa.RecordBatch], text: str, label: str) -> Iterator[pa.RecordBatch]:
    """(label, sparse counts) of every text."""
    for piece in pieces(batches, text):
        found, edges = subwords(piece.column(text))
        rows = []
        for d in range(piece.num_rows):
            place, count = [], []
            for i, (f, e) in enumerate(zip(found, edges)):
                b, c = np.unique(f[e[d]:e[d + 1]].astype(np.int64), return_counts=True)
                place.append(b + i * BUCKETS)
                count.append(c)
            rows.append(pickle.dumps((np.concatenate(place).astype(np.int32),
                                      np.concatenate(count).astype(np.float32))))
        yield pa.RecordBatch.from_arrays(
            [piece.column(label), pa.array(rows, pa.binary())], ["label", "features"])


def _descend(fit: list, n_languages: int, width: int, epochs: int, rate: float,
             draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The score of every subword for every language, and the bias, from (language, places, shares)."""
    table = draw.normal(0, 0.1, (len(ORDERS) * BUCKETS, width)).astype(np.float32)
    head, bias = np.zeros((width, n_languages), np.float32), np.zeros(n_languages)
    head += draw.normal(0, 0.1, head.shape)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for at in draw.permutation(len(fit)):
            y, place, value = fit[at]
            step = rate * (1 - done / steps)
            done += 1
            rows_ = table[place]
            mean = value @ rows_
            p = np.exp((z := mean @ head + bias) - z.max())
            p /= p.sum()
            p[y] -= 1
            back = head @ p
            # a text of few subwords would move its mean too far: its step is shorter
            most = 0.5 * (step / rate) / float(value @ value)
            table[place] = rows_ - min(step * 25, most) * np.outer(value, back).astype(np.float32)
            head -= (step * 0.1) * np.outer(mean, p).astype(np.float32)
            bias -= step * 0.01 * p
    return (table @ head).astype(np.float32), bias


def train(rows: Sequence[tuple[str, bytes]], width: int = 10, epochs: int = 8, rate: float = 4.0,
          kept_out: int = 8, reject_share: float = 0.002, seed: int = 5) -> dict:
    """The model: languages, the score of every subword, temperature and threshold.

    The rows are dealt into ``kept_out`` parts, and every part is scored by a fit that has not seen
    it; the first of these fits is the model. All rows together set the temperature (least log
    loss) and the threshold: a true text of a known language falls below it in about
    ``reject_share`` of cases, by the rank of the probabilities of the true languages. Between ranks,
    and below the first one where the rows are fewer than 1 / ``reject_share``, the threshold is
    interpolated; rank 0 is probability 0.
    """
    rows = sorted(rows)
    languages = sorted({r[0] for r in rows})
    if not languages:
        return {"languages": [], "table": np.zeros((len(ORDERS) * BUCKETS, 0), np.float32),
                "bias": np.zeros(0), "scale": 1.0, "threshold": 0.0}
    data = [(languages.index(x), *pickle.loads(f)) for x, f in rows]
    data = [(y, i, v / v.sum()) for y, i, v in data if len(i)]
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(data))
    model, z, y = {}, np.zeros((0, len(languages))), np.zeros(0, int)
    for part in range(max(1, min(kept_out, len(data)))):
        test = [data[i] for i in order[part::kept_out]]
        fit = [data[i] for n, i in enumerate(order) if n % kept_out != part] or test
        scores, bias = _descend(fit, len(languages), width, epochs, rate,
                                np.random.default_rng((seed, part)) if part else draw)
        model = model or {"languages": languages, "table": scores, "bias": bias}
        z = np.vstack([z, *(v @ scores[i] + bias for _, i, v in test)])
        y = np.append(y, [t[0] for t in test]).astype(int)

    def log_p(scale: float) -> np.ndarray:
        s = z * scale
        return s - s.max(1, keepdims=True) - np.log(
            np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True))

    scales = np.geomspace(0.02, 20, 60)
    at = np.arange(len(y))
    model["scale"] = float(min(scales, key=lambda s: -log_p(s)[at, y].mean())) if len(y) else 1.0
    true = np.sort(np.exp(log_p(model["scale"])[at, y]))
    # a language that is likelier than all others together is never rejected
    model["threshold"] = min(0.5, float(np.interp(reject_share * (len(true) + 1),
                                                  np.arange(len(true) + 1), np.r_[0, true])))
    return model


def probabilities(column: pa.Array, model: dict) -> np.ndarray:
    """Calibrated probability of every language for every text; equal where no subword is known."""
    found, edges = subwords(column)
    n, k = len(column), len(model["languages"])
    total, count = np.zeros((n, k)), np.zeros(n)
    for i, (f, e) in enumerate(zip(found, edges)):
        size = np.diff(e)
        count += size
        full = np.flatnonzero(size)
        if len(full):
            for c in range(k):
                part = model["table"][i * BUCKETS:(i + 1) * BUCKETS, c]
                total[full, c] += np.add.reduceat(
                    np.ascontiguousarray(part)[f], e[:-1][full], dtype=np.float64)
    z = (total / np.maximum(count, 1)[:, None] + model["bias"]) * model["scale"]
    p = np.exp(z - z.max(1, keepdims=True)) if k else z
    return p / p.sum(1, keepdims=True) if k else p


def fit_language(labelled: DataFrame, text: str = "text", label: str = "lang",
                 key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> dict:
    """Train on about ``per_language`` texts of every language, drawn by a hash of ``key``.

    The bound is a parameter of the fit; rows without a label or text take no part. The sample's
    features, not its texts, meet in one task.
    """
    sample = sampled_by_class(labelled.where(F.col(text).isNotNull()), label, key, per_language)
    rows = sample.select(F.col(label).cast("string").alias(label), text).mapInArrow(
        lambda batches: _features(batches, text, label), "label string, features binary")
    return train_in_one_task(rows, train)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: dict, text: str = "text", lang: str = "lang_pred",
            score: str = "lang_score", rejected: str = "lang_rejected") -> DataFrame:
    """``docs`` with the language, its calibrated probability and whether it is rejected.

    A null text, a text without a letter, and every text if no language was learned, is
    ``und`` with score 0 and rejected; otherwise a text is rejected below the model's threshold.
    Equal probabilities go to the first language by code point. Columns of these names are
    replaced.
    """
    mark = "_has_letter"
    kept = [c for c in docs.columns if c not in (lang, score, rejected, mark)]
    schema = StructType([docs.schema[c] for c in kept] + [
        StructField(lang, StringType()), StructField(score, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known["languages"], UNKNOWN], object)
        for piece in pieces(batches, text):
            letters = piece.column(mark).to_numpy(zero_copy_only=False).astype(bool)
            if known["languages"]:
                p = probabilities(piece.column(text), known)
                best, value = p.argmax(1), p.max(1)
            else:
                best, value = np.zeros(piece.num_rows, int), np.zeros(piece.num_rows)
            name = names[np.where(letters, best, -1)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in kept] + [pa.array(name.tolist(), pa.string()),
                                                   pa.array(np.where(letters, value, 0.0))],
                [*kept, lang, score])

    marked = docs.select(*kept, has_letter(F.col(text)).alias(mark))
    return marked.mapInArrow(run, schema).withColumn(
        rejected, (F.col(lang) == UNKNOWN) | (F.col(score) < F.lit(model["threshold"])))
