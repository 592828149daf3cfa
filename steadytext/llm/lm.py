"""Masked pseudo-likelihood of documents by a bidirectional window network.

Every word is predicted from two words on either side of it: their embeddings, one table per
place, are summed and squashed, and a two-level softmax (class, then word in the class) reads
the hidden word from the result. The sum of these conditional log-probabilities is a document's
pseudo-log-likelihood. Words are counted over the whole corpus. Training is data-parallel: every
task masks words of all its documents and trains its own copy of the network in numpy, and
Spark averages the copies, weighted by the words they saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from steadytext.llm.sampling import train_in_one_task
from steadytext.llm.scan import (Powers, byte_kinds, lower_bytes, pieces, span_hashes, text_bytes,
                                 token_spans)
from steadytext.llm.storage import stored

CLASSES, IN_CLASS = 32, 32
WORDS = CLASSES * IN_CLASS     # outputs of the network
RARE = 128                     # the last of them stand for all words beyond the most frequent
WIDTH = 16
PLACES = (-2, -1, 1, 2)
EDGE = WORDS                   # context beyond the text
MASKED = 0.15                  # share of words hidden in the training pass
WARM_DOCS = 1000               # documents of the first fit in one task
BATCH = 4096
SLICES = 8


class Reader:
    """Word hashes of pieces of text: runs of letters, digits or signs, A-Z lowered."""

    def __init__(self) -> None:
        self.kinds, self.lower, self.powers = byte_kinds(), lower_bytes(), Powers()

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hash as int64, document) of every word in order."""
        data, offsets = text_bytes(column)
        data = self.lower[data]
        start, end, doc = token_spans(data, offsets, self.kinds)
        return span_hashes(data, start, end, self.powers).view(np.int64), doc


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; tasks add up their own words before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        held, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merge(words: np.ndarray, counts: np.ndarray):
            order = np.argsort(words, kind="stable")
            words, counts = words[order], counts[order]
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else []
            return words[first], np.add.reduceat(counts, first) if len(words) else counts

        for piece in pieces(batches, text):
            words, _ = reader.words(piece.column(text))
            new, k = merge(words, np.ones_like(words))
            held, n = merge(np.concatenate([held, new]), np.concatenate([n, k]))
            if len(held) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], ["word", "n"])
                held, n = held[:0], n[:0]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n)], ["word", "n"])

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


class Vocabulary:
    """The most frequent words by rank; all others share ``RARE`` outputs by hash.

    ``spread`` is the log of the number of words behind every output, by which the
    probability of a shared output is divided.
    """

    def __init__(self, sorted_words: np.ndarray, rank: np.ndarray, spread: np.ndarray) -> None:
        self.sorted, self.rank, self.spread = sorted_words, rank, spread

    def data(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What to build it from again in a task."""
        return self.sorted, self.rank, self.spread

    def ids(self, words: np.ndarray) -> np.ndarray:
        rare = WORDS - RARE + np.mod(words, RARE)
        if not len(self.sorted):
            return rare
        place = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[place] == words, self.rank[place], rare)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The driver holds the ``WORDS - RARE`` most frequent words and one number per shared output."""
    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(WORDS - RARE).collect()]
    sizes = {r["b"]: r["count"] for r in counts.groupBy(
        F.pmod("word", F.lit(RARE)).alias("b")).count().collect()}
    for word in top:
        sizes[word % RARE] -= 1
    spread = np.zeros(WORDS)
    for bucket, n in sizes.items():
        spread[WORDS - RARE + bucket] = np.log(max(n, 1))
    order = np.argsort(np.array(top, np.int64))
    return Vocabulary(np.array(top, np.int64)[order], order.astype(np.int64), spread)


def windows(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(words, places) ids around every word; beyond the text stands ``EDGE``."""
    out = np.full((len(ids), len(PLACES)), EDGE, np.int64)
    for k, step in enumerate(PLACES):
        a, b = (slice(-step, None), slice(None, step)) if step < 0 else \
            (slice(None, -step), slice(step, None))
        if len(ids) > abs(step):
            same = doc[a] == doc[b]
            out[a, k] = np.where(same, ids[b], EDGE)
    return out


class Network:
    """Parameters: one flat float32 vector with named views."""

    SHAPES = {"place": (len(PLACES), WORDS + 1, WIDTH), "bias": (WIDTH,),
              "to_class": (WIDTH, CLASSES), "class_bias": (CLASSES,),
              "to_word": (CLASSES, WIDTH, IN_CLASS), "word_bias": (CLASSES, IN_CLASS)}

    def __init__(self, flat: np.ndarray | None = None) -> None:
        size = sum(int(np.prod(s)) for s in self.SHAPES.values())
        if flat is None:
            flat = np.random.default_rng(1).normal(0, 0.1, size).astype(np.float32)
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at:at + n].reshape(shape))
            at += n

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.place[0][context[:, 0]]
        for k in range(1, len(PLACES)):
            h = h + self.place[k][context[:, k]]
        h += self.bias
        return np.tanh(h, out=h)

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of every target in its context."""
        out = np.zeros(len(target), np.float32)
        for at in range(0, len(target), BATCH * 4):
            h = self.hidden(context[at:at + BATCH * 4])
            word = target[at:at + BATCH * 4]
            z = h @ self.to_class
            z += self.class_bias
            group = word // IN_CLASS
            p = z[np.arange(len(z)), group] - _log_sum(z)
            order = np.argsort(group.astype(np.int8), kind="stable")
            edge = np.searchsorted(group[order], np.arange(CLASSES + 1))
            for c in range(CLASSES):
                rows = order[edge[c]:edge[c + 1]]
                if len(rows):
                    y = h[rows] @ self.to_word[c]
                    y += self.word_bias[c]
                    p[rows] += y[np.arange(len(rows)), word[rows] % IN_CLASS] - _log_sum(y)
            out[at:at + BATCH * 4] = p
        return out

    def step(self, context: np.ndarray, target: np.ndarray, squares: "Network",
             rate: float) -> None:
        """One Adagrad step on the mean log loss of a batch."""
        n = len(target)
        h = self.hidden(context)
        group = target // IN_CLASS
        dz = _softmax(h @ self.to_class + self.class_bias)
        dz[np.arange(n), group] -= 1
        dz /= n
        dh = dz @ self.to_class.T
        order = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[order], np.arange(CLASSES + 1))
        change = [("to_class", None, h.T @ dz), ("class_bias", None, dz.sum(0))]
        for c in range(CLASSES):
            rows = order[edge[c]:edge[c + 1]]
            if len(rows):
                hc = h[rows]
                dy = _softmax(hc @ self.to_word[c] + self.word_bias[c])
                dy[np.arange(len(rows)), target[rows] % IN_CLASS] -= 1
                dy /= n
                dh[rows] += dy @ self.to_word[c].T
                change += [("to_word", c, hc.T @ dy), ("word_bias", c, dy.sum(0))]
        dh *= 1 - h * h
        change.append(("bias", None, dh.sum(0)))
        for name, at, g in change:
            value, square = getattr(self, name), getattr(squares, name)
            if at is not None:
                value, square = value[at], square[at]
            square += g * g
            value -= rate * g / np.sqrt(square)
        for k in range(len(PLACES)):
            rows, inverse = np.unique(context[:, k], return_inverse=True)
            g = np.zeros((len(rows), WIDTH), np.float32)
            np.add.at(g, inverse, dh)
            squares.place[k][rows] += g * g
            self.place[k][rows] -= rate * g / np.sqrt(squares.place[k][rows])


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return np.log(np.exp(z - top[:, None]).sum(1)) + top


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    return z


class Trainer:
    """Trains one copy of the network on masked words."""

    def __init__(self, flat: np.ndarray | None, rate: float, seed: int) -> None:
        self.net = Network(flat)
        self.squares = Network(np.full(len(self.net.flat), 1e-6, np.float32))
        self.rate, self.seed, self.seen = rate, seed, 0
        self.draw = np.random.default_rng(seed)

    def learn(self, ids: np.ndarray, doc: np.ndarray, share: float) -> None:
        chosen = np.flatnonzero(self.draw.random(len(ids)) < share)
        self.draw.shuffle(chosen)
        context = windows(ids, doc)
        for at in range(0, len(chosen), BATCH):
            rows = chosen[at:at + BATCH]
            self.net.step(context[rows], ids[rows], self.squares, self.rate)
        self.seen += len(chosen)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", warm_docs: int = WARM_DOCS,
        masked: float = MASKED, rate: float = 0.05) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of a corpus.

    A first fit on about ``warm_docs`` documents, drawn by a hash of ``key``, gives all tasks the
    same start. Then every task passes over all its documents, hiding ``masked`` of their words,
    and the copies are averaged. Null and empty texts add nothing; without any word the network
    keeps its random start.
    """
    words = vocabulary(stored(count_words(docs, text)))
    spark = docs.sparkSession
    total = docs.where(F.col(text).isNotNull()).count()
    span = 1 << 40
    few = docs.where(F.pmod(F.xxhash64(F.lit(9), key), F.lit(span))
                     < min(span, span * warm_docs // max(total, 1)))
    shared_words = spark.sparkContext.broadcast(words.data())

    def as_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = Reader(), Vocabulary(*shared_words.value)
        for piece in pieces(batches, text):
            found, doc = reader.words(piece.column(text))
            yield pa.RecordBatch.from_arrays([pa.array(
                [known.ids(found).astype(np.int16).tobytes()], pa.binary()), pa.array(
                [doc.astype(np.int32).tobytes()], pa.binary())], ["ids", "doc"])

    def warm(rows: list[tuple[bytes, bytes]]) -> np.ndarray:
        trainer = Trainer(None, 2 * rate, 1)
        for _ in range(2):
            for ids, doc in sorted(rows):
                trainer.learn(np.frombuffer(ids, np.int16).astype(np.int64),
                              np.frombuffer(doc, np.int32), 0.5)
        return trainer.net.flat

    start = train_in_one_task(few.select(text).mapInArrow(as_ids, "ids binary, doc binary"), warm)
    shared_start = spark.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known, trainer = Reader(), Vocabulary(*shared_words.value), None
        for piece in pieces(batches, text):
            found, doc = reader.words(piece.column(text))
            if trainer is None:      # the seed comes from the data: a rerun of the task agrees
                trainer = Trainer(shared_start.value, rate, int(found[0]) & 0xFFFF
                                  if len(found) else 0)
            trainer.learn(known.ids(found), doc, masked)
        if trainer is not None and trainer.seen:
            parts = np.array_split(trainer.net.flat, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([trainer.seed % 64] * SLICES, pa.int32()),
                 pa.array([trainer.seen] * SLICES, pa.int64()),
                 pa.array([p.tobytes() for p in parts], pa.binary())],
                ["slice", "part", "seen", "weights"])

    schema = "slice int, part int, seen long, weights binary"

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        value = np.stack([np.frombuffer(w, np.float32) for w in rows["weights"]])
        mean = np.average(value.astype(np.float64), axis=0, weights=rows["seen"])
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "part": [rows["part"].iloc[0]],
                             "seen": [rows["seen"].sum()],
                             "weights": [mean.astype(np.float32).tobytes()]})

    copies = docs.select(text).mapInArrow(run, schema)
    mean = copies.groupBy("slice", "part").applyInPandas(average, schema) \
        .groupBy("slice").applyInPandas(average, schema).orderBy("slice").collect()
    flat = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in mean]) if mean else start
    return words, Network(flat)


def score(docs: DataFrame, model: tuple[Vocabulary, Network], text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with ``n_words``, ``log_likelihood`` (the sum of the
    conditional log-probabilities of all words) and ``mean_log_likelihood`` in place of ``text``.

    A null text, or one without words, has no words, sum 0 and a null mean. Equal texts have
    equal scores.
    """
    names = ("n_words", "log_likelihood", "mean_log_likelihood")
    kept = [c for c in docs.columns if c not in (text, *names)]
    schema = StructType([docs.schema[c] for c in kept] + [
        StructField(names[0], LongType(), False), StructField(names[1], DoubleType(), False)])
    words, net = model
    shared = docs.sparkSession.sparkContext.broadcast((words.data(), net.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, network, reader = Vocabulary(*shared.value[0]), Network(shared.value[1]), Reader()
        for piece in pieces(batches, text):
            found, doc = reader.words(piece.column(text))
            ids = known.ids(found)
            log_p = network.log_p(windows(ids, doc), ids) - known.spread[ids]
            n = np.bincount(doc, minlength=piece.num_rows)
            total = np.bincount(doc, log_p, piece.num_rows)
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in kept] + [pa.array(n), pa.array(total)],
                [*kept, *names[:2]])

    return docs.select(*kept, text).mapInArrow(run, schema).withColumn(
        names[2], F.when(F.col(names[0]) > 0, F.col(names[1]) / F.col(names[0])))
