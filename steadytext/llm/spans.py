"""Alignment of the tokens of two tokenizers over the bytes of a text.

The spans that the tokenizers report are coarse cuts: a byte-level tokenizer counts in characters
and gives all parts of a character the same span, a piece tokenizer gives all but the last of
its fallback bytes an empty one. Where spans fall together, the bytes that the tokens
decode to place the cuts inside. Where both tokenizers cut, a group of tokens ends.

Texts are cut at blanks after a visible character, where neither tokenizer's result depends on
the other side, and a task aligns a stretch between two such cuts once however often it occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from steadytext.llm.bpe import _ranges, byte_signs
from steadytext.llm.scan import Powers, pieces, span_hashes, text_bytes
from steadytext.llm.storage import stored
from steadytext.operators.frames import join_lookup

SHARED_BYTES = 64            # longer stretches are aligned where they stand
STRETCHES_KEPT = 1 << 18
TOGETHER = 1 << 16           # bytes of new stretches that are encoded as one text
HEAD_PAIRS = 1 << 19         # pairs of ids that are broadcast, the most frequent ones
_ID_BITS = 20
_MARK = "▁"

LINKS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("a", "b", "times")]))
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def stretch_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where a stretch begins: a text, or a blank after a visible character.

    Visible: printable ASCII, or a two-byte character from U+00C0 on. After any other character
    nothing is cut, which is always right, and neither before a blank that ends its text, which
    would be no text for the piece model.
    """
    starts = np.zeros(len(data), bool)
    starts[1:] = (data[1:] == 0x20) & safe_ends(data)[:-1]
    starts[np.append(first[1:], len(data))[:len(first)] - 1] = False
    starts[first] = True
    return np.flatnonzero(starts)


def safe_ends(data: np.ndarray) -> np.ndarray:
    """Whether the byte ends a visible character as ``stretch_starts`` means it."""
    safe = (data > 0x20) & (data < 0x7F)
    lead = np.zeros(len(data), np.uint8)
    lead[1:] = data[:-1]
    return safe | (((data & 0xC0) == 0x80) & (lead >= 0xC3) & (lead <= 0xDF))


def refined_ends(start: np.ndarray, end: np.ndarray, size: np.ndarray, text: np.ndarray,
                 origin: np.ndarray) -> np.ndarray:
    """Where every token ends, from coarse spans and the number of bytes it decodes to.

    ``start`` and ``end`` are spans in bytes of one buffer, ``text`` the number of each token's
    text and ``origin`` where each text begins. A span of its own, as long as the token, stands;
    tokens that share a character follow one another from the last such cut on.
    """
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    opens = np.r_[True, text[1:] != text[:-1]]
    before = np.where(opens, origin[text], np.r_[0, end[:-1]])
    stands = (end - start == size) & (start == before)
    total = np.cumsum(size)
    # the last token that stands, or the beginning of the text
    anchor = np.where(stands | opens, np.arange(n), 0)
    anchor = np.maximum.accumulate(anchor)
    base_end = np.where(stands, end, origin[text] + size)[anchor]
    return base_end + total - total[anchor]


class Growing:
    """Rows of an array that grows at its end."""

    def __init__(self, *shape: int) -> None:
        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    def extend(self, rows: np.ndarray) -> None:
        end = self.n + len(rows)
        if end > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(
                (max(end - len(self.held), len(self.held)), *self.held.shape[1:]), np.int64)])
        self.held[self.n:end] = rows
        self.n = end

    def rows(self) -> np.ndarray:
        return self.held[:self.n]


class Aligner:
    """Aligns stretches and keeps what it found, in flat arrays."""

    def __init__(self, byte_path: str, piece_path: str, kept: int = STRETCHES_KEPT) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        sizes = self.a.get_vocab_size(), len(names)
        if any(_MARK in name.lstrip(_MARK) for name in names):
            raise ValueError("a piece spans a blank after a visible character")
        if max(sizes) > 1 << _ID_BITS:
            raise ValueError(f"vocabularies of {sizes} ids")
        signs = {chr(s): b for b, s in byte_signs().items()}
        own = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = self._table([bytes(signs[c] for c in own[i]) if all(
            c in signs for c in own.get(i, "?\n")) else own.get(i, "").encode() for i in range(sizes[0])])
        self.bytes_b = self._table([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else
                                    x.replace(_MARK, " ").encode() for i, x in enumerate(names)])
        self.signed = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(max(sizes))]
        self.kept, self.powers = kept, Powers()
        self.forget()

    @staticmethod
    def _table(tokens: list[bytes]):
        size = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.counts = Growing(5)     # n_a, n_b, n_groups, n_links, valid
        self.links = Growing()       # packed pairs of ids, stretch after stretch

    # ------------------------------------------------------------- encoding

    def _encoded(self, texts: list[bytes]):
        """Ids, coarse spans and text of every token of both tokenizers; every text begins with a blank."""
        whole = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        origin = np.cumsum(sizes) - sizes
        strings = [t.decode("utf-8", "replace") for t in texts]
        first = np.append(np.flatnonzero((whole & 0xC0) != 0x80), len(whole))   # of every character
        chars = np.cumsum([0, *map(len, strings)])
        found = self.a.encode_batch(strings, add_special_tokens=False)
        text = np.repeat(np.arange(len(texts)), [len(e) for e in found])
        every = chain.from_iterable
        ids = np.fromiter(every(e.ids for e in found), np.int64, len(text))
        span = np.fromiter(every(every(e.offsets for e in found)), np.int64, 2 * len(text))
        place = np.minimum(span.reshape(-1, 2) + chars[text][:, None], chars[text + 1][:, None])
        a = ids, first[place[:, 0]], first[place[:, 1]], text
        found = [p.pieces for p in self.b.encode([s[1:] for s in strings], return_type="proto", num_threads=1)]
        text = np.repeat(np.arange(len(texts)), [len(p) for p in found])
        flat = np.array([(t.id, t.begin, t.end) for p in found for t in p], np.int64).reshape(-1, 3)
        begin, end = flat[:, 1] + 1, flat[:, 2] + 1      # after the blank that is added
        begin[np.r_[True, text[1:] != text[:-1]][:len(text)]] = 0
        b = flat[:, 0], begin + origin[text], end + origin[text], text
        return whole, sizes, origin, a, b

    def _cuts(self, tokens, table, whole: np.ndarray, sizes: np.ndarray, origin: np.ndarray):
        """(ends, whether the tokens of each text decode to its bytes)."""
        ids, start, end, text = tokens
        flat, at, length = table
        size = length[ids]
        total = np.bincount(text, size, len(sizes)).astype(np.int64)
        right = total == sizes
        fits = right[text]
        decoded = flat[_ranges(at[ids[fits]], size[fits])]
        held = whole[_ranges(origin[right], sizes[right])]
        wrong = np.bincount(np.repeat(np.flatnonzero(right), sizes[right]), decoded != held, len(sizes))
        right &= wrong == 0
        ends = refined_ends(start, end, size, text, origin)
        if not np.array_equal(ends[right[text]], (origin[text] + np.cumsum(size) - (
                np.cumsum(total) - total)[text])[right[text]]):
            raise ValueError("spans of the tokenizer contradict the bytes of its tokens")
        return ends, right

    def learn(self, stretches: list[bytes]) -> None:
        """Align stretches that are not known yet."""
        joint, alone, size, mark = [[]], [], 0, _MARK.encode()
        for s in stretches:
            # both conditions of ``safe_ends``, on one byte string
            if not (0x20 < s[-1] < 0x7F or (0x80 <= s[-1] < 0xC0 and 0xC3 <= s[-2] <= 0xDF)) or mark in s:
                alone.append([s])
                continue
            if size > TOGETHER:
                joint.append([])
                size = 0
            joint[-1].append(s)
            size += len(s)
        for texts in (joint, alone):
            self._learn([t for t in texts if t])

    def _learn(self, texts: list[list[bytes]]) -> None:
        if not texts:
            return
        whole, sizes, origin, a, b = self._encoded([b"".join(t) for t in texts])
        ends_a, right_a = self._cuts(a, self.bytes_a, whole, sizes, origin)
        ends_b, right_b = self._cuts(b, self.bytes_b, whole, sizes, origin)
        right = right_a & right_b
        again = [[s] for t, ok in zip(texts, right) if not ok and len(t) > 1 for s in t]
        bad = [t[0] for t, ok in zip(texts, right) if not ok and len(t) == 1]
        self._add(bad, [b""] * len(bad), np.zeros((len(bad), 5), np.int64))
        self._learn(again)
        held = [s for t, ok in zip(texts, right) if ok for s in t]
        if not held:
            return
        keep_a, keep_b = right[a[3]], right[b[3]]
        ids_a, ids_b, ends_a, ends_b = a[0][keep_a], b[0][keep_b], ends_a[keep_a], ends_b[keep_b]
        stop = np.cumsum([len(s) for s in held])
        gone = np.cumsum(np.where(right, 0, sizes))       # bytes of texts left out
        ends_a, ends_b = ends_a - gone[a[3][keep_a]], ends_b - gone[b[3][keep_b]]
        every = np.sort(np.concatenate([ends_a, ends_b]))
        new = np.r_[True, every[1:] != every[:-1]]
        both, every = every[~new], every[new]
        counts = np.stack([np.diff(np.searchsorted(e, stop, "right"), prepend=0)
                           for e in (ends_a, ends_b, both, every)] + [np.ones(len(held), np.int64)], 1)
        # between two neighbouring cuts lies one token of each side
        link = (ids_a[np.searchsorted(ends_a, every)] << _ID_BITS) | ids_b[np.searchsorted(ends_b, every)]
        # the tokens of A and then of B, group by group, each written with the sign after it
        group = [np.searchsorted(both, e) for e in (ends_a, ends_b)]
        last = [np.append(g[1:] != g[:-1], True) for g in group]
        width = len(self.signed) // 3
        signed = np.concatenate([ids_a + width * last[0], ids_b + 2 * width * last[1]])
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        told = list(map(self.signed.__getitem__, signed[order].tolist()))
        at = np.cumsum(np.r_[0, counts[:, 0] + counts[:, 1]]).tolist()
        self._add(held, [b"".join(told[i:j]) for i, j in zip(at, at[1:])], counts)
        self.links.extend(link)

    def _add(self, stretches: list[bytes], groups: list[bytes], counts: np.ndarray) -> None:
        self.number.update(zip(stretches, range(len(self.strings), len(self.strings) + len(stretches))))
        self.strings += groups
        self.counts.extend(counts)

    # ------------------------------------------------------------ documents

    def align(self, column: pa.Array) -> dict[str, pa.Array]:
        """Counts, digest of the groups and links of every text of a piece."""
        given, given_at = text_bytes(column)
        n = len(column)
        size = np.diff(given_at)
        # every text with a blank before it; empty ones are left out
        offsets = np.cumsum(np.r_[0, size + (size > 0)])
        data = np.full(offsets[-1], 0x20, np.uint8)
        data[_ranges(offsets[:-1] + (size > 0), size)] = given
        start = stretch_starts(data, offsets[:-1][size > 0])
        end = np.append(start[1:], len(data))
        doc = np.searchsorted(offsets, start, "right") - 1
        if len(self.strings) > self.kept or self.links.n > 16 * self.kept:
            self.forget()
        which = self._numbers(data, start, end)
        counts = self.counts.rows()
        rows = counts[which]
        valid = np.bincount(doc, rows[:, 4] == 0, n) == 0
        out = {c: np.bincount(doc, rows[:, i], n).astype(np.int64) * valid for i, c in enumerate(COUNTS)}
        out["groups_sha256"], links = self._digests(which, doc, valid & (size > 0), n), counts[:, 3]
        # a stretch that a text repeats counts so many times
        key, times = np.unique(doc[valid[doc]] * len(counts) + which[valid[doc]], return_counts=True)
        owner, which = key // len(counts), key % len(counts)
        table, at = self.links.rows(), np.cumsum(links) - links
        taken = links[which]
        pair = table[_ranges(at[which], taken)]
        owner, times = np.repeat(owner, taken), np.repeat(times, taken)
        order = np.argsort((owner << (2 * _ID_BITS)) | pair, kind="stable")
        owner, pair, times = owner[order], pair[order], times[order]
        new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])][:len(pair)])
        times = np.add.reduceat(times, new) if len(new) else times
        pair, owner = pair[new], owner[new]
        bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
        parts = [pair >> _ID_BITS, pair & ((1 << _ID_BITS) - 1), times]
        out["links"] = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(
            [pa.array(p.astype(np.int32)) for p in parts], ["a", "b", "times"]))
        return out

    def _numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of every stretch; unknown ones are aligned first."""
        keys = span_hashes(data, start, end, self.powers)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        like = first[inverse]
        same = (end - start == (end - start)[like]) & (end - start <= SHARED_BYTES)
        size = (end - start)[same]
        if same.any():       # equal hashes must be equal bytes
            equal = data[_ranges(start[same], size)] == data[_ranges(start[like[same]], size)]
            same[same] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        like = np.where(same, like, np.arange(len(start)))
        own = np.unique(like)
        raw = data.tobytes()
        stretches = [raw[x:y] for x, y in zip(start[own].tolist(), end[own].tolist())]
        self.learn(list(dict.fromkeys(s for s in stretches if s not in self.number)))
        numbers = np.zeros(len(start), np.int64)
        numbers[own] = [self.number[s] for s in stretches]
        for s in {s for s in stretches if len(s) > SHARED_BYTES}:
            del self.number[s]
        return numbers[like]

    def _digests(self, which: np.ndarray, doc: np.ndarray, told: np.ndarray, n: int) -> list[str]:
        bounds = np.searchsorted(doc, np.arange(n + 1)).tolist()
        numbers, strings = which.tolist(), self.strings
        return [hashlib.sha256(b"".join([strings[i] for i in numbers[bounds[d]:bounds[d + 1]]])[:-1])
                .hexdigest() if told[d] else "" for d in range(n)]


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text",
            key: str = "doc_id") -> DataFrame:
    """(key, row, n_a, n_b, n_groups, n_links, groups_sha256, links) of every text, stored.

    ``byte_path`` is a byte-level tokenizer file (A), which sees the text after a blank,
    ``piece_path`` a piece model (B), which adds that blank. ``links`` are the overlapping pairs of
    ids with how often the text holds them. ``groups_sha256`` is the digest of the groups, written
    ``a1,a2|b1;a3|b2``. ``row`` numbers the rows. A text that is null, empty or not given back
    by the bytes of its tokens (a text with U+2581, say) has zeros, no links and an empty digest.
    Equal rows, null keys and other columns: each row gives one row, other columns are dropped.
    """
    kind = docs.schema[key].dataType
    schema = StructType([StructField(key, kind), StructField("row", LongType()),
                         *[StructField(c, LongType()) for c in COUNTS],
                         StructField("groups_sha256", StringType()), StructField("links", LINKS)])

    # a worker process keeps its broadcast values, so the next task it runs finds the stretches known
    memory = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "aligner" not in memory.value:
            memory.value["aligner"] = Aligner(byte_path, piece_path)
        aligner, row = memory.value["aligner"], TaskContext.get().partitionId() << 40
        for piece in pieces(batches, "_text"):
            found = aligner.align(piece.column("_text"))
            rows = pa.array(np.arange(row, row + piece.num_rows))
            row += piece.num_rows
            yield pa.RecordBatch.from_arrays(
                [piece.column("_key"), rows, *[pa.array(found[c]) for c in COUNTS],
                 pa.array(found["groups_sha256"], pa.string()), found["links"]], schema.names)

    given = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return stored(given.mapInArrow(run, schema))


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many rows a pair of ids is linked, and whether ``a`` has no better one.

    The best count is broadcast: it has one row per id of A at most.
    """
    counts = found.select(F.inline("links")).groupBy("a", "b").agg(F.count("*").alias("n"))
    counts = stored(counts)
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), "a").select(
        "a", "b", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))


def with_corpus_counts(found: DataFrame, counts: DataFrame, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Add ``n_best`` (links whose pair is the best of its A id) and ``count_sum`` (over links).

    The most frequent pairs, ``head_pairs`` at most, are broadcast to the links, so no pair that
    many rows hold is ever shuffled. The links of all other pairs, each of few rows, meet their
    counts in a join. Sums are added up before they leave a task.
    """
    level = F.floor(F.log2("n")).cast("int")
    sizes = dict(counts.groupBy(level.alias("level")).count().collect())     # one row per power of two
    least, held = 64, 0
    while least and held + sizes.get(least - 1, 0) <= head_pairs:
        least -= 1
        held += sizes.get(least, 0)
    head, tail = counts.where(level >= least), counts.where(level < least)
    links = found.select("row", F.inline("links"))

    def sums(met: DataFrame) -> DataFrame:
        return met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"),
                                      F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    added = sums(links.join(F.broadcast(head), ["a", "b"]))
    if least:      # some pairs are not in the head
        rest = links.join(F.broadcast(head.select("a", "b")), ["a", "b"], "left_anti")
        added = added.unionByName(sums(join_lookup(rest, tail, ["a", "b"], "inner"))) \
            .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return found.drop("links").join(added, "row", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("n_best", "count_sum")})
