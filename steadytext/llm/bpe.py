"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last four bytes decides where a text is cut into chunks of several
words: at some gaps between words, and rarely inside a run without blanks. Equal passages are cut
alike wherever they stand, so documents share chunks, and a task encodes each distinct chunk
once and keeps its ids. The words of a new chunk are looked up in the same way before the
tokenizer sees them. At a cut between words the ids of both sides stand as they are. At a
cut inside a word the word around it is encoded again and replaces both parts: the repair
widens to the nearest blanks, where the tokenizer's own splitting agrees with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from steadytext.llm.scan import (DIGIT, LETTER, SPACE, Powers, byte_kinds, lower_bytes, pieces,
                                 span_hashes, text_bytes)

CUT_GAP = 8        # one gap between words in so many ends a chunk
CUT_WORD = 4096    # one byte in so many ends a chunk inside a word
CHUNKS_KEPT = 1 << 18


def chunk_bounds(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray,
                 cut_gap: int = CUT_GAP, cut_word: int = CUT_WORD, classes: bool = False):
    """(start, end, document, joined) of the chunks of a byte buffer.

    A gap between words ends a chunk if the rolling hash of the bytes before it says so, one in
    ``cut_gap``; a gap of 1 makes every word a chunk. A ``cut_word`` of 0 cuts no word.
    ``joined`` marks a chunk that begins inside a word: its join with the chunk before
    it needs a repair. Blanks at the ends of a chunk are left out. ``classes`` lets a word
    also end between an ASCII letter and an ASCII sign or digit (an apostrophe stays with
    the letter after it), for tokenizers that always split there.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    blank = kinds[data] == SPACE
    rolling = data.astype(np.uint32)
    for back in (1, 2, 3):
        rolling[back:] += data[:-back].astype(np.uint32) << np.uint32(8 * back)
    rolling *= np.uint32(0x9E3779B1)
    rolling >>= np.uint32(12)
    first = np.zeros(n + 1, bool)      # a text begins here
    first[offsets] = True
    before = np.r_[True, blank[:-1]] | first[:n]
    begins = ~blank & before
    stops = ~blank & np.r_[blank[1:] | first[1:n], True]
    if classes:
        letter = (kinds[data] == LETTER) & (data < 128)
        sign = kinds[data] >= DIGIT
        turn = (letter[:-1] & sign[1:]) | (sign[:-1] & (data[:-1] != ord("'")) & letter[1:])
        turn &= ~first[1:n]
        begins[1:] |= turn
        stops[:-1] |= turn
    word_start = np.flatnonzero(begins)
    gap_end = np.flatnonzero(stops) + 1   # ends of words
    # a gap is cut if the hash of the bytes before it says so, or between texts
    cut = np.ones(len(word_start), bool)
    cut[1:] = (rolling[gap_end[:-1] - 1] % np.uint32(cut_gap) == 0) | \
        (np.searchsorted(offsets, word_start[1:], "right") !=
         np.searchsorted(offsets, word_start[:-1], "right"))
    inside = np.flatnonzero((rolling[:-1] % np.uint32(cut_word) == 1) & ~blank[:-1] & ~begins[1:] & ~blank[1:] &
                            ~first[1:n] & (data[1:] & 0xC0 != 0x80)) + 1 if cut_word else np.zeros(0, np.int64)
    start = np.concatenate([word_start[cut], inside])
    order = np.argsort(start, kind="stable")
    start = start[order]
    joined = (np.arange(len(start)) >= cut.sum())[order]
    # a chunk ends where its last word ends
    last = np.append(start[1:], n)
    word_end = gap_end[np.maximum(np.searchsorted(gap_end, last, "right") - 1, 0)]
    end = np.where(np.append(joined[1:], False), last, word_end)
    return start, end, np.searchsorted(offsets, start, "right") - 1, joined


def repaired(data: np.ndarray, start: np.ndarray, end: np.ndarray, document: np.ndarray,
             joined: np.ndarray, kinds: np.ndarray):
    """The chunks (start, end, document) with every join inside a word repaired.

    The word around a join reaches from the last blank of the left chunk to the first blank
    of the right one; chunks without any blank grow into one word. It becomes a chunk of
    its own, encoded again as a whole, and both sides lose their part of it.
    """
    blank = np.flatnonzero(kinds[data] == SPACE)
    at = start[joined]
    place = np.searchsorted(blank, at)
    low = np.append(-1, blank)[place] + 1
    high = np.append(blank, len(data))[place]
    group = np.flatnonzero(joined)
    first = group[np.r_[True, np.diff(group) > 1]] - 1       # the chunk a run of joins begins in
    owner = np.searchsorted(first, group, "right") - 1
    low = np.maximum(low, start[first][owner])
    last = np.r_[np.diff(owner) > 0, True]
    high = np.minimum(high, end[group[last]][owner])
    # what is left of the old chunks lies between the words
    cuts = np.sort(np.concatenate([start[~joined], low, high]))
    cuts = cuts[np.r_[True, cuts[1:] != cuts[:-1]]]
    stop = np.append(cuts[1:], len(data))
    reach = np.append(end[np.append(~joined[1:], True)], 0)[:-1]   # ends of whole runs
    stop = np.minimum(stop, reach[np.searchsorted(start[~joined], cuts, "right") - 1])
    full = stop > cuts
    cuts, stop = cuts[full], stop[full]
    seen = kinds[data] != SPACE
    place = np.append(np.flatnonzero(seen), len(data))
    head = place[np.searchsorted(place, cuts)]
    tail = place[np.maximum(np.searchsorted(place, stop) - 1, 0)] + 1
    full = head < np.minimum(tail, stop)
    head, tail = head[full], tail[full]
    doc = document[~joined][np.searchsorted(start[~joined], head, "right") - 1]
    return head, tail, doc


def byte_signs() -> dict[int, int]:
    """Byte -> the character that byte-level vocabularies write for it.

    Printable Latin-1 characters stand for themselves, the other bytes, in order, for the
    characters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(hidden)}


class ChunkIds:
    """Ids of the chunks seen so far.

    A chunk is looked up by a 64-bit hash in an open table of numpy arrays, many at a time,
    and its bytes are then compared with the stored ones, so equal hashes of unlike chunks
    do no harm. Bytes and ids of all chunks lie in flat arrays. When ``kept`` chunks are
    held, all are forgotten: the memory stays bounded and the ids stay the same. A new chunk
    is put together from its words, which a second table of the same kind knows.
    """

    def __init__(self, tokenizer, plain_words: bool, kept: int = CHUNKS_KEPT,
                 of_words: bool = False) -> None:
        self.tokenizer, self.kept = tokenizer, kept
        self.words = None if of_words else ChunkIds(tokenizer, plain_words, kept, True)
        self.kinds = byte_kinds()
        # a lower-case Latin word is one unit for such a tokenizer: its model alone gives the ids
        self.model = tokenizer.model if plain_words else None
        self.byte_signs = byte_signs()
        self.special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.powers = Powers()
        self.slots = 1 << (2 * kept - 1).bit_length()
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.number = np.zeros(self.slots, np.int64)
        self.count = 0
        self.flat = {"bytes": np.zeros(1 << 16, np.uint8), "ids": np.zeros(1 << 16, np.int32)}
        self.start = {k: np.zeros(1 << 12, np.int64) for k in self.flat}
        self.size = {k: np.zeros(1 << 12, np.int64) for k in self.flat}
        self.used = dict.fromkeys(self.flat, 0)

    def _append(self, kind: str, values: np.ndarray, size: np.ndarray) -> None:
        def room(array: np.ndarray, n: int) -> np.ndarray:
            return array if n <= len(array) else np.concatenate(
                [array, np.zeros(max(n - len(array), len(array)), array.dtype)])

        at, end = self.count, self.count + len(size)
        self.flat[kind] = room(self.flat[kind], self.used[kind] + len(values))
        self.flat[kind][self.used[kind]:self.used[kind] + len(values)] = values
        self.start[kind], self.size[kind] = room(self.start[kind], end), room(self.size[kind], end)
        self.start[kind][at:end] = self.used[kind] + np.cumsum(size) - size
        self.size[kind][at:end] = size
        self.used[kind] += len(values)

    def flat_ids(self, chunks: list[bytes], classes: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, number of ids per chunk) of chunks not held."""
        if self.words is None:
            found = self.ids_of(chunks)
            size = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for x in found for i in x), np.int32, int(size.sum())), size
        data = np.frombuffer(b"".join(chunks), np.uint8)
        offsets = np.zeros(len(chunks) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)), out=offsets[1:])
        start, end, chunk, _ = chunk_bounds(data, offsets, self.kinds, 1, 0, classes)
        ids, size = self.words.encode(data, start, end, classes)
        return ids, np.bincount(chunk, size, len(chunks)).astype(np.int64)

    def ids_of(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids straight from the tokenizer."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        words = [self.model is not None and x.isalpha() and x.islower() and max(x) < "\u0250"
                 for x in texts]
        rest = iter(self.tokenizer.encode_batch_fast(
            [x for x, word in zip(texts, words) if not word], add_special_tokens=False))
        tokenize = self.model.tokenize if self.model is not None else None
        return [[t.id for t in tokenize(c.decode("latin-1").translate(self.byte_signs))]
                if word else next(rest).ids for c, word in zip(chunks, words)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the chunk with this hash, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.key[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.number[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
        return out

    def _insert(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.key[slot[open_]] == 0]
            self.key[slot[free]] = keys[free]
            self.number[slot[free]] = numbers[free]
            open_ = open_[self.key[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray,
               classes: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after another, number of ids per chunk).

        ``classes``: the chunks' words end as ``chunk_bounds`` says for it.
        """
        if self.count > self.kept // 2:
            self.forget()
        keys = span_hashes(data, start, end, self.powers) | np.uint64(1)
        which = self.find(keys)
        new = np.flatnonzero(which < 0)
        if len(new):
            order = new[np.argsort(keys[new], kind="stable")]
            first = order[np.r_[True, keys[order[1:]] != keys[order[:-1]]]]
            fresh = keys[first]
            a, b = start[first], end[first]
            chunks = [data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]
            room = max(0, min(len(chunks), self.slots // 2 - self.count))
            found, size = self.flat_ids(chunks[:room], classes)
            at = np.arange(self.count, self.count + room)
            self._append("bytes", np.frombuffer(b"".join(chunks[:room]), np.uint8), (b - a)[:room])
            self._append("ids", found, size)
            self._insert(fresh[:room], at)
            self.count += room
            which[new] = self.find(keys[new])
        same = which >= 0
        same[same] = self._equal(data, start[same], end[same], which[same])
        size = np.zeros(len(start), np.int64)
        size[same] = self.size["ids"][which[same]]
        extra, size[~same] = self.flat_ids([data[x:y].tobytes() for x, y in zip(
            start[~same].tolist(), end[~same].tolist())], classes)
        source = np.zeros(len(start), np.int64)
        source[same] = self.start["ids"][which[same]]
        table = self.flat["ids"]
        if len(extra):
            source[~same] = len(table) + np.cumsum(size[~same]) - size[~same]
            table = np.concatenate([table, extra])
        return table[_ranges(source, size)], size

    def _equal(self, data, start, end, which) -> np.ndarray:
        """Whether the bytes of each chunk are those stored under its number."""
        size = self.size["bytes"][which]
        same = size == end - start
        if not same.all():
            start, which, size = start[same], which[same], size[same]
        if len(size):
            equal = data[_ranges(start, size)] == \
                self.flat["bytes"][_ranges(self.start["bytes"][which], size)]
            same[same] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return same


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (size of them) for every pair, one after another."""
    out = np.repeat(start - (np.cumsum(size) - size), size)
    out += np.arange(len(out))
    return out


def encode_piece(column: pa.Array, known: ChunkIds, kinds: np.ndarray,
                 lowered: np.ndarray | None = None, cut_gap: int = CUT_GAP,
                 cut_word: int = CUT_WORD) -> pa.Array:
    """list<int32> of the ids of every text. ``lowered``: see ``splits_classes``."""
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    plain = lowered is not None and not any(s in raw for s in known.special)
    if plain:      # letters that the normalizer lowers anyway, so that more chunks are equal
        data = lowered[data]
    start, end, document, joined = chunk_bounds(data, offsets, kinds, cut_gap, cut_word, plain)
    if joined.any():
        start, end, document = repaired(data, start, end, document, joined, kinds)
    ids, size = known.encode(data, start, end, plain)
    per_text = np.bincount(document, size, len(column)).astype(np.int64)
    bounds = np.zeros(len(column) + 1, np.int32)
    np.cumsum(per_text, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids",
           cut_gap: int = CUT_GAP, cut_word: int = CUT_WORD,
           splits_classes: bool = True) -> DataFrame:
    """``docs`` with an array<int> column of token ids, as the tokenizers library encodes
    the whole text without added special tokens.

    ``tokenizer`` is the path of a tokenizer file that every executor can open. It must
    split at blanks (its pre-tokenizer drops or separates white space), as BPE with word
    ends does. ``splits_classes``: it also lowers the letters A-Z and splits between letters,
    digits and signs ('s, 't and the like aside), so chunks may end there too. A null or empty text has no ids. Every other column passes unchanged; one
    named like ``ids`` is replaced. Rows are independent: no shuffle, and a lost task is
    simply run again.
    """
    kept = [c for c in docs.columns if c != ids]
    schema = StructType([docs.schema[c] for c in kept]
                        + [StructField(ids, ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one core per task
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.no_truncation()
        model.no_padding()
        known, kinds = ChunkIds(model, splits_classes), byte_kinds()
        lowered = lower_bytes() if splits_classes else None
        for piece in pieces(batches, text):
            found = encode_piece(piece.column(text), known, kinds, lowered, cut_gap, cut_word)
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + [found],
                                             [*kept, ids])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "token_ids",
           text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, as the tokenizers library decodes them with
    special tokens kept, by a file that names no decoder: its tokens, joined by a blank.

    Null ids decode to null, no ids to the empty text, an id beyond the vocabulary to
    nothing. A column named like ``text`` is replaced.
    """
    kept = [c for c in encoded.columns if c != text]
    schema = StructType([encoded.schema[c] for c in kept] + [StructField(text, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        if model.decoder is not None:
            raise ValueError("the tokenizer file names a decoder of its own")
        size = model.get_vocab_size()
        tokens = pa.array([model.id_to_token(i) for i in range(size)], pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(ids)
                flat, counts = column.flatten(), pc.fill_null(pc.list_value_length(column), 0)
                number = flat.to_numpy(zero_copy_only=False)
                known = (number >= 0) & (number < size)
                bounds = np.r_[0, np.cumsum(counts.to_numpy())]
                if not known.all():
                    bounds = np.r_[0, np.cumsum(known)][bounds]
                    number = number[known]
                words = tokens.take(pa.array(number))
                joined = pc.binary_join(pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), words), " ")
                if column.null_count:
                    joined = pc.if_else(column.is_valid(), joined, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [joined], [*kept, text])

    return encoded.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text."""
    rows = decode(encode(docs.select("doc_id", "text"), tokenizer), tokenizer)
    return rows.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
