"""Byte-level reading of text columns inside Arrow batches.

A text column reaches a task as one byte buffer with offsets. The helpers here look at
that buffer with numpy, many documents at a time, and never build a Python object per
character. ``pieces`` bounds what is looked at together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE, LETTER, DIGIT, SIGN = 0, 1, 2, 3
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def byte_kinds() -> np.ndarray:
    """Kind of each byte: blank, letter (also every byte of a non-ASCII character), digit or sign."""
    kinds = np.full(256, SIGN, np.uint8)
    for low, high in (("a", "z"), ("A", "Z")):
        kinds[ord(low):ord(high) + 1] = LETTER
    kinds[ord("0"):ord("9") + 1] = DIGIT
    kinds[128:] = LETTER
    kinds[list(BLANKS)] = SPACE
    return kinds


def lower_bytes() -> np.ndarray:
    """Table that turns A-Z into a-z and keeps every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null reads as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    n, buffers = len(column), column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    width = np.int64 if pa.types.is_large_string(column.type) or \
        pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(buffers[1], width)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batches, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut so that ``column`` holds about ``limit`` bytes.

    A row is never cut: a longer text is a piece of its own.
    """
    for batch in batches:
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, kept from piece to piece."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            up, down = np.full(size, _BASE), np.full(size, _UNBASE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def token_spans(data: np.ndarray, offsets: np.ndarray,
                kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of bytes of one kind, blanks left out."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = kinds[data]
    breaks = np.empty(len(data), bool)
    breaks[0] = True
    np.not_equal(kind[1:], kind[:-1], out=breaks[1:])
    inner = offsets[1:-1]
    breaks[inner[inner < len(data)]] = True
    start = np.flatnonzero(breaks)
    end = np.append(start[1:], len(data))
    seen = kind[start] != SPACE
    start, end = start[seen], end[seen]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray,
                powers: Powers) -> np.ndarray:
    """64-bit hash of the bytes of every span, the same wherever the bytes stand."""
    up, down = powers.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def sum_by_document(values: np.ndarray, document: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (rows) per document; ``document`` is sorted."""
    out = np.zeros((n,) + values.shape[1:], np.float64)
    if len(document):
        first = np.flatnonzero(np.r_[True, document[1:] != document[:-1]])
        out[document[first]] = np.add.reduceat(values, first, axis=0, dtype=np.float64)
    return out
