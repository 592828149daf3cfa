"""Hashed words and word n-grams of texts, as numpy arrays over a whole piece."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from steadytext.llm.scan import LETTER, Powers, mix, span_hashes, text_bytes, token_spans


def ngram_buckets(column: pa.Array, kinds: np.ndarray, powers: Powers,
                  buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every word and word pair, sorted by document.

    Words are runs of letters, of digits or of signs, case kept. A word that repeats the one
    before it is written as one fixed mark, so all repetitions share their pairs.
    """
    data, offsets = text_bytes(column)
    start, end, doc = token_spans(data, offsets, kinds)
    word = span_hashes(data, start, end, powers)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    word[again] = np.uint64(0x5EED)
    pair = mix(word[1:] * np.uint64(0x9E3779B97F4A7C15) + word[:-1])
    inside = doc[1:] == doc[:-1]
    bucket = np.concatenate([word, pair[inside]])
    doc = np.concatenate([doc, doc[1:][inside]])
    order = np.argsort(doc, kind="stable")
    return (mix(bucket[order]) % np.uint64(buckets)).astype(np.int64), doc[order]


def word_parts(column: pa.Array, lowered: np.ndarray, kinds: np.ndarray, powers: Powers,
               buckets: int, prefixes=(4, 5, 6, 7)) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every letter run, A-Z lowered, and of its first bytes."""
    data, offsets = text_bytes(column)
    data = lowered[data]
    start, end, doc = token_spans(data, offsets, kinds)
    letters = kinds[data[start]] == LETTER if len(data) else np.zeros(0, bool)
    start, end, doc = start[letters], end[letters], doc[letters]
    up, down = powers.upto(len(data) + 1)
    found, owner = [span_hashes(data, start, end, powers)], [doc]
    for size in prefixes:
        longer = end - start > size
        found.append(mix(span_hashes(data, start[longer], start[longer] + size, powers)
                         + np.uint64(size)))
        owner.append(doc[longer])
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(owner)


def per_document(bucket: np.ndarray, doc: np.ndarray, buckets: int):
    """(document, bucket, count) without repeats, sorted."""
    key = np.sort(doc * buckets + bucket)
    if not len(key):
        return key, key, key
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first] // buckets, key[first] % buckets, np.diff(np.append(first, len(key)))
