import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from steadytext.llm import bpe, fingerprints, queries
from steadytext.llm.scan import byte_kinds, lower_bytes, text_bytes
from tests.llm.helpers import SF, empty_docs, odd_docs

PATH = queries.tokenizer_path()


@pytest.mark.parametrize("keep_gap,cut_word", [(64, 4096), (2, 7), (1 << 19, 3)])
def test_chunks_give_the_ids_of_whole_texts(keep_gap, cut_word):
    draw = random.Random(4)
    signs = [*"abcdeé ñß'sst\t\n  0123ABC.,!?<|>", "́", " ", "　", "İ", "Σ", "ﬁ",
             "<|endoftext|>", "don't", "<|ENDOFTEXT|>"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 50))) for _ in range(1500)]
    texts += ["x" * 5000, "", None, "ab" * 2000 + " c"]
    model = Tokenizer.from_file(PATH)
    for lowered in (None, lower_bytes()):
        known = bpe.ChunkIds(model, lowered is not None, kept=512)
        got = bpe.encode_piece(pa.array(texts), known, byte_kinds(), lowered, keep_gap, cut_word)
        want = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert got.to_pylist() == want


def test_bpe_round_trip_and_odd_rows(spark):
    docs = odd_docs(spark)
    rows = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert rows.columns == [*docs.columns, "token_ids", "decoded"]
    model = Tokenizer.from_file(PATH)
    for r in rows.collect():
        want = model.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["token_ids"] == want
        assert r["decoded"] == model.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty_docs(spark), PATH).count() == 0
    odd_ids = spark.createDataFrame([(None,), ([],), ([320, 99999, -1],)], "token_ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd_ids, PATH).collect()] == [
        None, "", model.id_to_token(320)]


def test_bpe_query_against_the_library(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = Tokenizer.from_file(PATH)
    rows = queries.op10_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = model.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        text = model.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def slow_embedding(text, walk):
    """What a walk sees at each slot, one step at a time."""
    kinds = [(ord(c) * 0x9E3779B1 & 0xFFFFFFFF) >> 27 for c in text]
    steps, i, t = {}, 0, 0
    for i, kind in enumerate(kinds):
        stay = walk.stay[t % fingerprints.PHASES, kind]
        steps.update(dict.fromkeys(range(t, t + stay), i))
        t += stay
    out = []
    for records in walk.records:
        step = max(r for r in records.tolist() if r < 2 * len(text))
        at = steps.get(step)
        if at is None:
            out.append(0)
            continue
        seen = ord(text[at]) * 0x85EBCA6B & 0xFFFFFFFF
        for k in (1, 2):
            after = ord(text[at + k]) if at + k < len(text) else 0
            seen = (seen ^ after) * 0xC2B2AE35 & 0xFFFFFFFF
        out.append((seen >> 16) % 255 + 1)
    return out


def test_embedding_against_single_steps():
    draw = random.Random(3)
    texts = ["".join(draw.choice("abc déf😀") for _ in range(draw.randint(1, 90))) for _ in range(60)]
    walks = [fingerprints.Walk(w) for w in range(2)]
    got = fingerprints.embed(pa.array(texts), walks)
    for few in (texts, texts[:5]):       # side by side and one by one
        got = fingerprints.embed(pa.array(few), walks)
        for text, row in zip(few, got):
            assert row.tolist() == slow_embedding(text, walks[0]) + slow_embedding(text, walks[1])


def test_fingerprint_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    rows = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, SF).collect()}
    assert len(rows) == len(docs)
    printed = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        r, q = rows[i], len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert printed.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    for (i, text), (j, after) in zip(docs, docs[1:] + docs[:1]):
        a, b = (bytes.fromhex(rows[k]["fingerprint"]) for k in (i, j))
        assert rows[i]["near_next"] == pytest.approx(np.mean([x == y for x, y in zip(a, b)]))
    long = [rows[i] for i, t in docs if len(t) > 400]
    assert np.mean([r["candidate_edited"] for r in long]) > 0.95
    assert not any(r["candidate_next"] for r in long if r["near_next"] < 0.05)
    assert 0.65 < np.mean([r["near_edited"] for r in long]) < 0.85
    assert min(r["near_edited"] - r["near_next"] for r in long) > 0.3


def test_fingerprints_of_odd_rows(spark):
    rows = fingerprints.edited_likeness(odd_docs(spark)).collect()
    assert len(rows) == 10
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)} == {"00" * 256}
    assert fingerprints.edited_likeness(empty_docs(spark)).count() == 0
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = fingerprints.edited_likeness(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1


def test_bands_find_near_texts(spark):
    draw = random.Random(9)
    base = ["".join(draw.choice("abcdefghij klmno") for _ in range(600)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:300] + "#" + t[300:])
                                                   for i, t in enumerate(base)] + [(200, base[0])]
    printed = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r["a"], r["b"]) for r in fingerprints.near_texts(printed, 0.6).collect()}
    assert found <= {(i, 100 + i) for i in range(20)} and len(found) >= 17
    assert printed.where("doc_id IN (0, 200)").select("fingerprint").distinct().count() == 1


def test_chunks_hold_several_words_and_equal_passages_share_them():
    draw = np.random.default_rng(4)
    words = ["".join(map(chr, draw.integers(97, 123, draw.integers(2, 9)))) for _ in range(3000)]
    passage = " ".join(words[:1500])
    texts = [passage, "other words before " + passage, " ".join(words[1500:])]
    data, offsets = text_bytes(pa.array(texts))
    start, end, document, joined = bpe.chunk_bounds(data, offsets, byte_kinds(), cut_word=0)
    sizes = [len(data[a:b].tobytes().split()) for a, b in zip(start, end)]
    assert not joined.any() and sum(sizes) == 4503 and 4 < np.mean(sizes) < 16
    held = [{data[a:b].tobytes() for a, b in zip(start[document == d], end[document == d])} for d in (0, 1)]
    assert len(held[0] - held[1]) <= 1      # only the first chunk of the passage may differ
