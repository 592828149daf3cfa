"""SimHash near-duplicates by segment bit counts.

A text's 64-bit fingerprint holds the majority bits of its shingle hashes. Fingerprints
are cut into segments, and each is mapped to the vector of its segments' bit counts. Two
fingerprints that differ in k bits have vectors at most k apart in Manhattan distance, so
a join of every vector's cell with the cells within k finds all close pairs; the exact bit
test follows inside the join. Groups are closed by star contraction.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from steadytext.llm.components import components
from steadytext.llm.scan import mix, pieces, text_bytes
from steadytext.llm.storage import release, stored
from steadytext.operators.frames import join_lookup

SEED = 42
IN_SHARE = 3           # a share has so many different shingles, and up to twice as many
WANTED_BITS = 1 << 23


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (big-endian) of every shingle of a text, repeats included."""
    import xxhash

    tokens = text.lower().split()     # bytes: lowers A-Z only, splits at ASCII blanks only
    if not tokens:
        return np.zeros(0, ">u8")
    joined = b" ".join(tokens)
    end = list(itertools.accumulate((len(t) + 1 for t in tokens), initial=-1))
    step = min(words, len(tokens))
    view, digest = memoryview(joined), xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(view[a + 1:b], SEED) for a, b in zip(end, end[step:])]),
                         ">u8")


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that more than half of the hashes set; zero of none."""
    if not len(hashes):
        return 0
    bits = np.frombuffer(hashes.tobytes(), np.uint8).reshape(-1, 8)
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 14):
        set_ += np.unpackbits(bits[at:at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_ * 2 > len(bits)).tobytes(), "big", signed=True)


def share_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The share of every hash, from the hash alone."""
    return ((mix(hashes.astype(np.uint64)) >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def share_majorities(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, majority) of the hashes of every share that has any."""
    share = share_of(hashes, parts)
    order = np.argsort(share, kind="stable")
    share = share[order]
    if not len(share):
        return share, share
    first = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
    bits = np.unpackbits(np.frombuffer(hashes[order].tobytes(), np.uint8).reshape(-1, 8), axis=1)
    set_ = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    size = np.diff(np.append(first, len(share)))
    return share[first], np.packbits(set_ * 2 > size[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def share_counts(size: int, parts: int, least: float) -> list[int]:
    """Into how many shares a text of ``size`` different shingles is dealt, once for each count.

    Counts are ``parts`` times powers of two, so that a share has 3 to 6 shingles (fewer in a short
    text). A text takes the counts of the lengths around its own, up to the root of ``least`` shorter
    and longer: two texts of that similarity always have one count in common, and two
    counts are taken by one text in three.
    """
    def level(n: float) -> int:
        return max(0, int(n / (IN_SHARE * parts)).bit_length() - 1)

    around = math.sqrt(least)
    return [parts << i for i in range(level(size * around), level(size / around) + 1)]


def fingerprint(text: bytes, words: int) -> int:
    """Signed 64-bit SimHash of one text; a text without words has zero."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text",
                 out: str = "simhash") -> DataFrame:
    """The other columns of ``docs`` with a signed 64-bit fingerprint in place of ``text``.

    Words are runs of characters other than ASCII blanks, A-Z lowered; shingles are
    ``words`` of them, repeats included, joined by a blank, hashed by XXH64 (seed 42) over
    UTF-8. A text of fewer words is one shingle; without any, and for null, the fingerprint
    is zero. A bit is set if more than half of the shingles set it.
    """
    kept = [c for c in docs.columns if c not in (text, out)]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(out, LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            data, offsets = text_bytes(piece.column(text))
            raw, at = data.tobytes(), offsets.tolist()
            found = [fingerprint(raw[a:b], words) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in kept] + [pa.array(found, pa.int64())], [*kept, out])

    return docs.select(*kept, text).mapInArrow(run, schema)


def _cell(value: Column, segments: int, reach: int) -> Column:
    """The bit counts of all segments as the digits of one number."""
    width = 64 // segments
    base = width + 2 * reach + 1
    mask = -1 if width == 64 else (1 << width) - 1
    return sum((F.bit_count(F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit(mask)))
                .cast("long") + reach) * F.lit(base ** i) for i in range(segments))


def _steps(segments: int, reach: int) -> list[int]:
    """Cell differences of all vectors within ``reach`` whose first nonzero entry is positive."""
    base = 64 // segments + 2 * reach + 1
    steps = {0}
    for size in range(1, reach + 1):
        for places in itertools.combinations_with_replacement(range(segments), size):
            at = sorted(set(places))
            counts = [places.count(p) for p in at]
            for signs in itertools.product((1, -1), repeat=len(at) - 1):
                steps.add(sum(n * s * base ** p for n, s, p in zip(counts, (1, *signs), at)))
    return sorted(steps)


def close_pairs(values: DataFrame, value: str = "simhash", reach: int = 2, segments: int = 8,
                part: str | None = None) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most ``reach`` bits, each once.

    ``values`` holds every fingerprint once. With a column ``part`` (a small number from 0),
    fingerprints are compared within their part only, and it comes first in the result. Each one asks its own cell and half of the cells
    around it (73 in all for 8 segments and 2 bits), so a pair meets once. A fingerprint has at most
    2,080 others within 2 bits, so the pairs grow no faster than the fingerprints. More
    segments ask more cells and meet fewer strangers; the result is the same.
    """
    if not 1 <= segments <= 64 or 64 % segments:
        raise ValueError("segments must divide 64")
    number = F.lit(0) if part is None else F.col(part)
    # the part is one more digit in front of the cell's number
    front = number.cast("long") * F.lit((64 // segments + 2 * reach + 1) ** segments)
    cell = _cell(F.col("a"), segments, reach)
    asked = values.select(F.col(value).alias("a"), number.alias("part"), front.alias("front")).select(
        "a", "part", "front",
        F.explode(F.array(*[F.lit(s) for s in _steps(segments, reach)])).alias("step")
    ).select("a", "part", (F.col("front") + cell + F.col("step")).alias("cell"))
    held = values.select((front + _cell(F.col(value), segments, reach)).alias("cell"),
                         number.alias("in_part"), F.col(value).alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach
    own = F.col("part").cast("long") * F.lit((64 // segments + 2 * reach + 1) ** segments) + cell
    once = (F.col("a") < F.col("b")) | (own != held["cell"])
    # Spark sizes the asked cells as if each fingerprint asked one, and could broadcast all of them
    pairs = asked.hint("merge").join(held, (asked["cell"] == held["cell"]) & near & once
                                     & (F.col("part") == F.col("in_part")))
    return pairs.select("a", "b") if part is None else pairs.select(
        F.col("part").alias(part), "a", "b")


def near_groups(docs: DataFrame, words: int = 3, reach: int = 2, segments: int = 8) -> DataFrame:
    """``docs`` without text, with ``simhash`` and ``component_id``.

    Texts whose fingerprints differ in at most ``reach`` bits are linked, and linked texts
    are one group, named by its smallest doc_id; rows without doc_id belong to their
    text's group but never name it (null if no row of the group has one). Repeated rows and
    equal texts share a fingerprint, and only distinct fingerprints are compared.
    """
    rows = stored(fingerprints(docs, words))
    distinct = stored(rows.groupBy("simhash").agg(F.min("doc_id").alias("first_id")))
    links = stored(close_pairs(distinct, reach=reach, segments=segments))
    groups = components(links)           # node, component: fingerprints
    named = distinct.join(groups.withColumnRenamed("node", "simhash"), "simhash", "left") \
        .withColumn("component", F.coalesce("component", "simhash"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = join_lookup(named, smallest, ["component"]).select("simhash", "component_id")
    return join_lookup(rows, named, ["simhash"])


def part_fingerprints(docs: DataFrame, words: int = 5, parts: int = 32,
                      least: float = 0.8) -> DataFrame:
    """(doc_id, digest, simhash, size, parts): SHA-256 of the text, the fingerprint and number of its
    different shingles, and one fingerprint (part, value) for each of ``parts`` shares of them.

    Shingles are dealt to shares by their hash, so equal shingles fall in the same share in every text.
    There are as many shares as keep them small (``share_counts``), and the first ``parts`` of them
    are looked at, the same ones in every text: of two texts with Jaccard similarity
    0.8 a share is the same with probability 0.26 or more, so that all 32 differ once in
    20,000 pairs, whatever the length. Share i of n is part n + i; empty shares are left out.
    """
    def shares(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for n in share_counts(len(hashes), parts, least):
            own, value = share_majorities(hashes[share_of(hashes, n) < parts].astype(">u8"), n)
            found.append((n + own, value))
        return tuple(np.concatenate(x) for x in zip(*found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for piece in pieces(batches, "text"):
            data, offsets = text_bytes(piece.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            digest, whole, count, part, value = [], [], [], [], []
            for a, b in zip(at, at[1:]):
                hashes = np.unique(shingle_hashes(raw[a:b], words).astype(np.uint64))
                digest.append(hashlib.sha256(raw[a:b]).digest())
                whole.append(majority(hashes.astype(">u8")))
                count.append(len(hashes))
                own, values = shares(hashes)
                part.append(own)
                value.append(values)
            bounds = np.cumsum([0, *map(len, part)])
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.concatenate(part), pa.int32()),
                 pa.array(np.concatenate(value), pa.int64())], ["part", "value"]))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(digest, pa.binary()), pa.array(whole, pa.int64()),
                 pa.array(count, pa.int32()), listed], ["doc_id", "digest", "simhash", "size", "parts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, digest binary, simhash long, size int, "
             "parts array<struct<part:int,value:long>>")


def _bits_of(ids: DataFrame) -> tuple[np.ndarray, Column]:
    """A bit table that has every id of the column ``id`` set, and the bit of an id as a column.

    One row per 64 bits comes to the driver, 131,072 at most. Of very many ids it rules out fewer.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(WANTED_BITS)).cast("int")
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63))).alias("mask"))
    table = np.zeros(WANTED_BITS // 64, np.int64)
    for word, mask in words.collect():
        table[word] = mask
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool), bit


def _verified(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts' shingle sets have at least ``least`` in common (Jaccard).

    Texts are read where they lie: sets are made of those that a pair may ask for, by a bit table
    of bounded size, and only these sets are shuffled.
    """
    wanted, bit = _bits_of(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    known_bits = docs.sparkSession.sparkContext.broadcast(wanted)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text") \
        .select("id", bit.alias("bit"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            piece = piece.filter(pa.array(known_bits.value[piece.column("bit").to_numpy()]))
            data, offsets = text_bytes(piece.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            found = [np.unique(shingle_hashes(raw[a:b], words).astype(np.uint64)).astype(np.int64)
                     for a, b in zip(at, at[1:])]
            bounds = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            listed = pa.ListArray.from_arrays(bounds, pa.array(
                np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([piece.column("id"), listed], ["id", "shingles"])

    known = stored(rows.mapInArrow(sets, "id long, shingles array<long>"))
    # a doc_id that stands for several texts counts with one of them
    once = known.groupBy("id").agg(F.min("shingles").alias("shingles"))
    x = once.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = once.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    met = join_lookup(join_lookup(pairs, x, ["a"], "inner"), y, ["b"], "inner")
    both = F.size(F.array_intersect("x", "y"))
    every = F.size("x") + F.size("y")
    found = stored(met.select("a", "b", both.alias("both"), every.alias("every")).where(
        F.col("both") >= least * (F.col("every") - F.col("both"))).select("a", "b"))
    release(known)
    return found


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, parts: int = 32,
                   reach: int = 2, segments: int = 8, slack: int = 24) -> DataFrame:
    """(doc_id, digest, component_id): groups of texts with Jaccard similarity of at least ``least``
    over ``words``-word shingles, every link verified on the texts.

    Candidates are whole fingerprints within ``reach`` bits, joined by their segments' bit counts, and,
    as few looser copies come that close, texts with an equal share. Texts of one fingerprint or
    share are compared with its smallest doc_id, if their whole fingerprints differ in at most
    ``slack`` bits and their sizes allow the similarity. Equal texts are one from the
    start. No share, however common, makes more candidates than it has texts; the price is that a
    link inside a group can be missed where no share brings its texts together.
    Rows without doc_id take no part.

    Tables that grow with the documents are joined by sorting: Spark sizes them by their files and by digests
    and lists that it takes to be longer or shorter, and could broadcast several of them at once.
    """
    rows = stored(part_fingerprints(docs, words, parts, least).where("doc_id IS NOT NULL"))
    first = F.min(F.struct("doc_id", "simhash", "size")).alias("first")
    texts = stored(rows.groupBy("digest").agg(first).select(
        "digest", F.col("first.doc_id").alias("id"), "first.simhash", "first.size"))
    shares = rows.select(F.col("doc_id").alias("id"), F.inline("parts"))
    # the smallest doc_id of a share is also the first one of its own text
    nodes = shares.groupBy("part", "value").agg(F.min("id").alias("head"), F.count("*").alias("n")) \
        .where("n > 1").drop("n")
    nodes = stored(nodes)
    by_share = join_lookup(shares.hint("merge"), nodes, ["part", "value"], "inner").select(
        F.col("head").alias("a"), F.col("id").alias("b"))
    prints = stored(texts.groupBy("simhash").agg(F.min("id").alias("head")))
    by_print = join_lookup(texts.select("id", "simhash").hint("merge"), prints, ["simhash"], "inner").select(
        F.col("head").alias("a"), F.col("id").alias("b"))
    close = stored(close_pairs(prints, reach=reach, segments=segments))
    heads = prints.select(F.col("simhash").alias("b"), F.col("head").alias("to"))
    across = close.hint("merge").join(prints.select(F.col("simhash").alias("a"), "head"), "a") \
        .hint("merge").join(heads, "b").select(
        F.least("head", "to").alias("a"), F.greatest("head", "to").alias("b"))
    met = by_share.unionByName(by_print).unionByName(across).where("a <> b").distinct()
    # ids that are not the first of their text drop out here
    known = texts.select("id", "simhash", "size")
    for end in ("a", "b"):
        met = join_lookup(met.hint("merge"), known.select(
            F.col("id").alias(end), F.col("simhash").alias(f"{end}_simhash"),
            F.col("size").alias(f"{end}_size")), [end], "inner")
    near = F.bit_count(F.col("a_simhash").bitwiseXOR(F.col("b_simhash"))) <= slack
    sized = F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * least
    pairs = stored(met.where(near & sized).select("a", "b"))
    for done in (nodes, prints, close):
        release(done)
    links = _verified(pairs, docs, words, least)
    release(pairs)
    groups = components(links)
    release(links)
    named = join_lookup(texts.select("digest", "id"),
                        groups.select(F.col("node").alias("id"), "component"), ["id"]) \
        .select("digest", F.coalesce("component", "id").alias("component_id"))
    return join_lookup(rows.select("doc_id", "digest"), named, ["digest"])


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of ``similar_groups``: its smallest doc_id.

    Rows that repeat that doc_id are reduced to one. Rows without a doc_id are all kept, as
    nothing tells them apart. Null texts are empty, and empty texts are copies of each other.
    """
    groups = similar_groups(docs.select("doc_id", "text"), words, least)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    with_id = docs.where("doc_id IS NOT NULL").join(
        kept, F.col("doc_id") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id"])
    return with_id.unionByName(docs.where("doc_id IS NULL"))


def as_hex(value: Column) -> Column:
    """16 lower-case hex digits of a signed 64-bit value."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
