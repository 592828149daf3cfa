"""Document fingerprints by randomised edit embedding.

A random walk reads a text character by character: at every step a shared random bit, chosen
by the step and the character, says whether to move on. Texts that differ by few edits are
read alike again soon after each edit, so the number of steps at which the walks see different
things (a Hamming distance) follows the edit distance. A fingerprint samples the walk at
shared steps: each slot takes the sampled step by consistent sampling over the length of the
walk, so texts of similar length look at the same steps. Bands of slots find candidates,
and the whole fingerprints verify them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from steadytext.llm.scan import pieces, text_bytes

WALKS = 2              # independent walks
SLOTS = 128            # samples of each walk
PHASES = 256           # the random bits repeat after so many steps
CLASSES = 32           # characters are hashed to so many classes for the walk
SEED = 20
FEW = 24               # fewer texts than this are walked one by one
PIECE = 2 << 20


class Walk:
    """The shared random choices of one walk."""

    def __init__(self, seed: int) -> None:
        draw = np.random.default_rng([SEED, seed])
        moves = draw.integers(0, 2, (PHASES, CLASSES), np.int8)
        moves[draw.integers(0, PHASES, CLASSES), np.arange(CLASSES)] = 1
        # steps spent on a character of a class when it is met at a phase
        stay = np.zeros((PHASES, CLASSES), np.int64)
        ahead = np.zeros(CLASSES, np.int64)
        for phase in range(2 * PHASES - 1, -1, -1):
            ahead = np.where(moves[phase % PHASES] == 1, 1, ahead + 1)
            stay[phase % PHASES] = ahead
        self.stay = stay.astype(np.int32)
        then = (np.arange(PHASES)[:, None] + stay) % PHASES
        self.two = (stay[:, :, None] + stay[then]).reshape(-1).astype(np.int32)
        # slot s looks at the last of its records below the length of the walk; a record
        # replaces the one before it as the smallest of a growing range would
        self.records = []
        for _ in range(SLOTS):
            at, found = 1, [0]
            while at < 1 << 34:
                at = int(at / (1 - draw.random())) + 1
                found.append(at - 1)
            self.records.append(np.array(found, np.int64))

    def times(self, pairs: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Step at which the walk meets every pair of characters of every text.

        ``first`` and ``count``: place and number of each text's pairs. Texts are walked side
        by side, the long ones at the end one by one.
        """
        out = np.zeros(len(pairs), np.int32)
        order = np.argsort(-count, kind="stable")
        start, count = first[order], count[order]
        now = np.zeros(len(order), np.int32)
        long_enough = np.searchsorted(-count, -np.arange(count[0] if len(count) else 0), "left")
        at = 0
        for active in long_enough:
            if active < FEW:
                break
            place = start[:active] + at
            time = now[:active]
            out[place] = time
            time += self.two[((time & (PHASES - 1)) << 10) + pairs[place]]
            at += 1
        two = self.two.tolist() if len(count) and at < count[0] else []
        for text in range(len(count)):
            if count[text] <= at:
                break
            low, high = start[text] + at, start[text] + count[text]
            time, met = int(now[text]), []
            for pair in pairs[low:high].tolist():
                met.append(time)
                time += two[((time & 255) << 10) + pair]
            out[low:high] = met
        return out


def embed(texts: pa.Array, walks: list[Walk]) -> np.ndarray:
    """(texts, WALKS * SLOTS) bytes. Equal texts have equal rows; an empty text has zeros."""
    data, offsets = text_bytes(texts)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    bounds = lead[offsets]
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(code) != bounds[-1]:      # not UTF-8: every byte is a character
        code, bounds = data.astype(np.uint32), offsets
    n = np.diff(bounds)
    count = (n + 1) // 2
    first = np.cumsum(count) - count
    place = np.arange(len(code)) + np.repeat(2 * first - bounds[:-1], n)
    kind = np.zeros(2 * int(count.sum()), np.uint16)
    kind[place] = (code * np.uint32(0x9E3779B1)) >> np.uint32(27)
    pairs = (kind[0::2] << np.uint16(5)) | kind[1::2]
    out = np.zeros((len(texts), len(walks) * SLOTS), np.uint8)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    code = np.append(code, np.zeros(2, np.uint32))
    for w, walk in enumerate(walks):
        met = walk.times(pairs, first, count)
        key = met + (np.repeat(np.arange(len(n)), count) << 34)
        step = np.stack([r[np.searchsorted(r, 2 * n[full], "left") - 1] for r in walk.records], 1)
        pair = np.searchsorted(key, (step + (full << 34)[:, None]).ravel(), "right") - 1
        pair = pair.reshape(step.shape)
        passed = step - met[pair]
        at = 2 * (pair - first[full][:, None])
        at += passed >= walk.stay[met[pair] & (PHASES - 1), kind[2 * pair]]
        whole = walk.two[((met[pair] & (PHASES - 1)) << 10) + pairs[pair]]
        gone = (at >= n[full][:, None]) | (passed >= whole)  # the walk has left the text
        here = np.minimum(at, n[full][:, None] - 1) + bounds[full][:, None]
        end = bounds[full + 1][:, None]
        # a step shows the character it reads and the two after it, as one byte
        seen = code[here] * np.uint32(0x85EBCA6B)
        for i in (1, 2):
            after = np.where(here + i < end, code[np.minimum(here + i, len(code) - 1)], 0)
            seen = (seen ^ after.astype(np.uint32)) * np.uint32(0xC2B2AE35)
        seen = ((seen >> np.uint32(16)) % np.uint32(255) + np.uint32(1)).astype(np.uint8)
        seen[gone] = 0
        out[full, w * SLOTS:(w + 1) * SLOTS] = seen
    return out


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The other columns of ``docs`` with the fingerprint (binary) of ``text`` in its place.

    A null text is empty, and an empty text's fingerprint is zero bytes. Repeated rows and equal
    texts have equal fingerprints. No shuffle.
    """
    kept = [c for c in docs.columns if c not in (text, out)]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(out, BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(w) for w in range(WALKS)]
        for piece in pieces(batches, text, PIECE):
            found = [row.tobytes() for row in embed(piece.column(text), walks)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in kept] + [pa.array(found, pa.binary())], [*kept, out])

    return docs.select(*kept, text).mapInArrow(run, schema)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row."""
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


BANDS, SAMPLES = 32, 6


def band_slots(bands: int = BANDS, samples: int = SAMPLES) -> np.ndarray:
    """(bands, samples) slots that each band looks at, the same for all fingerprints."""
    draw = np.random.default_rng([SEED, bands, samples])
    return np.stack([draw.choice(WALKS * SLOTS, samples, replace=False) for _ in range(bands)])


def shares_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two fingerprints agree in all slots of some band, row by row."""
    return (a == b)[:, band_slots()].all(2).any(1)


def band_keys(fingerprint: Column, bands: int = BANDS, samples: int = SAMPLES) -> Column:
    """array<bigint>: one hash of its sampled slots per band."""
    return F.array(*[
        F.xxhash64(F.lit(band), *[F.substring(fingerprint, int(s) + 1, 1) for s in slots])
        for band, slots in enumerate(band_slots(bands, samples))])


def near_texts(printed: DataFrame, least: float = 0.8, bands: int = BANDS,
               samples: int = SAMPLES, key: str = "doc_id") -> DataFrame:
    """(a, b, likeness) between one representative of every distinct fingerprint.

    ``printed`` has ``key`` and ``fingerprint``; equal fingerprints are represented by their
    smallest key, so copies are never paired. In each band, every fingerprint is compared with
    the smallest key of its band's bucket rather than with all others, and the verified links
    of all bands together connect what is near: no bucket, however large, makes more
    candidates than it has members.
    """
    rows = printed.groupBy("fingerprint").agg(F.min(key).alias("key")).where("key IS NOT NULL")
    banded = rows.select("key", "fingerprint",
                         F.explode(band_keys(F.col("fingerprint"), bands, samples)).alias("bucket"))
    heads = banded.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("n")) \
        .where("n > 1").select("bucket", "head")
    pairs = banded.select("key", "bucket").join(heads, "bucket").where("key <> head") \
        .select("head", "key").distinct()
    equal = F.expr(f"""aggregate(sequence(1, {WALKS * SLOTS}), 0, (s, i) -> s + CAST(
        substring(fa, i, 1) = substring(fb, i, 1) AS INT))""") / F.lit(WALKS * SLOTS)
    a = rows.select(F.col("key").alias("head"), F.col("fingerprint").alias("fa"))
    b = rows.select("key", F.col("fingerprint").alias("fb"))
    return pairs.join(a, "head").join(b, "key").select(
        F.col("head").alias("a"), F.col("key").alias("b"), equal.alias("likeness")) \
        .where(F.col("likeness") >= least)


def with_next(docs: DataFrame, bucket_rows: int = 1024) -> DataFrame:
    """(doc_id, bucket, place, text, next_text) in ascending order of doc_id; the last row's next is the first.

    Null texts are empty. Rows without doc_id come first, in the order of a hash of their text; rows
    that repeat a doc_id follow each other in that order. Ids are cut into ranges of about
    ``bucket_rows`` rows, each ordered by itself; the first rows of all ranges close the gaps.
    Ids that lie very unevenly make uneven ranges: slower, never wrong.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ranges = max(1, n // bucket_rows)
    width = max(1, ((high or 0) - (low or 0)) // ranges + 1)
    place = F.xxhash64("text")
    bucket = F.coalesce(
        F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)).cast("long"),
        F.pmod(place, F.lit(ranges)) - ranges)
    rows = rows.select("doc_id", "text", bucket.alias("bucket"), place.alias("place"))
    within = Window.partitionBy("bucket").orderBy("doc_id", "place")
    # the first row of each range, and the range that follows each one
    first = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    chain = first.select("bucket", F.coalesce(
        F.lag("bucket").over(Window.orderBy("bucket")),
        F.max("bucket").over(Window.orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"),
        F.col("first.doc_id").alias("doc_id"), F.col("first.place").alias("place"))
    heads = rows.select(F.col("bucket").alias("b"), F.col("doc_id").alias("d"),
                        F.col("place").alias("p"), F.col("text").alias("head_text")).join(
        F.broadcast(chain) if ranges <= 10_000 else chain,
        (F.col("b") == F.col("bucket")) & F.col("d").eqNullSafe(F.col("doc_id"))
        & (F.col("p") == F.col("place"))) \
        .groupBy("before").agg(F.first("head_text").alias("head_text"))
    ordered = rows.withColumn("inner_next", F.lead("text").over(within)) \
        .withColumn("nth", F.row_number().over(within))
    heads = heads.select(F.col("before").alias("bucket"), "head_text")
    return ordered.join(heads, "bucket", "left").select(
        "doc_id", "bucket", "nth", "text", F.col("inner_next").isNull().alias("ends"),
        F.coalesce("inner_next", "head_text").alias("next_text"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, its edited text's, and how alike they and the next text's are.

    The edited text has the last quarter of its code points (rounded down) replaced by as many
    from the start of the next text, or all of it. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (hex), near_edited, near_next, and candidate_edited and
    candidate_next: whether the pair shares a band. A single document is its own next.
    """
    n = F.char_length("text")
    keep = n - F.floor(n / 4).cast("int")
    rows = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring(F.col("text"), F.lit(1), keep),
                 F.substring(F.col("next_text"), F.lit(1), n - keep)).alias("edited"),
        F.when(F.col("ends"), F.col("next_text")).alias("far_text"), "bucket", "nth")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256)) \
        .sortWithinPartitions("bucket", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [Walk(w) for w in range(WALKS)]
        held = None            # the last row of a piece waits for the next row's fingerprint
        for piece in pieces(batches, "text", PIECE):
            own, edited = embed(piece.column("text"), walks), embed(piece.column("edited"), walks)
            ends = piece.column("far_text").is_valid().to_numpy(zero_copy_only=False)
            after = np.zeros_like(own)
            after[:-1] = own[1:]
            if ends.any():
                after[ends] = embed(piece.column("far_text").filter(pa.array(ends)), walks)
            if held is not None:
                yield _result(*held[:3], own[:1])
                held = None
            stay = piece.num_rows - (not ends[-1])
            if stay < piece.num_rows:
                held = (piece.slice(stay), own[stay:], edited[stay:])
            if stay:
                yield _result(piece.slice(0, stay), own[:stay], edited[:stay], after[:stay])
        if held is not None:
            raise ValueError("rows out of order")

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                "edited_fingerprint string, near_edited double, near_next double, "
                                "candidate_edited boolean, candidate_next boolean")


def _result(rows: pa.RecordBatch, own: np.ndarray, edited: np.ndarray,
            after: np.ndarray) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256"]
    return pa.RecordBatch.from_arrays(
        [rows.column(c) for c in names]
        + [pa.array([r.tobytes().hex() for r in x], pa.string()) for x in (own, edited)]
        + [pa.array(f(own, x)) for f in (likeness, shares_band) for x in (edited, after)],
        [*names, "fingerprint", "edited_fingerprint", "near_edited", "near_next",
         "candidate_edited", "candidate_next"])
