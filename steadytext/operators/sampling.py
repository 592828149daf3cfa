"""Splits and samples by seeded rank.

Every sample is a slice of one seeded order per class: rows sorted by
``digest(seed, id)``. A class may hold a third of all rows, so ranks are not
taken by one window per class. The first hex digits of the digest form
equal-sized buckets; bucket sizes are counted with a map-side combine, their
running total gives every bucket its first rank, and only the buckets that
contain wanted ranks are numbered. No task sees more than one bucket, and rows
of other buckets are dropped before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from steadytext import constants as K
from steadytext.functions.hashing import digest, wide_draw
from steadytext.operators.frames import join_lookup

BUCKET_DIGITS = 4  # 65,536 buckets per class: bounds the bucket table


def _keyed(df: DataFrame, by: str, labels: Sequence[str], id_col: str, seed) -> DataFrame:
    return (df.filter(F.col(by).isin(list(labels)))
            .withColumn("_key", digest(seed, id_col))
            .withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS)))


def _buckets(df: DataFrame, by: str, labels: Sequence[str], id_col: str, seed) -> DataFrame:
    """(by, _bucket, _n, _before, _total); at most len(labels) * 65,536 rows."""
    # counting needs neither the texts nor any other column
    counts = (_keyed(df.select(by, id_col), by, labels, id_col, seed)
              .groupBy(by, "_bucket").agg(F.count("*").alias("_n")))
    running = Window.partitionBy(by).orderBy("_bucket")
    return counts.select(
        by, "_bucket", "_n",
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(by)).alias("_total"))


def _ranked(df: DataFrame, wanted: DataFrame, by: str, labels, id_col: str, seed) -> DataFrame:
    """Rows of the wanted buckets with ``_rank``, counted from 1 within ``by``."""
    # wanted is a subset of the bucket table, whose size is bounded by design
    rows = _keyed(df, by, labels, id_col, seed).join(F.broadcast(wanted), [by, "_bucket"])
    within = Window.partitionBy(by, "_bucket").orderBy("_key", id_col)
    return rows.withColumn("_rank", F.col("_before") + F.row_number().over(within))


def split_stratified(df: DataFrame, n_train: int = K.TRAIN_PER_CLASS,
                     n_test: int = K.TEST_PER_CLASS, seed=K.SPLIT_SEED,
                     by: str = "sentiment", id_col: str = "sample_id",
                     labels: Sequence[str] = K.LABELS) -> DataFrame:
    """Disjoint train and test rows of fixed size per class, in a ``split`` column.

    Fails when a class, also an absent one, has fewer than ``n_train + n_test`` rows.
    """
    need = n_train + n_test
    found = _buckets(df, by, labels, id_col, seed)
    sizes = _checked_sizes(found, need, by, labels)
    wanted = (found.join(sizes, by)
              .filter((F.col("_before") < need) & (F.col("_rows") >= need))
              .select(by, "_bucket", "_before"))
    split = F.when(F.col("_rank") <= n_test, "test").otherwise("train")
    return (_ranked(df, wanted, by, labels, id_col, seed)
            .filter(F.col("_rank") <= need)
            .select(*df.columns, split.alias("split")))


CELLS = 1 << 16    # equal shares of a class's ranks, to find a rank's bucket by an equi-join


def _checked_sizes(found: DataFrame, need: int, by: str, labels: Sequence[str]) -> DataFrame:
    """(by, _rows) of every expected class; fails where a class, also an absent one, is too small."""
    totals = found.agg(*[F.max(F.when(F.col(by) == x, F.col("_total"))).alias(f"_t{i}")
                         for i, x in enumerate(labels)])
    too_small = F.raise_error(F.concat(F.lit("class too small for the split: "), F.col(by)))
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(x).alias(by), F.coalesce(f"_t{i}", F.lit(0)).alias("_rows"))
        for i, x in enumerate(labels)]))).select(by, F.when(
            F.col("_rows") >= need, F.col("_rows")).otherwise(too_small.cast("long"))
            .alias("_rows"))


def _draws(spark, sizes: DataFrame, n: int, skip: int, seed, by: str,
           labels: Sequence[str]) -> DataFrame:
    """(by, _rank, draws): the drawn ranks, each with the numbers of its draws."""
    each = spark.range(n).select(
        F.col("id").cast("int").alias("draw"), F.explode(F.array(*map(F.lit, labels))).alias(by))
    rank = F.pmod(wide_draw(seed, by, "draw"), F.col("_rows") - skip) + 1 + skip
    return each.join(sizes, by).select(by, "draw", rank.alias("_rank")).groupBy(by, "_rank").agg(
        F.collect_list("draw").alias("draws"))


def _buckets_of(draws: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """(by, _bucket, _before) of the buckets that hold a drawn rank.

    Ranks and buckets meet on the cell of the class's ranks that they share, and the exact range
    is tested then.
    """
    size = F.ceil(F.col("_total") / CELLS)
    spans = found.select(by, "_bucket", "_before", "_n", F.explode(F.sequence(
        F.floor(F.col("_before") / size), F.floor((F.col("_before") + F.col("_n") - 1) / size)))
        .alias("_cell"))
    totals = found.groupBy(by).agg(F.max("_total").alias("_total"))
    asked = draws.join(totals, by).select(
        by, "_rank", F.floor((F.col("_rank") - 1) / size).alias("_cell"))
    return spans.join(asked, [by, "_cell"]).filter(
        (F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))) \
        .select(by, "_bucket", "_before").distinct()


def sample_with_replacement(df: DataFrame, n: int = K.EVAL_PER_CLASS, seed=K.EVAL_SEED,
                            skip: int = 0, order_seed=K.SPLIT_SEED, by: str = "sentiment",
                            id_col: str = "sample_id",
                            labels: Sequence[str] = K.LABELS) -> DataFrame:
    """``n`` draws per class with replacement, numbered by ``draw``.

    A draw is a random rank, so only the buckets holding drawn ranks are
    numbered. ``skip`` leaves out the first ranks of ``order_seed``: with
    ``skip = n_train + n_test`` the rows not used by ``split_stratified``. Fails when a class,
    also an absent one, has no row left.
    """
    found = _buckets(df, by, labels, id_col, order_seed)
    sizes = _checked_sizes(found, skip + 1, by, labels)
    draws = _draws(df.sparkSession, sizes, n, skip, seed, by, labels)
    wanted = _buckets_of(draws, found, by)
    return (_ranked(df, wanted, by, labels, id_col, order_seed)
            .join(draws, [by, "_rank"])
            .select(*df.columns, F.explode("draws").alias("draw")))


def experiment_split(df: DataFrame, n_train: int = K.TRAIN_PER_CLASS,
                     n_test: int = K.TEST_PER_CLASS, n_eval: int = K.EVAL_PER_CLASS,
                     seed=K.SPLIT_SEED, eval_seed=K.EVAL_SEED, by: str = "sentiment",
                     id_col: str = "sample_id", labels: Sequence[str] = K.LABELS) -> DataFrame:
    """Train, test and eval rows in one frame, marked by ``split``.

    ``draw`` is null but for eval rows, which may repeat. The three parts share one seeded
    order, one table of buckets and one ranked pass over the rows: two scans.
    """
    need = n_train + n_test
    found = _buckets(df, by, labels, id_col, seed)
    sizes = _checked_sizes(found, need + (n_eval > 0), by, labels)
    first = found.join(sizes, by).filter(
        (F.col("_before") < need) & (F.col("_rows") >= need)).select(by, "_bucket", "_before")
    draws = _draws(df.sparkSession, sizes, n_eval, need, eval_seed, by, labels)
    wanted = first.unionByName(_buckets_of(draws, found, by)).distinct()
    ranked = join_lookup(_ranked(df, wanted, by, labels, id_col, seed), draws, [by, "_rank"])
    none = F.lit(None).cast("int")
    split = F.when(F.col("_rank") <= n_test, "test").otherwise("train")
    own = F.when(F.col("_rank") <= need,
                 F.array(F.struct(none.alias("draw"), split.alias("split"))))
    evals = F.transform("draws", lambda d: F.struct(d.alias("draw"), F.lit("eval").alias("split")))
    return ranked.select(*df.columns, F.inline(F.coalesce(own, evals))).select(
        *df.columns, "split", "draw")


def with_shuffle_key(df: DataFrame, seed=K.SHUFFLE_SEED, id_col: str = "sample_id") -> DataFrame:
    """Seeded shuffle order as a column; sort by it at the sink, if at all."""
    return df.withColumn("shuffle_key", digest(seed, id_col))


def sample_batch(df: DataFrame, k: int, step: int, seed=0, id_col: str = "sample_id") -> DataFrame:
    """``k`` rows without replacement for one step: the first of the step's seeded order.

    Rows are counted by the first digits of their digest. Buckets before the one where the ``k``-th row
    lies are taken whole by a filter, and that bucket alone, about one row in 65,536, is ranked.
    So ``k`` may be any number; no row is gathered and nothing is sorted as a whole.
    """
    keyed = df.withColumn("_key", digest(seed, F.lit(step), F.col(id_col))) \
        .withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sizes = keyed.groupBy("_bucket").count().collect()      # 65,536 rows at most
    before, last, missing = 0, None, 0
    for bucket, n in sorted(sizes):
        if before + n >= k:
            last, missing = bucket, k - before
            break
        before += n
    if last is None:
        return df
    within = Window.partitionBy("_bucket").orderBy("_key", id_col)
    tied = keyed.filter(F.col("_bucket") == last).repartition("_bucket") \
        .withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= missing)
    return keyed.filter(F.col("_bucket") < last).select(*df.columns).unionByName(tied.select(*df.columns))


def head_n(df: DataFrame, n: int, id_col: str = "sample_id") -> DataFrame:
    return df.orderBy(id_col).limit(n)


def assign_minibatch(df: DataFrame, batch_size: int, id_col: str = "sample_id") -> DataFrame:
    """Contiguous batches over dense ids, without a global numbering."""
    return df.withColumn("batch_id", F.floor(F.col(id_col) / batch_size).cast("long"))


def assign_hash_batch(df: DataFrame, n_batches: int, id_col: str = "sample_id",
                      seed=0) -> DataFrame:
    """Batches of varying size for ids that are not dense."""
    return df.withColumn("batch_id", F.pmod(wide_draw(seed, id_col), F.lit(n_batches)))


def assign_exact_batch(df: DataFrame, batch_size: int, id_col: str = "sample_id",
                       seed=0) -> DataFrame:
    """Batches of exactly ``batch_size`` rows, the last one aside, for any ids, in seeded order.

    Ranks come from counted buckets as for the splits, so there is no window over all rows.
    """
    one = df.withColumn("_all", F.lit("all"))
    wanted = _buckets(one, "_all", ["all"], id_col, seed).select("_all", "_bucket", "_before")
    return _ranked(one, wanted, "_all", ["all"], id_col, seed).select(
        *df.columns, F.floor((F.col("_rank") - 1) / batch_size).cast("long").alias("batch_id"))


def assign_ordered_batch(df: DataFrame, batch_size: int, store, id_col: str = "sample_id",
                         range_rows: int = 1 << 18) -> DataFrame:
    """Contiguous batches of exactly ``batch_size`` rows in the order of any ids, the last one aside.

    Rows are cut into ranges at sampled quantiles of the id and kept by ``store`` (DataFrame -> DataFrame, a
    write to shared storage and a read), as another sample would cut elsewhere. Ranges are counted,
    and rows are ranked inside their range only. Rows that share an id follow one another in an order
    of their own digest, and may lie in several ranges; null ids come first.
    """
    rows = df.withColumn("_tie", F.xxhash64(*df.columns))
    ranges = max(1, -(-df.count() // range_rows))
    cut = store(rows.repartitionByRange(ranges, id_col, "_tie").withColumn(
        "_range", F.spark_partition_id()))
    counts = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row per range
    before = counts.select("_range", (F.sum("_n").over(
        Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("_range").orderBy(F.asc_nulls_first(id_col), "_tie")
    rank = F.row_number().over(within) - 1 + F.col("_before")
    return cut.join(F.broadcast(before), "_range").select(
        *df.columns, F.floor(rank / batch_size).cast("long").alias("batch_id"))


def drop_unpaired(df: DataFrame, pert: str = "pert") -> DataFrame:
    """Rows that have a perturbed counterpart."""
    return df.filter(F.col(pert).isNotNull())


def batch_pairing(df: DataFrame, batch: str = "batch_id", pert: str = "pert") -> DataFrame:
    """Kept and skipped rows per batch; a batch that keeps none is flagged."""
    kept = F.count_if(F.col(pert).isNotNull())
    return df.groupBy(batch).agg(kept.alias("kept"),
                                 (F.count("*") - kept).alias("skipped"),
                                 (kept == 0).alias("empty"))
