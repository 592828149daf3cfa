"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters must not recompute.

    A filter on a projected column is pushed below the projection with the
    column's whole expression copied into it, so an expensive expression would
    run once for the filter and once for the output. A generator over a
    one-element array stops that copy and stays inside whole-stage codegen.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def even_parts(df: DataFrame) -> DataFrame:
    """The rows in even parts, several per core, for work far dearer than a row's bytes tell.

    Behind a join the adaptive plan merges parts by their bytes, down to about one per core: one more
    than there are cores doubles the time, and a large row group of a file behind a broadcast stays one
    part. Parts are a quarter of the session's shuffle parts, four per core at least and as many for each
    core: every part costs a start and starts its own dictionaries and partial sums. Rows are dealt in
    turn, so no key, null or frequent, makes a part larger.
    """
    session = df.sparkSession
    cores = session.sparkContext.defaultParallelism
    per_core = -(-int(session.conf.get("spark.sql.shuffle.partitions")) // (4 * cores))
    return df.repartition(cores * max(per_core, 4))


def join_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str],
                how: str = "left") -> DataFrame:
    """Join a lookup with one row per key so that hot keys of ``df`` can be split.

    A lookup is mostly the result of an aggregate, which Spark would join without
    another shuffle. The adaptive skew join handles only sides that come straight
    from a shuffle, so a key held by a third of the rows would stay one task. The
    rebuilt key columns hide the old partitioning: the lookup, which has few rows
    per key by nature, is shuffled once more, and Spark splits the hot keys of
    ``df`` at run time. A small lookup is still broadcast instead.
    """
    fresh = [F.element_at(F.array(F.col(c)), 1).alias(c) if c in keys else F.col(c)
             for c in lookup.columns]
    return df.join(lookup.select(*fresh), list(keys), how)


def text_key(text: str | Column) -> Column:
    """The first 16 bytes of SHA-256, which stand for a text as a join or grouping key.

    Two of 10^12 texts share them with a probability of 10^-15. A null text has none.
    """
    digest = F.sha2(F.col(text) if isinstance(text, str) else text, 256)
    return F.unhex(F.substring(digest, 1, 32))


def join_by_text(df: DataFrame, lookup: DataFrame, text: str, how: str = "left") -> DataFrame:
    """``join_lookup`` on a text column, of which only the digest is shuffled as a key.

    ``lookup`` has one row per text or more; its own copy of the text does not travel.
    """
    keyed = lookup.withColumn("_text_key", text_key(text)).drop(text)
    return join_lookup(df.withColumn("_text_key", text_key(text)), keyed, ["_text_key"], how).drop("_text_key")


def distinct_texts(df: DataFrame, *columns: str) -> DataFrame:
    """Different rows of text columns, told apart by one digest; nulls count as equal."""
    parts = [F.coalesce(F.concat(F.lit("="), F.sha2(F.col(c), 256)), F.lit("-")) for c in columns]
    return df.select(*columns).withColumn("_row_key", text_key(F.concat(*parts))) \
        .dropDuplicates(["_row_key"]).drop("_row_key")


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Attach per-group aggregates to every row.

    Aggregate and join back instead of a window: the aggregate is combined on
    the map side, the statistics of few groups are broadcast at run time, and a
    hot group is split by the adaptive skew join, whereas a window sends every
    row of a group to one task.
    """
    table = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return join_lookup(df, table, keys)


def round6(value: Column) -> Column:
    """Six decimals, with negative zero turned into zero."""
    return F.round(value, 6) + F.lit(0.0)
