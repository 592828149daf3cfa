"""Readers and writers of headline, pair and prediction files."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

HEADLINES_SCHEMA = "sentiment string, text string"
PAIRS_SCHEMA = "orig string, pert string"
PREDICTIONS_SCHEMA = "text string, y_true string, y_pred string"
_QUOTING = {"quote": '"', "escape": '"'}
# keep blanks around values; write empty texts as empty, not as two quotes
_WRITE = {**_QUOTING, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
          "encoding": "UTF-8"}


def read_headlines_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV of (sentiment, text); bad UTF-8 bytes become U+FFFD.

    Quoted newlines need ``multiLine``, which makes a file unsplittable: convert
    big inputs to Parquet once with ``import_headlines``.
    """
    return spark.read.schema(HEADLINES_SCHEMA).options(
        **_QUOTING, multiLine=True, encoding="UTF-8").csv(path)


def with_sample_id(df: DataFrame, *columns: str) -> DataFrame:
    """Id from the row's content, for files that bring none: a 128-bit digest and a copy number.

    Rows that are equal in all columns are counted and written out again, numbered, in blocks,
    so a row that is repeated very often stays with no single task. ``columns`` (all by
    default) are digested; rows equal in them but not in others share numbers no more than rows
    of their own content do, because all columns take part in the count.
    """
    keys = list(columns) or df.columns
    rest = [c for c in df.columns if c not in keys]
    block = 1 << 16
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
             for c in [*keys, *rest]]
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).withColumn(
        "_digest", F.md5(F.concat_ws("\u0001", *parts)))
    blocks = counted.withColumn("_block", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block))))
    copies = blocks.withColumn("_copy", F.explode(F.sequence(
        F.col("_block") * block, F.least(F.col("_n"), (F.col("_block") + 1) * block) - 1)))
    return copies.select(*df.columns, F.concat_ws(":", "_digest", F.col("_copy"))
                         .alias("sample_id"))


def write_headlines_csv(df: DataFrame, path: str) -> str:
    df.select("sentiment", "text").write.options(**_WRITE).csv(path)
    return path


def import_headlines(spark: SparkSession, csv_path: str, path: str, partitions: int | None = None) -> str:
    """Turn a headlines CSV into Parquet once, with the rows spread over ``partitions`` tasks.

    A CSV file with quoted newlines is one task, so everything later reads the Parquet copy.
    """
    rows = read_headlines_csv(spark, csv_path)
    rows.repartition(partitions or spark.sparkContext.defaultParallelism).write.parquet(path)
    return path


def read_headlines(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_headlines_csv(spark, path) if fmt == "csv" else spark.read.schema(
        HEADLINES_SCHEMA).parquet(path)


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path)
    return reader.options(**_QUOTING, header=True, multiLine=True).csv(path)


def _write(df: DataFrame, path: str, fmt: str) -> str:
    if fmt == "parquet":
        df.write.parquet(path)
    else:
        df.write.options(**_WRITE, header=True).csv(path)
    return path


def read_pairs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, PAIRS_SCHEMA, fmt)


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write (orig, pert); returns the path. CSV, read back as one task per file, is for export."""
    return _write(pairs.select("orig", "pert"), path, fmt)


def write_predictions(rows: DataFrame, predictions: DataFrame, path: str,
                      id_col: str = "sample_id", fmt: str = "parquet") -> str:
    """Write ``text, y_true, y_pred``, joined on the row id. CSV is for export, see ``write_pairs``."""
    joined = rows.join(predictions.select(id_col, "y_pred"), id_col)
    return _write(joined.select("text", F.col("sentiment").alias("y_true"), "y_pred"), path, fmt)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, PREDICTIONS_SCHEMA, fmt)


def content_key(df: DataFrame) -> str:
    """Digest of a table's rows, whatever their order, and of its columns: one aggregate.

    Two sums of 64-bit hashes and the number of rows; equal rows count as often as they occur.
    """
    sums = [F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")) for seed in (1, 2)]
    found = df.agg(F.count("*"), *sums).first()
    return hashlib.sha256(f"{df.schema.json()}{tuple(map(str, found))}".encode()).hexdigest()


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of a path on any Hadoop file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(target)


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its marker."""
    system, marker = _file_system(spark, f"{path}/_SUCCESS")
    return system.exists(marker)


def _publish(spark: SparkSession, beside: str, path: str) -> None:
    """Give a finished folder its final name in one step; if another writer was first, theirs stays."""
    context = spark.sparkContext
    system, target = _file_system(spark, path)
    if system.exists(target) and not _complete(spark, path):
        system.delete(target, True)     # left by a writer that did not finish
    hadoop = context._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(target.toUri(), context._jsc.hadoopConfiguration())
    plain = context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    made = _file_system(spark, beside)[1]
    try:        # unlike a plain rename, this one fails where the target exists
        files.rename(made, target, plain)
    except Py4JJavaError:
        if not _complete(spark, path):
            raise
        system.delete(made, True)


def materialize(spark: SparkSession, build: Callable[[], DataFrame], root: str, name: str,
                params: dict, source: DataFrame | Sequence[DataFrame] | None = None) -> DataFrame:
    """Read the stored result for these parameters, building it if it is absent.

    The parameter hash is part of the path, and so is the content of ``source``, the tables it is built
    from, if they are given: changed rows are built anew under an unchanged version name. A result is
    written beside and published by a rename, so readers see a whole result or none; of two
    writers at once the first one wins and both read its result. What a failed writer left is
    replaced. On a store without an atomic rename the marker of a finished write is what counts.
    """
    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()
    folder = f"{root.rstrip('/')}/{name}"
    path = f"{folder}/params={key[:16]}"
    if source is not None:
        tables = [source] if isinstance(source, DataFrame) else list(source)
        content = hashlib.sha256("".join(map(content_key, tables)).encode()).hexdigest()
        path += f"-{content[:16]}"
    if not _complete(spark, path):
        beside = f"{folder}/_building-{uuid.uuid4().hex}"
        build().write.parquet(beside)
        _publish(spark, beside, path)
    return spark.read.parquet(path)
