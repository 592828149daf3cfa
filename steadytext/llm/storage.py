"""Written tables that cut lineage, in the folder the cluster shares for checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame

from steadytext.sources.scratch import scratch_path


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as a table and read them back.

    What follows starts from the files, so a lost executor costs no more than the tasks
    it ran. The folder is new on every call.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "steadytext")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
