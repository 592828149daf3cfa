"""Prepares a training corpus: documents in, mixed and encoded documents out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from steadytext.llm import bpe, language, mixing, simhash, toxicity
from steadytext.llm.queries import tokenizer_path
from steadytext.llm.sampling import fold
from steadytext.llm.storage import stored


BATCH_ROWS = 1000     # whole documents in one batch for Python; the default of 10,000 is meant for short rows


def _in_small_batches(spark: SparkSession) -> None:
    """Bound the memory that batches of whole texts take on both sides, whatever the stage before."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those that language identification rejects go.

    Learned from the given languages of folds 1 to 4.
    """
    _in_small_batches(spark)
    model = language.fit_language(docs.select("doc_id", "text", "lang").where(fold() != 0))
    found = language.predict(docs, model)
    return found.where(~F.col("lang_rejected")).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity scoring does not reject.

    Learned from the labelled documents of folds 1 to 4.
    """
    _in_small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels.where(fold() != 0))
    scored = toxicity.severity(docs, model)
    return scored.where(~F.col("rejected")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike in 0.8 of their five-word shingles or more."""
    _in_small_batches(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shuffled inside output shards."""
    _in_small_batches(spark)
    return mixing.mix(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and number of tokens."""
    _in_small_batches(spark)
    return bpe.encode(docs, tokenizer_path()).withColumn(
        "n_tokens", F.size("token_ids").cast("long"))


STAGES = [("language", identify_language), ("toxicity", drop_toxic),
          ("near_copies", drop_near_copies), ("mix", mix_sources), ("bpe", encode_text)]

ORACLE_SQL = None      # fits, fingerprints and BPE have no SQL counterpart; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
