"""Registered queries of the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from steadytext.llm import (bpe, fingerprints, hosts, language, lm, mixing, negatives, neighbours, quality,
                            simhash, spans, toxicity, wrappers)
from steadytext.llm.sampling import fold
from steadytext.llm.storage import stored


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# allow or block, host, beginning of the path
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_likeness(_table(spark, sf, "documents"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's severity; the fit sees labelled documents of folds 1 to 4 only."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, _table(spark, sf, "labels").where(fold() != 0))
    scored = toxicity.severity(docs.withColumn("held_out", fold() == 0), model).drop("text")
    return scored.withColumn("toxic", F.col("rejected").cast("int")).drop("rejected")


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, _table(spark, sf, "labels").where(fold() != 0))
    scored = quality.score(docs.withColumn("held_out", fold() == 0), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return lm.score(docs, lm.fit(docs))


def op5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = language.fit_language(docs.select("doc_id", "text", "lang").where(fold() != 0))
    found = language.predict(docs.select("doc_id", "text", (fold() == 0).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"),
                        F.col("lang_rejected").alias("rejected"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf, "documents").select("doc_id", "text"))
    return groups.select("doc_id", simhash.as_hex(F.col("simhash")).alias("fingerprint"),
                         "component_id")


def op8_html(spark: SparkSession, sf: str) -> DataFrame:
    pages = _table(spark, sf, "pages")
    found = wrappers.extract(pages, stored(wrappers.induce(pages)))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf, "documents")).drop("source")


def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(_table(spark, sf, "documents"), tokenizer_path())


def op11_urls(spark: SparkSession, sf: str) -> DataFrame:
    judged = hosts.judge_urls(_table(spark, sf, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_spans(spark: SparkSession, sf: str) -> DataFrame:
    found = spans.aligned(_table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"),
                          tokenizer_path("piece_bpe_32k.model"))
    told = spans.with_corpus_counts(found, stored(spans.pair_counts(found)))
    return told.select("doc_id", *spans.COUNTS, "n_best", "count_sum", "groups_sha256")


def op13_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf, "embeddings").withColumn("label", label),
                                    lambda vec_id: vec_id % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_lm": op4_lm,
    "op5_neighbours": op5_neighbours,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_html": op8_html,
    "op9_mixing": op9_mixing,
    "op10_bpe": op10_bpe,
    "op11_urls": op11_urls,
    "op12_spans": op12_spans,
    "op13_negatives": op13_negatives,
}
ORACLES: dict[str, str] = {
    "op11_urls": hosts.oracle_sql(URL_RULES),
    "op13_negatives": negatives.ORACLE_SQL,
}
