"""Input views derived from the test tables, on the Spark side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from steadytext import dictionaries as D
from steadytext import constants as K
from steadytext.functions.hashing import draw
from steadytext.functions.text import tokens
from steadytext.operators.frames import compute_once
from steadytext.operators.verbalizer import variants

HEADLINE_COLUMNS = [
    "o_orderkey AS sample_id",
    "CASE o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'neutral' ELSE 'positive' END"
    " AS sentiment",
    """concat(
    CASE o_custkey % 6 WHEN 0 THEN 'Barclays' WHEN 1 THEN 'Apple' WHEN 2 THEN 'United'
         WHEN 3 THEN 'Nokia' WHEN 4 THEN 'BP' ELSE 'The company' END, ' ',
    CASE o_orderkey % 8 WHEN 0 THEN 'reported strong demand and sales rose'
         WHEN 1 THEN 'missed expectations as profits fell'
         WHEN 2 THEN 'said revenues increased'
         WHEN 3 THEN 'beat expectations while shares soared'
         WHEN 4 THEN 'plunged sharply on weak demand by'
         WHEN 5 THEN 'was up' WHEN 6 THEN 'was down'
         ELSE 'kept its outlook unchanged with growth of' END, ' ',
    CAST(floor((CAST(round(o_totalprice*100) AS bigint) % 300) / 10.0) AS bigint), '.',
    CAST(round(o_totalprice*100) AS bigint) % 10,
    CASE WHEN o_orderkey % 2 = 0 THEN ' %' ELSE '%' END, ' in ', year(o_orderdate)) AS text""",
]


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for a freshly read table that fits fewer partitions.

    Meant for a bare scan ahead of heavy row work. A large table already has more
    partitions than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def headlines(spark, sf, spread: bool = False) -> DataFrame:
    """``spread`` is for the heavy per-row work of the candidate library."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    if spread:
        orders = spread_small(orders, "o_orderkey")
    return orders.selectExpr(*HEADLINE_COLUMNS)


def rewrites(spark, sf) -> DataFrame:
    """Supplied rewrites: one per distinct headline that contains a rewritable word."""
    new = F.replace(F.replace(F.replace("text", F.lit("revenues"), F.lit("turnover")),
                              F.lit("shares"), F.lit("the stock")),
                    F.lit("profits"), F.lit("earnings"))
    # the filter is pushed below the distinct; the text is not put together anew for each use in it
    return (compute_once(headlines(spark, sf), text=F.col("text")).select("text").distinct()
            .select(F.col("text").alias("orig"), new.alias("rewrite"))
            .filter("rewrite <> orig"))


def text_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """Stand-in scorer: probabilities from the text's digest, one row per text."""
    e = F.array(*[(1 + F.pmod(draw(x, text), F.lit(1000))).cast("double")
                  for x in K.REWARD_ORDER])
    return (df.select(F.col(text).alias("text")).distinct()
            .select("text", e.alias("e"))
            .select("text", F.transform("e", lambda x: x / F.aggregate(
                "e", F.lit(0.0), lambda a, v: a + v)).alias("probs")))


def _normal(name):
    return F.transform(name, lambda x: x / F.aggregate(
        name, F.lit(0.0), lambda a, v: a + v))


def prob_pairs(spark, sf) -> DataFrame:
    raw = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS sample_id", "CASE label % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' "
        "ELSE 'positive' END AS sentiment", "label", "CAST(floor(vec_id/8) AS bigint) AS batch_id",
        "CAST(floor(vec_id/32) AS bigint) AS step", "vec_id % 4 AS run_id",
        *[f"transform(slice(embedding,{i},3), x -> exp(4D*x)) AS {n}"
          for n, i in (("e_clean", 1), ("e_pert", 4), ("e_teacher", 7), ("e_anchor", 10))],
        "CASE WHEN label = 3 THEN NULL WHEN label = 4 THEN '' ELSE concat('p', vec_id) END"
        " AS pert_prompt")
    return raw.select(
        "sample_id", "sentiment", F.col("label").alias("cluster"), "batch_id", "step", "run_id",
        "pert_prompt",
        F.col("sentiment").alias("ground_truth"), _normal("e_clean").alias("p_student"),
        _normal("e_pert").alias("p_pert"), _normal("e_teacher").alias("p_teacher"),
        _normal("e_anchor").alias("p_anchor"))


def holed_probs(spark, sf) -> DataFrame:
    """``prob_pairs`` with non-finite entries in some rows and zeros in others."""
    nan, inf, zero = (F.lit(float(x)) for x in ("nan", "inf", "0"))
    p = F.col("p_student")
    holed = (F.when(F.col("cluster") == 9, F.array(nan, p[1], p[2]))
             .when(F.col("cluster") == 8, F.array(p[0], inf, p[2]))
             .when(F.col("cluster") == 7, F.array(p[0], p[1], zero)).otherwise(p))
    return prob_pairs(spark, sf).select(
        "sample_id", "sentiment", holed.alias("p_clean"), "p_pert")


def raw_scores(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS sample_id", "transform(slice(embedding,1,3), x -> CAST(x AS double)) AS s")


def preds(spark, sf) -> DataFrame:
    y = ("CASE WHEN quality=0 THEN 'negative' WHEN toxic=1 THEN 'neutral' "
         "ELSE 'positive' END")
    return table(spark, sf, "labels").selectExpr(
        "doc_id AS sample_id", f"{y} AS y_true",
        "CASE substr(md5(concat('7:',doc_id)),1,1) WHEN '0' THEN 'none' WHEN '1' THEN "
        f"'negative' WHEN '2' THEN 'neutral' WHEN '3' THEN 'positive' ELSE {y} END AS y_pred")


def token_logits(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS sample_id", "posexplode(embedding) AS (token_id, x)").selectExpr(
        "sample_id", "token_id", "CAST(x AS double) AS logit")


def emb_pairs(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("eb"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("sample_id"),
                                      F.col("embedding").alias("ea"), "eb")


def reward_log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id % 4 AS run_id", "CAST(floor(event_id/32) AS bigint) AS step",
        "CAST(floor(event_id/8) AS bigint) AS batch_id",
        "CAST(floor(event_id/4) AS bigint) AS group_id", "event_id AS sample_id",
        "value AS reward")


def documents(spark, sf, spread: bool = True) -> DataFrame:
    """Whole documents; all cores work on them even if they fit one file split."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = spread_small(docs, "doc_id") if spread else docs
    return docs.withColumnRenamed("doc_id", "sample_id")


def doc_pairs(spark, sf) -> DataFrame:
    """Whole documents against a version without two frequent words."""
    return documents(spark, sf).select(
        "sample_id", F.col("text").alias("orig"),
        F.replace(F.replace("text", F.lit(" and "), F.lit(" ")),
                  F.lit(" the "), F.lit(" ")).alias("pert"))


def seeds(spark, sf) -> DataFrame:
    """(label, ord, word): the words of the labelled documents, in order of appearance."""
    y = preds(spark, sf).select("sample_id", F.col("y_true").alias("label"))
    # the label joins the document, before it becomes many words
    words = documents(spark, sf).join(y, "sample_id").select("sample_id", "label", F.posexplode(
        tokens(F.col("text"))).alias("pos", "w"))
    return (words.groupBy("label", "w")
            .agg(F.min(F.struct("sample_id", "pos")).alias("first"))
            .withColumn("ord", F.col("first.sample_id") * (1 << 31) + F.col("first.pos"))
            .select("label", "ord", F.concat(F.lit(" "), F.col("w")).alias("word")))


def vocab(spark, sf) -> DataFrame:
    """(word, token_ids): stand-in tokenisation of all spellings of the seed words."""
    spelled = seeds(spark, sf).select(
        F.explode(variants(F.col("word"))).alias("word")).distinct()

    def token(part):
        return F.pmod(draw(part, "word"), F.lit(50000)).cast("int")

    pieces = F.when(F.length("word") <= 6, F.array(token("a"))).otherwise(
        F.array(token("b"), token("c")))
    return spelled.select("word", pieces.alias("token_ids"))


def verbalizer_ids(spark, sf) -> DataFrame:
    """(label, token_id): each of the 64 token ids of ``token_logits`` that some seed
    word maps to, with the label of the first such word."""
    mapped = seeds(spark, sf).withColumn(
        "token_id", F.pmod(draw("v", "word"), F.lit(64)).cast("int"))
    return mapped.groupBy("token_id").agg(F.min_by("label", F.struct("ord", "label"))
                                          .alias("label")).select("label", "token_id")


def peers(spark) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(K.SECTOR_PEERS)],
                                 "ord int, a string, b string")


GUARDED_NAMES = ["Nokia", "Strong demand rose", "Apple", "fell by", "The"]


def guard_names(spark) -> DataFrame:
    return spark.createDataFrame([(n,) for n in GUARDED_NAMES], "name string")


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame(D.LEXICON_ROWS, D.LEXICON_SCHEMA)
