"""Verbalizer tables: which token ids stand for a label.

``seeds(label, ord, word)`` are the words to try, ``vocab(word, token_ids)`` is a
supplied tokenisation of spellings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from steadytext import constants as K
from steadytext.functions.text import WHITESPACE, strip
from steadytext.operators.frames import join_lookup


def _lstrip(word: Column) -> Column:
    return F.regexp_replace(word, rf"^{WHITESPACE}+", "")


def tokenized(seeds: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token ids per seed word; a word unknown to ``vocab`` gets an empty array."""
    none = F.array().cast("array<int>")
    return seeds.join(vocab, "word", "left").select(
        *seeds.columns, F.coalesce("token_ids", none).alias("token_ids"))


def variants(word: Column, limit: int = K.MAX_VARIANTS) -> Column:
    """Distinct spellings of a word in the order they are tried."""
    hyphenated = F.regexp_replace(strip(word), WHITESPACE + "+", "-")
    tried = [word, F.concat(F.lit(" "), _lstrip(word)), strip(word), F.lower(word),
             F.upper(word), F.concat(F.lit(" "), _lstrip(F.lower(word))),
             F.concat(F.lit(" "), hyphenated)]
    return F.slice(F.array_distinct(F.array(*tried)), 1, limit)


def choose_variants(seeds: DataFrame, vocab: DataFrame,
                    limit: int = K.MAX_VARIANTS) -> DataFrame:
    """Per seed the first spelling with a single token, else the last one tried."""
    tried = seeds.select("label", "ord", F.col("word").alias("seed"),
                         F.posexplode(variants(F.col("word"), limit)).alias("pos", "word"))
    known = tokenized(tried, vocab)
    choice = F.struct("word", "token_ids")
    single = F.min_by(choice, F.when(F.size("token_ids") == 1, F.col("pos")))
    picked = known.groupBy("label", "ord", "seed").agg(
        F.coalesce(single, F.max_by(choice, "pos")).alias("c"))
    return picked.select("label", "ord", "seed", F.col("c.word").alias("word"),
                         F.col("c.token_ids").alias("token_ids"))


def build_verbalizer(seeds: DataFrame, vocab: DataFrame, prefer_single_token: bool = True,
                     allow_last_token_fallback: bool = True,
                     auto_variant_search: bool = True) -> DataFrame:
    """Status of every seed word: kept with its id, or dropped with the reason.

    The first word of a label that claims an id keeps it. Claims are compared
    through one minimum per (label, id), not by numbering the claimants.
    """
    words = (choose_variants(seeds, vocab) if auto_variant_search
             else tokenized(seeds.withColumn("seed", F.col("word")), vocab))
    n = F.size("token_ids")
    usable = (n == 1) | ((n > 1) & F.lit(prefer_single_token and allow_last_token_fallback))
    claims = words.withColumn("token_id", F.when(usable, F.try_element_at(
        "token_ids", F.lit(-1))))
    winners = (claims.filter(F.col("token_id").isNotNull())
               .groupBy("label", "token_id").agg(F.min("ord").alias("_first")))
    multi_reason = ("multi_token_dropped" if prefer_single_token else "multi_token_ignored")
    kept = F.col("token_id").isNotNull() & (F.col("ord") == F.col("_first"))
    reason = (F.when(kept, F.lit(None).cast("string"))
              .when(F.col("token_id").isNull(), multi_reason)
              .when(n == 1, "dup_token").otherwise("dup_last_token"))
    shown = F.when(kept & (n > 1), F.concat("word", F.lit(" (last)"))).otherwise(F.col("word"))
    return join_lookup(claims, winners, ["label", "token_id"]).select(
        "label", "ord", "seed", shown.alias("word"), "token_ids",
        F.when(kept, F.col("token_id")).alias("token_id"),
        F.coalesce(kept, F.lit(False)).alias("kept"), (n != 1).alias("multi_token"),
        reason.alias("reason"))


def verbalizer_report(verbalizer: DataFrame) -> DataFrame:
    """Long report: one row per label, list (kept, multi_token, dropped) and word.

    The lists stay rows, so that a label with very many words is never gathered.
    """
    lists = F.array_compact(F.array(
        F.when(F.col("kept"), F.lit("kept")), F.when(F.col("multi_token"), F.lit("multi_token")),
        F.when(~F.col("kept"), F.lit("dropped"))))
    return verbalizer.select("label", F.explode(lists).alias("list"), "ord", "word",
                             "token_id", "token_ids", "reason")


def report_counts(verbalizer: DataFrame) -> DataFrame:
    return verbalizer_report(verbalizer).groupBy("label", "list").agg(F.count("*").alias("n"))


def sorted_ids(seeds: DataFrame, vocab: DataFrame,
               default: int | str = K.VERBALIZER_DEFAULT_WORD) -> DataFrame:
    """(label, rank, id): the distinct last tokens of a label's words in order, ranked from 1.

    One row per label and id, so no label's ids are gathered. A label without ids gets the default, an id
    or a word of the vocabulary (an unknown word: null).
    """
    last = F.try_element_at("token_ids", F.lit(-1)).alias("id")
    found = tokenized(seeds, vocab).select("label", last)
    ids = found.where("id IS NOT NULL").distinct()
    lone = found.select("label").distinct().join(ids.select("label"), "label", "left_anti")
    if isinstance(default, str):
        lone = tokenized(lone.withColumn("word", F.lit(default)), vocab).select("label", last)
    else:
        lone = lone.withColumn("id", F.lit(default))
    order = Window.partitionBy("label").orderBy("id")
    return ids.unionByName(lone).select("label", F.row_number().over(order).alias("rank"), "id")


def seed_table(spark: SparkSession,
               seeds: Mapping[str, Sequence[str]] = K.VERBALIZER_SEEDS) -> DataFrame:
    """(label, ord, word) of the words tried per label, by default the published ones."""
    rows = [(label, i, word) for label, words in seeds.items() for i, word in enumerate(words)]
    return spark.createDataFrame(rows, "label string, ord long, word string")
