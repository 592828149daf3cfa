"""Prompt frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steadytext.functions import text as X


def rows_for_reward(rows: DataFrame) -> DataFrame:
    """Prompts of the source and the perturbed text with the label.

    The source text defaults to ``text``; without a perturbed text its prompt is null.
    """
    has = set(rows.columns)
    text = F.col("text")
    orig = F.coalesce(F.col("orig_text"), text) if "orig_text" in has else text
    pert = F.col("pert_text") if "pert_text" in has else F.lit(None).cast("string")
    keys = [c for c in ("sample_id", "batch_id") if c in has]
    return rows.select(
        *keys, X.eval_prompt(orig).alias("prompt"), X.eval_prompt(pert).alias("pert_prompt"),
        F.col("sentiment").alias("ground_truth"), orig.alias("orig_text"),
        pert.alias("pert_text"))


def prompt_frames(split: DataFrame) -> DataFrame:
    """Prompts of a train / test / eval frame; test prompts leave the label open."""
    is_test = F.col("split") == "test"
    text, label = F.col("text"), F.col("sentiment")
    keys = [c for c in ("sample_id", "split", "draw") if c in split.columns]
    return split.select(
        *keys,
        F.when(is_test, X.eval_prompt(text)).otherwise(X.train_prompt(text, label))
        .alias("prompt"),
        F.when(is_test, label).alias("y_true"))
