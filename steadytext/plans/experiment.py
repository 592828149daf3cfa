"""The three whole jobs: baseline, robustness evaluation, reward table.

Each reads labelled rows ``(sample_id, sentiment, text)``, stores the split and the
library under ``root`` (shared storage) so that later stages and later runs reuse
them, and returns a lazy result. Models come as loaders, see ``operators.scoring``.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, functions as F

from steadytext import constants as K
from steadytext.functions.text import eval_prompt
from steadytext.operators import library as L, metrics as M, rewards as R, sampling as S
from steadytext.operators.prompts import rows_for_reward
from steadytext.operators.scoring import Loader, score_text
from steadytext.sources.files import materialize


@dataclass(frozen=True)
class Experiment:
    """``source`` names the input and its version, ``rewrites`` those of the rewrite table; both are
    part of stored paths, and so is the content of the tables themselves, so neither another table
    nor changed rows under the same name find the library of the first."""

    root: str
    source: str
    n_train: int = K.TRAIN_PER_CLASS
    n_test: int = K.TEST_PER_CLASS
    n_eval: int = K.EVAL_PER_CLASS
    seed: int = K.SPLIT_SEED
    eval_seed: int = K.EVAL_SEED
    rewrites: str = ""    # name and version of the rewrite table, if one is used
    model_order: tuple[str, ...] = K.SCORER_ORDER
    library: L.LibraryConfig = field(default_factory=L.LibraryConfig)

    def params(self, **extra) -> dict:
        sizes = {k: v for k, v in asdict(self).items() if k not in ("root", "library", "rewrites")}
        return {**sizes, **extra}


def stored_split(rows: DataFrame, exp: Experiment) -> DataFrame:
    return materialize(
        rows.sparkSession,
        lambda: S.experiment_split(rows, exp.n_train, exp.n_test, exp.n_eval, exp.seed,
                                   exp.eval_seed),
        exp.root, "split", exp.params(), rows)


def part(split: DataFrame, name: str) -> DataFrame:
    return split.filter(F.col("split") == name).select("sample_id", "sentiment", "text")


def stored_library(split: DataFrame, exp: Experiment, name: str,
                   rewrites: DataFrame | None = None) -> DataFrame:
    if (rewrites is None) != (exp.rewrites == ""):
        raise ValueError("name the rewrite table and its version in Experiment.rewrites")
    used = [part(split, name)] + ([] if rewrites is None else [rewrites])
    return materialize(
        split.sparkSession, lambda: L.build_library(part(split, name), exp.library, rewrites),
        exp.root, f"library-{name}",
        exp.params(library=asdict(exp.library), part=name, rewrites=exp.rewrites), used)


def baseline(rows: DataFrame, exp: Experiment, model: Loader) -> DataFrame:
    """Classification report of a model on the clean test prompts."""
    test = part(stored_split(rows, exp), "test").withColumn("prompt", eval_prompt(F.col("text")))
    scored = score_text(test, model, exp.model_order, text="prompt")
    coded = M.encode(scored.select(F.col("sentiment").alias("y_true"),
                                   F.col("label").alias("y_pred")))
    return M.classification_report(coded)


def scored_pairs(rows: DataFrame, exp: Experiment, model: Loader,
                 rewrites: DataFrame | None = None) -> DataFrame:
    """Aligned clean and perturbed test prompts with labels and probabilities of both."""
    split = stored_split(rows, exp)
    library = stored_library(split, exp, "test", rewrites)
    pairs = L.clean_pert_pairs(part(split, "test"), library)
    for side, prompt in (("clean", "clean_prompt"), ("pert", "pert_prompt")):
        scored = score_text(pairs, model, exp.model_order, text=prompt)
        pairs = scored.withColumnsRenamed({"probs": f"p_{side}", "label": f"pred_{side}"})
    return pairs


def robustness(rows: DataFrame, exp: Experiment, model: Loader,
               rewrites: DataFrame | None = None) -> DataFrame:
    """Report of a model on clean and perturbed prompts; scored pairs are stored and read back."""
    pairs = scored_pairs(rows, exp, model, rewrites)
    path = f"{exp.root.rstrip('/')}/scored-{uuid.uuid4().hex}"
    pairs.write.parquet(path)
    return M.robustness_report(rows.sparkSession.read.parquet(path))


def reward_table(rows: DataFrame, exp: Experiment, student: Loader, teacher: Loader | None,
                 anchor: Loader | None, weights: R.RewardWeights = R.RewardWeights(),
                 rewrites: DataFrame | None = None, batch_size: int = 32) -> DataFrame:
    """Rewards of the augmented training rows under the given models.

    Batches hold ``batch_size`` rows at every size of the table, as their statistics need.
    """
    split = stored_split(rows, exp)
    train = part(split, "train")
    data = L.augment_train(train, stored_library(split, exp, "train", rewrites))
    data = rows_for_reward(data).withColumn(
        "sample_id", F.sha2(F.concat_ws("\u0001", "prompt", "pert_prompt", "ground_truth"), 256))
    data = S.assign_exact_batch(data, batch_size)
    order = K.REWARD_ORDER
    wanted = {"p_student": (student, "prompt"), "p_pert": (student, "pert_prompt"),
              "p_anchor": (anchor, "prompt"), "p_teacher": (teacher, "orig_text")}
    for out, (loader, text) in wanted.items():
        if loader is not None:
            data = score_text(data, loader, exp.model_order, order, text).drop(
                "label").withColumnRenamed("probs", out)
    return R.reward_total(data, weights, teacher="p_teacher" if teacher else None,
                          anchor="p_anchor" if anchor else None)
