"""Batch scoring hooks for user-supplied models, and a native classifier.

These are the only places where Python workers run. The loader is called once
per worker and gets whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from steadytext import constants as K
from steadytext.functions import probs as P
from steadytext.functions.hashing import draw
from steadytext.functions.similarity import sparse_counts
from steadytext.functions.text import guard_polarity, tokens
from steadytext.operators.frames import join_lookup

# loader() -> fn(array of texts) -> array [n, k]
Loader = Callable[[], Callable]


_KEY = "_text_digest"


def _keyed(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(_KEY, F.sha2(F.col(text), 256))


def score_distinct(df: DataFrame, loader: Loader, text: str = "text", out: str = "probs",
                   batch_size: int = 256, element=T.DoubleType) -> DataFrame:
    """One row (digest, text, out) per distinct text, scored once however often it occurs.

    Texts are told apart by their SHA-256; each crosses one shuffle, to become distinct.
    """
    score = predict_batch_udf(loader, return_type=T.ArrayType(element()),
                              batch_size=batch_size)
    return (_keyed(df.select(text), text).filter(F.col(text).isNotNull())
            .dropDuplicates([_KEY]).select(_KEY, text, score(F.col(text)).alias(out)))


def _attached(df: DataFrame, scored: DataFrame, text: str) -> DataFrame:
    """The scores joined back by digest; no text is a key."""
    joined = join_lookup(_keyed(df, text), scored.drop(text), [_KEY])
    return joined.drop(_KEY)


def score_text(df: DataFrame, loader: Loader, model_order: Sequence[str] = K.SCORER_ORDER,
               order: Sequence[str] = K.SCORER_ORDER, text: str = "text",
               batch_size: int = 256) -> DataFrame:
    """Add probabilities in ``order`` and the label of the largest one."""
    scored = score_distinct(df, loader, text, "_raw", batch_size)
    names = F.array(*[F.lit(x) for x in model_order])
    ordered = scored.select(_KEY, text, P.reorder(F.map_from_arrays(names, F.col("_raw")), order)
                            .alias("probs"))
    ordered = ordered.withColumn("label", P.argmax_label(F.col("probs"), order))
    return _attached(df, ordered, text)


def score_teacher(df: DataFrame, loader: Loader | None, model_order: Sequence[str],
                  order: Sequence[str] = K.REWARD_ORDER, text: str = "orig_text",
                  out: str = "p_teacher", batch_size: int = 256) -> DataFrame:
    """Add the second scorer's probabilities; ``None`` disables it (null column)."""
    if loader is None:
        return df.withColumn(out, F.lit(None).cast("array<double>"))
    scored = score_distinct(df, loader, text, "_raw", batch_size)
    names = F.array(*[F.lit(x) for x in model_order])
    return _attached(df, scored.select(_KEY, text, P.reorder(
        F.map_from_arrays(names, F.col("_raw")), order).alias(out)), text)


def forgiving(loader: Loader, classes: int) -> Loader:
    """The loader's model, with a row of NaN for every text that it fails on.

    A batch that fails is tried text by text, so one text never takes others with it.
    """
    def load():
        import numpy as np

        predict = loader()

        def one(text):
            try:
                return np.asarray(predict(np.array([text], dtype=object)), dtype="float64")[0]
            except Exception:
                return np.full(classes, np.nan)

        def guarded(texts):
            try:
                return np.asarray(predict(texts), dtype="float64")
            except Exception:
                return np.stack([one(t) for t in texts])

        return guarded

    return load


def guard_by_model(rows: DataFrame, rewrite: Column, loader: Loader, store,
                   model_order: Sequence[str] = K.SCORER_ORDER, text: str = "text",
                   out: str = "pert", batch_size: int = 256) -> DataFrame:
    """``rewrite`` where the model gives both texts the same label, else the text itself.

    Rewrites are made once and kept by ``store`` (DataFrame -> DataFrame, a write to shared storage
    and a read). Their different texts, and those they came from, are scored in one pass, kept too, and meet
    the rows by digest; a rewrite that changes nothing is not scored. Where the model fails, or gives a
    probability that is not finite, for either text, the text stays. A null rewrite or text
    gives the text.
    """
    made = store(rows.withColumn("_new", rewrite))
    changed = made.filter(F.col(text) != F.col("_new"))
    both = changed.select(F.explode(F.array(F.col(text), F.col("_new"))).alias("text"))
    scored = score_distinct(both, forgiving(loader, len(model_order)), "text", "_p", batch_size)
    finite = F.forall("_p", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    labels = store(scored.select(
        _KEY, F.when(finite, P.argmax_label(F.col("_p"), model_order)).alias("_y")))
    keyed = made.withColumns({"_old_key": F.sha2(text, 256), "_new_key": F.sha2("_new", 256)})
    for side in ("old", "new"):
        named = labels.select(F.col(_KEY).alias(f"_{side}_key"), F.col("_y").alias(f"_{side}_label"))
        keyed = join_lookup(keyed, named, [f"_{side}_key"])
    kept = guard_polarity(F.col(text), F.col("_new"), F.col("_old_label"), F.col("_new_label"))
    return keyed.select(*rows.columns, kept.alias(out))


def embed_text(df: DataFrame, loader: Loader, text: str = "text", out: str = "embedding",
               batch_size: int = 256) -> DataFrame:
    """Add a sentence vector from a supplied encoder."""
    return _attached(df, score_distinct(df, loader, text, out, batch_size, T.FloatType), text)


def hashed_terms(df: DataFrame, text: str = "text", out: str = "embedding",
                 dimensions: int = 1 << 12) -> DataFrame:
    """Native stand-in for an encoder: hashed term counts as a sparse vector.

    A token's place is the seeded digest of the token modulo ``dimensions``. The vector is
    (size, indices, values) with rising indices, see ``functions.similarity.cosine_sparse``; it is as
    long as the text has different terms, whatever the dimensions. A null text gives null.
    """
    places = F.transform(tokens(F.col(text)), lambda t: F.pmod(draw("term", t), F.lit(dimensions)).cast("int"))
    return df.withColumn(out, sparse_counts(places, dimensions))


def text_features(features: int = 1 << 16) -> Pipeline:
    """Hashed terms without stop words, weighed by rarity."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_terms", pattern=r"\W+"),
        StopWordsRemover(inputCol="_terms", outputCol="_content"),
        HashingTF(inputCol="_content", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="features")])


@dataclass(frozen=True)
class Fitted:
    """A text classifier, the setting chosen and the log loss of every setting that was tried."""

    model: PipelineModel
    reg: float
    max_iter: int
    eval_loss: float | None
    tried: tuple[tuple[float, int, float], ...]     # (reg, max_iter, log loss)


def log_loss(scored: DataFrame, p: str = "_probability", label: str = "_label") -> DataFrame:
    """(log_loss): mean of minus the log of the probability of the true class, clamped from below."""
    true = F.get(vector_to_array(p), F.col(label).cast("int"))
    return scored.agg(F.avg(-F.log(F.greatest(true, F.lit(K.PROB_FLOOR)))).alias("log_loss"))


def train_classifier(train: DataFrame, evaluation: DataFrame | None = None,
                     order: Sequence[str] = K.REWARD_ORDER, features: int = 1 << 16,
                     regs: Sequence[float] = (1e-4, 1e-3, 1e-2),
                     iterations: Sequence[int] = (10, 20)) -> Fitted:
    """Text classifier whose probabilities come in ``order``.

    Features are fitted on the training part once. Every pair of regularisation and number of iterations
    is fitted and measured by its log loss on ``evaluation``, and the best one is kept (the
    stronger regularisation, then fewer iterations, on a tie). Without rows to evaluate, the middle
    regularisation and the most iterations are taken. Rows with a label outside ``order`` take no part.
    """
    names = F.array(*[F.lit(x) for x in order])

    def labelled(rows):
        found = rows.withColumn("_label", (F.array_position(names, F.col("sentiment")) - 1).cast("double"))
        return found.filter("_label >= 0").select("text", "_label")

    prepared = text_features(features).fit(labelled(train))
    ready = prepared.transform(labelled(train)).select("features", "_label").persist()
    held = None if evaluation is None else prepared.transform(labelled(evaluation)).select(
        "features", "_label").persist()
    tried, best = [], None
    grid = [(reg, n) for reg in sorted(regs, reverse=True) for n in sorted(iterations)]
    if held is None or not held.take(1):
        grid = [(sorted(regs)[len(regs) // 2], max(iterations))]
    for reg, n in grid:
        fit = LogisticRegression(featuresCol="features", labelCol="_label", maxIter=n, regParam=reg,
                                 family="multinomial", probabilityCol="_probability").fit(ready)
        loss = None if len(grid) == 1 and held is None else log_loss(fit.transform(held)).first()[0]
        tried.append((reg, n, loss))
        if best is None or (loss is not None and loss < best[3]):
            best = (fit, reg, n, loss)
    for kept in (ready, held):
        if kept is not None:
            kept.unpersist()
    model = PipelineModel([*prepared.stages, best[0]])
    return Fitted(model, best[1], best[2], best[3], tuple(tried))


def classify(model: PipelineModel | Fitted, df: DataFrame,
             order: Sequence[str] = K.REWARD_ORDER) -> DataFrame:
    """Add ``probs`` and ``y_pred``."""
    scored = getattr(model, "model", model).transform(df).select(*df.columns,
                                        vector_to_array("_probability").alias("probs"))
    return scored.withColumn("y_pred", P.argmax_label(F.col("probs"), order))
