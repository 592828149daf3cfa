"""Classification and robustness metrics.

Reports start from counts per (true, predicted): at most a few rows whatever the
size of the input, combined on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from steadytext import constants as K
from steadytext.functions import probs as P
from steadytext.functions.labels import label_to_int


def encode(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Integer labels; anything unknown counts as neutral."""
    return df.withColumn(y_true, label_to_int(F.col(y_true))).withColumn(
        y_pred, label_to_int(F.col(y_pred)))


def _same(t: str, p: str) -> Column:
    return (F.col(t) == F.col(p)).cast("int")


def accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.agg(F.avg(_same(y_true, y_pred)).alias("accuracy"))


def accuracy_per_label(df: DataFrame, y_true: str = "y_true",
                       y_pred: str = "y_pred") -> DataFrame:
    return df.groupBy(F.col(y_true).alias("label")).agg(
        F.avg(_same(y_true, y_pred)).alias("accuracy"))


def _ratio(x: Column, n: Column) -> Column:
    return F.coalesce(x / F.nullif(n, F.lit(0).cast("long")), F.lit(0.0))


def label_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                 group: Sequence[str] = ()) -> DataFrame:
    """Hits, predicted and true rows per label occurring on either side."""
    cells = df.groupBy(*group, y_true, y_pred).agg(F.count("*").alias("n"))
    t, p, n = F.col(y_true), F.col(y_pred), F.col("n")
    zero = F.lit(0).cast("long")
    sides = cells.select(*group, F.inline(F.array(
        F.struct(t.alias("label"), F.when(t == p, n).otherwise(zero).alias("hit"),
                 n.alias("support"), zero.alias("predicted")),
        F.struct(p.alias("label"), zero.alias("hit"), zero.alias("support"),
                 n.alias("predicted")))))
    return sides.groupBy(*group, "label").agg(
        F.sum("hit").alias("hit"), F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"))


def label_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                  group: Sequence[str] = ()) -> DataFrame:
    counts = label_counts(df, y_true, y_pred, group)
    return counts.select(
        *group, "label", _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
        "support", "hit")


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                          group: Sequence[str] = ()) -> DataFrame:
    """Per label precision, recall, F1, support; then accuracy, macro and weighted means."""
    per = label_metrics(df, y_true, y_pred, group)
    total = F.sum("support")

    def weighted(c):
        return F.sum(F.col(c) * F.col("support")) / total

    names = ("precision", "recall", "f1")
    acc = F.sum("hit") / total
    kinds = {"accuracy": [acc] * 3, "macro avg": [F.avg(c) for c in names],
             "weighted avg": [weighted(c) for c in names]}
    rows = [F.struct(F.lit(kind).alias("label"), *[v.alias(c) for v, c in zip(vals, names)],
                     total.alias("support")) for kind, vals in kinds.items()]
    means = per.groupBy(*group).agg(F.array(*rows).alias("_rows"))
    summary = means.select(*group, F.inline("_rows"))
    return per.select(*group, F.col("label").cast("string").alias("label"), *names,
                      "support").unionByName(summary)


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                     labels: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """One row per true label, one column per predicted label, zero filled."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in labels], "label int")
    cells = df.groupBy(F.col(y_true).alias("label")).agg(*[
        F.count_if(F.col(y_pred) == x).alias(f"pred_{x}") for x in labels])
    return wanted.join(cells, "label", "left").na.fill(0)


def flip_rate(df: DataFrame, a: str = "pred_clean", b: str = "pred_pert") -> DataFrame:
    """Share of pairs whose predictions differ; null for no pairs."""
    return df.agg(F.avg((F.col(a) != F.col(b)).cast("int")).alias("flip_rate"))


def _finite_pair(p: str, q: str) -> Column:
    return P.all_finite(F.col(p)) & P.all_finite(F.col(q))


def finite_rows(df: DataFrame, p: str = "p_clean", q: str = "p_pert") -> DataFrame:
    """Rows whose two vectors hold finite numbers only."""
    return df.filter(F.coalesce(_finite_pair(p, q), F.lit(False)))


def sym_kl_term(p: Column, q: Column, eps: float = K.METRIC_FLOOR) -> Column:
    return P.sym_kl(P.clamp(p, eps, 1.0), P.clamp(q, eps, 1.0))


def sym_kl_mean(df: DataFrame, p: str = "p_clean", q: str = "p_pert",
                eps: float = K.METRIC_FLOOR) -> DataFrame:
    """Mean symmetric KL over finite rows, and the number of dropped rows."""
    ok = F.coalesce(_finite_pair(p, q), F.lit(False))
    value = F.when(ok, sym_kl_term(F.col(p), F.col(q), eps))
    return df.agg(F.coalesce(F.avg(value), F.lit(float("nan"))).alias("sym_kl"),
                  F.count_if(~ok).alias("dropped"))


def macro_f1(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
             labels: Sequence = K.REWARD_ORDER) -> DataFrame:
    """Mean F1 over a fixed list; a listed label that never occurs counts 0."""
    total = F.sum(F.when(F.col("label").isin(list(labels)), F.col("f1")))
    return label_metrics(df, y_true, y_pred).agg(
        (F.coalesce(total, F.lit(0.0)) / len(labels)).alias("macro_f1"))


FINANCE = ("negative_recall", "neutral_f1", "positive_precision")


def finance_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                    group: Sequence[str] = ()) -> DataFrame:
    """Recall of negative, F1 of neutral, precision of positive."""
    t, p = F.col(y_true), F.col(y_pred)

    def n(condition):
        return F.count_if(condition)

    return df.groupBy(*group).agg(
        _ratio(n((t == 0) & (p == 0)), n(t == 0)).alias("negative_recall"),
        _ratio(2 * n((t == 1) & (p == 1)), n(t == 1) + n(p == 1)).alias("neutral_f1"),
        _ratio(n((t == 2) & (p == 2)), n(p == 2)).alias("positive_precision"))


def robustness_report(pairs: DataFrame) -> DataFrame:
    """Clean and perturbed quality with flip rate and symmetric KL, one row per metric.

    Each variant also has its finance metrics: recall of negative, F1 of neutral, precision of positive.

    The cells of each variant's confusion matrix are the metrics ``confusion <true> <predicted>``.
    ``pairs`` has ``y_true, pred_clean, pred_pert, p_clean, p_pert``. Labels and
    probabilities are separate measurements: neither is derived from the other.
    """
    variants = F.inline(F.array(
        F.struct(F.lit("clean").alias("variant"), F.col("pred_clean").alias("y_pred")),
        F.struct(F.lit("perturbed").alias("variant"), F.col("pred_pert").alias("y_pred"))))
    coded = encode(pairs.select("y_true", variants))
    report = classification_report(coded, group=["variant"])
    quality = report.select(F.inline(F.array(*[F.struct(
        F.col("variant"), F.concat(F.lit(c + " "), F.col("label")).alias("metric"),
        F.col(c).alias("value")) for c in ("precision", "recall", "f1")])))
    quality = quality.filter(~F.col("metric").isin("recall accuracy", "f1 accuracy"))
    quality = quality.withColumn("metric", F.when(
        F.col("metric") == "precision accuracy", "accuracy").otherwise(F.col("metric")))
    ok = F.coalesce(_finite_pair("p_clean", "p_pert"), F.lit(False))
    drift = pairs.agg(
        F.avg((F.col("pred_clean") != F.col("pred_pert")).cast("int")).alias("flip"),
        F.avg(F.when(ok, sym_kl_term(F.col("p_clean"), F.col("p_pert")))).alias("kl"))
    drift = drift.select(F.inline(F.array(*[F.struct(
        F.lit("pair").alias("variant"), F.lit(name).alias("metric"), F.col(c).alias("value"))
        for name, c in (("flip_rate", "flip"), ("sym_kl", "kl"))])))
    labels = (0, 1, 2)
    cells = coded.groupBy("variant").agg(F.array(*[F.struct(
        F.lit(f"confusion {t} {p}").alias("metric"),
        F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p)).cast("double").alias("value"))
        for t in labels for p in labels]).alias("_cells"))
    finance = finance_metrics(coded, group=["variant"]).select("variant", F.inline(F.array(*[F.struct(
        F.lit(c).alias("metric"), F.col(c).alias("value")) for c in FINANCE])))
    return quality.unionByName(drift).unionByName(cells.select("variant", F.inline("_cells"))) \
        .unionByName(finance)
