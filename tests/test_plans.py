"""The physical plans: no cross joins, no global windows, no Python on the text path."""

import re

import pytest
from pyspark.sql import functions as F

from checks import registry, views as V
from checks.score_queries import word_model
from steadytext.operators import joins as J, library as L, rewards as R
from steadytext.plans import experiment as E

registry.load()
SF = "/root/testdata/sf0.01"
# these call a user's model
PYTHON_ALLOWED = {"score_text", "score_teacher", "embed_text", "filter_cascade_vectors",
                  "build_library", "adversarial_tag", "guard_by_model", "reward_total_extra"}
# write their output, or fit a model, before they return a plan
SKIP = {"src_headlines_csv", "src_pairs_csv", "sink_pairs", "sink_predictions",
        "materialize_if_absent", "src_headlines", "train_classifier", "train_classifier_rows"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in SKIP])
def test_plan(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_ALLOWED:
        assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text
    for window in re.findall(r"Window \[.*", text):
        # each window names its partition columns before its order columns
        specs = re.findall(r"windowspecdefinition\(([^,)]+),", window)
        assert specs and not any("specifiedwindowframe" in s for s in specs), window


def formatted(df):
    query = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(query, "formatted")


def scanned(spark, name):
    text = formatted(registry.QUERIES[name](spark, SF))
    return {tuple(sorted(c.split(":")[0] for c in s.split(",")))
            for s in re.findall(r"ReadSchema: struct<(.*?)>\n", text)}


def test_scan_reads_only_the_needed_columns(spark):
    assert scanned(spark, "minibatch_assign") == {("o_orderkey",)}
    assert scanned(spark, "distinct_labels") == {("doc_id", "quality", "toxic")}
    assert scanned(spark, "order_report") == {("o_orderstatus",)}
    # the split counts its buckets without reading what the text is made of
    assert ("o_orderkey", "o_orderstatus") in scanned(spark, "split_stratified")
    assert ("text",) in scanned(spark, "hashed_terms") or ("doc_id", "text") in scanned(
        spark, "hashed_terms")


def test_filter_on_passed_does_not_repeat_the_cascade(spark):
    lib = L.build_library(V.headlines(spark, SF))
    text = plan(L.passed_pairs(lib))
    assert len(re.findall(r"array_intersect", text)) == len(
        re.findall(r"array_intersect", plan(lib.select("sim"))))


HOT = {"spark.sql.shuffle.partitions": "40",
       "spark.sql.autoBroadcastJoinThreshold": "-1",
       "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
       "spark.sql.adaptive.coalescePartitions.enabled": "false",
       "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000"}


@pytest.mark.parametrize("case", ["rewrite", "label", "stats", "scores", "ema"])
def test_hot_keys_are_split(spark, case):
    """A key with a third of the rows is spread by the adaptive skew join."""
    n = 60000
    hot = spark.range(0, n, 1, 8).select(
        F.col("id").alias("sample_id"), F.lit("neutral").alias("sentiment"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("batch_id"),
        F.lit(0).cast("long").alias("run_id"), F.rand(1).alias("reward"))
    hot = hot.withColumn("text", F.concat(F.lit("text number "), F.col("batch_id")))
    hot = hot.withColumn("step", F.col("batch_id"))
    pairs = hot.select(F.col("text").alias("orig"), F.lit("x").alias("rewrite"))
    old = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    try:
        df = {"rewrite": lambda: J.external_rewrite(hot, pairs),
              "label": lambda: J.lookup_label(hot.select(F.col("text").alias("orig"), "reward"),
                                              hot),
              "stats": lambda: R.batch_zscore(hot, "reward"),
              "scores": lambda: L.adversarial_tags(
                  # candidates of one text differ, as its digest is all that they share in a shuffle
                  hot.select("sample_id", F.col("text").alias("orig"), F.concat(
                      "text", F.lit(" "), "sample_id").alias("pert"), F.lit(True).alias("passed")),
                  V.text_scores(hot)),
              "ema": lambda: R.ema_advantage(hot)}[case]()
        rows = df.collect()
        assert len(rows) == n
        assert "skew=true" in plan(df)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_whole_experiment(spark, tmp_path):
    rows = V.headlines(spark, SF)
    exp = E.Experiment(str(tmp_path), "sf0.01", 200, 150, 20, rewrites="views-1")
    report = {r.label: r.f1 for r in E.baseline(rows, exp, word_model()).collect()}
    assert {"accuracy", "macro avg", "0", "1", "2"} <= set(report)
    rob = {(r.variant, r.metric): r.value for r in
           E.robustness(rows, exp, word_model(), V.rewrites(spark, SF)).collect()}
    # the split is exactly balanced, and most rows have a passed candidate
    assert 0 <= rob["pair", "flip_rate"] <= 1 and rob["pair", "sym_kl"] >= 0
    assert rob["clean", "accuracy"] == pytest.approx(report["accuracy"], abs=0.1)
    table = E.reward_table(rows, exp, word_model(), word_model(), word_model(),
                           R.RewardWeights(0.1, 0.3, 0.3, 0.2),
                           V.rewrites(spark, SF), batch_size=16)
    got = table.selectExpr("count(*)", "count(reward)", "max(abs(r_anchor))").first()
    assert got[0] == got[1] > 600 and got[2] == pytest.approx(0)
