"""Hand-computed cases of probability arithmetic, metrics and rewards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadytext.functions import labels as Y, probs as P
from steadytext.operators import metrics as M, rewards as R

NAN, INF = float("nan"), float("inf")
from steadytext.operators import token_scores as TS


def value(spark, expr, **columns):
    names = list(columns)
    types = ", ".join(f"{n} {t}" for n, (t, _) in columns.items())
    df = spark.createDataFrame([tuple(v for _, v in columns.values())], types)
    return df.select(expr(*[F.col(n) for n in names])).first()[0]


def arr(v):
    return "array<double>", v


def test_softmax_is_stable_and_sums_to_one(spark):
    p = value(spark, P.softmax, x=arr([1000.0, 1001.0, -1e9]))
    assert sum(p) == pytest.approx(1) and p[1] == pytest.approx(1 / (1 + math.exp(-1)))


def test_kl_argument_order(spark):
    p, q = [0.7, 0.2, 0.1], [0.2, 0.3, 0.5]
    want = sum(a * math.log(a / b) for a, b in zip(p, q))
    assert value(spark, P.kl, p=arr(p), q=arr(q)) == pytest.approx(want)
    s = value(spark, P.sym_kl, p=arr(p), q=arr(q))
    assert s == pytest.approx(value(spark, P.sym_kl, q=arr(q), p=arr(p))) and s > 0


def test_finite_and_clamp(spark):
    for v, ok in (([0.0, 1.0, 0.5], True), ([NAN, 1.0, 0.5], False), ([INF, 1.0, 0.5], False),
                  ([-INF, 1.0, 0.5], False), ([None, 1.0, 0.5], False)):
        assert value(spark, P.all_finite, x=arr(v)) is ok
    got = value(spark, lambda x: P.clamp(x, 1e-8, 1.0), x=arr([0.0, 2.0, 0.5]))
    assert got == [1e-8, 1.0, 0.5]


def test_argmax_takes_the_first_of_ties(spark):
    assert value(spark, P.argmax, x=arr([0.4, 0.4, 0.2])) == 0
    assert value(spark, P.margin, x=arr([0.1, 0.7, 0.2])) == pytest.approx(0.5)


def test_reorder_fails_on_a_missing_label(spark):
    good = {"positive": 0.5, "negative": 0.3, "neutral": 0.2}
    order = ["negative", "neutral", "positive"]
    run = lambda m: value(spark, lambda c: P.reorder(c, order), m=("map<string,double>", m))
    assert run(good) == [0.3, 0.2, 0.5]
    with pytest.raises(Exception, match="no probability for label 'neutral'"):
        run({"positive": 0.5, "negative": 0.5})


def test_answer_parsing_orders(spark):
    s = "string"
    assert value(spark, Y.parse_answer, t=(s, "x = y = negative or positive")) == "positive"
    assert value(spark, Y.parse_answer, t=(s, "positive = Neutral")) == "none"
    assert value(spark, Y.extract_label, t=(s, "POSITIVE, not Negative")) == "negative"
    assert value(spark, Y.extract_label, t=(s, "nothing")) is None


def test_completion_text(spark):
    t = "array<struct<role:string,content:string>>"
    assert value(spark, Y.completion_text, m=(t, [("user", "a"), ("assistant", "b")])) == "b"
    assert value(spark, Y.completion_text, m=(t, [("assistant", None)])) == ""
    assert value(spark, Y.completion_text, m=(t, [])) == ""


@pytest.mark.parametrize("text, want", [
    (" Positive ", 2), ("0", 0), ("2", 2), ("3", None), ("02", 2), ("12", None), ("", None),
    ("neutral", 1), ("x", None), (None, None), ("-1", None)])
def test_label_index(spark, text, want):
    assert value(spark, Y.label_index, t=("string", text)) == want


def test_label_to_int_defaults_to_neutral(spark):
    for label, want in (("positive", 2), ("negative", 0), ("none", 1), (None, 1), ("x", 1)):
        assert value(spark, Y.label_to_int, t=("string", label)) == want


def test_report_counts_zero_division_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 1), (2, 1)], "y_true int, y_pred int")
    rep = {r.label: r for r in M.classification_report(df).collect()}
    assert set(rep) == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}
    assert (rep["0"].precision, rep["0"].recall) == (1.0, 0.5)
    assert (rep["1"].precision, rep["1"].recall, rep["1"].support) == (0.0, 0.0, 0)
    assert rep["2"].f1 == 0.0 and rep["accuracy"].f1 == 0.25 and rep["macro avg"].support == 4
    assert rep["weighted avg"].recall == pytest.approx(0.25)


def test_confusion_matrix_is_complete(spark):
    df = spark.createDataFrame([(0, 0), (0, 2)], "y_true int, y_pred int")
    got = {r[0]: tuple(r[1:]) for r in M.confusion_matrix(df).collect()}
    assert got == {0: (1, 0, 1), 1: (0, 0, 0), 2: (0, 0, 0)}


def test_empty_pairs(spark):
    none = spark.createDataFrame([], "pred_clean string, pred_pert string, p_clean array<double>, "
                                     "p_pert array<double>")
    assert M.flip_rate(none).first()[0] is None
    kl, dropped = M.sym_kl_mean(none).first()
    assert math.isnan(kl) and dropped == 0


def test_sym_kl_mean_drops_and_counts_bad_rows(spark):
    rows = [([0.7, 0.2, 0.1], [0.2, 0.3, 0.5]), ([NAN, 0.2, 0.1], [0.2, 0.3, 0.5]),
            ([1.0, 0.0, 0.0], [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "p_clean array<double>, p_pert array<double>")
    got, dropped = M.sym_kl_mean(df).first()
    p, q = (np.clip([rows[0][i], rows[2][i]], 1e-8, 1) for i in (0, 1))
    want = ((p - q) * (np.log(p) - np.log(q))).sum(1).mean()
    assert got == pytest.approx(want) and dropped == 1


def test_macro_f1_counts_absent_labels(spark):
    df = spark.createDataFrame([("negative", "negative")], "y_true string, y_pred string")
    assert M.macro_f1(df).first()[0] == pytest.approx(1 / 3)


def batch(spark, values):
    return spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(values)],
                                 "sample_id long, batch_id long, r double")


def test_zscore_guards(spark):
    z = [r.z for r in R.batch_zscore(batch(spark, [1, 2, 3]), "r").orderBy("sample_id").collect()]
    assert z == pytest.approx([-(1.5 ** 0.5), 0, 1.5 ** 0.5])
    assert [r.z for r in R.batch_zscore(batch(spark, [5, 5]), "r").collect()] == [0, 0]
    assert [r.z for r in R.batch_zscore(batch(spark, [5]), "r", guard="shift").collect()] == [0]


def reward_rows(spark, perts):
    p = [[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]]
    q = [[0.6, 0.3, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]
    rows = [(i, 0, "Negative" if i else "7", p[i], q[i], q[2 - i], perts[i]) for i in range(3)]
    return spark.createDataFrame(
        rows, "sample_id long, batch_id long, ground_truth string, p_student array<double>, "
              "p_pert array<double>, p_teacher array<double>, pert_prompt string"), p, q


def test_rewards_against_numpy(spark):
    df, p, q = reward_rows(spark, ["a", None, ""])
    base = np.array([0.0, math.log(0.1), math.log(0.3)])  # an unknown label counts 0
    got = [r.reward for r in R.reward_gt(df, 2.0).orderBy("sample_id").collect()]
    assert got == pytest.approx(list(2 * (base - base.mean()) / base.std()))

    def skl(a, b):
        a, b = np.array(a), np.array(b)
        return float(((a - b) * (np.log(a) - np.log(b))).sum())

    cons = np.array([-skl(p[0], q[0]), 0, 0])
    got = [r.reward for r in R.reward_consistency(df).orderBy("sample_id").collect()]
    assert got == pytest.approx(list(0.3 * (cons - cons.mean()) / (cons.std() + 1e-8)))
    flat, _, _ = reward_rows(spark, [None, None, ""])
    assert [r.reward for r in R.reward_consistency(flat).collect()] == [0, 0, 0]
    assert [r.reward for r in R.reward_teacher(df, teacher=None).collect()] == [0, 0, 0]
    assert [r.reward for r in R.reward_teacher(df, 0.0).collect()] == [0, 0, 0]


def test_total_is_the_sum_of_the_single_rewards(spark):
    df, _, _ = reward_rows(spark, ["a", "b", ""])
    df = df.withColumn("p_anchor", F.col("p_teacher"))
    w = R.RewardWeights(0.5, 0.3, 0.3, 0.2)
    total = {r.sample_id: r for r in R.reward_total(df, w).collect()}
    single = [
        {r.sample_id: r.reward for r in d.collect()} for d in (
            R.reward_gt(df, 0.5), R.reward_teacher(df), R.reward_consistency(df),
            df.select("sample_id", R.anchor_kl(F.col("p_student"), F.col("p_anchor"))
                      .alias("reward")))]
    for i, row in total.items():
        assert row.reward == pytest.approx(sum(s[i] for s in single))
    no_extra = R.reward_total(df, w, teacher=None, anchor=None, pert=None).collect()
    assert all(r.r_teacher == r.r_anchor == r.r_consistency == 0 for r in no_extra)


def test_anchor_direction(spark):
    p, q = [0.7, 0.2, 0.1], [0.2, 0.3, 0.5]
    kl_qp = sum(b * math.log(b / a) for a, b in zip(p, q))
    got = value(spark, lambda s, a: R.anchor_kl(s, a, 1.0), s=arr(p), a=arr(q))
    assert got == pytest.approx(-kl_qp)
    other = value(spark, lambda s, a: R.anchor_kl(s, a, 1.0, "student_anchor"), s=arr(p), a=arr(q))
    assert other == pytest.approx(-sum(a * math.log(a / b) for a, b in zip(p, q)))


def test_ema_over_several_chunks(spark):
    rng = np.random.default_rng(5)
    # dense steps over many chunks, and sparse ones far apart
    runs = {0: list(range(1500)), 1: sorted(rng.choice(10**7, 300, replace=False).tolist()), 2: [3]}
    rows, want = [], {}
    for run, steps in runs.items():
        b = 0.0
        for s in steps:
            v = float(rng.normal())
            rows.append((run, s, v))
            b = 0.9 * b + 0.1 * v
            want[run, s] = b
    df = spark.createDataFrame(rows, "run_id long, step long, mean_reward double").repartition(5)
    got = {(r.run_id, r.step): r.baseline for r in R.ema_by_step(df).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_clipping(spark):
    rows = [(0, 0, 0.0, 0.0, 1.0), (0, 0, math.log(2), 0.0, 1.0), (0, 1, math.log(2), 0.0, -1.0)]
    df = spark.createDataFrame(rows, "run_id long, step long, logp_new double, logp_old double, "
                                     "advantage double")
    got = {r.step: r.policy_loss for r in R.clipped_surrogate(df).collect()}
    assert got == pytest.approx({0: (-1 - 1.1) / 2, 1: 2.0})


@pytest.mark.parametrize("decay", [0, 0.2, 0.9, 0.999])
@pytest.mark.parametrize("spacing,n", [(1, 1500), (512, 700), (10**7, 300)])
def test_ema_for_every_decay_and_spacing(spark, decay, spacing, n):
    import random
    values = [random.Random(i).random() for i in range(n)]
    rows = [("a", i * spacing, v) for i, v in enumerate(values)] + [(None, 3, 1.0)]
    df = spark.createDataFrame(rows, "run_id string, step long, mean_reward double")
    got = {(r.run_id, r.step): r.baseline for r in R.ema_by_step(df, decay=decay).collect()}
    b = 0.0
    for i, v in enumerate(values):
        b = decay * b + (1 - decay) * v
        assert got["a", i * spacing] == pytest.approx(b, abs=1e-12)
    assert got[None, 3] == pytest.approx(1 - decay)


def test_ema_advantage_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 1, 1.0), (None, 1, 2.0), ("a", None, 3.0)],
                               "run_id string, step long, reward double")
    got = R.ema_advantage(df).collect()
    assert len(got) == 3 and sum(r.advantage is None for r in got) == 2


def test_ids_without_label_tokens_are_kept(spark):
    scores = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 9, 5.0)],
                                   "sample_id long, token_id int, logit double")
    verbalizer = spark.createDataFrame([("negative", 0), ("positive", 1)], "label string, token_id int")
    got = {r.sample_id: r.probs for r in TS.label_probs(scores, verbalizer).collect()}
    assert got[2] == pytest.approx([1 / 3] * 3) and max(got[1]) > 0.7


def test_logsumexp_of_far_apart_scores(spark):
    import math
    values = [-700.0, -1.0, 0.0, 63.9, 64.1, 800.0, 800.5]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, -5000.0)], "k long, logit double")
    got = {r.k: r.score for r in TS.logsumexp_by(df, ["k"]).collect()}
    assert got[1] == pytest.approx(800.5 + math.log(1 + math.exp(-0.5))) and got[2] == -5000.0
