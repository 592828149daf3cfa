"""Rewards, advantages and step statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S, views as V
from checks.registry import query
from checks.sample_queries import kept
from steadytext import constants as K
from steadytext.functions import probs as P
from steadytext.operators import rewards as R
from steadytext.operators.frames import round6

PP = f"WITH {S.PROB_PAIRS}"
IDX = "list_position(['negative','neutral','positive'], ground_truth)"
GT = f"coalesce(ln(greatest(p_student[{IDX}], 1e-12)), 0)"
TE = "-" + S.sym_kl("p_student", "p_teacher", "1e-12")
CO = f"""CASE WHEN pert_prompt IS NULL OR pert_prompt = '' THEN 0.0::DOUBLE
ELSE -{S.sym_kl('p_student', 'p_pert', '1e-12')} END"""
BASE = f"""{PP}, base AS (SELECT *, {GT} AS gt, {TE} AS te, {CO} AS co,
-0.2 * {S.kl('p_anchor', 'p_student', '1e-12')} AS an FROM prob_pairs),
st AS (SELECT batch_id, avg(gt) AS gm, stddev_pop(gt) AS gs, avg(te) AS tm, stddev_pop(te) AS ts,
avg(co) AS cm, stddev_pop(co) AS cs, min(co) AS clo, max(co) AS chi FROM base GROUP BY batch_id),
z AS (SELECT base.*, (gt - gm) / CASE WHEN gs < 1e-8 THEN 1 ELSE gs END AS zgt,
0.3 * (te - tm) / (ts + 1e-8) AS rte,
CASE WHEN clo = chi THEN 0.0 ELSE 0.3 * (co - cm) / (cs + 1e-8) END AS rco
FROM base JOIN st USING (batch_id))"""


def _out(df, c="reward"):
    return df.select("sample_id", round6(F.col(c)).alias(c))


@query("reward_gt_logprob", f"{BASE} SELECT sample_id, {S.r6('zgt')} AS reward FROM z")
def _(spark, sf):
    return _out(R.reward_gt(V.prob_pairs(spark, sf)))


@query("reward_teacher_align", f"{BASE} SELECT sample_id, {S.r6('rte')} AS reward FROM z")
def _(spark, sf):
    return _out(R.reward_teacher(V.prob_pairs(spark, sf)))


@query("reward_consistency", f"{BASE} SELECT sample_id, {S.r6('rco')} AS reward FROM z")
def _(spark, sf):
    return _out(R.reward_consistency(V.prob_pairs(spark, sf)))


@query("reward_sft_kl", f"{BASE} SELECT sample_id, {S.r6('an')} AS reward FROM z")
def _(spark, sf):
    return V.prob_pairs(spark, sf).select("sample_id", round6(R.anchor_kl(
        F.col("p_student"), F.col("p_anchor"))).alias("reward"))


@query("reward_total", f"""{BASE} SELECT sample_id, {S.r6('0.0 * zgt')} AS r_gt, {S.r6('rte')} AS r_teacher,
{S.r6('rco')} AS r_consistency, {S.r6('an')} AS r_anchor, {S.r6('0.0 * zgt + rte + rco + an')} AS reward
FROM z""")
def _(spark, sf):
    r = R.reward_total(V.prob_pairs(spark, sf))
    return r.select("sample_id", *[round6(F.col(c)).alias(c) for c in (
        "r_gt", "r_teacher", "r_consistency", "r_anchor", "reward")])


def _added_rewards():
    """A native and a batch reward, known by their names."""
    def peak(p):
        return F.array_max(p)

    def load():
        import numpy as np

        def spread(p, cluster):
            held = np.stack([np.asarray(x, dtype="float64") for x in p.to_pylist()])
            return np.where(np.asarray(cluster) == 9, np.nan, held.max(1) - held.min(1))
        return spread

    for reward in (R.RewardFunction("peak", ("p_student",), native=peak, weight=0.5),
                   R.RewardFunction("spread", ("p_pert", "cluster"), batch=load, weight=2.0, zscore=None),
                   R.RewardFunction("absent", ("no_such_column",), native=peak),
                   R.RewardFunction("off", ("p_student",), native=peak, weight=0.0)):
        if reward.name not in R.REWARD_FUNCTIONS:
            R.register_reward(reward)


@query("reward_total_extra", f"""{BASE}, mx AS (SELECT sample_id, batch_id, label, list_max(p_student) AS pk,
list_max(p_pert) - list_min(p_pert) AS sp FROM prob_pairs), ms AS (SELECT batch_id, avg(pk) AS m,
stddev_pop(pk) AS s FROM mx GROUP BY batch_id), e AS (SELECT sample_id,
0.5 * (pk - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END AS r1, CASE WHEN label = 9 THEN 0.0 ELSE 2.0 * sp END AS r2
FROM mx JOIN ms USING (batch_id)) SELECT sample_id, {S.r6('r1')} AS r_peak, {S.r6('r2')} AS r_spread,
0.0::DOUBLE AS r_absent, 0.0::DOUBLE AS r_off, {S.r6('0.0 * zgt + rte + rco + an + r1 + r2')} AS reward
FROM z JOIN e USING (sample_id)""")
def _(spark, sf):
    _added_rewards()
    r = R.reward_total(V.prob_pairs(spark, sf), extra=("peak", "spread", "absent", "off"), store=kept)
    return r.select("sample_id", *[round6(F.col(c)).alias(c) for c in (
        "r_peak", "r_spread", "r_absent", "r_off", "reward")])


@query("batch_zscore", f"""WITH {S.REWARD_LOG}, st AS (SELECT batch_id, avg(reward) AS m, stddev_pop(reward) AS s
FROM reward_log GROUP BY batch_id) SELECT sample_id, {S.r6('(reward - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END')}
AS z FROM reward_log JOIN st USING (batch_id)""")
def _(spark, sf):
    return _out(R.batch_zscore(V.reward_log(spark, sf), "reward"), "z")


NE = "(" + " + ".join(f"p_student[{i}] * ln(p_student[{i}])" for i in (1, 2, 3)) + ")"
PROTO = (f"(-{S.sym_kl('p_student', 'p_pert')} + 0.5 * (1.0 - {S.kl('p_student', 'p_teacher')}) "
         f"+ 0.01 * {NE})")


@query("reward_notebook_total", f"{PP} SELECT sample_id, {S.r6(PROTO)} AS reward FROM prob_pairs")
def _(spark, sf):
    return V.prob_pairs(spark, sf).select("sample_id", round6(_proto()).alias("reward"))


def _proto():
    return R.prototype_total(F.col("p_student"), F.col("p_pert"), F.col("p_teacher"))


def _ema_sql(source):
    return f"""means AS (SELECT run_id, step, avg(reward) AS m, row_number() OVER (PARTITION BY run_id
ORDER BY step) AS i FROM {source} GROUP BY run_id, step), ema AS (SELECT b.run_id, b.step,
sum(0.1 * a.m * pow(0.9, b.i - a.i)) AS baseline FROM means a JOIN means b
ON a.run_id = b.run_id AND a.i <= b.i GROUP BY b.run_id, b.step)"""


@query("ema_baseline", f"""WITH {S.REWARD_LOG}, {_ema_sql('reward_log')} SELECT sample_id,
{S.r6('baseline + 1e-9')} AS baseline, {S.r6('reward - baseline + 1e-9')} AS advantage
FROM reward_log JOIN ema USING (run_id, step)""")
def _(spark, sf):
    # rewards have few decimals, so early baselines lie exactly between two rounded
    # values; both sides are moved off that point
    return R.ema_advantage(V.reward_log(spark, sf)).select(
        "sample_id", round6(F.col("baseline") + 1e-9).alias("baseline"),
        round6(F.col("advantage") + 1e-9).alias("advantage"))


@query("group_advantage", f"""WITH {S.REWARD_LOG}, st AS (SELECT group_id, avg(reward) AS m,
coalesce(stddev_samp(reward), 0) AS s FROM reward_log GROUP BY group_id)
SELECT sample_id, {S.r6('(reward - m) / (s + 1e-4)')} AS advantage FROM reward_log JOIN st USING (group_id)""")
def _(spark, sf):
    return _out(R.group_advantage(V.reward_log(spark, sf)), "advantage")


def policy_rows(spark, sf):
    """Logged steps: the student before (anchor) and after, with advantages."""
    p, old = F.col("p_student"), F.col("p_anchor")
    rows = V.prob_pairs(spark, sf).select(
        "sample_id", "run_id", "step", p.alias("p_new"), old.alias("p_old"), "p_pert",
        _proto().alias("reward"), P.gather_log(p, P.argmax(p)).alias("logp_new"),
        P.gather_log(old, P.argmax(old)).alias("logp_old"))
    return R.ema_advantage(rows)


POLICY = f"""{PP}, rw AS (SELECT *, {PROTO} AS reward, ln(list_max(p_student)) AS ln_new,
ln(list_max(p_anchor)) AS ln_old, list_position(p_student, list_max(p_student))
<> list_position(p_pert, list_max(p_pert)) AS flip, {S.kl('p_student', 'p_anchor')} AS kl FROM prob_pairs),
{_ema_sql('rw')}, t AS (SELECT rw.*, greatest(-exp(ln_new - ln_old) * (reward - baseline),
-least(greatest(exp(ln_new - ln_old), 0.9), 1.1) * (reward - baseline)) AS term
FROM rw JOIN ema USING (run_id, step))"""


@query("clipped_surrogate", f"""{POLICY} SELECT run_id, step, {S.r6('avg(term)')} AS policy_loss FROM t
GROUP BY run_id, step""")
def _(spark, sf):
    return R.clipped_surrogate(policy_rows(spark, sf)).withColumn(
        "policy_loss", round6(F.col("policy_loss")))


@query("kl_regularizer", f"""{POLICY} SELECT run_id, step, {S.r6('avg(kl)')} AS kl,
{S.r6('0.01 * avg(kl)')} AS kl_loss FROM t GROUP BY run_id, step""")
def _(spark, sf):
    rows = V.prob_pairs(spark, sf).withColumnsRenamed({"p_student": "p_new", "p_anchor": "p_old"})
    return R.kl_regularizer(rows).withColumns({c: round6(F.col(c)) for c in ("kl", "kl_loss")})


STEP = f"""{POLICY} SELECT run_id, step, {S.r6('avg(term) + 0.01 * avg(kl)')} AS loss,
{S.r6('avg(reward)')} AS mean_reward, {S.r6('avg(flip::INT)')} AS flip_rate FROM t"""


@query("step_stats", f"{STEP} GROUP BY run_id, step")
def _(spark, sf):
    return R.step_stats(policy_rows(spark, sf)).withColumns(
        {c: round6(F.col(c)) for c in ("loss", "mean_reward", "flip_rate")})


@query("step_report", f"{STEP} WHERE step % 10 = 0 GROUP BY run_id, step")
def _(spark, sf):
    return R.step_stats(policy_rows(spark, sf), every=K.REPORT_EVERY).withColumns(
        {c: round6(F.col(c)) for c in ("loss", "mean_reward", "flip_rate")})
