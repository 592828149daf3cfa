"""Rewards, advantages and step statistics over logged probabilities.

Rows carry ``batch_id`` (or run, step, group), ``ground_truth`` and probability
arrays in the reward label order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from steadytext import constants as K
from steadytext.functions import probs as P
from steadytext.functions.labels import label_index
from steadytext.operators.frames import compute_once, join_lookup, with_group_stats


@dataclass(frozen=True)
class RewardWeights:
    gt: float = K.W_GT
    teacher: float = K.W_TEACHER
    consistency: float = K.W_CONSISTENCY
    anchor: float = K.W_ANCHOR


# ------------------------------------------------------- rewards of a caller

@dataclass(frozen=True)
class RewardFunction:
    """A reward that a caller adds to ``reward_total``.

    Give either ``native``, which makes a column of the input columns, or ``batch``, a loader called once per
    task whose function gets the input columns of a batch as Arrow arrays and returns as many numbers.
    It is enabled if its weight is positive and the table has all its inputs. ``zscore`` standardises
    it within the batch: ``floor`` or ``shift`` as for the built-in rewards, None for raw values. A null
    or non-finite value counts 0 after standardising.
    """

    name: str
    inputs: tuple[str, ...]
    native: Callable[..., Column] | None = None
    batch: Callable[[], Callable] | None = None
    weight: float | None = 1.0
    zscore: str | None = "floor"

    def __post_init__(self) -> None:
        if (self.native is None) == (self.batch is None):
            raise ValueError(f"reward {self.name!r} needs either a native or a batch function")
        if self.zscore not in (None, *_GUARDS):
            raise ValueError(f"unknown standardisation {self.zscore!r}")

    def enabled(self, columns: Sequence[str]) -> bool:
        return self.weight is not None and self.weight > 0 and set(self.inputs) <= set(columns)

    def value(self) -> Column:
        inputs = [F.col(c) for c in self.inputs]
        if self.native is not None:
            raw = self.native(*inputs).cast("double")
        else:
            loader = self.batch

            @F.arrow_udf("double")
            def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
                reward = loader()
                for columns in batches:
                    values = reward(*columns)
                    yield values if isinstance(values, pa.Array) else pa.array(values, pa.float64())

            raw = run(*inputs)
        return F.when(F.abs(raw) < float("inf"), raw)       # neither NaN nor infinite


REWARD_FUNCTIONS: dict[str, RewardFunction] = {}


def register_reward(reward: RewardFunction) -> RewardFunction:
    """Make a reward known by its name to ``reward_total``."""
    if reward.name in REWARD_FUNCTIONS:
        raise ValueError(f"reward {reward.name!r} registered twice")
    REWARD_FUNCTIONS[reward.name] = reward
    return reward


# ----------------------------------------------------------- row rewards

def gt_logprob(p: Column, truth: Column, order: Sequence[str] = K.REWARD_ORDER) -> Column:
    """Log-probability of the true class; 0 for an unknown label."""
    return F.coalesce(P.gather_log(p, label_index(truth, order)), F.lit(0.0))


def teacher_alignment(p_student: Column, p_teacher: Column) -> Column:
    return -P.sym_kl(P.clamp(p_student), P.clamp(p_teacher))


def consistency(p_clean: Column, p_pert: Column, pert: Column) -> Column:
    """Minus symmetric KL; 0 without a perturbed text."""
    return F.when(pert.isNull() | (pert == ""), F.lit(0.0)).otherwise(
        -P.sym_kl(P.clamp(p_clean), P.clamp(p_pert)))


def anchor_kl(p_student: Column, p_anchor: Column, weight: float = K.W_ANCHOR,
              direction: str = "anchor_student") -> Column:
    """Minus weighted KL to a fixed anchor model, not standardised.

    ``direction`` names the first and second argument of KL; the default is
    KL(anchor, student).
    """
    s, a = P.clamp(p_student), P.clamp(p_anchor)
    if direction not in ("anchor_student", "student_anchor"):
        raise ValueError(f"unknown direction {direction!r}")
    return -weight * (P.kl(a, s) if direction == "anchor_student" else P.kl(s, a))


def prototype_total(p_x: Column, p_pert: Column, p_teacher: Column,
                    w_cons: float = K.W_PROTO_CONS, w_align: float = K.W_PROTO_ALIGN,
                    w_calib: float = K.W_PROTO_CALIB) -> Column:
    """Consistency + alignment 1 - KL(student, teacher) + negative entropy."""
    p = P.clamp(p_x)
    return (w_cons * -P.sym_kl(p, P.clamp(p_pert))
            + w_align * (1.0 - P.kl(p, P.clamp(p_teacher)))
            + w_calib * P.neg_entropy(p))


# ------------------------------------------------------- standardisation

def _z_floor(r: Column, mean: Column, std: Column) -> Column:
    """A deviation below the guard counts as 1."""
    return (r - mean) / F.when(std < K.STD_FLOOR, F.lit(1.0)).otherwise(std)


def _z_shift(r: Column, mean: Column, std: Column) -> Column:
    """The guard is added to the deviation."""
    return (r - mean) / (std + K.STD_FLOOR)


_GUARDS = {"floor": _z_floor, "shift": _z_shift}


def batch_zscore(df: DataFrame, value: str, keys: Sequence[str] = ("batch_id",),
                 guard: str = "floor", out: str = "z") -> DataFrame:
    """Standardise within a batch by the population deviation."""
    stats = with_group_stats(df, keys, _mean=F.avg(value), _std=F.stddev_pop(value))
    return stats.select(*df.columns, _GUARDS[guard](
        F.col(value), F.col("_mean"), F.col("_std")).alias(out))


def reward_gt(df: DataFrame, weight: float = 1.0, p: str = "p_student",
              truth: str = "ground_truth", keys: Sequence[str] = ("batch_id",),
              out: str = "reward") -> DataFrame:
    base = compute_once(df, _r=gt_logprob(F.col(p), F.col(truth)))
    z = batch_zscore(base, "_r", keys, "floor", "_z")
    return z.select(*df.columns, (weight * F.col("_z")).alias(out))


def reward_teacher(df: DataFrame, weight: float = K.W_TEACHER, p: str = "p_student",
                   teacher: str | None = "p_teacher", keys: Sequence[str] = ("batch_id",),
                   out: str = "reward") -> DataFrame:
    """Zero without a teacher or with a weight that is not positive."""
    if teacher is None or weight is None or weight <= 0:
        return df.withColumn(out, F.lit(0.0))
    base = compute_once(df, _r=teacher_alignment(F.col(p), F.col(teacher)))
    z = batch_zscore(base, "_r", keys, "shift", "_z")
    return z.select(*df.columns, F.coalesce(weight * F.col("_z"), F.lit(0.0)).alias(out))


def reward_consistency(df: DataFrame, weight: float = K.W_CONSISTENCY, p: str = "p_student",
                       p_pert: str = "p_pert", pert: str = "pert_prompt",
                       keys: Sequence[str] = ("batch_id",), out: str = "reward") -> DataFrame:
    """A batch whose values are all equal contributes nothing."""
    if weight is None or weight <= 0:
        return df.withColumn(out, F.lit(0.0))
    base = compute_once(df, _r=consistency(F.col(p), F.col(p_pert), F.col(pert)))
    stats = with_group_stats(base, keys, _mean=F.avg("_r"), _std=F.stddev_pop("_r"),
                             _lo=F.min("_r"), _hi=F.max("_r"))
    z = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.0)).otherwise(
        _z_shift(F.col("_r"), F.col("_mean"), F.col("_std")))
    return stats.select(*df.columns, (weight * z).alias(out))


def reward_total(df: DataFrame, weights: RewardWeights = RewardWeights(),
                 teacher: str | None = "p_teacher", anchor: str | None = "p_anchor",
                 pert: str | None = "pert_prompt", p: str = "p_student",
                 p_pert: str = "p_pert", truth: str = "ground_truth",
                 keys: Sequence[str] = ("batch_id",),
                 extra: Sequence[RewardFunction | str] = (), store=None) -> DataFrame:
    """All enabled rewards and their sum, from one pass of batch statistics.

    The ground-truth reward is always enabled; the others need a positive weight
    and their input. ``extra`` are a caller's rewards, given or named as registered; each becomes a
    column ``r_<name>``, 0 where it is not enabled. Batch functions run once per row: their
    values are kept by ``store`` (DataFrame -> DataFrame, a write to shared storage and a read)
    before the statistics are taken.
    """
    added = [REWARD_FUNCTIONS[r] if isinstance(r, str) else r for r in extra]
    if len({r.name for r in added} | {"gt", "teacher", "consistency", "anchor"}) < len(added) + 4:
        raise ValueError("two rewards of one name")
    used = {r.name: r for r in added if r.enabled(df.columns)}
    columns = df.columns
    slow = {f"_x_{n}": r.value() for n, r in used.items() if r.batch is not None}
    if slow:
        if store is None:
            raise ValueError("batch rewards need a store")
        df = store(df.withColumns(slow))
    base = {"_gt": gt_logprob(F.col(p), F.col(truth))}
    use_teacher = teacher is not None and weights.teacher > 0
    use_cons = pert is not None and weights.consistency > 0
    use_anchor = anchor is not None and weights.anchor > 0
    if use_teacher:
        base["_te"] = teacher_alignment(F.col(p), F.col(teacher))
    if use_cons:
        base["_co"] = consistency(F.col(p), F.col(p_pert), F.col(pert))
    base |= {f"_x_{n}": r.value() for n, r in used.items() if r.native is not None}
    rows = compute_once(df, **base)
    base |= dict.fromkeys(slow)
    stats = {}
    for c in base:
        stats |= {c + "_m": F.avg(c), c + "_s": F.stddev_pop(c)}
    if use_cons:
        stats |= {"_co_lo": F.min("_co"), "_co_hi": F.max("_co")}
    wide = with_group_stats(rows, keys, **stats)

    def z(name, guard):
        return guard(F.col(name), F.col(name + "_m"), F.col(name + "_s"))

    zero = F.lit(0.0)
    parts = {
        "r_gt": weights.gt * z("_gt", _z_floor),
        "r_teacher": F.coalesce(weights.teacher * z("_te", _z_shift), zero)
        if use_teacher else zero,
        "r_consistency": F.when(F.col("_co_lo") == F.col("_co_hi"), zero).otherwise(
            weights.consistency * z("_co", _z_shift)) if use_cons else zero,
        "r_anchor": anchor_kl(F.col(p), F.col(anchor), weights.anchor) if use_anchor else zero,
    }
    for r in added:
        own = zero
        if r.name in used:
            c = f"_x_{r.name}"
            own = F.coalesce(r.weight * (F.col(c) if r.zscore is None else z(c, _GUARDS[r.zscore])), zero)
        parts[f"r_{r.name}"] = own
    wide = wide.select(*columns, *[v.alias(n) for n, v in parts.items()])
    return wide.withColumn("reward", sum((F.col(n) for n in parts), zero))


# ------------------------------------------------------------ advantages

def group_advantage(df: DataFrame, value: str = "reward", keys: Sequence[str] = ("group_id",),
                    eps: float = 1e-4, out: str = "advantage") -> DataFrame:
    """Reward relative to the answers of the same prompt (sample deviation)."""
    stats = with_group_stats(df, keys, _mean=F.avg(value), _std=F.stddev_samp(value))
    return stats.select(*df.columns, (
        (F.col(value) - F.col("_mean")) / (F.coalesce("_std", F.lit(0.0)) + eps)).alias(out))


_FOLD = 256        # chunks folded into one at every level


def _rows_per_chunk(decay: float) -> int:
    """So many steps that ``decay`` to the minus that power stays far inside the double range."""
    return max(1, min(512, int(200 / -math.log10(decay))))


def ema_by_step(means: DataFrame, value: str = "mean_reward", run: str = "run_id",
                step: str = "step", decay: float = K.EMA_DECAY,
                out: str = "baseline") -> DataFrame:
    """b = decay * b + (1 - decay) * value over the steps of a run, starting at 0.

    ``means`` has one row per (run, step), integer steps with any spacing; ``decay`` is in
    [0, 1). The recurrence is linear: a chunk of steps turns what comes in, b, into
    a * b + e. Chunks of chunks are folded the same way until one is left, and what comes
    into each chunk is handed down again, so no task sees more than one chunk and none is
    left out. The number of levels follows the range of steps, read first.
    """
    if not 0 <= decay < 1:
        raise ValueError("decay must be in [0, 1)")
    if decay == 0:
        return means.withColumn(out, F.col(value).cast("double"))
    low, high = means.agg(F.min(step), F.max(step)).first()
    size = _rows_per_chunk(decay)
    place = F.col(step) - F.lit(low if low is not None else 0)
    chunked = means.withColumn("_chunk0", F.floor(place / size))
    ordered = Window.partitionBy(run, "_chunk0").orderBy(step)
    # value_i * decay^-i summed up to i, then scaled back by decay^i
    local = (chunked.withColumn("_i", F.row_number().over(ordered))
             .withColumn("_acc", F.sum(F.col(value) * F.pow(F.lit(decay), -F.col("_i")))
                         .over(ordered))
             .withColumn("_local", (1 - decay) * F.col("_acc")
                         * F.pow(F.lit(decay), F.col("_i"))))
    chunks = local.groupBy(run, "_chunk0").agg(
        F.pow(F.lit(decay), F.max("_i")).alias("_a"), F.max_by("_local", "_i").alias("_e"))
    last = 0 if low is None else (high - low) // size
    carried = _carry_in(chunks.withColumnRenamed("_chunk0", "_chunk"), run, last)
    carried = carried.select(F.col(run).alias("_run"), F.col("_chunk").alias("_of"), "_in")
    return local.join(carried, local[run].eqNullSafe(F.col("_run"))
                      & (F.col("_chunk0") == F.col("_of"))).select(*means.columns, (
        F.col("_local") + F.col("_in") * F.pow(F.lit(decay), F.col("_i"))).alias(out))


def _carry_in(chunks: DataFrame, run: str, last: int) -> DataFrame:
    """(run, _chunk, _in): what comes into every chunk of (run, _chunk, _a, _e).

    ``last`` is the highest chunk number. ``_FOLD`` chunks at a time meet in one row.
    """
    entry = F.sort_array(F.collect_list(F.struct("_chunk", "_a", "_e")))
    groups = chunks.groupBy(run, F.floor(F.col("_chunk") / _FOLD).alias("_group")).agg(
        entry.alias("_parts"))
    # for every chunk of the group: a and e of all chunks before it in the group
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("e"))
    folded = F.aggregate(
        "_parts", F.array(start), lambda done, c: F.concat(done, F.array(F.struct(
            (F.element_at(done, -1)["a"] * c["_a"]).alias("a"),
            (F.element_at(done, -1)["e"] * c["_a"] + c["_e"]).alias("e")))))
    groups = groups.withColumn("_folded", folded)
    if last < _FOLD:
        into = groups.withColumn("_in", F.lit(0.0))
    else:
        whole = groups.select(run, F.col("_group").alias("_chunk"),
                              F.element_at("_folded", -1)["a"].alias("_a"),
                              F.element_at("_folded", -1)["e"].alias("_e"))
        above = _carry_in(whole, run, last // _FOLD).select(
            F.col(run).alias("_run"), F.col("_chunk").alias("_of"), "_in")
        into = groups.join(above, groups[run].eqNullSafe(F.col("_run"))
                           & (F.col("_group") == F.col("_of")))
    parts = F.zip_with("_parts", F.slice("_folded", 1, F.size("_parts")), lambda c, f: F.struct(
        c["_chunk"].alias("_chunk"), (f["a"] * F.col("_in") + f["e"]).alias("_in")))
    return into.select(run, F.inline(parts))


def ema_advantage(df: DataFrame, value: str = "reward", run: str = "run_id",
                  step: str = "step", decay: float = K.EMA_DECAY) -> DataFrame:
    """Reward minus the running baseline, which already contains the step itself.

    A row without run or step has no baseline: it is kept, with null in both columns.
    """
    means = df.groupBy(run, step).agg(F.avg(value).alias("mean_reward"))
    base = ema_by_step(means.filter(F.col(run).isNotNull() & F.col(step).isNotNull()),
                       "mean_reward", run, step, decay)
    return join_lookup(df, base, [run, step]).select(
        *df.columns, "baseline", (F.col(value) - F.col("baseline")).alias("advantage"))


def surrogate_term(logp_new: Column, logp_old: Column, adv: Column,
                   eps: float = K.CLIP_EPS) -> Column:
    ratio = F.exp(logp_new - logp_old)
    bounded = F.least(F.greatest(ratio, F.lit(1.0 - eps)), F.lit(1.0 + eps))
    return F.greatest(-ratio * adv, -bounded * adv)


def clipped_surrogate(df: DataFrame, keys: Sequence[str] = ("run_id", "step"),
                      eps: float = K.CLIP_EPS) -> DataFrame:
    term = surrogate_term(F.col("logp_new"), F.col("logp_old"), F.col("advantage"), eps)
    return df.groupBy(*keys).agg(F.avg(term).alias("policy_loss"))


def kl_regularizer(df: DataFrame, keys: Sequence[str] = ("run_id", "step"),
                   coef: float = K.KL_COEF) -> DataFrame:
    """Mean KL(new, old) per step and its weighted share of the loss."""
    term = P.kl(P.clamp(F.col("p_new")), P.clamp(F.col("p_old")))
    return df.groupBy(*keys).agg(F.avg(term).alias("kl")).withColumn(
        "kl_loss", coef * F.col("kl"))


def step_stats(df: DataFrame, keys: Sequence[str] = ("run_id", "step"),
               eps: float = K.CLIP_EPS, coef: float = K.KL_COEF,
               every: int | None = None) -> DataFrame:
    """Loss, mean reward and flip rate per step; ``every`` keeps each n-th step.

    Needs ``logp_new, logp_old, advantage, p_new, p_old, p_pert, reward``.
    """
    policy = surrogate_term(F.col("logp_new"), F.col("logp_old"), F.col("advantage"), eps)
    kl = P.kl(P.clamp(F.col("p_new")), P.clamp(F.col("p_old")))
    flip = P.argmax(F.col("p_new")) != P.argmax(F.col("p_pert"))
    rows = df if every is None else df.filter(F.col(keys[-1]) % every == 0)
    return rows.groupBy(*keys).agg(
        (F.avg(policy) + coef * F.avg(kl)).alias("loss"),
        F.avg("reward").alias("mean_reward"), F.avg(flip.cast("int")).alias("flip_rate"))
