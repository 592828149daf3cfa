"""Arithmetic on class-probability arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from steadytext.constants import PROB_FLOOR


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _with_top(scores: Column, body) -> Column:
    """``body`` of the largest score, which is found once and not for every element."""
    return F.element_at(F.transform(F.array(F.array_max(scores)), body), 1)


def softmax(scores: Column) -> Column:
    shifted = _with_top(scores, lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return F.element_at(F.transform(F.array(shifted), lambda e: F.element_at(F.transform(
        F.array(_sum(e)), lambda total: F.transform(e, lambda x: x / total)), 1)), 1)


def logsumexp(scores: Column) -> Column:
    return _with_top(scores, lambda top: top + F.ln(_sum(F.transform(
        scores, lambda x: F.exp(x - top)))))


def reorder(by_label: Column, order: Sequence[str]) -> Column:
    """Array of a label -> probability map in ``order``; a missing label fails the job."""
    return F.array(*[
        F.coalesce(by_label[label],
                   F.raise_error(F.lit(f"no probability for label '{label}'")).cast("double"))
        for label in order])


def clamp(p: Column, floor: float = PROB_FLOOR, cap: float | None = None) -> Column:
    """Raise entries to ``floor`` (and cut at ``cap``) without renormalising.

    Test for finite entries first: NaN is larger than every number in Spark.
    """
    if cap is None:
        return F.transform(p, lambda x: F.greatest(x, F.lit(floor)))
    return F.transform(p, lambda x: F.least(F.greatest(x, F.lit(floor)), F.lit(cap)))


def kl(p: Column, q: Column) -> Column:
    """KL(p, q) = sum p (ln p - ln q); inputs must be positive."""
    return _sum(F.zip_with(p, q, lambda a, b: a * (F.ln(a) - F.ln(b))))


def sym_kl(p: Column, q: Column) -> Column:
    """KL both ways, added."""
    return kl(p, q) + kl(q, p)


def neg_entropy(p: Column) -> Column:
    return _sum(F.transform(p, lambda x: x * F.ln(x)))


def argmax(p: Column) -> Column:
    """0-based index of the largest entry; the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def gather_log(p: Column, index: Column, floor: float = PROB_FLOOR) -> Column:
    """Log of the entry at a 0-based index; null for a null or foreign index."""
    entry = F.get(p, index)
    # greatest() alone would turn a null entry into the floor
    return F.when(entry.isNotNull(), F.ln(F.greatest(entry, F.lit(floor))))


def all_finite(p: Column) -> Column:
    return F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def margin(p: Column) -> Column:
    """Largest minus second-largest entry."""
    return F.element_at(F.sort_array(p), -1) - F.element_at(F.sort_array(p), -2)


def argmax_label(p: Column, order: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), argmax(p) + 1)
