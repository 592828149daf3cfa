"""Class scores from next-token scores in long form ``(id, token_id, logit)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from steadytext import constants as K
from steadytext.functions.probs import logsumexp, softmax


_STEP = 64.0       # exp stays far inside the double range within one step


def logsumexp_by(scores: DataFrame, keys: Sequence[str], value: str = "logit",
                 out: str = "score") -> DataFrame:
    """Log-sum-exp per group in one aggregate of the long table.

    The sum is kept in steps of ``_STEP``: scores are grouped by the step they fall in,
    added up below that step's own bound, which cannot overflow, and the few sums of a
    group are put together by their largest.
    """
    level = F.ceil(F.col(value) / _STEP) * _STEP
    parts = scores.groupBy(*keys, level.alias("_level")).agg(
        F.sum(F.exp(F.col(value) - level)).alias("_sum"))
    return parts.groupBy(*keys).agg(F.collect_list(
        F.col("_level") + F.ln("_sum")).alias("_parts")).select(
            *keys, logsumexp(F.col("_parts")).alias(out))


def label_scores(token_scores: DataFrame, verbalizer: DataFrame,
                 id_col: str = "sample_id") -> DataFrame:
    """Score per (id, label): log-sum-exp over the label's tokens.

    ``verbalizer(label, token_id)`` is usually small enough for Spark to broadcast it
    by its measured size. An (id, label) without any token has no row.
    """
    hits = token_scores.join(verbalizer, "token_id")
    return logsumexp_by(hits, [id_col, "label"])


def label_probs(token_scores: DataFrame, verbalizer: DataFrame,
                order: Sequence[str] = K.REWARD_ORDER, id_col: str = "sample_id") -> DataFrame:
    """Class probabilities in ``order`` of every id; a label without tokens scores -1e9.

    An id none of whose tokens belongs to a label gets equal probabilities. The scores of
    an id that matter, at most one per token of the verbalizer, meet in one row.
    """
    hits = token_scores.join(verbalizer, "token_id", "left")
    score = F.col("logit").cast("double")
    wide = hits.groupBy(id_col).agg(*[
        F.collect_list(F.when(F.col("label") == x, score)).alias(f"_s{i}")
        for i, x in enumerate(order)])
    scores = F.array(*[F.when(F.size(f"_s{i}") > 0, logsumexp(F.col(f"_s{i}")))
                       .otherwise(F.lit(K.EMPTY_LABEL_SCORE)) for i in range(len(order))])
    return wide.select(id_col, scores.alias("_scores")).select(
        id_col, softmax(F.col("_scores")).alias("probs"))


def label_probs_from_vector(scores: Column, token_ids: dict[str, Sequence[int]],
                            order: Sequence[str] = K.REWARD_ORDER) -> Column:
    """Class probabilities of a next-token score array; nothing leaves the row.

    ``token_ids`` are 0-based positions per label; a label without any scores -1e9.
    """
    def label_score(ids):
        if not ids:
            return F.lit(K.EMPTY_LABEL_SCORE)
        return logsumexp(F.array(*[F.get(scores, F.lit(i)).cast("double") for i in ids]))
    return softmax(F.array(*[label_score(token_ids.get(x, ())) for x in order]))


def renormalised_label_probs(token_scores: DataFrame, label_tokens: dict[str, int],
                             order: Sequence[str] = K.SCORER_ORDER,
                             id_col: str = "sample_id") -> DataFrame:
    """Softmax over the whole vocabulary, cut to one token per label, rescaled to 1."""
    parts = [F.max(F.when(F.col("token_id") == label_tokens[x], F.col("logit"))).alias(f"_l{i}")
             for i, x in enumerate(order)]
    picked = token_scores.filter(F.col("token_id").isin(list(label_tokens.values()))) \
        .groupBy(id_col).agg(*parts)
    whole = logsumexp_by(token_scores, [id_col], out="_whole")
    joined = whole.join(picked, id_col, "left")
    p = F.array(*[F.coalesce(F.exp(F.col(f"_l{i}") - F.col("_whole")), F.lit(0.0))
                  for i in range(len(order))])
    return joined.select(id_col, p.alias("_p")).select(id_col, F.transform(
        "_p", lambda x: x / F.greatest(F.aggregate("_p", F.lit(0.0), lambda a, v: a + v),
                                       F.lit(K.PROB_FLOOR))).alias("probs"))
