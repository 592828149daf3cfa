"""Probability arithmetic, answer parsing and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S, views as V
from checks.registry import query
from steadytext import constants as K
from steadytext.functions import labels as Y, probs as P
from steadytext.operators import metrics as M, token_scores as T
from steadytext.operators.frames import round6

PP = f"WITH {S.PROB_PAIRS}"


def _sql3(x, names="p0 p1 p2".split()):
    """Three rounded columns of an array."""
    return ", ".join(f"{S.r6(f'{x}[{i + 1}]')} AS {n}" for i, n in enumerate(names))


def _cols3(x, names="p0 p1 p2".split()):
    return [round6(F.get(x, F.lit(i))).alias(n) for i, n in enumerate(names)]


# ----------------------------------------------------------- probabilities

@query("softmax3", f"""WITH s AS (SELECT vec_id AS sample_id, embedding[1:3]::DOUBLE[] AS s FROM embeddings),
e AS (SELECT sample_id, list_transform(s, lambda x: exp(x)) AS e FROM s)
SELECT sample_id, {_sql3('list_transform(e, lambda x: x / list_sum(e))')} FROM e""")
def _(spark, sf):
    s = V.raw_scores(spark, sf).select("sample_id", P.softmax(F.col("s")).alias("p"))
    return s.select("sample_id", *_cols3(F.col("p")))


@query("logsumexp_tokens", f"""WITH {S.VERB_IDS}, {S.TOKEN_LOGITS} SELECT sample_id, label,
{S.r6('ln(sum(exp(logit)))')} AS score FROM token_logits JOIN verb_ids USING (token_id)
GROUP BY sample_id, label""")
def _(spark, sf):
    s = T.label_scores(V.token_logits(spark, sf), V.verbalizer_ids(spark, sf))
    return s.select("sample_id", "label", round6(F.col("score")).alias("score"))


BY_THIRD = {"negative": range(0, 21), "neutral": [30], "positive": range(40, 64)}


@query("label_probs_from_vectors", f"""WITH {S.TOKEN_LOGITS}, s AS (SELECT sample_id,
[sum(exp(logit)) FILTER (token_id < 21), sum(exp(logit)) FILTER (token_id = 30),
sum(exp(logit)) FILTER (token_id >= 40)] AS e FROM token_logits GROUP BY sample_id)
SELECT sample_id, {_sql3('list_transform(e, lambda x: x / list_sum(e))')} FROM s""")
def _(spark, sf):
    p = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), T.label_probs_from_vector(
        F.col("embedding"), BY_THIRD).alias("p"))
    return p.select("sample_id", *_cols3(F.col("p")))


def _label_sums(order):
    return ", ".join(f"coalesce(sum(exp(logit)) FILTER (label = '{x}'), 0)" for x in order)


@query("label_probs_from_logits", f"""WITH {S.VERB_IDS}, {S.TOKEN_LOGITS}, s AS (SELECT sample_id,
[{_label_sums(K.REWARD_ORDER)}] AS e FROM token_logits JOIN verb_ids USING (token_id) GROUP BY sample_id)
SELECT sample_id, {_sql3('list_transform(e, lambda x: x / list_sum(e))')} FROM s""")
def _(spark, sf):
    p = T.label_probs(V.token_logits(spark, sf), V.verbalizer_ids(spark, sf))
    return p.select("sample_id", *_cols3(F.col("probs")))


@query("renorm_label_probs", f"""WITH {S.TOKEN_LOGITS}, s AS (SELECT sample_id,
[sum(exp(logit)) FILTER (token_id = 5), sum(exp(logit)) FILTER (token_id = 17),
sum(exp(logit)) FILTER (token_id = 40)] AS e, sum(exp(logit)) AS z FROM token_logits GROUP BY sample_id),
q AS (SELECT sample_id, list_transform(e, lambda x: x / z) AS q FROM s)
SELECT sample_id, {_sql3('list_transform(q, lambda x: x / greatest(list_sum(q), 1e-12))')} FROM q""")
def _(spark, sf):
    p = T.renormalised_label_probs(V.token_logits(spark, sf),
                                   {"positive": 5, "negative": 17, "neutral": 40})
    return p.select("sample_id", *_cols3(F.col("probs")))


@query("reorder_labels", f"""{PP} SELECT sample_id, {S.r6('p_teacher[2]')} AS p0,
{S.r6('p_teacher[3]')} AS p1, {S.r6('p_teacher[1]')} AS p2 FROM prob_pairs""")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in K.SCORER_ORDER])
    p = V.prob_pairs(spark, sf).select("sample_id", P.reorder(
        F.map_from_arrays(names, F.col("p_teacher")), K.REWARD_ORDER).alias("p"))
    return p.select("sample_id", *_cols3(F.col("p")))


FINITE = "len(list_filter(p_clean, lambda x: NOT isfinite(x))) = 0"


@query("clamp_probs", f"""WITH {S.HOLED} SELECT sample_id,
{', '.join(S.r6(f'ln(least(greatest(p_clean[{i}], 1e-8), 1.0))') + f' AS l{i}' for i in (1, 2, 3))}
FROM holed WHERE {FINITE}""")
def _(spark, sf):
    rows = M.finite_rows(V.holed_probs(spark, sf)).select(
        "sample_id", P.clamp(F.col("p_clean"), K.METRIC_FLOOR, 1.0).alias("c"))
    return rows.select("sample_id", *_cols3(F.transform("c", lambda x: F.ln(x)), ["l1", "l2", "l3"]))


@query("kl_div", f"""{PP} SELECT sample_id, {S.r6(S.kl('p_student', 'p_pert'))} AS kl_forward,
{S.r6(S.kl('p_pert', 'p_student'))} AS kl_backward FROM prob_pairs""")
def _(spark, sf):
    p, q = F.col("p_student"), F.col("p_pert")
    return V.prob_pairs(spark, sf).select("sample_id", round6(P.kl(p, q)).alias("kl_forward"),
                                          round6(P.kl(q, p)).alias("kl_backward"))


@query("sym_kl", f"""{PP} SELECT sample_id, {S.r6(S.sym_kl('p_student', 'p_pert'))} AS sym_kl
FROM prob_pairs""")
def _(spark, sf):
    return V.prob_pairs(spark, sf).select("sample_id", round6(P.sym_kl(
        F.col("p_student"), F.col("p_pert"))).alias("sym_kl"))


NEG_ENTROPY = "(" + " + ".join(f"p_student[{i}] * ln(p_student[{i}])" for i in (1, 2, 3)) + ")"


@query("neg_entropy", f"{PP} SELECT sample_id, {S.r6(NEG_ENTROPY)} AS neg_entropy FROM prob_pairs")
def _(spark, sf):
    return V.prob_pairs(spark, sf).select("sample_id", round6(P.neg_entropy(
        F.col("p_student"))).alias("neg_entropy"))


@query("gather_logprob", f"""{PP} SELECT sample_id, {S.r6('ln(list_max(p_student))')} AS logp
FROM prob_pairs""")
def _(spark, sf):
    p = F.col("p_student")
    return V.prob_pairs(spark, sf).select("sample_id", round6(P.gather_log(
        p, P.argmax(p))).alias("logp"))


@query("finite_rows", f"WITH {S.HOLED} SELECT sample_id FROM holed WHERE {FINITE}")
def _(spark, sf):
    return M.finite_rows(V.holed_probs(spark, sf)).select("sample_id")


# ----------------------------------------------------------------- answers

GENERATED = """CASE ('0x'||substr(md5(concat_ws(':','ans',sample_id)),1,8))::bigint % 5
WHEN 0 THEN ' positive' WHEN 1 THEN ' negative, not positive' WHEN 2 THEN ' Neutral'
WHEN 3 THEN ' neutral or negative' ELSE '' END"""


def _generated(spark, sf):
    answers = F.array(*[F.lit(x) for x in (" positive", " negative, not positive", " Neutral",
                                           " neutral or negative", "")])
    pick = F.pmod(V.draw("ans", F.col("sample_id")), F.lit(5)).cast("int")
    return V.headlines(spark, sf).select(
        "sample_id", F.concat(F.lit("["), "text", F.lit("] ="), F.get(answers, pick)).alias("out"))


@query("parse_answer", f"""WITH {S.HEADLINES}, g AS (SELECT sample_id, string_split('[' || text || '] =' ||
{GENERATED}, '=')[-1] AS a FROM headlines) SELECT sample_id, CASE WHEN contains(a, 'positive')
THEN 'positive' WHEN contains(a, 'negative') THEN 'negative' WHEN contains(a, 'neutral')
THEN 'neutral' ELSE 'none' END AS label FROM g""")
def _(spark, sf):
    return _generated(spark, sf).select("sample_id", Y.parse_answer(F.col("out")).alias("label"))


@query("completion_text", """SELECT conv_id AS sample_id, arg_max(text, turn) AS content
FROM conversations GROUP BY conv_id""")
def _(spark, sf):
    last = V.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max_by(F.struct("role", F.col("text").alias("content")), "turn").alias("m"))
    return last.select(F.col("conv_id").alias("sample_id"),
                       Y.completion_text(F.array("m")).alias("content"))


@query("extract_label", f"""WITH {S.HEADLINES}, g AS (SELECT sample_id, lower({GENERATED}) AS a FROM headlines)
SELECT sample_id, CASE WHEN contains(a, 'negative') THEN 'negative' WHEN contains(a, 'neutral')
THEN 'neutral' WHEN contains(a, 'positive') THEN 'positive' END AS label FROM g""")
def _(spark, sf):
    return _generated(spark, sf).select("sample_id", Y.extract_label(F.col("out")).alias("label"))


@query("label_index", f"""WITH {S.PREDS}, v AS (SELECT sample_id, CASE y_pred WHEN 'none' THEN ' 2 '
WHEN 'neutral' THEN ' Neutral' ELSE y_pred END AS y FROM preds), e AS (SELECT sample_id,
CASE lower(trim(y)) WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2
WHEN '2' THEN 2 END AS idx FROM v) SELECT sample_id, idx FROM e""")
def _(spark, sf):
    y = F.col("y_pred")
    odd = F.when(y == "none", " 2 ").when(y == "neutral", " Neutral").otherwise(y)
    return V.preds(spark, sf).select("sample_id", Y.label_index(odd).alias("idx"))


# ----------------------------------------------------------------- metrics

ENC = f"""WITH {S.PREDS}, e AS (SELECT sample_id, CASE y_true WHEN 'positive' THEN 2 WHEN 'negative'
THEN 0 ELSE 1 END AS t, CASE y_pred WHEN 'positive' THEN 2 WHEN 'negative' THEN 0 ELSE 1 END AS p
FROM preds)"""
PER = """, labs AS (SELECT t AS label FROM e UNION SELECT p FROM e), per AS (SELECT label,
coalesce(tp / nullif(pr, 0), 0) AS precision, coalesce(tp / nullif(su, 0), 0) AS recall,
coalesce(2 * tp / nullif(su + pr, 0), 0) AS f1, su AS support, tp FROM (SELECT label,
(SELECT count(*) FROM e WHERE t = label AND p = label) AS tp,
(SELECT count(*) FROM e WHERE p = label) AS pr,
(SELECT count(*) FROM e WHERE t = label) AS su FROM labs))"""


def coded(spark, sf):
    return M.encode(V.preds(spark, sf))


@query("label_to_int", f"{ENC} SELECT sample_id, t AS y_true, p AS y_pred FROM e")
def _(spark, sf):
    return coded(spark, sf)


@query("accuracy", f"{ENC} SELECT {S.r6('avg((t = p)::INT)')} AS accuracy FROM e")
def _(spark, sf):
    return M.accuracy(coded(spark, sf)).select(round6(F.col("accuracy")).alias("accuracy"))


@query("accuracy_per_label", f"""{ENC} SELECT t AS label, {S.r6('avg((t = p)::INT)')} AS accuracy
FROM e GROUP BY t""")
def _(spark, sf):
    return M.accuracy_per_label(coded(spark, sf)).withColumn("accuracy", round6(F.col("accuracy")))


ROUND3 = f"{S.r6('precision')} AS precision, {S.r6('recall')} AS recall, {S.r6('f1')} AS f1"


@query("classification_report", f"""{ENC}{PER}, rep AS (SELECT label::VARCHAR AS label, precision,
recall, f1, support FROM per UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support),
sum(tp) / sum(support), sum(support) FROM per UNION ALL SELECT 'macro avg', avg(precision), avg(recall),
avg(f1), sum(support) FROM per UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM per)
SELECT label, {ROUND3}, support::BIGINT AS support FROM rep""")
def _(spark, sf):
    return M.classification_report(coded(spark, sf)).withColumns(
        {c: round6(F.col(c)) for c in ("precision", "recall", "f1")})


@query("confusion_matrix", f"""{ENC} SELECT label, count(*) FILTER (p = 0) AS pred_0,
count(*) FILTER (p = 1) AS pred_1, count(*) FILTER (p = 2) AS pred_2
FROM (SELECT unnest([0, 1, 2]) AS label) LEFT JOIN e ON t = label GROUP BY label""")
def _(spark, sf):
    return M.confusion_matrix(coded(spark, sf))


@query("flip_rate", f"WITH {S.PREDS} SELECT {S.r6('avg((y_true <> y_pred)::INT)')} AS flip_rate FROM preds")
def _(spark, sf):
    return M.flip_rate(V.preds(spark, sf), "y_true", "y_pred").select(
        round6(F.col("flip_rate")).alias("flip_rate"))


HKL = S.sym_kl("p_clean", "p_pert", "1e-8", "1.0")


@query("sym_kl_mean", f"""WITH {S.HOLED} SELECT {S.r6(f'avg({HKL}) FILTER ({FINITE})')} AS sym_kl,
count(*) FILTER (NOT {FINITE}) AS dropped FROM holed""")
def _(spark, sf):
    return M.sym_kl_mean(V.holed_probs(spark, sf)).withColumn("sym_kl", round6(F.col("sym_kl")))


@query("macro_f1", f"""WITH {S.PREDS}, e AS (SELECT y_true AS t, y_pred AS p FROM preds){PER}
SELECT {S.r6("sum(f1) FILTER (label IN ('negative','neutral','positive')) / 3")} AS macro_f1 FROM per""")
def _(spark, sf):
    return M.macro_f1(V.preds(spark, sf)).select(round6(F.col("macro_f1")).alias("macro_f1"))


@query("finance_metrics", f"""{ENC}{PER} SELECT
{S.r6('max(recall) FILTER (label = 0)')} AS negative_recall,
{S.r6('max(f1) FILTER (label = 1)')} AS neutral_f1,
{S.r6('max(precision) FILTER (label = 2)')} AS positive_precision FROM per""")
def _(spark, sf):
    m = M.finance_metrics(coded(spark, sf))
    return m.select(*[round6(F.col(c)).alias(c) for c in m.columns])


def pair_frame(spark, sf):
    """Pairs with labels of both variants and, measured separately, probabilities."""
    rows = V.holed_probs(spark, sf)
    clean = P.argmax_label(F.col("p_pert"), K.REWARD_ORDER)  # finite in every row
    return rows.select("sample_id", F.col("sentiment").alias("y_true"), "p_clean", "p_pert",
                       clean.alias("pred_clean"), F.when(
                           F.pmod(V.draw("flip", F.col("sample_id")), F.lit(4)) == 0, "none")
                       .otherwise(clean).alias("pred_pert"))


ARG = "(['negative','neutral','positive'])[list_position(p_pert, list_max(p_pert))]"


def _report(variant, pred):
    enc = "CASE {} WHEN 'positive' THEN 2 WHEN 'negative' THEN 0 ELSE 1 END"
    per = PER.replace("FROM e ", f"FROM e_{variant} ").replace("FROM e)", f"FROM e_{variant})")
    per = per.replace("FROM e\n", f"FROM e_{variant}\n").replace("labs", f"labs_{variant}")
    per = per.replace(", per AS", f", per_{variant} AS")
    return (f", e_{variant} AS (SELECT {enc.format('y_true')} AS t, {enc.format(pred)} AS p "
            f"FROM pf){per}")


def _long(variant):
    t = f"per_{variant}"
    out = []
    for c in ("precision", "recall", "f1"):
        out += [f"SELECT '{variant}' AS variant, '{c} ' || label AS metric, {c} AS value FROM {t}",
                f"SELECT '{variant}', '{c} macro avg', avg({c}) FROM {t}",
                f"SELECT '{variant}', '{c} weighted avg', sum({c} * support) / sum(support) FROM {t}"]
    out.append(f"SELECT '{variant}', 'accuracy', sum(tp) / sum(support) FROM {t}")
    return " UNION ALL ".join(out)


def _cells(variant, pred):
    """Cells of the confusion matrix: negative 0, neutral 1, positive 2, anything else 1."""
    def code(x):
        return f"CASE {x} WHEN 'negative' THEN 0 WHEN 'positive' THEN 2 ELSE 1 END"
    return (f"SELECT '{variant}', 'confusion ' || t || ' ' || p, (SELECT count(*) FROM pf WHERE "
            f"{code('y_true')} = t AND {code(pred)} = p)::DOUBLE FROM range(3) a(t), range(3) b(p)")


def _finance(variant):
    t = f"per_{variant}"
    return " UNION ALL ".join(
        f"SELECT '{variant}', '{name}', max({c}) FILTER (label = {label}) FROM {t}"
        for name, c, label in (("negative_recall", "recall", 0), ("neutral_f1", "f1", 1),
                               ("positive_precision", "precision", 2)))


@query("robustness_report", f"""WITH {S.HOLED}, pf AS (SELECT sentiment AS y_true, p_clean, p_pert,
{ARG} AS pred_clean, CASE WHEN {S.h('flip', 'sample_id')} % 4 = 0 THEN 'none' ELSE {ARG} END AS pred_pert
FROM holed){_report('clean', 'pred_clean')}{_report('perturbed', 'pred_pert')},
r AS ({_long('clean')} UNION ALL {_long('perturbed')}
UNION ALL SELECT 'pair', 'flip_rate', avg((pred_clean <> pred_pert)::INT) FROM pf
UNION ALL SELECT 'pair', 'sym_kl', avg({HKL}) FILTER ({FINITE}) FROM pf
UNION ALL {_cells('clean', 'pred_clean')} UNION ALL {_cells('perturbed', 'pred_pert')}
UNION ALL {_finance('clean')} UNION ALL {_finance('perturbed')})
SELECT variant, metric, {S.r6('value')} AS value FROM r""")
def _(spark, sf):
    return M.robustness_report(pair_frame(spark, sf)).withColumn("value", round6(F.col("value")))
