"""Verbalizer tables and batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S, views as V
from checks.registry import query
from checks.metric_queries import _cols3, _sql3
from checks.sample_queries import kept
from steadytext import constants as K
from steadytext.functions.similarity import cosine_sparse
from steadytext.operators import sampling, scoring as M, verbalizer as B
from steadytext.operators.frames import round6

IDS = "array_to_string(token_ids, '|')"


def _ids(c="token_ids"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|")


# -------------------------------------------------------------- verbalizer

@query("verbalizer_tokens", f"""WITH {S.VOCAB} SELECT label, ord, word, {IDS} AS ids FROM seed_words
JOIN vocab USING (word)""")
def _(spark, sf):
    return B.tokenized(V.seeds(spark, sf), V.vocab(spark, sf)).select(
        "label", "ord", "word", _ids().alias("ids"))


@query("verbalizer_variants", f"""WITH {S.CHOSEN} SELECT label, ord, seed, c.word AS word,
array_to_string(c.ids, '|') AS ids FROM chosen""")
def _(spark, sf):
    return B.choose_variants(V.seeds(spark, sf), V.vocab(spark, sf)).select(
        "label", "ord", "seed", "word", _ids().alias("ids"))


def built(spark, sf):
    return B.build_verbalizer(V.seeds(spark, sf), V.vocab(spark, sf))


@query("verbalizer_build", f"""WITH {S.VERBALIZER} SELECT label, ord, seed, word, {IDS} AS ids, token_id, kept,
reason FROM verb""")
def _(spark, sf):
    return built(spark, sf).select("label", "ord", "seed", "word", _ids().alias("ids"), "token_id",
                                   "kept", "reason")


REPORT = f"""WITH {S.VERBALIZER}, rep AS (SELECT label, 'kept' AS list, ord, word FROM verb WHERE kept
UNION ALL SELECT label, 'dropped', ord, word FROM verb WHERE NOT kept
UNION ALL SELECT label, 'multi_token', ord, word FROM verb WHERE multi)"""


@query("verbalizer_report", f"{REPORT} SELECT label, list, ord, word FROM rep")
def _(spark, sf):
    return B.verbalizer_report(built(spark, sf)).select("label", "list", "ord", "word")


@query("verbalizer_report_counts", f"{REPORT} SELECT label, list, count(*) AS n FROM rep GROUP BY ALL")
def _(spark, sf):
    return B.report_counts(built(spark, sf))


@query("verbalizer_ids_sorted", f"""WITH {S.VOCAB} SELECT label,
row_number() OVER (PARTITION BY label ORDER BY id)::INT AS rank, id FROM (SELECT DISTINCT label,
token_ids[-1] AS id FROM seed_words JOIN vocab USING (word))""")
def _(spark, sf):
    return B.sorted_ids(V.seeds(spark, sf), V.vocab(spark, sf), 0)


# ----------------------------------------------------------------- scoring

def word_model():
    """A stand-in model: class scores from counts of a few words, (pos, neg, neu) order."""
    def load():
        import numpy as np

        def predict(texts):
            scores = np.array([[t.count("rose") + t.count("beat") + t.count("strong"),
                                t.count("fell") + t.count("missed") + t.count("down"), 0.5]
                               for t in texts], dtype="float64")
            e = np.exp(scores)
            return e / e.sum(axis=1, keepdims=True)
        return predict
    return load


def _hits(*words):
    return " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) / {len(w)}" for w in words)


MODEL = f"""WITH {S.HEADLINES}, e AS (SELECT sample_id, [exp({_hits('rose', 'beat', 'strong')}),
exp({_hits('fell', 'missed', 'down')}), exp(0.5)] AS e FROM headlines),
p AS (SELECT sample_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""


@query("score_text", f"""{MODEL} SELECT sample_id,
(['positive','negative','neutral'])[list_position(p, list_max(p))] AS label, {_sql3('p')} FROM p""")
def _(spark, sf):
    scored = M.score_text(V.headlines(spark, sf), word_model())
    return scored.select("sample_id", "label", *_cols3(F.col("probs")))


@query("score_teacher", f"""{MODEL} SELECT sample_id, {_sql3('[p[2], p[3], p[1]]')} FROM p""")
def _(spark, sf):
    rows = V.headlines(spark, sf).withColumnRenamed("text", "orig_text")
    scored = M.score_teacher(rows, word_model(), K.SCORER_ORDER)
    return scored.select("sample_id", *_cols3(F.col("p_teacher")))


def length_encoder():
    def load():
        import numpy as np

        def encode(texts):
            return np.array([[len(t), t.count(" "), t.count("e")] for t in texts], dtype="float32")
        return encode
    return load


@query("embed_text", """SELECT doc_id AS sample_id, length(text)::DOUBLE AS p0,
(length(text) - length(replace(text, ' ', '')))::DOUBLE AS p1,
(length(text) - length(replace(text, 'e', '')))::DOUBLE AS p2 FROM documents""")
def _(spark, sf):
    rows = V.table(spark, sf, "documents").withColumnRenamed("doc_id", "sample_id")
    v = M.embed_text(rows, length_encoder())
    return v.select("sample_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"p{i}")
                                   for i in range(3)])


def _hashed(source, text, size):
    """Terms per place of a hashed text."""
    return f"""SELECT sample_id, place, count(*) AS n FROM (SELECT sample_id,
{S.h('term', 'w')} % {size} AS place FROM (SELECT sample_id, unnest({S.toks(text)}) AS w FROM {source}))
GROUP BY ALL"""


@query("hashed_terms", f"""WITH d AS (SELECT doc_id AS sample_id, text FROM documents),
h AS ({_hashed('d', 'text', 256)}), v AS (SELECT sample_id,
string_agg(place || ':' || n, ' ' ORDER BY place) AS v FROM h GROUP BY sample_id)
SELECT sample_id, md5(coalesce(v, '')) AS places FROM d LEFT JOIN v USING (sample_id)""")
def _(spark, sf):
    rows = V.documents(spark, sf)
    v = F.col("embedding")
    entries = F.zip_with(v["indices"], v["values"], lambda i, x: F.concat_ws(
        ":", i.cast("string"), x.cast("long").cast("string")))
    return M.hashed_terms(rows, dimensions=256).select(
        "sample_id", F.md5(F.array_join(entries, " ")).alias("places"))


@query("cosine_sparse", f"""WITH {S.DOC_PAIRS}, a AS ({_hashed('doc_pairs', 'orig', 4096)}),
b AS ({_hashed('doc_pairs', 'pert', 4096)}),
dots AS (SELECT sample_id, sum(a.n * b.n) AS d FROM a JOIN b USING (sample_id, place) GROUP BY sample_id),
na AS (SELECT sample_id, sum(n * n) AS q FROM a GROUP BY sample_id),
nb AS (SELECT sample_id, sum(n * n) AS q FROM b GROUP BY sample_id)
SELECT sample_id, {S.r6('coalesce(d / (sqrt(na.q) * sqrt(nb.q)), 0.0)')} AS sim FROM doc_pairs
LEFT JOIN dots USING (sample_id) LEFT JOIN na USING (sample_id) LEFT JOIN nb USING (sample_id)""")
def _(spark, sf):
    both = M.hashed_terms(M.hashed_terms(V.doc_pairs(spark, sf), "orig", "va"), "pert", "vb")
    return both.select("sample_id", round6(cosine_sparse(F.col("va"), F.col("vb"))).alias("sim"))


def counting_model():
    """Labels by counts of words; a text with a certain word makes it fail."""
    def load():
        predict = word_model()()

        def guarded(texts):
            if any("unchanged" in t for t in texts):
                raise ValueError("no label for this text")
            return predict(texts)
        return guarded
    return load


def _label(text):
    up, down = (_hits(*w).replace("text", text) for w in (("rose", "beat", "strong"),
                                                          ("fell", "missed", "down")))
    return (f"CASE WHEN contains({text}, 'unchanged') THEN NULL WHEN greatest({up}, {down}) < 0.5 "
            f"THEN 'neutral' WHEN {up} >= {down} THEN 'positive' ELSE 'negative' END")


REWRITTEN = ("replace(replace(replace(replace(text, 'rose', 'climbed'), 'strong demand', 'strong rose'), "
             "'was down', 'was unchanged'), 'soared', 'rose')")


@query("guard_by_model", f"""WITH {S.HEADLINES}, r AS (SELECT sample_id, text, {REWRITTEN} AS new FROM headlines)
SELECT sample_id, CASE WHEN text = new OR {_label('text')} = {_label('new')} THEN new ELSE text END AS pert
FROM r""")
def _(spark, sf):
    rewrite = F.col("text")
    for old, new in (("rose", "climbed"), ("strong demand", "strong rose"), ("was down", "was unchanged"),
                     ("soared", "rose")):
        rewrite = F.replace(rewrite, F.lit(old), F.lit(new))
    found = M.guard_by_model(V.headlines(spark, sf), rewrite, counting_model(), kept)
    return found.select("sample_id", "pert")


def _fitted(spark, sf):
    split = sampling.experiment_split(V.headlines(spark, sf))
    fit = M.train_classifier(split.filter("split = 'train'"), split.filter("split = 'eval'"), features=4096)
    return fit, M.classify(fit, split.filter("split = 'test'"))


@query("train_classifier")
def _(spark, sf):
    fit, scored = _fitted(spark, sf)
    return scored.select("sample_id", F.col("sentiment").alias("y_true"), "y_pred",
                         *_cols3(F.col("probs")), F.lit(fit.reg).alias("reg"),
                         F.lit(fit.max_iter).alias("max_iter"), F.lit(fit.eval_loss).alias("eval_loss"))


@query("train_classifier_rows", f"""WITH {S.HEADLINES}, {S.rank_ctes()} SELECT sample_id, sentiment AS y_true,
1.0::DOUBLE AS total, true AS largest, true AS chosen FROM split WHERE split = 'test'""")
def _(spark, sf):
    """One row per test row; probabilities add up to one, the label is the most probable one, and the setting
    kept is the one with the least log loss on the eval part."""
    fit, scored = _fitted(spark, sf)
    p = F.col("probs")
    names = F.array(*[F.lit(x) for x in K.REWARD_ORDER])
    return scored.select(
        "sample_id", F.col("sentiment").alias("y_true"),
        round6(F.aggregate(p, F.lit(0.0), lambda a, x: a + x)).alias("total"),
        (F.get(p, (F.array_position(names, F.col("y_pred")) - 1).cast("int")) == F.array_max(p)).alias("largest"),
        F.lit(fit.eval_loss == min(loss for _, _, loss in fit.tried)).alias("chosen"))
