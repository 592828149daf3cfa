"""Tokens, text edits, filters and the candidate library."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S, views as V
from checks.registry import query
from checks.sample_queries import HEAD, LIB, library
from checks.score_queries import length_encoder
from steadytext import constants as K, dictionaries as D
from steadytext.functions import similarity, text as X
from steadytext.functions.entities import entity_pattern, entity_types
from steadytext.operators import library as L, lexicon, sampling
from steadytext.operators.frames import join_by_text, round6
from steadytext.sources.scratch import scratch_path

H = f"WITH {S.HEADLINES}"


def T():
    return F.col("text")


def ID():
    return F.col("sample_id")


# ----------------------------------------------------------------- tokens

@query("tokenize_ws", f"""SELECT doc_id AS sample_id, len(t) AS n_words, coalesce(t[1], '') AS first,
md5(array_to_string(t, chr(1))) AS digest FROM (SELECT doc_id, {S.toks('text')} AS t FROM documents)""")
def _(spark, sf):
    d = V.documents(spark, sf).select("sample_id", X.tokens(T()).alias("t"))
    return d.select("sample_id", F.size("t").cast("long").alias("n_words"),
                    F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"),
                    F.md5(F.array_join("t", "\u0001")).alias("digest"))


@query("tok_stopword_filter", f"""SELECT doc_id AS sample_id, len(t) AS n_words,
md5(array_to_string(t, chr(1))) AS digest FROM (SELECT doc_id, list_filter({S.toks('text')},
lambda w: NOT list_contains({S.strings(D.STOP_WORDS)}, w)) AS t FROM documents)""")
def _(spark, sf):
    d = V.documents(spark, sf).select("sample_id", X.content_tokens(T(), D.STOP_WORDS).alias("t"))
    return d.select("sample_id", F.size("t").cast("long").alias("n_words"),
                    F.md5(F.array_join("t", "\u0001")).alias("digest"))


# -------------------------------------------------------------- text edits

@query("synonym_replace", f"""{H}, {S.SYNONYMS}, {S.synonym_ctes('s', 'headlines', '2')}
SELECT sample_id, pert FROM s""")
def _(spark, sf):
    return V.headlines(spark, sf, spread=True).select("sample_id", X.replace_synonyms(
        T(), ID(), 2, D.SURFACE_SYNONYMS, D.STOP_WORDS).alias("pert"))


@query("synonym_replace_ratio", f"""{H}, {S.SYNONYMS},
{S.synonym_ctes('s', 'headlines', S.RATIO_QUOTA)} SELECT sample_id, pert FROM s""")
def _(spark, sf):
    return V.headlines(spark, sf, spread=True).select("sample_id", X.replace_synonyms_ratio(
        T(), ID(), D.SURFACE_SYNONYMS, D.STOP_WORDS).alias("pert"))


@query("synonym_replace_lexicon", f"""{H}, {S.LEXICON}, syn AS (SELECT surface,
list(replace(synonym, '_', ' ') ORDER BY ord) AS synonyms FROM lexicon WHERE sense = 0
AND lower(synonym) <> lower(surface) GROUP BY surface),
{S.synonym_ctes('s', 'headlines', S.RATIO_QUOTA)} SELECT sample_id, pert FROM s""")
def _(spark, sf):
    quota = X.synonym_quota(X.tokens(T()))
    return lexicon.replace_from_lexicon(V.headlines(spark, sf), V.lexicon(spark), quota,
                                        D.STOP_WORDS).select("sample_id", "pert")


@query("synonym_replace_lexicon_documents", f"""WITH {S.LEXICON}, syn AS (SELECT surface,
list(replace(synonym, '_', ' ') ORDER BY ord) AS synonyms FROM lexicon WHERE sense = 0
AND lower(synonym) <> lower(surface) GROUP BY surface), d AS (SELECT doc_id AS sample_id,
'sales rose ' || text || ' as weak demand fell' AS text FROM documents),
{S.synonym_ctes('s', 'd', S.RATIO_QUOTA)} SELECT sample_id, md5(pert) AS pert FROM s
UNION ALL SELECT sample_id, md5(pert) FROM s""")
def _(spark, sf):
    """Long documents, every row twice as draws with replacement give them."""
    rows = V.documents(spark, sf).withColumn("text", F.concat(
        F.lit("sales rose "), "text", F.lit(" as weak demand fell")))
    rows = rows.unionByName(rows)
    found = lexicon.replace_from_lexicon(rows, V.lexicon(spark), X.synonym_quota(X.tokens(T())),
                                         D.STOP_WORDS)
    return found.select("sample_id", F.md5("pert").alias("pert"))


@query("synonym_replace_dict", f"""{H}, {S.SYNONYMS}, {S.forms_ctes('f', 'headlines')}
SELECT sample_id, pert FROM f""")
def _(spark, sf):
    return V.headlines(spark, sf, spread=True).select("sample_id", X.replace_forms(
        T(), ID(), D.SURFACE_SYNONYMS).alias("pert"))


SPANS = S.quote(S.ENTITY_SPANS)


@query("synonym_replace_guarded", f"""{H}, masked AS (SELECT sample_id,
regexp_replace(text, {SPANS}, chr(57344), 'g') AS text,
regexp_extract_all(text, {SPANS}) AS held FROM headlines), {S.SYNONYMS},
{S.forms_ctes('f', 'masked')}, gaps AS (SELECT f.sample_id, held,
string_split(pert, chr(57344)) AS g FROM f JOIN masked USING (sample_id))
SELECT sample_id, array_to_string(list_transform(g, lambda x, i: x || coalesce(held[i], '')), '')
AS pert FROM gaps""")
def _(spark, sf):
    return V.headlines(spark, sf, spread=True).select("sample_id", X.replace_forms_guarded(
        T(), ID(), D.SURFACE_SYNONYMS, entity_pattern(D.GAZETTEER)).alias("pert"))


GUARDED = ("'sales rose at Nokia as Strong demand rose. ' || text || "
           "' as weak demand fell by 3.5 % for Apple'")
FIGURE_SPANS = S.quote(S.FIGURE_SPAN)


@query("synonym_replace_guarded_table", f"""WITH {S.LEXICON}, {S.GUARD_NAMES}, syn AS (SELECT surface,
list(replace(synonym, '_', ' ') ORDER BY ord) AS synonyms FROM lexicon WHERE sense = 0
AND lower(synonym) <> lower(surface) GROUP BY surface),
d AS (SELECT doc_id AS sample_id, {GUARDED} AS text FROM documents),
cut AS (SELECT sample_id, string_split(regexp_replace(text, {S.quote(S.WHITESPACE)}, ' ', 'g'), ' ') AS p
FROM d), words AS (SELECT sample_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM cut),
places AS (SELECT * FROM (SELECT sample_id, w,
sum(length(w) + 1) OVER (PARTITION BY sample_id ORDER BY i) - length(w) - 1 AS start,
sum(CASE WHEN w <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY i) - 1 AS pos FROM words)
WHERE w <> ''),
named AS (SELECT sample_id, length(name) AS width, string_split(text, name) AS p FROM d
JOIN names ON contains(text, name)),
figured AS (SELECT sample_id, regexp_split_to_array(text, {FIGURE_SPANS}) AS p,
regexp_extract_all(text, {FIGURE_SPANS}) AS held FROM d),
spans AS (SELECT sample_id, list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * width AS low,
width FROM (SELECT *, unnest(range(1, len(p))) AS k FROM named) UNION ALL
SELECT sample_id, list_sum(list_transform(p[1:k], lambda x: length(x)))
+ coalesce(list_sum(list_transform(held[1:k - 1], lambda x: length(x))), 0), length(held[k])
FROM (SELECT *, unnest(range(1, len(p))) AS k FROM figured)),
ranked AS (SELECT p.sample_id, pos, synonyms, row_number() OVER (PARTITION BY p.sample_id
ORDER BY {S.md5(0, 'p.sample_id', 'pos')}, pos) AS rn FROM places p JOIN syn ON lower(w) = surface
WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.sample_id = p.sample_id AND start < low + width
AND low < start + length(w)))
SELECT p.sample_id, md5(string_agg(coalesce(r.synonyms[{S.h('0:pick', 'p.sample_id', 'p.pos')}
% len(r.synonyms) + 1], w), ' ' ORDER BY p.pos)) AS pert FROM places p LEFT JOIN ranked r
ON p.sample_id = r.sample_id AND p.pos = r.pos AND rn <= 2 GROUP BY p.sample_id""")
def _(spark, sf):
    """Long documents; some words of the lexicon stand inside a name of the table."""
    rows = V.documents(spark, sf).withColumn("text", F.concat(
        F.lit("sales rose at Nokia as Strong demand rose. "), "text",
        F.lit(" as weak demand fell by 3.5 % for Apple")))
    found = lexicon.replace_forms_guarded_from(rows, V.lexicon(spark), V.guard_names(spark))
    return found.select("sample_id", F.md5("pert").alias("pert"))


@query("template_paraphrase", f"{H} SELECT sample_id, {S.template('text')} AS pert FROM headlines")
def _(spark, sf):
    return V.headlines(spark, sf, spread=True).select("sample_id", X.template_paraphrase(T()).alias("pert"))


@query("paraphrase_unguarded", f"{H} SELECT sample_id, {S.paraphrase('text')} AS pert FROM headlines")
def _(spark, sf):
    return V.headlines(spark, sf, spread=True).select("sample_id", X.paraphrase_rules(T()).alias("pert"))


@query("jitter_percent", f"{H} SELECT sample_id, {S.jitter('text')} AS pert FROM headlines")
def _(spark, sf):
    return V.headlines(spark, sf, spread=True).select("sample_id", X.jitter_percents(T(), ID()).alias("pert"))


def _carried(d):
    """Digit ``d``, 33 to 45 nines or zeros and one decimal, moved by hand."""
    step = S.jitter_step("doc_id", "0")
    up = f"CASE {step} WHEN -0.2 THEN {d} || nines || '.7' WHEN -0.1 THEN {d} || nines || '.8' " \
         f"WHEN 0.1 THEN ({d} + 1) || zeros || '.0' ELSE ({d} + 1) || zeros || '.1' END"
    less = f"CASE {d} WHEN 1 THEN '' ELSE ({d} - 1)::VARCHAR END"
    down = f"CASE {step} WHEN -0.2 THEN {less} || nines || '.9' WHEN -0.1 THEN {d} || zeros || '.0' " \
           f"WHEN 0.1 THEN {d} || zeros || '.2' ELSE {d} || zeros || '.3' END"
    return f"""SELECT doc_id AS sample_id, 'up ' || CASE doc_id % 2 WHEN 0 THEN {up} ELSE {down} END
|| '% or more' AS pert FROM (SELECT doc_id, repeat('9', (32 + doc_id % 13)::INT) AS nines,
repeat('0', (32 + doc_id % 13)::INT) AS zeros FROM documents)"""


@query("jitter_percent_carry", _carried("(doc_id % 9 + 1)"))
def _(spark, sf):
    """Figures of 33 to 45 digits before the point that a carry or a borrow runs through."""
    n = (F.lit(32) + F.col("doc_id") % 13).cast("int")
    figure = F.when(F.col("doc_id") % 2 == 0, F.concat(F.repeat(F.lit("9"), n), F.lit(".9"))) \
        .otherwise(F.concat(F.repeat(F.lit("0"), n), F.lit(".1")))
    rows = V.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.concat(
        F.lit("up "), F.col("doc_id") % 9 + 1, figure, F.lit(" % or more")).alias("text"))
    return rows.select("sample_id", X.jitter_percents(T(), ID()).alias("pert"))


@query("jitter_percent_long", f"""SELECT doc_id AS sample_id, 'up ' || round(
(doc_id || '.' || n_chars || '4995')::DECIMAL(38,14) + {S.jitter_step("doc_id", "0")}, 1)::DECIMAL(38,1)
|| '% or more' AS pert FROM documents""")
def _(spark, sf):
    figures = V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.concat(
            F.lit("up "), "doc_id", F.lit("."), "n_chars", F.lit("4995 % or more")).alias("text"))
    return figures.select("sample_id", X.jitter_percents(T(), ID()).alias("pert"))


@query("swap_peer", f"""SELECT doc_id AS sample_id, md5({S.swap('text')}) AS digest FROM documents
UNION ALL SELECT sample_id, md5(pert) FROM (WITH {S.HEADLINES}
SELECT sample_id, {S.swap('text')} AS pert FROM headlines)""")
def _(spark, sf):
    rows = V.documents(spark, sf).select("sample_id", "text").unionByName(
        V.headlines(spark, sf).select("sample_id", "text"))
    return rows.select("sample_id", F.md5(X.swap_peer(T())).alias("digest"))


@query("perturb_numbers_entities", f"""{H}, {S.numbers_ctes('n', 'headlines')}
SELECT sample_id, pert FROM n""")
def _(spark, sf):
    return V.headlines(spark, sf, spread=True).select("sample_id", X.perturb_numbers_entities(T(), ID())
                                         .alias("pert"))


@query("guard_length", f"""WITH {S.DOC_PAIRS} SELECT sample_id,
md5(CASE WHEN {S.length_change('orig', 'pert')} > 0.2 THEN orig ELSE pert END) AS digest
FROM doc_pairs""")
def _(spark, sf):
    return V.doc_pairs(spark, sf).select("sample_id", F.md5(
        X.guard_length(F.col("orig"), F.col("pert"))).alias("digest"))


def _kept(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _labelled_pairs(spark, sf):
    """Headlines and their paraphrases with the scorer's label of both."""
    # the rules are applied once: both the scored texts and the rows read what is kept
    rows = _kept(V.headlines(spark, sf).select(
        "sample_id", T().alias("orig"), X.paraphrase_rules(T()).alias("pert")), "paraphrases")
    texts = rows.select(F.explode(F.array("orig", "pert")).alias("text"))
    scored = L.label_margins(V.text_scores(texts)).select("text", "label")
    a = scored.select(F.col("text").alias("orig"), F.col("label").alias("l0"))
    b = scored.select(F.col("text").alias("pert"), F.col("label").alias("l1"))
    return join_by_text(join_by_text(rows, a, "orig"), b, "pert")


LABEL_OF = "(['negative','neutral','positive'])[list_position(probs, list_max(probs))]"


@query("guard_polarity", f"""{H}, p AS (SELECT sample_id, text AS orig, {S.paraphrase('text')} AS pert
FROM headlines), texts AS (SELECT orig AS text FROM p UNION ALL SELECT pert FROM p),
{S.scores_cte('sc', 'texts')}, l AS (SELECT text, {LABEL_OF} AS y FROM sc)
SELECT sample_id, CASE WHEN a.y = b.y THEN pert ELSE orig END AS pert FROM p
JOIN l a ON a.text = orig JOIN l b ON b.text = pert""")
def _(spark, sf):
    return _labelled_pairs(spark, sf).select("sample_id", X.guard_polarity(
        F.col("orig"), F.col("pert"), F.col("l0"), F.col("l1")).alias("pert"))


# ---------------------------------------------------------------- filters

def _dot(a, b):
    return f"list_sum(list_transform({a}, lambda x, i: x * {b}[i]))"


@query("cosine_filter", f"""WITH {S.EMB_PAIRS}, s AS (SELECT sample_id, {_dot('ea', 'eb')} /
(sqrt({_dot('ea', 'ea')}) * sqrt({_dot('eb', 'eb')})) AS sim FROM emb_pairs)
SELECT sample_id, {S.r6('sim')} AS sim, sim >= 0.85 AS passed FROM s""")
def _(spark, sf):
    s = V.emb_pairs(spark, sf).select("sample_id", similarity.cosine(
        F.col("ea"), F.col("eb")).alias("sim"))
    return s.select("sample_id", round6(F.col("sim")).alias("sim"),
                    (F.col("sim") >= K.SIM_THRESHOLD).alias("passed"))


@query("cosine_from_tokens", f"""WITH {S.DOC_PAIRS}, {S.sim_ctes('s', 'doc_pairs', 'sample_id')}
SELECT sample_id, {S.r6('sim')} AS sim FROM s""")
def _(spark, sf):
    return V.doc_pairs(spark, sf).select("sample_id", round6(similarity.token_cosine(
        X.tokens(F.col("orig")), X.tokens(F.col("pert")))).alias("sim"))


@query("l2_normalize", f"""WITH e AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS v
FROM embeddings), n AS (SELECT sample_id, v, greatest(sqrt({_dot('v', 'v')}), 1e-12) AS n FROM e)
SELECT sample_id, i - 1 AS pos, {S.r6('v[i] / n')} AS x FROM (SELECT *,
unnest(range(1, len(v) + 1)) AS i FROM n)""")
def _(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode(
        similarity.l2_normalize(F.col("embedding"))).alias("pos", "x"))
    return e.select("sample_id", F.col("pos").cast("long").alias("pos"), round6(F.col("x")).alias("x"))


@query("length_ratio_filter", f"""WITH {S.DOC_PAIRS} SELECT sample_id,
{S.length_change('orig', 'pert')} <= 0.5 AS ok, {S.length_change('orig', 'pert')} <= 0.2 AS ok_tight
FROM doc_pairs""")
def _(spark, sf):
    change = X.length_change(F.col("orig"), F.col("pert"))
    return V.doc_pairs(spark, sf).select(
        "sample_id", (change <= K.LENGTH_RATIO).alias("ok"),
        (change <= K.NOTEBOOK_LENGTH_RATIO).alias("ok_tight"))


@query("entity_type_set", f"""{H} SELECT doc_id AS sample_id, {S.entities('text')} AS types FROM documents
UNION ALL SELECT sample_id, {S.entities('text')} FROM headlines""")
def _(spark, sf):
    rows = V.documents(spark, sf).select("sample_id", "text").unionByName(
        V.headlines(spark, sf).select("sample_id", "text"))
    return rows.select("sample_id", F.array_join(entity_types(T(), D.GAZETTEER), "|").alias("types"))


@query("entity_types_table", f"""SELECT doc_id AS sample_id, {S.entities('text')} AS types FROM documents""")
def _(spark, sf):
    names = spark.createDataFrame([(n, t) for t, v in D.GAZETTEER.items() for n in v],
                                  "name string, type string")
    return lexicon.entity_types_from(V.documents(spark, sf), names).select(
        "sample_id", F.array_join("entity_types", "|").alias("types"))


@query("entity_set_filter", f"""{H}, {S.numbers_ctes('n', 'headlines')}
SELECT sample_id, {S.entities('text')} = {S.entities('pert')} AS ner_ok
FROM headlines JOIN n USING (sample_id)""")
def _(spark, sf):
    rows = V.headlines(spark, sf, spread=True).select("sample_id", "text", F.inline(F.array(F.struct(
        X.perturb_numbers_entities(T(), ID()).alias("pert")))))
    return rows.select("sample_id", (entity_types(T(), D.GAZETTEER) == entity_types(
        F.col("pert"), D.GAZETTEER)).alias("ner_ok"))


CASCADE_OUT = f"passed, {S.r6('sim')} AS sim, len_ok, ner_ok, src_ner, tgt_ner"


def _flat(df, *keys):
    """Cascade columns with rounded similarity and joined type sets."""
    return df.select(*keys, "passed", round6(F.col("sim")).alias("sim"), "len_ok", "ner_ok",
                     F.array_join("src_ner", "|").alias("src_ner"),
                     F.array_join("tgt_ner", "|").alias("tgt_ner"))


@query("filter_cascade", f"""WITH dp AS (SELECT doc_id AS sample_id, 0 AS method_ord, text AS orig,
replace(replace(replace(text,' and ',' '),' the ',' '),'%',' percent') AS pert FROM documents),
{S.cascade_ctes('c', 'dp')} SELECT sample_id, {CASCADE_OUT} FROM c""")
def _(spark, sf):
    # figures spelled out lose their PERCENT entity, which the last stage must notice
    rows = V.doc_pairs(spark, sf).withColumn("pert", F.replace("pert", F.lit("%"), F.lit(" percent")))
    return _flat(L.cascade(rows), "sample_id")


@query("filter_cascade_vectors", f"""{H}, {S.REWRITES}, dp AS (SELECT sample_id, text AS orig,
coalesce(rewrite, text || ' eee 5 %') AS pert FROM headlines LEFT JOIN rewrites ON text = orig),
v AS (SELECT *, [length(orig), length(orig) - length(replace(orig, ' ', '')),
length(orig) - length(replace(orig, 'e', ''))]::DOUBLE[] AS a, [length(pert),
length(pert) - length(replace(pert, ' ', '')), length(pert) - length(replace(pert, 'e', ''))]::DOUBLE[] AS b
FROM dp), s AS (SELECT *, list_inner_product(a, b) / sqrt(list_inner_product(a, a))
/ sqrt(list_inner_product(b, b)) AS sim FROM v) SELECT sample_id, {S.r6('sim')} AS sim, sim >= 0.99
AND {S.length_change('orig', 'pert')} <= 0.5 AND {S.entities('orig')} = {S.entities('pert')} AS passed FROM s""")
def _(spark, sf):
    rows = L.candidates(V.headlines(spark, sf, spread=True), L.LibraryConfig(methods=("rewrite",)),
                        V.rewrites(spark, sf))
    rows = rows.withColumn("pert", F.when(F.col("pert") == F.col("orig"), F.concat(
        "orig", F.lit(" eee 5 %"))).otherwise(F.col("pert")))
    out = L.cascade_by_vectors(rows, length_encoder(), L.LibraryConfig(sim_threshold=0.99))
    return out.select("sample_id", round6(F.col("sim")).alias("sim"), "passed")


@query("filter_sim_readable", f"""{H}, {S.REWRITES}, dp AS (SELECT sample_id, text AS orig,
coalesce(rewrite, text) || CASE WHEN rewrite IS NULL THEN '' ELSE ' as the markets had expected it to be' END AS pert
FROM headlines LEFT JOIN rewrites ON text = orig), {S.sim_ctes('s', 'dp', 'sample_id')}
SELECT sample_id, length(pert) <= 80 AND sim >= 0.85 AS passed FROM dp JOIN s USING (sample_id)""")
def _(spark, sf):
    longer = F.concat("pert", F.lit(" as the markets had expected it to be"))
    rows = L.candidates(V.headlines(spark, sf, spread=True), L.LibraryConfig(methods=("rewrite",)),
                        V.rewrites(spark, sf))
    rows = rows.withColumn("pert", F.when(F.col("pert") != F.col("orig"), longer)
                           .otherwise(F.col("pert")))
    return L.readable_and_similar(rows).select("sample_id", "passed")


CAND = f"{H}, {S.candidate_ctes('cand')}"


@query("drop_identity", f"""{CAND} SELECT sample_id, method, pert FROM cand
WHERE {S.strip('pert')} <> {S.strip('orig')}""")
def _(spark, sf):
    return L.candidates(V.headlines(spark, sf, spread=True), L.LibraryConfig(drop_identity=True),
                        V.rewrites(spark, sf)).select("sample_id", "method", "pert")


# ---------------------------------------------------------------- library

@query("gen_candidates", f"{CAND} SELECT sample_id, method_ord, method, orig, pert FROM cand")
def _(spark, sf):
    return L.candidates(V.headlines(spark, sf, spread=True), rewrites=V.rewrites(spark, sf)).select(
        "sample_id", "method_ord", "method", "orig", "pert")


@query("gen_candidates_prototype", f"""{H}, {S.SYNONYMS}, {S.forms_ctes('f', 'headlines')},
{S.numbers_ctes('n', 'headlines')}
SELECT sample_id, 0 AS method_ord, 'synonym_dict' AS method, pert FROM f
UNION ALL SELECT sample_id, 1, 'template', {S.template('text')} FROM headlines
UNION ALL SELECT sample_id, 2, 'numbers', pert FROM n""")
def _(spark, sf):
    return L.candidates(V.headlines(spark, sf, spread=True), L.LibraryConfig(methods=L.PROTOTYPE_METHODS)
                        ).select("sample_id", "method_ord", "method", "pert")


TEXTS = "texts AS (SELECT orig AS text FROM cand UNION ALL SELECT pert FROM cand)"
TAGS = f"""{TEXTS}, {S.scores_cte('sc', 'texts')}, m AS (SELECT text, {LABEL_OF} AS y,
list_sort(probs)[3] - list_sort(probs)[2] AS m FROM sc), tagged AS (SELECT lib.*,
CASE WHEN passed THEN a.y END AS orig_label, CASE WHEN passed THEN b.y END AS pert_label,
CASE WHEN passed THEN a.y <> b.y END AS flipped, CASE WHEN passed THEN a.m - b.m >= 0.2 END
AS weakened, CASE WHEN passed THEN a.m END AS m0, CASE WHEN passed THEN b.m END AS m1
FROM lib JOIN m a ON a.text = orig JOIN m b ON b.text = pert)"""
TAG_OUT = f"orig_label, pert_label, flipped, weakened, {S.r6('m0')} AS m0, {S.r6('m1')} AS m1"


def digest_model():
    """A stand-in model: class scores from the text's digest."""
    def load():
        import hashlib

        import numpy as np

        def predict(texts):
            scores = [[1 + int(hashlib.md5(f"{x}:{t}".encode()).hexdigest()[:8], 16) % 1000
                       for x in K.REWARD_ORDER] for t in texts]
            scores = np.array(scores, dtype="float64")
            return scores / scores.sum(axis=1, keepdims=True)
        return predict
    return load


def _scored_library(spark, sf):
    return L.build_scored_library(V.headlines(spark, sf, spread=True), digest_model(),
                                  lambda library: _kept(library, "library"),
                                  rewrites=V.rewrites(spark, sf), model_order=K.REWARD_ORDER)


@query("build_library", f"""{LIB}, {TAGS} SELECT sample_id, method, orig, pert, {CASCADE_OUT}, {TAG_OUT}
FROM tagged""")
def _(spark, sf):
    lib = _scored_library(spark, sf).withColumns(
        {"m0": round6(F.col("m0")), "m1": round6(F.col("m1"))})
    flat = _flat(lib, "sample_id", "method", "orig", "pert", "orig_label", "pert_label",
                 "flipped", "weakened", "m0", "m1")
    return flat


@query("adversarial_tag", f"""{LIB}, {TAGS} SELECT method, orig_label, pert_label, flipped, weakened,
count(*) AS n FROM tagged GROUP BY ALL""")
def _(spark, sf):
    return _scored_library(spark, sf).groupBy(
        "method", "orig_label", "pert_label", "flipped", "weakened").agg(F.count("*").alias("n"))


@query("label_margin", f"""WITH {S.PROB_PAIRS} SELECT sample_id, {LABEL_OF.replace('probs', 'p_student')}
AS label, {S.r6('list_sort(p_student)[3] - list_sort(p_student)[2]')} AS margin FROM prob_pairs""")
def _(spark, sf):
    return L.label_margins(V.prob_pairs(spark, sf), p="p_student").select(
        "sample_id", "label", round6(F.col("margin")).alias("margin"))


def _split(spark, sf, part):
    split = sampling.split_stratified(V.headlines(spark, sf))
    return split.filter(F.col("split") == part).select("sample_id", "sentiment", "text")


def _part_library(rows, spark, sf):
    return L.build_library(rows, rewrites=V.rewrites(spark, sf))


def _part_sql(part):
    return f"""{H}, {S.rank_ctes()}, part AS (SELECT sample_id, sentiment, text FROM split
WHERE split = '{part}'), {S.library_ctes('part')},
lab AS (SELECT text, arg_max(sentiment, sample_id) AS y FROM part GROUP BY text),
prs AS (SELECT DISTINCT orig, pert FROM lib WHERE passed)"""


@query("augment_train", f"""{_part_sql('train')} SELECT text, sentiment, text AS orig_text,
text AS pert_text FROM part UNION ALL SELECT pert, y, orig, pert FROM prs LEFT JOIN lab ON orig = text""")
def _(spark, sf):
    train = _split(spark, sf, "train")
    return L.augment_train(train, _part_library(train, spark, sf))


@query("clean_and_pert_test", f"""{_part_sql('test')}, b AS (SELECT 'clean' AS variant, text,
sentiment AS y_true FROM part UNION ALL SELECT 'perturbed', pert, y FROM prs LEFT JOIN lab ON orig = text)
SELECT variant, text, {HEAD} || text || '] =' AS prompt, y_true FROM b""")
def _(spark, sf):
    test = _split(spark, sf, "test")
    return L.clean_and_pert_test(test, _part_library(test, spark, sf))


@query("clean_pert_pairs", f"""{_part_sql('test')}, f AS (SELECT orig, arg_min(pert, (sample_id, method_ord))
AS pert FROM lib WHERE passed GROUP BY orig)
SELECT sample_id, sentiment AS y_true, text, pert, {HEAD} || text || '] =' AS clean_prompt,
{HEAD} || pert || '] =' AS pert_prompt FROM part JOIN f ON text = orig""")
def _(spark, sf):
    test = _split(spark, sf, "test")
    return L.clean_pert_pairs(test, _part_library(test, spark, sf))


@query("library_profile", f"""{LIB}, lab AS (SELECT text, arg_max(sentiment, sample_id) AS y FROM headlines
GROUP BY text), prs AS (SELECT DISTINCT orig, pert FROM lib WHERE passed),
expanded AS (SELECT sentiment FROM headlines UNION ALL SELECT y FROM prs LEFT JOIN lab ON orig = text)
SELECT sentiment, 'clean' AS variant, count(*) AS n FROM headlines GROUP BY sentiment
UNION ALL SELECT sentiment, 'expanded', count(*) FROM expanded GROUP BY sentiment""")
def _(spark, sf):
    return L.library_profile(V.headlines(spark, sf), library(spark, sf))


@query("library_pass_rates", f"""{LIB} SELECT method, count(*) AS n, {S.r6('avg(passed::INT)')} AS pass_rate
FROM lib GROUP BY method""")
def _(spark, sf):
    return L.pass_rates(library(spark, sf)).withColumn("pass_rate", round6(F.col("pass_rate")))


FLAGSHIP = f"""{H}, {S.numbers_ctes('n', 'headlines')}, f AS (SELECT sentiment,
{S.length_change('text', 'pert')} <= 0.5 AND {S.entities('text')} = {S.entities('pert')} AS passed
FROM headlines JOIN n USING (sample_id)) SELECT sentiment, count(*) AS pairs,
{S.r6('avg(passed::INT)')} AS pass_rate FROM f GROUP BY sentiment"""


@query("numbers_pass_rate", FLAGSHIP)
def flagship(spark, sf):
    """Pass rate and pair count per class of the numbers-and-entities edit."""
    rows = V.headlines(spark, sf, spread=True).select("sentiment", "text", F.inline(F.array(F.struct(
        X.perturb_numbers_entities(T(), ID()).alias("pert")))))
    ok = (X.length_change(T(), F.col("pert")) <= K.LENGTH_RATIO) & (
        entity_types(T(), D.GAZETTEER) == entity_types(F.col("pert"), D.GAZETTEER))
    return rows.groupBy("sentiment").agg(
        F.count("*").alias("pairs"), round6(F.avg(ok.cast("int"))).alias("pass_rate"))
