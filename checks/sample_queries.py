"""Sources, projections, joins, splits, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as S, views as V
from checks.registry import query
from steadytext.functions import text as X
from steadytext.functions.probs import argmax
from steadytext.operators import joins as J, lexicon as L, sampling as P
from steadytext.operators.library import clean_rows, passed_pairs, build_library
from steadytext.operators.prompts import prompt_frames, rows_for_reward
from steadytext.sources import files as IO
from steadytext.sources.scratch import scratch_path

H, R = f"WITH {S.HEADLINES}", f"WITH {S.HEADLINES}, {S.REWRITES}"
LIB = f"WITH {S.HEADLINES}, {S.library_ctes()}"
SPLIT = f"WITH {S.HEADLINES}, {S.rank_ctes()}"


def pairs(spark, sf):
    return V.rewrites(spark, sf).withColumnRenamed("rewrite", "pert")


def library(spark, sf):
    return build_library(V.headlines(spark, sf, spread=True), rewrites=V.rewrites(spark, sf))


# ---------------------------------------------------------------- sources

@query("src_headlines_csv", f"{H} SELECT sentiment, text FROM headlines")
def _(spark, sf):
    path = IO.write_headlines_csv(V.headlines(spark, sf), scratch_path(spark, "headlines"))
    return IO.read_headlines_csv(spark, path)


@query("src_headlines", f"{H} SELECT sentiment, text FROM headlines")
def _(spark, sf):
    """The CSV file is turned into Parquet once, which is what is read."""
    path = IO.write_headlines_csv(V.headlines(spark, sf), scratch_path(spark, "headlines"))
    return IO.read_headlines(spark, IO.import_headlines(spark, path, scratch_path(spark, "imported")))


@query("src_pairs_csv", f"{R} SELECT orig, rewrite AS pert FROM rewrites")
def _(spark, sf):
    return IO.read_pairs(spark, IO.write_pairs(pairs(spark, sf), scratch_path(spark, "pairs")))


@query("sink_pairs", f"{LIB} SELECT DISTINCT orig, pert FROM lib WHERE passed")
def _(spark, sf):
    out = passed_pairs(library(spark, sf))
    return IO.read_pairs(spark, IO.write_pairs(out, scratch_path(spark, "library")))


@query("materialize_if_absent", f"{H} SELECT * FROM headlines")
def _(spark, sf):
    root = scratch_path(spark, "stored")
    # the second call reads what the first one stored
    for _ in range(2):
        out = IO.materialize(spark, lambda: V.headlines(spark, sf), root, "headlines",
                             {"input": sf, "version": 1}, V.headlines(spark, sf))
    return out


@query("sink_predictions", f"""WITH {S.PREDS} SELECT text, y_true, y_pred FROM preds
JOIN documents ON doc_id = sample_id""")
def _(spark, sf):
    p = V.preds(spark, sf)
    rows = V.table(spark, sf, "documents").withColumnRenamed("doc_id", "sample_id").join(
        p.select("sample_id", F.col("y_true").alias("sentiment")), "sample_id")
    path = scratch_path(spark, "predictions")
    return IO.read_predictions(spark, IO.write_predictions(rows, p, path))


# ------------------------------------------------------------ projections

@query("proj_pairs", f"{R} SELECT orig AS orig_text, rewrite AS text FROM rewrites")
def _(spark, sf):
    df = V.rewrites(spark, sf)
    wanted = [c for c in ("orig", "rewrite", "passed") if c in df.columns]
    return df.select(*wanted).withColumnsRenamed({"orig": "orig_text", "rewrite": "text"})


@query("proj_clean_rows", f"""{H} SELECT text, sentiment, text AS orig_text, text AS pert_text
FROM headlines""")
def _(spark, sf):
    return clean_rows(V.headlines(spark, sf))


@query("filter_class", f"{H} SELECT * FROM headlines WHERE sentiment = 'negative'")
def _(spark, sf):
    return V.headlines(spark, sf).filter(F.col("sentiment") == "negative")


@query("filter_passed", f"{LIB} SELECT sample_id, method, pert FROM lib WHERE passed")
def _(spark, sf):
    return library(spark, sf).filter("passed").select("sample_id", "method", "pert")


@query("cast_text", f"""{R} SELECT sample_id, coalesce(rewrite, 'nan') AS text FROM headlines
LEFT JOIN rewrites ON text = orig""")
def _(spark, sf):
    r = V.rewrites(spark, sf)
    rows = V.headlines(spark, sf).join(r, F.col("text") == F.col("orig"), "left")
    return rows.select("sample_id", X.text_or_nan(F.col("rewrite")).alias("text"))


HEAD = S.quote(S.K.PROMPT_HEAD)


@query("prompt_train", f"""{H} SELECT sample_id,
{S.strip(f"{HEAD} || text || '] = ' || sentiment")} AS prompt FROM headlines""")
def _(spark, sf):
    return V.headlines(spark, sf).select("sample_id", X.train_prompt(
        F.col("text"), F.col("sentiment")).alias("prompt"))


@query("prompt_test", f"""{H} SELECT sample_id, {S.strip(f"{HEAD} || text || '] = '")} AS prompt
FROM headlines""")
def _(spark, sf):
    return V.headlines(spark, sf).select("sample_id", X.eval_prompt(F.col("text"))
                                         .alias("prompt"))


@query("prompt_causal", """SELECT doc_id AS sample_id, 'Text: ' || text || chr(10) || 'Sentiment:'
AS prompt, 'user' AS role, 'Classify the sentiment of the following text into negative, neutral, '
|| 'or positive.' || chr(10) || 'Text: ' || text || chr(10) || 'Answer one word: Sentiment:'
AS content FROM documents""")
def _(spark, sf):
    t = F.col("text")
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), X.causal_prompt(t).alias("prompt"),
        F.inline(X.chat_prompt(t)))


@query("rows_for_reward", f"""{R} SELECT sample_id, {HEAD} || text || '] =' AS prompt,
{HEAD} || rewrite || '] =' AS pert_prompt, sentiment AS ground_truth, text AS orig_text,
rewrite AS pert_text FROM headlines LEFT JOIN rewrites ON text = orig""")
def _(spark, sf):
    r = V.rewrites(spark, sf)
    rows = V.headlines(spark, sf).join(r, F.col("text") == F.col("orig"), "left")
    # a row without a rewrite has no source text of its own either
    return rows_for_reward(rows.select("sample_id", "sentiment", "text",
                                       F.col("orig").alias("orig_text"),
                                       F.col("rewrite").alias("pert_text")))


@query("prompt_frames", f"""{SPLIT} SELECT sample_id, split, draw, CASE WHEN split = 'test'
THEN {HEAD} || text || '] =' ELSE {HEAD} || text || '] = ' || sentiment END AS prompt,
CASE WHEN split = 'test' THEN sentiment END AS y_true FROM split""")
def _(spark, sf):
    return prompt_frames(P.experiment_split(V.headlines(spark, sf)))


# ------------------------------------------------------------------ joins

@query("join_pairs_inner", f"""{R} SELECT sample_id, sentiment, text, rewrite AS pert FROM headlines
JOIN rewrites ON text = orig""")
def _(spark, sf):
    return J.join_pairs(V.headlines(spark, sf), pairs(spark, sf)).drop("orig")


@query("join_label_map", f"""{R} SELECT orig, rewrite AS pert, y AS sentiment FROM rewrites LEFT JOIN
(SELECT text, arg_max(sentiment, sample_id) AS y FROM {'''(SELECT * FROM headlines)'''}
GROUP BY text) ON orig = text""")
def _(spark, sf):
    return J.lookup_label(pairs(spark, sf), V.headlines(spark, sf)).select(
        "orig", "pert", "sentiment")


@query("join_semi_known", f"""WITH {S.HEADLINES}, {S.REWRITES}, {S.rank_ctes()}
SELECT orig, rewrite AS pert FROM rewrites
WHERE orig IN (SELECT text FROM split WHERE split = 'test')""")
def _(spark, sf):
    test = P.split_stratified(V.headlines(spark, sf)).filter("split = 'test'")
    return J.keep_known(pairs(spark, sf), test).select("orig", "pert")


ANTI = f"""{SPLIT} SELECT sample_id, sentiment, text FROM headlines WHERE sample_id NOT IN
(SELECT sample_id FROM split WHERE split <> 'eval')"""


@query("join_anti_rest", ANTI)
def _(spark, sf):
    df = V.headlines(spark, sf)
    return J.drop_used(df, P.split_stratified(df))


@query("join_peer_first_match", f"""WITH {S.HEADLINES}, {S.PEERS}, hits AS (SELECT sample_id,
arg_min(a, ord) AS peer, arg_min(b, ord) AS replacement FROM headlines
JOIN peers ON contains(text, a) GROUP BY sample_id)
SELECT sample_id, peer, replacement FROM headlines LEFT JOIN hits USING (sample_id)""")
def _(spark, sf):
    return L.first_peer(V.headlines(spark, sf, spread=True), V.peers(spark)).select(
        "sample_id", "peer", "replacement")


SYN_TABLE = f"""syn AS (SELECT surface, list(replace(synonym, '_', ' ') ORDER BY ord) AS synonyms
FROM lexicon WHERE sense = 0 AND lower(synonym) <> lower(surface) GROUP BY surface)"""


@query("join_synonym_lexicon", f"""WITH {S.HEADLINES}, {S.LEXICON}, {SYN_TABLE},
words AS (SELECT DISTINCT unnest({S.toks('text')}) AS word FROM headlines)
SELECT word, coalesce(array_to_string(synonyms, '|'), '') AS synonyms FROM words
LEFT JOIN syn ON word = surface""")
def _(spark, sf):
    words = V.headlines(spark, sf).select(
        F.explode(X.tokens(F.col("text"))).alias("word")).distinct()
    return L.join_synonyms(words, V.lexicon(spark)).select(
        "word", F.array_join("synonyms", "|").alias("synonyms"))


@query("join_external_rewrite", f"""{R} SELECT sample_id, coalesce(rewrite, text) AS rewrite
FROM headlines LEFT JOIN rewrites ON text = orig""")
def _(spark, sf):
    return J.external_rewrite(V.headlines(spark, sf), V.rewrites(spark, sf)).select(
        "sample_id", "rewrite")


# ---------------------------------------------------------------- samples

@query("split_stratified", f"""{SPLIT} SELECT sample_id, sentiment, text, split FROM split
WHERE split <> 'eval'""")
def _(spark, sf):
    return P.split_stratified(V.headlines(spark, sf))


@query("shuffle_rows", f"{H} SELECT *, {S.md5(10, 'sample_id')} AS shuffle_key FROM headlines")
def _(spark, sf):
    return P.with_shuffle_key(V.headlines(spark, sf))


@query("sample_with_replacement", f"""{SPLIT} SELECT sample_id, sentiment, text, draw FROM split
WHERE split = 'eval'""")
def _(spark, sf):
    return P.sample_with_replacement(V.headlines(spark, sf), skip=600)


@query("sample_batch", f"""{H} SELECT * FROM headlines
ORDER BY {S.md5(0, '3', 'sample_id')}, sample_id LIMIT 32""")
def _(spark, sf):
    return P.sample_batch(V.headlines(spark, sf), 32, step=3)


LINES = "SELECT l_orderkey * 8 + l_linenumber AS sample_id FROM lineitem"


@query("sample_batch_large", " UNION ALL ".join(f"""SELECT {k} AS k, * FROM (SELECT * FROM ({LINES})
ORDER BY {S.md5(5, '3', 'sample_id')}, sample_id LIMIT {k})""" for k in (100, 20000, 100000)))
def _(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_id"))
    parts = [P.sample_batch(rows, k, step=3, seed=5).select(F.lit(k).alias("k"), "*")
             for k in (100, 20000, 100000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("head_n", f"{H} SELECT * FROM headlines ORDER BY sample_id LIMIT 100")
def _(spark, sf):
    return P.head_n(V.headlines(spark, sf), 100)


@query("minibatch_assign", f"""{H} SELECT sample_id, CAST(floor(sample_id / 64) AS bigint) AS batch_id
FROM headlines""")
def _(spark, sf):
    return P.assign_minibatch(V.headlines(spark, sf), 64).select("sample_id", "batch_id")


@query("minibatch_hash", f"""{H} SELECT CAST(('0x' || substr({S.md5(0, 'sample_id')}, 1, 15))::BIGINT % 64 AS bigint)
AS batch_id, count(*) AS n FROM headlines GROUP BY 1""")
def _(spark, sf):
    batched = P.assign_hash_batch(V.headlines(spark, sf), 64)
    return batched.groupBy("batch_id").agg(F.count("*").alias("n"))


@query("minibatch_exact", f"""{H} SELECT sample_id, CAST(floor((row_number() OVER (
ORDER BY {S.md5(0, 'sample_id')}, sample_id) - 1) / 32) AS bigint) AS batch_id FROM headlines""")
def _(spark, sf):
    sparse = V.headlines(spark, sf)
    return P.assign_exact_batch(sparse, 32).select("sample_id", "batch_id")


def kept(df):
    """A table written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@query("minibatch_ordered", """SELECT sample_id, CAST(floor((row_number() OVER (ORDER BY sample_id) - 1) / 32)
AS bigint) AS batch_id FROM (SELECT (o_orderkey % 5) * 1000000000000 + o_orderkey * o_orderkey AS sample_id
FROM orders)""")
def _(spark, sf):
    """Ids in five clusters far apart, denser at the beginning of each."""
    clustered = V.table(spark, sf, "orders").select(((F.col("o_orderkey") % 5) * 1000000000000
                                                     + F.col("o_orderkey") * F.col("o_orderkey"))
                                                    .cast("long").alias("sample_id"))
    return P.assign_ordered_batch(clustered, 32, kept, range_rows=1 << 12)


@query("swap_peer_table", f"""WITH {S.HEADLINES}, {S.PEERS}, hits AS (SELECT sample_id,
arg_min(a, ord) AS a, arg_min(b, ord) AS b FROM headlines JOIN peers ON contains(text, a) GROUP BY sample_id)
SELECT sample_id, CASE WHEN a IS NULL THEN text ELSE substr(text, 1, strpos(text, a) - 1) || b
|| substr(text, strpos(text, a) + length(a)) END AS pert FROM headlines LEFT JOIN hits USING (sample_id)""")
def _(spark, sf):
    return L.swap_first_peer(V.headlines(spark, sf, spread=True), V.peers(spark)).select(
        "sample_id", "pert")


PICK_RANK = S.md5(0, "sample_id", "method")


@query("pick_one_per_text", f"""{LIB}, best AS (SELECT sample_id, arg_min(pert, {PICK_RANK})
AS pert FROM lib WHERE passed GROUP BY sample_id)
SELECT sample_id, pert FROM headlines LEFT JOIN best USING (sample_id)""")
def _(spark, sf):
    return J.pick_one_pert(library(spark, sf))


@query("drop_unpaired", f"""{R}, b AS (SELECT CAST(floor(sample_id / 4) AS bigint) AS batch_id, rewrite
FROM headlines LEFT JOIN rewrites ON text = orig)
SELECT batch_id, count(rewrite) AS kept, count(*) - count(rewrite) AS skipped,
count(rewrite) = 0 AS empty FROM b GROUP BY batch_id""")
def _(spark, sf):
    rows = V.headlines(spark, sf).join(pairs(spark, sf), F.col("text") == F.col("orig"), "left")
    return P.batch_pairing(P.assign_minibatch(rows, 4))


@query("argmax_row", f"""WITH {S.PROB_PAIRS} SELECT sample_id,
(list_position(p_student, list_max(p_student)) - 1)::INT AS top FROM prob_pairs""")
def _(spark, sf):
    return V.prob_pairs(spark, sf).select("sample_id", argmax(F.col("p_student")).alias("top"))


@query("order_report", f"""WITH {S.HEADLINES} SELECT array_to_string(list_sort(list(DISTINCT sentiment)), '|')
AS labels FROM headlines""")
def _(spark, sf):
    return V.headlines(spark, sf).agg(
        F.array_join(F.array_sort(F.collect_set("sentiment")), "|").alias("labels"))


# ------------------------------------------------------- dedup, set operations

@query("dedup_pairs", f"{LIB} SELECT DISTINCT orig, pert FROM lib")
def _(spark, sf):
    return J.distinct_pairs(library(spark, sf))


@query("dedup_first_pert", f"""{LIB} SELECT orig, arg_min(pert, (sample_id, method_ord)) AS pert
FROM lib WHERE passed GROUP BY orig""")
def _(spark, sf):
    return J.first_pert(library(spark, sf).filter("passed"))


@query("union_clean_aug", f"""{R} SELECT text, sentiment FROM headlines UNION ALL
SELECT rewrite, NULL FROM rewrites""")
def _(spark, sf):
    extra = V.rewrites(spark, sf).select(F.col("rewrite").alias("text"),
                                         F.lit(None).cast("string").alias("sentiment"))
    return V.headlines(spark, sf).select("text", "sentiment").unionByName(extra)


@query("union_class_parts", f"{SPLIT} SELECT sample_id, sentiment, split FROM split WHERE split <> 'eval'")
def _(spark, sf):
    split = P.split_stratified(V.headlines(spark, sf)).select("sample_id", "sentiment", "split")
    # the split is one frame already; stacking its class parts gives it back
    a, b, c = (split.filter(F.col("sentiment") == x) for x in S.K.LABELS)
    return a.unionByName(b).unionByName(c)


@query("except_used", ANTI.replace("SELECT sample_id, sentiment, text FROM", "SELECT sample_id FROM"))
def _(spark, sf):
    df = V.headlines(spark, sf)
    return J.drop_used(df.select("sample_id"), P.split_stratified(df))


@query("distinct_labels", f"WITH {S.PREDS} SELECT DISTINCT y_pred AS label FROM preds")
def _(spark, sf):
    return V.preds(spark, sf).select(F.col("y_pred").alias("label")).distinct()
