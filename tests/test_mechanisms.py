"""Names of any number, spans, sparse vectors, shared storage, large samples, callers' models and rewards."""

import random
import re
import threading
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import views as V
from checks.registry import QUERIES, load
from checks.sample_queries import kept
from checks.score_queries import counting_model, word_model
from steadytext import constants as K
from steadytext.functions import similarity as Y, text as X
from steadytext.operators import joins as J, lexicon, library as L, rewards as R, sampling as P, scoring as M
from steadytext.sources import files as IO

load()
SF = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------ names of any number

def names_table(spark, names):
    return spark.createDataFrame([(i, a, f"<{a}>") for i, a in enumerate(names)], "ord int, a string, b string")


def many_names(n):
    draw = random.Random(3)
    out = {"".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDÄß日本 .-", k=draw.randint(3, 12))) for _ in range(n)}
    return sorted(x for x in out if x.strip() == x)


@pytest.mark.parametrize("n", [8, 100_000])
def test_first_peer_finds_what_a_plain_search_finds(spark, n):
    draw = random.Random(n)
    names = many_names(n) if n > 8 else ["Apple", "BP", "日本", "x", "a.b", "ÄÖ", "Nokia Oyj", "😀"]
    texts = ["".join(draw.choices("abc ABCÄ日本.-", k=40)) + draw.choice(names) + "".join(draw.choices("xyz \n", k=9))
             for _ in range(60)] + ["", "nothing here", "A", "😀😀", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "sample_id int, text string")
    got = {r.sample_id: r.peer for r in lexicon.first_peer(rows, names_table(spark, names)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == next((a for a in names if t is not None and a in t), None), t


def test_few_places_leave_the_row(spark):
    headlines = V.headlines(spark, SF).select("text").distinct()
    starts = lexicon.name_starts(V.peers(spark))
    keys = headlines.select(F.size(lexicon.possible_keys(F.col("text"), starts)).alias("n"),
                            F.char_length("text").alias("chars")).agg(F.sum("n"), F.sum("chars")).first()
    assert 0 < keys[0] < 0.03 * keys[1]
    docs = V.documents(spark, SF)
    many = lexicon.name_starts(names_table(spark, many_names(100_000)))
    keys = docs.select(F.size(lexicon.possible_keys(F.col("text"), many)).alias("n"),
                       F.char_length("text").alias("chars")).agg(F.sum("n"), F.sum("chars")).first()
    assert keys[0] < 0.15 * keys[1]      # 3 to 12 characters: every other name is shorter than a key


def test_no_names_and_empty_names(spark):
    rows = spark.createDataFrame([(1, "a text"), (2, None)], "sample_id int, text string")
    for names in ([], ["", None]):
        found = lexicon.first_peer(rows, names_table(spark, names)).collect()
        assert [(r.peer, r.replacement) for r in found] == [(None, None)] * 2


def test_class_of_first_characters():
    points = [ord(c) for c in "ABDE"] + list(range(1000, 1400, 2))
    held = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))),
                                   lexicon._char_class(points)) + "]")
    assert all(held.match(chr(p)) for p in points)
    small = lexicon._char_class([65, 66, 68])
    assert small == r"\x{41}-\x{42}\x{44}-\x{44}"


def plain_spans(text, names):
    out = []
    for name in names:
        at = text.find(name) if name else -1
        while at >= 0:
            out.append((at, at + len(name)))
            at = text.find(name, at + len(name))
    return out


def test_spans_against_plain_search(spark):
    names = ["aa", "a.b", r"c\Ed", "(x", "日本", "é", "word w"]
    texts = ["aaa aaaa", r"a.b axb c\Ed (x (x", "日本日本 é", "word word w", "", "12 % or 3.5% and EUR 7"]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "_text string, _whole string")
    table = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted((int(r._text), r.start, r.stop) for r in lexicon.name_spans(frame, table).collect())
    assert got == sorted((i, *s) for i, t in enumerate(texts) for s in plain_spans(t, names))
    figures = lexicon.name_spans(frame, table.limit(0), r"[0-9.]+ ?%|EUR [0-9]+")
    assert sorted(tuple(r) for r in figures.collect()) == [("5", 0, 4), ("5", 8, 12), ("5", 17, 22)]


def test_guarded_words_stay_and_rows_may_repeat(spark):
    lexicon_rows = spark.createDataFrame([("rose", "rise", 0, 0, "climbed"), ("fell", "fall", 0, 0, "dropped")],
                                         "surface string, lemma string, sense int, ord int, synonym string")
    names = spark.createDataFrame([("Mary rose", "ORG"), ("fell 5", "X"), (None, "X")], "name string, type string")
    rows = spark.createDataFrame(
        [(1, "Mary rose  Rose fell"), (1, "Mary rose  Rose fell"), (2, "fell 5% fell"), (3, ""), (4, " \t"), (5, None),
         (None, "rose"), (6, "rose"), (7, "x" * 5000 + " rose")], "sample_id int, text string")
    rows = rows.withColumn("word", F.lit("kept"))
    out = lexicon.replace_forms_guarded_from(rows, lexicon_rows, names).collect()
    assert sorted(((r.sample_id, r.pert) for r in out), key=str) == sorted([
        (1, "Mary rose climbed dropped"), (1, "Mary rose climbed dropped"), (2, "fell 5% dropped"), (3, ""), (4, " \t"),
        (5, None), (None, "rose"), (6, "climbed"), (7, "x" * 5000 + " climbed")], key=str)
    assert {r.word for r in out} == {"kept"}
    assert lexicon.replace_forms_guarded_from(rows.limit(0), lexicon_rows, names).count() == 0


# ------------------------------------------------------------------ long figures

def test_long_figures_move_exactly(spark):
    draw = random.Random(1)
    figures = []
    for _ in range(300):
        body = "".join(draw.choice(["9" * draw.randint(1, 50), "0" * draw.randint(1, 50), str(draw.randint(0, 10**20))])
                       for _ in range(draw.randint(1, 3)))
        figures.append(body.lstrip("0") + draw.choice(["", ".", ".0", ".95", ".9999999", ".05", ".15001"]))
    figures = [f for f in figures if f and f[0] != "."]
    steps = [draw.choice(["-0.2", "-0.1", "0.1", "0.2"]) for _ in figures]
    rows = spark.createDataFrame(list(zip(figures, steps)), "f string, s string")
    got = rows.select("f", "s", X._moved(F.col("f"), F.col("s").cast("decimal(2,1)")).alias("m")).collect()
    with localcontext() as context:
        context.prec = 300
        for r in got:
            moved = Decimal(r.f.rstrip(".")) + Decimal(r.s)
            want = moved.quantize(Decimal("0.1"), ROUND_HALF_UP)
            assert Decimal(r.m) == want, (r.f, r.s, r.m)


# ---------------------------------------------------------------- sparse vectors

def test_sparse_cosine_equals_the_dense_one(spark):
    docs = V.doc_pairs(spark, SF).unionByName(spark.createDataFrame(
        [(-1, "", "a"), (-2, None, "a"), (-3, "a a b", "a a b"), (-4, " ", "")], "sample_id long, orig string, pert string"))
    both = M.hashed_terms(M.hashed_terms(docs, "orig", "va", 512), "pert", "vb", 512)
    r = both.select("sample_id", "va", Y.cosine_sparse(F.col("va"), F.col("vb")).alias("s"),
                    Y.cosine(Y.to_dense(F.col("va")), Y.to_dense(F.col("vb"))).alias("d")).collect()
    assert all(x.s == x.d for x in r)
    found = {x.sample_id: x for x in r}
    assert found[-1].s == 0 and found[-2].s is None and found[-3].s == pytest.approx(1)
    for x in r:
        if x.va is not None:
            assert x.va["indices"] == sorted(set(x.va["indices"])) and len(x.va["indices"]) == len(x.va["values"])
    other = both.select(Y.cosine_sparse(F.col("va"), F.struct(F.lit(9).alias("size"), F.col("vb.indices"),
                                                              F.col("vb.values"))).alias("s"))
    assert other.where("s IS NOT NULL").count() == 0


# ---------------------------------------------------------------- shared storage

def test_two_builders_at_once_give_one_whole_result(spark, tmp_path):
    gate, built, out = threading.Barrier(2), [], []

    def build():
        gate.wait(60)       # both have seen that nothing is stored
        built.append(1)
        return spark.range(1000).repartition(4)

    def run():
        out.append(IO.materialize(spark, build, str(tmp_path), "x", {"a": 1}).count())

    writers = [threading.Thread(target=run) for _ in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert out == [1000, 1000] and len(built) == 2
    (folder,) = [p for p in (tmp_path / "x").iterdir()]
    assert folder.name.startswith("params=")


def test_changed_rows_are_built_again(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, t string")
    same = spark.createDataFrame([(2, None), (1, "x"), (1, "x")], "i int, t string").repartition(3)
    others = [a.distinct(), a.withColumnRenamed("t", "u"), a.fillna("y"), a.limit(0)]
    assert IO.content_key(a) == IO.content_key(same)
    assert len({IO.content_key(x) for x in [a, *others]}) == 5
    for rows in (a, same, others[0]):
        got = IO.materialize(spark, lambda: rows, str(tmp_path), "x", {"version": 1}, rows)
        assert got.count() == rows.count()
    assert len(list((tmp_path / "x").iterdir())) == 2


def test_headlines_and_predictions_in_both_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "positive", 'a "b"\nc'), (2, "negative", " x ")],
                                 "sample_id int, sentiment string, text string")
    csv = IO.write_headlines_csv(rows, str(tmp_path / "csv"))
    path = IO.import_headlines(spark, csv, str(tmp_path / "parquet"), 3)
    want = sorted(tuple(r) for r in rows.select("sentiment", "text").collect())
    assert sorted(map(tuple, IO.read_headlines(spark, path).collect())) == want
    assert sorted(map(tuple, IO.read_headlines(spark, csv, "csv").collect())) == want
    predictions = rows.select("sample_id", F.lit("neutral").alias("y_pred"))
    for fmt in ("parquet", "csv"):
        path = IO.write_predictions(rows, predictions, str(tmp_path / f"p{fmt}"), fmt=fmt)
        assert IO.read_predictions(spark, path, fmt).count() == 2


# --------------------------------------------------------------- samples, batches

@pytest.mark.parametrize("k", [0, 1, 100, 2999, 3000, 100_000])
def test_sample_batch_is_the_head_of_the_seeded_order(spark, k):
    from steadytext.functions.hashing import digest
    rows = spark.range(3000).withColumnRenamed("id", "sample_id").withColumn("rank", F.lit("own"))
    batch = P.sample_batch(rows, k, step=2)
    plan = executed(batch)
    assert "TakeOrderedAndProject" not in plan and "SinglePartition" not in plan and "GlobalLimit" not in plan
    order = [r[0] for r in rows.orderBy(digest(0, F.lit(2), "sample_id")).collect()]
    got = [r.sample_id for r in batch.collect()]
    assert sorted(got) == sorted(order[:k]) and batch.columns == rows.columns


def test_ordered_batches_of_clustered_and_repeated_ids(spark):
    draw = random.Random(4)
    ids = [draw.choice([7, 7, 10**15 + i, i]) for i in range(2000)] + [None, None]
    rows = spark.createDataFrame(list(zip(ids, range(2002))), "sample_id long, n int").repartition(5)
    out = P.assign_ordered_batch(rows, 30, kept, range_rows=128).collect()
    sizes = np.bincount([r.batch_id for r in out])
    assert len(out) == 2002 and set(sizes[:-1]) == {30} and sizes[-1] == 2002 % 30
    held = sorted(out, key=lambda r: r.batch_id)
    low = [min((-1 if r.sample_id is None else r.sample_id) for r in held if r.batch_id == b) for b in range(len(sizes))]
    high = [max((-1 if r.sample_id is None else r.sample_id) for r in held if r.batch_id == b) for b in range(len(sizes))]
    assert all(a <= b for a, b in zip(high, low[1:]))
    assert P.assign_ordered_batch(rows.limit(0), 30, kept).count() == 0


# --------------------------------------------------------- callers' models, rewards

def test_guard_scores_once_and_survives_failures(spark):
    rows = spark.createDataFrame([(1, "sales rose"), (1, "sales rose"), (2, "it was unchanged"), (3, "rose"), (4, None),
                                  (5, "same"), (6, "fell"), (7, "calm")], "sample_id int, text string")
    new = F.when(F.col("sample_id") == 1, "sales beat").when(F.col("sample_id") == 2, "it moved") \
        .when(F.col("sample_id") == 3, "fell").when(F.col("sample_id") == 6, F.lit(None).cast("string")) \
        .when(F.col("sample_id") == 7, "unchanged").otherwise(F.col("text"))
    scored = []

    def store(df):
        scored.append(df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython"))
        return kept(df)

    found = M.guard_by_model(rows, new, counting_model(), store, batch_size=4)
    assert scored == [0, 1] and "ArrowEvalPython" not in executed(found)
    assert sorted(((r.sample_id, r.pert) for r in found.collect()), key=str) == sorted(
        [(1, "sales beat")] * 2 + [(2, "it was unchanged"), (3, "rose"), (4, None), (5, "same"), (6, "fell"),
                                   (7, "calm")], key=str)


def test_forgiving_model_loses_only_the_texts_it_fails_on():
    predict = M.forgiving(counting_model(), 3)()
    got = predict(np.array(["rose", "unchanged", "fell"], dtype=object))
    assert np.isnan(got[1]).all() and np.isfinite(got[[0, 2]]).all()
    assert np.allclose(got[[0, 2]], word_model()()(["rose", "fell"]))


def test_reward_functions_are_checked(spark):
    one = R.RewardFunction("one", ("p_student",), native=F.array_max)
    with pytest.raises(ValueError):
        R.RewardFunction("x", ("a",))
    with pytest.raises(ValueError):
        R.RewardFunction("x", ("a",), native=F.array_max, zscore="other")
    rows = V.prob_pairs(spark, SF)
    with pytest.raises(ValueError):
        R.reward_total(rows, extra=[one, one])
    slow = R.RewardFunction("slow", ("label",), batch=lambda: (lambda x: [1.0] * len(x)))
    with pytest.raises(ValueError):
        R.reward_total(rows.withColumn("label", F.lit(1)), extra=[slow])
    plain, more = R.reward_total(rows), R.reward_total(rows, extra=[one])
    assert more.columns == [*plain.columns[:-1], "r_one", "reward"]


def test_fit_keeps_the_setting_with_the_least_loss(spark):
    draw = random.Random(2)
    words = {"positive": ["up", "gain"], "negative": ["down", "loss"], "neutral": ["flat", "calm"]}

    def rows(n, noise):
        out = []
        for i in range(n):
            label = draw.choice(list(words))
            seen = draw.choice(list(words)) if draw.random() < noise else label
            out.append((i, label, " ".join(draw.choices(words[seen] + ["firm", "year"], k=4))))
        return spark.createDataFrame(out, "sample_id int, sentiment string, text string")

    train, held = rows(150, 0.4), rows(100, 0.4)
    fit = M.train_classifier(train, held, features=256, regs=(1e-6, 0.03), iterations=(3, 15))
    assert len(fit.tried) == 4 and fit.eval_loss == min(x for _, _, x in fit.tried)
    assert (fit.reg, fit.max_iter, fit.eval_loss) in fit.tried
    scored = M.classify(fit, held).collect()
    at = {name: i for i, name in enumerate(K.REWARD_ORDER)}
    plain = np.mean([-np.log(max(r.probs[at[r.sentiment]], K.PROB_FLOOR)) for r in scored])
    assert plain == pytest.approx(fit.eval_loss, abs=1e-9)
    alone = M.train_classifier(train, held.limit(0), features=256, regs=(1e-6, 0.03), iterations=(3,))
    assert alone.eval_loss is None and len(alone.tried) == 1


# ------------------------------------------------------------------- digests as keys

TEXT = re.compile(r"hashpartitioning\(([^)]*)\)")


def test_no_exchange_hashes_a_text(spark):
    rows, pairs = V.headlines(spark, SF), V.rewrites(spark, SF).withColumnRenamed("rewrite", "pert")
    scored = V.text_scores(rows)
    library = L.build_library(rows, rewrites=V.rewrites(spark, SF), scored=scored)
    frames = [library, L.adversarial_tags(L.build_library(rows), scored), L.augment_train(rows, library),
              J.join_pairs(rows, pairs), J.lookup_label(pairs, rows), J.keep_known(pairs, rows),
              J.external_rewrite(rows, V.rewrites(spark, SF)), L.passed_pairs(library)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in frames:
            # "text" makes the tables put in here distinct; the grouping expression is a digest
            keys = {k for part in TEXT.findall(df._jdf.queryExecution().executedPlan().toString())
                    for k in re.findall(r"([a-z_]+)#", part)}
            assert keys <= {"_text_key", "_row_key", "sample_id", "text", "_groupingexpression"}, keys
            assert "orig" not in keys and "pert" not in keys
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_new_queries_are_registered():
    assert {"synonym_replace_guarded_table", "guard_by_model", "reward_total_extra", "cosine_sparse", "minibatch_ordered",
            "sample_batch_large", "jitter_percent_carry", "train_classifier_rows", "src_headlines"} <= set(QUERIES)


# ------------------------------------------------------- words of a lexicon

def _plain_guarded(key, text, table, names, most):
    """Words of the table replaced one after another, as the operator's text says."""
    import hashlib
    from steadytext.functions.text import _OTHER_SPACES
    spans = plain_spans(text, names)
    at, start, words, hits = 0, 0, [], []
    for part in text.translate({ord(c): " " for c in _OTHER_SPACES}).split(" "):
        if part:
            if part.lower() in table and not any(a < start + len(part) and start < b for a, b in spans):
                hits.append((hashlib.md5(f"0:{key}:{at}".encode()).hexdigest(), at))
            words.append(part)
            at += 1
        start += len(part) + 1
    for _, at in sorted(hits)[:most]:
        words[at] = table[words[at].lower()]
    return " ".join(words) if words else text


def test_guarded_words_of_odd_texts_against_plain_search(spark):
    table = {"rose": "climbed", "fell": "dropped", "é\u0001": "e"}
    names = ["a rose", "日本 fell", "  "]
    draw = random.Random(3)
    bits = ["rose", "Rose", "FELL", "fell", "a", "日本", "é\u0001", "\u0001", "", "", "x\u0001y", "𝔘", "\t", "　", "fell rose"]
    texts = [" ".join(draw.choice(bits) for _ in range(draw.randrange(40))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)) * 2, "sample_id int, text string")
    rows_of = spark.createDataFrame([(w, w, 0, 0, s) for w, s in table.items()] + [(None, None, 0, 0, "x")],
                                    "surface string, lemma string, sense int, ord int, synonym string")
    out = lexicon.replace_forms_guarded_from(rows, rows_of, spark.createDataFrame([(n,) for n in names], "name string"),
                                             max_repl=3, figures=False).collect()
    assert len(out) == 120
    assert all(r.pert == _plain_guarded(r.sample_id, r.text, table, names, 3) for r in out)




@pytest.mark.parametrize("guarded", [False, True])
def test_only_words_found_leave_their_rows(spark, guarded, tmp_path):
    rows = spark.range(300).select(F.col("id").cast("int").alias("sample_id"), F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: F.md5(i.cast("string"))), " "),
        F.lit(" rose "), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "rows")
    rows.repartition(2).write.parquet(path)
    rows = spark.read.parquet(path)
    table = spark.createDataFrame([("rose", "rise", 0, 0, "climbed")],
                                  "surface string, lemma string, sense int, ord int, synonym string")
    if guarded:
        out = lexicon.replace_forms_guarded_from(rows, table, spark.createDataFrame([("zz",)], "name string"))
    else:
        out = lexicon.replace_from_lexicon(rows, table, F.lit(1), [])
    assert out.filter("pert LIKE '% climbed %'").count() == 300
    seen = out.groupBy().agg(F.sum(F.length("pert")))
    seen.collect()
    plan = seen._jdf.queryExecution().executedPlan()
    records = []

    def walk(node):
        found = node.metrics().get("shuffleRecordsWritten")
        if found.isDefined():
            records.append(found.get().value())
        name = node.getClass().getSimpleName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") \
            else [node.children().apply(i) for i in range(node.children().size())]
        for child in below:
            walk(child)

    walk(plan)
    assert records and max(records) <= 10 * 300     # 2,003 words a text stay in the row


def test_sparse_cosine_of_large_indices_and_unequal_values(spark):
    entry = "struct<size:int,indices:array<int>,values:array<float>>"
    top = 2**31 - 1
    rows = [((top, [0, 5, top - 1], [1.0, 2.0, 3.0]), (top, [5, top - 2, top - 1], [4.0, 9.0, 0.5])),
            ((9, [1], [1.0]), (9, [2], [1.0])), ((9, [], []), (9, [2], [1.0]))]
    got = spark.createDataFrame(rows, f"a {entry}, b {entry}").select(
        Y.cosine_sparse(F.col("a"), F.col("b"))).collect()
    first = (8 + 1.5) / (14 ** 0.5 * (16 + 81 + 0.25) ** 0.5)
    assert [round(r[0], 9) for r in got] == [round(first, 9), 0.0, 0.0]


def test_numbers_candidate_equals_the_edit_of_the_row(spark):
    rows = spark.createDataFrame([(1, "Apple was up 3.5% in 2020"), (2, "BP fell by 9.9 % and 1%"), (3, ""), (4, None)],
                                 "sample_id long, text string")
    made = L.build_library(rows, L.LibraryConfig(methods=("numbers",))).select("sample_id", "orig", "pert", "passed")
    plain = rows.select("sample_id", X.perturb_numbers_entities(F.col("text"), F.col("sample_id")))
    assert sorted(map(tuple, plain.collect())) == sorted((r.sample_id, r.pert) for r in made.collect())
    assert made.columns == ["sample_id", "orig", "pert", "passed"]


# ------------------------------------------------- row work that Spark compiles

def test_source_facts_are_made_after_the_joins_and_without_lambda_functions(spark):
    rows = V.headlines(spark, SF)
    library = L.build_library(rows, rewrites=V.rewrites(spark, SF))
    plan = library._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tokens_at = max(i for i, line in enumerate(plan) if "struct(_src_tokens" in line)
    assert tokens_at < min(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    # a step with a lambda function is interpreted as a whole: types, peers and tokens stand apart
    for name in ("_src_tokens", "_peer", "method_ord", "_tgt_tokens"):
        step = [line for line in plan if f"inline(array(struct({name}," in line]
        assert step and all("lambdafunction" not in line for line in step), name


def test_rules_are_applied_once_for_labels_and_rows(spark):
    plan = executed(QUERIES["guard_polarity"](spark, SF))
    assert "beat expectations" not in plan and "parquet" in plan


def test_a_rule_without_its_words_runs_no_regex_and_others_run(spark):
    assert X._needles(r"\bprofits? (fell|declined)\b") == ["profit"]
    assert X._needles(r"\b(fell|slid)\b") == ["fell", "slid"]
    assert X._needles(r"\bx+\b") == X._needles(r"up|down") == X._needles(r"\ba?\b") == []
    texts = ["Profits FELL", "profit declined", "ro\u017fe", "ROSE", "prose", "met  expectations", "was up", "up x", "",
             None, "wea\u212a demand", "plunged", "İncreased ıncreased"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rules = [*K.PARAPHRASE_RULES, (r"up|down", "level")]
    plain = F.col("t")
    for pattern, new in rules:
        plain = F.regexp_replace(plain, "(?iU)" + pattern, new.replace("{adv}", "slightly").replace("\\1", "$1"))
    got = rows.select("i", X.paraphrase_rules(F.col("t"), rules).alias("a"), plain.alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert got[0].a == "profit FELL slightly" and got[6].a == "rose"


def test_one_figure_and_several_move_alike(spark):
    figures = ["0.1", "0.05", "007.5", "12.", "12", "99.9", "123456789012345.6", "9" * 40 + ".95", "0", "\u0663"]
    texts = [f"{f}% and" for f in figures] + [f"at {f} %" for f in figures]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    # another figure behind leaves the first one's draw as it is, and takes the way for several
    alone, two = X.jitter_percents(F.col("t"), F.lit(7)), X.jitter_percents(F.concat("t", F.lit(" 3%")), F.lit(7))
    got = rows.select("i", alone.alias("a"), two.alias("b")).orderBy("i").collect()
    assert all(r.b.startswith(r.a + " 3.") or r.b.startswith(r.a + " 2.") for r in got)
    steps = rows.select(X._moved_tenths(F.lit("99.9"), F.lit("0.1").cast("decimal(2,1)")),
                        X._moved_tenths(F.lit("0.1"), F.lit("-0.2").cast("decimal(2,1)")),
                        X._moved_tenths(F.lit("0.05"), F.lit("0.1").cast("decimal(2,1)"))).first()
    assert tuple(steps) == ("100.0", "-0.1", None)


def test_a_text_without_a_peer_stays_outside_lambda_functions_too(spark):
    rows = spark.createDataFrame([(1, "Nokia rose 5%"), (2, "BP rose 5%"), (3, None)], "sample_id int, text string")
    for whole in (False, True):
        index = X.peer_index(F.col("text"), whole_word=whole)
        got = rows.select("sample_id", "text", F.inline(F.array(F.struct(index.alias("at"))))).select(
            "sample_id", X.swap_peer_at(F.col("text"), F.col("at"), whole_word=whole).alias("pert")).orderBy("sample_id")
        assert [r.pert for r in got.collect()] == ["Nokia rose 5%", "Shell rose 5%", None]
    made = L.candidates(rows, L.LibraryConfig(methods=("numbers",))).orderBy("sample_id").collect()
    assert made[0].pert.startswith("Nokia rose ") and made[1].pert.startswith("Shell rose ") and made[2].pert is None


def test_row_work_behind_the_join_with_rewrites_is_dealt_evenly(spark, tmp_path):
    words = [(i if i % 3 else None, "demand rose 3.5%" if i % 2 else f"profits of BP fell by {i}%") for i in range(6000)]
    # one file, cut nowhere
    spark.createDataFrame(words, "sample_id long, text string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    rewrites = rows.filter("text like 'profits%'").select(
        F.col("text").alias("orig"), F.replace("text", F.lit("profits"), F.lit("earnings")).alias("rewrite"))
    cores = spark.sparkContext.defaultParallelism
    for made in (L.build_library(rows, rewrites=rewrites), L.candidates(rows, rewrites=rewrites)):
        parts = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 3 * len(words)
        assert len(parts) >= 4 * cores and max(parts) <= 2 * min(parts)
    changed = L.candidates(rows, rewrites=rewrites).filter("method = 'rewrite' and pert <> orig")
    assert changed.filter("pert like 'earnings of BP%'").count() == changed.count() == 3000
