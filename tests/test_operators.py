"""Invariants of sampling, joins, library and storage, also on skewed data."""

import hashlib

import pytest
from pyspark.sql import functions as F

from steadytext import dictionaries as D
from steadytext.operators import joins as J, library as L, rewards as R, sampling as S, \
    verbalizer as B
from steadytext.operators.frames import with_group_stats
from steadytext.sources import files as IO

LABELS = ("negative", "neutral", "positive")


def labelled(spark, n=3000, hot=False):
    """With ``hot``, one text makes up a third of all rows."""
    text = F.concat(F.lit("Apple rose "), F.col("id") % 97, F.lit("% on strong demand in "), F.col("id"))
    if hot:
        text = F.when(F.col("id") % 3 == 0, F.lit("Barclays fell 5 % on weak demand")).otherwise(text)
    names = F.array(*[F.lit(x) for x in LABELS])
    # 'positive' holds two thirds of the rows
    label = F.get(names, F.when(F.col("id") % 3 == 0, F.col("id") % 2).otherwise(2).cast("int"))
    return spark.range(n).select(F.col("id").alias("sample_id"), label.alias("sentiment"),
                                 text.alias("text"))


def python_ranks(rows, seed):
    out = {}
    for r in rows:
        key = hashlib.md5(f"{seed}:{r.sample_id}".encode()).hexdigest()
        out.setdefault(r.sentiment, []).append((key, r.sample_id))
    return {k: [i for _, i in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("n_train, n_test", [(100, 100), (300, 150), (0, 10)])
def test_split_against_brute_force(spark, n_train, n_test):
    df = labelled(spark)
    order = python_ranks(df.collect(), 42)
    got = S.split_stratified(df, n_train, n_test).collect()
    for label in LABELS:
        test = {r.sample_id for r in got if r.sentiment == label and r.split == "test"}
        train = {r.sample_id for r in got if r.sentiment == label and r.split == "train"}
        assert test == set(order[label][:n_test])
        assert train == set(order[label][n_test:n_test + n_train])


@pytest.mark.parametrize("shuffles, parts", [(1, 1), (4, 3), (64, 7)])
def test_split_does_not_depend_on_the_layout(spark, shuffles, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
    try:
        rows = S.experiment_split(labelled(spark).repartition(parts), 100, 80, 20).select(
            "sample_id", "split", "draw").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    digest = hashlib.md5(repr(sorted(map(tuple, rows), key=repr)).encode()).hexdigest()
    seen = test_split_does_not_depend_on_the_layout.__dict__.setdefault("seen", digest)
    assert digest == seen and len(rows) == 3 * 200


def test_class_too_small_fails(spark):
    with pytest.raises(Exception, match="class too small for the split: ne"):
        S.split_stratified(labelled(spark, 300), 40, 40).collect()
    missing = labelled(spark).filter("sentiment <> 'neutral'")
    with pytest.raises(Exception, match="class too small for the split: neutral"):
        S.split_stratified(missing, 10, 10).collect()


def test_eval_draws_come_from_the_rest(spark):
    df = labelled(spark)
    split = S.experiment_split(df, 200, 200, 70)
    rows = split.collect()
    used = {r.sample_id for r in rows if r.split != "eval"}
    evals = [r for r in rows if r.split == "eval"]
    assert len(evals) == 3 * 70 and not used & {r.sample_id for r in evals}
    # 100 rows are left per small class, so 70 draws with replacement repeat some
    assert len({r.sample_id for r in evals if r.sentiment == "neutral"}) < 70
    rest = J.drop_used(df, split.filter("split <> 'eval'"))
    assert rest.count() + len(used) == df.count()


def test_last_label_wins(spark):
    rows = spark.createDataFrame([(1, "a", "negative"), (3, "a", "positive"), (2, "a", "neutral")],
                                 "sample_id long, text string, sentiment string")
    pairs = spark.createDataFrame([("a", "b"), ("z", "y")], "orig string, pert string")
    got = {r.orig: r.sentiment for r in J.lookup_label(pairs, rows).collect()}
    assert got == {"a": "positive", "z": None}


def test_every_equal_text_matches_its_pair(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "sample_id long, text string")
    pairs = spark.createDataFrame([("a", "x")], "orig string, pert string")
    assert sorted(r.sample_id for r in J.join_pairs(rows, pairs).collect()) == [1, 2]


def test_pick_one_takes_passed_only(spark):
    c = spark.createDataFrame([(1, "m1", "p1", False), (1, "m2", "p2", True), (2, "m1", "q", False),
                               (3, "m1", "r1", True), (3, "m2", "r2", True)],
                              "sample_id long, method string, pert string, passed boolean")
    got = {r.sample_id: r.pert for r in J.pick_one_pert(c).collect()}
    assert got[1] == "p2" and got[2] is None and got[3] in ("r1", "r2")


def test_batch_pairing_flags_empty_batches(spark):
    df = spark.createDataFrame([(0, "a"), (0, None), (1, None)], "batch_id long, pert string")
    got = {r.batch_id: (r.kept, r.skipped, r.empty) for r in S.batch_pairing(df).collect()}
    assert got == {0: (1, 1, False), 1: (0, 1, True)}
    assert S.drop_unpaired(df).count() == 1


@pytest.mark.parametrize("hot", [False, True])
def test_library_invariants(spark, hot):
    rows = labelled(spark, 900, hot)
    lib = L.build_library(rows).cache()
    assert lib.count() == 3 * rows.count()
    bad = lib.filter("passed AND (sim < 0.85 OR len_ok IS NOT NULL OR ner_ok IS NOT NULL)")
    assert bad.count() == 0
    # without supplied rewrites that method returns the text itself
    assert lib.filter("method = 'rewrite' AND (pert <> orig OR NOT passed)").count() == 0
    aug = L.augment_train(rows, lib)
    pairs = L.passed_pairs(lib)
    assert aug.count() == rows.count() + pairs.count()
    assert aug.filter("sentiment IS NULL").count() == 0
    aligned = L.clean_pert_pairs(rows, lib)
    assert aligned.count() == rows.count()
    assert aligned.select("sample_id").distinct().count() == rows.count()


def test_adversarial_tags_agree_on_both_paths(spark):
    rows = labelled(spark, 60)
    plain = L.build_library(rows)
    texts = plain.select(F.col("orig").alias("text")).union(plain.select("pert")).distinct()
    p = (F.pmod(F.xxhash64("text"), F.lit(1000)) / 1000).cast("double")
    scored = texts.select("text", F.array(p / 2, p / 2, 1 - p).alias("probs"))
    a = L.build_library(rows, scored=scored)
    b = L.adversarial_tags(plain, scored)
    assert a.columns == b.columns
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(a) == key(b)
    assert a.filter("passed AND orig_label IS NULL OR NOT passed AND m0 IS NOT NULL").count() == 0


def test_identity_candidates_can_be_dropped(spark):
    rows = spark.createDataFrame([(1, "negative", "plain words")],
                                 "sample_id long, sentiment string, text string")
    assert L.candidates(rows).count() == 3
    assert L.candidates(rows, L.LibraryConfig(drop_identity=True)).count() == 0


def test_group_stats_on_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
                                  F.col("id").alias("v"))
    got = with_group_stats(df, ["k"], n=F.count("*")).filter("k = 0").agg(
        F.count("*"), F.max("n")).first()
    assert got[0] == got[1] == 1000
    z = R.batch_zscore(df, "v", ["k"]).agg(F.sum("z")).first()[0]
    assert abs(z) < 1e-6


def test_verbalizer_build_against_brute_force(spark):
    words = {" up": [7], " down": [3, 9], " rally": [7], " soar": [9], " big gain": [],
             " slump": [5], "slump": [1, 2], "up": [7], " UP": [8]}
    seeds = [("p", 0, " up"), ("p", 1, " rally"), ("p", 2, " soar"), ("p", 3, " down"),
             ("n", 0, " down"), ("n", 1, " slump"), ("n", 2, " big gain")]
    s = spark.createDataFrame(seeds, "label string, ord long, word string")
    v = spark.createDataFrame(list(words.items()), "word string, token_ids array<int>")
    got = {(r.label, r.ord): r for r in B.build_verbalizer(s, v, auto_variant_search=False).collect()}
    assert got["p", 0].token_id == 7 and got["p", 1].reason == "dup_token"
    assert got["p", 2].token_id == 9 and got["p", 3].reason == "dup_last_token"
    assert got["n", 0].word == " down (last)" and got["n", 0].token_id == 9
    assert got["n", 2].reason == "multi_token_dropped" and got["n", 2].multi_token
    strict = B.build_verbalizer(s, v, prefer_single_token=False, auto_variant_search=False)
    assert {r.reason for r in strict.filter("label = 'n' AND ord <> 1").collect()} == {
        "multi_token_ignored"}
    ids = sorted(tuple(r) for r in B.sorted_ids(s, v, 99).collect())
    assert ids == [("n", 1, 5), ("n", 2, 9), ("p", 1, 7), ("p", 2, 9)]
    lone = spark.createDataFrame([("x", 0, "unknown")], s.schema)
    assert tuple(B.sorted_ids(lone, v, 99).first()) == ("x", 1, 99)
    assert tuple(B.sorted_ids(lone, v, " rally").first()) == ("x", 1, words[" rally"][-1])
    assert B.sorted_ids(lone, v).first().id is None       # the default word is not in this vocabulary
    assert {r.label: r["count"] for r in B.seed_table(spark).groupBy("label").count().collect()} == {
        "negative": 15, "neutral": 10, "positive": 15}
    chosen = {r.seed: r.word for r in B.choose_variants(
        spark.createDataFrame([("p", 0, "up "), ("p", 1, "a b")], s.schema), v).collect()}
    # "up" is the third spelling of "up "; nothing is known for "a b", so the last one stays
    assert chosen == {"up ": "up", "a b": " a-b"}


def test_csv_edge_cases(spark, tmp_path):
    raw = (b'positive,"said ""yes"", twice"\nnegative,"two\nlines"\nneutral,bad \xff byte\n'
           b"neutral,NA\nneutral,  blanks  \n")
    (tmp_path / "in.csv").write_bytes(raw)
    df = IO.read_headlines_csv(spark, str(tmp_path / "in.csv"))
    got = [tuple(r) for r in df.collect()]
    assert got == [("positive", 'said "yes", twice'), ("negative", "two\nlines"),
                   ("neutral", "bad � byte"), ("neutral", "NA"), ("neutral", "  blanks  ")]
    again = IO.read_headlines_csv(spark, IO.write_headlines_csv(df, str(tmp_path / "out")))
    assert sorted(map(tuple, again.collect())) == sorted(got)
    assert IO.with_sample_id(df, "text").select("sample_id").distinct().count() == 5


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_pairs_round_trip(spark, tmp_path, fmt):
    rows = [('a "b", c', "x\ny"), (" lead", "trail "), ("ünï", "\\ back")]
    df = spark.createDataFrame(rows, "orig string, pert string")
    path = IO.write_pairs(df, str(tmp_path / fmt), fmt)
    assert sorted(map(tuple, IO.read_pairs(spark, path, fmt).collect())) == sorted(rows)


def test_materialize_builds_once_per_parameters(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for params in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert IO.materialize(spark, build, str(tmp_path), "x", params).count() == 3
    assert len(calls) == 2
    # a write that did not finish is replaced
    (done,) = (p for p in (tmp_path / "x").rglob("_SUCCESS")
               if IO.hashlib.sha256(b'{"a": 1}').hexdigest()[:16] in str(p))
    done.unlink()
    IO.materialize(spark, build, str(tmp_path), "x", {"a": 1})
    assert len(calls) == 3


def test_row_operators_accept_a_stream(spark, tmp_path):
    labelled(spark, 30).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("sample_id long, sentiment string, text string").parquet(
        str(tmp_path / "in"))
    lib = L.build_library(rows, L.LibraryConfig(methods=("synonym", "template", "numbers")))
    q = lib.writeStream.format("memory").queryName("lib").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("lib").count() == 90


def test_synonym_dictionary_is_literal_sized():
    assert len(D.SURFACE_SYNONYMS) < 200


def test_draws_fail_for_an_exhausted_class_and_scale_with_n(spark):
    rows = spark.range(90).select(F.col("id").alias("sample_id"), F.element_at(F.array(*map(
        F.lit, LABELS)), (F.col("id") % 3 + 1).cast("int")).alias("sentiment"), F.lit("t").alias("text"))
    with pytest.raises(Exception, match="class too small"):
        S.sample_with_replacement(rows, 5, skip=30).collect()
    many = S.sample_with_replacement(rows, 20_000, skip=10)
    got = many.groupBy("sentiment").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("d"),
                                        F.countDistinct("draw").alias("k")).collect()
    assert [(r.n, r.d, r.k) for r in got] == [(20_000, 20, 20_000)] * 3


def test_exact_batches_of_sparse_ids(spark):
    rows = spark.range(70).select((F.col("id") * 1000 + F.col("id") % 7).alias("sample_id"))
    sizes = sorted(r["count"] for r in S.assign_exact_batch(rows, 32).groupBy("batch_id").count().collect())
    assert sizes == [6, 32, 32]


def test_ids_of_equal_rows_differ(spark):
    rows = spark.createDataFrame([("a", "x")] * 3 + [("b", None), (None, "b")], "text string, sentiment string")
    got = IO.with_sample_id(rows)
    assert got.count() == 5 and got.select("sample_id").distinct().count() == 5


def test_stored_library_knows_its_rewrites(spark, tmp_path):
    from steadytext.plans import experiment as E
    with pytest.raises(ValueError, match="rewrites"):
        E.stored_library(None, E.Experiment(str(tmp_path), "s"), "test", rewrites=object())


def test_scratch_needs_a_shared_folder(spark, tmp_path):
    from types import SimpleNamespace
    from steadytext.sources.scratch import scratch_root
    conf = {"spark.sql.warehouse.dir": f"file:{tmp_path}"}
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: None), master="yarn",
                              getCheckpointDir=lambda: None)
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)
    with pytest.raises(ValueError, match="shared"):
        scratch_root(session)
    context.master = "local[2]"
    assert scratch_root(session) == f"file:{tmp_path}/_scratch"
    context.getCheckpointDir = lambda: "hdfs://x/c/"
    assert scratch_root(session) == "hdfs://x/c"
