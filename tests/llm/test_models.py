import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadytext.llm import language, lm, neighbours, quality, queries, toxicity
from steadytext.llm.sampling import fold, sampled_by_class
from tests.llm.helpers import SF, empty_docs, odd_docs, sentences

LABELS = "doc_id long, quality int, toxic int"


def held_out_share(rows, truth, column):
    seen = [(r[column], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(a == b for a, b in seen) / len(seen)


def test_folds_and_bounded_sample(spark):
    import zlib
    rows = spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("y", F.col("doc_id") % 4 == 0)
    for r in rows.limit(50).select("doc_id", fold().alias("f")).collect():
        assert r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5
    got = {r["y"]: r["count"] for r in sampled_by_class(rows, "y", "doc_id", 100)
           .groupBy("y").count().collect()}
    assert all(60 < n < 140 for n in got.values()) and len(got) == 2


def test_language_on_held_out_rows(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_language(spark, SF).collect()
    assert len(rows) == len(truth)
    assert held_out_share(rows, truth, "lang_pred") >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    train = spark.createDataFrame(
        [(i, t, "up" if i % 2 else "down") for i, t in enumerate(
            ["uvwxyz yxuv wvux"] * 1 + [" ".join(random.Random(i).choices(
                ["uvwx", "xyuv", "wuvy"] if i % 2 else ["abcd", "dcab", "badc"], k=30))
                for i in range(1, 60)])], "doc_id long, text string, lang string")
    model = language.fit_language(train)
    found = language.predict(docs.withColumn("lang_pred", F.lit("old")), model)
    rows = found.collect()
    assert len(rows) == 10 and set(docs.columns) <= set(found.columns)
    for r in rows:
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letter)
        assert r["score"] == "kept"
    none = language.fit_language(empty_docs(spark))
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(empty_docs(spark), model).count() == 0


def test_rejection_is_calibrated():
    draw = np.random.default_rng(0)

    def rows(n):
        for _ in range(n):
            y = int(draw.integers(2))
            place = np.unique(draw.integers(0, 40, 6) + 4 * y).astype(np.int32)
            yield str(y), pickle.dumps((place, np.ones(len(place), np.float32)))

    model = language.train(list(rows(2400)), reject_share=0.02)
    assert 0 < model["threshold"] <= 0.5
    z = [(int(y), pickle.loads(f)) for y, f in rows(2000)]
    z = [(y, (v / v.sum() @ model["table"][i] + model["bias"]) * model["scale"]) for y, (i, v) in z]
    p = np.array([np.exp(s[y]) / np.exp(s).sum() for y, s in z])
    assert (p < model["threshold"]).mean() <= 0.04
    assert abs(p.mean() - np.mean([s.argmax() == y for y, s in z])) < 0.1


def test_default_rejection_of_an_unlearned_language():
    draw = np.random.default_rng(3)

    def row(y):        # languages share some subwords; those of an unlearned one are new
        own = draw.integers(0, 30, 8) + 100 + 30 * y if y is not None else draw.integers(500, 900, 8)
        place = np.unique(np.r_[draw.integers(0, 10, 4), own]).astype(np.int32)
        return pickle.dumps((place, np.ones(len(place), np.float32)))

    model = language.train([(str(y), row(y)) for y in range(4) for _ in range(600)])

    def rejected(texts):
        z = np.array([(v / v.sum() @ model["table"][i] + model["bias"]) * model["scale"]
                      for i, v in map(pickle.loads, texts)])
        p = np.exp(z - z.max(1, keepdims=True))
        return ((p / p.sum(1, keepdims=True)).max(1) < model["threshold"]).mean()

    assert model["threshold"] > 0
    assert rejected([row(y) for y in range(4) for _ in range(500)]) <= 0.01
    assert rejected([row(None) for _ in range(500)]) >= 0.3


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op3_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert held_out_share(rows, truth, "predicted") >= 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    docs = odd_docs(spark)
    model = quality.fit_quality(docs, spark.createDataFrame([(2, 1, 0), (4, 0, 0), (5, None, 0)], LABELS))
    scored = quality.score(docs.drop("score"), model).collect()
    assert len(scored) == 10 and len({r["score"] for r in scored if r["doc_id"] in (1, 2, 3)}) == 1
    empty = quality.fit_quality(empty_docs(spark), spark.createDataFrame([], LABELS))
    assert {round(r["score"], 6) for r in quality.score(docs, empty).collect()} == {0.5}


def test_quality_mean_is_the_share_of_ones_whatever_the_sample(spark):
    good, bad = sentences(5, 900), sentences(6, 100, lexicon="alpha beta junk trash".split())
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(1000)], LABELS)
    for per_label in (2000, 60):
        scored = quality.score(docs, quality.fit_quality(docs, labels, per_label=per_label))
        assert scored.agg(F.avg("score")).first()[0] == pytest.approx(0.9, abs=0.03)


def test_ordinal_fit_orders_grades_and_shares_weights():
    draw = np.random.default_rng(1)
    data = []
    for grade in draw.integers(0, 3, 600):
        n = int(draw.poisson(1 + 4 * grade))
        data.append((int(grade), np.array([0, 1]), np.array([n, int(draw.poisson(2))])))
    model = toxicity.fit_ordinal(data, 2)
    assert model["weight"][0] > 0.5 > abs(model["weight"][1])
    assert np.all(np.diff(model["thresholds"]) > 0) and len(model["thresholds"]) == 2
    assert toxicity.fit_ordinal([], 3)["cut"] == 0.5


def test_toxicity_finds_marked_texts_and_leaves_others(spark):
    clean, marked = sentences(1, 300), sentences(2, 60)
    rows = [(i, t) for i, t in enumerate(clean)] + [
        (1000 + i, t.replace(" ", " dreadful ", 1 + i % 5)) for i, t in enumerate(marked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in rows if i % 3], LABELS)
    model = toxicity.fit_toxicity(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.severity(docs, model).collect()}
    assert all(r["rejected"] == (i >= 1000) for i, r in found.items())
    assert found[1004]["severity"] > found[1000]["severity"] > found[0]["severity"]
    odd = toxicity.severity(odd_docs(spark), model).collect()
    assert len(odd) == 10 and not any(r["rejected"] for r in odd)
    none = toxicity.fit_toxicity(empty_docs(spark), spark.createDataFrame([], LABELS))
    assert not any(r["rejected"] for r in toxicity.severity(odd_docs(spark), none).collect())


def test_toxicity_with_more_labels_than_the_sample_takes(spark):
    draw = random.Random(7)
    clean = [t + draw.choice(["", "", "", " dreadful", " hateful"]) for t in sentences(3, 6500, 12)]
    marked = [t + " dreadful hateful" for t in sentences(4, 6500, 12)]
    docs = spark.createDataFrame(list(enumerate(clean + marked)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 6500)) for i in range(13000)], LABELS)
    model = toxicity.fit_toxicity(docs, labels)
    assert len(model["features"])
    found = toxicity.severity(docs, model).groupBy(F.col("doc_id") >= 6500).agg(
        F.avg(F.col("rejected").cast("int"))).collect()
    caught = dict(tuple(r) for r in found)
    assert caught[True] >= 0.99 and caught[False] <= 0.01


def test_pseudo_likelihood_learns_both_sides(spark):
    draw = random.Random(5)
    words = "ab cd ef gh ij kl mn op".split()

    def chain(n):      # every word is followed by one of two
        out, at = [], draw.randrange(8)
        for _ in range(n):
            out.append(words[at])
            at = (at + draw.choice((1, 2))) % 8
        return out

    docs = [(i, " ".join(chain(300))) for i in range(300)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = lm.fit(docs, warm_docs=100)
    own = lm.score(docs, model).agg(F.avg("mean_log_likelihood")).first()[0]
    mixed = docs.select("doc_id", F.array_join(F.array_sort(F.split("text", " ")), " ").alias("text"))
    assert own > np.log(1 / 8) + 0.5          # beats the frequencies of eight equal words
    assert own > lm.score(mixed, model).agg(F.avg("mean_log_likelihood")).first()[0]
    rows = {r["doc_id"]: r for r in lm.score(odd_docs(spark), model).collect()}
    assert rows[1]["n_words"] == 0 and rows[1]["mean_log_likelihood"] is None
    assert rows[8]["n_words"] == 20000 and rows[6]["log_likelihood"] < 0
    assert lm.score(empty_docs(spark), lm.fit(empty_docs(spark))).count() == 0


def test_network_probabilities_sum_to_one():
    net = lm.Network()
    context = np.full((lm.WORDS, 4), 3)
    assert np.exp(net.log_p(context, np.arange(lm.WORDS)).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_window_does_not_cross_texts():
    got = lm.windows(np.array([5, 6, 7, 8]), np.array([0, 0, 1, 1]))
    e = lm.EDGE
    assert got.tolist() == [[e, e, 6, e], [e, 5, e, e], [e, e, 8, e], [e, 7, e, e]]


def brute(ids, x, every, k):
    n = np.sqrt((x * x).sum(1))
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q] / (n * n[q])
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        yield int(ids[q]), [int(ids[i]) for i in order], [score[i] for i in order]


def test_neighbours_exact_and_relaxed(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    local = rows.orderBy("vec_id").toPandas()
    ids, x = local["vec_id"].to_numpy(), np.array(local["embedding"].tolist(), float)
    for factor, least in ((1.0, 1.0), (neighbours.FACTOR, 0.9)):
        got = {}
        for r in neighbours.nearest(rows, lambda i: i % 50 == 0, factor=factor, shard_rows=100).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        hits = 0
        for q, want, scores in brute(ids, x, 50, 5):
            assert sorted(got[q]) == [1, 2, 3, 4, 5]
            hits += len({v for v, _ in got[q].values()} & set(want)) / 5
            if factor == 1:
                assert [got[q][i + 1][0] for i in range(5)] == want
                assert np.allclose([got[q][i + 1][1] for i in range(5)], scores, atol=1e-12)
        assert hits / len(got) >= least


def test_neighbours_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0]),
            (11, None), (12, [0.0, 0.0]), (13, [nan, 1.0]), (14, [inf, 1.0]), (15, [None, 1.0]),
            (None, [1.0, 0.0]), (16, [1.0, 0.0, 0.0]), (17, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    found = neighbours.nearest(table, lambda i: i % 50 == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(3, 1.0), (7, 1.0), (9, 0.0)]
    assert neighbours.nearest(table.limit(0), lambda i: i % 50 == 0).count() == 0


def test_neighbours_hold_shards_together_and_broadcast_nothing(spark, monkeypatch):
    """Blocks are repeated for groups of shards: no join may collect the repeats in the driver."""
    draw = np.random.default_rng(5)
    ids, x = np.arange(900), draw.normal(size=(900, 6))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)],
                               "vec_id long, embedding array<double>")
    other = spark.createDataFrame([(5000 + i, [1.0, float(i)]) for i in range(40)], df.schema)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 8)
    monkeypatch.setattr(neighbours, "HELD_BYTES", 1 << 14, raising=False)     # ten groups would do, cores ask for more
    found = neighbours.nearest(df.unionByName(other), lambda i: i % 20 == 0, factor=1.0, shard_rows=10)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    for every, mine, vectors in ((20, ids, x), (20, 5000 + np.arange(40), np.c_[np.ones(40), np.arange(40)])):
        for q, want, scores in brute(mine, vectors, every, 5):
            got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
            assert [i for _, i, _ in got] == want
            assert np.allclose([s for *_, s in got], scores, atol=1e-12)
    assert len(rows) == (45 + 2) * 5


def test_trees_travel_unchanged():
    import pickle
    draw = np.random.default_rng(2)
    for vectors in (draw.normal(size=(200, 4)).astype(np.float32), draw.normal(size=(200, 4)),
                    np.full((3, 2), 1e-300), np.full((3, 2), 1e300)):
        tree = neighbours.Tree(np.arange(len(vectors)), vectors)
        again = pickle.loads(pickle.dumps(tree))
        assert again.vectors.dtype == again.unit.dtype == np.float64
        assert (again.vectors == tree.vectors).all() and (again.unit == tree.unit).all()


def test_neighbours_of_extreme_norms(spark):
    """Factor one is exact for finite vectors of any size; scores are those of exact arithmetic."""
    from fractions import Fraction
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(300, 8)) * 10.0 ** draw.choice([-200, -30, 0, 30, 200], size=(300, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(300, [5e-324] * 8), (301, [1e308] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, lambda i: i % 50 == 0, factor=1.0, shard_rows=100).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = {i: [Fraction(x) for x in v] for i, v in rows}

    def square(a, b):      # the cosine's square with its sign
        dot = sum(x * y for x, y in zip(a, b))
        return dot * abs(dot) / (sum(x * x for x in a) * sum(x * x for x in b))

    for q in range(0, 302, 50):
        order = sorted((i for i in exact if i != q), key=lambda i: (-square(exact[q], exact[i]), i))
        assert [i for _, i, _ in sorted(found[q])] == order[:5]
        for _, i, score in found[q]:
            s = float(square(exact[q], exact[i]))
            assert score == pytest.approx(np.sign(s) * abs(s) ** 0.5, abs=1e-12)
