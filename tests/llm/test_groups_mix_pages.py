import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from steadytext.llm import mixing, queries, simhash, wrappers
from steadytext.llm.components import components
from steadytext.llm.storage import stored
from tests.llm.helpers import SF, empty_docs, odd_docs, sentences


def slow_fingerprint(text, size=3):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    prints = [slow_fingerprint(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i)
             if bin(prints[i] ^ prints[j]).count("1") <= 2]
    groups = union(len(docs), links)
    rows = {r["doc_id"]: r for r in queries.op7_simhash(spark, SF).collect()}
    for k, (i, _) in enumerate(docs):
        assert rows[i]["fingerprint"] == f"{prints[k]:016x}"
        assert rows[i]["component_id"] == docs[groups[k]][0]


@pytest.mark.parametrize("reach,segments", [(1, 8), (2, 8), (2, 16), (3, 4)])
def test_close_pairs_against_all_pairs(spark, reach, segments):
    draw = np.random.default_rng(reach)
    base = draw.integers(-2**63, 2**63, 40)
    flips = [int(b) ^ int(sum(1 << int(k) for k in draw.choice(63, draw.integers(1, 5), replace=False)))
             for b in base for _ in range(4)]
    values = sorted({int(b) for b in base} | set(flips))
    got = [(r["a"], r["b"]) for r in simhash.close_pairs(
        spark.createDataFrame([(v,) for v in values], "simhash long"), reach=reach,
        segments=segments).collect()]
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1:]
            if bin((a ^ b) & (2**64 - 1)).count("1") <= reach}
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


def test_asked_cells_are_never_broadcast(spark):
    """Spark sizes them without their 73 repeats, so that a table far too large went to the driver."""
    values = spark.createDataFrame([(i * 7919,) for i in range(50)], "simhash long")
    for part in (None, "part"):
        pairs = simhash.close_pairs(values.withColumn("part", F.lit(3)), part=part)
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark, monkeypatch):
    """Shares, fingerprints and ids of the near-copies stage, and the rows of the mix."""
    plans = []

    def seen(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df)

    monkeypatch.setattr(simhash, "stored", seen)
    texts = sentences(4, 30)
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts + texts[:9])],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert simhash.keep_one(docs).count() == 30
    close, pairs = [p for columns, p in plans if columns == ["a", "b"]][:2]
    for plan in (close, pairs):
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    mixed = mixing.plan_mix(docs)
    assert mixed.count() == 39
    joins = re.findall(r"BroadcastHashJoin \[source#.*", mixed._jdf.queryExecution().executedPlan().toString())
    assert joins and not [j for j in joins if "BuildLeft" in j]


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [
        (500, 501), (501, 500), (500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 400)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_groups_of_odd_rows(spark):
    rows = simhash.near_groups(odd_docs(spark)).collect()
    got = {r["doc_id"]: (r["simhash"], r["component_id"]) for r in rows}
    assert len(rows) == 10 and got[1] == got[2] == got[3] == (0, 1)
    assert simhash.near_groups(empty_docs(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    base = sentences(7, 40, 120)
    near = [t.replace(" ", " edited ", 1) for t in base[:10]]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(near)] + [
        (200, base[3]), (3, base[3]), (None, base[0]), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cell", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(
        [*range(40), 300, None], key=str)
    assert simhash.keep_one(empty_docs(spark)).count() == 0


def test_long_similar_texts_are_linked(spark):
    draw, rows = np.random.default_rng(2), []
    for pair in range(8):
        size, step = (1000, 3000)[pair % 2], (54, 35)[pair >= 6]   # Jaccard 0.83; 0.75 for the last two
        words = [f"w{i}" for i in draw.integers(0, 10 ** 6, size)]
        other = [f"x{pair}" if n % step == step // 2 else w for n, w in enumerate(words)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert groups == {i: i - i % 2 if i < 12 else i for i in range(16)}


def test_targets_by_hand():
    got = mixing.targets([("a", 10), ("b", 100), (None, 90)])
    # 300 words: weights 3, 1, 2; a stops at 20, the other 280 go 1 to 2: None stops at 180
    assert got == {"a": 20.0, "b": 100.0, None: 180.0}
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_quotas_are_split_exactly():
    quotas = np.array([100, 7, 0, 1])
    got = mixing.split_quotas(quotas, 5, 3)
    assert got.sum(0).tolist() == quotas.tolist() and np.ptp(got.sum(1)) <= 1
    assert (got == mixing.split_quotas(quotas, 5, 3)).all()


def test_mixing_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op9_mixing(spark, SF).collect()
    again = queries.op9_mixing(spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(docs)
    size, taken, target = {}, {}, {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", d["text"]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert (len(r["shards"]) == 0) == (r["taken"] == 0)
        size[d["source"]] = size.get(d["source"], 0) + r["size"]
        taken[d["source"]] = taken.get(d["source"], 0) + r["taken"]
        target[d["source"]] = r["target"], r["source_size"]
    want = mixing.targets(sorted(size.items()))
    for s in size:
        assert target[s] == (pytest.approx(want[s]), size[s]) and abs(taken[s] - want[s]) < 1


def test_mixing_of_odd_rows(spark):
    rows = mixing.plan_mix(odd_docs(spark)).collect()
    assert len(rows) == 10 and sum(r["taken"] for r in rows if r["source"] is None) > 0
    assert {r["taken"] for r in rows if r["size"] == 0} == {0}
    assert mixing.plan_mix(empty_docs(spark)).count() == 0
    mixed = mixing.mix(odd_docs(spark))
    assert mixed.columns == odd_docs(spark).columns
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_wrapper_drops_what_stays_the_same(spark):
    def page(i, host="h"):
        return (i, f"http://{host}/{i}", f"""<html><head><title>t{i}</title><script>var a="<p>x</p>"</script>
            <body><nav><li>Menu {i}</nav><div class="cookie-notice">We use {i}</div><article>
            <h1>Head {i}</h1><p>First &amp; <b>bold</b>&nbsp;text {i}<p>Read our house rules<p>Last
            {i} <br> line</article><div id=comments><p>nice {i}</p></div><footer>f {i}</footer>""")

    rows = [page(i) for i in range(8)] + [page(20, "lonely"), (30, None, None), (31, "http://h/x", ""),
                                          (32, "::bad::", "plain text < 3 &lt;b&gt;"), page(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "wrapper", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in wrappers.extract(pages, wrappers.induce(pages)).collect()}
    assert got[5] == "Head 5\nFirst & bold text 5\nLast 5 line"
    assert got[20] == "Head 20\nFirst & bold text 20\nRead our house rules\nLast 20 line"
    assert got[30] == got[31] == "" and got[32] == "plain text < 3 <b>"
    none = pages.limit(0)
    assert wrappers.extract(none, wrappers.induce(none)).count() == 0


def test_tree_matching_aligns_in_order():
    page = wrappers.fold(wrappers.parse("<body><div class=a>x</div><p>1<p>2<div class=b>y</div>"))
    other = wrappers.skeleton("<body><p>1</p><div class=b>y</div><div class=c>z</div>")
    found = {slot.label: place for place, slot in wrappers.align(page, other).items()}
    assert {"p ", "div b"} <= set(found) and "div a" not in found


def test_pages_query_against_plain_reading(spark):
    import html
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op8_html(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split())
                  for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, known = docs.columns, {(r["doc_id"], r["text"]) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert docs.columns == columns
        assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= known
        if name == "near_copies":
            assert docs.count() == docs.select("doc_id").distinct().count()
    assert docs.where("size(token_ids) <> n_tokens").count() == 0


def test_deep_long_and_broken_pages():
    deep = "<article>" + "<div>" * 2000 + "core" + "</div>" * 2000 + "<p>after</p></article><p>beside</p>"
    assert wrappers.main_text(deep) == "core\nafter"
    nested = "<main><p>a</p>" + "<div>" * 150 + "<nav>menu<div>x</div></nav>b" + "</div>" * 150 + "<p>c</p></main>"
    assert wrappers.main_text(nested) == "a\nb\nc"
    start = time.perf_counter()
    for broken in ("<a " * 50_000, "<a \"" * 20_000, "<p>x</p>" + "<a '" * 20_001 + ">", "<" * 50_000, "<!--" * 20_000,
                   "<a b='" * 20_000 + ">"):
        wrappers.skeleton(broken)
    rows = lambda n, m: "<table>" + "".join(f"<tr><td>{i}</td><td>{'<b>x</b>' * (i % m)}y</td></tr>"
                                            for i in range(n)) + "</table>"
    for n, m in ((1500, 2), (1500, 7)):
        tree = wrappers.fold(wrappers.parse(rows(n, m)))
        assert len(wrappers.align(tree, wrappers.skeleton(rows(n + 5, m)))) > n
    assert time.perf_counter() - start < 20


def test_parts_of_names_say_nothing_inside_an_article():
    page = ('<body><div class="site-menu">m</div><article><p class="share-price">price</p><div class="comment-free">'
            'free</div><div class="ad">advert</div><section id="comments">c</section></article></body>')
    assert wrappers.main_text(page) == "price\nfree"


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_follow_one_another_on_odd_and_empty_tables(spark, tmp_path, kind):
    """Null and empty texts, repeated rows and clashing columns pass through all stages."""
    spark.createDataFrame([(6, 1, 0), (8, 0, 1), (5, 1, 0), (None, 1, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs(spark) if kind == "odd" else empty_docs(spark)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
        after = docs.count()
        if name != "bpe":
            assert docs.columns == columns, name
        if name in ("language", "toxicity", "near_copies"):
            assert after <= before
        if name == "near_copies":
            ids = [r["doc_id"] for r in docs.collect() if r["doc_id"] is not None]
            assert len(ids) == len(set(ids))
        before = after
    assert {"token_ids", "n_tokens"} <= set(docs.columns)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in docs.collect())
    assert kind == "odd" or before == 0


def test_long_lists_of_children_align_like_short_ones():
    def page(labels):
        return "<body>" + "".join(f"<div class=x{i}>t{i}</div>" for i in labels) + "</body>"

    # moved by more than any stretch
    found = wrappers.align(wrappers.fold(wrappers.parse(page([*range(900, 1200), *range(300), 5000]))),
                           wrappers.skeleton(page([*range(300), *range(2000, 2300)])))
    assert sum(s.label.startswith("div") for s in found.values()) == 300
    draw = random.Random(5)
    for cells in (1, 50, 1 << 20):      # how many cells are held makes no difference
        wrappers.CELLS, before = cells, wrappers.CELLS
        try:
            ours, theirs = ([draw.randrange(12) for _ in range(n)] for n in (70, 90))
            slots = wrappers.align(wrappers.fold(wrappers.parse(page(ours))), wrappers.skeleton(page(theirs)))
        finally:
            wrappers.CELLS = before
        runs = [[x for i, x in enumerate(xs) if not i or x != xs[i - 1]] for xs in (ours, theirs)]
        best = [[0] * (len(runs[1]) + 1) for _ in range(len(runs[0]) + 1)]
        for i, x in enumerate(runs[0]):
            for j, y in enumerate(runs[1]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y))
        assert sum(s.label.startswith("div") for s in slots.values()) == best[-1][-1]
