import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from steadytext.llm import hosts, negatives, queries, spans
from tests.llm.helpers import SF, empty_docs, odd_docs

# ------------------------------------------------------------------ URL filters

PAGES = "page_id long, url string, html string"


def link(host, path="/x", quote='"'):
    return f"<p><a class=c href={quote}https://{host}{path}{quote}>t</a>"


def graph_pages():
    """Good hosts, a blocked farm, hosts that link to either, and a chain."""
    rows = [(i, f"http://good{i % 3}.org/p{i}", link("friend.net") + link("Friend.NET", quote="'"))
            for i in range(9)]
    rows += [(20 + i, f"http://farm.net/bad/{i}", link("friend.net") if i == 0 else "") for i in range(4)]
    rows += [(30, "http://fan.net/a", link("farm.net") * 3), (31, "http://fan.net/b", link("good0.org")),
             (32, "http://fanfan.net/a", link("fan.net")), (33, "http://friend.net/a", link("next.net")),
             (34, "http://next.net/", "<a href='//rel.net?q'>x</a> <a title=x  href = http://Far.net:80#f>"),
             (35, "http://lone.net/a", '<a href="/farm.net">x</a> href="http://farm.net"'),
             (36, "http://toads.net/a", link("ads.net", "/")), (37, "mailto:farm.net", link("farm.net")),
             (38, None, link("farm.net")), (39, "http://lone.net/b?http://farm.net/", None)]
    return rows + [(39, "http://lone.net/b?http://farm.net/", None)]


RULES = [("allow", "org", "/"), ("block", "farm.net", "/bad/"), ("block", "ads.net", "/"),
         ("allow", "farm.net", "/bad/3"), ("block", "good1.org", ""), ("allow", "good1.org", "/p")]


def plain_judgement(pages, rules, damping=0.85, rounds=200, least=0.01):
    import re

    def place(url):
        got = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        return (got[1].lower(), got[2]) if got else ("", "")

    def rule(host, path):
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    links = Counter()
    for _, url, html in pages:
        a = place(url)[0]
        found = re.findall(r"""<a(?:\s[^<>]*?)?[\s"']href\s*=\s*["']?\s*(?:https?:)?//([^/?#<>"'\s]+)""",
                           (html or "").lower())
        for b in set(found):
            if a and b != a:
                links[a, b] += 1
    asked = [place(u) for _, u, _ in pages]
    own = {h for h, _ in asked}
    asked += [(b, "/") for b in {b for _, b in links} - own]
    seeds = {}
    for h in {h for h, _ in asked}:
        verdicts = [rule(*x)[1] for x in asked if x[0] == h]
        share = [verdicts.count(v) / len(verdicts) for v in ("allow", "block")]
        seeds[h] = [s if s >= 0.5 else 0 for s in share]
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    score = {h: list(s) for h, s in seeds.items()}
    for _ in range(rounds):
        moved = {h: list(s) for h, s in seeds.items()}
        for (a, b), n in links.items():
            moved[b][0] += damping * n / out[a] * score[a][0]
            moved[a][1] += damping * n / into[b] * score[b][1]
        score = moved
    rows = []
    for i, url, _ in pages:
        h, p = place(url)
        trust, distrust = score[h]
        bad = h and distrust >= least and distrust > trust
        rows.append((i, h, p, rule(h, p)[0], rule(h, p)[1] or ("block" if bad else "allow")))
    return sorted(rows, key=str), score


def test_urls_by_links_against_plain_loops(spark):
    pages = graph_pages()
    want, score = plain_judgement(pages, RULES)
    held = spark.createDataFrame(pages, PAGES).withColumn("host", F.lit("old")).coalesce(3)
    judged = hosts.judge_urls(held, RULES, rounds=60, close=1e-9)
    rows = judged.collect()
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows), key=str)
    assert got == want
    for r in rows:
        assert (r["trust"], r["distrust"]) == pytest.approx(score[r["host"]], abs=1e-6)
    verdict = {r["url"]: r["verdict"] for r in rows}
    # linked from trusted hosts, linking to blocked ones, and neither
    assert verdict["http://friend.net/a"] == "allow" and verdict["http://lone.net/a"] == "allow"
    assert verdict["http://fan.net/a"] == verdict["http://toads.net/a"] == "block"
    assert verdict["http://farm.net/bad/3"] == "allow"      # the longer rule


def test_urls_sql_says_the_same(spark):
    pages = pa.table(dict(zip(("page_id", "url", "html"), map(list, zip(*graph_pages())))))
    con = duckdb.connect()
    con.register("pages", pages)
    con.execute(hosts.oracle_sql(RULES, rounds=40))
    names = [d[0] for d in con.description]
    rows = [dict(zip(names, r)) for r in con.fetchall()]
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows), key=str)
    assert got == plain_judgement(graph_pages(), RULES)[0]


def test_url_parts(spark):
    urls = ["http://A.Example.ORG:80/x/y?z#w", "no scheme", None, "", "x://h", "a://b?c://d/e", "://", "http://İ.org#/",
            "http://h//p://q\n/r"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(
        hosts.host_of(F.col("url")), hosts.path_of(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a.example.org:80", "/x/y"), ("", ""), ("", ""), ("", ""), ("h", ""), ("b", ""), ("", ""), ("İ.org", ""),
        ("h", "//p://q\n/r")]


def test_urls_of_empty_tables_and_long_html(spark):
    none = spark.createDataFrame([], PAGES)
    assert hosts.judge_urls(none, RULES).count() == 0
    long = [(1, "http://a.net/", "<a " * 200_000), (2, "http://b.net/", '<a href="' * 100_000),
            (3, "http://" + "x." * 20_000 + "org/", "href" * 100_000)]
    rows = {r["page_id"]: r for r in hosts.judge_urls(spark.createDataFrame(long, PAGES), RULES).collect()}
    assert {i: r["verdict"] for i, r in rows.items()} == {1: "allow", 2: "allow", 3: "allow"}
    assert rows[3]["rule"] == "org/"
    assert {r["verdict"] for r in hosts.judge_urls(spark.createDataFrame(long, PAGES), []).collect()} == {"allow"}


def test_url_query_takes_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = queries.op11_urls(spark, SF).collect()
    want, _ = plain_judgement([tuple(r) for r in pages.select("page_id", "url", "html").collect()],
                              queries.URL_RULES)
    assert sorted(map(tuple, rows), key=str) == want


# ------------------------------------------------------------------ token spans

@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def plain_tokens(text, paths):
    """(id, bytes) of both tokenizers over the whole text, or None."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if "a" not in plain_tokens.__dict__:
        plain_tokens.a = Tokenizer.from_file(paths[0])
        plain_tokens.a.encode_special_tokens = True
        plain_tokens.b = SentencePieceProcessor(model_file=paths[1])
        plain_tokens.signs = {chr(c): b for b, c in spans.byte_signs().items()}
    if not text:
        return None
    a = [(i, bytes(plain_tokens.signs[c] for c in plain_tokens.a.id_to_token(i)))
         for i in plain_tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in plain_tokens.b.encode(text):
        name = plain_tokens.b.id_to_piece(i)
        b.append((i, bytes([int(name[3:5], 16)]) if plain_tokens.b.is_byte(i)
                  else name.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def plain_alignment(text, paths):
    found = plain_tokens(text, paths)
    if found is None:
        return (0, 0, 0, 0, ""), Counter()
    a, b = found
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
    groups, links, i, j = [], Counter(), 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        groups.append(",".join(str(x) for x, _ in a[i:k]) + "|" + ",".join(str(x) for x, _ in b[j:m]))
        for p in range(i, k):
            for q in range(j, m):
                low = max(([0] + ends[0])[p], ([0] + ends[1])[q])
                if low < min(ends[0][p], ends[1][q]):
                    links[a[p][0], b[q][0]] += 1
        i, j = k, m
    told = ";".join(groups)
    return (len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(told.encode()).hexdigest()), links


def plain_spans(texts, paths):
    found = [plain_alignment(t, paths) for t in texts]
    count = Counter(p for _, links in found for p in links)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    return [(*row[:4], sum(n for p, n in links.items() if count[p] == top[p[0]]),
             sum(n * count[p] for p, n in links.items()), row[4]) for row, links in found]


TEXTS = ["Hello world", "naïve café — 𒀀𒀁 日本語 text", " leading", "  two", "trailing  ", "a  b   c\n\n d\t e", "\n", " ",
         "under ▁ mark", "x" * 300, "<|endoftext|> <s> </s> it's we'll 12,345.6", "\u00a0nbsp\u00a0 x\u2003y \u3000z ",
         "é" * 90 + " ü", "👩‍👩‍👧 family 🇫🇷", "ab" * 40 + " " + "ab" * 40, "a\x00b \x7f c\u0085 d", "mixed 日 本 Ω ж ñ", None, "",
         "same same same same"]


def test_spans_against_plain_loops(spark, paths):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(2)
    want = plain_spans(TEXTS, paths)
    found = spans.aligned(rows, *paths)
    for head in (spans.HEAD_PAIRS, 5, 0):       # all, some and none of the pairs broadcast
        got = spans.with_corpus_counts(found, spans.pair_counts(found), head).orderBy("doc_id").collect()
        assert [tuple(r[c] for c in [*spans.COUNTS, "n_best", "count_sum", "groups_sha256"])
                for r in got] == want


def test_span_query_against_plain_loops(spark, paths):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = plain_spans([r["text"] for r in docs], paths)
    got = {r["doc_id"]: r for r in queries.op12_spans(spark, SF).collect()}
    assert len(got) == len(docs)
    for doc, row in zip(docs, want):
        assert tuple(got[doc["doc_id"]])[1:] == row


def test_stretches_do_not_change_ids(paths):
    """Random texts of awkward characters, whole against cut, with memory that is often forgotten."""
    draw = random.Random(5)
    signs = [" ", " ", "  ", "\n", "\t", "a", "the", "é", "ñ", "Ω", "日", "𒀀", "'s", "12", "!", "\u00a0", "\u2003", "ing", "▁"]
    texts = ["".join(draw.choices(signs[:-1] if draw.random() < 0.8 else signs, k=draw.randint(1, 60)))
             for _ in range(400)]
    aligner = spans.Aligner(*paths, kept=50)
    for at in range(0, 400, 40):
        found = aligner.align(pa.array(texts[at:at + 40]))
        for i, t in enumerate(texts[at:at + 40]):
            want, links = plain_alignment(t, paths)
            assert tuple(found[c][i] for c in spans.COUNTS) == want[:4], t
            assert found["groups_sha256"][i] == want[4]
            assert {(x["a"], x["b"]): x["times"] for x in found["links"][i].as_py()} == links


def test_refined_ends_inside_a_character():
    # a character of four bytes, cut 1+3 by spans that all cover it, between single bytes
    start, end = np.array([0, 1, 1, 5]), np.array([1, 5, 5, 6])
    got = spans.refined_ends(start, end, np.array([1, 1, 3, 1]), np.zeros(4, int), np.zeros(1, int))
    assert got.tolist() == [1, 2, 5, 6]
    # the other side reports empty spans for all but the last byte
    start, end = np.array([0, 1, 1, 1, 1]), np.array([1, 1, 1, 1, 5])
    got = spans.refined_ends(start, end, np.ones(5, int), np.zeros(5, int), np.zeros(1, int))
    assert got.tolist() == [1, 2, 3, 4, 5]


def test_spans_of_odd_and_empty_tables(spark, paths):
    docs = odd_docs(spark).withColumn("row", F.lit("x"))
    found = spans.aligned(docs, *paths)
    told = spans.with_corpus_counts(found, spans.pair_counts(found)).collect()
    texts = [r["text"] for r in docs.collect()]
    want = plain_spans(texts, paths)
    keep = lambda rows: sorted(map(str, rows))
    assert keep((r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                 r["groups_sha256"]) for r in told) == keep(want)
    none = spans.aligned(empty_docs(spark), *paths)
    assert spans.with_corpus_counts(none, spans.pair_counts(none)).count() == 0


# ------------------------------------------------------------------ hard negatives

VECTORS = "vec_id long, label int, embedding array<double>"


def plain_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    held = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [max(-2**63, min(2**63 - 1, int(np.floor(256 * x)) if abs(x) < 2**53 else
                                 (2**63 if x > 0 else -2**63))) for x in v]
        held[i] = min(held.get(i, (label, whole)), (label, whole))
    out = []
    for i, (label, v) in held.items():
        if not is_anchor(i):
            continue
        score = {j: max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(v, w))))
                 for j, (_, w) in held.items() if j != i and len(w) == len(v)}
        order = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in order if held[j][0] == label][:positives]:
            inside = [j for j in order if held[j][0] != label
                      and low * score[p] <= 100 * score[j] <= high * score[p]][:negatives]
            out += [(i, p, r + 1, j, score[p], score[j]) for r, j in enumerate(inside)]
    return sorted(out)


def vectors(seed, n, dims=6, labels=3, grid=None):
    draw = random.Random(seed)
    value = (lambda: draw.choice(grid)) if grid else (lambda: draw.gauss(0, 1))
    return [(i, draw.randrange(labels), [value() for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("rows", [vectors(1, 400), vectors(2, 300, grid=[0.0, 0.25, 0.5]),
                                  vectors(3, 120, dims=2, grid=[-1e300, 1e300, 3.0, 1e12]),
                                  vectors(4, 100, dims=3, grid=[2.0**30, 2.0**29, -1.5])])
def test_negatives_against_plain_loops(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).coalesce(2)
    got = negatives.hard_negatives(df, lambda i: i % 10 == 0, shard_rows=64, block_rows=7)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(7, 60) + [(100, None, [1.0] * 6), (110, 1, None), (120, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
                             (130, 1, [nan] * 6), (140, 1, [1.0, inf, 1.0, 1.0, 1.0, 1.0]), (150, 1, []), (151, 2, []),
                             (160, 1, [0.0] * 6), (None, 1, [1.0] * 6), (170, 2, [1.0] * 3), (171, 1, [1.0] * 3),
                             (172, 2, [1.0] * 3), (5, 2, [9.0] * 6), (5, 2, [9.0] * 6), (10, 0, [1.0] * 6)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    got = negatives.hard_negatives(df, lambda i: i % 10 == 0, shard_rows=16, block_rows=4)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none, lambda i: i % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, lambda i: i < 0).count() == 0


def test_limits_are_distinct_and_falling():
    assert negatives.limits([100, 100, 40, -3], 50, 95) == ([95, 38], 20)
    assert negatives.limits([], 50, 95) == ([], 0)
