"""URL filters: rules first, then trust and distrust that spread along links between hosts.

Rules decide the urls they fit. All other urls are judged by their host: trust walks from hosts
the rules mostly allow along links (a page vouches for what it links to), distrust walks from
hosts the rules mostly block against the links (a page answers for what it links to). Both
are personalised PageRanks over host edges, and a host is blocked where distrust prevails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from steadytext.llm.storage import release, stored
from steadytext.operators.frames import join_lookup

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_BLANK = r"\x20\x09-\x0D"
# host of an absolute link; a tag is read up to the next angle bracket, so broken tags cost no more
_LINK = (rf"(?i)<a(?:[{_BLANK}][^<>]*?)?[{_BLANK}\x22']href[{_BLANK}]*=[{_BLANK}]*[\x22']?[{_BLANK}]*"
         rf"(?:https?:)?//([^/?#<>\x22'{_BLANK}]+)")
DAMPING, ROUNDS, CLOSE, LEAST = 0.85, 20, 1e-4, 0.01
RULES = "verdict string, host string, path string"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rules_for(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct places (host, path) that a rule fits.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with its
    path; the longest rule wins, then the one of the longest host, then ``block``. Rules are met in
    two equi-joins, by the last labels of a host and then by a beginning of the path, for
    just the lengths that rules of that host have; so there may be any number of rules.
    """
    rules = rules.where("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL")
    labels = lambda host: F.size(F.split(host, r"\."))
    depths = [r[0] for r in rules.select(labels(F.col("host"))).distinct().collect()]
    lengths = rules.groupBy(F.col("host").alias("suffix")).agg(
        F.collect_set(F.char_length("path")).alias("lengths"))
    every = F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>")
    ends = places.select("host", "path", F.explode(F.filter(every, lambda d: d <= labels(F.col("host"))))
                         .alias("depth"))
    ends = ends.withColumn("suffix", F.expr("substring_index(host, '.', -depth)"))
    starts = join_lookup(ends, lengths, ["suffix"], "inner").select(
        "host", "path", "suffix", F.explode("lengths").alias("length")) \
        .where(F.col("length") <= F.char_length("path")) \
        .withColumn("start", F.expr("substring(path, 1, length)"))
    keyed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    fits = join_lookup(starts, keyed, ["suffix", "start"], "inner")
    text = F.concat("suffix", "start")
    best = F.max(F.struct(F.char_length(text).alias("n"), F.char_length("suffix").alias("m"),
                          text.alias("rule"), "verdict"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select(
        "host", "path", "best.rule", "best.verdict")


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b, n): how many pages of host ``a`` link to another host ``b``."""
    target = F.explode(F.array_distinct(F.regexp_extract_all(
        F.translate(F.col(html), _UPPER, _LOWER), F.lit(_LINK), F.lit(1))))
    return pages.select(host_of(F.col(url)).alias("a"), target.alias("b")) \
        .where("a <> '' AND a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def _seeds(counted: DataFrame) -> DataFrame:
    """(host, trusted, blocked): the share of a host's places that rules allow or block.

    A share below one half is no seed.
    """
    def share(verdict: str) -> Column:
        part = F.sum(F.when(F.col("verdict") == verdict, F.col("n")).otherwise(0)) / F.sum("n")
        return F.when(part >= 0.5, part).otherwise(0.0)

    return counted.groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))


def spread(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS,
           close: float = CLOSE) -> DataFrame:
    """(host, trust, distrust) of every host of ``seeds`` and ``links``.

    Trust follows the links (a, b, n), shared out by n; distrust goes against them. A score is
    the personalised PageRank of the host divided by 1 - ``damping``, so a seed without links keeps
    its own weight. A walk ends at a host without links. Rounds are written tables; they end
    after ``rounds`` or when no score moved by ``close``.
    """
    out = links.groupBy("a").agg(F.sum("n").alias("all"))
    into = links.groupBy("b").agg(F.sum("n").alias("all"))
    along = join_lookup(links, out, ["a"], "inner").select(
        F.col("a").alias("host"), F.col("b").alias("to"), (F.col("n") / F.col("all")).alias("t"),
        F.lit(0.0).alias("d"))
    against = join_lookup(links, into, ["b"], "inner").select(
        F.col("b").alias("host"), F.col("a").alias("to"), F.lit(0.0).alias("t"),
        (F.col("n") / F.col("all")).alias("d"))
    flows = stored(along.unionByName(against))
    linked = flows.select("host").distinct()
    start = join_lookup(linked, seeds, ["host"]).select(
        "host", F.coalesce("trusted", F.lit(0.0)).alias("trusted"),
        F.coalesce("blocked", F.lit(0.0)).alias("blocked"))
    now = stored(start.withColumns({"trust": F.col("trusted"), "distrust": F.col("blocked")}))
    for _ in range(rounds):
        moved = join_lookup(flows, now.select("host", "trust", "distrust"), ["host"], "inner") \
            .groupBy(F.col("to").alias("host")).agg(
                F.sum(F.col("t") * F.col("trust")).alias("t"),
                F.sum(F.col("d") * F.col("distrust")).alias("d"))
        # sums are rounded, as their last digits depend on the order of arrival
        score = lambda own, got: F.round(
            F.col(own) + damping * F.coalesce(F.col(got), F.lit(0.0)), 12)
        after = stored(now.join(moved, "host", "left").select(
            "host", "trusted", "blocked", score("trusted", "t").alias("trust"),
            score("blocked", "d").alias("distrust"),
            F.greatest(F.abs(score("trusted", "t") - F.col("trust")),
                       F.abs(score("blocked", "d") - F.col("distrust"))).alias("step")))
        release(now)
        now, step = after, after.agg(F.max("step")).first()[0]
        if step is None or step < close:
            break
    lone = seeds.join(linked, "host", "left_anti").select(
        "host", F.col("trusted").alias("trust"), F.col("blocked").alias("distrust"))
    return lone.unionByName(now.select("host", "trust", "distrust"))


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]],
               least: float = LEAST, key: str = "page_id", url: str = "url", html: str = "html",
               **settings) -> DataFrame:
    """(key, url, host, path, rule, verdict, trust, distrust), one row per page.

    ``rules`` are rows (``allow`` or ``block``, host, path). ``rule`` is host and path of the winning
    one, or null. Without a rule the verdict is ``block`` where the distrust of the host is
    at least ``least`` and above its trust, else ``allow``. A host seeds trust (distrust) if rules
    allow (block) at least half of its pages; a host that is only linked to is asked by its
    root path. Links are absolute ``href`` values of ``a`` tags; a relative link stays on
    its host and says nothing.

    A null url, or one without ``://``, has an empty host and path: no rule, no links, verdict
    ``allow``. Null and empty html has no links. Equal rows each get their row; null keys
    stay. Other columns are dropped, whatever their names. No pages, no rows.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), RULES)
    named = pages.select(F.col(key), F.col(url), host_of(F.col(url)).alias("host"),
                         path_of(F.col(url)).alias("path"))
    places = named.groupBy("host", "path").agg(F.count("*").alias("n"))
    ruled = stored(places.join(rules_for(places.select("host", "path"), rules), ["host", "path"], "left"))
    links = stored(host_links(pages, url, html))
    if links.take(1):
        far = links.select(F.col("b").alias("host")).distinct().join(
            ruled.select("host").distinct(), "host", "left_anti").withColumn("path", F.lit("/"))
        asked = far.join(rules_for(far, rules), ["host", "path"], "left").withColumn("n", F.lit(1))
        hosts = spread(_seeds(ruled.unionByName(asked)), links, **settings)
    else:       # nothing spreads
        hosts = _seeds(ruled).select("host", F.col("trusted").alias("trust"),
                                     F.col("blocked").alias("distrust"))
    joined = join_lookup(join_lookup(named, ruled.drop("n"), ["host", "path"]), hosts, ["host"])
    bad = (F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")) & (F.col("host") != "")
    own = F.when(bad, "block").otherwise("allow")
    return joined.select(key, url, "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"),
                         "trust", "distrust")


def oracle_sql(rules: Sequence[tuple[str, str, str]], damping: float = DAMPING, rounds: int = ROUNDS,
               least: float = LEAST) -> str:
    """The same rows in SQL, with a fixed number of rounds written out."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    lowered = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    link, url = _LINK.replace("'", "''"), _URL.replace("'", "''")
    steps = ["r0 AS (SELECT host, trusted, blocked, trusted AS trust, blocked AS distrust FROM seeds)"]
    for i in range(rounds):
        steps.append(f"""r{i + 1} AS MATERIALIZED (
  SELECT r.host, any_value(r.trusted) AS trusted, any_value(r.blocked) AS blocked,
         any_value(r.trusted) + {damping} * coalesce(sum(f.t * g.trust), 0) AS trust,
         any_value(r.blocked) + {damping} * coalesce(sum(f.d * g.distrust), 0) AS distrust
  FROM r{i} r LEFT JOIN flows f ON f.dest = r.host LEFT JOIN r{i} g ON g.host = f.host
  GROUP BY r.host)""")
    shares = ", ".join(f"""CASE WHEN sum(CASE WHEN verdict = '{v}' THEN 1 ELSE 0 END) / count(*) >= 0.5
    THEN sum(CASE WHEN verdict = '{v}' THEN 1 ELSE 0 END) / count(*) ELSE 0 END AS {name}"""
                       for v, name in (("allow", "trusted"), ("block", "blocked")))
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {values}),
named AS (
  SELECT page_id, html, {lowered.format(f"coalesce(regexp_extract(url, '{url}', 1), '')")} AS host,
         coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
links AS (
  SELECT a, b, count(*) AS n FROM (
    SELECT host AS a, unnest(list_distinct(regexp_extract_all({lowered.format("html")}, '{link}', 1))) AS b
    FROM named WHERE host <> '') WHERE a <> b GROUP BY a, b),
asked AS (
  SELECT host, path, TRUE AS page, page_id FROM named
  UNION ALL SELECT b, '/', FALSE, NULL FROM (SELECT DISTINCT b FROM links)
  WHERE b NOT IN (SELECT host FROM named)),
ruled AS (
  SELECT host, path, page, page_id, best.rule AS rule, best.verdict AS verdict FROM (
    SELECT *, (SELECT max(struct_pack(n := length(rhost || rpath), m := length(rhost),
                                      rule := rhost || rpath, verdict := r.verdict))
               FROM rules r WHERE (host = rhost OR ends_with(host, '.' || rhost))
                 AND starts_with(path, rpath)) AS best FROM asked)),
seeds AS MATERIALIZED (SELECT host, {shares} FROM ruled GROUP BY host),
flows AS MATERIALIZED (
  SELECT a AS host, b AS dest, n / sum(n) OVER (PARTITION BY a) AS t, 0.0 AS d FROM links
  UNION ALL SELECT b, a, 0.0, n / sum(n) OVER (PARTITION BY b) FROM links),
{", ".join(steps)}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust >= {least}
       AND distrust > trust AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN r{rounds} USING (host) WHERE page
"""
