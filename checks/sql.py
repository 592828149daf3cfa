"""SQL text of the input views and of the perturbation steps, for the oracle side."""

from __future__ import annotations

import re

from checks.views import GUARDED_NAMES
from steadytext import constants as K
from steadytext import dictionaries as D

# Written here once more, not taken from the code under test: what whitespace is (as Python's str.split
# sees it), what sums and percentages look like, and the headlines.
WHITESPACE = "[" + "".join(rf"\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]"
PERCENT_PATTERN = r"\d[ \t]?%"
MONEY_PATTERN = (r"([$€£]|EUR|USD|GBP)[ \t]?\d|\d[ \t]?(EUR|USD|GBP|euro|euros|dollar|dollars|mn|bn|million|billion)\b")
FIGURE_SPAN = r"\d+([.,]\d+)*[ \t]?%|([$€£]|(EUR|USD|GBP) )\d+([.,]\d+)*"

HEADLINES = """headlines AS (SELECT o_orderkey AS sample_id,
    CASE WHEN o_orderstatus = 'F' THEN 'negative' WHEN o_orderstatus = 'O' THEN 'neutral' ELSE 'positive' END
    AS sentiment,
    coalesce((['Barclays', 'Apple', 'United', 'Nokia', 'BP'])[o_custkey % 6 + 1], 'The company') || ' ' ||
    (['reported strong demand and sales rose', 'missed expectations as profits fell', 'said revenues increased',
      'beat expectations while shares soared', 'plunged sharply on weak demand by', 'was up', 'was down',
      'kept its outlook unchanged with growth of'])[o_orderkey % 8 + 1] || ' ' ||
    (round(o_totalprice * 100)::BIGINT % 300) // 10 || '.' || round(o_totalprice * 100)::BIGINT % 10 ||
    CASE o_orderkey % 2 WHEN 0 THEN ' %' ELSE '%' END || ' in ' || year(o_orderdate) AS text FROM orders)"""

REWRITES = """rewrites AS (SELECT * FROM (SELECT text AS orig,
    replace(replace(replace(text,'revenues','turnover'),'shares','the stock'),
            'profits','earnings') AS rewrite
    FROM (SELECT DISTINCT text FROM headlines)) WHERE rewrite <> orig)"""

_Y = "CASE WHEN quality=0 THEN 'negative' WHEN toxic=1 THEN 'neutral' ELSE 'positive' END"
PREDS = f"""preds AS (SELECT doc_id AS sample_id, {_Y} AS y_true,
    CASE substr(md5(concat('7:',doc_id)),1,1) WHEN '0' THEN 'none' WHEN '1' THEN 'negative'
    WHEN '2' THEN 'neutral' WHEN '3' THEN 'positive' ELSE {_Y} END AS y_pred FROM labels)"""


def _norm(lo):
    return (f"list_transform(embedding[{lo}:{lo + 2}], lambda x: exp(4.0::DOUBLE*x))")


PROB_PAIRS = f"""prob_raw AS (SELECT vec_id AS sample_id, label,
    CASE label % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS sentiment,
    CAST(floor(vec_id/8) AS bigint) AS batch_id, CAST(floor(vec_id/32) AS bigint) AS step,
    vec_id % 4 AS run_id,
    CASE WHEN label=3 THEN NULL WHEN label=4 THEN '' ELSE concat('p', vec_id) END AS pert_prompt,
    {_norm(1)} AS e1, {_norm(4)} AS e2, {_norm(7)} AS e3, {_norm(10)} AS e4 FROM embeddings),
prob_pairs AS (SELECT sample_id, label, sentiment, sentiment AS ground_truth, batch_id, step,
    run_id, pert_prompt,
    list_transform(e1, lambda x: x/list_sum(e1)) AS p_student,
    list_transform(e2, lambda x: x/list_sum(e2)) AS p_pert,
    list_transform(e3, lambda x: x/list_sum(e3)) AS p_teacher,
    list_transform(e4, lambda x: x/list_sum(e4)) AS p_anchor FROM prob_raw)"""

HOLED = PROB_PAIRS + """, holed AS (SELECT sample_id, sentiment, p_pert, CASE label
    WHEN 9 THEN ['nan'::DOUBLE, p_student[2], p_student[3]]
    WHEN 8 THEN [p_student[1], 'inf'::DOUBLE, p_student[3]]
    WHEN 7 THEN [p_student[1], p_student[2], 0.0::DOUBLE] ELSE p_student END AS p_clean
    FROM prob_pairs)"""

TOKEN_LOGITS = """token_logits AS (SELECT vec_id AS sample_id,
    unnest(generate_series(0, len(embedding)-1)) AS token_id,
    unnest(embedding)::DOUBLE AS logit FROM embeddings)"""

EMB_PAIRS = """emb_pairs AS (SELECT a.vec_id AS sample_id, a.embedding::DOUBLE[] AS ea,
    b.embedding::DOUBLE[] AS eb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""

REWARD_LOG = """reward_log AS (SELECT user_id % 4 AS run_id,
    CAST(floor(event_id/32) AS bigint) AS step, CAST(floor(event_id/8) AS bigint) AS batch_id,
    CAST(floor(event_id/4) AS bigint) AS group_id, event_id AS sample_id, value AS reward
    FROM events)"""

DOC_PAIRS = """doc_pairs AS (SELECT doc_id AS sample_id, text AS orig,
    replace(replace(text,' and ',' '),' the ',' ') AS pert FROM documents)"""


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WHITESPACE}+'), lambda t: t <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')"


def md5(seed, *keys) -> str:
    return f"md5(concat_ws(':', {', '.join([quote(str(seed)), *keys])}))"


def h(seed, *keys) -> str:
    return f"('0x'||substr({md5(seed, *keys)},1,8))::bigint"


def h60(seed, *keys) -> str:
    return f"('0x'||substr({md5(seed, *keys)},1,15))::bigint"


def sym_kl(p, q, floor=None, cap=None) -> str:
    return f"({kl(p, q, floor, cap)} + {kl(q, p, floor, cap)})"


def kl(p, q, floor=None, cap=None) -> str:
    def c(x):
        if floor is not None:
            x = f"greatest({x}, {floor})"
        return f"least({x}, {cap})" if cap is not None else x
    return "(" + " + ".join(
        f"{c(f'{p}[{i}]')} * (ln({c(f'{p}[{i}]')}) - ln({c(f'{q}[{i}]')}))"
        for i in (1, 2, 3)) + ")"


def r6(x) -> str:
    return f"(round({x}, 6) + 0.0::DOUBLE)"


SYNONYMS = "syn(surface, synonyms) AS (VALUES " + ", ".join(
    f"({quote(w)}, {strings(s)})" for w, s in D.SURFACE_SYNONYMS.items()) + ")"
LEXICON = "lexicon(surface, lemma, sense, ord, synonym) AS (VALUES " + ", ".join(
    f"({quote(a)}, {quote(b)}, {c}, {d}, {quote(e)})" for a, b, c, d, e in D.LEXICON_ROWS) + ")"
PEERS = "peers(ord, a, b) AS (VALUES " + ", ".join(
    f"({i}, {quote(a)}, {quote(b)})" for i, (a, b) in enumerate(K.SECTOR_PEERS)) + ")"

GUARD_NAMES = "names(name) AS (VALUES " + ", ".join(f"({quote(n)})" for n in GUARDED_NAMES) + ")"


def synonym_ctes(name: str, source: str, quota: str, seed=0, text="text",
                 synonyms="syn") -> str:
    """``name(sample_id, pert)``: synonym replacement by joining exploded tokens."""
    return f"""{name}_tok AS (SELECT sample_id, {text} AS t, {toks(text)} AS toks FROM {source}),
{name}_long AS (SELECT sample_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos
    FROM {name}_tok),
{name}_rank AS (SELECT sample_id, w, synonyms, row_number() OVER (PARTITION BY sample_id
    ORDER BY {md5(seed, 'sample_id', 'w')}, w) AS rn FROM (SELECT DISTINCT sample_id, w
    FROM {name}_long WHERE NOT list_contains({strings(D.STOP_WORDS)}, w))
    JOIN {synonyms} ON w = surface WHERE len(synonyms) > 0),
{name}_pick AS (SELECT r.sample_id, w, synonyms[{h(f'{seed}:pick', 'r.sample_id', 'w')}
    % len(synonyms) + 1] AS s FROM {name}_rank r JOIN {name}_tok USING (sample_id)
    WHERE rn <= {quota}),
{name}_new AS (SELECT l.sample_id, string_agg(coalesce(p.s, l.w), ' ' ORDER BY pos) AS pert
    FROM {name}_long l LEFT JOIN {name}_pick p ON l.sample_id = p.sample_id AND l.w = p.w
    GROUP BY l.sample_id),
{name} AS (SELECT k.sample_id, coalesce(n.pert, k.t) AS pert FROM {name}_tok k
    LEFT JOIN {name}_new n USING (sample_id))"""


RATIO_QUOTA = f"greatest(1, CAST(floor(len(toks) * {K.SYNONYM_RATIO}) AS int))"


def forms_ctes(name: str, source: str, text="text", seed=0, max_repl=2) -> str:
    """``name(sample_id, pert)``: replacement by position of dictionary forms."""
    return f"""{name}_tok AS (SELECT sample_id, {toks(text)} AS toks FROM {source}),
{name}_long AS (SELECT sample_id, unnest(toks) AS w, generate_subscripts(toks, 1) - 1 AS pos
    FROM {name}_tok),
{name}_rank AS (SELECT sample_id, pos, synonyms, row_number() OVER (PARTITION BY sample_id
    ORDER BY {md5(seed, 'sample_id', 'pos')}) AS rn
    FROM {name}_long JOIN syn ON lower(w) = surface),
{name}_new AS (SELECT l.sample_id, string_agg(coalesce(r.synonyms[
    {h(f'{seed}:pick', 'l.sample_id', 'l.pos')} % len(r.synonyms) + 1], l.w), ' '
    ORDER BY l.pos) AS pert FROM {name}_long l LEFT JOIN {name}_rank r
    ON l.sample_id = r.sample_id AND l.pos = r.pos AND r.rn <= {max_repl} GROUP BY l.sample_id),
{name} AS (SELECT k.sample_id, coalesce(n.pert, '') AS pert FROM {name}_tok k
    LEFT JOIN {name}_new n USING (sample_id))"""


def paraphrase(x: str) -> str:
    for pattern, replacement in K.PARAPHRASE_RULES:
        x = (f"regexp_replace({x}, {quote(pattern)}, "
             f"{quote(replacement.replace('{adv}', K.SOFTENING_ADVERB))}, 'gi')")
    return x


def length_change(a: str, b: str) -> str:
    return f"(abs(len({toks(b)}) - len({toks(a)})) / greatest(1, len({toks(a)})))"


def template(x: str, delta=K.PARAPHRASE_LENGTH_DELTA) -> str:
    new = paraphrase(x)
    return f"CASE WHEN {length_change(x, new)} > {delta} THEN {x} ELSE {new} END"


_PCT = r"([0-9]+\.?[0-9]*)" + WHITESPACE + "?%"


def jitter_step(key: str, place: str, seed=0) -> str:
    return f"(['-0.2','-0.1','0.1','0.2'])[{h(seed, key, place)} % 4 + 1]::DECIMAL(2,1)"


def jitter(x: str, seed=0) -> str:
    delta = jitter_step("sample_id", "i - 1", seed)
    nums = f"regexp_extract_all({x}, '{_PCT}', 1)"
    return f"""array_to_string(list_transform(regexp_split_to_array({x}, '{_PCT}'),
    lambda g, i: g || CASE WHEN i <= len({nums}) THEN
    round({nums}[i]::DECIMAL(18,4) + {delta}, 1)::DECIMAL(18,1)::VARCHAR || '%' ELSE '' END), '')"""


def swap(x: str) -> str:
    whens = " ".join(f"WHEN contains({x}, {quote(a)}) THEN regexp_replace({x}, {quote(a)}, "
                     f"{quote(b)})" for a, b in K.SECTOR_PEERS)
    return f"CASE {whens} ELSE {x} END"


def numbers_ctes(name: str, source: str, text="text", seed=0) -> str:
    return (f"{name}_j AS (SELECT sample_id, {jitter(text, seed)} AS t FROM {source}), "
            f"{name} AS (SELECT sample_id, {swap('t')} AS pert FROM {name}_j)")


def entities(x: str) -> str:
    """Entity types joined by '|', in sorted order."""
    def any_of(kind):
        return "(" + " OR ".join(f"contains({x}, {quote(n)})" for n in D.GAZETTEER[kind]) + ")"
    tests = {"GPE": any_of("GPE"), "MONEY": f"regexp_matches({x}, {quote(MONEY_PATTERN)})",
             "ORG": any_of("ORG"), "PERCENT": f"regexp_matches({x}, {quote(PERCENT_PATTERN)})",
             "PRODUCT": any_of("PRODUCT")}
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN {t} THEN '{k}' END" for k, t in tests.items()) + ")"


# figures first, then names, the longest first
ENTITY_SPANS = "|".join([FIGURE_SPAN] + [re.escape(n) for n in sorted(
    {n for names in D.GAZETTEER.values() for n in names}, key=lambda n: (-len(n), n))])


def sim_ctes(name: str, source: str, keys="sample_id, method_ord") -> str:
    """``name(keys, sim)``: cosine of term counts by joining exploded tokens."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    using = ", ".join(ks)
    return f"""{name}_a AS (SELECT {keys}, w, count(*) AS n FROM (SELECT {keys},
    unnest({toks('orig')}) AS w FROM {source}) GROUP BY {keys}, w),
{name}_b AS (SELECT {keys}, w, count(*) AS n FROM (SELECT {keys},
    unnest({toks('pert')}) AS w FROM {source}) GROUP BY {keys}, w),
{name}_dot AS (SELECT {', '.join('a.' + k for k in ks)}, sum(a.n * b.n)::DOUBLE AS dot
    FROM {name}_a a JOIN {name}_b b ON {on} AND a.w = b.w GROUP BY ALL),
{name}_na AS (SELECT {keys}, sum(n * n)::DOUBLE AS aa FROM {name}_a GROUP BY {keys}),
{name}_nb AS (SELECT {keys}, sum(n * n)::DOUBLE AS bb FROM {name}_b GROUP BY {keys}),
{name} AS (SELECT {keys}, coalesce(dot / sqrt(aa * bb), 0.0) AS sim FROM {source}
    LEFT JOIN {name}_dot USING ({using}) LEFT JOIN {name}_na USING ({using})
    LEFT JOIN {name}_nb USING ({using}))"""


def cascade_ctes(name: str, source: str, th=K.SIM_THRESHOLD, ratio=K.LENGTH_RATIO) -> str:
    """``name``: candidates with ``passed, sim, len_ok, ner_ok, src_ner, tgt_ner``."""
    return f"""{sim_ctes(name + '_sim', source)},
{name}_m AS (SELECT c.*, s.sim, {length_change('orig', 'pert')} AS chg, {entities('orig')} AS sn,
    {entities('pert')} AS tn FROM {source} c JOIN {name}_sim s USING (sample_id, method_ord)),
{name} AS (SELECT * EXCLUDE (chg, sn, tn),
    sim >= {th} AND chg <= {ratio} AND sn = tn AS passed,
    CASE WHEN sim >= {th} AND chg > {ratio} THEN false END AS len_ok,
    CASE WHEN sim >= {th} AND chg <= {ratio} AND sn <> tn THEN false END AS ner_ok,
    CASE WHEN sim >= {th} AND chg <= {ratio} AND sn <> tn THEN sn END AS src_ner,
    CASE WHEN sim >= {th} AND chg <= {ratio} AND sn <> tn THEN tn END AS tgt_ner
    FROM {name}_m)"""


def candidate_ctes(name: str, source: str = "headlines", extra: str = "sentiment") -> str:
    """``name``: the three production candidates per row of ``source``."""
    cols = f"t.sample_id, t.{extra}, t.text AS orig"
    return f"""{REWRITES}, {SYNONYMS},
{synonym_ctes(name + '_s', source, RATIO_QUOTA)},
{numbers_ctes(name + '_n', source)},
{name} AS (
    SELECT {cols}, 0 AS method_ord, 'synonym' AS method, s.pert FROM {source} t
    JOIN {name}_s s USING (sample_id)
    UNION ALL SELECT {cols}, 1, 'rewrite', coalesce(r.rewrite, t.text) FROM {source} t
    LEFT JOIN rewrites r ON t.text = r.orig
    UNION ALL SELECT {cols}, 2, 'numbers', n.pert FROM {source} t
    JOIN {name}_n n USING (sample_id))"""


def library_ctes(source: str = "headlines") -> str:
    return f"{candidate_ctes('cand', source)}, {cascade_ctes('lib', 'cand')}"


def rank_ctes(source: str = "headlines", n_train=K.TRAIN_PER_CLASS, n_test=K.TEST_PER_CLASS,
              n_eval=K.EVAL_PER_CLASS, seed=K.SPLIT_SEED, eval_seed=K.EVAL_SEED) -> str:
    """``split``: train, test and eval rows with ``split`` and ``draw``."""
    need = n_train + n_test
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY sentiment
    ORDER BY {md5(seed, 'sample_id')}, sample_id) AS rk,
    count(*) OVER (PARTITION BY sentiment) AS total FROM {source}),
picks AS (SELECT sentiment, draw, {h60(eval_seed, 'sentiment', 'draw')} % (total - {need})
    + 1 + {need} AS rk FROM (SELECT DISTINCT sentiment, total FROM ranked),
    (SELECT unnest(range({n_eval})) AS draw)),
split AS (SELECT sample_id, sentiment, text, CASE WHEN rk <= {n_test} THEN 'test' ELSE 'train'
    END AS split, NULL::INT AS draw FROM ranked WHERE rk <= {need}
    UNION ALL SELECT r.sample_id, r.sentiment, r.text, 'eval', p.draw::INT FROM ranked r
    JOIN picks p USING (sentiment, rk))"""


def scores_cte(name: str, texts: str) -> str:
    """``name(text, probs)``: the stand-in scorer over ``texts(text)``."""
    e = ", ".join(f"(1 + {h(x, 'text')} % 1000)::DOUBLE" for x in K.REWARD_ORDER)
    return (f"{name} AS (SELECT text, list_transform(e, lambda x: x / list_sum(e)) AS probs "
            f"FROM (SELECT text, [{e}] AS e FROM (SELECT DISTINCT text FROM {texts})))")


SEEDS = PREDS + f""", seed_words AS (SELECT y_true AS label, ' ' || w AS word,
    min(doc_id * 2147483648 + pos - 1) AS ord FROM (SELECT doc_id, unnest({toks('text')}) AS w,
    generate_subscripts({toks('text')}, 1) AS pos FROM documents) d
    JOIN preds p ON d.doc_id = p.sample_id GROUP BY ALL)"""


def variants(w: str) -> str:
    """Spellings in order; DuckDB keeps one capital for the sharp s, Python and Spark write two."""
    def lstrip(x):
        return f"regexp_replace({x}, '^{WHITESPACE}+', '')"
    tried = (f"[{w}, ' ' || {lstrip(w)}, {strip(w)}, lower({w}), upper(replace({w}, 'ß', 'ss')), "
             f"' ' || {lstrip(f'lower({w})')}, "
             f"' ' || regexp_replace({strip(w)}, '{WHITESPACE}+', '-', 'g')]")
    return (f"list_filter({tried}, lambda v, i: list_position({tried}, v) = i)"
            f"[1:{K.MAX_VARIANTS}]")


VOCAB = SEEDS + f""", spelled AS (SELECT DISTINCT unnest({variants('word')}) AS word
    FROM seed_words), vocab AS (SELECT word, CASE WHEN length(word) <= 6
    THEN [({h('a', 'word')} % 50000)::INT] ELSE [({h('b', 'word')} % 50000)::INT,
    ({h('c', 'word')} % 50000)::INT] END AS token_ids FROM spelled)"""

CHOSEN = VOCAB + f""", tried AS (SELECT label, ord, word AS seed, unnest({variants('word')}) AS word,
    generate_subscripts({variants('word')}, 1) AS pos FROM seed_words),
known AS (SELECT t.*, token_ids FROM tried t JOIN vocab USING (word)),
chosen AS (SELECT label, ord, seed, coalesce(
    arg_min({{'word': word, 'ids': token_ids}}, pos) FILTER (len(token_ids) = 1),
    arg_max({{'word': word, 'ids': token_ids}}, pos)) AS c FROM known GROUP BY ALL)"""

VERBALIZER = CHOSEN + """, claims AS (SELECT label, ord, seed, c.word AS word, c.ids AS token_ids,
    c.ids[-1] AS token_id FROM chosen),
verb AS (SELECT label, ord, seed, token_ids, first_ord = ord AS kept, len(token_ids) <> 1 AS multi,
    CASE WHEN first_ord = ord AND len(token_ids) > 1 THEN word || ' (last)' ELSE word END AS word,
    CASE WHEN first_ord = ord THEN token_id END AS token_id,
    CASE WHEN first_ord = ord THEN NULL WHEN len(token_ids) = 1 THEN 'dup_token'
    ELSE 'dup_last_token' END AS reason
    FROM (SELECT *, min(ord) OVER (PARTITION BY label, token_id) AS first_ord FROM claims))"""

VERB_IDS = SEEDS + f""", verb_ids AS (SELECT token_id, arg_min(label, (ord, label)) AS label
    FROM (SELECT *, ({h('v', 'word')} % 64)::INT AS token_id FROM seed_words)
    GROUP BY token_id)"""
