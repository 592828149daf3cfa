"""Candidate library: generate, filter, tag, pair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from steadytext import constants as K
from steadytext import dictionaries as D
from steadytext.functions import probs, text as X
from steadytext.functions.entities import entity_types
from steadytext.functions.similarity import cosine, token_cosine
from steadytext.operators.frames import compute_once, distinct_texts, even_parts, join_by_text
from steadytext.operators.joins import external_rewrite, first_pert, join_pairs, lookup_label
from steadytext.operators.scoring import Loader, embed_text, score_distinct

PRODUCTION_METHODS = ("synonym", "rewrite", "numbers")
PROTOTYPE_METHODS = ("synonym_dict", "template", "numbers")
METHOD_ORDER = ("synonym", "synonym_dict", "rewrite", "template", "numbers")


@dataclass(frozen=True)
class LibraryConfig:
    methods: Sequence[str] = PRODUCTION_METHODS
    sim_threshold: float = K.SIM_THRESHOLD
    length_ratio: float = K.LENGTH_RATIO
    margin_drop: float = K.MARGIN_DROP
    synonym_ratio: float = K.SYNONYM_RATIO
    drop_identity: bool = False
    seed: int = 0
    synonyms: Mapping[str, Sequence[str]] = field(default_factory=lambda: D.SURFACE_SYNONYMS)
    stop_words: Sequence[str] = field(default_factory=lambda: D.STOP_WORDS)
    peers: Sequence[tuple[str, str]] = field(default_factory=lambda: K.SECTOR_PEERS)
    gazetteer: Mapping[str, Sequence[str]] = field(default_factory=lambda: D.GAZETTEER)
    label_order: Sequence[str] = K.REWARD_ORDER


DEFAULT = LibraryConfig()


def candidates(rows: DataFrame, config: LibraryConfig = DEFAULT,
               rewrites: DataFrame | None = None, text: str = "text",
               id_col: str = "sample_id") -> DataFrame:
    """One row per text and method: ``orig, method_ord, method, pert``."""
    return _made(_with_rewrites(rows, config, rewrites, text), config, text, id_col)


def _with_rewrites(rows: DataFrame, config: LibraryConfig, rewrites: DataFrame | None, text: str) -> DataFrame:
    """The rows with the supplied rewrite, if the method is asked for."""
    if "rewrite" not in config.methods:
        return rows
    return (rows.withColumn("_rewrite_text", F.col(text)) if rewrites is None
            else even_parts(external_rewrite(rows, rewrites, text, "_rewrite_text")))


def _made(rows: DataFrame, config: LibraryConfig, text: str, id_col: str) -> DataFrame:
    """Candidates of rows that have their rewrites, and maybe the facts of the source.

    Spark interprets a step that holds a lambda function, with all else in it, and compiles the
    others. So edits with such functions come first, in a step of their own.
    """
    t, key = F.col(text), F.col(id_col)
    edits = {
        "synonym": lambda: X.replace_synonyms_ratio(
            t, key, config.synonyms, config.stop_words, config.synonym_ratio, config.seed,
            F.col("_src_tokens") if "_src_tokens" in rows.columns else None),
        "synonym_dict": lambda: X.replace_forms(t, key, config.synonyms, 2, config.seed),
        "template": lambda: X.template_paraphrase(t),
        "numbers": lambda: X.jitter_percents(t, key, config.seed),
    }
    source, perts = rows, {m: F.col(f"_made_{m}") for m in config.methods} | {"rewrite": F.col("_rewrite_text")}
    edited = {f"_made_{m}": edits[m]() for m in config.methods if m in edits}
    if edited:
        source = compute_once(source, **edited)
    if "numbers" in config.methods:     # with the step above, X.perturb_numbers_entities
        moved = perts["numbers"]
        source = compute_once(source, _peer=X.peer_index(moved, config.peers))
        perts["numbers"] = X.swap_peer_at(moved, F.col("_peer"), config.peers)
    made = [F.struct(F.lit(i).alias("method_ord"), F.lit(m).alias("method"), perts[m].alias("pert"))
            for i, m in enumerate(config.methods)]
    kept = [c for c in rows.columns if c not in (text, "_rewrite_text")]
    out = source.select(*kept, t.alias("orig"), F.inline(F.array(*made)))
    if config.drop_identity:
        out = out.filter(X.strip(F.col("pert")) != X.strip(F.col("orig")))
    return out


_SOURCE_FACTS = ("_src_tokens", "_src")


def _with_source_facts(df: DataFrame, text: Column, config: LibraryConfig) -> DataFrame:
    """Tokens and entity types of the source text, computed once per row."""
    return compute_once(df, _src_tokens=X.tokens(text),
                        _src=entity_types(text, config.gazetteer))


def cascade(pairs: DataFrame, config: LibraryConfig = DEFAULT, sim: Column | None = None,
            orig: str = "orig", pert: str = "pert") -> DataFrame:
    """Similarity, then length, then entity types; the first failure decides the details.

    ``len_ok`` is set (false) only on a length failure, ``ner_ok``, ``src_ner`` and
    ``tgt_ner`` only on an entity failure. Supply ``sim`` to use vectors instead of
    token counts.
    """
    a, b = F.col(orig), F.col(pert)
    ready = pairs if "_src_tokens" in pairs.columns else _with_source_facts(pairs, a, config)
    # an unchanged text is not taken apart again
    ready = compute_once(
        ready, _tgt_tokens=F.when(a == b, F.col("_src_tokens")).otherwise(X.tokens(b)),
        _tgt=F.when(a == b, F.col("_src")).otherwise(entity_types(b, config.gazetteer)))
    x, y = F.col("_src_tokens"), F.col("_tgt_tokens")
    if sim is None:
        # equal texts need no folding of tokens, unless they have none
        sim = F.when((a == b) & (F.size(x) > 0), F.lit(1.0)).otherwise(token_cosine(x, y))
    measured = compute_once(ready, sim=sim, _change=X.size_change(x, y))
    kept = [c for c in pairs.columns if c not in _SOURCE_FACTS]
    sim_ok = F.col("sim") >= config.sim_threshold
    len_ok = F.col("_change") <= config.length_ratio
    ner_ok = F.col("_src") == F.col("_tgt")
    ner_failed = sim_ok & len_ok & ~ner_ok
    return measured.select(
        *kept,
        F.coalesce(sim_ok & len_ok & ner_ok, F.lit(False)).alias("passed"),
        "sim",
        F.when(sim_ok & ~len_ok, F.lit(False)).alias("len_ok"),
        F.when(ner_failed, F.lit(False)).alias("ner_ok"),
        F.when(ner_failed, F.col("_src")).alias("src_ner"),
        F.when(ner_failed, F.col("_tgt")).alias("tgt_ner"))


def label_margins(scored: DataFrame, order: Sequence[str] = K.REWARD_ORDER,
                  p: str = "probs") -> DataFrame:
    """Add ``label`` and ``margin`` of a probability array."""
    return scored.select("*", probs.argmax_label(F.col(p), order).alias("label"),
                         probs.margin(F.col(p)).alias("margin"))


def _margins_for(scored: DataFrame, config: LibraryConfig, text: str, label: str,
                 margin: str) -> DataFrame:
    return label_margins(scored, config.label_order).select(
        F.col("text").alias(text), F.col("label").alias(label), F.col("margin").alias(margin))


def _tagged(library: DataFrame, columns: Sequence[str], scored: DataFrame,
            config: LibraryConfig) -> DataFrame:
    joined = join_by_text(library, _margins_for(scored, config, "pert", "_y1", "_m1"), "pert")
    ok = F.col("passed")
    return joined.select(
        *columns,
        F.when(ok, F.col("_y0")).alias("orig_label"),
        F.when(ok, F.col("_y1")).alias("pert_label"),
        F.when(ok, F.col("_y0") != F.col("_y1")).alias("flipped"),
        F.when(ok, F.col("_m0") - F.col("_m1") >= config.margin_drop).alias("weakened"),
        F.when(ok, F.col("_m0")).alias("m0"),
        F.when(ok, F.col("_m1")).alias("m1"))


def adversarial_tags(library: DataFrame, scored: DataFrame,
                     config: LibraryConfig = DEFAULT) -> DataFrame:
    """Label flip and margin drop of passed rows; null for the others.

    ``scored(text, probs)`` holds one row per distinct text.
    """
    sourced = join_by_text(library, _margins_for(scored, config, "orig", "_y0", "_m0"), "orig")
    return _tagged(sourced, library.columns, scored, config)


def build_library(rows: DataFrame, config: LibraryConfig = DEFAULT,
                  rewrites: DataFrame | None = None, scored: DataFrame | None = None,
                  text: str = "text", id_col: str = "sample_id") -> DataFrame:
    """All candidates of all rows with filter results, and tags if scores are given."""
    def filtered(sourced):
        # tokens and types are made after the joins, which need not shuffle them
        ready = _with_source_facts(_with_rewrites(sourced, config, rewrites, text), F.col(text), config)
        return cascade(_made(ready, config, text, id_col), config)

    if scored is None:
        return filtered(rows)
    # the source's score joins the rows, before each becomes several candidates
    out = filtered(join_by_text(rows, _margins_for(scored, config, text, "_y0", "_m0"), text))
    plain = [c for c in out.columns if c not in ("_y0", "_m0")]
    return _tagged(out, plain, scored, config)


def build_scored_library(rows: DataFrame, loader: Loader, store,
                         config: LibraryConfig = DEFAULT, rewrites: DataFrame | None = None,
                         model_order: Sequence[str] = K.SCORER_ORDER, text: str = "text",
                         id_col: str = "sample_id") -> DataFrame:
    """Candidates, filters, and tags of those that pass, by a model that scores only those.

    Candidates are made once: ``store`` (DataFrame -> DataFrame, for instance a write
    to shared storage and a read) keeps the filtered library before its texts are scored.
    """
    library = store(build_library(rows, config, rewrites, None, text, id_col))
    passed = library.filter("passed")
    texts = passed.select(F.explode(F.array("orig", "pert")).alias("text"))
    names = F.array(*[F.lit(x) for x in model_order])
    # one row per text, told apart and scored by digest
    scored = score_distinct(texts, loader, "text", "_raw").select("text", probs.reorder(
        F.map_from_arrays(names, F.col("_raw")), config.label_order).alias("probs"))
    return adversarial_tags(library, scored, config)


def cascade_by_vectors(pairs: DataFrame, encoder: Loader, config: LibraryConfig = DEFAULT,
                       orig: str = "orig", pert: str = "pert") -> DataFrame:
    """``cascade`` with the cosine of sentence vectors; each text is encoded once per column."""
    both = embed_text(embed_text(pairs, encoder, orig, "_va"), encoder, pert, "_vb")
    sim = compute_once(both, _sim=cosine(F.col("_va"), F.col("_vb")))
    out = cascade(sim.drop("_va", "_vb"), config, F.col("_sim"), orig, pert)
    return out.drop("_sim")


def readable_and_similar(pairs: DataFrame, sim: Column | None = None, orig: str = "orig",
                         pert: str = "pert", threshold: float = K.SIM_THRESHOLD,
                         chars: int = K.READABLE_CHARS) -> DataFrame:
    """Add ``passed``: the candidate is short enough to read and similar enough."""
    a, b = F.col(orig), F.col(pert)
    sim = token_cosine(X.tokens(a), X.tokens(b)) if sim is None else sim
    return pairs.withColumn("passed", (F.char_length(b) <= chars) & (sim >= threshold))


def passed_pairs(library: DataFrame, only_passed: bool = True,
                 drop_duplicates: bool = True) -> DataFrame:
    kept = library.filter("passed") if only_passed else library
    pairs = kept.select("orig", "pert")
    return distinct_texts(pairs, "orig", "pert") if drop_duplicates else pairs


def clean_rows(rows: DataFrame) -> DataFrame:
    """Rows in training shape: their own text as source and counterpart."""
    return rows.select("text", "sentiment", F.col("text").alias("orig_text"),
                       F.col("text").alias("pert_text"))


def augment_train(train: DataFrame, library: DataFrame) -> DataFrame:
    """Clean training rows plus passed candidates with the label of their source."""
    extra = lookup_label(passed_pairs(library), train).select(
        F.col("pert").alias("text"), "sentiment", F.col("orig").alias("orig_text"),
        F.col("pert").alias("pert_text"))
    return clean_rows(train).unionByName(extra)


def clean_and_pert_test(test: DataFrame, library: DataFrame) -> DataFrame:
    """Test prompts of both variants with their labels, in a ``variant`` column."""
    pert = lookup_label(passed_pairs(library), test).select(F.col("pert").alias("text"),
                                                            "sentiment")
    both = test.select("text", "sentiment", F.lit("clean").alias("variant")).unionByName(
        pert.withColumn("variant", F.lit("perturbed")))
    return both.select("variant", "text", X.eval_prompt(F.col("text")).alias("prompt"),
                       F.col("sentiment").alias("y_true"))


def clean_pert_pairs(test: DataFrame, library: DataFrame) -> DataFrame:
    """Aligned pairs: every test row that has a passed candidate, with its first one."""
    pairs = join_pairs(test, first_pert(library.filter("passed")))
    return pairs.select("sample_id", F.col("sentiment").alias("y_true"), "text", "pert",
                        X.eval_prompt(F.col("text")).alias("clean_prompt"),
                        X.eval_prompt(F.col("pert")).alias("pert_prompt"))


def library_profile(train: DataFrame, library: DataFrame) -> DataFrame:
    """Rows per class before and after expansion."""
    clean = train.groupBy("sentiment").agg(F.count("*").alias("n")).withColumn(
        "variant", F.lit("clean"))
    full = augment_train(train, library).groupBy("sentiment").agg(
        F.count("*").alias("n")).withColumn("variant", F.lit("expanded"))
    return clean.unionByName(full)


def pass_rates(library: DataFrame) -> DataFrame:
    """Candidates and pass rate per method."""
    return library.groupBy("method").agg(
        F.count("*").alias("n"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))
