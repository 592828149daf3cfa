"""Perturbation against dictionaries that are tables instead of literals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from steadytext.functions.entities import entity_pattern, entity_types
from steadytext.functions.hashing import digest, draw
from steadytext.functions.text import blanks_only, tokens
from steadytext.operators.frames import compute_once, join_lookup

_KEY = 6          # characters of a name that are joined before the whole name is tested
_RANGES = 64      # ranges of first characters in a pattern
_BITS = 1 << 22
_CELL = 64        # characters per cell when spans meet places
_CUT = "\u0001"    # stands for a word while the text around it is measured


def synonyms_of(lexicon: DataFrame) -> DataFrame:
    """surface -> ordered synonyms of the first sense, without the word itself."""
    entry = F.struct(F.col("ord"), F.translate("synonym", "_", " ").alias("synonym"))
    return (lexicon.filter("sense = 0")
            .filter(F.lower("synonym") != F.lower("surface"))
            .groupBy("surface").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
            .select("surface", F.col("entries.synonym").alias("synonyms")))


def join_synonyms(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Ordered synonyms per word; an unknown word gets an empty array."""
    table = synonyms_of(lexicon).withColumnRenamed("surface", word)
    none = F.array().cast("array<string>")
    return join_lookup(words, table, [word]).select(
        *words.columns, F.coalesce("synonyms", none).alias("synonyms"))


def replace_from_lexicon(rows: DataFrame, lexicon: DataFrame, quota: Column,
                         stop_words: Sequence[str], text: str = "text",
                         id_col: str = "sample_id", seed=0, out: str = "pert") -> DataFrame:
    """Replace all occurrences of up to ``quota`` distinct words that have synonyms.

    Only words that pass a bit table of the lexicon leave the row, with their places, and meet it in
    a join. What was found comes back per (id, text), so repeated rows get the same result, and the
    row's own words are cut at the chosen places. The work grows with the length of a text, not with
    its square, and the shuffles with the words found, not with all words.
    """
    row = ["_id", "_text"]        # short keys: the id and a digest of the text
    usable = synonyms_of(lexicon).filter(F.size("synonyms") > 0).filter(
        ~F.col("surface").isin(list(stop_words))).withColumnRenamed("surface", "word")
    known = known_words(usable, "word")
    keyed = _keyed(rows, id_col, text)
    places = keyed.filter("_id IS NOT NULL AND _text IS NOT NULL").select(
        *row, F.posexplode(tokens(F.col(text))).alias("_at", "word")).filter(known(F.col("word")))
    pick = F.pmod(draw(f"{seed}:pick", "_id", "word"), F.size("synonyms")).cast("int") + 1
    hits = join_lookup(places, usable, ["word"], "inner").select(*row, F.struct(
        F.col("_at").alias("at"), "word", F.element_at("synonyms", pick).alias("synonym")).alias("hit"))
    # bounded by the words of one text; grouped behind the shuffle, where a task's share is bounded
    found = hits.repartition(*row).groupBy(*row).agg(F.collect_set("hit").alias("hits")).select(
        *row, F.sort_array(F.transform("hits", lambda x: F.struct(
            digest(seed, "_id", x["word"]).alias("rank"), x["at"].alias("at"),
            x["synonym"].alias("synonym")))).alias("_hits"))
    ranks = F.array_distinct(F.col("_hits.rank"))
    last = F.get(ranks, F.least(F.coalesce(quota, F.lit(0)), F.size(ranks)) - 1)
    joined = compute_once(keyed.join(found, row, "left"), _last=last)
    marks = F.filter("_hits", lambda x: x["rank"] <= F.col("_last"))
    return _with_words_at(joined, marks, rows.columns, text, out)


def _keyed(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """``rows`` with the id and a digest of the text as ``_id`` and ``_text``."""
    return rows.withColumns({"_id": F.col(id_col), "_text": F.unhex(F.sha2(text, 256))})


def _with_words_at(keyed: DataFrame, marks: Column, columns: Sequence[str], text: str, out: str) -> DataFrame:
    """``columns`` and the text with the words at the places of ``marks(at, synonym)`` replaced.

    Words are joined by one blank. A text without words, or of a row without an id, stays as it is.
    """
    ordered = F.sort_array(F.transform(marks, lambda x: F.struct(
        x["at"].alias("at"), x["synonym"].alias("synonym"))))
    marked = compute_once(keyed, _marks=ordered, _words=tokens(F.col(text)))

    def part(mark, k):      # nulls for the words before a mark
        before = F.coalesce(F.get(F.col("_marks"), k - 1)["at"], F.lit(-1))
        return F.concat(F.array_repeat(F.lit(None).cast("string"), mark["at"] - before - 1),
                        F.array(mark["synonym"]))

    new = F.coalesce(F.flatten(F.transform("_marks", part)), F.array().cast("array<string>"))
    edited = F.array_join(F.zip_with("_words", new, lambda word, x: F.coalesce(x, word)), " ")
    return marked.select(*columns, F.when((F.size("_words") > 0) & F.col("_id").isNotNull(), edited)
                         .otherwise(F.col(text)).alias(out))


def known_words(words: DataFrame, word: str):
    """Function (column) -> whether a word may be among those of the table, tested inside the row.

    A bit table as in ``name_starts``: some words pass that are not in the table, none of it fails.
    """
    n = words.filter(F.col(word).isNotNull()).count()
    bits = min(_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    bit = _bit_of(F.col(word), bits)
    masks = words.filter(F.col(word).isNotNull()).groupBy(F.floor(bit / 64).alias("slot")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)).alias("mask"))
    found = {slot: mask for slot, mask in masks.collect()}
    table = ",".join(str(found.get(i, 0)) for i in range(bits // 64))
    return lambda value: _bit_set(table, _bit_of(value, bits))


@dataclass(frozen=True)
class NameStarts:
    """Where names of a table can begin, in bounded size for any number of names."""

    first: str                  # regex class of first characters
    widths: tuple[int, ...]     # lengths of the keys
    bits: int
    table: str                  # one bit per hash of a key, as whole numbers of 64 bits


def _char_class(points: list[int]) -> str:
    """Regex class of the code points; of many ranges the closest grow together."""
    ranges = []
    for point in sorted(points):
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    gaps = sorted(b[0] - a[1] for a, b in zip(ranges, ranges[1:]))
    least = gaps[-_RANGES] if len(gaps) >= _RANGES else 0
    kept = ranges[:1]
    for low, high in ranges[1:]:
        if low - kept[-1][1] <= least:
            kept[-1][1] = high
        else:
            kept.append([low, high])
    return "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in kept)


def name_starts(names: DataFrame, name: str = "a") -> NameStarts | None:
    """First characters, key lengths and a bit table of the keys; None for no names.

    The table has 16 bits or more a name, up to 2^22: beyond some 100,000 names it
    lets more places through, which the join then sorts out. The driver gets set bits only,
    as numbers of 64, never names.
    """
    keys = names.where(F.col(name) != "").select(F.substring(name, 1, _KEY).alias("key"))
    n = keys.count()
    if not n:
        return None
    bits = min(_BITS, max(1 << 10, 1 << (16 * n).bit_length()))
    values = F.array(F.ascii("key"), _bit_of(F.col("key"), bits), F.char_length("key"))
    marks = keys.select(F.posexplode(values).alias("kind", "value")).groupBy(
        "kind", F.floor(F.col("value") / 64).alias("slot")).agg(F.bit_or(F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.col("value") % 64)).alias("mask"))
    found: dict[int, dict[int, int]] = {0: {}, 1: {}, 2: {}}
    for kind, slot, mask in marks.collect():
        found[kind][slot] = mask

    def members(kind: int) -> list[int]:
        return [64 * slot + i for slot, mask in found[kind].items() for i in range(64) if mask >> i & 1]

    table = ",".join(str(found[1].get(i, 0)) for i in range(bits // 64))
    return NameStarts(_char_class(members(0)), tuple(sorted(members(2))), bits, table)


def _bit_of(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)).cast("int")


def _bit_set(table: str, bit: Column) -> Column:
    masks = F.split(F.lit(table), ",").cast("array<bigint>")    # folded into a constant
    return F.getbit(F.get(masks, F.shiftright(bit, 6)), bit.bitwiseAND(63)) == 1


def possible_keys(text: Column, starts: NameStarts) -> Column:
    """The different beginnings of names that a text may hold, tested inside the row.

    Only places with a first character of some name are cut out, and of those only keys
    whose bit is set are kept.
    """
    # a lookahead steps through the text once; substrings by place would count from its start
    windows = F.regexp_extract_all(text, F.lit(f"(?s)(?=([{starts.first}].{{0,{_KEY - 1}}}))"), F.lit(1))
    widths = F.array(*[F.lit(w) for w in starts.widths])

    def known(key):
        return _bit_set(starts.table, _bit_of(key, starts.bits))

    keys = F.transform(windows, lambda x: F.filter(
        F.transform(widths, lambda w: F.substring(x, F.lit(1), w)), known))
    return F.array_distinct(F.flatten(keys))


def names_in(texts: DataFrame, names: DataFrame, text: str = "_whole", key: str = "_text",
             name: str = "a") -> DataFrame:
    """Rows of ``names`` with the ``key`` and ``text`` of every text that contains the name.

    ``texts`` has one row per key. Containment becomes an equi-join on the first characters of
    a name, verified afterwards, so names never meet every text and only places where a name
    can begin leave the row. Null and empty names are in no text.
    """
    starts = name_starts(names, name)
    if starts is None:
        kept = [texts.schema[key], *names.schema.fields, texts.schema[text]]
        return texts.sparkSession.createDataFrame([], StructType(kept))
    keyed = names.where(F.col(name) != "").withColumn("_gram", F.substring(name, 1, _KEY))
    found = texts.select(key, F.explode(possible_keys(F.col(text), starts)).alias("_gram"))
    # join digests and keys only; the text comes back for the candidates
    pairs = join_lookup(found, keyed, ["_gram"], "inner").drop("_gram").distinct()
    return pairs.join(texts.select(key, text), key).filter(F.contains(F.col(text), F.col(name)))


def _distinct_texts(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(F.sha2(text, 256).alias("_text"), F.col(text).alias("_whole")) \
        .filter("_text IS NOT NULL").dropDuplicates(["_text"])


def first_peer(rows: DataFrame, peers: DataFrame, text: str = "text") -> DataFrame:
    """Lowest-``ord`` peer whose name is a substring of the text, per row, and its replacement.

    ``peers(ord, a, b)`` may be of any size. The answer belongs to the text, so every distinct
    text is searched once, known by its digest, and rows need no id.
    ``functions.text.swap_peer`` does the same for names given as literals.
    """
    hits = names_in(_distinct_texts(rows, text), peers.select("ord", "a", "b"))
    best = hits.groupBy("_text").agg(F.min(F.struct("ord", "a", "b")).alias("_peer"))
    return join_lookup(rows.withColumn("_text", F.sha2(text, 256)), best, ["_text"]).select(
        *rows.columns, F.col("_peer.a").alias("peer"), F.col("_peer.b").alias("replacement"))


def swap_first_peer(rows: DataFrame, peers: DataFrame, text: str = "text",
                    out: str = "pert") -> DataFrame:
    """Replace the first occurrence of the peer that ``first_peer`` finds; other texts stay."""
    found = first_peer(rows, peers, text)
    swapped = F.overlay(F.col(text), F.col("replacement"),
                        F.position(F.col("peer"), F.col(text)), F.char_length("peer"))
    return found.select(*rows.columns, F.coalesce(swapped, F.col(text)).alias(out))


def entity_types_from(rows: DataFrame, names: DataFrame, text: str = "text",
                      out: str = "entity_types") -> DataFrame:
    """Sorted entity types of every text, with names from a table ``(name, type)`` of any size.

    Figures are found by patterns as in ``functions.entities``; a type counts if one of its
    names is a substring of the text.
    """
    found = names_in(_distinct_texts(rows, text), names.select("name", "type"), name="name") \
        .groupBy("_text").agg(F.collect_set("type").alias("_types"))
    joined = join_lookup(rows.withColumn("_text", F.sha2(text, 256)), found, ["_text"])
    figures = entity_types(F.col(text), {})
    every = F.sort_array(F.array_distinct(F.concat(figures, F.coalesce(
        "_types", F.array().cast("array<string>")))))
    return joined.select(*rows.columns, F.when(F.col(text).isNotNull(), every).alias(out))


def name_spans(texts: DataFrame, names: DataFrame, pattern: str | None = None) -> DataFrame:
    """(_text, start, stop): where names of the table and matches of ``pattern`` stand in each text.

    ``texts(_text, _whole)`` has one row per key, ``names(name)`` any size. Occurrences of one name are
    taken from left to right without overlap. Places count characters from 0.
    """
    hits = names_in(texts, names.select("name").distinct(), name="name")
    quoted = F.concat(F.lit(r"\Q"), F.replace("name", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    # lengths leave the row, the text does not
    gap_sizes = F.transform(F.split("_whole", quoted, -1), F.char_length)
    parts = hits.select("_text", "name", F.posexplode(gap_sizes).alias("i", "gap"),
                        F.char_length("name").alias("width"))
    if pattern:
        whole = F.col("_whole")
        held = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
        both = F.arrays_zip(F.transform(F.split(whole, pattern, -1), F.char_length).alias("gap"),
                            F.transform(held, F.char_length).alias("span"))
        parts = parts.unionByName(texts.select("_text", F.posexplode(both).alias("i", "p")).select(
            "_text", F.lit(None).cast("string").alias("name"), "i", F.col("p.gap").alias("gap"),
            F.col("p.span").alias("width")))
    # running over the parts of one text around one name
    upto = Window.partitionBy("_text", "name").orderBy("i")
    gaps = F.sum("gap").over(upto)
    before = F.coalesce(F.sum("width").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("i").over(upto).isNull()      # what follows the last occurrence
    spans = parts.select("_text", "width", (gaps + before).alias("start"), last.alias("last"))
    return spans.where("NOT last AND width > 0").select(
        "_text", "start", (F.col("start") + F.col("width")).alias("stop"))


def _in_cells(df: DataFrame) -> DataFrame:
    """One row per cell that start..stop reaches into."""
    cells = F.sequence(F.floor(F.col("start") / _CELL), F.floor((F.col("stop") - 1) / _CELL))
    return df.withColumn("cell", F.explode(cells))


def replace_forms_guarded_from(rows: DataFrame, lexicon: DataFrame, names: DataFrame, max_repl: int = 2,
                               text: str = "text", id_col: str = "sample_id", seed=0,
                               out: str = "pert", figures: bool = True) -> DataFrame:
    """Replace up to ``max_repl`` words with synonyms, none of them inside an entity.

    A word is a whitespace token whose lower-cased form is in ``lexicon``. It is left alone if it
    overlaps an occurrence of a name of ``names(name)`` or, with ``figures``, a percentage or sum of
    money. Both tables may be of any size. Words meet spans in an equi-join on the text's digest and
    the cell of the place, verified. Words are joined by one blank; a text without words stays.
    Rows with the same id and text get the same result; null ids and texts stay as they are.
    """
    row = ["_id", "_text"]
    usable = synonyms_of(lexicon).filter(F.size("synonyms") > 0).withColumnRenamed("surface", "form")
    known = known_words(usable, "form")
    keyed = _keyed(rows, id_col, text)
    cut = _likely_words(F.split(blanks_only(F.col(text)), " ", -1), known)
    likely = keyed.filter("_id IS NOT NULL AND _text IS NOT NULL").select(*row, cut.alias("_likely")) \
        .filter(F.size("_likely") > 0).repartition(*row).dropDuplicates(row)
    # the place where each begins, and its number among the words: running over one text's likely words
    upto = Window.partitionBy(*row).orderBy("_i")
    places = likely.select(*row, F.posexplode("_likely").alias("_i", "w")).select(
        *row, "_i", "w.word", "w.chars", "w.words").withColumns({
            "start": F.sum(F.col("chars") + F.char_length("word")).over(upto) - F.char_length("word"),
            "at": (F.sum(F.col("words") + 1).over(upto) - 1).cast("int")})
    hits = join_lookup(places.withColumn("form", F.lower("word")), usable, ["form"], "inner") \
        .withColumn("stop", F.col("start") + F.char_length("word"))
    once = keyed.filter("_text IS NOT NULL").select("_text", F.col(text).alias("_whole")).dropDuplicates(["_text"])
    spans = _in_cells(name_spans(once, names, entity_pattern({}) if figures else None))
    inside = _in_cells(hits.select(*row, "at", "start", "stop")).join(
        spans.select("_text", "cell", F.col("start").alias("low"), F.col("stop").alias("high")),
        ["_text", "cell"]).where("start < high AND low < stop").select(*row, "at").distinct()
    first = Window.partitionBy(*row).orderBy("rank", "at")
    free = hits.join(inside, [*row, "at"], "left_anti").withColumn("rank", digest(seed, "_id", "at")) \
        .withColumn("n", F.row_number().over(first)).where(F.col("n") <= max_repl)
    pick = F.pmod(draw(f"{seed}:pick", "_id", "at"), F.size("synonyms")).cast("int") + 1
    chosen = free.select(*row, F.struct("at", F.element_at("synonyms", pick).alias("synonym")).alias("mark")) \
        .groupBy(*row).agg(F.collect_list("mark").alias("_marks"))
    return _with_words_at(keyed.join(chosen, row, "left"), F.col("_marks"), rows.columns, text, out)


def _likely_words(parts: Column, known) -> Column:
    """Words of a text cut at blanks that may be forms of the lexicon.

    Each with the number of characters and words between it and the one before.
    """
    def marked(pair):
        return F.array_join(F.zip_with(pair["parts"], pair["likely"], lambda w, x: F.when(
            x.isNotNull(), _CUT).when(F.contains(w, F.lit(_CUT)), F.translate(w, _CUT, "-")).otherwise(w)), " ")

    def found(pair):
        gaps = F.transform(F.split(marked(pair), _CUT, -1), lambda gap: F.struct(
            F.char_length(gap).alias("chars"), F.size(F.array_remove(F.split(gap, " "), "")).alias("words")))
        return F.zip_with(F.array_compact(pair["likely"]), gaps, lambda w, gap: F.struct(
            w.alias("word"), gap["chars"].alias("chars"), gap["words"].alias("words")))

    def likely(p):
        return F.struct(p.alias("parts"), F.transform(
            p, lambda w: F.when((w != "") & known(F.lower(w)), w)).alias("likely"))

    # what follows the last word has none
    pairs = F.transform(F.transform(F.array(parts), likely), found)
    return F.filter(F.element_at(pairs, 1), lambda x: x["word"].isNotNull())
