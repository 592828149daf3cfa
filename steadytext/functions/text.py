"""Tokens, prompts and text edits as native column expressions."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from steadytext import constants as K
from steadytext.functions.hashing import digest, draw

# All characters a whitespace split cuts on. Spelled out, because the regex
# class "\s" covers ASCII only.
_SPACES = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
           r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WHITESPACE = f"[{_SPACES}]"
_OTHER_SPACES = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# The same as a class, and the blank; outside the first ranges, letters and digits fail at once.
_RARE_SPACE = rf"[\x00-\x1f\x7f-\x{{ffff}}&&[{_SPACES}]]"
_PERCENT = rf"(\d+\.?\d*){WHITESPACE}?%"
# One percentage with the text before it, starting where the last match ended.
_TO_PERCENT = rf"(?sU)\G(.*?){_PERCENT}"
# Private-use character standing for a protected span while the rest is edited.
_HOLE = "\ue000"


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` can use it many times
    while it is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def blanks_only(text: Column) -> Column:
    """The text with every whitespace character turned into a blank."""
    return F.regexp_replace(text, _RARE_SPACE, " ")


def tokens(text: Column) -> Column:
    """Whitespace tokens; empty and blank texts give an empty array.

    All whitespace becomes blanks first: splitting at one plain character needs
    no regex, which a split would compile anew for every row.
    """
    return F.array_remove(F.split(blanks_only(text), " "), "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"{WHITESPACE}+$", "")


def content_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Tokens that are not stop words; the test is case-sensitive."""
    return F.filter(tokens(text), lambda t: ~t.isin(list(stop_words)))


def text_or_nan(text: Column) -> Column:
    """String cast in which a missing text becomes ``'nan'``."""
    return F.coalesce(text.cast("string"), F.lit("nan"))


# ---------------------------------------------------------------- prompts

def train_prompt(text: Column, label: Column) -> Column:
    return F.concat(F.lit(K.PROMPT_HEAD), text, rstrip(F.concat(F.lit("] = "), label)))


def eval_prompt(text: Column) -> Column:
    return F.concat(F.lit(K.PROMPT_HEAD), text, F.lit("] ="))


def causal_prompt(text: Column) -> Column:
    return F.concat(F.lit("Text: "), text, F.lit("\nSentiment:"))


def chat_prompt(text: Column) -> Column:
    """One user message, as an array of (role, content)."""
    content = F.concat(F.lit(K.CHAT_INSTRUCTION + "Text: "), text,
                       F.lit("\nAnswer one word: Sentiment:"))
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


# ------------------------------------------------------- length comparison

def size_change(before: Column, after: Column) -> Column:
    """Relative change of the number of tokens."""
    n = F.size(before)
    return F.abs(F.size(after) - n) / F.greatest(F.lit(1), n)


def length_change(orig: Column, new: Column) -> Column:
    """Relative change of the word count."""
    return size_change(tokens(orig), tokens(new))


def guard_length(orig: Column, new: Column,
                 max_delta: float = K.PARAPHRASE_LENGTH_DELTA) -> Column:
    """``new`` unless it changes the word count by more than ``max_delta``."""
    return F.when(length_change(orig, new) > max_delta, orig).otherwise(new)


def guard_polarity(orig: Column, new: Column, orig_label: Column, new_label: Column) -> Column:
    """``new`` only if both labels are known and equal."""
    return F.when(orig_label == new_label, new).otherwise(orig)


# ------------------------------------------------------------- paraphrase

def _needles(pattern: str) -> list[str]:
    """Lower-case strings of which every match of the pattern holds one; none if that is not plain to see.

    For words between two word boundaries, with single letters left open and groups of words.
    """
    if not re.fullmatch(r"\\b(?:[A-Za-z ]|[A-Za-z]\?|\([A-Za-z |]+\))+\\b", pattern):
        return []
    words = re.sub(r"[a-z]\?", ")(", pattern[2:-2].lower())
    longest = max(re.split(r"\([^()]*\)|\)\(", words), key=len)
    group = re.search(r"\(([^()]+)\)", words)
    return [longest] if longest.strip() else group[1].split("|") if group else []


def _apply_rule(text: Column, pattern: str, replacement: str) -> Column:
    """One rule. An ASCII text that holds no needle of it is left alone without a regex."""
    def applied(t):
        return F.regexp_replace(t, "(?iU)" + pattern, replacement)

    needles = _needles(pattern)
    if not needles:
        return applied(text)

    def tried(t):
        held = _let(F.lower(t), lambda low: functools.reduce(
            operator.or_, [F.contains(low, F.lit(n)) for n in needles]))
        return F.when(held | (F.octet_length(t) != F.char_length(t)), applied(t)).otherwise(t)

    return _let(text, tried)


def paraphrase_rules(text: Column, rules=None, adverb: str = K.SOFTENING_ADVERB) -> Column:
    """Apply the ordered regex rules, each to the output of the one before."""
    out = text
    for pattern, replacement in (K.PARAPHRASE_RULES if rules is None else rules):
        # rule texts use "\1" for the matched word, Java uses "$1"
        java = replacement.replace("{adv}", adverb).replace("\\1", "$1")
        out = _apply_rule(out, pattern, java)
    return out


def template_paraphrase(text: Column, max_delta: float = K.PARAPHRASE_LENGTH_DELTA) -> Column:
    return _let(paraphrase_rules(text), lambda new: guard_length(text, new, max_delta))


# ---------------------------------------------------------------- numbers

_TAIL = 32   # integer digits that decimal arithmetic looks at; a carry or borrow goes on in the text


def _one_more(digits: Column) -> Column:
    """The whole number written as ``digits`` plus one: nines at the end turn to zeros."""
    kept = F.rtrim(digits, F.lit("9"))
    zeros = F.repeat(F.lit("0"), F.char_length(digits) - F.char_length(kept))
    last = F.translate(F.right(kept, F.lit(1)), "012345678", "123456789")
    return F.concat(F.when(kept == "", F.lit("1")).otherwise(F.concat(
        F.substring(kept, F.lit(1), F.char_length(kept) - 1), last)), zeros)


def _one_less(digits: Column) -> Column:
    """``digits``, a whole number above zero, minus one: zeros at the end turn to nines."""
    kept = F.rtrim(digits, F.lit("0"))
    nines = F.repeat(F.lit("9"), F.char_length(digits) - F.char_length(kept))
    last = F.translate(F.right(kept, F.lit(1)), "123456789", "012345678")
    return F.concat(F.substring(kept, F.lit(1), F.char_length(kept) - 1), last, nines)


def _moved_tenths(number: Column, step: Column) -> Column:
    """``_moved`` in whole tenths, for up to 15 characters with one decimal or none; others give null."""
    whole = F.substring_index(number, ".", 1)
    tenth = F.rpad(F.substring(number, F.char_length(whole) + 2, F.char_length(number)), 1, "0")
    short = (F.char_length(number) <= 15) & (F.char_length(number) <= F.char_length(whole) + 2)
    tenths = F.when(short, F.concat(whole, tenth).try_cast("long")) + (step * 10).cast("long")
    return (tenths.cast("decimal(17,0)") * F.lit("0.1").cast("decimal(1,1)")).cast("string")


def _moved(number: Column, step: Column) -> Column:
    """``number``, digits with at most one point, moved by ``step`` and rounded once, half up.

    Four decimals and one more digit that says whether others follow are enough to round
    exactly. The last 32 integer digits move as a decimal; a carry into the digits before
    them, or a borrow, is written out there, so figures of any length move exactly.
    """
    whole = F.ltrim(F.substring_index(number, ".", 1), F.lit("0"))
    decimals = F.substring(number, F.char_length(F.substring_index(number, ".", 1)) + 2, F.char_length(number))
    more = F.when(F.substring(decimals, F.lit(5), F.char_length(number)).rlike("[1-9]"), "1") \
        .otherwise("0")
    head = F.substring(whole, F.lit(1), F.greatest(F.char_length(whole) - _TAIL, F.lit(0)))
    tail = F.substring(whole, F.char_length(head) + 1, F.char_length(whole))
    value = F.concat(F.lit("0"), tail, F.lit("."), F.rpad(F.substring(decimals, 1, 4), 4, "0"), more) \
        .try_cast("decimal(38,5)")
    limit = F.lit("1" + "0" * _TAIL).cast("decimal(38,1)")

    def rounded(v):
        return F.round(v, 1).cast("decimal(38,1)")

    def with_head(front, back):
        text = F.concat(front, F.lpad(back.cast("decimal(38,1)").cast("string"), _TAIL + 2, "0"))
        return F.regexp_replace(text, "^0+(?=[0-9])", "")

    def written(v):
        there, below = rounded(v + step), rounded(v + step + limit)
        return F.when(head == "", there.cast("string")) \
            .when(v + step < 0, F.when(below < limit, with_head(_one_less(head), below))
                  .otherwise(with_head(head, below - limit))) \
            .when(there >= limit, with_head(_one_more(head), there - limit)) \
            .otherwise(with_head(head, there))

    return F.coalesce(_let(value, written), number)


def jitter_percents(text: Column, key: Column, seed=0) -> Column:
    """Move every percentage by 0.1 or 0.2 either way, keeping one decimal.

    Decimal arithmetic, rounding half up, for figures of any length.
    """
    steps = F.array(*[F.lit(d).cast("decimal(2,1)") for d in ("-0.2", "-0.1", "0.1", "0.2")])

    def moved(number, position):
        pick = F.pmod(draw(seed, key, position), F.lit(4)).cast("int") + 1
        step = _let(pick, lambda i: F.element_at(steps, i))
        return _let(F.struct(number.alias("number"), step.alias("step")), lambda n: F.concat(
            F.coalesce(_moved_tenths(n["number"], n["step"]), _moved(n["number"], n["step"])), F.lit("%")))

    def part(group):
        return F.regexp_extract_all(text, F.lit(_TO_PERCENT), F.lit(group))

    figures = F.transform(part(2), moved)
    changed = F.array_join(F.zip_with(part(1), figures, lambda gap, figure: F.concat(gap, figure)),
                           "")
    rest = F.substring(text, F.char_length(F.array_join(part(0), "")) + 1, F.char_length(text))

    def only(found):
        # the only match: its characters stand nowhere else, or there would be another
        number = F.regexp_replace(F.rtrim(found, F.lit("%")), f"{WHITESPACE}$", "")
        return F.replace(text, found, moved(number, F.lit(0)))

    matches = F.regexp_extract_all(text, F.lit(f"(?U){_PERCENT}"), F.lit(0))
    return F.when(F.contains(text, F.lit("%")), _let(matches, lambda m: F.when(
        F.size(m) == 1, only(F.get(m, F.lit(0)))).when(F.size(m) > 1, F.concat(changed, rest)).otherwise(text))) \
        .otherwise(text)


# ------------------------------------------------------------------ peers

def peer_index(text: Column, peers=K.SECTOR_PEERS, whole_word: bool = False) -> Column:
    """1-based position of the first peer name contained in ``text``, else null."""
    chain = None
    for i, (name, _) in enumerate(peers, start=1):
        hit = F.contains(text, F.lit(name))
        if whole_word:
            hit = hit & text.rlike(rf"(?U)(?<!\w)\Q{name}\E(?!\w)")
        chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
    return chain


def swap_peer(text: Column, peers=K.SECTOR_PEERS, whole_word: bool = False) -> Column:
    """Replace the first occurrence of the first listed peer name found."""
    return _let(peer_index(text, peers, whole_word), lambda i: swap_peer_at(text, i, peers, whole_word))


def swap_peer_at(text: Column, index: Column, peers=K.SECTOR_PEERS, whole_word: bool = False) -> Column:
    """``swap_peer`` with the ``peer_index`` of the text at hand."""
    names, others = _strings([a for a, _ in peers]), _strings([b for _, b in peers])
    name = F.element_at(names, index)
    if whole_word:
        pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), name, F.lit(r"\E(?!\w)"))
        at = F.regexp_instr(text, pattern)
    else:
        at = F.position(name, text)
    # not by coalesce: Spark takes an element of names that are all known for known, whatever the index
    return F.when(index.isNotNull(), F.overlay(text, F.element_at(others, index), at, F.char_length(name))) \
        .otherwise(text)


def perturb_numbers_entities(text: Column, key: Column, seed=0, peers=K.SECTOR_PEERS,
                             whole_word: bool = False) -> Column:
    return _let(jitter_percents(text, key, seed), lambda t: swap_peer(t, peers, whole_word))


# --------------------------------------------------------------- synonyms

def _synonym_map(synonyms: Mapping[str, Sequence[str]]) -> Column:
    pairs = []
    for word, options in synonyms.items():
        pairs += [F.lit(word), _strings(options)]
    return F.create_map(*pairs)


def _choose(options: Column, seed, *keys: Column) -> Column:
    n = F.size(options)
    return F.element_at(options, F.pmod(draw(seed, *keys), n).cast("int") + 1)


def replace_words(toks: Column, chosen: Column) -> Column:
    """Replace every token that is a key of the map ``chosen`` and join by blanks."""
    return F.array_join(F.transform(toks, lambda t: F.coalesce(chosen[t], t)), " ")


def _synonym_editor(key: Column, synonyms: Mapping[str, Sequence[str]],
                    stop_words: Sequence[str], seed):
    """Function (tokens, count) -> edited text."""
    eligible = [w for w, options in synonyms.items() if options and w not in set(stop_words)]
    table = _synonym_map({w: synonyms[w] for w in eligible})

    def edit(toks, count):
        hits = F.array_distinct(F.filter(toks, lambda t: t.isin(eligible)))

        def replaced(found):
            ranked = F.sort_array(F.transform(
                found, lambda w: F.struct(digest(seed, key, w).alias("rank"), w.alias("word"))))
            chosen = F.map_from_entries(F.transform(
                F.slice(ranked, 1, F.greatest(count, F.lit(0))),
                lambda r: F.struct(r["word"], _choose(table[r["word"]], f"{seed}:pick", key,
                                                      r["word"]))))
            return _let(chosen, lambda m: replace_words(toks, m))

        # without a hit nothing is looked up
        return _let(hits, lambda found: F.when(F.size(found) == 0, F.array_join(toks, " ")).otherwise(
            replaced(found)))

    return edit


def replace_synonyms(text: Column, key: Column, n: Column | int,
                     synonyms: Mapping[str, Sequence[str]], stop_words: Sequence[str],
                     seed=0) -> Column:
    """Replace all occurrences of up to ``n`` distinct words that have synonyms.

    For dictionaries small enough to be a literal (some hundred words); it needs
    no join and no shuffle. ``operators.lexicon`` does the same against a table.
    """
    edit = _synonym_editor(key, synonyms, stop_words, seed)
    count = F.lit(n) if isinstance(n, int) else n
    return _let(tokens(text), lambda toks: edit(toks, count))


def synonym_quota(toks: Column, ratio: float = K.SYNONYM_RATIO) -> Column:
    """At least one word, else the given share of the words."""
    return F.greatest(F.lit(1), F.floor(F.size(toks) * F.lit(ratio)).cast("int"))


def replace_synonyms_ratio(text: Column, key: Column, synonyms, stop_words,
                           ratio: float = K.SYNONYM_RATIO, seed=0,
                           toks: Column | None = None) -> Column:
    """``replace_synonyms`` for a share of the words; a text without words stays as is.

    ``toks`` are the tokens of ``text`` if they are at hand.
    """
    edit = _synonym_editor(key, synonyms, stop_words, seed)

    def edited(t):
        return F.when(F.size(t) == 0, text).otherwise(edit(t, synonym_quota(t, ratio)))

    return _let(tokens(text), edited) if toks is None else edited(toks)


def replace_forms(text: Column, key: Column, synonyms: Mapping[str, Sequence[str]],
                  max_repl: int = 2, seed=0) -> Column:
    """Replace up to ``max_repl`` positions whose lower-cased token is a known form."""
    forms = list(synonyms)
    table = _synonym_map(synonyms)

    def edit(toks):
        # only known forms are hashed
        found = F.filter(
            F.transform(toks, lambda t, i: F.struct(i.alias("at"), F.lower(t).alias("form"))),
            lambda s: s["form"].isin(forms))
        spots = F.transform(found, lambda s: F.struct(
            digest(seed, key, s["at"]).alias("rank"), s["at"].alias("at"), s["form"].alias("form")))
        chosen = F.map_from_entries(F.transform(
            F.slice(F.sort_array(spots), 1, max_repl),
            lambda s: F.struct(s["at"], _choose(table[s["form"]], f"{seed}:pick", key,
                                                s["at"]))))
        return _let(chosen, lambda m: F.array_join(
            F.transform(toks, lambda t, i: F.coalesce(m[i], t)), " "))

    return _let(tokens(text), edit)


def replace_forms_guarded(text: Column, key: Column, synonyms, entity_pattern: str,
                          max_repl: int = 2, seed=0) -> Column:
    """``replace_forms`` that leaves every span matching ``entity_pattern`` alone."""
    pattern = f"{entity_pattern}|{_HOLE}"  # a hole already in the text is held as well
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    masked = F.regexp_replace(text, pattern, _HOLE)
    edited = F.split(replace_forms(masked, key, synonyms, max_repl, seed), _HOLE, -1)
    return F.array_join(F.zip_with(edited, held, lambda gap, span: F.concat(
        F.coalesce(gap, F.lit("")), F.coalesce(span, F.lit("")))), "")
