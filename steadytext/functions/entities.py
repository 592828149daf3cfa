"""Rule-based entity types: patterns for figures, word lists for names."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from steadytext.constants import ENTITY_TYPES

PERCENT_PATTERN = r"[0-9][\t ]?%"
MONEY_PATTERN = (
    r"(?:[$€£]|EUR|USD|GBP)[\t ]?[0-9]"
    r"|[0-9][\t ]?(?:EUR|USD|GBP|euros?|dollars?|mn|bn|million|billion)\b"
)
# every match of MONEY_PATTERN contains one of these
_MONEY_SIGNS = ("$", "€", "£", "EUR", "USD", "GBP", "euro", "dollar", "mn", "bn", "illion")


def _contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether a part stands in the text: one pass over it for many parts, one for each of a few."""
    if len(parts) > 12 and "" not in parts:
        return text.rlike(any_name(parts))
    return functools.reduce(operator.or_, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


def any_name(names: Sequence[str]) -> str:
    """Regex finding any of the names; the lookahead skips other first letters fast."""
    initials = "".join(sorted({re.escape(n[0]) for n in names}))
    return f"(?=[{initials}])(?:" + "|".join(re.escape(n) for n in names) + ")"


def entity_types(text: Column, gazetteer: Mapping[str, Sequence[str]]) -> Column:
    """Sorted array of the entity types found in ``text``.

    For names that fit a literal; ``operators.lexicon.entity_types_from`` takes a table.
    """
    tests = {"PERCENT": F.contains(text, F.lit("%")) & text.rlike(PERCENT_PATTERN),
             "MONEY": _contains_any(text, _MONEY_SIGNS) & text.rlike(MONEY_PATTERN)}
    for kind, names in gazetteer.items():
        tests[kind] = _contains_any(text, names)
    found = [F.when(tests[kind], F.lit(kind)).otherwise(F.lit("")) for kind in ENTITY_TYPES if kind in tests]
    # ENTITY_TYPES is sorted, hence so is the result; array_compact would be a lambda function, see library
    return F.when(text.isNotNull(), F.array_remove(F.array(*found), ""))


def entity_pattern(gazetteer: Mapping[str, Sequence[str]]) -> str:
    """One regex matching whole entity spans, longest names first."""
    names = sorted({n for v in gazetteer.values() for n in v}, key=lambda n: (-len(n), n))
    parts = [r"[0-9]+(?:[.,][0-9]+)*[\t ]?%", r"(?:[$€£]|EUR |USD |GBP )[0-9]+(?:[.,][0-9]+)*"]
    return "|".join(parts + [re.escape(n) for n in names])
