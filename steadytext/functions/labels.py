"""Reading labels from answers, and label encodings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from steadytext.constants import REWARD_ORDER, SCORER_ORDER
from steadytext.functions.text import strip


def _first_contained(text: Column, labels: Sequence[str]) -> Column:
    chain = None
    for label in labels:
        hit = F.contains(text, F.lit(label))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def parse_answer(generated: Column) -> Column:
    """Label named after the last ``=``, case-sensitive; ``'none'`` without one."""
    tail = F.substring_index(generated, "=", -1)
    return F.coalesce(_first_contained(tail, SCORER_ORDER), F.lit("none"))


def completion_text(messages: Column) -> Column:
    """Content of the last message of an array of (role, content)."""
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))


def extract_label(text: Column, order: Sequence[str] = REWARD_ORDER) -> Column:
    """First label of ``order`` contained in the lower-cased text, else null."""
    return _first_contained(F.lower(text), order)


def label_index(value: Column, order: Sequence[str] = REWARD_ORDER) -> Column:
    """Index of a label given by name or by digit, else null."""
    key = F.lower(strip(value.cast("string")))
    by_name = F.array_position(F.array(*[F.lit(x) for x in order]), key)
    digit = F.try_to_number(F.substring(key, -1, 1), F.lit("9")).cast("int")
    by_digit = F.when(key.rlike("^0*[0-9]$") & (digit < len(order)), digit)
    return F.coalesce(by_digit, F.nullif(by_name, F.lit(0).cast("long")).cast("int") - 1)


def label_to_int(label: Column) -> Column:
    """negative 0, neutral 1, positive 2, anything else 1."""
    return F.when(label == "positive", 2).when(label == "negative", 0).otherwise(1)
