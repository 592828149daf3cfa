"""Default small dictionaries of our own; every operator takes them as parameters."""

from __future__ import annotations

from steadytext.constants import EXTRA_STOP_WORDS, SECTOR_PEERS, SYNONYM_DICT

STOP_WORDS = (
    "a about after all also an and any are as at be been before but by can did do does "
    "for from had has have he her his how i if in into is it its me more most my no nor "
    "not of off on once only or other our out over own she so some such than that the "
    "their them then there these they this those to too under until up was we were what "
    "when where which while who why will with you your"
).split() + EXTRA_STOP_WORDS

# lemma -> inflected forms looked up in the text
_FORMS = {
    "rise": ["rise", "rises", "rose", "risen", "rising"],
    "fall": ["fall", "falls", "fell", "fallen", "falling"],
    "strong": ["strong", "stronger", "strongest"],
    "weak": ["weak", "weaker", "weakest"],
}

# surface -> ordered synonyms of its lemma
SURFACE_SYNONYMS = {
    form: SYNONYM_DICT[lemma] for lemma, forms in _FORMS.items() for form in forms
}

# (surface, lemma, sense, ord, synonym); sense 1 rows are never used for replacement
LEXICON_ROWS = [
    (form, lemma, 0, i, synonym)
    for lemma, forms in _FORMS.items()
    for form in forms
    for i, synonym in enumerate([lemma] + SYNONYM_DICT[lemma])
] + [
    ("sales", "sale", 0, 0, "gross_revenue"),
    ("sales", "sale", 0, 1, "Sales"),
    ("demand", "demand", 0, 0, "requirement"),
    ("demand", "demand", 1, 0, "ask"),
    ("outlook", "outlook", 0, 0, "mindset"),
    ("outlook", "outlook", 0, 1, "mentality"),
    ("outlook", "outlook", 1, 0, "prospect"),
    ("shares", "share", 0, 0, "portion"),
    ("shares", "share", 0, 1, "part"),
    ("growth", "growth", 0, 0, "growing"),
    ("growth", "growth", 0, 1, "maturation"),
]
LEXICON_SCHEMA = "surface string, lemma string, sense int, ord int, synonym string"

GAZETTEER = {
    "ORG": sorted({name for pair in SECTOR_PEERS for name in pair} | {"Nokia"}),
    "GPE": ["China", "Finland", "Germany", "Helsinki", "London", "Russia", "Sweden"],
    "PRODUCT": ["Android", "Galaxy", "Windows", "iPhone"],
}
