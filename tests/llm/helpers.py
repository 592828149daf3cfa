"""Small tables for the tests."""

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# null and empty texts, blanks only, signs only, accents, a repeated row, a null id, a long text
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3),
       (4, "?! ... 12", None, "b", 9), (5, "naïve café à l'école", "fr", "b", 20),
       (6, "the cat sat on the mat", "en", None, 22), (6, "the cat sat on the mat", "en", None, 22),
       (None, "a text without an id", "en", "b", 20), (8, "word " * 20000, "en", "c", 100000),
       (9, "x" * 30000, "en", "c", 30000)]


def odd_docs(spark):
    """The odd rows, with extra columns whose names clash with the operators' own."""
    rows = [(*r, "kept", 7) for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", score string, cell int").coalesce(2)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def sentences(seed, n, words=60, lexicon="alpha beta gamma delta epsilon zeta eta theta iota kappa".split()):
    draw = random.Random(seed)
    return [" ".join(draw.choice(lexicon) + draw.choice("abcdefgh") for _ in range(words))
            for _ in range(n)]
