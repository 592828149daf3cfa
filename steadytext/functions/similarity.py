"""Cosine similarity of vectors and of token bags, inside the row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from steadytext.constants import PROB_FLOOR


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    norm = F.greatest(F.sqrt(_dot(v, v)), F.lit(PROB_FLOOR))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(
        v, lambda x: x.cast("double") / n)), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero vector gives 0."""
    norms = F.greatest(F.sqrt(_dot(a, a)), F.lit(PROB_FLOOR)) * F.greatest(
        F.sqrt(_dot(b, b)), F.lit(PROB_FLOOR))
    return _dot(a, b) / norms


def sparse_counts(places: Column, dimensions: int) -> Column:
    """Counts of whole-number places as (size, indices, values) with rising indices."""
    def runs(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.element_at(F.transform(F.array(starts), lambda at: F.struct(
            F.lit(dimensions).alias("size"), F.transform(at, lambda i: F.get(s, i)).alias("indices"),
            F.zip_with(at, F.concat(F.slice(at, 2, F.size(at)), F.array(n)), lambda i, j: (j - i).cast("float"))
            .alias("values"))), 1)

    none = F.struct(F.lit(dimensions).alias("size"), F.array().cast("array<int>").alias("indices"),
                    F.array().cast("array<float>").alias("values"))
    return F.element_at(F.transform(F.array(F.sort_array(places)), lambda s: F.when(
        F.size(s) > 0, runs(s)).when(s.isNotNull(), none)), 1)


def _sparse_dot(a: Column, b: Column) -> Column:
    """Both vectors in one order of indices; equal neighbours multiply.

    An entry is sorted as one whole number: its index, its side and its place.
    """
    def keys(v, side):
        return F.transform(v["indices"], lambda i, at: F.shiftleft(i.cast("long"), 31) + (side << 30) + at)

    def value(v, key):
        return F.get(v["values"], key.bitwiseAND((1 << 30) - 1).cast("int")).cast("double")

    def neighbours(e):
        n = F.size(e) - 1
        products = F.zip_with(F.slice(e, F.lit(1), n), F.slice(e, F.lit(2), n), lambda x, y: F.when(
            F.shiftright(x, 31) == F.shiftright(y, 31), value(a, x) * value(b, y)).otherwise(F.lit(0.0)))
        return F.when(n > 0, F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))

    merged = F.sort_array(F.concat(keys(a, 0), keys(b, 1)))
    return F.element_at(F.transform(F.array(merged), neighbours), 1)


def _sparse_norm(v: Column) -> Column:
    square = F.aggregate(v["values"], F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.greatest(F.sqrt(square), F.lit(PROB_FLOOR))


def cosine_sparse(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors (size, indices, values); that of their dense forms.

    Indices rise and do not repeat. Costs n log n in the stored entries, not in the dimensions. A zero
    vector gives 0, vectors of different size or a null one give null.
    """
    pair = F.struct(a.alias("a"), b.alias("b"))
    return F.element_at(F.transform(F.array(pair), lambda p: F.when(
        p["a"]["size"] == p["b"]["size"],
        _sparse_dot(p["a"], p["b"]) / (_sparse_norm(p["a"]) * _sparse_norm(p["b"])))), 1)


def to_dense(v: Column) -> Column:
    """The dense array of a sparse vector."""
    return F.transform(F.sequence(F.lit(0), v["size"] - 1), lambda i: F.coalesce(
        F.get(v["values"], F.array_position(v["indices"], i).cast("int") - 1), F.lit(0.0).cast("float")))


def _squared_counts(tokens: Column) -> Column:
    """Sum of squared token counts: squared lengths of the runs of the sorted array."""
    def runs(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(s, i) != F.get(s, i - 1))
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("sum"))

        def add(acc, at):
            length = (at - acc["at"]).cast("long")
            return F.struct(at.alias("at"), (acc["sum"] + length * length).alias("sum"))

        total = F.aggregate(F.concat(starts, F.array(n)), zero, add, lambda acc: acc["sum"])
        return F.when(n < 2, n.cast("long")).otherwise(total)

    return F.element_at(F.transform(F.array(F.sort_array(tokens)), runs), 1)


def _bag_cosine(a: Column, b: Column) -> Column:
    """Token cosine from squared counts: those of a + b are aa + 2 dot + bb."""
    sums = F.struct(_squared_counts(a).alias("aa"), _squared_counts(b).alias("bb"),
                    _squared_counts(F.concat(a, b)).alias("cc"))

    def ratio(x):
        norms = F.sqrt(x["aa"].cast("double") * x["bb"].cast("double"))
        dot = (x["cc"] - x["aa"] - x["bb"]) / 2
        return F.when(norms > 0, dot / norms).otherwise(F.lit(0.0))

    return F.element_at(F.transform(F.array(sums), ratio), 1)


def _set_cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(F.size(a).cast("double") * F.size(b).cast("double"))
    return F.when(norms > 0, F.size(F.array_intersect(a, b)) / norms).otherwise(F.lit(0.0))


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of the term-count vectors of two token arrays; 0 for an empty side.

    Computed inside the row, so nothing is shuffled, at n log n in the text
    length. Texts that repeat no token, as most headlines, need set sizes only.
    """
    def no_repeats(x):
        return F.size(F.array_distinct(x)) == F.size(x)

    def measure(pair):
        x, y = pair["x"], pair["y"]
        return F.when(no_repeats(x) & no_repeats(y), _set_cosine(x, y)).otherwise(
            _bag_cosine(x, y))

    # binds the arrays to a lambda variable: they are tokenised once
    return F.element_at(F.transform(F.array(F.struct(a.alias("x"), b.alias("y"))), measure), 1)
