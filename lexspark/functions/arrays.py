"""Array-expression helpers shared by the example builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.operators.segment import char_ngrams, chars


def lit_array(*xs: str) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def units_of(c: Column, unit: str, n: int = 1) -> Column:
    """Symbols of one word / lemma / tag: 'char' code points (or n-grams), 'word' whole."""
    if unit == "word":
        return F.array(c)
    if unit == "ngram" and n > 1:
        return char_ngrams(c, n)
    return chars(c)


def join_with(arrs: Column, sep: str) -> Column:
    """Flatten an array of arrays, putting ``sep`` between consecutive members."""
    return F.flatten(F.transform(arrs, lambda a, i: F.when(i > 0, F.concat(lit_array(sep), a)).otherwise(a)))
