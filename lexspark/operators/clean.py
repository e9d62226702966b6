"""Cleaning filters and projections.

All are native column expressions; null handling follows the reference's
pandas semantics, written out explicitly (see the notes per function).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.patterns import CYRILLIC_START, EXCLUDED_TAGS, LEADING_PUNCT, TAG_TAIL

COLS = ("word", "lemma", "tag")


def _all_present(cols=COLS) -> Column:
    c = F.lit(True)
    for name in cols:
        c = c & F.col(name).isNotNull()
    return c


def lowercase_complete(df: DataFrame, cols=COLS) -> DataFrame:
    """Lowercase word, lemma and tag, only in rows with no null among them."""
    full = _all_present(cols)
    return df.withColumns({c: F.when(full, F.lower(F.col(c))).otherwise(F.col(c)) for c in cols})


def strip_tag_tail(df: DataFrame, pattern: str = TAG_TAIL) -> DataFrame:
    """Remove a tail of ``+digits``, ``"...`` or ``;...`` from the tag."""
    tag = F.col("tag")
    cut = F.regexp_replace(tag, pattern, "")
    if pattern == TAG_TAIL:  # a tag without any of the three marks has no tail: the pattern is not tried
        cut = F.when(tag.contains("+") | tag.contains('"') | tag.contains(";"), cut).otherwise(tag)
    return df.withColumn("tag", cut)


def drop_corrupt(df: DataFrame) -> DataFrame:
    """Drop rows whose word is null while the tag is not."""
    return df.filter(~(F.col("word").isNull() & F.col("tag").isNotNull()))


def drop_leading_punct(df: DataFrame, pattern: str = LEADING_PUNCT) -> DataFrame:
    """C4: drop words starting with a punctuation or space character; null words stay."""
    other = ~F.col("word").rlike(pattern)
    if pattern == LEADING_PUNCT:  # no word that starts with a letter a-z: the pattern is not tried
        other = F.col("word").between("a", "z\uffff") | other
    return df.filter(F.coalesce(other, F.lit(True)))


def drop_punct(df: DataFrame) -> DataFrame:
    """Drop tag or lemma ``punct`` unless the word is null.

    A null tag is *not* ``punct`` (pandas compares NaN != 'punct' as True),
    hence the null-safe comparison.
    """
    not_p = lambda c: ~F.col(c).eqNullSafe("punct")
    return df.filter(F.col("word").isNull() | (not_p("tag") & not_p("lemma")))


def clean_for_train(df: DataFrame) -> DataFrame:
    """C1-C5 in the reference's order (C2 after C1, before C5)."""
    return (df.transform(lowercase_complete).transform(strip_tag_tail)
            .transform(drop_corrupt).transform(drop_leading_punct).transform(drop_punct))


def eval_predicate(word: Column, tag: Column, script: str = CYRILLIC_START,
                   excluded_tags: str = EXCLUDED_TAGS) -> Column:
    """C6 predicate: first character of the script class, tag not excluded.

    A null word fails; a null tag is kept (the reference fills NaN with False).
    """
    return F.coalesce(word.rlike(script), F.lit(False)) & ~F.coalesce(tag.rlike(excluded_tags), F.lit(False))


def eval_filter(df: DataFrame, script: str = CYRILLIC_START, excluded_tags: str = EXCLUDED_TAGS,
                word_col: str = "word", tag_col: str = "tag", enabled: bool = True) -> DataFrame:
    """C6 (and C7 with ``word_col='word_truth'``); ``enabled=False`` is C8."""
    if not enabled:
        return df
    return df.filter(eval_predicate(F.col(word_col), F.col(tag_col), script, excluded_tags))


def drop_incomplete(df: DataFrame, cols=COLS) -> DataFrame:
    """Drop rows with any null among ``cols``."""
    return df.filter(_all_present(cols))


def rejects(df: DataFrame) -> DataFrame:
    """Rows the reference would crash on (word present, lemma or tag missing)."""
    return df.filter(F.col("word").isNotNull() & (F.col("lemma").isNull() | F.col("tag").isNull()))


def split_rejects(df: DataFrame):
    """(good, rejected) instead of failing the whole job."""
    bad = F.col("word").isNotNull() & (F.col("lemma").isNull() | F.col("tag").isNull())
    return df.filter(~bad), df.filter(bad)


def n_symbols(pairs: DataFrame, column: str) -> Column:
    """Symbols of an example's side: an array, or text with blanks between them, whose blanks are counted without cutting it."""
    if dict(pairs.dtypes)[column] != "string":
        return F.size(column)
    return F.octet_length(column) - F.octet_length(F.replace(F.col(column), F.lit(" "), F.lit(""))) + 1


def long_examples(pairs: DataFrame, symbols: int = 50, group=("part",)) -> DataFrame:
    """Per group the examples whose source or target has more than ``symbols`` symbols, and the longest ones."""
    sides = pairs.select(*group, *[n_symbols(pairs, c).alias(c) for c in ("source", "target")])
    over = lambda c: F.count_if(F.col(c) > symbols).alias(f"n_long_{c}")
    return sides.groupBy(*group).agg(F.count("*").alias("n_examples"), over("source"), over("target"),
                                     F.max("source").alias("longest_source"), F.max("target").alias("longest_target"))


def qa_counts(df: DataFrame, group=("part",)) -> DataFrame:
    """Alphabetic tokens; lemmas with > 1 form; words with > 1 reading (a missing lemma or tag is none)."""
    g = list(group)
    alpha = df.groupBy(*g).agg(
        F.count("*").alias("n_tokens"),
        F.count_if(F.col("word").rlike(r"\p{L}")).alias("n_alpha"),
    )
    forms = (df.where(F.col("lemma").isNotNull()).groupBy(*g, "lemma").agg(F.count_distinct("word").alias("k"))
             .groupBy(*g).agg(F.count_if(F.col("k") > 1).alias("n_lemmas_multi_form")))
    readings = (df.groupBy(*g, "word").agg(F.count_distinct("lemma", "tag").alias("k"))
                .groupBy(*g).agg(F.count_if(F.col("k") > 1).alias("n_words_multi_reading")))
    return alpha.join(forms, g, "left").join(readings, g, "left")


def length_filter(pairs: DataFrame, maxlen: int = 120) -> DataFrame:
    """C11: keep pairs whose source and target have at most ``maxlen`` symbols."""
    return pairs.filter((n_symbols(pairs, "source") <= maxlen) & (n_symbols(pairs, "target") <= maxlen))
