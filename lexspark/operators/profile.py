"""Corpus profile (P1-P11): counts, type sets, unseen types, ambiguity.

Input: the cleaned token table with a ``part`` column (training/dev/test)
and, where stated, its evaluation-filtered subset.  Type sets stay
DataFrames (distinct + anti/semi joins); nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators.clean import eval_predicate
from lexspark.functions.patterns import CYRILLIC_START, EXCLUDED_TAGS

COLS = ("word", "lemma", "tag")


def with_eval_flag(pre: DataFrame, script: str = CYRILLIC_START, excluded_tags: str = EXCLUDED_TAGS,
                   enabled: bool = True) -> DataFrame:
    """Mark rows kept by the evaluation filter (C6); ``enabled=False`` keeps all."""
    flag = eval_predicate(F.col("word"), F.col("tag"), script, excluded_tags) if enabled else F.lit(True)
    return pre.withColumn("is_eval", flag)


def _types_with_null(c: str) -> Column:
    # a set of values counts a missing value as one more type
    return (F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int"))).alias(f"n_{c}_types")


def partition_stats(flagged: DataFrame) -> DataFrame:
    """P1 + P2: tokens before/after the evaluation filter and type counts (after)."""
    n = flagged.groupBy("part").agg(F.count("*").alias("n_tokens"), F.count_if("is_eval").alias("n_eval_tokens"))
    t = flagged.where("is_eval").groupBy("part").agg(*[_types_with_null(c) for c in COLS])
    return n.join(t, "part", "left").fillna(0, subset=[f"n_{c}_types" for c in COLS])


def tag_frequency(all_tokens: DataFrame, part: str = "training") -> DataFrame:
    """Tag -> number of (non-null) words in the partition, null tags out."""
    return (all_tokens.where((F.col("part") == part) & F.col("tag").isNotNull())
            .groupBy("tag").agg(F.count("word").alias("n")))


def _long_types(df: DataFrame) -> DataFrame:
    """(part, column, value) for the three columns."""
    return df.select("part", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in COLS])).alias("t")
    ).select("part", "t.column", "t.value")


def _unseen(all_tokens: DataFrame, train: str) -> DataFrame:
    """(part, column, value, n tokens) of the non-training parts' types that training lacks.

    Counts per type and part, then one row per type that lists its parts: both
    steps combine before the shuffle and no token is joined.
    """
    per_part = _long_types(all_tokens).groupBy("column", "value", "part").agg(F.count("*").alias("n"))
    per_type = per_part.groupBy("column", "value").agg(F.bool_or(F.col("part") == train).alias("seen"), F.collect_list(F.struct("part", "n")).alias("of"))
    return per_type.where("NOT seen").select("column", "value", F.inline("of")).select("part", "column", "value", "n")


def unseen_type_table(all_tokens: DataFrame, train: str = "training") -> DataFrame:
    """Distinct (part, column, value) of the non-training parts not seen in training."""
    return _unseen(all_tokens, train).select("part", "column", "value")


def unseen_types(all_tokens: DataFrame, train: str = "training") -> DataFrame:
    """Number of types per column unseen in training, per non-training part."""
    return _unseen(all_tokens, train).groupBy("part", "column").agg(F.count("*").alias("n_types"))


def unseen_tokens(all_tokens: DataFrame, train: str = "training") -> DataFrame:
    """P5: number of tokens whose word / lemma / tag type is unseen in training."""
    return _unseen(all_tokens, train).groupBy("part", "column").agg(F.sum("n").alias("n_tokens"))


def _share_multi(df: DataFrame, key: str, others) -> DataFrame:
    per = df.where(F.col(key).isNotNull()).groupBy("part", key).agg(
        *[F.count_distinct(c).alias(f"k_{c}") for c in others])
    return per.groupBy("part").agg(
        *[(F.count_if(F.col(f"k_{c}") > 1) / F.count("*")).alias(f"share_{c}") for c in others])


def lemma_ambiguity(all_tokens: DataFrame) -> DataFrame:
    """Share of lemmas with more than one word form / more than one tag."""
    return _share_multi(all_tokens, "lemma", ("word", "tag")).select(
        "part", F.col("share_word").alias("share_multi_form"), F.col("share_tag").alias("share_multi_tag"))


def word_ambiguity(all_tokens: DataFrame) -> DataFrame:
    """Share of words with more than one lemma / tag, rounded to 5 places."""
    return _share_multi(all_tokens, "word", ("lemma", "tag")).select(
        "part", F.round("share_lemma", 5).alias("share_multi_lemma"), F.round("share_tag", 5).alias("share_multi_tag"))


def top_lemmas(all_tokens: DataFrame, by: str = "word", part: str = "training", k: int = 20) -> DataFrame:
    """P7 (by='word') / P8 (by='tag'): lemmas with most distinct values, top k.

    The limit is the feature (a top-k report); ties broken by lemma.
    """
    return (all_tokens.where((F.col("part") == part) & F.col("lemma").isNotNull())
            .groupBy("lemma").agg(F.count_distinct(by).alias("n"))
            .where(F.col("n") > 1).orderBy(F.desc("n"), F.asc("lemma")).limit(k))


def ambiguous_words(all_tokens: DataFrame, on_tag: bool = False) -> DataFrame:
    """(part, word) of words with > 1 lemma (or > 1 lemma or tag: P11) within the part."""
    aggs = [F.count_distinct("lemma").alias("kl")] + ([F.count_distinct("tag").alias("kt")] if on_tag else [])
    g = all_tokens.where(F.col("word").isNotNull()).groupBy("part", "word").agg(*aggs)
    cond = (F.col("kl") > 1) | (F.col("kt") > 1) if on_tag else (F.col("kl") > 1)
    return g.where(cond).select("part", "word")


def ambiguous_tokens(all_tokens: DataFrame) -> DataFrame:
    """Tokens of ambiguous words per part (by lemma; by lemma or tag).

    One aggregation per (part, word) carries the token count, so no join
    back to the tokens is needed.
    """
    g = all_tokens.where(F.col("word").isNotNull()).groupBy("part", "word").agg(
        F.count("*").alias("n"), F.count_distinct("lemma").alias("kl"), F.count_distinct("tag").alias("kt"))
    return g.groupBy("part").agg(
        F.coalesce(F.sum(F.when(F.col("kl") > 1, F.col("n"))), F.lit(0)).cast("bigint").alias("n_ambiguous_lemma"),
        F.coalesce(F.sum(F.when((F.col("kl") > 1) | (F.col("kt") > 1), F.col("n"))), F.lit(0)).cast("bigint")
        .alias("n_ambiguous_any"))
