"""Most-frequent-label baseline."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.joins import skew_join, top_keys
from lexspark.operators.typetable import among, is_seen, looked_up, stored, type_table


def _most_frequent(train: DataFrame, label: str) -> DataFrame:
    """Per word the label seen most often; ties -> smallest label; null keys out.

    Two aggregations, both with map-side combine: (word, label) counts,
    then a top-1 per word with ``min_by`` (no per-word sort, no collect).
    """
    c = (train.where(F.col("word").isNotNull() & F.col(label).isNotNull())
         .groupBy("word", label).agg(F.count("*").alias("n")))
    return c.groupBy("word").agg(F.min_by(F.col(label), F.struct((-F.col("n")).alias("nn"), F.col(label))).alias(label))


def fit(train_pre: DataFrame) -> DataFrame:
    """B1: (word, lemma, tag) from cleaned, not evaluation-filtered, training tokens."""
    return _most_frequent(train_pre, "lemma").join(_most_frequent(train_pre, "tag"), "word", "full")


def predict(tokens: DataFrame, model: DataFrame, unknown_tag: Optional[str] = None,
            hot: Optional[DataFrame] = None) -> DataFrame:
    """Add ``pred_lemma`` (unknown -> the word) and ``pred_tag`` (unknown -> ``unknown_tag``)."""
    m = model.select(F.col("word").alias("__w"), F.col("lemma").alias("__l"), F.col("tag").alias("__t"))
    out = skew_join(tokens.withColumn("__w", F.col("word")), m, ["__w"], "left", hot=hot)
    tag = F.coalesce(F.col("__t"), F.lit(unknown_tag)) if unknown_tag is not None else F.col("__t")
    return out.withColumn("pred_lemma", F.coalesce(F.col("__l"), F.col("word"))) \
        .withColumn("pred_tag", tag).drop("__w", "__l", "__t")


SCOPES = ("pre_all_tokens", "all_tokens", "unseen_word_tokens", "unseen_lemma_tokens",
          "unseen_tag_tokens", "ambiguous_word_tokens")


def scope_flags(flagged: DataFrame, train: str = "training", hot: Optional[DataFrame] = None, rows: Optional[DataFrame] = None) -> DataFrame:
    """Add the scope flags of B3 to cleaned tokens carrying ``is_eval``: one dictionary lookup per column.

    ``rows`` (default: all of ``flagged``) get the flags, the dictionaries come from ``flagged``.
    """
    ev = flagged.where("is_eval")
    out = flagged if rows is None else rows
    other = F.col("is_eval") & (F.col("part") != train)
    for c in ("word", "lemma", "tag"):
        table = stored(type_table(ev, c, "lemma" if c == "word" else None, train))
        out = looked_up(out, c, table, "__entry", hot if c == "word" else None).withColumn(f"unseen_{c}", other & ~is_seen("__entry"))
        if c == "word":
            out = out.withColumn("ambiguous", F.col("is_eval") & F.col("word").isNotNull() & among("__entry", "ambiguous", F.col("part")))
        out = out.drop("__entry")
    return out


def scores(flagged: DataFrame, model: DataFrame, unknown_tag: Optional[str] = None,
           parts=("dev", "test"), train: str = "training") -> DataFrame:
    """Lemma / tag / joint accuracy per (part, scope), one pass over the rows.

    Flags and predictions follow from a token's part and labels, so tokens alike are
    counted first and looked up once.  Accuracy is the share of right predictions (1.0
    when there is no error; the reference fails there).  Empty scopes produce no row.
    """
    alike = stored(flagged.where(F.col("part").isin(*parts)).groupBy("part", "word", "lemma", "tag", "is_eval").agg(F.count("*").alias("n")))
    hot = stored(top_keys(alike, "word"))  # counted once, shared by both lookups
    f = scope_flags(flagged, train, hot, rows=alike)
    p = predict(f, model, unknown_tag, hot)
    ok_l = F.coalesce(F.col("pred_lemma") == F.col("lemma"), F.lit(False))
    ok_t = F.coalesce(F.col("pred_tag") == F.col("tag"), F.lit(False))
    names = F.array(F.lit("pre_all_tokens"),
                    F.when(F.col("is_eval"), F.lit("all_tokens")),
                    F.when(F.col("unseen_word"), F.lit("unseen_word_tokens")),
                    F.when(F.col("unseen_lemma"), F.lit("unseen_lemma_tokens")),
                    F.when(F.col("unseen_tag"), F.lit("unseen_tag_tokens")),
                    F.when(F.col("ambiguous"), F.lit("ambiguous_word_tokens")))
    x = p.select("part", "n", ok_l.cast("int").alias("l"), ok_t.cast("int").alias("t"),
                 (ok_l & ok_t).cast("int").alias("j"),
                 F.explode(F.filter(names, lambda s: s.isNotNull())).alias("scope"))
    right = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias
    return x.groupBy("part", "scope").agg(
        F.sum("n").alias("n"), right("l")("lemma_acc"), right("t")("tag_acc"), right("j")("joint_acc"))
