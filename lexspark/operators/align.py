"""Parsing hypotheses and aligning predictions with the truth (A1-A10).

Alignment is by explicit position keys (document, sentence, word), never by
row order, so it holds on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.config import TAG_BOUNDARY, WORD_BOUNDARY
from lexspark.functions.joins import top_keys
from lexspark.operators.clean import eval_predicate
from lexspark.operators.typetable import TRAIN, among, is_seen, looked_up, looked_up_both, stored, type_table
from lexspark.functions.patterns import CYRILLIC_START, EXCLUDED_TAGS

# Fixed value: one-character markup tags (<s>, </w>, ...) and all white space are removed.
MARKUP = r"</?[^>]>"
SPACE = "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def parse_line(line: Column, tag_boundary: str = TAG_BOUNDARY, tag_first: bool = False):
    """A1: (lemma, tag) of one hypothesis; split at the last boundary; blank -> nulls."""
    x = F.replace(F.regexp_replace(line, MARKUP, ""), F.lit(" "), F.lit(""))
    x = F.when(x.rlike(SPACE), F.regexp_replace(x, SPACE + "+", "")).otherwise(x)  # blanks are rarely others than " "
    has = F.instr(x, tag_boundary) > 0
    tail = F.substring_index(x, tag_boundary, -1)
    head = F.substring(x, F.lit(1), F.length(x) - F.length(tail) - F.lit(len(tag_boundary)))
    lemma = F.nullif(F.when(has, head).otherwise(x), F.lit(""))
    tag = F.when(has, F.nullif(tail, F.lit("")))
    if tag_first:
        lemma, tag = F.nullif(F.when(has, tail).otherwise(x), F.lit("")), F.when(has, F.nullif(head, F.lit("")))
    return lemma, tag


def parse_hypotheses(lines: DataFrame, line_col: str = "line", tag_boundary: str = TAG_BOUNDARY,
                     tag_first: bool = False) -> DataFrame:
    lemma, tag = parse_line(F.col(line_col), tag_boundary, tag_first)
    return lines.withColumn("lemma", lemma).withColumn("tag", tag).drop(line_col)


def with_models(truth: DataFrame, pred: DataFrame, model_col: str = "model_id") -> DataFrame:
    """Every truth row once per model of ``pred``: the left side of an alignment that loses nothing.

    The models are a number of runs, whatever the corpus holds: one row carries their list.
    """
    models = pred.agg(F.collect_set(model_col).alias("__models")).withColumn("__one", F.lit(1))
    rows = truth.withColumn("__one", F.lit(1)).join(F.broadcast(models), "__one")
    return rows.select(F.explode("__models").alias(model_col), *truth.columns)


def _per_model(rows: DataFrame, found: str, pred: DataFrame, model_col: str = "model_id") -> DataFrame:
    """Every row once per model of ``pred`` and struct of that model in the list ``found``, with the fields of that struct: null where the model has none."""
    models = pred.agg(F.collect_set(model_col).alias("__models")).withColumn("__one", F.lit(1))
    fields = rows.schema[found].dataType.elementType
    kinds = {f.name: f.dataType for f in fields}

    def of(m):
        own = F.filter(F.coalesce(F.col(found), F.array().cast(rows.schema[found].dataType)), lambda x: x[model_col] == m)
        none = F.struct(*[(m if c == model_col else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        return F.when(F.size(own) > 0, own).otherwise(F.array(none))

    both = rows.withColumn("__one", F.lit(1)).join(F.broadcast(models), "__one").drop("__one")
    return both.select(*[c for c in rows.columns if c != found], F.inline(F.flatten(F.transform("__models", of))))


def align_words(truth: DataFrame, hyps: DataFrame, keys=("part", "doc_id", "sent_no", "word_no"),
                model_col: str = "model_id") -> DataFrame:
    """A2: truth row <-> hypothesis row of the same example key.

    Returns a row for every model and truth word with the parsed (lemma, tag), null
    where no hypothesis came; of several for one key the smallest line counts.
    ``surplus_words`` lists what has no truth row, ``align_check`` counts both,
    ``require_aligned`` fails on any.
    """
    k = list(keys)
    parsed = parse_hypotheses(hyps.groupBy(model_col, *k).agg(F.min("line").alias("line")))
    return with_models(truth.select(*k, "word"), hyps, model_col).join(parsed, [model_col, *k], "left") \
        .select(model_col, *k, "word", "lemma", "tag")


def surplus_words(truth: DataFrame, hyps: DataFrame, keys=("part", "doc_id", "sent_no", "word_no"),
                  model_col: str = "model_id") -> DataFrame:
    """A2: what ``align_words`` leaves over: (model, *keys, reason, n hypotheses), reason ``no truth`` or ``repeated``."""
    k = list(keys)
    t = truth.select(*k).distinct().withColumn("__t", F.lit(True))
    h = hyps.groupBy(model_col, *k).agg(F.count("*").alias("n")).join(t, k, "left")
    lost = F.col("__t").isNull()
    return h.where(lost | (F.col("n") > 1)).select(
        model_col, *k, F.when(lost, "no truth").otherwise("repeated").alias("reason"),
        F.when(lost, F.col("n")).otherwise(F.col("n") - 1).alias("n"))


def align_check(truth: DataFrame, hyps: DataFrame, keys=("part", "doc_id", "sent_no", "word_no"),
                model_col: str = "model_id") -> DataFrame:
    """A2 check: per model, examples without hypothesis and hypotheses without example.

    (model, n_matched, n_missing, n_extra): one pass over the joined keys; the
    number of truth rows is a one-row aggregate of the same plan.
    """
    k = list(keys)
    h = hyps.select(model_col, *k)
    joined = h.join(truth.select(*k, F.lit(True).alias("__t")), k, "left")
    per_model = joined.groupBy(model_col).agg(F.count("__t").alias("n_matched"), F.count("*").alias("n_hyp"))
    size = truth.agg(F.count("*").alias("__n")).withColumn("__one", F.lit(1))
    return per_model.withColumn("__one", F.lit(1)).join(F.broadcast(size), "__one").select(
        model_col, "n_matched", (F.col("__n") - F.col("n_matched")).alias("n_missing"),
        (F.col("n_hyp") - F.col("n_matched")).alias("n_extra"))


def require_aligned(truth: DataFrame, hyps: DataFrame, keys=("part", "doc_id", "sent_no", "word_no"),
                    model_col: str = "model_id") -> None:
    """A2, A5: raise unless every truth row has its hypothesis row and none is left over."""
    bad = align_check(truth, hyps, keys, model_col).where("n_missing <> 0 OR n_extra <> 0").orderBy(model_col).limit(5).collect()
    if bad:
        raise ValueError(f"hypotheses and truth do not align: {[r.asDict() for r in bad]}")


def _sentence_lines(truth: DataFrame, hyps: DataFrame, sent_keys, model_col: str, word_boundary: str, how: str) -> DataFrame:
    """(model, *sentence, __ws: truth words in order, __ps: pieces of the line, __n lines)."""
    sk = list(sent_keys)
    t = truth.groupBy(*sk).agg(F.sort_array(F.collect_list(F.struct("word_no", "word"))).alias("__ws"))
    line = hyps.groupBy(model_col, *sk).agg(F.min("line").alias("line"), F.count("*").alias("__n"))
    pat = "\\Q" + word_boundary + "\\E"
    line = line.select(model_col, *sk, "__n", F.split("line", pat, -1).alias("__ps"))
    if how == "truth":
        # a sentence moves once for all models: its lines meet there, by model
        lines = line.groupBy(*sk).agg(F.collect_list(F.struct(model_col, "__n", "__ps")).alias("__lines"))
        return _per_model(t.join(lines, sk, "left"), "__lines", hyps, model_col)
    return line.join(t, sk, "left")


def align_sentences(truth: DataFrame, hyps: DataFrame, sent_keys=("part", "doc_id", "sent_no"),
                    model_col: str = "model_id", word_boundary: str = WORD_BOUNDARY) -> DataFrame:
    """A3, A4: split hypotheses at the word boundary; i-th piece <-> i-th truth word.

    Returns a row for every model and truth word: missing pieces and sentences
    without a hypothesis give null lemma and tag.  Surplus pieces, lines without
    a truth sentence and repeated lines are listed by ``surplus_sentences``.
    """
    sk = list(sent_keys)
    both = _sentence_lines(truth, hyps, sk, model_col, word_boundary, "truth")
    words = both.select(model_col, *sk, "__ps", F.posexplode("__ws").alias("idx", "x"))
    words = words.select(model_col, *sk, F.col("x.word_no").alias("word_no"), F.col("x.word").alias("word"), F.get("__ps", "idx").alias("piece"))
    lemma, tag = parse_line(F.col("piece"))
    return words.select(model_col, *sk, "word_no", "word", lemma.alias("lemma"), tag.alias("tag"))


def surplus_sentences(truth: DataFrame, hyps: DataFrame, sent_keys=("part", "doc_id", "sent_no"),
                      model_col: str = "model_id", word_boundary: str = WORD_BOUNDARY) -> DataFrame:
    """A3, A4: what ``align_sentences`` leaves over: (model, *sentence, reason, n).

    Reasons: ``no truth`` (n lines of a sentence that the truth lacks), ``repeated`` (n
    further lines of a sentence), ``beyond the sentence`` (n pieces after its last word).
    """
    sk = list(sent_keys)
    both = _sentence_lines(truth, hyps, sk, model_col, word_boundary, "hypotheses")
    lost = F.col("__ws").isNull()
    beyond = F.size("__ps") - F.size("__ws")
    found = F.array(F.when(lost, F.struct(F.lit("no truth").alias("reason"), F.col("__n").alias("n"))),
                    F.when(~lost & (F.col("__n") > 1), F.struct(F.lit("repeated").alias("reason"), (F.col("__n") - 1).alias("n"))),
                    F.when(~lost & (beyond > 0), F.struct(F.lit("beyond the sentence").alias("reason"), beyond.cast("bigint").alias("n"))))
    return both.select(model_col, *sk, F.inline(F.filter(found, lambda f: f.isNotNull())))


def match_table(pred: DataFrame, truth: DataFrame, keys=("part", "doc_id", "sent_no", "word_no"), model_col: str = "model_id") -> DataFrame:
    """A5: truth joined with the predictions by position, ``_prediction`` / ``_truth`` suffixes.

    A row for every model and truth row; predicted columns are null where none came.
    """
    k = list(keys)
    p = pred.select(*[c for c in pred.columns if c not in ("word", "lemma", "tag")],
                    *[F.col(c).alias(f"{c}_prediction") for c in ("word", "lemma", "tag")])
    t = truth.select(*k, *[F.col(c).alias(f"{c}_truth") for c in ("word", "lemma", "tag")],
                     *([F.col("eos")] if "eos" in truth.columns else []))
    order = [*p.columns, *[c for c in t.columns if c not in p.columns]]
    return with_models(t, pred, model_col).join(p, [model_col, *k], "left").select(order)


def match_flags(match: DataFrame, train_pre: DataFrame, truth_pre: DataFrame,
                script: str = CYRILLIC_START, excluded_tags: str = EXCLUDED_TAGS,
                postprocess: bool = True, part_col: str = "part") -> DataFrame:
    """C7 + A6-A10 on a match table.

    seen_word: truth word among the (cleaned) training words; ambiguous:
    predicted word among words with > 1 lemma in the truth partition or in
    training; seen_tag: truth tag among training tags; existent_tag:
    predicted tag among training or truth tags.
    """
    m = match
    if postprocess:
        m = m.filter(eval_predicate(F.col("word_truth"), F.col("tag_truth"), script, excluded_tags))
    eq = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    both = train_pre.select(F.lit(TRAIN).alias("part"), "word", "lemma", "tag").unionByName(
        truth_pre.select(F.col(part_col).alias("part"), "word", "lemma", "tag"))
    words = stored(type_table(both.where(F.col("word").isNotNull()), "word", "lemma"))
    tags = stored(type_table(both.where(F.col("tag").isNotNull()), "tag"))
    # 1,000 rows at most; the match rows' words and tags are those of the truth, which is read without matching
    hot_w, hot_t = stored(top_keys(truth_pre, "word")), stored(top_keys(truth_pre, "tag"))
    part = F.col(part_col)
    m = looked_up_both(m, ("word_truth", "word_prediction"), words, ("__wt", "__wp"), hot_w)
    # ambiguous: the predicted word has more than one lemma in the truth's part, or in training
    m = m.withColumn("seen_word", is_seen("__wt")).withColumn(
        "ambiguous", among("__wp", "ambiguous", part) | among("__wp", "ambiguous", F.lit(TRAIN))).drop("__wt", "__wp")
    m = looked_up(m, "tag_truth", tags, "__tt", hot_t).withColumn("seen_tag", is_seen("__tt")).drop("__tt")
    # existent: the predicted tag is among the tags of training or of the truth's part
    m = looked_up(m, "tag_prediction", tags, "__tp", hot_t).withColumn(
        "existent_tag", is_seen("__tp") | among("__tp", "parts", part)).drop("__tp")
    m = m.withColumn("lemma_match", eq("lemma_prediction", "lemma_truth")) \
        .withColumn("tag_match", eq("tag_prediction", "tag_truth")) \
        .withColumn("joint_match", F.col("lemma_match") & F.col("tag_match"))
    return m.select(*match.columns, "lemma_match", "tag_match", "joint_match", "seen_word", "ambiguous", "seen_tag", "existent_tag")
