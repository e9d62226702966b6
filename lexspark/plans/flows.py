"""Whole flows (F1-F3): corpus -> pairs, hypotheses -> scores, parameter grids."""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.config import TransformConfig
from lexspark.operators import align, clean, context, score, sentences, sizes


def corpus_to_pairs(tokens: DataFrame, cfg: TransformConfig, bpe_units: Optional[DataFrame] = None,
                    already_clean: bool = False) -> DataFrame:
    """pairs for all partitions under one configuration (``part`` stays a column)."""
    t = tokens if already_clean else clean.clean_for_train(tokens)
    if cfg.mode == "sentence_to_sentence":
        return sentences.build_pairs(t, cfg, bpe_units)
    return context.build_examples(t, cfg, bpe_units)


def hypotheses_to_scores(hyps: DataFrame, truth_pre: DataFrame, train_pre: DataFrame, script: str,
                         sentence_mode: bool = True, strict: bool = True) -> DataFrame:
    """F2: hypotheses -> predictions -> match flags -> score rows, all models at once.

    With ``strict`` (default) a truth sentence or word without a hypothesis, or a
    hypothesis without truth, fails the flow; otherwise it is left out.
    """
    from lexspark.operators.segment import eos_flags
    if strict:
        keys = ("part", "doc_id", "sent_no", "word_no")[:3 if sentence_mode else 4]
        align.require_aligned(truth_pre.select(*keys).distinct(), hyps, keys)
    if sentence_mode:
        pred = align.align_sentences(truth_pre, hyps)
    else:
        pred = align.align_words(truth_pre, hyps)
    m = align.match_table(pred, clean.drop_incomplete(eos_flags(truth_pre)))
    return score.score_row(align.match_flags(m, train_pre, truth_pre, script=script))


def config_grid(tokens_clean: DataFrame, configs: Iterable[TransformConfig], folder: str = "corpus") -> DataFrame:
    """F3 + S11: per configuration, its output name and pair statistics.

    Configurations whose contexts stay in a sentence are measured together, in one
    pass over the tokens (``operators.sizes``); others are built one by one.
    """
    configs = list(configs)
    together = [c for c in configs if sizes.measurable(c)]
    out = None
    if together:
        names = F.element_at(F.array(*[F.lit(c.config_id(folder)) for c in together]), F.col("config") + 1)
        out = sizes.pair_sizes(tokens_clean, together).select(names.alias("config_id"), "n_pairs", "n_source_symbols", "n_target_symbols", "max_source")
    for cfg in configs:
        if sizes.measurable(cfg):
            continue
        p = corpus_to_pairs(tokens_clean, cfg, already_clean=True)
        st = p.agg(F.count("*").alias("n_pairs"),
                   F.sum(F.size("source")).cast("bigint").alias("n_source_symbols"),
                   F.sum(F.size("target")).cast("bigint").alias("n_target_symbols"),
                   F.max(F.size("source")).cast("int").alias("max_source")) \
            .select(F.lit(cfg.config_id(folder)).alias("config_id"), "*")
        out = st if out is None else out.unionByName(st)
    return out
