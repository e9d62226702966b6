"""Sizes of examples under many configurations at once (F3), without rendering them.

Words travel packed, once, as in the example builder.  A chunk of
words is laid out once per segmentation that some configuration needs, and met
there with all configurations of that segmentation.  A context's symbols are its
units and one boundary between units of different words, so two word numbers give
the count and no text is made; a task sends on sums only.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.config import TransformConfig, closing_tag
from lexspark.operators.clean import drop_incomplete
from lexspark.operators.context import SENT, Units, budget_of
from lexspark.operators.packed import BLOCK, laid_out, pack


def measurable(cfg: TransformConfig) -> bool:
    """Contexts of one sentence, without tags, in units that follow from the word alone."""
    return cfg.mode == "word_and_context" and cfg.context_span <= 0 and cfg.context_tags == "none" and cfg.context_unit in ("char", "word")


def _layout(cfg: TransformConfig) -> tuple:
    return (cfg.context_unit, cfg.n if cfg.context_unit == "char" else 1)


def _symbols(*marks: str) -> int:
    return sum(len(m.split(" ")) for m in marks)


def _measurer(configs: Sequence[TransformConfig], sent, budget, block: int):
    """Function of packed batches to batches (config, n_pairs, n_source, n_target, max_source), a row per configuration and chunk of words."""
    layouts = sorted({_layout(c) for c in configs})

    def measure(chunk):
        own = chunk.own
        for unit, n in layouts:
            u = Units(chunk, unit, n)
            length = lambda c: pc.utf8_length(u.texts[c]).to_numpy(zero_copy_only=False).astype(np.int64)[own]
            size, lemma, tag = u.length[own], length("lemma"), length("tag")
            a, b = u.first[own], u.first[own + 1]
            of = np.append(u.of, 0)
            for k, c in enumerate(configs):
                if _layout(c) != (unit, n):
                    continue
                N = c.context_char_size
                lo, hi = u.reach(own, c.context_size, N)
                if N is not None:  # a unit has a character
                    lo, hi = np.maximum(lo, a - N), np.minimum(hi, b + max(N, 0))
                left = np.where(lo < a, a - lo + of[a - 1] - of[lo], 0)
                right = np.where(b < hi, hi - b + of[hi - 1] - of[b], 0)
                source = left + right + (1 if c.word_unit == "word" else size) + _symbols(
                    c.example_boundary, c.left_context_boundary, c.right_context_boundary, closing_tag(c.example_boundary))
                target = (1 if c.word_unit == "word" else lemma) + (1 if c.tag_unit == "word" else tag) + _symbols(
                    c.example_boundary, c.tag_boundary, closing_tag(c.example_boundary))
                yield k, len(own), int(source.sum()), int(np.sum(np.broadcast_to(target, len(own)))), int(source.max())

    def run(batches):
        for chunk in laid_out(batches, sent, budget, block=block):
            rows = list(measure(chunk))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["config", "n_pairs", "ns", "nt", "most"])

    return run


def pair_sizes(tokens: DataFrame, configs: Sequence[TransformConfig], sent=SENT, block: int = BLOCK) -> DataFrame:
    """(config, n_pairs, n_source_symbols, n_target_symbols, max_source) per position in ``configs``; all must be measurable."""
    configs = [c.validate() for c in configs]
    budgets = [budget_of(c) for c in configs]
    words = drop_incomplete(tokens).select(*sent, "word_no", "word", "lemma", "tag")
    most = None if None in budgets else max(budgets)
    z = pack(words, sent, most, block=block).mapInArrow(_measurer(configs, list(sent), most, block), "config bigint, n_pairs bigint, ns bigint, nt bigint, most bigint")
    return z.groupBy(F.col("config").cast("int").alias("config")).agg(
        F.sum("n_pairs").alias("n_pairs"), F.sum("ns").alias("n_source_symbols"),
        F.sum("nt").alias("n_target_symbols"), F.max("most").cast("int").alias("max_source"))
