"""What must hold of every example of the nine configurations, and of the block-wise line operators."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.config import TEST_GRID
from lexspark.operators import segment
from lexspark.operators.context import build_examples
from lexspark.plans import corpus


def words_of(symbols, boundary):
    out = [""]
    for s in symbols:
        if s == boundary:
            out.append("")
        else:
            out[-1] += s
    return [w for w in out if w]


@pytest.mark.parametrize("number", range(len(TEST_GRID)))
def test_contexts_of_the_grid(spark, sf_dir, number):
    """Contexts keep their budget and hold words of the sentence, whole but for the word at the far end."""
    cfg = TEST_GRID[number]
    tokens = corpus.clean_tokens(spark, sf_dir).where("doc_id < 20 AND word IS NOT NULL AND lemma IS NOT NULL AND tag IS NOT NULL")
    sentences = {(r.doc_id, r.sent_no): r.ws for r in tokens.groupBy("doc_id", "sent_no").agg(
        F.sort_array(F.collect_list(F.struct("word_no", "word"))).alias("ws")).collect()}
    rows = build_examples(tokens, cfg).collect()
    assert len(rows) == sum(map(len, sentences.values()))
    for r in rows:
        ws = sentences[r.doc_id, r.sent_no]
        at = [w.word_no for w in ws].index(r.word_no)
        assert (r.source[0], r.source[-1]) == (cfg.example_boundary, "</w>")
        i, j = r.source.index(cfg.left_context_boundary), r.source.index(cfg.right_context_boundary)
        assert "".join(r.source[i + 1:j]) == ws[at].word
        for side, symbols in (("left", r.source[1:i]), ("right", r.source[j + 1:-1])):
            units = [s for s in symbols if s != cfg.word_boundary]
            if cfg.context_char_size is not None:
                assert sum(map(len, units)) <= cfg.context_char_size
            else:
                assert len(units) <= cfg.context_size
            assert not symbols or cfg.word_boundary not in (symbols[0], symbols[-1])
            found = words_of(symbols, cfg.word_boundary)
            near = [w.word for w in (ws[:at][::-1] if side == "left" else ws[at + 1:])]
            found = found[::-1] if side == "left" else found
            assert found[:-1] == near[:max(len(found) - 1, 0)]
            if found:
                last = near[len(found) - 1]
                assert last.endswith(found[-1]) if side == "left" else last.startswith(found[-1])


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_blocks_of_lines(spark, block):
    """Sentence numbers and blank runs do not depend on the block that a window spans."""
    r = random.Random(8)
    rows = [(d, 2 * k, r.choice(["", " ", "\t", "a", "b c"])) for d in (3, 1, 7) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, line_no int, line string").repartition(3)
    numbered = {(x.doc_id, x.line_no): x.sent_no for x in segment.number_sentences(df, blank=F.trim("line", F.lit(" \t")) == "", block=block).collect()}
    collapsed = sorted(map(tuple, segment.collapse_blanks(df, block=block).collect()))
    want, before = [], None
    for d, k, line in sorted(rows):
        blank = not line.strip()
        assert numbered[d, k] == sum(1 for e, j, x in rows if e == d and j < k and not x.strip())
        if before is not None and not (blank and before):
            want.append((d, k, "" if blank else line))
        before = blank
    assert collapsed == want
