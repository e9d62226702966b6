"""Golden cases of word-and-context examples (FIXTURES.md section 3)."""

import pytest

from lexspark.config import TransformConfig
from lexspark.operators.context import as_text, build_examples


def lines(df, cfg, side="source"):
    rows = as_text(build_examples(df, cfg)).orderBy("sent_no", "word_no").collect()
    return {(r.sent_no, r.word_no): r[side] for r in rows}


def test_cleaning_golden(golden):
    got = [(r.word, r.lemma, r.tag) for r in golden.orderBy("sent_no", "word_no").collect()]
    assert got == [("котка", "котка", "ncfsi"), ("спи", "спя", "vpitf-r3s"),
                   ("куче", "куче", "ncnsi"), ("лае", "лая", "vpitf-r3s")]


@pytest.mark.parametrize("cfg,key,side,expected", [
    (TransformConfig(context_size=3), (0, 0), "source", "<w> <lc> к о т к а <rc> с п и </w>"),
    (TransformConfig(context_size=3), (0, 0), "target", "<w> к о т к а + n c f s i </w>"),
    (TransformConfig(context_size=3), (0, 1), "source", "<w> т к а <lc> с п и <rc> </w>"),
    (TransformConfig(context_size=3, context_tags="left"), (0, 1), "source",
     "<w> т к а + n c f s i <lc> с п и <rc> </w>"),
    (TransformConfig(n=2, context_char_size=3), (0, 1), "source", "<w> тк а <lc> с п и <rc> </w>"),
    (TransformConfig(n=2, context_char_size=3), (0, 0), "source", "<w> <lc> к о т к а <rc> сп и </w>"),
    (TransformConfig(context_unit="word", context_size=1), (0, 1), "source", "<w> котка <lc> с п и <rc> </w>"),
    (TransformConfig(context_size=4, context_span=1), (0, 0), "source",
     "<w> <lc> к о т к а <rc> с п и <s> к </w>"),
    (TransformConfig(context_size=4, context_span=1, exclude_last_right=True), (0, 0), "source",
     "<w> <lc> к о т к а <rc> с п и </w>"),
    (TransformConfig(context_size=0), (0, 1), "source", "<w> <lc> с п и <rc> </w>"),
    (TransformConfig(tag_first=True), (0, 0), "target", "<w> n c f s i + к о т к а </w>"),
    (TransformConfig(tag_unit="word"), (0, 0), "target", "<w> к о т к а + ncfsi </w>"),
])
def test_golden(golden, cfg, key, side, expected):
    assert lines(golden, cfg, side)[key] == expected


def test_span_left_context_crosses_sentences(golden):
    got = lines(golden, TransformConfig(context_size=4, context_span=1))
    assert got[(1, 0)] == "<w> а <s> с п и <lc> к у ч е <rc> л а е </w>"


def test_word_bpe_rejected(golden):
    with pytest.raises(ValueError):
        build_examples(golden, TransformConfig(word_unit="bpe"))


def _sentences(spark, lengths, seed=3):
    import random
    r = random.Random(seed)
    words = ["a", "bb", "ccc", "dddd", "x", "ñandú", "𝔘𝔘"]
    rows = [("dev", 1, s, k, r.choice(words), r.choice(words), r.choice(["N", "Vp"])) for s, n in enumerate(lengths) for k in range(n)]
    return spark.createDataFrame(rows, "part string, doc_id bigint, sent_no int, word_no int, word string, lemma string, tag string")


@pytest.mark.parametrize("over", [
    dict(context_size=3), dict(context_size=0), dict(context_char_size=4, n=2), dict(context_unit="word", context_size=2, context_tags="left"),
    dict(context_size=3, context_span=1), dict(context_char_size=5, n=3, context_span=2, context_tags="left"),
    dict(context_size=4, context_span=2, exclude_last_right=True), dict(context_size=None)])
def test_blocks_do_not_change_examples(spark, over):
    """Sentences around the block length, with neighbours, against sentences laid out whole."""
    from lexspark.config import TransformConfig
    from lexspark.operators.context import build_examples
    cfg = TransformConfig(**over)
    tokens = _sentences(spark, [1, 8, 9, 0, 30, 2, 16, 17, 7, 40, 3]).repartition(3)
    whole = build_examples(tokens, cfg, as_arrays=False).collect()
    assert len(whole) == 133
    assert sorted(build_examples(tokens, cfg, as_arrays=False, block=8).collect()) == sorted(whole)


def test_a_long_sentence_spreads_over_rows(spark):
    from pyspark.sql import functions as F
    from lexspark.config import TransformConfig
    from lexspark.operators.context import build_examples, sentence_units, with_units
    long = spark.range(0, 120_000, 1, 4).select(F.lit("dev").alias("part"), F.lit(1).alias("doc_id"), F.lit(0).alias("sent_no"), F.col("id").cast("int").alias("word_no"),
                                              F.concat(F.lit("w"), F.col("id") % 97).alias("word"), F.lit("l").alias("lemma"), F.lit("N").alias("tag"))
    cfg = TransformConfig(context_unit="word", context_size=3)
    sizes = [r[0] for r in sentence_units(with_units(long, cfg), budget=3).select(F.size("ws")).collect()]
    assert len(sizes) == 29 and max(sizes) < 2 * 4096 + 6
    got = build_examples(long, cfg, as_arrays=False)
    assert got.count() == 120_000
    assert got.where("word_no = 4096").first().source == "<w> w19 <s> w20 <s> w21 <lc> w 2 2 <rc> w23 <s> w24 <s> w25 </w>"


@pytest.mark.parametrize("unit,n", [("char", 1), ("char", 3), ("word", 1)])
def test_words_travel_without_their_units(golden, unit, n):
    """Units are cut behind the shuffle, so rows hold words and the plan has no expression that cuts them."""
    cfg = TransformConfig(context_unit=unit, n=n, context_size=3, context_tags="left", context_span=1)
    plan = build_examples(golden, cfg, as_arrays=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


@pytest.mark.parametrize("n,k,N,tags", [(1, 4, None, False), (2, 3, None, True), (3, 0, None, True), (2, None, 5, False), (3, None, 7, True), (1, None, None, False)])
def test_contexts_against_plain_statement(spark, monkeypatch, n, k, N, tags):
    """Every context spelled out unit by unit, with small batches of rendered words and of text."""
    from lexspark.operators import context
    monkeypatch.setattr(context, "CHUNK", 16)
    monkeypatch.setattr(context, "TEXT", 200)
    tokens = _sentences(spark, [1, 7, 0, 12, 30])
    cfg = TransformConfig(n=n, context_size=k, context_char_size=N, context_tags="left" if tags else "none")
    expected = {}
    rows = sorted(tokens.collect(), key=lambda r: (r.sent_no, r.word_no))
    for sent in {r.sent_no for r in rows}:
        words = [r for r in rows if r.sent_no == sent]
        units = [(i, w.word[x:x + n], x == 0, x + n >= len(w.word)) for i, w in enumerate(words) for x in range(0, len(w.word), n)]
        for i, w in enumerate(words):
            def walk(side):
                taken, length = [], 0
                for u in side:
                    length += len(u[1])
                    if (length > N) if N is not None else (k is not None and len(taken) >= k):
                        break
                    taken.append(u)
                return taken
            left, right = walk([u for u in units if u[0] < i][::-1])[::-1], walk([u for u in units if u[0] > i])

            def text(taken, tagged):
                out = []
                for at, u in enumerate(taken):
                    out += (["<s>"] if u[2] and at else []) + [u[1]] + (["+", *words[u[0]].tag] if tagged and u[3] else [])
                return out
            expected[sent, w.word_no] = " ".join(["<w>", *text(left, tags), "<lc>", *w.word, "<rc>", *text(right, False), "</w>"])
    got = {(r.sent_no, r.word_no): r.source for r in build_examples(tokens, cfg, as_arrays=False).collect()}
    assert got == expected
