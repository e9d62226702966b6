"""Plans that stand in for slower ones: sizes without texts, encoding by batch, lookups in one dictionary."""

import pytest
from pyspark.sql import functions as F

from lexspark.config import TransformConfig
from lexspark.operators import align, context, sizes, typetable, vocab
from lexspark.plans import corpus

KEYS = ["part", "doc_id", "sent_no", "word_no"]


@pytest.mark.parametrize("block", [4096, 16])
def test_sizes_equal_built_examples(spark, sf_dir, block):
    tokens = corpus.clean_tokens(spark, sf_dir).where("doc_id < 12")
    configs = [TransformConfig(context_size=4), TransformConfig(context_unit="word", context_size=2, word_unit="word"), TransformConfig(n=2, context_char_size=7, tag_unit="word"),
               TransformConfig(n=3, context_char_size=0), TransformConfig(n=2, context_size=0)] + ([TransformConfig(context_size=None)] if block > 16 else [])
    got = {r["config"]: tuple(r)[1:] for r in sizes.pair_sizes(tokens, configs, block=block).collect()}
    for k, cfg in enumerate(configs):
        want = context.build_examples(tokens, cfg).agg(F.count("*"), F.sum(F.size("source")), F.sum(F.size("target")), F.max(F.size("source"))).first()
        assert got[k] == tuple(want)
    assert not sizes.measurable(TransformConfig(context_span=1)) and not sizes.measurable(TransformConfig(context_tags="left"))


@pytest.mark.parametrize("unit", ["char", "word"])
def test_encoding_by_batch_and_by_join(spark, sf_dir, unit):
    """Characters and words (thousands of symbols); unknown symbols, null and empty lists."""
    tokens = corpus.clean_tokens(spark, sf_dir).where("doc_id < 30")
    pairs = context.build_examples(tokens, TransformConfig(context_unit=unit, context_size=3, word_unit=unit))
    v = vocab.vocabulary(pairs.where("part = 'training'")).cache()
    assert unit == "char" or v.count() > 1000
    odd = spark.createDataFrame([("dev", -1, 0, 0, None, []), ("dev", -1, 0, 1, ["never seen", None], ["a"])], "part string, doc_id bigint, sent_no int, word_no int, source array<string>, target array<string>")
    rows = pairs.unionByName(odd)
    ids = {(r["side"], r["symbol"]): r["id"] for r in v.collect()}
    want = sorted((*[r[k] for k in KEYS], *[None if r[s] is None else [ids.get((s, x), vocab.UNK_ID) for x in r[s]] for s in ("source", "target")]) for r in rows.collect())
    for most in (10 ** 6, 0):
        assert sorted(map(tuple, vocab.encode(rows, v, KEYS, most=most).collect())) == want
    text = context.as_text(pairs)
    assert sorted(vocab.vocabulary(text.where("part = 'training'")).collect()) == sorted(v.collect())
    some = {tuple(w[:4]): w for w in want}
    for most in (10 ** 6, 0):
        assert all(some[tuple(r[:4])] == tuple(r) for r in vocab.encode(text, v, KEYS, most=most).collect())


def test_flags_do_not_depend_on_the_dictionarys_size(spark, sf_dir, monkeypatch):
    """Dictionaries that are broadcast, and dictionaries joined by key with hot keys spread."""
    from lexspark.sources import fixtures
    ct = corpus.clean_tokens(spark, sf_dir)
    train, truth = ct.where("part = 'training'"), ct.where("part IN ('dev', 'test')")
    m = align.match_table(fixtures.predictions(spark, sf_dir), corpus.truth_with_eos(spark, sf_dir))
    get = lambda: align.match_flags(m, train, truth, script=corpus.SCRIPT)
    small = get()
    assert small.where("seen_word").count() > 0
    monkeypatch.setattr(typetable, "SMALL", 0)
    large = get()
    assert large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty()


def test_lost_hypotheses_keep_their_truth(spark):
    """A row for every model and truth row; surplus lines are listed with their reason."""
    keys = "part string, doc_id bigint, sent_no int, word_no int"
    truth = spark.createDataFrame([("dev", 1, s, k, f"w{k}") for s in range(2) for k in range(3)], keys + ", word string")
    hyps = spark.createDataFrame([("dev", 1, 0, 0, 1, "b + B"), ("dev", 1, 0, 0, 1, "a + A"), ("dev", 9, 0, 0, 1, "c + C"), ("dev", 1, 1, 2, 2, "d + D")],
                                 keys + ", model_id int, line string")
    got = {(r.model_id, r.sent_no, r.word_no): (r.lemma, r.tag) for r in align.align_words(truth, hyps).collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v != (None, None)} == {(1, 0, 0): ("a", "A"), (2, 1, 2): ("d", "D")}
    left = {(r.model_id, r.doc_id, r.reason, r.n) for r in align.surplus_words(truth, hyps).collect()}
    assert left == {(1, 9, "no truth", 1), (1, 1, "repeated", 1)}
    lines = spark.createDataFrame([("dev", 1, 0, 1, "a + A <s> b + B <s> c + C <s> d + D"), ("dev", 5, 0, 1, "x"), ("dev", 1, 1, 2, "e + E")], "part string, doc_id bigint, sent_no int, model_id int, line string")
    rows = {(r.model_id, r.sent_no, r.word_no): r.lemma for r in align.align_sentences(truth, lines).collect()}
    assert len(rows) == 12 and {k: v for k, v in rows.items() if v} == {(1, 0, 0): "a", (1, 0, 1): "b", (1, 0, 2): "c", (2, 1, 0): "e"}
    assert {(r.model_id, r.doc_id, r.reason, r.n) for r in align.surplus_sentences(truth, lines).collect()} == {(1, 1, "beyond the sentence", 1), (1, 5, "no truth", 1)}
    m = align.match_table(align.align_words(truth, hyps).where("lemma IS NOT NULL"), truth.withColumn("lemma", F.lit("l")).withColumn("tag", F.lit("t")))
    assert m.count() == 12 and m.where("lemma_prediction IS NULL").count() == 10


def test_predictions_read_what_was_predicted_once(spark, sf_dir):
    from lexspark.sources import fixtures
    plan = fixtures.predictions(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_equal_words_are_looked_up_once(spark, monkeypatch):
    from lexspark.operators import typetable
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, None), (4, "c", None), (5, "z", "z")], "id int, t string, p string")
    table = spark.createDataFrame([(w, w == "a", [], []) for w in ("a", "b", "c")], "type string, seen boolean, parts array<string>, ambiguous array<string>")
    get = lambda: sorted(typetable.looked_up_both(rows, ("t", "p"), table, ("x", "y")).selectExpr("id", "t", "p", "x.seen", "y.seen").collect(), key=lambda r: r[0])
    small = get()
    monkeypatch.setattr(typetable, "SMALL", 0)
    assert get() == small == [(1, "a", "a", True, True), (2, "a", "b", True, False), (3, None, None, None, None), (4, "c", None, False, None), (5, "z", "z", None, None)]


def test_sizes_make_no_row_per_word_and_configuration(spark, golden):
    """F16: words are measured by batch; a task sends one row per configuration, not one per word."""
    from lexspark.config import TEST_GRID
    from lexspark.operators import sizes
    out = sizes.pair_sizes(golden.coalesce(1), TEST_GRID)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Generate") <= 1  # the blocks of a sentence
    assert sorted(r["n_pairs"] for r in out.collect()) == [golden.count()] * len(TEST_GRID)
