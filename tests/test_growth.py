"""Steps whose tasks must not grow with the input: shares of tasks, aggregations of tokens without a sort."""

from lexspark.operators import baseline
from lexspark.operators.typetable import type_table
from lexspark.sources import fixtures

SCHEMA = "part string, word string, lemma string, tag string, is_eval boolean"
ROWS = [("training", "a", "a", "x", True), ("training", "a", "b", "x", True), ("training", "a", "b", "y", True), ("training", None, "c", None, False),
        ("training", "b", None, "x", True), ("dev", "a", "b", "x", True), ("dev", "a", "b", "x", True), ("dev", "a", "a", "x", True), ("dev", "n", "n", "z", True),
        ("dev", "n", "m", None, True), ("dev", None, "a", "x", False), ("dev", "b", None, None, False), ("test", "b", "b", "x", True), ("test", "b", "b", "x", True)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_cut_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    rows = [(i, "en", f"word{i} and more\nnext, line {i}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    slots = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fixtures, "TASK_BYTES", 1 << 40)
    few = fixtures.tokens(spark, str(tmp_path))
    assert few.rdd.getNumPartitions() == slots
    monkeypatch.setattr(fixtures, "TASK_BYTES", 100)
    many = fixtures.tokens(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() > 2 * slots
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)


def test_types_are_gathered_without_sorting_tokens(spark):
    t = spark.createDataFrame(ROWS, SCHEMA)
    for column, readings in (("word", "lemma"), ("tag", None)):
        plan = _plan(type_table(t, column, readings))
        assert "SortAggregate" not in plan
        below = plan[plan.rindex("Exchange"):]  # what the token rows go through first
        assert "HashAggregate" in below and "ObjectHashAggregate" not in below, plan
    got = {r["type"]: (r["seen"], sorted(r["parts"]), sorted(r["ambiguous"])) for r in type_table(t, "word", "lemma").collect()}
    assert got == {"a": (True, ["dev"], ["dev", "training"]), "b": (True, ["dev", "test"], []), "n": (False, ["dev"], ["dev"]), "\0": (True, ["dev"], [])}


def test_scores_look_up_tokens_alike_once(spark, monkeypatch):
    seen = []
    looked_up = baseline.looked_up
    monkeypatch.setattr(baseline, "looked_up", lambda rows, *a, **k: seen.append(rows.count()) or looked_up(rows, *a, **k))
    f = spark.createDataFrame(ROWS * 7, SCHEMA)
    model = baseline.fit(f.where("part = 'training'"))
    got = {(r["part"], r["scope"]): tuple(r)[2:] for r in baseline.scores(f, model).collect()}
    assert max(seen) <= len(set(ROWS))
    labels = {"a": ("b", "x"), "b": (None, "x")}  # most frequent ones; unknown: the word, no tag
    train, ev = [r for r in ROWS if r[0] == "training" and r[4]], [r for r in ROWS if r[4]]
    want = {}
    for part, word, lemma, tag, is_eval in [r for r in ROWS if r[0] != "training"] * 7:
        known = labels.get(word, (None, None))
        ok_l = lemma is not None and (known[0] or word) == lemma
        ok_t = tag is not None and known[1] == tag
        many = {r[2] for r in ev if r[0] == part and r[1] == word and r[2] is not None}
        scopes = ["pre_all_tokens", *["all_tokens"] * is_eval, *[f"unseen_{c}_tokens" for i, c in ((1, "word"), (2, "lemma"), (3, "tag")) if is_eval and (part, word, lemma, tag)[i] not in {r[i] for r in train}],
                  *["ambiguous_word_tokens"] * (is_eval and word is not None and len(many) > 1)]
        for s in scopes:
            n, l, t, j = want.get((part, s), (0, 0, 0, 0))
            want[part, s] = (n + 1, l + ok_l, t + ok_t, j + (ok_l and ok_t))
    assert got == {k: (n, l / n, t / n, j / n) for k, (n, l, t, j) in want.items()}


def test_rejects_take_the_corpus_unwritten(spark, tmp_path):
    from lexspark.plans import corpus, queries
    from lexspark.sources import store
    rows = [(i, "en", "some words of Text\n\nthe second, line of it again and again") for i in range(60)] + [(60, None, None), (None, "en", "no id"), (7, "en", "twice the id here")]
    spark.createDataFrame(rows, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d, at = str(tmp_path), lambda: store.exists(spark, store.table_path(spark, "clean_tokens", str(tmp_path)))
    first = sorted(map(tuple, queries.QUERIES["pairs_rejects"](spark, d).collect()), key=repr)
    assert first and not at()
    stored = corpus.clean_tokens(spark, d)
    assert at()
    again = queries.QUERIES["pairs_rejects"](spark, d)
    assert any("clean_tokens" in f for f in again.inputFiles())  # a corpus at hand is read
    assert sorted(map(tuple, again.collect()), key=repr) == first
    assert first == sorted((tuple(r) for r in stored.select(*queries.TOK).collect() if r["word"] is not None and None in (r["lemma"], r["tag"])), key=repr)
