"""The derived corpus: tokens of odd lines, and how the corpus is written."""

import unicodedata

from lexspark.sources import fixtures, store

LINES = ["Die Straße Überging ment x2 a1b m²s ²³ Ⅷa", "naïve 東京tower 😀 été s", "", None, "ending tion s e Ening, (x)\tyes\r", "Wort " * 30]
SCHEMA = "doc_id bigint, lang string, sent_no int, line string"


def plain_words(line):
    out, run = [], ""
    for c in line or "":
        if unicodedata.category(c).startswith("L"):
            run += c
            continue
        out += ([run] if run else []) + ([c] if c not in " \t" else [])
        run = ""
    return out + ([run] if run else [])


def plain_row(doc, lang, sent_no, i, w):
    letters = unicodedata.category(w[0]).startswith("L")
    stem = next((w[:-len(e)] for e in ("tion", "ment", "ing", "en", "s", "e") if w.endswith(e)), w)
    lemma = stem if letters and doc % 7 and stem else w
    if not letters:
        tag = "punct"
    elif i > 0 and unicodedata.category(w[0]) == "Lu":
        tag = lang and "Np" + lang
    elif len(w) <= 3:
        tag = "R" + ("c" if doc % 5 == 0 else "")
    elif len(w) <= 6:
        tag = lang and "Nc" + lang
    else:
        tag = lang and ("Xu" if doc % 10 >= 8 and (doc + i) % 5 == 0 else "Vp") + lang
    tag = tag and tag + ("+0" if doc % 11 == 0 else "")
    lost = (doc + 3 * sent_no + i) % 97
    return (doc, lang, "dev" if doc % 10 == 8 else "test" if doc % 10 == 9 else "training", sent_no, i,
            None if lost == 2 else w, None if lost == 1 else lemma, None if lost == 0 else tag)


def test_tokens_follow_the_rules(spark, monkeypatch):
    rows = [(d, lang, n, x) for d, lang in ((0, "de"), (55, "en"), (77, None), (88, "fr"), (109, "de")) for n, x in enumerate(LINES)]
    monkeypatch.setattr(fixtures, "CHUNK", 40)
    lines = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    out = fixtures.tokens_from_lines(lines)
    want = [plain_row(d, lang, n, i, w) for d, lang, n, x in rows for i, w in enumerate(plain_words(x))]
    key = lambda r: (r[0], r[3], r[4])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)


def test_tokens_without_a_document(spark):
    out = fixtures.tokens_from_lines(spark.createDataFrame([(None, "de", 0, "Wort, ja")], SCHEMA)).collect()
    assert [tuple(r) for r in out] == [(None, "de", "training", 0, i, None, None, None) for i in range(3)]


def test_rules_run_by_distinct_word(spark, sf_dir):
    """no regular expression runs once per token."""
    plan = fixtures.tokens(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp" not in plan and "RLIKE" not in plan


def test_parts_are_written_without_a_sort(spark):
    """a task writes all parts at once, instead of sorting its rows by part first."""
    before = spark.conf.get(store.WRITERS, None)
    with store._open_files(spark):
        assert int(spark.conf.get(store.WRITERS)) >= 3
    assert spark.conf.get(store.WRITERS, None) == before
    rows = lambda: spark.range(100).selectExpr("id", "id % 3 AS part")
    assert sorted(map(tuple, store.materialized(spark, "unsorted", "/nowhere", rows, partition_by=["part"]).collect())) == sorted(map(tuple, rows().collect()))


def test_sentences_and_parts_need_no_other_tokens(spark, sf_dir):
    """the sentences are those of the tokens; tokens of some parts are those of all parts."""
    keys = ["part", "doc_id", "sent_no"]
    every = fixtures.tokens(spark, sf_dir)
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert same(fixtures.sentences(spark, sf_dir), every.select(*keys).distinct())
    assert same(fixtures.tokens(spark, sf_dir, ("dev",)), every.where("part = 'dev'"))


def test_markup_and_blanks_are_removed(spark):
    from lexspark.operators import align
    lines = ["<w> a b + N p </w>", "<w> x y +\tz </w>", "< > q", "a<b> + c", None, " ", "<<s>>x + <y", "​x+\u0085y　"]
    out = align.parse_hypotheses(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in out] == [("ab", "Np"), ("xy", "z"), ("q", None), ("a", "c"), (None, None), (None, None), ("<>x", "<y"), ("​x", "y")]
