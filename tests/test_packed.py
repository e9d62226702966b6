"""Words that travel packed, against plain Python: any order of rows, small batches, repeated and missing keys, neighbours."""

import random

import pytest

from lexspark.config import TransformConfig
from lexspark.operators.context import build_examples, sentence_units
from lexspark.operators.packed import pack

SCHEMA = "part string, doc_id bigint, sent_no int, word_no int, word string, lemma string, tag string"


def _rows(seed, longest=40):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice("abcé漢") for _ in range(rng.randrange(1, 6))) * (90 if rng.random() < .01 else 1)
    rows = []
    for doc in (None, 1, 2):
        for sent in (0, 1, 2, 4, 5, 63, 64, 65, 130):
            no = rng.randrange(3)
            for _ in range(rng.randrange(longest)):
                rows.append(("dev", doc, sent, no, text(), text(), rng.choice(["N", "Vé"])))
                no += rng.choice([0, 1, 1, 1, 2, 9])  # some numbers twice
    return rows + [("dev", 1, 5, None, "x", "x", "N"), (None, 1, 5, 3, "y", "y", "N")]


def _key(x):
    return tuple((v is not None, v) for v in x)


def _expected(rows, k, span, tags, exclude):
    sents = {}
    for r in sorted(rows, key=lambda r: _key((*r[3:],))):
        sents.setdefault(r[:3], []).append(r)
    out = []
    for (part, doc, no), words in sents.items():
        last = max(s for p, d, s in sents if (p, d) == (part, doc))
        near = lambda d: [] if exclude and d > 0 and no + d == last else sents.get((part, doc, no + d), [])  # noqa: E731,B023
        before, behind = (sum((near(d) for d in r), []) for r in (range(-span, 0), range(1, span + 1)))
        row = before + words + behind
        units = [(i, c, x == 0, x == len(w[4]) - 1) for i, w in enumerate(row) for x, c in enumerate(w[4])]
        for i in range(len(before), len(before) + len(words)):
            def text(taken, tagged):
                got = []
                for at, (j, c, opens, closes) in enumerate(taken):
                    got += (["<s>"] if opens and at else []) + [c] + (["+", *row[j][6]] if tagged and closes else [])
                return got
            left, right = [u for u in units if u[0] < i], [u for u in units if u[0] > i]
            left, right = left[len(left) - k if k is not None and k < len(left) else 0:], right[:k]
            w = row[i]
            out.append((part, doc, no, w[3], " ".join(["<w>", *text(left, tags), "<lc>", *w[4], "<rc>", *text(right, False), "</w>"]), " ".join(["<w>", *w[5], "+", *w[6], "</w>"])))
    return sorted(out, key=_key)


@pytest.mark.parametrize("k,span,tags,exclude,batch,block", [
    (4, 0, False, False, 10_000, 4096), (3, 0, True, False, 7, 8), (None, 0, False, False, 50, 16), (0, 1, False, False, 10_000, 4096),
    (5, 1, True, False, 9, 8), (30, 2, False, True, 100, 4096), (6, 40, False, False, 30, 64), (None, 1, False, True, 20, 16)])
def test_examples_from_rows_in_any_order(spark, monkeypatch, k, span, tags, exclude, batch, block):
    from lexspark.operators import context
    monkeypatch.setattr(context, "CHUNK", 32)
    rows = _rows(batch)
    cfg = TransformConfig(context_size=k, context_span=span, context_tags="left" if tags else "none", exclude_last_right=exclude)
    want = _expected(rows, k, span, tags, exclude)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for seed in (None, 1):
            if seed is not None:
                random.Random(seed).shuffle(rows)
            got = build_examples(spark.createDataFrame(rows, SCHEMA).repartition(3) if seed else spark.createDataFrame(rows, SCHEMA).coalesce(1), cfg, as_arrays=False, block=block)
            assert sorted(map(tuple, got.collect()), key=_key) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_units_of_any_kind_travel_whole(spark):
    """Segmentations that make up the word, that do not, and words without one."""
    rows = [("dev", 1, 0, i, w, w, "N") for i, w in enumerate(["abc", "de", "f", "gh", "é" * 300, "abc"])]
    tokens = spark.createDataFrame(rows, SCHEMA)
    for seg, third in (([("abc", ["ab", "c"]), ("de", ["de"])], "d e"), ([("abc", ["ab@@", "c"]), ("de", ["D", "", "E"]), ("gh", [])], "D  E")):
        units = spark.createDataFrame(seg, "type string, units array<string>")
        got = {r.word_no: r.source for r in build_examples(tokens, TransformConfig(context_unit="bpe", context_size=4), units, as_arrays=False).collect()}
        cut = {w: " ".join(dict(seg).get(w, w)) for w in ("abc", "de", "f", "gh", "é" * 300)}
        assert got[0].startswith("<w> <lc> a b c <rc> " + cut["de"] + " <s> f")
        assert got[1].startswith("<w> " + cut["abc"] + " <lc> d e <rc> f <s>")
        assert got[2].startswith("<w> " + cut["abc"] + " <s> " + cut["de"] + " <lc> f <rc> ") or third == "D  E"


def test_words_move_in_a_row_per_stretch(spark):
    """A sentence of neighbouring rows is one row of the shuffle, also where contexts span sentences; a long one is several."""
    tokens = spark.range(0, 20_000, 1, 1).selectExpr("'dev' part", "1L doc_id", "cast(id div 20 as int) sent_no", "cast(id % 20 as int) word_no", "concat('w', id % 97) word", "'l' lemma", "'N' tag")
    plain = pack(tokens, ("part", "doc_id", "sent_no"), 3)
    assert plain.count() <= 1000 + 3 and plain.agg({"__n": "sum"}).first()[0] == 20_000
    spans = pack(tokens, ("part", "doc_id", "sent_no"), 3, span=1)
    assert spans.count() < 1000 * 1.1 and spans.where("NOT __home").agg({"__n": "max"}).first()[0] == 3
    long = tokens.withColumnsRenamed({"sent_no": "s", "word_no": "w"}).selectExpr("part", "doc_id", "0 sent_no", "s * 20 + w word_no", "word", "lemma", "tag")
    assert pack(long, ("part", "doc_id", "sent_no"), 3).agg({"__n": "max"}).first()[0] <= 4096
    assert sentence_units(long, budget=3).count() == 4
    got = build_examples(long, TransformConfig(context_unit="word", context_size=1), as_arrays=False)
    assert got.count() == 20_000 and got.where("word_no = 4096").first().source.startswith("<w> w21 <lc>")
