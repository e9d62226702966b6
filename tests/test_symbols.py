"""Texts cut into symbols and encoded as bytes, against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspark.functions.utf8 import spelled, strings_of
from lexspark.operators import vocab


def _texts(rng):
    return [None if rng.random() < .1 else "".join(rng.choice(["a", " ", "é", "漢b", "<s>", "😀"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(7))]


def test_spelling_and_symbols_of_slices():
    rng = random.Random(5)
    for _ in range(300):
        rows = _texts(rng)
        column = pa.array(["x", *rows, "y"], pa.string()).slice(1, len(rows))
        for n in (1, 2, 3):
            data, at, size = spelled(column, n)
            units = [[x[i:i + n] for i in range(0, len(x), n)] for x in (r or "" for r in rows)]
            assert strings_of(data, at).to_pylist() == [" ".join(x) for x in units]
            assert size.tolist() == [len(y.encode()) for x in units for y in x]
        cut = [None if x is None else x.split(" ") for x in rows]
        for c in (column, pa.array([["q"], *cut], pa.list_(pa.string())).slice(1)):
            found = vocab.Symbols(c)
            longer = dict(zip(found.other.tolist(), found.longer.to_pylist()))
            assert [longer.get(i, chr(x)) for i, x in enumerate(found.byte.tolist())] == [y for x in cut if x is not None for y in x]
            assert found.count.tolist() == [len(x or []) for x in cut]


@pytest.mark.parametrize("most", [vocab.MOST, 0])
def test_ids_as_text_are_the_ids_as_arrays(spark, most):
    rows = [(0, "<w> a b </w>", "a b"), (1, "é <s> a  b", ""), (2, None, "x x"), (3, "", None), (4, " ", "漢 a")]
    pairs = spark.createDataFrame(rows, "k int, source string, target string")
    v = vocab.vocabulary(pairs.where("k < 4"))
    ids = {(r.side, r.symbol): r.id for r in v.collect()}
    arrays = {r.k: r for r in vocab.encode(pairs, v, ["k"], most=most).collect()}
    for r in vocab.encode(pairs, v, ["k"], most=most, as_arrays=False).collect():
        for side, text in zip(("source", "target"), rows[r.k][1:]):
            want = None if text is None else [ids.get((side, x), vocab.UNK_ID) for x in text.split(" ")]
            assert arrays[r.k][f"{side}_ids"] == want
            assert r[f"{side}_ids"] == (None if want is None else " ".join(map(str, want)))
    counted = {(r.side, r.symbol): r.freq for r in v.collect()}
    assert counted["source", "a"] == 2 and counted["source", ""] == 2 and counted["target", "x"] == 2
    assert v.where(F.col("symbol").isNull()).isEmpty()


def test_ids_of_more_digits_than_a_cell(spark):
    """Ids of one to five digits, in cells of four and of eight bytes."""
    pairs = spark.createDataFrame([(0, "a b é a", "b"), (1, "", "zz a")], "k int, source string, target string")
    for big in (99, 31_234):
        v = spark.createDataFrame([("source", "a", 2), ("source", "b", big), ("source", "é", 3), ("target", "b", big), ("target", "a", 12)], "side string, symbol string, id bigint")
        got = {r.k: (r.source_ids, r.target_ids) for r in vocab.encode(pairs, v, ["k"], as_arrays=False).collect()}
        assert got == {0: (f"2 {big} 3 2", f"{big}"), 1: ("1", "1 12")}


def test_symbols_of_texts_are_counted_without_cutting_them(spark):
    """C10 and C11 on text and on arrays alike."""
    from lexspark.operators import clean
    text = spark.createDataFrame([("dev", "a b c", "é"), ("dev", "", "a b"), ("test", " a", "x y z w")], "part string, source string, target string")
    arrays = text.withColumns({c: F.split(c, " ") for c in ("source", "target")})
    assert sorted(clean.long_examples(text, 2).collect()) == sorted(clean.long_examples(arrays, 2).collect()) == [("dev", 2, 1, 0, 3, 2), ("test", 1, 0, 1, 2, 4)]
    assert clean.length_filter(text, 2).count() == clean.length_filter(arrays, 2).count() == 1
    assert "split(" not in clean.length_filter(text, 2)._jdf.queryExecution().optimizedPlan().toString()
