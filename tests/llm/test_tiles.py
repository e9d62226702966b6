"""Near-dedup of families whose members are mostly too far from each other, over many tiles."""

import random

import numpy as np
import pytest


def family(seed, n, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(160)]
    members = []
    for _ in range(n):
        words = list(base)
        for at in r.sample(range(len(words)), r.choice(edits)):
            words[at] = f"x{r.randrange(10 ** 6)}"
        members.append(words)
    members += [[*m[:150], *m[:10]] for m in members[:n // 4]]
    return [" ".join(m) for m in members]


@pytest.mark.parametrize("tile", [1_000, 400_000])
def test_tiles_equal_brute_force(spark, tile):
    from lexspark.llm.minhash import near_duplicates, shingles, _Words
    texts = family(1, 50, [2, 6, 9, 11, 13]) + family(2, 20, [1, 3]) + ["", None, "one two"]
    sets = [set(shingles((t or "").encode(), 3, _Words()).tolist()) for t in texts]
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), tile=tile).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert 3 < len({root[i] for i in range(len(sets) - 3)}) < len(sets) - 20


def test_shared_counts():
    from lexspark.llm import minhash
    r = np.random.default_rng(3)
    one, two = ([np.unique(r.integers(0, 9000, n).astype(np.uint64)) for n in sizes] for sizes in ((5, 3000, 1, 6000), (10, 4000, 7000)))
    assert minhash._shared(one, two).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in two] for a in one]
    assert minhash._common(one[1], two[1]) == minhash._shared(one, two)[1, 1]


def test_one_of_equal_rows_stays(spark):
    import corpus_pipeline
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = "some words that stand here often enough to be a text of their own"
    rows = [(1, text, "en", "a", 5), (1, text, "en", "b", 5), (2, text, "en", "a", 5), (None, "null id", "en", "a", 1), (None, "null id", "en", "a", 1), (7, None, "en", "a", 1)]
    out = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, schema), "")
    assert out.dtypes == spark.createDataFrame([], schema).dtypes
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(1, text), (7, None), (None, "null id")]
