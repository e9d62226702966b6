"""Periodic runs, ranked lexical search and exact top-k search against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, `term` string, `segment` int, `runs` int"


def brute_runs(words, least=12):
    """Maximal stretches by their smallest period, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, 2 * q) and not any(
                    all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_texts(seed):
    """Words with planted, nested, touching and broken repetitions."""
    r = random.Random(seed)
    for _ in range(250):
        n, letters = r.choice([0, 1, 11, 40, 120, 260]), r.choice([1, 2, 3, 30])
        words = [b"%d" % r.randrange(letters) for _ in range(n)]
        kind = r.randrange(5)
        unit = [b"%d" % r.randrange(2) for _ in range(r.randrange(1, 5))]
        if kind == 1 and n > 9:
            p, a = r.randrange(1, n // 3), r.randrange(n // 3)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        elif kind == 2:
            words = [w for _ in range(6) for w in unit * r.randrange(1, 40) + unit[:r.randrange(len(unit))]]
        elif kind == 3:
            inner = unit * r.randrange(1, 25) + unit[:r.randrange(len(unit))]
            words = inner * r.randrange(1, 6) + inner[:r.randrange(len(inner))] + [b"q"] + words
        elif kind == 4:
            x, y = [b"a"], [b"a", b"b"]
            while len(y) < max(n, 2):
                x, y = y, y + x
            words = y[:n]
        yield words


@pytest.mark.parametrize("short", [4, 16])
def test_runs_equal_brute_force(short):
    from lexspark.llm.runs import runs_of
    texts = list(odd_texts(5))
    assert runs_of(texts, short=short) == [brute_runs(w) for w in texts]


def test_runs_of_a_long_text():
    from lexspark.llm.runs import runs_of
    r = random.Random(1)
    base = [b"%d" % r.randrange(5000) for _ in range(7000)]
    words = base[:900] + base[900:3900] * 9 + base[3900:5000] + [b"a"] * 30000
    assert runs_of([words, [], words[:50]])[0] == [(900, 27000, 3000), (len(words) - 30000, 30000, 1)]


def test_periodic_runs_query(spark, tmp_path):
    from lexspark.llm.queries import op11_periodic_runs
    r = random.Random(3)
    texts = [" \n".join(w.decode() for w in words) for words in odd_texts(9)] + [None, "", " ", "one", None, "x" * 9000]
    rows = [(i, t, "en", "clash", 1, 2) for i, t in enumerate(texts)] + [(None, "a b " * 9, None, None, None, None), (3, texts[3], "en", "clash", 1, 2)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(x) for x in op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            words = [w if k < a else words[a + (k - a) % (1 + (n - a) // (3 + g % 8))] for k, w in enumerate(words)]
        runs = brute_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        s, length, q = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i, len(runs), s, length, q, 1000 * length // q if runs else None,
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_runs_of_an_empty_table(spark):
    from lexspark.llm.runs import periodic_runs
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def brute_search(docs, items, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    texts = [(i, split(t)) for i, t in docs]
    texts = [(i, w) for i, w in texts if w]
    n, total, out = len(texts), sum(len(w) for _, w in texts), []
    for no, (item, text) in enumerate(items):
        terms, scored = split(text), []
        weight = {t: int(np.floor(1000 * np.log((2 * n + 2) / (2 * sum(t in w for _, w in texts) + 1)))) for t in set(terms)}
        for i, w in texts:
            m = 75 + 25 * len(w) * n // total
            score = sum(weight[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in terms if t in w)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["über", "東京", "don't", "Of", "THE"]
    common = vocabulary[-2:] + vocabulary[:6]
    text = lambda n: " ".join(r.choice(common if r.random() < 0.4 else vocabulary) for _ in range(n))
    texts = [text(r.randrange(1, 80)) for _ in range(300)] + ["", " .,", None, "the of " * 3000, "w1 " * 50]
    texts += [texts[0]] * 40
    rows = [(i, t, "en", "clash", 1, 2) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None), (5, texts[5], "en", "x", 1, 2)]
    items = [(i, text(r.randrange(1, 30)), "x") for i in range(25)] + [(90, None, "x"), (91, "", "x"), (92, "unheard word", None), (93, texts[0], "x"),
                                                                      (None, "w7 w8", "x"), (94, "the The tHE of", "x"), (1, texts[7], "x")]
    return rows, items


@pytest.mark.parametrize("size, rare", [(30, 2), (30, 8), (16_384, 8), (16_384, 1)])
def test_lexical_search(spark, corpus, size, rare):
    from lexspark.llm.lexical import build_index, search
    rows, items = corpus
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    index = build_index(docs, max_docs=size)
    got = search(spark, index, spark.createDataFrame(items, "item_id bigint, text string, score string"), 7, per_block=10, rare=rare).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_search([r[:2] for r in rows], [i[:2] for i in items], 7), key=str)


def test_lexical_search_of_empty_tables(spark):
    from lexspark.llm.lexical import build_index, search
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    assert search(spark, build_index(none), items, 5).count() == 0
    docs = spark.createDataFrame([(1, "word", None, None, None, None)], DOCS)
    assert search(spark, build_index(docs), items.limit(0), 5).count() == 0


def test_pair_bounds_skip_more_than_single_bounds():
    """Two terms that never meet: their pair's bound is that of one, so nothing needs to be looked at."""
    from lexspark.llm.lexical import search_segment
    single = {b"a": (np.array([1, 5]), np.array([700, 600]), 700), b"b": (np.array([2, 9]), np.array([650, 500]), 650)}
    terms, pair = [(10, b"a", 1), (9, b"b", 1)], {(b"a", 1, b"b", 1): (np.zeros(0, int), np.zeros(0, int), 7000)}
    assert search_segment(single, pair, terms, 100, 8000, 5)[2] == 0
    assert search_segment(single, {}, [(10, b"a", 1)], 100, 7000, 5)[0].tolist() == [1]
    docs, scores, seen = search_segment(single, pair, terms, 100, 5850, 5)
    assert sorted(zip(docs.tolist(), scores.tolist())) == [(1, 7000), (2, 5850), (5, 6000)]


VECTORS = "vec_id bigint, embedding array<float>, label int, `block` string, `pack` int"


def vectors(seed):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(0, 0.2, 9).round(2).tolist(), 1, "x", 1) for i in range(330)]
    rows += [(400 + i, rows[7][1], None, None, None) for i in range(60)]  # many copies: ties at the boundary
    rows += [(500, None, 1, "x", 1), (550, [], 1, "x", 1), (551, [], 1, "x", 1), (600, [0.0] * 9, 1, "x", 1), (650, [0.1] * 8 + [None], 1, "x", 1),
             (700, [0.1] * 8 + [float("nan")], 1, "x", 1), (750, [float("inf")] * 9, 1, "x", 1), (800, [0.5, -2.5], 1, "x", 1), (801, [3.0, 1.0], 1, "x", 1),
             (None, rows[50][1], 1, "x", 1), (50, rows[50][1], 1, "x", 1), (900, [40.0, -41.5] + [0.01] * 7, 1, "x", 1)]
    return rows


def brute_top(rows, k, every):
    sound = [(i, [int(np.floor(256.0 * np.float64(np.float32(x)))) for x in v]) for i, v, *_ in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sound:
        if i is not None and i % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, c)), j is None, j) for j, c in sound if j != i and len(c) == len(q)]
            out += [(i, rank + 1, j, -s) for rank, (s, _, j) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, pack", [(50, 3), (4096, 256)])
def test_top_k_search(spark, block, pack):
    from lexspark.llm.bitslice import build_index, search
    rows = vectors(2)
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = search(build_index(table, block=block), table.where("vec_id % 50 = 0"), 5, pack=pack)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, 5, 50)


def test_top_k_of_empty_tables(spark):
    from lexspark.llm.bitslice import build_index, search
    none, one = spark.createDataFrame([], VECTORS), spark.createDataFrame([(50, [1.0], 1, "x", 1)], VECTORS)
    assert search(build_index(none), one, 5).count() == 0
    assert search(build_index(one), none, 5).count() == 0
    assert search(build_index(one), one, 5).count() == 0  # only the query's own row


def test_scores_beyond_the_integers_are_refused(spark):
    from lexspark.llm.bitslice import build_index
    with pytest.raises(Exception, match="smaller scale"):
        build_index(spark.createDataFrame([(1, [1e30, 2.0], 1, "x", 1)], VECTORS))


def test_slices_add_up():
    from lexspark.llm.bitslice import summed, top_rows
    r = np.random.default_rng(1)
    bits = r.integers(0, 2, (40, 128)).astype(bool)
    rows = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    weights = r.integers(0, 5, 40)
    slices = summed([[rows[weights == p]] for p in range(5)], 2)
    total = (bits * (1 << weights)[:, None]).sum(0)
    values = sum(np.unpackbits(s.view(np.uint8), bitorder="little").astype(int) << i for i, s in enumerate(slices))
    assert (values == total).all()
    best = top_rows(slices, np.full(2, 2**64 - 1, np.uint64), 7)
    assert sorted(best.tolist()) == sorted(np.lexsort((np.arange(128), -total))[:7].tolist())
