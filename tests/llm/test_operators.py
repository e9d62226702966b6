"""The training-data operators against brute force, on small tables with every odd case."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

WORDS = "alpha beta gamma delta omega über naïve 東京 don't x1 the of and to in".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `key` string, `h` int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) + r.choice(["", "", ".", ",", ".\nNext"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join(words[:40] + ["changed"] + words[41:])
    passage = prose(2, 60)
    return [base, base, near, prose(3, 90) + " " + passage + " tail", "head " + passage + " " + prose(4, 80), None, "", " ", "one", "x" * 5000,
            "a <|endoftext|> b", "tab\there  twice\n\nlines \x1c odd", prose(5, 4000), "ab " * 300, None, "ONE TWO!! three"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 7) for i, t in enumerate(texts)] + [(None, "text without an id " * 20, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_decontaminate(spark, docs, none, texts):
    from lexspark.llm.decontaminate import build_index, contamination, item_words, near, search
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[3].lower())
    items = [(1, " ".join(words[5:30])), (2, " ".join(words[-14:])), (3, "one"), (4, None), (5, "!!"), (6, "not in any text at all"), (7, " ".join(words[5:30]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    got = by_id(contamination(docs, bench))
    blocks = {r["doc_id"]: r for r in search(build_index(docs), item_words(bench), block_words=15).collect()}
    for i, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= own
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (blocks[str(i)]["n_hit"], blocks[str(i)]["items"]) == (len(hit), sorted(found))
    assert contamination(none, bench).count() == 0
    assert not any(r["contaminated"] for r in contamination(docs, bench.limit(0)).collect())
    two = spark.createDataFrame([(9, "two one")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item"]) for r in near(build_index(docs), item_words(two), 3).collect()} == {("15", "9")}


def test_warc(spark):
    from lexspark.llm.warc import read_chunks, read_records, round_trip, write
    from lexspark.llm.common import shared_path
    big = "é\r\n\r\nWARC/1.1\r\n" * 30_000
    rows = [(3, "u", "x" * 100), (1, None, "x" * 100), (2, "u u", "y" * 99), (4, "u", "y" * 99), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in round_trip(pages).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if j is not None and h == html] if len(data) >= 100 else [i]
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["intact"]) == (len(data), hashlib.sha256(data).hexdigest(), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == min(same) else ("revisit", min(same)))
    path = shared_path(spark, "warc-test")
    write(pages.where("page_id = 7"), path)
    chunks = read_chunks(spark, path)
    assert chunks.count() > 5 and chunks.where("size > 65536").count() == 0
    joined = b"".join(bytes(r["payload"]) for r in chunks.orderBy("segment", "chunk").collect())
    assert joined == big.encode() and read_records(chunks).count() == 1
    assert round_trip(pages.limit(0)).count() == 0


def test_embeddings(spark):
    from lexspark.llm.embeddings import near_duplicates
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    vectors = [(base[i % 30] + rng.normal(size=16) * 0.08 * (i >= 30)).tolist() for i in range(150)]
    rows = [(i, v, i % 2 if i < 30 else (i % 30) % 2) for i, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, vectors[0], None), (205, vectors[0], 0), (206, [1.0] * 4, 0), (207, [None] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in near_duplicates(df, per_cell=4, block=8).collect()}
    ok = {i: (np.array(v, np.float32).astype(float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j in ok if j != i and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0])
                 and ok[i][0] @ ok[j][0] / np.linalg.norm(ok[i][0]) / np.linalg.norm(ok[j][0]) >= 0.93} for i in ok}
    true = sum(map(len, links.values()))
    assert len(got) == len(rows) and sum(r["n_links"] for r in got.values()) >= 0.9 * true > 0
    for i, r in got.items():
        assert r["n_links"] <= len(links.get(i, ())) and r["kept"] == (r["component_id"] == i)
        if not links.get(i):
            assert (r["n_links"], r["component_id"]) == (0, i)
    assert near_duplicates(df.limit(0)).count() == 0


def test_minhash(spark, docs, none, texts):
    from lexspark.llm.minhash import near_duplicates
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = by_id(near_duplicates(docs))
    assert all((got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), root[i], root[i] == i) for i in sets)
    assert got[None]["component_id"] is None and got[None]["kept"] and root[2] == 0
    assert near_duplicates(none).count() == 0


def test_minhash_family(spark):
    """A family whose members are near to each other, or to members of members, but not to the hub."""
    from lexspark.llm.minhash import near_duplicates, shingles, _Words
    r = random.Random(7)
    base = prose(11, 150).split()

    def edited(words, edits):
        out = list(words)
        for at in r.sample(range(len(out)), edits):
            out[at] = f"w{r.randrange(10 ** 6)}"
        return out

    members = [edited(base, r.choice([2, 5, 8, 10, 12])) for _ in range(40)]
    members += [edited(r.choice(members), r.choice([1, 3, 4])) for _ in range(40)] + [m[:130] for m in members[:8]]
    rows = [(i, " ".join(m)) for i, m in enumerate(members)]
    sets = [set(shingles(t.lower().encode(), 3, _Words()).tolist()) for _, t in rows]
    root = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert 5 < len(set(root)) < 80 and [got[i]["component_id"] for i in range(len(root))] == root


def test_components(spark):
    from lexspark.llm.components import connected
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}}


def test_bpe_and_token_ids(spark, docs, none, texts):
    from lexspark.llm import bpe, tokens
    word, byte = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    library = Tokenizer.from_file(word)
    got = by_id(bpe.round_trip(docs, word))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    library, start = Tokenizer.from_file(byte), None
    rows = by_id(tokens.round_trip(docs, byte))
    start = rows[None]["n_tokens"]
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    from lexspark.llm.common import shared_path
    path = shared_path(spark, "ids-test")
    tokens.write(docs, path, byte, shard_ids=300)
    asked = spark.createDataFrame([(3,), (9,), (5,), (999,), (None,)], "doc_id bigint")
    found = {r["doc_id"]: r["ids"] for r in tokens.lookup(spark, path, asked).collect()}
    assert found == {i: library.encode(texts[i] or "", add_special_tokens=False).ids + [2] for i in (3, 9, 5)}
    assert bpe.round_trip(none, word).count() == 0 and tokens.round_trip(none, byte).count() == 0


def test_words_are_encoded_once(texts, monkeypatch):
    """Half a million words stay known to a worker; a smaller table forgets the oldest ones, and ids are the library's with either."""
    import pyarrow as pa
    from lexspark.llm import tokens
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        source = f.read()
    many, asked = tokens.Encoder(source), []
    many.fresh = lambda words: asked.append(len(words)) or {w: b"ab" for w in words}
    lines = [" ".join(f"w{k}" for k in range(at, at + 1_000)) for at in range(0, 600_000, 1_000)]
    for _ in range(2):
        for at in range(0, len(lines), 100):
            assert set(map(len, many.encode(lines[at:at + 100]))) == {2 * 999}
    assert 600_000 <= sum(asked) <= 600_600  # the first word of a text has a line feed before it

    odd = [t or "" for t in texts] + [".starts here", "no. no,no ,no", "a.b,c_.d!.e", "l\nm\n", "\u2028x", "x\xa0y", "é.ß,漢.字", "w" * 300 + " and", "", prose(6, 300)]
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in odd]
    monkeypatch.setattr(tokens, "CACHE", 60)
    few = tokens.Encoder(source)
    for at in (0, 5, 11, 20, 3):
        assert few.encode(odd[at:] + odd[:at]) == expected[at:] + expected[:at]
        assert len(few.words) == len(few.used) == len(few.starts) - 1 <= 60 and few.starts[-1] == len(few.data)
    assert few.encode([]) == [] and few.encode(["", ""]) == [b"", b""]

    batch = pa.RecordBatch.from_arrays([pa.array(range(5_003)), pa.array(["x" * 1_500_000] * 4 + [None, ""] + ["y"] * 4_997)], ["key", "text"])
    parts = list(tokens.batches_of(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and [len(p) for p in parts] == [3, 2_000, 2_000, 1_000]


def test_perfect_hash():
    from lexspark.llm.tokens import build, find, hashes
    for n in (1, 2, 3, 50, 3_000):
        place, _ = hashes([str(k).encode() for k in range(n)])
        assert sorted(find(place, build(place), n).tolist()) == list(range(n))


def test_suffixes(spark, docs, none, texts):
    from lexspark.llm import suffixes
    all_texts = [(t or "").encode() for t in texts] + [("text without an id " * 20).encode()]
    count = {}
    for t in all_texts:
        for k in range(len(t) - 199):
            count[t[k:k + 200]] = count.get(t[k:k + 200], 0) + 1
    expected = []
    for t in all_texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if count[t[k:k + 200]] > 1:
                gone[k:k + 200] = True
        expected.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    keep = suffixes.HOT
    for hot in (keep, 1):  # the second way: every anchor counts as very frequent
        suffixes.HOT = hot
        got = by_id(suffixes.remove_repeats(docs))
        suffixes.HOT = keep
        for i, (n, gone, spans, left) in enumerate(expected):
            r = got[i if i < len(texts) else None]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, hashlib.sha256(left).hexdigest())
    assert suffixes.remove_repeats(none).count() == 0


def test_lines(spark, none):
    from lexspark.llm.lines import dedup
    shared = [f"shared line {k}" for k in range(30)]
    rows = [(i, "\n".join([f"own {i}"] + shared + [f"end {i}"])) for i in (4, 2, 9)] + [(5, None), (6, ""), (7, "single"), (2, "\n".join(["own 2"] + shared + ["end 2"]))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, no int")
    got = {r["doc_id"]: r for r in dedup(df).collect()}
    assert got[2]["n_removed"] == 0 and got[2]["n_lines"] == 32 and min(got[4]["n_removed"], got[9]["n_removed"]) > 15
    assert got[4]["text"].startswith("own 4") and got[4]["text"].endswith("end 4") and len(got[4]["text"].split("\n")) == 32 - got[4]["n_removed"] and got[5]["text"] is None and got[6]["text"] == ""
    assert dedup(df).count() == len(rows) and dedup(none).count() == 0


def test_lines_whole_passages(spark):
    from lexspark.llm.lines import dedup
    passages = [[f"passage {n} line {k}" for k in range(n)] for n in range(2, 9)]
    rows = [(0, "\n".join(x for p in passages for x in p + [f"between {p[0]}"]))]
    for n, p in enumerate(passages):
        for before in range(7):
            i = 1 + 7 * n + before
            rows.append((i, "\n".join([f"own {i} {k}" for k in range(before)] + p + [f"end {i}"])))
    rows += [(200, "a\na\na"), (201, "b\nb\nb\nb"), (202, "c\nd\nc\nd")]
    got = by_id(dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)))
    assert got[0]["n_removed"] == 0 and got[0]["text"] == rows[0][1]
    for n, p in enumerate(passages):
        for before in range(7):
            i = 1 + 7 * n + before
            assert got[i]["text"] == "\n".join([f"own {i} {k}" for k in range(before)] + [f"end {i}"]) and got[i]["n_removed"] == len(p)
    assert [got[i]["text"] for i in (200, 201, 202)] == ["a\na\na", "b\nb", "c\nd"]


def test_scorers(spark, sf_dir, docs, none):
    from lexspark.llm import quality, toxicity
    from lexspark.llm.common import table
    rows, labels = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"), table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    kept = quality.score(rows, quality.fit(rows)).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert sum((r["quality_score"] >= 0.5) == bool(r["quality"]) for r in kept) >= 0.97 * len(kept)
    scored = toxicity.score(rows, labels).collect()
    assert len(scored) == rows.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert toxicity.score(docs, labels.limit(0)).count() == docs.count() and toxicity.score(none, labels).count() == 0
    assert quality.score(docs, quality.fit(docs)).count() == docs.count() and quality.fit(none) is None


def test_rows_that_share_an_id(spark, tmp_path):
    """Different texts under one id, or under null, are different documents in every stage."""
    import corpus_pipeline
    from lexspark.llm.lines import dedup
    own = [prose(50 + k, 60).replace("\n", " ") for k in range(6)]
    leak = prose(90, 30).replace("\n", " ")
    rows = []
    for i in (7, None):
        k = 0 if i else 3
        rows += [(i, own[k] + " " + leak), (i, own[k + 1]), (i, own[k + 2])]
    rows += [(3, own[1] + " more")]  # near (7, own[1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = lambda df: {(r["doc_id"], r["text"]) for r in df.collect()}
    assert texts(corpus_pipeline.not_in_benchmark(spark, docs, str(tmp_path))) == {(i, t) for i, t in rows if leak not in t}
    assert texts(corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))) == set(rows) - {(7, own[1])}
    passage = "one shared line\nand another\n"
    lined = [(1, passage + "x")] + [(i, t) for i in (7, None) for t in (f"a {i}\nb {i}\nc {i}", passage + f"own {i}", passage + f"other {i}")]
    got = texts(dedup(spark.createDataFrame(lined, "doc_id bigint, text string")))
    assert {(7, "a 7\nb 7\nc 7"), (None, "a None\nb None\nc None"), (7, "own 7"), (7, "other 7"), (1, "x")} <= got
    assert sum(t.startswith(passage) for _, t in got) == 1 and len(got) == len(lined)


def test_toxicity_counts_by_word(spark):
    """Every word has its own counts and weight, whatever part of them the tasks hold."""
    from lexspark.llm import toxicity
    r = random.Random(17)
    words = [f"w{k}" for k in range(6_000)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(600)] + ["", None, "w1", "w1 w2 w3 never"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id bigint, toxic int")
    seen = {}
    for i, t in enumerate(texts[:600]):
        if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3):
            for left, word in zip([None] + t.split(), t.split()):
                seen.setdefault(word, (set(), set()))[i % 2].add(left)
    got = toxicity.contexts(docs, labels).collect()
    assert sorted((r["ordinary"], r["toxic"]) for r in got) == sorted((len(o), len(t)) for o, t in seen.values())
    n_o, n_t = (sum(len(x[k]) for x in seen.values()) for k in (0, 1))
    left_o, left_t = (sum(min(len(x[k]), 2) for x in seen.values()) for k in (0, 1))
    weight = {w: np.log((max(len(t) - 2, 0) / n_t + left_t / n_t * (len(o) + len(t)) / (n_o + n_t)) / (max(len(o) - 2, 0) / n_o + left_o / n_o * (len(o) + len(t)) / (n_o + n_t)))
              for w, (o, t) in seen.items()}
    other = np.log(left_t / n_t / (left_o / n_o))
    expected = {}
    for i, t in enumerate(texts):
        x = [weight.get(w, other) for w in (t or "").split()]
        expected[i] = max([sum(x[k:k + 4]) for k in range(max(1, len(x) - 3))]) / 4
    model = toxicity.fit(docs, labels)
    for head in (toxicity.HEAD, 100, 0):
        raw = {r["doc_id"]: r["raw"] for r in toxicity.evidence(docs, model, head=head).collect()}
        assert raw.keys() == expected.keys() and all(abs(raw[i] - expected[i]) < 1e-5 for i in raw)


def test_toxicity_moves_only_what_it_needs(spark, monkeypatch):
    """Texts without a label stay where they are, whatever the number of labels; of rare words only those are asked for that the table may hold."""
    from lexspark.llm import toxicity
    docs = spark.createDataFrame([(i, f"a b c d own{i} x{i} y{i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 4)] + [(4, 1), (None, 1), (8, None)], "doc_id bigint, toxic int")
    plan = toxicity.contexts(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "shuffle_hash" in plan
    words = np.array([toxicity._Hashes()[w.encode()] for w in "abcd"], np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(w, n, 0.5) for n, w in enumerate(words)], "word bigint, n bigint, weight float")
    bits = np.unpackbits(toxicity.word_bits(table), bitorder="little")
    assert set(np.flatnonzero(bits).tolist()) == {w % len(bits) for w in words}
    written, keep = {}, toxicity.saved
    monkeypatch.setattr(toxicity, "saved", lambda df, name: written.setdefault(name, keep(df, name)))
    raw = {r["doc_id"]: r["raw"] for r in toxicity.evidence(docs, (table, -1.0), head=0).collect()}
    assert set(raw.values()) == {0.5}
    tails = [w for r in written["runs"].where("tail IS NOT NULL").collect() for w in r["tail"]]
    assert set(words) <= set(tails) and len(set(tails)) <= 40  # 1,204 words without the bitmap


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from lexspark.llm.common import table
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes and 0 < out.count() <= docs.count()
        docs = out
    ids = corpus_pipeline.run(spark, sf_dir)
    library = Tokenizer.from_file(corpus_pipeline.VOCABULARY)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in ids.collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items()}
