"""Exact repeats of ``LENGTH`` bytes by a distributed, prefix-aware merge sort of suffixes.

Not every suffix is sorted.  Each window of LENGTH bytes elects an anchor: the
start of the GRAM-byte string in it with the smallest hash (leftmost of equals).
Equal windows elect the same place, so two equal windows always meet at equal
anchors, and one anchor serves all neighbouring windows that elect it (about
REACH / 2 of them).  An anchor whose GRAM bytes occur once in the corpus cannot
belong to a repeat; the others are the suffixes to be sorted.

Each task cuts its suffixes (the LENGTH bytes from the anchor on, then the REACH
bytes before it, backwards) by a hash of the anchor into ranges, sorts every
range, and sends it as a front-coded run.  A range's runs are combined by a
loser tree in which a suffix carries the length of the prefix it shares with
the last one put out: only bytes beyond known common prefixes are compared, and
the result comes with its common-prefix array.  From that array, and the like
one of the parts before the anchors, follows for every distance d between a
window's start and its anchor which windows are equal; they are removed wherever
they stand.  Equality is always decided on bytes.

An anchor string with more than HOT places (a passage that a large part of the
corpus shares) would be one group too large for a task: its windows are counted
one by one instead, by a digest of their 200 bytes with map-side combining.

Null texts are empty; rows are documents of their own even if they repeat ids
or texts; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import binaries, discarded, same_key, saved, sifted

LENGTH = 200
GRAM = 50
REACH = LENGTH - GRAM
WIDTH = LENGTH + REACH
PER_RANGE = 8_000
HOT = 100_000
BLOCK = 1 << 18  # window starts looked at together
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def elect(data: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(hash, anchor, first window, last window) for all windows of ``data``, by runs of windows with one anchor."""
    up, down = table
    found = []
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        part = data[at:at + BLOCK + LENGTH - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * down[:len(part) - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low = (h & np.uint64((1 << 64) - (1 << 20))) | np.arange(len(h), dtype=np.uint64)
        cover = 1
        while 2 * cover <= REACH + 1:
            low = np.minimum(low[:-cover], low[cover:])
            cover *= 2
        rest = REACH + 1 - cover
        low = np.minimum(low[:len(low) - rest], low[rest:]) if rest else low
        place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        anchor = place[first]
        found.append((h[anchor], anchor + at, first + at, last + at))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def _clip(anchors, starts: np.ndarray, ends: np.ndarray):
    """Anchors of windows that lie in one document: (document, hash, anchor, nearest, farthest window)."""
    h, a, first, last = anchors
    doc = np.searchsorted(starts, a, "right") - 1
    first, last = np.maximum(first, starts[doc]), np.minimum(last, ends[doc] - LENGTH)
    ok = first <= last
    return doc[ok], h[ok], (a - starts[doc])[ok], (a - last)[ok], (a - first)[ok]


def anchors(rows: DataFrame) -> DataFrame:
    """(key, h, gram, a, lo, hi) of every anchor in ``rows`` (key, h, text)."""
    def run(batches):
        table = powers(BLOCK + 2 * LENGTH)
        for batch in batches:
            texts = binaries(batch.column(2))
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < BLOCK:
                    size += len(texts[to])
                    to += 1
                data = np.frombuffer(b"".join(texts[at:to]), np.uint8)
                ends = np.cumsum([len(t) for t in texts[at:to]])
                doc, h, a, lo, hi = _clip(elect(data, table), ends - [len(t) for t in texts[at:to]], ends)
                of = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(h.view(np.int64)),
                                                  pa.array(a), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16))], ["key", "h", "gram", "a", "lo", "hi"])
                at = to

    kind = rows.schema["key"].dataType.simpleString()
    return rows.where(F.octet_length("text") >= LENGTH).select("key", "h", "text").mapInArrow(
        run, f"key {kind}, h bigint, gram bigint, a bigint, lo smallint, hi smallint")


def front_code(keys: list[bytes]) -> tuple[list[int], bytes]:
    """Shared prefix lengths with the predecessor, and the rest of every key."""
    shared, rest, last = [], [], b""
    for k in keys:
        n = prefix(last, k, 0) if last else 0
        shared.append(n)
        rest.append(k[n:])
        last = k
    return shared, b"".join(rest)


def prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two suffixes of WIDTH bytes that share ``known`` bytes."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return WIDTH - (x.bit_length() + 7) // 8


def decode(shared: list[int], rest: bytes):
    """(shared prefix with the predecessor, key) of a front-coded run."""
    last, at = b"", 0
    for n in shared:
        last = last[:n] + rest[at:at + WIDTH - n]
        at += WIDTH - n
        yield n, last


def merge(runs: list) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """Loser tree over front-coded runs: keys in order, common prefixes with the predecessor, (run, place).

    ``known[r]`` is what run r's head shares with the last key put out.  Of two heads the one that
    shares more is the smaller; only equal lengths call for a comparison, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    readers = [iter(r) for r in runs] + [iter(())] * (size - len(runs))
    head: list = [next(r, None) for r in readers]
    known = [0] * size
    head = [x and x[1] for x in head]
    place = [0] * size
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then knows what it shares with the winner."""
        if head[a] is None:
            return b, a
        if head[b] is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = prefix(head[a], head[b], known[a])
        if n == WIDTH:
            known[b] = n
            return a, b
        a, b = (a, b) if head[a][n] < head[b][n] else (b, a)
        known[b] = n
        return a, b

    level = list(range(size))
    while len(level) > 1:  # the first round, from the leaves up
        half = len(level) // 2
        won = []
        for i in range(half):
            w, tree[half + i] = play(level[2 * i], level[2 * i + 1])
            won.append(w)
        level = won
    winner = level[0]
    keys, common, origin = [], [], []
    while head[winner] is not None:
        keys.append(head[winner])
        common.append(known[winner])
        origin.append((winner, place[winner]))
        place[winner] += 1
        step = next(readers[winner], None)
        head[winner], known[winner] = (step[1], step[0]) if step else (None, 0)
        node = (winner + size) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2
    return keys, common, origin


def repeats(keys: np.ndarray, common: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """covered[i, d]: the window that starts d bytes before the anchor of suffix i stands elsewhere too.

    ``keys``: sorted distinct suffixes (rows of WIDTH bytes); ``common``: their common-prefix array.
    """
    n = len(keys)
    covered = np.zeros((n, REACH + 1), bool)
    back = np.ascontiguousarray(keys[:, LENGTH:])
    order = np.argsort(back.view(f"S{REACH}").ravel(), kind="stable")
    ordered = back[order]
    differ = ordered[1:] != ordered[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), REACH)
    side = np.empty(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        valid = np.flatnonzero((lo <= d) & (d <= hi))
        if len(valid):
            ahead = np.cumsum(np.concatenate([[0], common[1:] < LENGTH - d]))
            side[order] = np.cumsum(np.concatenate([[0], shared < d]))
            _, of = np.unique(ahead[valid] * n + side[valid], return_inverse=True)
            covered[valid, d] = np.bincount(of, weights=weight[valid])[of] > 1
    return covered


RUN = ("range bigint, shared array<int>, rest binary, ent array<int>, doc array<string>, h array<bigint>, "
       "a array<bigint>, lo array<int>, hi array<int>")
SPANS = "doc string, h bigint, start bigint, end bigint"


def suffix_of(text: bytes, a: int) -> bytes:
    return text[a:a + LENGTH].ljust(LENGTH, b"\0") + text[max(0, a - REACH):a][::-1].ljust(REACH, b"\0")


def runs(rows: DataFrame, ranges: int, held: int = 60_000) -> DataFrame:
    """Sorted front-coded runs by range, of the suffixes listed in ``at`` (gram, a, lo, hi) of each text."""
    def flush(found: dict):
        for number, own in found.items():
            own.sort(key=operator.itemgetter(0))
            keys, ent = [], []
            for e in own:
                if not keys or keys[-1] != e[0]:
                    keys.append(e[0])
                ent.append(len(keys) - 1)
            shared, rest = front_code(keys)
            _, doc, h, a, lo, hi = zip(*own)
            yield number, shared, rest, ent, doc, h, a, lo, hi

    def batch_of(out):
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["range", "shared", "rest", "ent", "doc", "h", "a", "lo", "hi"])

    def run(batches):
        found, size = {}, 0
        for batch in batches:
            for doc, h, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2)), batch.column(3)):
                at = at.values
                for gram, a, lo, hi in zip(*(at.field(c).to_pylist() for c in ("gram", "a", "lo", "hi"))):
                    found.setdefault(gram % ranges, []).append((suffix_of(text, a), doc, h, a, lo, hi))
                    size += 1
                if size >= held:
                    yield batch_of(list(flush(found)))
                    found, size = {}, 0
        if found:
            yield batch_of(list(flush(found)))

    return rows.select(F.col("key").cast("string").alias("doc"), "h", "text", "at").mapInArrow(run, RUN)


def _range(tab: pa.Table) -> pa.Table:
    """Merges a range's runs and returns the repeated stretches around its anchors."""
    coded = list(zip(tab["shared"].to_pylist(), (x.as_py() for x in tab["rest"])))
    keys, common, origin = merge([decode(*c) for c in coded])
    # Equal keys of several runs fall together; members are distinct (key, lo, hi).
    number = np.cumsum(np.array(common) < WIDTH) - 1
    of = {o: int(k) for o, k in zip(origin, number)}
    member: dict[tuple, int] = {}
    places = []
    for r, (ent, doc, h, a, lo, hi) in enumerate(zip(*(tab[c].to_pylist() for c in ("ent", "doc", "h", "a", "lo", "hi")))):
        for e, *place, low, high in zip(ent, doc, h, a, lo, hi):
            places.append((member.setdefault((of[r, e], low, high), len(member)), *place))
    names = np.array(sorted(member), np.int64)
    rank = np.empty(len(member), np.int64)
    rank[[member[tuple(x)] for x in names.tolist()]] = np.arange(len(names))
    first = np.flatnonzero(np.array(common) < WIDTH)
    flat = np.frombuffer(b"".join(keys[i] for i in first), np.uint8).reshape(-1, WIDTH)[names[:, 0]]
    lcp = np.array(common)[first][names[:, 0]]
    lcp[1:][names[1:, 0] == names[:-1, 0]] = WIDTH
    at = rank[[p[0] for p in places]]
    covered = repeats(flat, lcp, names[:, 1], names[:, 2], np.bincount(at, minlength=len(names)))
    edges = np.diff(np.pad(covered.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    spans: dict[int, list] = {}
    for i, lo, hi in zip(*np.nonzero(edges == 1), np.nonzero(edges == -1)[1]):
        spans.setdefault(int(i), []).append((int(hi) - 1, int(lo)))
    out = [(doc, h, a - far, a - near + LENGTH) for m, (_, doc, h, a) in zip(at.tolist(), places) for far, near in spans.get(m, ())]
    return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["doc", "h", "start", "end"])


def counted_windows(rows: DataFrame) -> DataFrame:
    """Repeated windows among those of anchors with very many places, by digests of their bytes."""
    def run(batches):
        for batch in batches:
            for doc, h, text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2)), batch.column(3).to_pylist()):
                starts = sorted({x["a"] - d for x in at for d in range(x["lo"], x["hi"] + 1)})
                yield pa.RecordBatch.from_arrays([
                    pa.array([xxhash.xxh3_128_digest(text[s:s + LENGTH]) for s in starts], pa.binary()), pa.array([doc] * len(starts), pa.string()),
                    pa.array([h] * len(starts), pa.int64()), pa.array(starts, pa.int64())], ["window", "doc", "h", "start"])

    found = saved(rows.select(F.col("key").cast("string").alias("doc"), "h", "text", "at").mapInArrow(run, "window binary, doc string, h bigint, start bigint"), "windows")
    # Written, so that the join has two plain shuffles and a very frequent window can be split.
    again = saved(found.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window"), "repeated-windows")
    return found.join(again, "window").select("doc", "h", "start", (F.col("start") + LENGTH).alias("end"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc, h, spans): stretches of each text (key, h, text) covered by repeated windows, unmerged."""
    every = light = saved(anchors(rows), "anchors")
    shared = saved(light.groupBy("gram").agg(F.count("*").alias("places")).where("places > 1"), "shared-grams")
    light = light.join(shared, "gram").groupBy("key", "h").agg(
        F.collect_set(F.when(F.col("places") <= HOT, F.struct("gram", "a", "lo", "hi"))).alias("at"),
        F.collect_set(F.when(F.col("places") > HOT, F.struct("gram", "a", "lo", "hi"))).alias("hot"))
    light = saved(light, "shared-anchors")
    discarded(every)
    size = light.agg(F.sum(F.size("at")), F.sum(F.size("hot")), F.count("*")).first()
    l, r = light.alias("l"), sifted(rows, "h", light, size[2]).where("__maybe").alias("r")  # texts without a shared anchor stay at home
    both = r.join(l, same_key(F.col("r.key"), F.col("l.key")) & (F.col("r.h") == F.col("l.h"))).select("r.key", "r.h", "text", "at", "hot")
    spans = runs(both.where(F.size("at") > 0), max(1, -(-(size[0] or 0) // PER_RANGE))).groupBy("range").applyInArrow(_range, SPANS)
    if size[1]:
        spans = spans.unionByName(counted_windows(both.where(F.size("hot") > 0).withColumn("at", F.col("hot"))))
    return saved(spans, "spans").groupBy("doc", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256."""
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("h"), body.alias("text"))
    spans = saved(repeated_spans(rows), "spans-of-texts")
    sieved = sifted(rows, "h", spans, spans.count())
    concerned = sieved.where("__maybe").drop("__maybe")
    spans = spans.withColumnRenamed("h", "h2")
    both = concerned.join(spans, same_key(F.col("key").cast("string"), F.col("doc")) & (F.col("h") == F.col("h2")), "left").select("key", "text", "spans")
    both = both.unionByName(sieved.where("NOT __maybe").select("key", "text"), allowMissingColumns=True)

    def cut(batches):
        for batch in batches:
            out = []
            for value, spans in zip(binaries(batch.column(1)), batch.column(2).to_pylist()):
                gone, kept, at, n = 0, [], 0, 0
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if s[0] > at or not n:
                        kept.append(value[at:s[0]])
                        n += 1
                        gone += s[1] - s[0]
                        at = s[1]
                    elif s[1] > at:
                        gone += s[1] - at
                        at = s[1]
                kept.append(value[at:])
                left = b"".join(kept)
                out.append((len(value), gone, n, left, hashlib.sha256(left).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))],
                                             ["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return both.mapInArrow(cut, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string").withColumnRenamed("key", key)
