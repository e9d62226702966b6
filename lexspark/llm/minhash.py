"""MinHash near-dedup: universal hash minima, banding, verification, components.

One pass over the texts gives every document the number of its distinct word
shingles, a digest of that set and the band keys of its hash minima.  Documents
with equal sets are one node (the smallest id).  Nodes that share a band key are
candidates.  Each bucket has a hub: the member that shares most bands with others
(of a family, usually its origin).  The hub meets the whole bucket, links are
verified and components formed.  Members that do not lie in the hub's component
are open; buckets with one hub are one group, and a group's open members meet all
its members of other components, in tiles: open and other members are cut into
blocks of bounded size, every pair of blocks compares its full shingle sets at
once, and only links that join components leave it.  So a family whose members
are mostly too far from each other costs tiles, not rows, and no candidate is
left out: whatever is skipped lies in one component already, or differs too much
in size for a link.  Candidates are always decided on the full sets.

Null texts and texts without words have an empty set and link with nothing.
Rows that repeat an id are one node, and each keeps its row; a row with a null
id has no node (component null, kept).  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import binaries, same_key, saved, space_words
from lexspark.llm.components import connected

BANDS, ROWS = 24, 6
TILE = 400_000  # shingles of a block
COLUMNS = 4096  # shingles of a step of the comparison
WORDS = 100_000  # words whose hashes a task keeps
PART = 500  # rows of a batch that are worked on at once


class _Words(dict):
    """64-bit hashes of words, kept for the words of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, size: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words (one run if there are fewer)."""
    found = space_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - size + 1)
    mixed = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        mixed = (mixed ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * np.uint64(0xBF58476D1CE4E5B9))


def family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``count`` universal hashes modulo 2^32."""
    rng = np.random.default_rng(1997)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(best, (x[at:at + 4096, None] * a + b).min(0), out=best)
    return best


def _parts(batches):
    for batch in batches:
        for at in range(0, len(batch), PART):
            yield batch.slice(at, PART)


def signatures(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """(key, n, cls, bands) of every row."""
    a, b = family(bands * rows)

    def run(batches):
        words = _Words()
        for batch in _parts(batches):
            n, cls, keys = [], [], []
            for value in binaries(batch.column(1)):
                hashes = shingles(value, size, words) if value else np.zeros(0, np.uint64)
                n.append(len(hashes))
                cls.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                low = minima(hashes, a, b)
                keys.append([xxhash.xxh3_64_intdigest(band.tobytes(), seed=k) - (1 << 63) for k, band in enumerate(low.reshape(bands, rows))] if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                                              pa.array(keys, pa.list_(pa.int64()))], ["key", "n", "cls", "bands"])

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string")).mapInArrow(
        run, "key bigint, n bigint, cls binary, bands array<bigint>")


def like_sizes(percent: int, one: str, two: str):
    """Two sets of these sizes can be near enough: the smaller one at best lies in the larger."""
    return 100 * F.least(one, two) >= percent * F.greatest(one, two)


def hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, hub) whose sets have 100 * common >= percent * united."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = both.join(sets.select(F.col("node").alias("hub"), F.col("set").alias("set_hub")), "hub")

    def check(batches):
        for batch in _parts(batches):
            ok = []
            for x, y in zip(binaries(batch.column("set_a")), binaries(batch.column("set_hub"))):
                mine, hub = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = _common(mine, hub)
                ok.append(100 * common >= percent * (len(mine) + len(hub) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("hub")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "hub", "set_a", "set_hub").mapInArrow(check, "a bigint, b bigint").distinct()


def _common(mine: np.ndarray, other: np.ndarray) -> int:
    """Members that two sorted sets share."""
    at = np.searchsorted(other, mine)
    at[at == len(other)] = 0
    return int((other[at] == mine).sum()) if len(other) else 0


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, set): the sorted shingle hashes of (node, text)."""
    def run(batches):
        words = _Words()
        for part in _parts(batches):
            found = [shingles(t, size, words).tobytes() for t in binaries(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, set binary")


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of both sides."""
    sizes = [np.array([len(x) for x in side]) for side in (one, two)]
    names, code = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    codes = np.split(code, [int(sizes[0].sum())])
    there = [np.bincount(c, minlength=len(names)) > 0 for c in codes]
    column = np.cumsum(there[0] & there[1]) - 1  # only shingles of both sides count
    kept = there[0] & there[1]
    total = np.zeros((len(one), len(two)), np.float32)
    sides = []
    for r, c in zip(rows, codes):
        use = kept[c]
        order = np.argsort(column[c[use]], kind="stable")
        sides.append((r[use][order], column[c[use]][order]))
    for low in range(0, int(kept.sum()), COLUMNS):
        part = []
        for (r, c), n in zip(sides, map(len, (one, two))):
            lo, hi = np.searchsorted(c, [low, low + COLUMNS])
            dense = np.zeros((n, COLUMNS), np.float32)
            dense[r[lo:hi], c[lo:hi] - low] = 1
            part.append(dense)
        total += part[0] @ part[1].T
    return total.astype(np.int64)


def _tile(tab: pa.Table, percent: int) -> pa.Table:
    """Links between the components of a pair of blocks, as a forest: at most one fewer than there are components."""
    sides = [tab.filter(pc.equal(tab["open"], flag)) for flag in (True, False)]
    nodes, parts = ([t[c].to_numpy() for t in sides] for c in ("node", "part"))
    sets = [[np.frombuffer(v, np.uint64) for x in t["set"].chunks for v in binaries(x)] for t in sides]
    found = []
    if len(nodes[0]) and len(nodes[1]):
        root: dict = {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        size = [np.array([len(x) for x in s]) for s in sets]
        for at in range(0, len(nodes[0]), 512):
            for to in range(0, len(nodes[1]), 512):
                common = _shared(sets[0][at:at + 512], sets[1][to:to + 512])
                united = size[0][at:at + 512, None] + size[1][None, to:to + 512] - common
                near = (100 * common >= percent * united) & (parts[0][at:at + 512, None] != parts[1][None, to:to + 512])
                for i, j in zip(*np.nonzero(near)):
                    a, b = top(int(parts[0][at + i])), top(int(parts[1][to + j]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        found.append((int(nodes[0][at + i]), int(nodes[1][to + j])))
    return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def open_links(groups: DataFrame, sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join components of a group; ``groups``: (hub, node, n, part, open) with every member once."""
    total = groups.groupBy("hub").agg(F.ceil(F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)) / tile).alias("opens"), F.ceil(F.sum("n") / tile).alias("alls"))
    rows = groups.join(saved(total.where("opens > 0"), "tiles"), "hub").join(sets, "node")
    columns = ["hub", "node", "part", "set"]

    def side(df, own, other, flag):
        block = F.pmod(F.xxhash64("node"), F.col(own))
        return df.select(*columns, F.lit(flag).alias("open"), block.alias(f"{own}_no"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(f"{other}_no"))

    both = side(rows.where("open"), "opens", "alls", True).unionByName(side(rows, "alls", "opens", False))
    return both.groupBy("hub", "opens_no", "alls_no").applyInArrow(lambda t: _tile(t, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85,
                    bands: int = BANDS, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id, kept.  Keys are integers."""
    marked = saved(signatures(docs, key, text, size, bands, rows), "signatures")
    classes = marked.where("n > 0").groupBy("cls").agg(F.min("key").alias("node"))
    nodes = marked.where("n > 0").join(classes.select("node").distinct(), F.col("key") == F.col("node"), "left_semi") \
        .select(F.col("key").alias("node"), "n", "bands")
    in_band = nodes.select("node", "n", F.explode("bands").alias("band")).distinct()
    sizes = saved(in_band.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "bands")
    shared = saved(in_band.join(sizes, "band"), "buckets")  # members of buckets with two nodes or more
    degree = saved(shared.groupBy("node").agg(F.sum("size").alias("degree")), "degrees")
    work = saved(shared.join(degree, "node").select("band", "node", "n", "degree"), "members")
    best = work.groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "n")).alias("m"))
    best = saved(best.select("band", F.expr("-m.minus").alias("hub"), F.col("m.n").alias("hub_n")), "hubs")
    members = saved(work.join(best, "band").select("hub", "hub_n", "node", "n").distinct(), "groups")  # buckets with one hub are one group
    pairs = members.where(F.col("node") != F.col("hub")).where(like_sizes(percent, "n", "hub_n")).select(F.col("node").alias("a"), "hub")
    base = docs.select(F.col(key).cast("bigint").alias("node"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    sets = saved(shingle_sets(base.join(degree.select("node"), "node", "left_semi").distinct(), size), "sets")
    links = saved(hub_links(pairs, sets, percent), "hub-links")
    parts = saved(connected(links), "hub-parts")
    placed = members.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    of_hub = parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_part"))
    placed = placed.join(of_hub, "hub", "left").withColumn("open", F.col("part") != F.coalesce("hub_part", "hub"))
    fresh = open_links(saved(placed.select("hub", "node", "n", "part", "open"), "placed"), sets, percent, tile)
    parts = saved(connected(links.unionByName(saved(fresh, "open-links"))), "parts")
    part = F.coalesce("component", "node")
    of = saved(classes.join(parts, "node", "left").select("cls", part.alias("component")), "classes")  # two plain shuffles meet: a frequent class splits
    out = marked.select("key", "n", "cls").join(of, "cls", "left")
    own = F.when(F.col("key").isNull(), F.lit(None)).otherwise(F.coalesce("component", "key")).cast("bigint")
    out = out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", same_key(F.col(key), F.col("component_id")))
