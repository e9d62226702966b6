"""Near-duplicate vectors by an inverted multi-index.

Two independent codebooks, one for each half of the vectors, span a product
grid of cells; every vector lies in one cell per label.  A vector visits the
cells in the order of the sum of its two squared half distances (the
multi-sequence order) as far as the radius within which a neighbour at the
threshold lies with the target probability; the radius is measured on a bounded
sample, whose vectors get an artificial neighbour at the threshold in a random
direction.  Of two cells the smaller visits the larger, so a pair meets once.
Every meeting is verified in double precision: a link is never guessed.

Equal vectors of a label are one node with a count.  A crowded cell is cut on
both sides into blocks of bounded size, and each pair of blocks is a group of
its own that returns counts and a spanning forest of its links, not the pairs.

Vectors that are null, empty, zero, or hold null or non-finite numbers, and
rows without a label link with nothing; vectors of different lengths never
link.  Rows that share an id are the same vector of the result: their links are
counted per row, and their component is common where both link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import saved, same_key
from lexspark.llm.components import connected

THRESHOLD = 0.93
TARGET = 0.99  # recall aimed at for neighbours just at the threshold
SAMPLE = 20_000  # vectors that fit the codebooks and the radius
PER_CELL = 200  # vectors a cell of the grid, all labels together
BLOCK = 1_000


def nodes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(node, label, vec, n): distinct usable vectors with the smallest id and the number of their rows."""
    v = F.col("vec")
    sound = F.col("label").isNotNull() & v.isNotNull() & F.col("key").isNotNull()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"),
                          F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("vec")).where(sound)
    rows = rows.where((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("label", "vec").agg(F.min("key").alias("node"), F.count("*").alias("n"))


def _kmeans(data: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    centres = data[rng.choice(len(data), k, replace=False)].copy()
    for _ in range(rounds):
        own = (2 * data @ centres.T - (centres ** 2).sum(1)).argmax(1)
        total, size = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(total, own, data)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def _distances(unit: np.ndarray, books) -> list[np.ndarray]:
    half = unit.shape[1] // 2
    return [(x ** 2).sum(1)[:, None] - 2 * x @ c.T + (c ** 2).sum(1) for x, c in zip((unit[:, :half], unit[:, half:]), books)]


def fit(found: DataFrame, threshold: float, target: float, sample: int, per_cell: int) -> dict[int, tuple]:
    """By vector length: the two codebooks and the radius of the traversal, from at most ``sample`` vectors."""
    total = found.count()
    k = max(1, round((total / per_cell) ** 0.5))
    rows = found.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r["vec"]), []).append(r["vec"])
    grids, rng = {}, np.random.default_rng(7)
    for length, vectors in by_length.items():
        unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
        size = min(k, len(unit)) if length > 1 else 1
        books = [_kmeans(unit[:, :length // 2], size), _kmeans(unit[:, length // 2:], size)]
        some = unit[:4_000]
        side = rng.normal(size=some.shape)
        side -= (side * some).sum(1)[:, None] * some
        norm = np.linalg.norm(side, axis=1)
        side /= np.where(norm > 0, norm, 1)[:, None]
        there = _distances(threshold * some + (1 - threshold ** 2) ** 0.5 * side, books)
        over = sum(d[np.arange(len(some)), e.argmin(1)] - d.min(1) for d, e in zip(_distances(some, books), there))
        grids[length] = (*books, float(np.quantile(over, target)) + 1e-9)
    return grids


def _assign(found: DataFrame, grids: dict) -> DataFrame:
    """Adds the own cell and the larger cells visited; a length that no grid covers has one cell."""
    shared = found.sparkSession.sparkContext.broadcast(grids)  # bounded by the sample

    def run(batches):
        for batch in batches:
            column = batch.column("vec")
            lengths = np.diff(column.offsets.to_numpy())
            flat, starts = column.values.to_numpy(), column.offsets.to_numpy()
            cell, visits = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))]
            for length in np.unique(lengths):
                if int(length) not in shared.value:
                    continue
                a, b, radius = shared.value[int(length)]
                rows = np.flatnonzero(lengths == length)
                data = np.stack([flat[starts[r]:starts[r] + length] for r in rows])
                first, second = _distances(data / np.linalg.norm(data, axis=1)[:, None], (a, b))
                own = first.argmin(1) * len(b) + second.argmin(1)
                cell[rows] = own
                first, second = first - first.min(1)[:, None], second - second.min(1)[:, None]
                for r, x, y, c in zip(rows, first, second, own):
                    near_x, near_y = np.argsort(x), np.argsort(y)
                    grid = x[near_x][:, None] + y[near_y] <= radius  # a staircase from the nearest cell on
                    i, j = np.nonzero(grid)
                    cells = near_x[i] * len(b) + near_y[j]
                    visits[r] = np.append(cells[cells > c], c).tolist()
            for r in np.flatnonzero([not v for v in visits]):
                visits[r] = [0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int32()), pa.array(cell), pa.array(visits, pa.list_(pa.int64()))],
                                             [*batch.schema.names, "length", "cell", "visits"])

    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    return found.mapInArrow(run, f"{schema}, length int, cell bigint, visits array<bigint>")


def _meet(tab: pa.Table, threshold: float) -> pa.Table:
    """Links of a pair of blocks: counts per node, and a spanning forest."""
    length = tab["length"][0].as_py()
    ids, home, own, n = (tab[c].to_numpy(zero_copy_only=False) for c in ("node", "home", "own", "n"))
    vec = np.concatenate([c.flatten().to_numpy() for c in tab["vec"].chunks]).reshape(-1, length)
    unit = vec / np.linalg.norm(vec, axis=1)[:, None]
    here, there = np.flatnonzero(home), np.flatnonzero(~home)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    pairs = []
    for at in range(0, len(there), 2_000):
        v = there[at:at + 2_000]
        close = unit[v] @ unit[here].T >= threshold
        close &= ~own[v][:, None] | (ids[v][:, None] < ids[here])  # pairs of one cell meet from the smaller id
        i, j = np.nonzero(close)
        pairs.append(np.stack([v[i], here[j]]))
        np.add.at(links, v[i], n[here[j]])
        np.add.at(links, here[j], n[v[i]])
    a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
    # A member of both sides stands in two rows: number the nodes, then spread the smallest until nothing changes.
    names, code = np.unique(ids, return_inverse=True)
    a, b, root = code[a], code[b], np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    total = np.zeros(len(names), np.int64)
    np.add.at(total, code, links)
    out = np.flatnonzero(total)
    return pa.table([pa.array(names[out], pa.int64()), pa.array(total[out], pa.int64()), pa.array(names[root[out]], pa.int64())], ["node", "links", "root"])


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    """Home and visiting rows of every cell, cut into blocks that all meet each other."""
    cell = ["label", "length", "cell"]
    homes = rows.select("node", "label", "length", "vec", "n", "cell")
    guests = rows.select("node", "label", "length", "vec", "n", F.col("cell").alias("from"), F.explode("visits").alias("cell"))
    size = homes.groupBy(cell).agg(F.count("*").alias("h"), F.lit(0).cast("bigint").alias("g")).unionByName(
        guests.groupBy(cell).agg(F.lit(0).cast("bigint").alias("h"), F.count("*").alias("g")))
    size = size.groupBy(cell).agg(F.ceil(F.sum("h") / block).alias("h"), F.ceil(F.sum("g") / block).alias("g"))
    crowded = saved(size.where("h > 0 AND (h > 1 OR g > 1)"), "crowded")
    h, g = F.coalesce("h", F.lit(1)), F.coalesce("g", F.lit(1))

    def cut(side, own, other):
        both = side.join(crowded, cell, "left")
        return both.withColumn(f"{own}_block", F.pmod(F.xxhash64("node"), h if own == "h" else g)).withColumn(
            f"{other}_block", F.explode(F.sequence(F.lit(0).cast("bigint"), (g if own == "h" else h) - 1)))

    names = [*cell, "h_block", "g_block", "node", "vec", "n", "home", "own"]
    homes = cut(homes.withColumn("home", F.lit(True)).withColumn("own", F.lit(True)), "h", "g").select(names)
    guests = cut(guests.withColumn("home", F.lit(False)).withColumn("own", F.col("from") == F.col("cell")), "g", "h").select(names)
    return homes.unionByName(guests)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, target: float = TARGET, sample: int = SAMPLE,
                    per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: ``key``, n_links, component_id, kept.  Keys are integers."""
    found = saved(nodes(vectors, key, vector, label), "nodes")
    rows = saved(_assign(found, fit(found, threshold, target, sample, per_cell)), "assigned")
    groups = _blocked(rows, block).groupBy("label", "length", "cell", "h_block", "g_block")
    met = saved(groups.applyInArrow(lambda tab: _meet(tab, threshold), "node bigint, links bigint, root bigint"), "met")
    parts = connected(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    of = found.join(links, "node", "left").join(parts, "node", "left").select(
        "label", "vec", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    # The component is the smallest id of the vector's rows or of what they link with.
    clean = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    base = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), clean.alias("vec"))
    out = base.join(of, (base["label"] == of["label"]) & (base["vec"] == of["vec"]) & base["key"].isNotNull(), "left").select(
        base["key"], F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", base["key"]).alias("component_id"))
    return out.select(F.col("key").alias(key), "n_links", "component_id", same_key(F.col("key"), F.col("component_id")).alias("kept"))
