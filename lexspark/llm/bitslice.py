"""Exact top-k search by inner product over a bit-sliced index.

Every component is quantised to an integer (``floor(scale * x)``).  The index
holds blocks of rows; of each component it stores the smallest value and, for
every bit of the difference from it, one bitmap over the block's rows.  A query's
scores are a weighted sum of these bitmaps: weights of one power of two are added
by carry-save adders, three bitmaps to a sum and a carry, until every power has
one bitmap left.  Negative weights take the complemented bitmap, so that all
terms are positive, and a constant of query and block is put right at the end.
The top rows are then chosen from the most significant slice downwards: the rows
with the bit set stay if there are k or more, else all of them are taken and
the search goes on among the others.  Rows that are still equal after the last
slice are the boundary; of them the smallest ids fill the rest.

Blocks are cut from an even deal of all rows, so no key can crowd one; the
stated queries are dealt to packs in the same way, and every block meets every
pack in a group of its own.  Of each group at most k rows a query leave.

A vector that is null or holds null or non-finite components takes no part; a
zero or empty vector does.  Vectors of different lengths never meet.  A query
is a row; rows with its id are its own and no candidates.  Rows that repeat an
id are candidates one by one; a null id is no query, and as a candidate it
comes after all others among ties.  Other columns are ignored.  A table whose
scores could pass 62 bits is refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import saved

BLOCK = 4_096  # rows of a block of the index
PACK = 256  # queries of a pack
INDEX = "length int, n int, known int, ids binary, low binary, widths binary, slices binary"
PACKED = "length int, ids binary, weights binary"
FOUND = "pack int, length int, no int, query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(key, vec): the rows that take part, their components as integers."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), v.alias("vec")).where(F.col("vec").isNotNull() & sound)
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale)))


def _by_length(batch: pa.RecordBatch):
    """(length, ids, null ids, matrix) of the rows of each length."""
    column, ids = batch.column("vec"), batch.column("key")
    lengths = np.asarray(column.value_lengths(), np.int64)
    flat, starts = column.values.to_numpy(), column.offsets.to_numpy()
    null = np.asarray(ids.is_null())
    ids = ids.fill_null(0).to_numpy()
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        data = flat[starts[at][:, None] + np.arange(length)] if length else np.zeros((len(at), 0), np.int64)
        yield int(length), ids[at], null[at], data


def _gathered(batches, size: int):
    """(length, ids, null ids, matrix) of up to ``size`` rows of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        for at in range(0, len(batch), size):
            for length, ids, null, data in _by_length(batch.slice(at, size)):
                parts = held.setdefault(length, [])
                parts.append((ids, null, data))
                if sum(len(p[0]) for p in parts) >= size:
                    yield length, *(np.concatenate(c) for c in zip(*held.pop(length)))
    for length, parts in held.items():
        yield length, *(np.concatenate(c) for c in zip(*parts))


def sliced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest value and number of slices of each component, and all slices (a row of 64-bit words each)."""
    n, length = data.shape
    low = data.min(0) if n else np.zeros(length, np.int64)
    above = (data - low).T.astype(np.uint64)
    widths = np.array([int(a.max()).bit_length() for a in above], np.int32)
    words = -(-n // 64)
    bits = np.zeros((int(widths.sum()), words * 64), bool)
    row = 0
    for a, width in zip(above, widths):
        for j in range(width):
            bits[row, :n] = (a >> np.uint64(j)) & np.uint64(1)
            row += 1
    return low, widths, np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(len(bits), words)


def summed(parts: list[list[np.ndarray]], words: int) -> np.ndarray:
    """Slices (of so many words), least significant first, of the sum of the bitmaps; ``parts[p]`` weigh 2^p each."""
    out, p = [], 0
    parts = [list(p) for p in parts]
    while p < len(parts):
        rows = [r for r in parts[p] if len(r)]
        stack = np.concatenate(rows) if rows else None
        while stack is not None and len(stack) > 1:
            third = max(1, len(stack) // 3)
            a, b = stack[:third], stack[third:2 * third]
            c = stack[2 * third:3 * third]
            half = a ^ b
            if len(c):
                carry, total = (a & b) | (half & c), half ^ c
            else:  # two bitmaps are left
                carry, total = a & b, half
            if p + 1 == len(parts):
                parts.append([])
            parts[p + 1].append(carry)
            stack = np.concatenate([total, stack[3 * third:]]) if len(c) else total
        out.append(stack[0] if stack is not None else np.zeros(words, np.uint64))
        p += 1
    return np.array(out, np.uint64).reshape(len(out), words)


def top_rows(slices: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The bitmap's ``k`` rows with the greatest sliced values, the first rows among equals; all, if there are fewer."""
    sure, open_ = np.zeros_like(among), among
    for s in slices[::-1]:
        more = sure | (open_ & s)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            open_ = open_ & s
        else:
            sure, open_ = more, open_ & ~s
            if n == k:
                return _places(sure)
    rest = _places(open_)[:max(0, k - int(np.bitwise_count(sure).sum()))]
    return np.sort(np.append(_places(sure), rest))


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(bitmap).view(np.uint8), bitorder="little"))


def _searched(low, widths, slices, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of one query's scores over a block, and the constant to add."""
    edges = np.append(0, np.cumsum(widths))
    constant = int((weights.astype(object) * low.astype(object)).sum()) if len(low) else 0
    parts: list[list[np.ndarray]] = [[] for _ in range(int(np.abs(weights).max(initial=0)).bit_length() + int(widths.max(initial=0)))]
    for d in np.flatnonzero(weights):
        w, rows = int(weights[d]), slices[edges[d]:edges[d + 1]]
        if w < 0:  # w * u = |w| * (all ones - u) - |w| * all ones
            constant += w * ((1 << len(rows)) - 1)
            rows = ~rows
        for s in range(abs(w).bit_length()):
            if abs(w) >> s & 1:
                for j in range(len(rows)):
                    parts[s + j].append(rows[j:j + 1])
    return summed(parts, slices.shape[1]), constant


def _index(rows: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for length, ids, null, data in _gathered(batches, size):
            order = np.lexsort((ids, null))  # ids ascending, null ids last: the first rows win ties
            low, widths, slices = sliced(data[order])
            if len(data) and length * int(max(abs(int(data.min())), abs(int(data.max()))) if data.size else 0) ** 2 >> 62:
                raise ValueError("scores could pass 62 bits: choose a smaller scale")
            yield pa.RecordBatch.from_pylist([{"length": length, "n": len(ids), "known": int((~null).sum()), "ids": ids[order].astype("<i8").tobytes(),
                                               "low": low.astype("<i8").tobytes(), "widths": widths.astype("<i4").tobytes(), "slices": slices.tobytes()}],
                                             schema=pa.schema([("length", pa.int32()), ("n", pa.int32()), ("known", pa.int32())] + [(c, pa.binary()) for c in ("ids", "low", "widths", "slices")]))
    return rows.mapInArrow(run, INDEX)


def _packs(rows: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for length, ids, _, data in _gathered(batches, size):
            yield pa.RecordBatch.from_pylist([{"length": length, "ids": ids.astype("<i8").tobytes(), "weights": data.astype("<i8").tobytes()}],
                                             schema=pa.schema([("length", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary())]))
    return rows.mapInArrow(run, PACKED)


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """Table of blocks (one row each, numbered by ``block``) over every row that takes part."""
    parts = max(1, -(-vectors.count() // block))
    rows = quantised(vectors, key, vector, scale).repartition(parts)
    made = _index(rows, 2 * block)  # an even deal gives each task one block of each length
    return saved(made.withColumn("block", F.spark_partition_id()), "bit-slices")


def search(index: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
           pack: int = PACK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest scores of every row of ``queries``."""
    deal = max(1, -(-queries.count() // pack))
    packs = _packs(quantised(queries, key, vector, scale).where("key IS NOT NULL").repartition(deal), 2 * pack)
    packs = saved(packs.withColumn("pack", F.spark_partition_id()), "query-packs")
    blocks = _for_each(index, "block", packs, "pack").select("block", "pack", *_names(INDEX))
    asked = _for_each(packs, "pack", index, "block").select("block", "pack", *_names(PACKED))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for b in left.to_pylist():
            ids, low, widths = (np.frombuffer(b[c], t) for c, t in (("ids", "<i8"), ("low", "<i8"), ("widths", "<i4")))
            words = -(-b["n"] // 64)
            slices = np.frombuffer(b["slices"], np.uint64).reshape(-1, words)
            every = np.packbits(np.arange(words * 64) < b["n"], bitorder="little").view(np.uint64)
            for p in right.to_pylist():
                if p["length"] != b["length"]:
                    continue
                asks = np.frombuffer(p["ids"], "<i8")
                for no, (own, weights) in enumerate(zip(asks.tolist(), np.frombuffer(p["weights"], "<i8").reshape(len(asks), -1))):
                    scores, constant = _searched(low, widths, slices, weights)
                    among = every
                    lo, hi = np.searchsorted(ids[:b["known"]], [own, own + 1])
                    if hi > lo:  # the query's own rows
                        bits = np.ones(words * 64, bool)
                        bits[lo:hi] = False
                        among = every & np.packbits(bits, bitorder="little").view(np.uint64)
                    best = top_rows(scores, among, k)
                    for r in best.tolist():
                        value = sum((int(s[r >> 6]) >> (r & 63) & 1) << i for i, s in enumerate(scores))
                        out.append((p["pack"], p["length"], no, own, int(ids[r]) if r < b["known"] else None, value + constant))
        types = [pa.int32()] * 3 + [pa.int64()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], _names(FOUND))

    met = blocks.groupBy("block", "pack").cogroup(asked.groupBy("block", "pack")).applyInArrow(meet, FOUND)
    order = Window.partitionBy("pack", "length", "no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _for_each(rows: DataFrame, own: str, others: DataFrame, other: str) -> DataFrame:
    """``rows`` once for every number of ``others``, which are numbered from 0."""
    most = others.agg(F.coalesce(F.max(other), F.lit(-1))).first()[0]
    every = F.sequence(F.lit(0), F.lit(most)) if most >= 0 else F.array().cast("array<int>")
    return rows.withColumn(other, F.explode(every))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]
