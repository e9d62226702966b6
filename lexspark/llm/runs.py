"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least two periods and
``least`` words long, that neither neighbour extends.  Periods below ``SHORT``
are scanned directly: the words are compared with themselves, shifted by the
lag.  For each greater scale P (a power of two) the periods from P to 2P - 1 are
sought by minimizers: every window of P/2 neighbouring runs of P/2 words selects
the one with the smallest hash (the leftmost of equals).  A run of period q >= P
holds two equal windows at distance q, whose minima lie at distance q as well:
so equal minima at a distance of the scale are the seeds, and each seed is
extended word by word to both sides.

Where the words themselves repeat at a short distance (at most P/4), equal minima
follow each other in a progression, here called a cluster.  Two members of one
cluster seed nothing (a run around them would have the shorter period), and two
clusters seed each possible distance once, so that the number of seeds stays
linear in the text whatever it holds.

Texts are worked off in chunks of some ``CHUNK`` words, longest first, so that a
scale only reads the texts that are long enough for it.  A text is one row; memory
grows with the longest text.  Null and empty texts have no words and no runs.
Every row keeps its row; repeated rows are alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import binaries

SHORT = 16  # a power of two; periods below it are scanned directly
LEAST = 12
CHUNK = 1_000_000
SCHEMA = "array<struct<start: bigint, length: bigint, period: bigint>>"


class _Codes(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _short(x: np.ndarray, q: int, least: int) -> np.ndarray:
    """(start, length, period) of the maximal stretches of ``x`` with the lag ``q``."""
    same = np.flatnonzero(x[q:] == x[:-q])
    if not len(same):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(same) != 1)
    start, stop = same[np.append(0, cut + 1)], same[np.append(cut, len(same) - 1)] + 1
    long = stop - start >= max(q, least - q)
    return np.stack([start[long], stop[long] - start[long] + q, np.full(long.sum(), q)], axis=1)


def _wider(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of runs of 2 t words from those of t words."""
    out = (h[:-t] * np.uint64(0x9E3779B97F4A7C15) + h[t:]) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


def _selected(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places selected as a minimum by a window of ``width`` hashes, and their hashes (upper bits)."""
    bits = max(20, int(len(h)).bit_length())
    low = np.uint64((1 << bits) - 1)
    best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    at = best & low
    keep = np.append(True, at[1:] != at[:-1])
    return at[keep].astype(np.int64), (best[keep] & ~low)


def _seeds(h: np.ndarray, scale: int) -> np.ndarray:
    """(distance, place): pairs of equal minima whose distance is from ``scale`` to 2 ``scale`` - 1, one per distance and two clusters."""
    t = scale // 2
    at, key = _selected(h, t)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    alike = key[1:] == key[:-1]
    some = np.append(alike, False) | np.append(False, alike)
    at, key = at[some], key[some]
    if not len(at):
        return np.zeros((0, 2), np.int64)
    gap = np.diff(at)
    new = np.append(True, (key[1:] != key[:-1]) | (gap > t // 2))
    head = np.flatnonzero(new)
    first, last, key = at[head], at[np.append(head[1:], len(at)) - 1], key[head]
    step = np.gcd.reduceat(np.where(new, 0, np.append(0, gap)), head)
    found = []
    for ahead in range(1, len(head)):
        a = np.flatnonzero(key[ahead:] == key[:-ahead])
        b = a + ahead
        near = first[b] - last[a] < 2 * scale
        a, b = a[near], b[near]
        if not len(a):
            break
        g = np.gcd(step[a], step[b])
        lead = first[b] - last[a]
        g = np.where(g == 0, 4 * scale, g)  # two single members: one distance
        low = lead + np.maximum(0, -((lead - scale) // g)) * g
        high = np.minimum(last[b] - first[a], 2 * scale - 1)
        count = np.maximum(0, (high - low) // g + 1)
        row = np.repeat(np.arange(len(a)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        distance = low[row] + nth * g[row]
        found.append(np.stack([distance, np.minimum(last[a][row], last[b][row] - distance)], axis=1))
    if not found:
        return np.zeros((0, 2), np.int64)
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _same(x: np.ndarray, i: int, j: int, way: int) -> int:
    """How many words from ``i`` and ``j`` on are equal, forwards (1) or backwards (-1) without the two themselves; i < j."""
    n, size = 0, 64
    while True:
        a, b = (x[i + n:i + n + size], x[j + n:j + n + size]) if way > 0 else (x[max(0, i - n - size):max(0, i - n)][::-1], x[max(0, j - n - size):j - n][::-1])
        m = min(len(a), len(b))
        other = np.flatnonzero(a[:m] != b[:m])
        if len(other):
            return n + int(other[0])
        n += m
        if m < size:
            return n
        size *= 2


def _extended(x: np.ndarray, seeds: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) around the seeds, which are sorted; seeds within one stretch are extended once."""
    out, lag, until = [], 0, -1
    for q, at in seeds.tolist():
        if q == lag and at < until:
            continue
        lag, until = q, at + _same(x, at, at + q, 1)
        start = at - _same(x, at, at + q, -1)
        if until - start >= q:
            out.append((start, until - start + q, q))
    return out


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _smallest(x: np.ndarray, start: int, q: int) -> bool:
    """No shorter period divides ``q`` in a stretch that has it (the stretch holds two periods, so no other can be shorter)."""
    return not any(np.array_equal(x[start:start + q], x[start + q // p:start + q // p + q]) for p in _primes(q))


def runs_of(texts: list[list[bytes]], least: int = LEAST, short: int = SHORT) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each list of words, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    order = [i for i in order if len(texts[i]) >= least]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not order:
        return out
    codes, parts, starts, at = _Codes(), [], [], 0
    for k, i in enumerate(order):  # every text is followed by a code of its own, so nothing repeats across texts
        parts += [np.fromiter(map(codes.__getitem__, texts[i]), np.int64, len(texts[i])), np.array([-1 - k])]
        starts.append(at)
        at += len(texts[i]) + 1
    x, starts = np.concatenate(parts), np.array(starts)
    sizes = np.array([len(texts[i]) for i in order])

    def part(words: int) -> int:
        """End of the texts with so many words at least."""
        k = int(np.searchsorted(-sizes, -words, side="right"))
        return int(starts[k - 1] + sizes[k - 1] + 1) if k else 0

    found = [_short(x[:end], q, least) for q in range(1, short) if (end := part(max(least, 2 * q))) > q]
    h, t, scale = x.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 1, short
    h ^= h >> np.uint64(32)
    while (end := part(2 * scale)) > scale:
        h = h[:end - t + 1]
        while t < scale // 2:
            h, t = _wider(h, t), 2 * t
        found.append(np.array(_extended(x[:end], _seeds(h, scale)), np.int64).reshape(-1, 3))
        scale *= 2
    rows = np.unique(np.concatenate(found), axis=0)
    own = np.searchsorted(starts, rows[:, 0], side="right") - 1
    for k, (start, length, q) in zip(own.tolist(), rows.tolist()):
        if length >= least and _smallest(x, start, q):
            out[order[k]].append((start - int(starts[k]), length, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by a blank, without those that a run holds after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, q in runs:
            keep[start + q:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, short: int = SHORT,
                  rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_words, runs (by start, then period) and the collapsed text.

    Words are separated by blanks and the controls 09 to 0D.  ``rewrite``, if given, gets
    a row's key and words and returns the words to work on.
    """

    def worked(keys: list, words: list) -> pa.RecordBatch:
        runs = runs_of(words, least, short)
        flat = [r for each in runs for r in each]
        ends = np.cumsum([0] + [len(r) for r in runs]).astype(np.int32)
        start, length, period = np.array(flat, np.int64).reshape(-1, 3).T
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, keys[0].type if keys else pa.null()), pa.array([len(w) for w in words], pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends), spans), pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.binary())],
            ["key", "n_words", "runs", "collapsed"])

    def run(batches):
        for batch in batches:
            keys, words, size = [], [], 0
            for k, value in zip(batch.column(0), binaries(batch.column(1))):
                found = value.split() if value else []
                keys.append(k)
                words.append(rewrite(k.as_py(), found) if rewrite else found)
                size += len(found)
                if size >= CHUNK:
                    yield worked(keys, words)
                    keys, words, size = [], [], 0
            if keys:
                yield worked(keys, words)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, n_words bigint, runs {SCHEMA}, collapsed binary")
    return rows.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(key, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that the query's contract plants by the key's checksum; a null key plants none."""
    import zlib
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
