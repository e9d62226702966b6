"""Words that travel to their sentence packed: a row per stretch of neighbouring words instead of a row per word.

A task packs the words of a sentence that follow each other in its input into one
row of bytes, of ``block`` word numbers at most; where they lie scattered, a row
holds one word and the result is the same.  Rows are dealt by sentence, or by
group of neighbouring sentences if contexts reach beyond one, and sorted by
sentence and word number there.  A task then lays out the words one behind the
other and keeps as many as a context can reach, so no sentence is one row.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple, Optional

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions.utf8 import Pool, bytes_of, glued, strings_of

BLOCK = 4096  # word numbers of a packed row, at most 1 << 16
CHUNK = 1 << 15  # words that are laid out at once
GROUP = 64  # sentences that are dealt together where contexts span sentences
WIDE, WHOLE = 1, 2  # marks of a packed row: sizes of four bytes, units that do not make up the word
TEXTS = ("word", "lemma", "tag")


def cuts(sizes: np.ndarray, most: int):
    """(start, stop) of consecutive stretches of ``sizes`` that sum up to at most ``most``, or hold one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, stop
        at = stop


def _opens(columns) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns; nulls are equal."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        code = pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


def _numbers(column: pa.Array) -> tuple:
    """(values as 64-bit integers, 0 where missing; whether they are there)."""
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _packed(batch: pa.RecordBatch, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words [first, first + count) of the batch as bytes; ``at``: their numbers in the block."""
    texts = [bytes_of(batch.column(c)) for c in TEXTS]
    sizes, held, marks = [np.diff(x) for _, x in texts], [(d, x) for d, x in texts], 0
    if "cu" in batch.schema.names:
        cu = batch.column("cu")
        units, ends = bytes_of(cu.flatten())
        number = pc.list_value_length(cu).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.append(0, np.cumsum(number))
        if not (np.array_equal(units, texts[0][0]) and np.array_equal(ends[upto], texts[0][1])):
            marks |= WHOLE
            held.append((units, ends[upto]))
        sizes += [number, np.diff(ends)]
    wide = max((int(x.max()) for x in sizes if len(x)), default=0) > 255
    kind = np.dtype("<u4" if wide else "u1")
    pool, last = Pool(), first + count
    parts = [(pool.add(np.array([marks | (WIDE if wide else 0)], np.uint8)), 1)]
    step = np.diff(at, prepend=0).astype(np.uint16)  # modulo 1 << 16
    step[first] = at[first]
    parts.append((pool.add(step.astype("<u2").view(np.uint8)) + 2 * first, 2 * count))
    for k, x in enumerate(sizes):
        own = pool.add(x.astype(kind).view(np.uint8))
        a, b = (upto[first], upto[last]) if k == 4 else (first, last)
        parts.append((own + kind.itemsize * a, kind.itemsize * (b - a)))
    for data, x in held:
        parts.append((pool.add(data) + x[first], x[last] - x[first]))
    data, ends = glued(pool.bytes(), len(first), *parts)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _packer(s: list, span: int, group: int, budget: Optional[int], block: int):
    """Function of record batches of words to batches of packed rows."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            number, there = _numbers(batch.column("word_no"))
            place = number // block
            opens = _opens([*[batch.column(c) for c in s], pa.array(place, mask=~there)])
            first = np.flatnonzero(opens)
            count = np.diff(np.append(first, len(number)))
            at = np.where(there, number - place * block, 0)
            dealt = []  # (run, first, count, group it goes to, home)
            if span > 0:
                sent, known = (x[first] for x in _numbers(batch.column(s[-1])))
                g, up = sent // group, np.append(np.diff(at) > 0, False)
                dealt.append((np.arange(len(first)), first, count, g, True))
                falls = np.add.reduceat(~up, first) > 1  # the words of the run do not rise: all of them go
                few = count if budget is None else np.where(falls, count, np.minimum(count, budget))
                last = batch.column("last").fill_null(False).to_numpy(zero_copy_only=False)[first] if "last" in batch.schema.names else np.zeros(len(first), bool)
                before, behind = np.flatnonzero(known & (sent % group >= group - span)), np.flatnonzero(known & ~last & (sent % group < span))
                dealt += [(before, (first + count - few)[before], few[before], g[before] + 1, False), (behind, first[behind], few[behind], g[behind] - 1, False)]
            else:
                dealt.append((np.arange(len(first)), first, count, None, True))
            for runs, start, size, to, home in dealt:
                start, size, runs, to = (x if x is None else x[size > 0] for x in (start, size, runs, to))
                if not len(runs):
                    continue
                rows = pa.array(first[runs])
                out = {c: batch.column(c).take(rows) for c in s}
                if span > 0:
                    out |= {"__group": pa.array(to, mask=~known[runs]), "__home": pa.array(np.full(len(runs), home)), "__last": pa.array(last[runs])}
                out |= {"__block": pa.array(place[first[runs]], mask=~there[first[runs]]), "__n": pa.array(size.astype(np.int32)), "__ws": _packed(batch, start, size, at)}
                yield pa.RecordBatch.from_pydict(out)

    return run


def pack(tokens: DataFrame, sent, budget: Optional[int], span: int = 0, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Packed rows of ``tokens`` (sent keys, word_no, word, lemma, tag, maybe cu and last), dealt and sorted for ``laid_out``."""
    s, types = list(sent), dict(tokens.dtypes)
    fields = [f"`{c}` {types[c]}" for c in s] + (["__group bigint", "__home boolean", "__last boolean"] if span > 0 else []) + ["__block bigint", "__n int", "__ws binary"]
    rows = tokens.mapInArrow(_packer(s, span, max(group, 2 * span), budget, block), ", ".join(fields))
    order = [*s[:-1], "__group"] if span > 0 else s
    return rows.repartition(*order).sortWithinPartitions(*order, *([s[-1]] if span > 0 else []), "__block")


class Words(NamedTuple):
    """Words in order. ``texts``: word, lemma, tag and maybe cu; ``no``, ``known``: their numbers; ``row``: the packed row that each lies in."""
    texts: dict
    no: np.ndarray
    known: np.ndarray
    row: np.ndarray

    def at(self, places) -> Words:
        if isinstance(places, slice):
            return Words({c: x[places] for c, x in self.texts.items()}, self.no[places], self.known[places], self.row[places])
        return Words({c: x.take(pa.array(places)) for c, x in self.texts.items()}, self.no[places], self.known[places], self.row[places])

    def followed(self, other: Words, rows: int) -> Words:
        """These words and then ``other``, whose rows come behind ``rows`` ones."""
        return Words({c: pa.concat_arrays([x, other.texts[c]]) for c, x in self.texts.items()}, np.append(self.no, other.no),
                     np.append(self.known, other.known), np.append(self.row, other.row + rows))


def _sums(sizes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``count`` sizes."""
    upto, ends = np.append(0, np.cumsum(sizes)), np.cumsum(count)
    return upto[ends] - upto[ends - count]


def _unpacked(rows: pa.RecordBatch, block: int, cu: bool) -> Words:
    """The words of packed rows, as they lie there."""
    data, at = bytes_of(rows.column("__ws"))
    n, marks = rows.column("__n").to_numpy().astype(np.int64), data[at[:-1]]
    place, known = _numbers(rows.column("__block"))
    edges = np.append(np.flatnonzero(np.append(True, marks[1:] != marks[:-1])), len(marks))
    numbers, texts = [], {c: [] for c in (*TEXTS, *(["cu"] if cu else []))}
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        kind, count, here = np.dtype("<u4" if marks[a] & WIDE else "u1"), n[a:b], at[a:b] + 1

        def taken(size):
            nonlocal here
            out, here = glued(data, b - a, (here, size))[0], here + size
            return out

        step = taken(2 * count).view("<u2").astype(np.int64)
        upto, ends = np.cumsum(step), np.cumsum(count)
        numbers.append((upto - np.repeat(upto[ends - count] - step[ends - count], count)) & 0xFFFF)
        sizes = [taken(kind.itemsize * count).view(kind).astype(np.int64) for _ in TEXTS]
        if cu:
            number = taken(kind.itemsize * count).view(kind).astype(np.int64)
            units = _sums(number, count)
            unit = taken(kind.itemsize * units).view(kind).astype(np.int64)
        for c, x in zip(TEXTS, sizes):
            texts[c].append(strings_of(taken(_sums(x, count)), np.append(0, np.cumsum(x))))
        if cu:
            held = taken(_sums(unit, units)) if marks[a] & WHOLE else bytes_of(texts["word"][-1])[0]
            texts["cu"].append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)).astype(np.int32)), strings_of(held, np.append(0, np.cumsum(unit)))))
    row = np.repeat(np.arange(len(n)), n)
    return Words({c: pa.concat_arrays(x) for c, x in texts.items()}, np.concatenate(numbers) + (place * block)[row], known[row], row)


def _ordered(words: Words, piece: np.ndarray) -> Words:
    """The words by ``piece`` (of their row), number, word, lemma and tag."""
    of = piece[words.row]
    if np.all((of[1:] > of[:-1]) | (words.no[1:] > words.no[:-1])):
        return words
    columns = {"piece": pa.array(of), "no": pa.array(words.no), **{c: words.texts[c] for c in TEXTS}}
    return words.at(pc.sort_indices(pa.table(columns), sort_keys=[(c, "ascending") for c in columns]).to_numpy())


def _whole(batches, columns: list):
    """(rows, whether they are the last), cut where one of ``columns`` changes."""
    held = None
    for batch in batches:
        for start, stop in cuts(batch.column("__n").to_numpy().astype(np.int64), 4 * CHUNK):
            rows = batch.slice(start, stop - start)
            rows = rows if held is None else pa.concat_batches([held, rows])
            last = int(np.flatnonzero(_opens([rows.column(c) for c in columns]))[-1])
            if last:
                yield rows.slice(0, last), False
            held = rows.slice(last)
    if held is not None:
        yield held, True


class Chunk(NamedTuple):
    """Words laid out one behind the other. ``own``: those that the chunk is for; ``low``, ``high``: the words that a word's context may span; ``rows``: sent keys, by ``row`` of a word."""
    words: Words
    own: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: pa.RecordBatch


def laid_out(batches, sent, budget: Optional[int], span: int = 0, block: int = BLOCK, cu: bool = False, chunk: int = CHUNK) -> Iterator[Chunk]:
    """All words of packed rows, which come in the order of ``pack``, in chunks; each is in ``own`` of one chunk.

    A chunk also holds the ``budget`` words to either side, which are all that a context can reach; without a
    budget it holds whole sentences (with ``span``, whole groups).
    """
    s = list(sent)
    group = [*s[:-1], "__group"] if span > 0 else s
    keys = [*group, *s[-1:]] if span > 0 else s
    words = rows = None
    done = 0  # words that only serve as context
    for more, final in _whole(batches, [*keys, "__block"]):
        new = _ordered(_unpacked(more, block, cu), np.cumsum(_opens([more.column(c) for c in (*keys, "__block")])))
        words, rows = (new, more) if words is None else (words.followed(new, rows.num_rows), pa.concat_batches([rows, more]))
        opens = _opens([rows.column(c) for c in group])
        sentence = np.cumsum(_opens([rows.column(c) for c in keys]))[words.row]
        first = np.flatnonzero(np.diff(sentence, prepend=-1))  # word that opens a sentence
        in_group, total = np.cumsum(opens)[words.row], len(sentence)
        number = np.cumsum(np.diff(sentence, prepend=sentence[0]) > 0)
        edge = np.append(first, total)
        low, high = np.arange(len(first)), np.arange(len(first)) + 1
        if span > 0:
            no, numbered = (x[words.row[first]] for x in _numbers(rows.column(s[-1])))
            place = in_group[first] * (1 << 40) + np.where(numbered, no, 0) + (1 << 33)
            low = np.where(numbered, np.searchsorted(place, place - span), low)
            high = np.where(numbered, np.searchsorted(place, place + span, side="right"), high)
            last = rows.column("__last").to_numpy(zero_copy_only=False)[words.row[first]]
            high -= last[high - 1] & (high - 1 > np.arange(len(first)))
        low, high = edge[low][number], edge[high][number]
        home = rows.column("__home").to_numpy(zero_copy_only=False)[words.row] if span > 0 else np.ones(total, bool)
        ready = total if final else max(done, total - budget) if budget is not None else int(np.searchsorted(in_group, in_group[-1]))
        if budget is not None:
            places = [(x, min(x + chunk, ready)) for x in range(done, ready, chunk)]
        else:
            sizes = np.diff(np.append(np.flatnonzero(np.diff(in_group[:ready], prepend=-1)), ready)) if ready else np.zeros(0, np.int64)
            ends = np.append(0, np.cumsum(sizes))
            places = [(int(ends[a]), int(ends[b])) for a, b in cuts(sizes, chunk)]
        for x, y in places:
            own = x + np.flatnonzero(home[x:y])
            if len(own):
                a, b = (max(x - budget, 0), min(y + budget, total)) if budget is not None else (x, y)
                yield Chunk(words.at(slice(a, b)), own - a, np.clip(low[a:b] - a, 0, b - a), np.clip(high[a:b] - a, 0, b - a), rows)
        keep = max(ready - budget, 0) if budget is not None else ready
        if keep == total:
            words, rows, done = None, None, 0
            continue
        words, done = words.at(slice(keep, total)), ready - keep
        from_row = int(words.row.min())
        words, rows = words._replace(row=words.row - from_row), rows.slice(from_row)
