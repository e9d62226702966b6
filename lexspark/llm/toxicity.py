"""Toxicity by class-conditional Kneser-Ney models with a shared backoff.

Counts are Kneser-Ney continuation counts: in how many different left contexts
a word stands, per class.  Copies of a text therefore add nothing, and a rare
expression keeps only what the discount leaves, the rest of its probability
coming from the backoff distribution that both classes share.  (The level above,
bigram counts, was measured and made held-out ranking worse: 0.95 against 0.99.)
The score compares the length-normalised log-likelihoods of the two classes in
every run of ``SPAN`` words and takes the largest difference, so one insult in a
long text counts; a logistic curve fitted on a fold of its own maps it to 0..1.

All labelled rows outside the held-out fold are counted, in Spark: the fold 4
serves the curve, the folds 1 to 3 the counts.  Counts are keyed by the 64-bit
hash of the word and lie in a table that grows with the input.  The ``HEAD``
words with most contexts travel to the tasks, with a bitmap of the table's words
that is of bounded size; runs of words that are among them, or surely not in the
table, are scored at once, and the other runs after a join of each text's other
words with the table.  Only texts whose ids may be labelled are sent to their labels.  Null and empty texts score as texts without evidence;
rows with null labels or ids teach nothing; repeated label rows of an id count
once (toxic if any says so); without labels of both classes the score is the
smoothed share of toxic labels.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import CELL, SIEVE_BITS, binaries, saved, sifted, text_digest, word_bytes, worker_state

HEAD = 1 << 18  # words whose weights every task holds; all others are joined
DISCOUNT = 2.0  # contexts; what a class has seen in fewer is left to the backoff
SPAN = 4
CURVE_ROWS = 50_000  # labelled rows that fit the logistic curve, at most
FOLDS = 5


def fold(key: Column) -> Column:
    """The remainder of the id's CRC-32; null ids are in no fold."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


class _Hashes(dict):
    """64-bit hashes of words, kept for the words of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


START = xxhash.xxh3_64_intdigest(b"")  # left context of a text's first word; no word is empty


def contexts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): different left contexts of each word in the texts of each class."""
    taught = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = taught.where(fold(F.col("doc_id")).isin(1, 2, 3))
    texts = docs.where(fold(F.col("doc_id")).isin(1, 2, 3) & F.col("text").isNotNull()).select("doc_id", "text")
    if docs.schema["doc_id"].dataType == labels.schema["doc_id"].dataType:  # equal ids have equal hashes
        texts = sifted(texts, "doc_id", taught, labels.count()).where("__maybe").drop("__maybe")

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            found: list[list[np.ndarray]] = [[], []]
            for toxic, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                words = word_bytes(text)
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                if len(h):
                    found[toxic].append(np.stack([np.concatenate([np.array([START], np.uint64), h[:-1]]), h]))
            for toxic, pairs in enumerate(found):
                left, word = np.concatenate(pairs, 1).view(np.int64) if pairs else np.zeros((2, 0), np.int64)
                order = np.lexsort((left, word))
                left, word = left[order], word[order]
                new = np.ones(len(word), bool)
                new[1:] = (left[1:] != left[:-1]) | (word[1:] != word[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(new.sum(), toxic, np.int32)), pa.array(left[new]), pa.array(word[new])], ["toxic", "left", "word"])

    pairs = texts.join(taught.hint("shuffle_hash"), "doc_id").select(  # few labels or many: the same plan, texts are not sorted
(F.col("toxic") > 0).cast("int").alias("toxic"), F.col("text").cast("string")) \
        .mapInArrow(run, "toxic int, left bigint, word bigint").distinct()
    return pairs.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("ordinary"))


def fit(docs: DataFrame, labels: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, float] | None:
    """((word, n, weight): contexts and log-likelihood difference by word hash, the difference of all other words); None without both classes."""
    counts = saved(contexts(docs, labels), "contexts")
    total = counts.agg(*(F.sum(c) for c in ("toxic", "ordinary")), *(F.sum(F.least(F.col(c), F.lit(discount))) for c in ("toxic", "ordinary"))).first()
    if not total[0] or not total[1]:
        return None
    n_t, n_o, left_t, left_o = map(float, total)
    t, o, n = F.col("toxic"), F.col("ordinary"), F.col("toxic") + F.col("ordinary")
    zero, shared = F.lit(0.0), n / F.lit(n_t + n_o)
    weight = F.log((F.greatest(t - discount, zero) / n_t + left_t / n_t * shared) / (F.greatest(o - discount, zero) / n_o + left_o / n_o * shared))
    # Words that neither class knows beyond the discount have the weight of unseen ones: no row.
    rows = counts.where(F.greatest("toxic", "ordinary") > discount).select("word", n.alias("n"), weight.cast("float").alias("weight"))
    return saved(rows, "weights"), float(np.float32(np.log((left_t / n_t) / (left_o / n_o))))


def runs(x: np.ndarray, span: int) -> np.ndarray:
    """Sums of all runs of ``span`` values; the sum of all if there are no more (values of a run are added in its order)."""
    if len(x) <= span:
        return np.array([sum(x.tolist())])
    sums = np.zeros(len(x) - span + 1)
    for k in range(span):
        sums += x[k:len(x) - span + 1 + k]
    return sums


def word_bits(table: DataFrame) -> np.ndarray:
    """A bitmap over the low bits of word hashes, with some sixteen bits a word of ``table`` up to 64 MB: a clear bit means no such word."""
    bits = 1 << min(SIEVE_BITS, max(15, (16 * table.count()).bit_length()))
    x = F.pmod(F.col("word"), F.lit(bits)) + 1  # Spark's bitmaps count from 1
    cells = table.groupBy(F.bitmap_bucket_number(x).alias("cell")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in cells:  # at most 16,384 of 4 KB
        at = (r["cell"] - 1) * CELL // 8
        out[at:at + CELL // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def evidence(docs: DataFrame, model: tuple[DataFrame, float], span: int = SPAN, head: int = HEAD) -> DataFrame:
    """(doc_id, raw): the largest mean difference over ``span`` words (short texts are filled with zeros)."""
    table, other = model
    best = table.orderBy(F.desc("n"), "word").limit(head).select("word", "weight").toPandas().sort_values("word")  # at most ``head`` rows
    shared = docs.sparkSession.sparkContext.broadcast((best["word"].to_numpy(np.int64), best["weight"].to_numpy(np.float32), word_bits(table)))
    name = "toxicity_" + uuid.uuid4().hex

    class Weights(dict):
        """Weight by word; nan: not among the head, but perhaps in the table."""

        def __missing__(self, word: bytes) -> float:
            if len(self) > 300_000:
                self.clear()
            words, weights, bits = shared.value
            digest = xxhash.xxh3_64_intdigest(word)
            place = digest & (8 * len(bits) - 1)
            if not bits[place >> 3] >> (place & 7) & 1:
                x = self[word] = other
                return x
            h = np.uint64(digest).astype(np.int64)
            at = int(words.searchsorted(h))
            x = self[word] = float(weights[at]) if at < len(words) and words[at] == h else float("nan")
            return x

    def first(batches):
        weights = worker_state(name, Weights)
        for batch in batches:
            raw, tails, refs, near, starts = [], [], [], [], []
            for text in binaries(batch.column(1)):
                words = word_bytes(text) if text else []
                x = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
                sums = runs(x, span)
                waits = np.isnan(sums)
                done = sums[~waits]
                raw.append(float(done.max()) if len(done) else None)
                if not waits.any():
                    for out in (tails, refs, near, starts):
                        out.append(None)
                    continue
                begin = np.flatnonzero(waits)
                covered = np.unique((begin[:, None] + np.arange(min(span, len(x)))).ravel())
                x = x[covered]
                rare = [words[k] for k in covered[np.isnan(x)].tolist()]
                number = {w: k for k, w in enumerate(dict.fromkeys(rare))}
                tails.append([int(np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64)) for w in number])
                refs.append(np.array([number[w] for w in rare], "<i4").tobytes())
                near.append(x.astype("<f4").tobytes())
                starts.append(covered.searchsorted(begin).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64()), batch.column(2), pa.array(tails, pa.list_(pa.int64())),
                                              *(pa.array(c, pa.binary()) for c in (refs, near, starts))], ["doc_id", "raw", "digest", "tail", "refs", "near", "starts"])

    def rest(batches):
        for batch in batches:
            raw = []
            for value, tail, known, refs, near, starts in zip(*(c.to_pylist() for c in batch.columns[1:])):
                found = {r["word"]: r["weight"] for r in known or ()}
                x = np.frombuffer(near, "<f4").astype(np.float64)
                x[np.isnan(x)] = np.array([found.get(w, other) for w in tail])[np.frombuffer(refs, "<i4")]
                more = float(runs(x, span)[np.frombuffer(starts, "<i4")].max())
                raw.append(max(more, value) if value is not None else more)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], ["doc_id", "raw"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = saved(docs.select("doc_id", F.col("text").cast("string"), F.unhex(text_digest("text")).alias("digest")).mapInArrow(
        first, f"doc_id {kind}, raw double, digest binary, tail array<bigint>, refs binary, near binary, starts binary"), "runs")
    asked = rows.where("tail IS NOT NULL").select("digest", F.explode("tail").alias("word")).distinct()
    known = asked.join(table.select("word", "weight"), "word").groupBy("digest").agg(F.collect_list(F.struct("word", "weight")).alias("known"))
    known = saved(known, "rare-words")  # two plain shuffles meet below: a frequent text splits
    late = rows.where("tail IS NOT NULL").join(known, "digest", "left").select("doc_id", "raw", "tail", "known", "refs", "near", "starts")
    out = rows.where("tail IS NULL").select("doc_id", "raw").unionByName(late.mapInArrow(rest, f"doc_id {kind}, raw double"))
    return out.withColumn("raw", F.col("raw") / span)


def curve(raw: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps with a small penalty on the slope)."""
    centre, width = raw.mean(), raw.std() or 1.0
    x = np.stack([(raw - centre) / width, np.ones(len(raw))], 1)
    w = np.array([0.0, np.log((toxic.sum() + 0.5) / ((1 - toxic).sum() + 0.5))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - toxic) + np.array([1e-2 * w[0], 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6]), gradient)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    slope = max(w[0], 0.0) / width
    return float(slope), float(w[1] - slope * centre)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    model = fit(docs, labels)
    if model is None:
        n = known.where(fold(F.col("doc_id")) != 0).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        share = (n[1] + 0.5) / (n[0] + 1) if n[0] else 0.0
        return docs.select("doc_id", held, F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    raw = saved(evidence(docs, model), "evidence")
    some = raw.join(known, "doc_id").where(fold(F.col("doc_id")) == 4).select("doc_id", "raw", "toxic") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "raw").limit(CURVE_ROWS).toPandas()
    slope, offset = curve(some["raw"].to_numpy(), some["toxic"].to_numpy(float)) if len(some) else (1.0, 0.0)
    value = 1 / (1 + F.exp(-(F.col("raw") * slope + offset)))
    return raw.select("doc_id", held, value.alias("score"), (value >= 0.5).cast("int").alias("predicted"))
