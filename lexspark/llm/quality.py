"""Quality classifier from weak labels.

Eight cheap heuristics (shares of shouted, decorated, bare-symbol and repeated
words, variety, line ends, word length, lack of small words) each vote good, bad or nothing on every
text.  Expectation-maximisation over the counts of all vote patterns (at most
3^8 rows, whatever the corpus) estimates how often each heuristic votes what
for good and for bad texts; the posterior of a pattern then labels the texts of
a bounded sample, on which a linear scorer over hashed word shapes is trained.
No given label is used.  A text is kept if its score is 0.5 or more.

Null and empty texts have no votes and the score 0; every row keeps its
columns; repeated rows get equal scores; of an empty table nothing is learnt.
"""

from __future__ import annotations

import operator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import saved, worker_state

DIMS = 2_048
SAMPLE = 10_000  # texts that train the linear scorer
KEEP = 0.5
# name -> bad if beyond the first bound, good if within the second
BOUNDS = {"shouted": (0.25, 0.08), "decorated": (0.08, 0.02), "bare": (0.10, 0.02), "repeated": (0.10, 0.02),
          "poor": (0.60, 0.50), "open_ended": (0.60, 0.20), "long_words": (6.8, 6.2), "no_small_words": (0.90, 0.80)}
BAD_VOTE = 8.0
ENOUGH = 12  # words: fewer say nothing on their lengths and ends
VARIETY_WORDS = 1_500  # longer texts repeat words in any case: no vote on variety


def shape(word: str) -> str:
    """Runs of capitals, small letters, digits and each other sign."""
    out = []
    for ch in word:
        c = "X" if ch.isupper() else "x" if ch.isalpha() else "9" if ch.isdigit() else ch
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


SHOUTED, DECORATED, BARE, LENGTH = DIMS, 2 * DIMS, 4 * DIMS, 8 * DIMS  # flags and length above a word's bucket


def bucket(form: str, length: int) -> int:
    return xxhash.xxh32_intdigest(f"{form}/{min(length, 16) // 3}".encode()) % (DIMS - 2) + 2


def code(word: str) -> int:
    """Bucket of the word's shape and length, with flags and the length."""
    if word.isalpha() and (word.islower() or word.istitle()):  # most words
        return bucket("Xx" if word[0].isupper() else "x", len(word)) + LENGTH * min(len(word), 1_000)
    letters = sum(map(str.isalpha, word))
    bare = not letters and not any(map(str.isalnum, word))
    tail = len(word) - len(word.rstrip("!?#$%&*+=~^|<>@_-"))
    flags = SHOUTED * (letters > 1 and word.upper() == word) + DECORATED * (tail > 1 and not bare) + BARE * bare
    return bucket(shape(word[:64]), len(word)) + flags + LENGTH * min(len(word), 1_000)


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = code(word)
        return found


def read_text(text: str, words: dict) -> tuple[dict[str, float], np.ndarray]:
    """Shares that the heuristics judge, and the scorer's features (shares of shapes; 0: constant, 1: repeats)."""
    found = text.split()
    n = len(found)
    if not n:
        return {}, np.zeros(DIMS, np.float32)
    codes = np.fromiter(map(words.__getitem__, found), np.int32, n)
    again = sum(map(operator.eq, found, islice(found, 1, None)))
    lines = [x for x in map(str.rstrip, text.split("\n")) if x]
    shares = {name: np.count_nonzero(codes & flag) / n for name, flag in (("shouted", SHOUTED), ("decorated", DECORATED), ("bare", BARE))}
    spelt = (codes // LENGTH)[codes & BARE == 0]
    shares["repeated"] = again / n
    if len(spelt) >= ENOUGH:
        shares |= {"open_ended": sum(x[-1] not in ".!?\"')…" for x in lines) / len(lines), "long_words": spelt.mean(), "no_small_words": np.count_nonzero(spelt > 3) / len(spelt)}
    if 30 <= n <= VARIETY_WORDS:
        shares["poor"] = 1 - len(set(found)) / n
    x = np.bincount(codes % DIMS, minlength=DIMS).astype(np.float32) / n
    x[0], x[1] = 1.0, again / n
    return shares, x


def votes(shares: dict[str, float]) -> str:
    """A letter per heuristic: b, g or - (nothing)."""
    return "".join("-" if k not in shares else "b" if shares[k] > bad else "g" if shares[k] <= good else "-" for k, (bad, good) in BOUNDS.items())


def learn(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, P(vote | class) per heuristic, posterior of good per pattern) by EM.

    A heuristic sees one kind of fault, so at the start one bad vote weighs as much as
    ``BAD_VOTE`` good ones; a text without votes follows the share of good ones.
    """
    codes = np.array([["gb-".index(c) for c in p] for p in patterns])
    good, bad = (codes == 0).sum(1), (codes == 1).sum(1)
    posterior = (good + 1.0) / (good + 1.0 + BAD_VOTE * bad)
    for _ in range(rounds):
        prior = float(np.clip((counts * posterior).sum() / counts.sum(), 1e-3, 1 - 1e-3))
        table = np.ones((2, codes.shape[1], 2))
        for c, weight in enumerate((posterior, 1 - posterior)):
            for v in range(2):
                table[c, :, v] += ((codes == v) * (weight * counts)[:, None]).sum(0)
        table /= table.sum(2, keepdims=True)
        log = np.concatenate([np.log(table), np.zeros((*table.shape[:2], 1))], 2)  # silence says nothing
        like = [log[c, np.arange(codes.shape[1]), codes].sum(1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[1] - like[0] + np.log((1 - prior) / prior), -60, 60)))
        done = abs(new - posterior).max() < 1e-9
        posterior = new
        if done:
            break
    return prior, table, posterior


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic scorer for soft labels ``y`` (Adam on all rows, small penalty)."""
    used = np.flatnonzero(x.any(0))
    x, whole = np.sqrt(x[:, used]), np.zeros(x.shape[1])
    w, m, v = (np.zeros(len(used), np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.2 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    whole[used] = w
    return whole


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray | None:
    """The scorer's weights, learnt from ``docs`` without labels; None if there is no text."""
    share = docs.where(F.col(text).isNotNull()).count()
    if not share:
        return None
    # The sample's texts are chosen by a hash; twice as many as wanted on average, then cut.
    chosen = F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(min(1.0, 2 * sample / share) * (1 << 30))

    def run(batches):
        words = worker_state("quality_words", _Words)
        for batch in batches:
            patterns, features = [], []
            for value, mine in zip(*(c.to_pylist() for c in batch.columns)):
                shares, x = read_text(value, words)
                patterns.append(votes(shares))
                at = np.flatnonzero(x) if mine and shares else []
                features.append(np.rec.fromarrays([np.array(at, "<i4"), x[at].astype("<f4")]).tobytes() if len(at) else None)
            yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(features, pa.binary())], ["votes", "features"])

    seen = saved(docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string"), chosen.alias("mine")).mapInArrow(run, "votes string, features binary"), "votes")
    rows = seen.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3^8
    patterns, counts = [r["votes"] for r in rows], np.array([r["n"] for r in rows], float)
    posterior = dict(zip(patterns, learn(patterns, counts)[2]))
    some = seen.where("features IS NOT NULL").orderBy(F.xxhash64("features"), "features").limit(sample).collect()
    if not some:
        return None
    x, kind = np.zeros((len(some), DIMS), np.float32), np.dtype([("at", "<i4"), ("value", "<f4")])
    for k, r in enumerate(some):
        f = np.frombuffer(r["features"], kind)
        x[k, f["at"]] = f["value"]
    return train(x, np.array([posterior[r["votes"]] for r in some], np.float32))


def score(docs: DataFrame, weights: np.ndarray | None, text: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the scorer's value (0..1, higher: better) in ``out``."""
    if weights is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # a fixed size

    def run(batches):
        words = worker_state("quality_words", _Words)
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.slice(at, 1_000)
                values = []
                for value in part.column(part.schema.get_field_index(text)).to_pylist():
                    shares, x = read_text(value, words) if value else ({}, None)
                    values.append(float(1 / (1 + np.exp(-np.clip(np.sqrt(x) @ shared.value, -30, 30)))) if shares else 0.0)
                yield part.append_column(out, pa.array(values, pa.float64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")
