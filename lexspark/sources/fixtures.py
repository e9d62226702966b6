"""Derived annotated corpus built from the driver's ``documents`` table.

The driver tables hold no annotated corpus, so tokens, lemmas and tags are
derived from ``documents`` by fixed rules that a SQL engine can state too
(the oracle in ``lexspark.plans.oracle`` states them in DuckDB SQL).
Lemmas and tags are invented by rule; they exercise the engine, not
linguistics.

Rules (per document):
  sentence = line of ``text`` (split at newline), ``sent_no`` from 0;
  tokens   = matches of ``\\p{L}+|[^ \\t\\p{L}]`` in the line, ``word_no`` from 0;
  part     = doc_id % 10: 8 dev, 9 test, else training;
  lemma    = word without the ending (tion|ing|ment|en|s|e) for letter runs
             unless doc_id % 7 = 0 (then the word; also if nothing is left);
  tag      = punct | Np<lang> | R[c] | Nc<lang> | Vp<lang>, plus "+0" when
             doc_id % 11 = 0; Xu<lang> for letter runs of more than 6 in dev
             and test when (doc_id + word_no) % 5 = 0 (no training word has it);
  missing  = (doc_id + 3 * sent_no + word_no) % 97: 0 loses the tag, 1 the
             lemma, 2 the word.
The line stream (sentence numbers, blank runs) puts (doc_id + line) % 4 blank
lines behind every line.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.sources.store import input_bytes

# Fixed values of the derivation rules.
TOKEN_PATTERN = r"\p{L}+|[^ \t\p{L}]"
LEMMA_ENDING = r"(tion|ing|ment|en|s|e)$"

TOKEN_COLUMNS = ["doc_id", "lang", "part", "sent_no", "word_no", "word", "lemma", "tag"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, tasks: int = 1) -> DataFrame:
    """Spread a scan that yields fewer splits than task slots (one small file) or than ``tasks``.

    Other inputs pass unchanged; a table of few splits is dealt round-robin
    so tokenising runs on all cores.
    """
    least = max(tasks, df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def part_of(doc_id: Column) -> Column:
    r = doc_id % 10
    return F.when(r == 8, "dev").when(r == 9, "test").otherwise("training")


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text", keep=("lang",)) -> DataFrame:
    """One row per line of each text: (key, *keep, sent_no, line)."""
    return docs.select(
        F.col(key).alias("doc_id"), *keep,
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("sent_no", "line"),
    )


def line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): the lines of all documents, blank lines put in by rule."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    spaced = F.flatten(F.transform("lines", lambda x, i: F.concat(
        F.array(x), F.array_repeat(F.lit(" "), F.pmod(F.col("doc_id") + i, F.lit(4)).cast("int")))))
    return docs.select("doc_id", F.posexplode(spaced).alias("line_no", "line"))


CHUNK = 1 << 20  # characters of lines that are tokenised at once
TASK_BYTES = 4 << 20  # bytes of the documents' files that a task tokenises: a byte of them makes some 200 bytes of token rows
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
# TOKEN_PATTERN for Python's re, which has no \p{L}: ASCII lines, lines without numerals that \\w holds, any line
_ASCII, _PLAIN, _ANY = (re.compile(x) for x in (r"[A-Za-z]+|[^ \t]", r"[^\W\d_]+|[^ \t]", r"[^\W\d_" + _NUMERALS + r"]+|[^ \t]"))
_ENDING = re.compile(LEMMA_ENDING)
_TAGS = ("punct", "Np", "R", "Rc", "Nc", "Xu", "Vp")  # all but the punctuation and R tags end in the language


def _words(lines: list) -> tuple:
    """(number of words per line, all words as a dictionary array)."""
    for other in (_PLAIN, _ANY):
        found = [[] if x is None else (_ASCII if x.isascii() else other).findall(x) for x in lines]
        words = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        if all(len(w) == 1 or w.isalpha() for w in words.dictionary.to_pylist()):  # no numeral in a run of letters
            break
    return np.array([len(x) for x in found], np.int64), words


def _annotated(doc: pa.Array, lang: pa.Array, sent_no: pa.Array, lines: list) -> pa.RecordBatch:
    """The tokens of some lines by the fixed rules: what follows from the word alone is found once per distinct word."""
    count, words = _words(lines)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    code, types = words.indices.to_numpy(), words.dictionary.to_pylist()
    of = lambda values, kind: np.array(values, kind)[code]
    letters, size = of([w[0].isalpha() for w in types], bool), of([len(w) for w in types], np.int64)
    capital = of([unicodedata.category(w[0]) == "Lu" for w in types], bool)
    stems = [_ENDING.sub("", w) for w in types]
    stem = of([bool(x) for x in stems], bool)
    d, no_doc = doc.fill_null(0).to_numpy()[row], doc.is_null().to_numpy(zero_copy_only=False)[row]
    rest = lambda x, n: np.fmod(x, n)  # noqa: E731 (the sign is the dividend's, as in SQL)
    lost = rest(d + 3 * sent_no.to_numpy()[row].astype(np.int64) + at, 97)
    pick = lambda values, index, gone: pa.array(values, pa.string()).take(pa.array(index, mask=gone | no_doc))
    lemma = np.where(letters & (rest(d, 7) != 0) & stem, code + len(types), code)
    kind = np.select([~letters, (at > 0) & capital, size <= 3, size <= 6, (rest(d, 10) >= 8) & (rest(d + at, 5) == 0)],
                     [0, 1, np.where(rest(d, 5) == 0, 3, 2), 4, 5], 6)
    langs = lang.dictionary_encode()
    names = langs.dictionary.to_pylist() + [None]
    tag = lambda t, x: t if t in ("punct", "R", "Rc") else None if x is None else t + x
    tags = [None if tag(t, x) is None else tag(t, x) + plus for x in names for t in _TAGS for plus in ("", "+0")]
    spoken = langs.indices.fill_null(len(names) - 1).to_numpy().astype(np.int64)[row]
    index = (spoken * len(_TAGS) + kind) * 2 + (rest(d, 11) == 0)
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [doc.take(rows), lang.take(rows), sent_no.take(rows), pa.array(at.astype(np.int32)),
         pick(types, code, lost == 2), pick(types + stems, lemma, lost == 1), pick(tags, index, lost == 0)],
        ["doc_id", "lang", "sent_no", "word_no", "word", "lemma", "tag"])


def tokens_from_lines(lines: DataFrame) -> DataFrame:
    """Split lines into tokens and annotate them by the fixed rules, a batch of lines at a time.

    What a word is, its stem and its kind are found once per distinct word of a
    batch; its tokens only pick them.  Letters are those of Python's Unicode tables.
    """
    def run(batches):
        for batch in batches:
            doc, lang, sent_no, line = (batch.column(c) for c in ("doc_id", "lang", "sent_no", "line"))
            sizes = pc.utf8_length(line).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.cumsum(sizes) // CHUNK
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
            for start, stop in zip(cuts[:-1], cuts[1:]):
                yield _annotated(*[c.slice(start, stop - start) for c in (doc, lang, sent_no)], line.slice(start, stop - start).to_pylist())

    t = lines.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.col("sent_no").cast("int").alias("sent_no"), "line") \
        .mapInArrow(run, "doc_id bigint, lang string, sent_no int, word_no int, word string, lemma string, tag string")
    return t.select("doc_id", "lang", part_of(F.col("doc_id")).alias("part"), "sent_no", "word_no", "word", "lemma", "tag")


def documents(spark: SparkSession, sf_dir: str, parts=None) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs if parts is None else docs.where(part_of(F.col("doc_id")).isin(*parts))


def tokens(spark: SparkSession, sf_dir: str, parts=None) -> DataFrame:
    """Raw annotated tokens (before cleaning) of all three partitions, or of ``parts``: other documents are not cut into tokens then.

    The tasks are as many as the documents' bytes ask for, so a task's share does not grow with the input.
    """
    docs = documents(spark, sf_dir, parts).select("doc_id", "lang", "text")
    return tokens_from_lines(lines_of(spread(docs, -(-input_bytes(spark, f"{sf_dir}/documents.parquet") // TASK_BYTES))))


def sentences(spark: SparkSession, sf_dir: str, parts=None) -> DataFrame:
    """(part, doc_id, sent_no) of the lines that hold a token."""
    lines = lines_of(spread(documents(spark, sf_dir, parts).select("doc_id", "text")), keep=())
    return lines.where(F.col("line").rlike("[^ \\t]")).select(
        part_of(F.col("doc_id")).alias("part"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("sent_no").cast("int").alias("sent_no"))


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexspark.plans.corpus import clean_tokens as ct
    return ct(spark, sf_dir)


def _baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's labels of dev and test, which all models start from (written once per input folder)."""
    from lexspark.operators import baseline
    from lexspark.sources.store import materialized
    cols = ["part", "doc_id", "sent_no", "word_no", "word", "pred_lemma", "pred_tag"]

    def build():
        ct = clean_tokens(spark, sf_dir)
        model = baseline.fit(ct.where(F.col("part") == "training"))
        truth = ct.where(F.col("part").isin("dev", "test")).select("part", "doc_id", "sent_no", "word_no", "word")
        return baseline.predict(truth, model).select(*cols)

    return materialized(spark, "baseline_predictions", sf_dir, build, partition_by=["part"]).select(*cols)


def predictions(spark: SparkSession, sf_dir: str, models=(1, 2, 3), by=()) -> DataFrame:
    """Fixture predictions for dev and test: baseline labels plus planted faults.

    With ``by`` the baseline's labels are dealt by these columns before they become
    the models' rows: what groups by them then moves a word once, not once per model.

    model m: lemma/tag = most frequent training label (lemma falls back to the
    word, tag to null); then (doc_id + word_no) % (13 + m) = 0 appends "x" to
    the lemma; (doc_id + sent_no + word_no) % (17 + m) = 0 sets the tag to
    "zz"; (doc_id + 2 * word_no) % 101 = 0 nulls lemma and tag.
    """
    p = _baseline_predictions(spark, sf_dir)
    if by:
        p = p.repartition(*by)
    m = F.col("model_id")
    p = p.withColumn("model_id", F.explode(F.array(*[F.lit(int(x)) for x in models])))
    d, s, w = F.col("doc_id"), F.col("sent_no"), F.col("word_no")
    lost = (d + 2 * w) % 101 == 0
    lemma = F.when(lost, F.lit(None)).when((d + w) % (13 + m) == 0, F.concat(F.col("pred_lemma"), F.lit("x"))) \
        .otherwise(F.col("pred_lemma"))
    tag = F.when(lost, F.lit(None)).when((d + s + w) % (17 + m) == 0, F.lit("zz")).otherwise(F.col("pred_tag"))
    return p.select(m.cast("int").alias("model_id"), "part", "doc_id", "sent_no", "word_no", "word",
                    lemma.cast("string").alias("lemma"), tag.cast("string").alias("tag"))


def _spaced(c) -> Column:
    # characters of a string joined by blanks; null -> empty
    return F.array_join(F.split(F.coalesce(c, F.lit("")), ""), " ")


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-mode hypothesis lines ``<w> l e m m a + t a g <s> ... </w>``.

    Faults: sent_no % 10 = 3 drops the last word; = 7 appends a surplus
    word ``x + y``; = 5 drops ``+`` and the tag of the first word.
    """
    p = predictions(spark, sf_dir, by=("part", "doc_id", "sent_no"))
    words = p.select("model_id", "part", "doc_id", "sent_no", "word_no",
                     F.concat_ws(" + ", _spaced(F.col("lemma")), _spaced(F.col("tag"))).alias("full"),
                     _spaced(F.col("lemma")).alias("bare"))
    g = words.groupBy("model_id", "part", "doc_id", "sent_no").agg(
        F.sort_array(F.collect_list(F.struct("word_no", "full", "bare"))).alias("ws"))
    k = F.col("sent_no") % 10
    ws = F.col("ws")
    rendered = F.transform(ws, lambda x, i: F.when((k == 5) & (i == 0), x["bare"]).otherwise(x["full"]))
    rendered = F.when(k == 3, F.slice(rendered, 1, F.size(ws) - 1)).when(
        k == 7, F.concat(rendered, F.array(F.lit("x + y")))).otherwise(rendered)
    line = F.concat(F.lit("<w> "), F.array_join(rendered, " <s> "), F.lit(" </w>"))
    return g.select("model_id", "part", "doc_id", "sent_no", line.alias("line"))


def word_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-mode hypothesis lines, one per truth token: ``<w> l e m m a + t a g </w>``."""
    p = predictions(spark, sf_dir)
    return p.select("model_id", "part", "doc_id", "sent_no", "word_no",
                    F.concat(F.lit("<w> "), F.concat_ws(" + ", _spaced(F.col("lemma")), _spaced(F.col("tag"))),
                             F.lit(" </w>")).alias("line"))
