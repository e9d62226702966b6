"""Helpers shared by the operators: tables in the cluster's shared folder and byte-level words."""

from __future__ import annotations

import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.session import ensure_checkpoint_dir

# Word rule of the decontamination operator: digits, a-z and everything beyond ASCII.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names (shared by all machines)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:16]}"


def saved(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a table of ``saved`` that nothing reads any more: what was made from it has been written too."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm/" in path:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


SIEVE_BITS = 29  # at most 64 MB are sent to every task
CELL = 32768  # bits of a row of the sieve: fixed by Spark's bitmap functions


def sifted(rows: DataFrame, column: str, wanted: DataFrame, n: int, most: int = SIEVE_BITS) -> DataFrame:
    """``rows`` with ``__maybe``: false only if the hash ``column`` is not among the ``n`` hashes of ``wanted``.

    A bitmap with some eight bits a hash (one hash function, at most 2^most bits) is
    built by a combinable aggregation and broadcast.  With more hashes it lets more
    rows through, but never loses one.
    """
    bits = 1 << min(most, max(15, (8 * max(n, 1)).bit_length()))
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    cells = wanted.select(number(F.col(column)).alias("x")).groupBy(F.bitmap_bucket_number(F.col("x")).alias("__cell")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("x"))).alias("__bits"))
    marked = rows.withColumn("__x", number(F.col(column)))
    marked = marked.withColumn("__cell", F.bitmap_bucket_number("__x")).join(F.broadcast(cells), "__cell", "left")
    place = F.bitmap_bit_position(F.col("__x"))
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return marked.withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop("__x", "__cell", "__bits")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bytes(text: bytes) -> list[bytes]:
    """Words of ``text`` (UTF-8): A-Z lower-cased, ASCII other than letters and digits separates."""
    return text.translate(_WORD).split()


def space_words(text: bytes) -> list[bytes]:
    """Words of ``text`` (UTF-8): A-Z lower-cased, the blank and the five ASCII controls 09-0D separate."""
    return text.lower().split()


def binaries(array) -> list:
    """Bytes (or None) of an Arrow string or binary column, without decoding."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        return array.cast(pa.large_binary()).to_pylist()
    return array.cast(pa.binary()).to_pylist()


def blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose i-th value is ``data`` between the i-th pair of item offsets in ``ends``."""
    offsets = (np.asarray(ends, dtype=np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1,
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def same_key(a: Column, b: Column) -> Column:
    """Equality in which null is a key like any other."""
    return a.eqNullSafe(b)


def text_digest(text: str) -> Column:
    """128 bits of the text's bytes, for telling apart rows that share an id; null of a null text."""
    return F.md5(F.col(text).cast("string").cast("binary"))


def row_key(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Column:
    """A string that names a row by its integer id and its text: in the order of the ids (null last), then of the text digests."""
    number = F.lpad(F.hex(F.col(key).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat_ws(":", F.coalesce(number, F.lit("~")), F.coalesce(text_digest(text), F.lit("")))


def without(docs: DataFrame, bad: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not among ``bad[key]`` (null is a key like any other)."""
    keys = bad.select(F.col(key).alias("__key")).distinct()
    return docs.join(keys, same_key(docs[key], keys["__key"]), "left_anti")


class Kept:
    """A bounded cache in two generations: what was asked for lately stays."""

    def __init__(self, limit: int) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.limit = limit

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def worker_state(name: str, make):
    """An object that outlives the tasks of its Python worker, until another name is asked for; ``make`` builds it."""
    home = sys.modules.setdefault("lexspark_worker_state", types.ModuleType("lexspark_worker_state"))
    held = vars(home).setdefault("held", {})
    if name not in held:
        held.clear()  # an earlier stage's caches make room
        held[name] = make()
    return held[name]
