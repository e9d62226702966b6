"""Derived tables written once to the cluster's shared checkpoint folder.

Expensive derivations that many plans share (the tokenised corpus, the match
table) are written as parquet under ``spark.checkpoint.dir`` and read back:
lineage is cut, a lost executor only reruns its own read, and later plans get
column pruning and partition pruning on ``part``.  A table counts as present
only when its ``_SUCCESS`` marker exists.

A table's name includes a fingerprint of the code of this package, of the
input files (sizes and modification times) and a run id (per session unless
``lexspark.tables.run`` is set), so a changed input or changed code never
reads an old table.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from contextlib import contextmanager
from functools import lru_cache
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from lexspark.session import ensure_checkpoint_dir

VERSION = "1"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


@lru_cache(maxsize=1)
def code_fingerprint() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for d, _, files in sorted(os.walk(root)):
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(d, f), "rb") as fh:
                    h.update(f.encode() + fh.read())
    return h.hexdigest()[:16]


def input_fingerprint(spark: SparkSession, path: str) -> str:
    """Sizes and modification times of the files under ``path`` (listing only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "absent"
    it = fs.listFiles(p, True)
    items = []
    while it.hasNext():
        st = it.next()
        items.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(items)).encode()).hexdigest()[:16]


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under ``path`` (listing only)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def run_id(spark: SparkSession) -> str:
    rid = spark.conf.get("lexspark.tables.run", None)
    if not rid:
        rid = uuid.uuid4().hex[:12]
        spark.conf.set("lexspark.tables.run", rid)
    return rid


def table_path(spark: SparkSession, name: str, key: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    ident = f"{VERSION}|{name}|{key}|{code_fingerprint()}|{input_fingerprint(spark, key)}|{run_id(spark)}"
    h = hashlib.sha1(ident.encode()).hexdigest()[:16]
    return f"{base}/lexspark-tables/{name}-{h}"


def materialized(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame],
                 partition_by: Sequence[str] = ()) -> DataFrame:
    path = table_path(spark, name, key)
    if not exists(spark, path + "/_SUCCESS"):
        w = build().write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        with _open_files(spark):
            w.parquet(path)
    return spark.read.parquet(path)


def at_hand(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table if an earlier query wrote it, else what ``build`` gives, unwritten: for a query that reads it once."""
    path = table_path(spark, name, key)
    return spark.read.parquet(path) if exists(spark, path + "/_SUCCESS") else build()


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN = 16  # files that a task holds open; of more values of the partition columns the rest is sorted


@contextmanager
def _open_files(spark: SparkSession):
    """A task writes a file per value of the partition columns at once, instead of sorting all its rows by them first."""
    before = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, str(OPEN))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(WRITERS)
        else:
            spark.conf.set(WRITERS, before)


def written(spark: SparkSession, name: str, key: str, write: Callable[[str], None]) -> str:
    """The path of files that ``write`` puts under the checkpoint folder once, in whatever format."""
    path = table_path(spark, name, key)
    if not exists(spark, path + "/_DONE"):
        write(path)
        spark.range(1).write.mode("overwrite").parquet(path + "/_DONE")
    return path
