"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLES: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local runs."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandflow-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors and keeps one copy of costly
    stages. Tables are dropped by release() or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._strandflow_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Drop materialized tables that nothing lazy reads any more."""
    for df in frames:
        path = getattr(df, "_strandflow_path", None)
        for item in [x for x in _TABLES if x[1] == path]:
            _TABLES.remove(item)
            _delete(*item)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    while _TABLES:
        _delete(*_TABLES.pop())


#: Bytes of a batch of rows between Spark and a Python worker. Spark's own bound is by far larger, and batches are held twice on either side.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that the session sends to Python workers by BATCH_BYTES, unless its bound is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def split_of(column, modulus: int):
    """crc32 of the id as text, modulo: the split that the queries' contracts name."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def process_cache(owner: str) -> dict:
    """A dict that a Python worker keeps from task to task, for one operator at a time; its owner bounds what it holds."""
    import sys
    import types

    name = "strandflow_process_cache"
    cache = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if cache.get("owner") != owner:
        cache.clear()
        cache["owner"] = owner
    return cache


def trim() -> None:
    """Give freed memory back to the system: a Python worker outlives its task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_parts(batch, columns: list[str], most_rows: int, most_bytes: int):
    """Slices of a record batch with at most so many rows and, a single row apart, bytes in the columns."""
    import numpy as np
    import pyarrow.compute as pc

    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        limit = (int(ends[at - 1]) if at else 0) + most_bytes
        end = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, limit, side="right"))))
        yield batch.slice(at, end - at)
        at = end


MARKS = ",.;:!?"
#: White space other than the space and the line feed, or a character that stands for something here.
_OTHER = re.compile(r"[^\S \n]|\0")
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A mark between a letter or digit and a space; these are letters in every version of Unicode.
_MARKED = re.compile(f"([{MARKS}])(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03f5\u0400-\u0481\u048a-\u052f].) ")


def words_of(text: str) -> list[str] | None:
    """The text cut at each space, before each line feed, and around marks (written \\0 and the mark); none if its white space isn't single."""
    if text[:1] == " " or text[-1:] in (" ", "\n") or "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
        return None
    if not text.replace("\n", "").isprintable() and _OTHER.search(text):  # the search alone is slower
        return None
    return _MARKED.sub(r" \0\1 ", text.replace("\n", " \n")).split(" ")


def edges_of(sizes) -> bool:
    """Whether a tokenizer's pattern starts a match wherever words_of() cuts; sizes(text) are its matches' lengths."""
    return list(sizes("".join(f" a\u00e9{x} a1{x}\na\u00e9" for x in MARKS))) == [3, 1, 2, 1, 1, 1, 2] * len(MARKS)
