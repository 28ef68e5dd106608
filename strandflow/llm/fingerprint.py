"""Quartile bucket digests of texts, and a bounded difference between two digests.

A digest counts the hashed byte triplets of a sliding window of four bytes
(three shapes) in 256 buckets and writes, for each bucket, which quartile of
the counts it falls in (two bits), beside a logarithmic code of the length and
the ratios of the quartiles. The difference adds the buckets' distances (the
largest counts double) and capped distances of the head; likeness is one less
the difference over its bound.

Neighbours by falling id come from one range exchange of compressed texts: a
task streams its sorted rows, so each row meets its next without a window, and
only each task's first and last row are joined across tasks afterwards.

Null texts count as empty (their digest has all buckets 0); texts under four
bytes have no triplets; rows with equal ids follow each other by a hash of
their text; a single row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import materialize, release

SHAPES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
HEAD_CAP = 16
BODY_MAX = 256 * 6
DIFFERENCE_MAX = BODY_MAX + 12 * HEAD_CAP + 2 * 15
ROWS_A_TASK = 2048


def digest(data: bytes) -> str:
    """Length code (2 hex digits), quartile ratios (2) and 256 two-bit codes (128)."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(256, np.int64)
    if len(b) >= 4:
        w = (b[:-3], b[1:-2], b[2:-1], b[3:])
        for salt, (i, j, k) in enumerate(SHAPES, 1):
            h = ((w[i] * np.uint32(0x9E3779B1) + w[j]) * np.uint32(0x85EBCA77) + w[k] * np.uint32(0x01000193) + np.uint32(salt)) * np.uint32(0xC2B2AE3D)
            counts += np.bincount(h >> np.uint32(24), minlength=256)
    q = np.sort(counts)[[63, 127, 191]]
    codes = (counts[:, None] > q[None, :]).sum(1).astype(np.uint8).reshape(64, 4)
    body = (codes << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    top = max(int(q[2]), 1)
    size = min(255, round(math.log(len(data) + 1, 1.1)))
    return f"{size:02x}{min(15, int(q[0]) * 15 // top):x}{min(15, int(q[1]) * 15 // top):x}{body.tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """Between 0 (equal digests) and DIFFERENCE_MAX."""

    def codes(d: str) -> np.ndarray:
        return (np.frombuffer(bytes.fromhex(d[4:]), np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3

    gap = np.abs(codes(a).astype(np.int16) - codes(b))
    body = int(gap.sum() + 3 * (gap == 3).sum())
    head = 12 * min(HEAD_CAP, abs(int(a[:2], 16) - int(b[:2], 16)))
    return body + head + sum(abs(int(a[i], 16) - int(b[i], 16)) for i in (2, 3))


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / DIFFERENCE_MAX


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) code points replaced by as many first ones of the following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(key, text: str, mark: str, following: str, next_mark: str) -> tuple:
    other = edited(text, following).encode()
    own = digest(other)
    return key, len(text), hashlib.sha256(other).hexdigest(), mark, own, likeness(mark, own), likeness(mark, next_mark)


FIELDS = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
EDGE = [("task", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SCHEMA = RESULT + ", task int, edge string, text string"


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(packed, pa.binary())], names=["doc_id", "mark", "packed"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is compared with its next. The first and last row of a task come out with their texts."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    before, task = None, None
    for batch in batches:
        out = []
        for where, key, packed in zip(*(batch.column(n).to_pylist() for n in ("task", "doc_id", "packed")), strict=True):
            text = unpack(packed).decode()
            mark = digest(text.encode())
            if before is None:
                task = where
                out.append((key, len(text), None, mark, None, None, None, task, "first", text))
            else:
                out.append((*_compare(*before, text, mark), task, None, None))
            before = (key, text, mark)
        if out:
            yield _batch(out)
    if before is not None:
        key, text, mark = before
        yield _batch([(key, len(text), None, mark, None, None, None, task, "last", text)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = FIELDS + EDGE
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            columns = (batch.column(n).to_pylist() for n in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"))
            rows = [_compare(*x) for x in zip(*columns, strict=True)]
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], names=[n for n, _ in FIELDS])


def fingerprint_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of each text and of its edited text, with their likeness and that to the next document's."""
    tasks = max(1, min(8192, -(-docs.count() // ROWS_A_TASK)))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("mark"))
    packed = rows.mapInArrow(_compress, "doc_id long, mark long, packed binary")
    order = [F.col("doc_id").desc(), F.col("mark").desc()]
    dealt = packed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("task"), "doc_id", "packed")
    found = materialize(dealt.mapInArrow(_stream, SCHEMA), "fingerprints")
    done = found.where("edge is null").select(*[n for n, _ in FIELDS])
    # one number for each task: bounded by the number of tasks
    used = sorted(r.task for r in found.where("edge = 'first'").select("task").collect())
    if not used:
        return done
    following = F.create_map(*[F.lit(x) for a, b in zip(used, used[1:] + used[:1], strict=True) for x in (a, b)])
    last = found.where("edge = 'last'").select("doc_id", "text", "fingerprint", following[F.col("task")].alias("next_task"))
    first = found.where("edge = 'first'").select(F.col("task").alias("next_task"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    return done.unionByName(last.join(first, "next_task").mapInArrow(_seams, RESULT))
