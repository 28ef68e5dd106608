"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of distinct five-word shingles. A table's key pairs one
key of a collection A with one of a collection B; SIDE keys of ROWS minhashes
each in either collection give SIDE * SIDE tables from 2 * SIDE * ROWS minhashes,
where plain banding would compute SIDE times as many. Two documents of
similarity s meet in some table with probability (1 - (1 - s^ROWS)^SIDE)^2.

Equal sets are one class from the start, found by an exact 128-bit digest, so
copies never meet. Keys that only one class holds are dropped before the tables
are formed. Each bucket links its classes with its smallest; the components of
these candidates are clusters. All classes of a cluster are compared on their
full sets, so every candidate pair is: a cluster is cut in blocks of at most
about BLOCK classes and BLOCK_SHINGLES shingles, a task compares two blocks by
products of incidence matrices and returns a spanning forest of the links it
found, at most one row for each class. No pair is ever a row. The links' own
components are the result.

Null, empty and wordless texts have no shingles and link with nothing; texts of
one to four words are one shingle, the whole sequence. Rows with a null id are
in no component and not kept. Rows that repeat an id share its component. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import in_parts, materialize, process_cache, release, small_batches, trim
from strandflow.llm.components import components

WORDS = 5
ROWS = 7
SIDE = 20
BLOCK = 1024
BLOCK_SHINGLES = 500_000
COLUMNS = 4096
MAX_WORDS = 300_000
PART_ROWS, PART_BYTES = 512, 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(data: bytes, hashes: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of lower-cased UTF-8 text."""
    parts = data.lower().split()  # of bytes: ASCII letters, and white space 9 to 13 and 32
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, parts), np.uint64, n)
    width = min(n, words)
    x = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        x = x * _P + h[k : n - width + 1 + k]
    return np.unique(_mixed(x))


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def half_keys(x: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each `rows` minhashes, of the high halves of mixed hashes; blocks of a few functions stay in the cache."""
    least = np.empty(len(a), np.uint32)
    high = (x >> np.uint64(32)).astype(np.uint32)
    step = max(1, 32_768 // len(x))
    for k in range(0, len(a), step):
        y = high[None, :] * a[k : k + step, None]
        y += b[k : k + step, None]
        least[k : k + step] = y.min(1)
    key = np.zeros(len(a) // rows, np.uint64)
    for column in least.astype(np.uint64).reshape(-1, rows).T:
        key = _mixed(key * _P + column + np.uint64(1))
    return key.view(np.int64)


def _cached_hashes() -> WordHashes:
    cache = process_cache("near_dedup")
    known = cache.setdefault("word_hashes", WordHashes())
    if len(known) > MAX_WORDS:
        known.clear()
    return known


def _signatures(words: int, rows: int, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashes = _cached_hashes()
        pack = zstandard.ZstdCompressor(level=1).compress
        a, b = permutations(2 * rows * side)
        for batch in batches:
            for part in in_parts(batch, ["text"], PART_ROWS, PART_BYTES):
                out = []
                if len(hashes) > MAX_WORDS:
                    hashes.clear()
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = (text or "").encode()
                    x = shingles(data, hashes, words)
                    if len(x):
                        mark = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                        out.append((key, len(x), int.from_bytes(mark[:8], "big", signed=True), int.from_bytes(mark[8:], "big", signed=True), half_keys(x, a, b, rows), pack(data)))
                    else:
                        out.append((key, 0, None, None, None, None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n", "set_a", "set_b", "half", "packed"])
        trim()

    return run


def linked_pairs(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i < j) of the sets with 100 * intersection >= percent * union."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    number = np.cumsum(counts > 1) - 1
    row, col = owner[shared], number[column[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(counts[counts > 1].size), COLUMNS):
        a, b = np.searchsorted(col, [start, start + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, int(col[b - 1]) - start + 1 if b > a else 1)), np.float32)
        x[row[a:b], col[a:b] - start] = 1
        both += x @ x.T
    rows, columns = [], []
    for i in range(len(sets) - 1):  # counts are exact in float32, their products need more
        own = both[i, i + 1 :].astype(np.float64)
        found = i + 1 + np.flatnonzero((100 + percent) * own >= percent * (sizes[i] + sizes[i + 1 :]))
        rows.append(np.full(len(found), i))
        columns.append(found)
    return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *columns])


def forest(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that join what is still apart."""
    parent = list(range(n))
    out = []
    for i, j in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True):
        x, y = i, j
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _verify(words: int, percent: int):
    """Rows sorted by group (cluster, two blocks) to links of the group's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hashes = _cached_hashes()
        unpack = zstandard.ZstdDecompressor().decompress
        group, ids, sets = None, [], []

        def links() -> list[tuple[int, int]]:
            return [(ids[i], ids[j]) for i, j in forest(len(ids), linked_pairs(sets, percent))] if len(ids) > 1 else []

        def record(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, x, y, doc, packed in zip(*(batch.column(n).to_pylist() for n in ("cluster", "x", "y", "doc_id", "packed")), strict=True):
                if (key, x, y) != group:
                    out += links()
                    group, ids, sets = (key, x, y), [], []
                ids.append(doc)
                sets.append(shingles(unpack(packed), hashes, words))
            yield record(out)
        yield record(links())
        trim()

    return run


def near_duplicates(
    docs: DataFrame, percent: int = 85, words: int = WORDS, rows: int = ROWS, side: int = SIDE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = materialize(
        source.mapInArrow(_signatures(words, rows, side), "doc_id long, n long, set_a long, set_b long, half array<long>, packed binary"), "signatures"
    )
    some = signed.where("n > 0 and doc_id is not null")
    classes = materialize(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class"), F.first("n").alias("n")), "classes")
    # keys of one row for each class; those that no other class holds can't make a table's bucket
    rep = some.select("doc_id", "set_a", "set_b", "half").join(classes, (some["doc_id"] == classes["class"]) & (some["set_a"] == classes["set_a"]) & (some["set_b"] == classes["set_b"]), "left_semi")
    halves = materialize(rep.select("doc_id", F.posexplode("half").alias("place", "key")), "halves")
    shared = halves.groupBy("place", "key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("place", "key")
    live = halves.join(shared, ["place", "key"]).groupBy("doc_id")
    side_a, side_b = (F.collect_list(F.when(which, F.struct("place", "key"))) for which in (F.col("place") < side, F.col("place") >= side))
    paired = live.agg(side_a.alias("x"), side_b.alias("y")).select("doc_id", F.explode("x").alias("x"), "y").select("doc_id", "x", F.explode("y").alias("y"))
    tables = materialize(paired.select("doc_id", F.xxhash64("x.place", "x.key", "y.place", "y.key").alias("bucket")), "tables")
    release(halves)
    buckets = tables.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("bucket", "first")
    met = tables.join(buckets, "bucket").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = components(met)
    release(tables)
    cluster = materialize(near.unionByName(near.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    texts = some.join(cluster, "doc_id").join(classes.select("set_a", "set_b", F.col("class").alias("doc_id")), ["doc_id", "set_a", "set_b"], "left_semi").select("cluster", "doc_id", "n", "packed")
    sizes = cluster.join(classes.groupBy(F.col("class").alias("doc_id")).agg(F.max("n").alias("n")), "doc_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    blocks = sizes.select("cluster", F.ceil(F.greatest(F.col("docs") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = texts.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    grouped = dealt.select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc_id", "packed").repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    found = components(grouped.mapInArrow(_verify(words, percent), "a long, b long"))
    named = classes.join(found.withColumnRenamed("node", "class"), "class", "left").select("set_a", "set_b", F.coalesce("component", "class").alias("component_id"))
    named = materialize(named, "components")
    plain = signed.select("doc_id", "n", "set_a", "set_b")
    with_set = plain.where("n > 0 and doc_id is not null").join(named, ["set_a", "set_b"]).select("doc_id", "n", "component_id")
    without = plain.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = with_set.unionByName(without)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
