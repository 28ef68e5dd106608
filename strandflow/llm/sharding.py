"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows of each source are shuffled by a seeded digest of their id, ranked, and
placed at the fractional rank (2r - 1) / 2n; all rows sorted by that fraction
and cut evenly give shards whose mixture matches the input's and whose counts
differ by one at most.

No window spans a source or the table. A rank is the sum of the sizes of the
smaller buckets and the rank within the bucket; buckets are ranges of the
shuffle key (then of the fraction), so a source with a third of all rows has
its rows in as many tasks as any. The bucket counts grow with the rows by
ROWS_A_BUCKET and are summed with bounded windows.

Null texts have size 1; null sources form a stratum of their own; repeated ids
are ordered by their text's checksum and then stand side by side (the same
rows, so any order is the same result). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BUCKET = 1024


def _ranked(rows: DataFrame, strata: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Rank from 1 within the strata, by bucket and then by order."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*strata, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    keys = [*strata, "_bucket"]
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = rows.withColumn("_within", within).join(starts, keys)
    return ranked.withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def interleave(
    docs: DataFrame, shards: int, seed: str = "0", id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", buckets: int | None = None
) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of each row.

    buckets: of the ranks; by default one for ROWS_A_BUCKET rows.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        F.col(source_column).isNull().alias("_no_source"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))).cast("binary")).alias("_key"),
    )
    total = docs.count()
    buckets = buckets or max(1, min(1 << 20, -(-total // ROWS_A_BUCKET)))
    strata = ["source", "_no_source"]
    sizes = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_of"))
    first = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32))
    ranked = _ranked(rows, strata, first, ["_key", "doc_id", "text_crc32", "size"], "_rank").join(sizes, strata)
    placed = ranked.withColumn("_at", (2 * F.col("_rank") - 1) / (2 * F.col("_of")))
    second = F.floor(F.col("_at") * buckets)
    ordered = _ranked(placed.withColumn("_all", F.lit(0)), ["_all"], second, ["_at", "source", "_no_source", "_rank"], "_position")
    position = F.col("_position") - 1
    shard = F.floor(position * shards / F.lit(max(total, 1)))
    # the first position of shard s is ceil(s * total / shards)
    start = F.floor((F.col("shard") * total + (shards - 1)) / F.lit(shards))
    return ordered.withColumn("shard", shard.cast("int")).select(
        "doc_id", F.when(~F.col("_no_source"), F.col("source")).alias("source"), "size", "text_crc32", "shard", (position - start).cast("long").alias("slot")
    )
