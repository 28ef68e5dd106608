"""Rows rewritten along paths, insertions merged on a backbone, validation, schedules of stars, k-mer distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replayed(row: Column, path: Column, side: int, gap: str = "-") -> Column:
    """The row's letters at the steps that it takes part in, else the gap; no Python: letters and gaps with their places, in order."""
    steps = F.transform(path, lambda p, k: F.struct(k.alias("k"), (p != side).alias("takes")))
    places = F.transform(F.filter(steps, lambda s: s["takes"]), lambda s: s["k"])
    letters = F.filter(F.split(row, ""), lambda c: c != "")
    taken = F.filter(F.zip_with(places, letters, lambda k, c: F.struct(k.alias("k"), F.coalesce(c, F.lit("")).alias("c"))), lambda x: x["k"].isNotNull())
    gaps = F.transform(F.filter(steps, lambda s: ~s["takes"]), lambda s: F.struct(s["k"].alias("k"), F.lit(gap).alias("c")))
    return F.array_join(F.transform(F.array_sort(F.concat(taken, gaps)), lambda x: x["c"]), "")


def insertion_runs(steps: DataFrame) -> DataFrame:
    """steps(row_id, k, step) to (row_id, place, n): letters inserted before each backbone column."""
    order = Window.partitionBy("row_id").orderBy("k")
    place = F.sum((F.col("step") != 1).cast("long")).over(order)
    return steps.withColumn("place", F.coalesce(place, F.lit(0))).where("step = 1").groupBy("row_id", "place").agg(F.count(F.lit(1)).alias("n"))


def slots(runs: DataFrame) -> DataFrame:
    """The longest insertion at each place, and the slots before it."""
    longest = runs.groupBy("place").agg(F.max("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))  # one row for each backbone column at most
    return longest.select("place", "n", F.coalesce(before, F.lit(0)).alias("before"))


def path_lengths(paths: DataFrame) -> DataFrame:
    """paths(pair_id, path): reference and query columns that each path uses."""

    def used(skip: int) -> Column:
        return F.size(F.filter("path", lambda p: p != skip)).cast("long")

    return paths.select("pair_id", used(1).alias("ref_len"), used(2).alias("qry_len"))


def merge_order(info: DataFrame) -> DataFrame:
    """Alignments by falling row count, then name: the first absorbs the others, one a level."""
    rank = F.row_number().over(Window.orderBy(F.col("n_rows").desc(), "node"))  # one row for each alignment
    return info.select("node", "n_rows", (rank - 1).cast("long").alias("merge_level"))


def kmer_distance(sequences: DataFrame, k: int = 6) -> DataFrame:
    """(a, b, distance): one less the Jaccard similarity of distinct k-mers, of sequences that share some.

    Sequences that share none have distance 1 and no row, so no pair is formed
    without a common k-mer.
    """
    n = F.length("seq")
    grams = sequences.where(n >= k).select(
        "seq_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("seq"), i, F.lit(k))))).alias("gram")
    )
    sizes = grams.groupBy("seq_id").agg(F.count(F.lit(1)).alias("size"))
    left, right = grams.withColumnRenamed("seq_id", "a"), grams.withColumnRenamed("seq_id", "b")
    common = left.join(right, "gram").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    sized = common.join(sizes.select(F.col("seq_id").alias("a"), F.col("size").alias("x")), "a").join(sizes.select(F.col("seq_id").alias("b"), F.col("size").alias("y")), "b")
    return sized.select("a", "b", F.round(1 - F.col("n") / (F.col("x") + F.col("y") - F.col("n")), 6).alias("distance"))
