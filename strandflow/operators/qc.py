"""Quality control of sequences: statistics, thresholds, names and gappy columns, as DataFrame operations.

sequences: seq_id, name, seq. msa: node, row_id, aligned (rows of a node have one width).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def length_stats(sequences: DataFrame) -> DataFrame:
    """Count, extremes, integer average and upper median of the lengths.

    The median comes from the counts of the lengths, so one row for each
    distinct length is sorted, not one for each sequence.
    """
    counts = sequences.groupBy(F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.sum(F.col("len") * F.col("n")).alias("letters"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("len")))
    median = upto.join(totals.select("total")).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("len").alias("median_len"))
    return totals.join(median).select(
        F.col("total").alias("n_seqs"),
        F.col("min_len").cast("long").alias("min_len"),
        F.col("max_len").cast("long").alias("max_len"),
        F.expr("letters div total").alias("avg_len"),
        F.col("median_len").cast("long").alias("median_len"),
    )


def length_bounds(sequences: DataFrame, deviation: float) -> DataFrame:
    """Truncated bounds around the upper median: one row, (low, high)."""
    median = F.col("median_len")
    return length_stats(sequences).select((median * (1 - deviation)).cast("long").alias("low"), (median * (1 + deviation)).cast("long").alias("high"))


def with_status(sequences: DataFrame, bounds: DataFrame, max_ambiguous: float = 0.1, drop: bool = False, letters: str = "ACGTU") -> DataFrame:
    """status: ok, or deferred (excluded with drop) outside the bounds or with more than the share of ambiguous letters."""
    n = F.length("seq")
    ambiguous = F.length(F.regexp_replace("seq", f"[{letters}{letters.lower()}.-]", ""))
    bad = (n > F.col("high")) | (n < F.col("low")) | (ambiguous > n * F.lit(max_ambiguous))
    checked = sequences.join(F.broadcast(bounds))  # one row
    return checked.select(
        "seq_id", "name", n.cast("long").alias("len"), ambiguous.cast("long").alias("n_ambiguous"), F.when(bad, "excluded" if drop else "deferred").otherwise("ok").alias("status")
    )


def first_of_names(sequences: DataFrame) -> DataFrame:
    """The first record of each name, by an aggregate that combines before the shuffle."""
    return sequences.groupBy("name").agg(F.min_by(F.struct("seq_id", "seq"), "seq_id").alias("x")).select("name", "x.seq_id", "x.seq")


def in_tree(sequences: DataFrame, leaves: DataFrame) -> DataFrame:
    return sequences.join(leaves, "name", "left_semi")


def missing_leaves(sequences: DataFrame, leaves: DataFrame) -> DataFrame:
    return leaves.join(sequences, "name", "left_anti")


def cells(msa: DataFrame, *keep: str) -> DataFrame:
    """(node, row_id, pos, ch) of every letter, positions from 0."""
    return msa.select("node", "row_id", *keep, F.posexplode(F.split("aligned", "")).alias("pos", "ch")).where("ch <> ''")


def gap_counts(msa: DataFrame, gaps: tuple[str, ...] = ("-", ".")) -> DataFrame:
    return cells(msa).groupBy("node", "pos").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ch").isin(*gaps)).alias("gaps"))


def gappy_columns(msa: DataFrame, threshold: float) -> DataFrame:
    return gap_counts(msa).where(F.col("gaps") / F.col("n") > threshold) if threshold < 1 else gap_counts(msa).where(F.lit(False))


def runs(columns: DataFrame) -> DataFrame:
    """Maximal runs (start, len) of neighbouring positions of each node."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy("node").orderBy("pos"))
    return columns.withColumn("island", island).groupBy("node", "island").agg(F.min("pos").cast("long").alias("start"), F.count(F.lit(1)).alias("len")).drop("island")


def kept_columns(msa: DataFrame, keep: Column) -> DataFrame:
    """(node, keep): the positions of the columns for which keep holds over (n, gaps), in order."""
    return gap_counts(msa, ("-",)).where(keep).groupBy("node").agg(F.sort_array(F.collect_list("pos")).alias("keep"))


def masked(msa: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows with only the kept columns; the list has one number for each column of a node."""
    rows = msa.join(columns, "node", "left")
    # the letters are split once, not at each position
    letters = F.array(F.filter(F.split("aligned", ""), lambda c: c != ""))
    text = F.array_join(F.element_at(F.transform(letters, lambda row: F.transform("keep", lambda p: F.get(row, p))), 1), "")
    return rows.select("node", "row_id", F.coalesce(text, F.lit("")).alias("aligned"))


def msa_info(msa: DataFrame) -> DataFrame:
    return msa.groupBy("node").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.length("aligned")).cast("long").alias("width"))


def ungapped(column: Column) -> Column:
    return F.regexp_replace(column, "[-.]", "")
