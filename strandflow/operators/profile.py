"""Column profiles as long tables (node, pos, letter, freq): sums, consensus, penalties, merging, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.alphabet import GAP_EXTEND, GAP_OPEN, letter_index, letters_of
from strandflow.operators.qc import cells

DIGITS = 6


def raw_profile(msa: DataFrame, kind: str = "n") -> DataFrame:
    """Sums of the rows' weights by node, column and letter."""
    return cells(msa, "weight").groupBy("node", "pos", letter_index(F.col("ch"), kind).alias("letter")).agg(F.sum("weight").alias("freq"))


def profile(msa: DataFrame, kind: str = "n") -> DataFrame:
    """raw_profile scaled from the sum of a node's weights to its number of rows."""
    rows = msa.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    return raw_profile(msa, kind).join(rows, "node").select("node", "pos", "letter", (F.col("freq") / F.col("w") * F.col("n")).alias("freq"))


def consensus(prof: DataFrame, kind: str = "n") -> DataFrame:
    """The most frequent real letter of each column, the first of equals; N or X without any."""
    letters = letters_of(kind)
    real = F.when((F.col("letter") < len(letters)) & (F.col("freq") > 0), F.struct(F.col("freq"), -F.col("letter")))
    best = prof.groupBy("node", "pos").agg(F.max(real).alias("b"))
    letter = F.substring(F.lit(letters), 1 - F.col("b")["col2"], F.lit(1))
    return best.select("node", "pos", F.coalesce(letter, F.lit("N" if kind == "n" else "X")).alias("letter"))


def consensus_strings(columns: DataFrame) -> DataFrame:
    return columns.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "").alias("consensus"))


def gap_penalties(prof: DataFrame, kind: str = "n", gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND) -> DataFrame:
    """(node, pos, op, ex): weaker penalties where rows have gaps; at least a tenth and a fifth of the plain ones."""
    gap = len(letters_of(kind)) + 1
    sums = prof.groupBy("node", "pos").agg(F.sum("freq").alias("n"), F.sum(F.when(F.col("letter") == gap, F.col("freq")).otherwise(0.0)).alias("g"))
    share = (F.col("n") - F.col("g")) / F.col("n")
    scale = 0.5 if kind == "n" else 1.0
    op = F.when(F.col("g") > 0, F.least(F.lit(gap_open * 0.1), gap_open * scale * share)).otherwise(gap_open)
    ex = F.when(F.col("g") > 0, F.least(F.lit(gap_extend * 0.2), gap_extend * share)).otherwise(gap_extend)
    return sums.select("node", "pos", F.round(op, DIGITS).alias("op"), F.round(ex, DIGITS).alias("ex"))


def walked(paths: DataFrame) -> DataFrame:
    """paths(pair_id, k, step) with the reference and query columns that each step uses (null for a gap)."""
    order = Window.partitionBy("pair_id").orderBy("k")
    ref = F.sum((F.col("step") != 1).cast("int")).over(order) - 1
    qry = F.sum((F.col("step") != 2).cast("int")).over(order) - 1
    return paths.select("pair_id", "k", "step", F.when(F.col("step") != 1, ref).alias("ref"), F.when(F.col("step") != 2, qry).alias("qry"))


def merge_along(ref: DataFrame, qry: DataFrame, paths: DataFrame, gap: int, ref_weight: float, qry_weight: float) -> DataFrame:
    """Profiles (pair_id, pos, letter, freq) added along paths; a side without a column adds its weight to the gap."""
    steps = walked(paths)
    left = steps.where("ref is not null").join(ref.withColumnRenamed("pos", "ref"), ["pair_id", "ref"]).select("pair_id", "k", "letter", "freq")
    right = steps.where("qry is not null").join(qry.withColumnRenamed("pos", "qry"), ["pair_id", "qry"]).select("pair_id", "k", "letter", "freq")
    lone = steps.where("step <> 0").select("pair_id", "k", F.lit(gap).alias("letter"), F.when(F.col("step") == 1, ref_weight).otherwise(qry_weight).alias("freq"))
    return left.unionByName(right).unionByName(lone).groupBy("pair_id", F.col("k").alias("pos"), "letter").agg(F.sum("freq").alias("freq"))


def similarity(ref: DataFrame, qry: DataFrame, matrix: DataFrame, gap: int, gap_letter: float) -> DataFrame:
    """(ref_pos, qry_pos, score) of profile columns, from a matrix of at most 21 x 21 rows that is broadcast."""
    rows = [p.groupBy("pos").agg(F.sum("freq").alias("n")).agg(F.max("n").alias("n")) for p in (ref, qry)]
    a = ref.select(F.col("pos").alias("ref_pos"), F.col("letter").alias("a"), F.col("freq").alias("x"))
    b = qry.select(F.col("pos").alias("qry_pos"), F.col("letter").alias("b"), F.col("freq").alias("y"))
    # a row's letter meets the matrix first, so the pairs of columns come from an equi-join on the query's letter
    scored = a.join(F.broadcast(matrix), F.col("a") == F.col("letter_a")).groupBy("ref_pos", F.col("letter_b").alias("b")).agg(F.sum(F.col("x") * F.col("score")).alias("s"))
    total = scored.join(b, "b").groupBy("ref_pos", "qry_pos").agg(F.sum(F.col("s") * F.col("y")).alias("s"))
    n = rows[0].select(F.col("n").alias("nr")).join(rows[1].select(F.col("n").alias("nq")))
    return total.join(F.broadcast(n)).select("ref_pos", "qry_pos", F.round(F.col("s") / (F.col("nr") * F.col("nq")), DIGITS).alias("score"))


def matrix_rows(matrix, gap_letter: float) -> list[tuple[int, int, float]]:
    """The matrix as rows, with letter against gap scoring gap_letter and gap against gap 0."""
    k = matrix.shape[0]
    rows = [(a, b, float(matrix[a, b])) for a in range(k) for b in range(k)]
    return rows + [(a, k, gap_letter) for a in range(k)] + [(k, a, gap_letter) for a in range(k)] + [(k, k, 0.0)]
