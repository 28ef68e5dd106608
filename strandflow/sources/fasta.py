"""FASTA and FASTQ (plain or gzip) sources and sinks as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_ord, name, seq) of each record; the name ends at the first white space, lines are joined.

    Records are split by Spark's text reader, so a plain file is read in parallel.
    """
    text = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", "true").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("file_ord"), F.regexp_replace("value", "^>|\r", "").alias("v"))
    head = F.regexp_extract("v", r"^([^\n]*)", 1)
    body = F.expr("substring(v, length(regexp_extract(v, '^([^\\n]*)', 1)) + 1)")
    return rows.where(F.length(F.trim("v")) > 0).select(
        "file", "file_ord", F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.regexp_replace(body, r"\s", "").alias("seq")
    )


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_ord, name, seq) of four-line FASTQ records; qualities are ignored."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("k", "line"))
    record = F.floor(F.col("k") / 4)
    made = lines.groupBy("file", record.alias("file_ord")).agg(
        F.max(F.when(F.col("k") % 4 == 0, F.col("line"))).alias("head"), F.max(F.when(F.col("k") % 4 == 1, F.col("line"))).alias("seq")
    )
    return made.where("head like '@%'").select("file", "file_ord", F.regexp_extract("head", r"^@(\S+)", 1).alias("name"), "seq")


def read_alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each alignment in a folder: those as long as its first row."""
    rows = read_fasta(spark, folder).withColumnRenamed("seq", "aligned")
    first = rows.groupBy("file").agg(F.min_by(F.length("aligned"), "file_ord").alias("width"))
    return rows.join(first, "file").where("length(aligned) = width").drop("width")


def infer_kind(lines: DataFrame, limit: int = 100) -> DataFrame:
    """One row, kind: p if among the first `limit` lines of sequences a letter only of proteins comes before any U, else n."""
    some = lines.orderBy("file_ord").limit(limit)
    letters = some.select("file_ord", F.posexplode(F.split(F.upper("seq"), "")).alias("k", "c"))
    found = letters.where(F.col("c").isin(*"EFIJLPQZU"))  # fixed values: letters that decide
    return found.agg(F.min_by(F.when(F.col("c") == "U", "n").otherwise("p"), F.struct("file_ord", "k")).alias("kind")).select(F.coalesce("kind", F.lit("n")).alias("kind"))


def write_fasta(rows: DataFrame, path: str, text_column: str = "aligned", compress: bool = False, mode: str = "errorifexists") -> None:
    """Records in the rows' order of partitions."""
    out = rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), text_column).alias("value"))
    out.write.mode(mode).option("compression", "gzip" if compress else "none").text(path)


def read_sequences(spark: SparkSession, path: str, leaves: DataFrame) -> DataFrame:
    """Records of FASTA files that are leaves(name, group_id, weight) of a tree, with the leaf's part and weight; the first of repeated names."""
    rows = read_fasta(spark, path)
    one = rows.groupBy("name").agg(F.min_by("seq", F.struct("file", "file_ord")).alias("seq"), F.min("file_ord").alias("seq_id"))
    return one.join(leaves, "name")


def write_parts(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The alignment of each part in a folder of its own (group_id=...)."""
    rows.select("group_id", F.concat(F.lit(">"), "name", F.lit("\n"), "aligned").alias("value")).repartition("group_id").write.mode(mode).partitionBy("group_id").text(path)


def write_filtered(sequences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The sequences that quality control excluded."""
    write_fasta(sequences.where("status = 'excluded'"), path, "seq", mode=mode)


def write_tree(spark: SparkSession, tree, path: str, mode: str = "errorifexists") -> None:
    """A tree as Newick text, such as the pruned one."""
    from strandflow.sources import newick

    spark.createDataFrame([(newick.write(tree),)], "value string").coalesce(1).write.mode(mode).text(path)


def write_subtrees(spark: SparkSession, roots: dict, path: str, mode: str = "errorifexists") -> None:
    """The tree of each part of newick.partition() in a folder of its own (group_id=...)."""
    from strandflow.sources import newick

    rows = [(g, newick.write(newick.copy(n, lambda x, g=g: x.group == g))) for g, n in roots.items()]
    spark.createDataFrame(rows, "group_id int, value string").write.mode(mode).partitionBy("group_id").text(path)
