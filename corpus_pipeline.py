"""A training corpus in four stages: language, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes
it as Parquet and reads it again as the next stage's docs. All but the last
return the columns of documents, whatever extra ones there are. run() does the
same by itself, with the stages' results in the shared folder. Texts are read
whole, however long; an empty table passes every stage as an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import materialize, read_table
from strandflow.llm.language import UNKNOWN, fit, predict, sample_labelled
from strandflow.llm.near_dedup import near_duplicates
from strandflow.llm.packing import pack
from strandflow.llm.pseudonyms import pseudonymize

#: A document is rejected when no language holds this share of its words.
LEAST_SHARE = 0.3
#: Near-duplicates share this percentage of their five-word shingles; shorter and more half keys keep the recall at the lower threshold.
PERCENT, ROWS, SIDE = 80, 6, 24
KEY = "example key"


def unused(name: str, columns: list[str]) -> str:
    """The name, longer by as many underscores as keep it apart from the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words, of which one language holds a fair share. Null, empty and letterless texts go."""
    columns = docs.columns
    model = fit(sample_labelled(docs, F.lit(True)))
    label, share = unused("lang_pred", columns), unused("score", columns)
    out = predict(docs, model, columns, names=(label, share))
    sure = F.col(share) >= LEAST_SHARE if model else F.lit(True)
    known = F.col(label) != UNKNOWN if model else F.regexp_like("text", F.lit(r"\p{L}"))
    return out.where(sure & known).select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id. Rows without an id stay; of rows that repeat a kept id, the least by text stays."""
    kept = near_duplicates(docs, percent=PERCENT, rows=ROWS, side=SIDE).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    kept = materialize(kept, "kept")
    # the ids grow with the documents, so they are never broadcast
    out = docs.join(kept.where("rows = 1").hint("merge"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)
    again = kept.where("rows > 1")
    if again.isEmpty():
        return out
    repeated = docs.join(again, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"), F.struct(F.col("text"), F.xxhash64(*docs.columns)).alias("by"))
    return out.unionByName(repeated.groupBy("doc_id").agg(F.min_by("row", "by").alias("row")).select("row.*").select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with valid identifiers replaced by pseudonyms and n_chars counted again; null texts stay null."""
    out = pseudonymize(docs, KEY, spans_column=unused("pii_spans", docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: Feature weights, MinHash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
