"""The operators of this subpackage as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import oracles
from strandflow.llm.common import read_table, split_of

#: The key is a parameter of a run; a real one comes from the caller.
PSEUDONYM_KEY = "example key"


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandflow.llm.pitman_yor import score_documents

    return score_documents(read_table(spark, sf_dir, "documents"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandflow.llm.pseudonyms import pseudonymize

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymize(docs, PSEUDONYM_KEY)
    return out.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_replaced"), "pii_spans")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandflow.llm.packing import pack

    out = pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandflow.llm.common import materialize
    from strandflow.llm.media import attach_payloads, media_features, parse_sequences, resolve_references

    pages = attach_payloads(read_table(spark, sf_dir, "documents"))
    parsed = parse_sequences(pages, keep=("row", "doc_id", "n_bytes", "digest", "stored"))
    media = F.filter("items", lambda x: x["kind"] == "media")
    # one pass: the items' texts go into a digest, and only references move on
    whole = parsed.select(
        "row", "doc_id", "n_bytes", "digest", "stored", F.size("items").alias("n_items"), F.sha2(F.to_json("items"), 256).alias("sequence_sha256"),
        F.transform(media, lambda x: F.struct(x["position"].alias("position"), x["digest"].alias("digest"))).alias("references"), F.transform(media, lambda x: x["caption"]).alias("captions"),
    )
    whole = materialize(whole, "media")
    resolved = resolve_references(whole.select("row", "references"), media_features(whole.select("digest", "stored")))
    first = F.col("resolved")[0]["media"]
    out = whole.select("row", "doc_id", "n_bytes", "n_items", "sequence_sha256", "captions").join(resolved, "row")
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    positions = F.transform("resolved", lambda x: x["position"]).alias("positions")
    return out.select("doc_id", "n_bytes", *[first[n].alias(n) for n in names], "n_items", "sequence_sha256", positions, "captions")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandflow.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandflow.llm.extraction import extract_pages

    return extract_pages(read_table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandflow.llm.sharding import interleave

    out = interleave(read_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandflow.llm.fingerprint import fingerprint_pairs

    return fingerprint_pairs(read_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandflow.llm.language import fit, predict, sample_labelled

    held_out = F.coalesce(split_of(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = read_table(spark, sf_dir, "documents")
    model = fit(sample_labelled(docs, ~held_out))
    return predict(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandflow.llm.byte_bpe import encode_documents

    docs = read_table(spark, sf_dir, "documents")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_packing": op3_packing,
    "op4_media": op4_media,
    "op5_near_dedup": op5_near_dedup,
    "op6_extraction": op6_extraction,
    "op7_sharding": op7_sharding,
    "op8_fingerprints": op8_fingerprints,
    "op9_language": op9_language,
    "op10_byte_bpe": op10_byte_bpe,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
