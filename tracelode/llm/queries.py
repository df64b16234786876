"""The queries of this subpackage: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    found = jaccard_components(table(spark, sf_dir, "documents"), n=3, threshold=0.9)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    # Real runs name their own key; this one is for the driver's tables.
    found = pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("spark.tracelode.pii.key", "tracelode"))
    kinds = F.array_join(F.transform("found", lambda x: x["kind"]), ",")
    return found.select(F.col("id").alias("doc_id"), "text", F.size("found").cast("long").alias("n_found"), kinds.alias("kinds"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats, loss_text, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{odd}'), (-1L, 1L, 'assistant', '{odd}') AS t(conv_id, turn, role, text)"))
    d = read_back(format_chats(rows)).withColumn("loss", loss_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_violations",
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_column

    found = encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join(F.transform("token_ids", lambda x: x.cast("string")), ",")
    return found.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), "round_trip")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    found = token_counts(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    found = round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import centroid_clusters

    found = centroid_clusters(table(spark, sf_dir, "embeddings"))
    written = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written, 256).alias("centroid_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import decode_ids, encode_texts

    found = decode_ids(encode_texts(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return found.select(
        F.col("id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_pii_pseudonyms": op2_pii_pseudonyms,
        "op4_chat_format": op4_chat_format,
        "op3_sentencepiece": op3_sentencepiece,
        "op5_token_counts": op5_token_counts,
        "op6_html_text": op6_html_text,
        "op7_warc": op7_warc,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_filter_audit": op13_filter_audit,
    }
