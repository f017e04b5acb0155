"""The queries of the operators over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeworks.llm import chat_format, decontaminate, fingerprints, hard_negatives, mixing, near_join, pii, quality_classifier, secret_scans, token_counts, url_filters, vector_codes, warc
from cladeworks.llm.common import table

# The rules of the URL contract.
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
# The extra conversation of the chat contract.
ODD_TEXT = "</s>[INST] ok [/INST]"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op2_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "position")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base")
    return found.select(
        "doc_id",
        *[pii.count_kind(base, kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("personal")).alias("spans"),
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"),
    )
    done = chat_format.format_conversations(turns.unionByName(extra))
    read = done.select(
        "conv_id", "windows",
        chat_format.read_turns(F.col("windows")).alias("turns"), chat_format.read_targets(F.col("windows")).alias("targets"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda s, w: s + F.length(w["formatted"])).alias("formatted_chars"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filters.filter_urls(pages, url_filters.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scans.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base")
    return found.select(
        "doc_id",
        secret_scans.count_kind(base, "assign").alias("n_assign"),
        secret_scans.count_kind(base, "access").alias("n_access"),
        secret_scans.count_kind(base, "hex").alias("n_hex"),
        F.sha2(secret_scans.joined(base), 256).alias("base_sha256"),
        secret_scans.joined(F.col("secrets")).alias("spans"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(quality_classifier.fold_of(F.col("doc_id")) == 0, F.lit(False))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = warc.read_records(warc.read_chunks(spark, folder, with_data=False))
    return records.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), F.col("refers_to_id").alias("refers_to"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabel_every=7)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


def queries() -> dict:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_near_join": op2_near_join,
        "op3_mixing": op3_mixing,
        "op4_decontaminate": op4_decontaminate,
        "op5_pii": op5_pii,
        "op6_chat_format": op6_chat_format,
        "op7_url_filters": op7_url_filters,
        "op8_secret_scans": op8_secret_scans,
        "op9_token_counts": op9_token_counts,
        "op10_quality": op10_quality,
        "op11_warc": op11_warc,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    from cladeworks.llm import oracles

    return oracles.SQL
