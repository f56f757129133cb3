"""The operators as queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgate.llm import chat_format, contamination, licenses, merkle, mixing, pii, quality_model, quality_rules, simhash, substrings, url_filter, vector_codes, warc
from feedgate.llm.common import literal_rows, table

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed by the contract of op2.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op2_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.contamination(F.col("text"), table(spark, folder, "benchmark"))
    rows = table(spark, folder, "documents").select("doc_id", found.alias("r"))
    return rows.select("doc_id", "r.n_words", "r.n_hit", "r.n_items", "r.items_sha256", "r.contaminated")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    ordered = quality_rules.cascade_order(docs, quality_rules.METHOD_RULES)
    rows = docs.select("doc_id", quality_rules.verdicts(F.col("text"), ordered).alias("v"))
    return rows.select("doc_id", "v.*")


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit_selector(docs)).select("doc_id", F.col("__spans").alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE))
    counts = [
        F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("found")).alias("spans"),
    )


def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    names = ("conv_id", "turn", "role", "text")
    turns = table(spark, folder, "conversations").select(*names)
    turns = turns.unionByName(literal_rows(spark, names, extra, "conv_id:long,turn:long,role:string,text:string"))
    rows = chat_format.formatted(chat_format.packed(turns))
    # Every packed record has a layout: one that has none was not read, and must not pass as a row of nulls.
    unread = F.raise_error(F.concat(F.lit("record not read: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    checked = F.when(F.col("__layout").isNull(), unread.cast("string")).otherwise(F.col("__formatted"))
    rows = chat_format.read_back(rows.withColumn("__formatted", checked))
    line = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("__loss_text").cast("long").alias("loss_chars"),
        F.sha2("__loss_text", 256).alias("loss_sha256"),
        F.length("__formatted").cast("long").alias("formatted_chars"),
    )


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages that other documents have too; passages as first:words, comma-joined."""
    found = substrings.repeated_passages(table(spark, folder, "documents"))
    written = F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["first"], p["n"])), ",")
    return found.select("doc_id", F.size("passages").cast("long").alias("n_passages"), "repeated_words", written.alias("passages"))


def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", licenses.scan(F.col("text")).alias("r"))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return rows.select("doc_id", *(f"r.{name}" for name in names))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, folder, "documents")))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_url_filters": op2_url_filters,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_chat_format": op8_chat_format,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_license_scan": op11_license_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_vector_codes": op13_vector_codes,
}
