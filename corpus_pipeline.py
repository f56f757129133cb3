"""A training corpus from documents, stage by stage; each stage's rows are written and read again.

Every stage takes all rows that the one before it kept, and returns their columns; the last one adds
the shares of the mix. Rows with null ids or texts are rows like others: a null text fails the
quality rules; of rows in a near-duplicate group the one with the smallest id stays, null last, and
of equal ones any, but one only. Columns beyond those of documents pass through, unless the last
stage adds a column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgate.llm import contamination, mixing, pii, quality_rules, simhash
from feedgate.llm.common import quoted, table
from feedgate.sources.scratch import save


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    columns = [quoted(name) for name in docs.columns]
    rows = docs.withColumn("__row", F.xxhash64(*columns))
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col("__row").alias("row"))
    groups = simhash.near_duplicates(rows.select(order.alias("__order"), "text"), id_col="__order")
    ids = groups.select("__order.doc_id", "__order.row", (F.col("__order") == F.col("component_id")).alias("stays"))
    ids = save(ids.groupBy("doc_id", "row").agg(F.first("stays").alias("stays"), F.count("*").alias("n")), "near-duplicates")

    def those(condition: str) -> DataFrame:
        return ids.where(condition).select(F.col("doc_id").alias("__id"), F.col("row").alias("__key"))

    here = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__key"))
    kept = rows.join(those("NOT stays"), here, "left_anti")
    if not those("stays AND n > 1").isEmpty():  # rows equal in every column
        once = kept.join(those("n > 1"), here, "left_semi").dropDuplicates(["doc_id", "__row"])
        kept = kept.join(those("n > 1"), here, "left_anti").unionByName(once)
    return kept.select(*columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = contamination.contamination(F.col("text"), table(spark, sf_dir, "benchmark"))
    return docs.where(~found["contaminated"])


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs, pii.fit_selector(docs))
    kind = dict(docs.dtypes)
    if "n_chars" in kind:
        clean = clean.withColumn("n_chars", F.length("text").cast(kind["n_chars"]))
    return clean.select(*(quoted(name) for name in docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, and how many; the last stage."""
    return mixing.mix(docs, keep=docs.columns).where("taken > 0")


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmarks),
    ("pii", without_personal_data),
    ("source_mixing", mixed_sources),
]

#: Fingerprints, learned redaction and seeded picks are beyond SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
