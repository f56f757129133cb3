"""Rules every record table must satisfy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgate.functions.idents import id_error, name_error
from feedgate.functions.labels import digest_error
from feedgate.limits import EMPTY_DOCUMENT, EMPTY_DOCUMENT_HASH
from feedgate.operators.merge import KEY


def row_violations(records: DataFrame) -> dict:
    """One condition per rule that can be judged on a row alone."""
    dead = F.col("deleted_at").isNotNull()
    return {
        "content_hash_format": digest_error(F.col("content_hash")).isNotNull(),
        "tombstone_payload": dead
        & ((F.col("payload") != EMPTY_DOCUMENT) | (F.col("content_hash") != EMPTY_DOCUMENT_HASH)),
        "seq_negative": F.coalesce(F.col("seq") < 0, F.lit(True)),
        "id_grammar": id_error(F.col("id")).isNotNull(),
        "source_grammar": name_error(F.col("source")).isNotNull(),
        "collection_grammar": name_error(F.col("collection")).isNotNull(),
    }


def integrity_report(records: DataFrame) -> DataFrame:
    """``rule, violations`` for every rule, zero included.

    Row rules are one scan with a single-row result. The two uniqueness rules are each one
    pre-aggregated exchange of short rows.
    """
    rules = row_violations(records)
    flat = records.agg(
        *[F.count_if(condition).alias(rule) for rule, condition in rules.items()]
    ).select(
        F.explode(
            F.array(
                *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules]
            )
        ).alias("_row")
    ).select("_row.*")

    def repeated(columns: list[str], rule: str) -> DataFrame:
        counts = records.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        return counts.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
            F.lit(rule).alias("rule"), "violations"
        )

    return flat.unionByName(repeated(KEY, "key_unique")).unionByName(repeated(["seq"], "seq_unique"))
