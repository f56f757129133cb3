"""Release projection, drop reports, coverage and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgate.functions import exact, release as compiled
from feedgate.spec import SpecSet

KEY = ["source", "collection", "id"]


def release(documents: DataFrame, specs: SpecSet) -> DataFrame:
    """Cut every document down to the fields its collection declares.

    Needs columns ``collection`` and ``payload`` (raw JSON text). ``payload`` becomes the
    canonical text of what is released; new columns are

    ``doc_state``     kind of the raw value, ``invalid`` if it is not JSON, NULL if absent
    ``doc_id``        id found at the collection's id path, NULL if there is none
    ``dropped``       array of (path, reason, expected, found) in document order
    ``content_hash``  SHA-256 of the canonical text, lower-case hex
    ``payload_bytes`` size of the canonical text

    A narrow, single-pass step: no shuffle, one parse per document, in one Arrow UDF.
    """
    collection = F.col("collection")
    rest = [c for c in documents.columns if c != "payload"]
    covered = F.when(collection.isin(list(specs)), F.col("payload"))
    decided = documents.select(*rest, exact.released(specs, collection, covered).alias("_released"))
    return decided.select(
        *rest,
        F.col("_released.state").alias("doc_state"),
        "_released.doc_id",
        "_released.payload",
        "_released.dropped",
    ).withColumns(
        {
            "content_hash": F.sha2("payload", 256),
            "payload_bytes": F.octet_length("payload"),
        }
    )


def dropped_fields(released: DataFrame, *carry: str) -> DataFrame:
    """One row per removed field, with the record it was removed from."""
    carry = carry or ("source", "collection", "id")
    exploded = released.select(*carry, F.posexplode_outer("dropped").alias("position", "_report"))
    return exploded.filter(F.col("position").isNotNull()).select(*carry, "position", "_report.*")


def coverage(released: DataFrame) -> DataFrame:
    """Per collection, how many documents lost nothing."""
    kept_all = F.size("dropped") == 0
    return released.groupBy("collection").agg(
        F.count_if(F.col("dropped").isNotNull()).alias("documents"),
        F.count_if(F.col("dropped").isNotNull() & kept_all).alias("complete"),
        F.count_if(F.col("dropped").isNotNull() & ~kept_all).alias("incomplete"),
    )


def fingerprint(documents: DataFrame, text_column: str = "payload") -> DataFrame:
    """Canonical text and content hash of whole documents, nothing removed.

    Documents of any shape need the key order and number forms of the canonical text at
    every depth. Spark's VARIANT orders object keys that way already, so plain documents stay
    native; those with numbers or escapes Spark prints differently are decided exactly.
    """
    rest = [c for c in documents.columns if c != text_column]
    text = F.col("_raw")
    pairs = documents.select(
        *rest, F.col(text_column).alias("_raw"), compiled.parsed(F.col(text_column)).alias("_pair")
    )
    native = pairs.select(
        *rest,
        "_raw",
        compiled.well_formed(F.col("_pair"), text).alias("_ok"),
        F.to_json(F.try_variant_get("_pair", "$[0]", "variant")).alias("_text"),
    )
    odd_number = r"[0-9][eE][-+]?[0-9]|[0-9.]{16,}|0\.000000"
    unsure = (
        ~F.col("_ok")
        | compiled.suspicious(text)
        | F.col("_text").contains("\\u00")
        | text.rlike(odd_number)
        | F.col("_text").rlike(odd_number)
    )
    flagged = native.withColumn("_exact", text.isNotNull() & unsure)
    checked = flagged.withColumn("_fix", exact.exact_text(text, F.col("_exact")))
    return checked.select(
        *rest,
        F.when(F.col("_exact"), F.col("_fix")).otherwise(F.col("_text")).alias("payload"),
    ).withColumns(
        {
            "content_hash": F.sha2("payload", 256),
            "payload_bytes": F.octet_length("payload"),
        }
    )
