"""Records, changes, pages and manifests in the form they are served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgate.functions.labels import rfc3339
from feedgate.operators.gates import sized
from feedgate.operators.summary import COLLECTION, max_positions


def served_records(rows: DataFrame) -> DataFrame:
    return rows.select(
        *COLLECTION, "id", "seq", rfc3339(F.col("ingested_at")).alias("ingested_at"),
        "content_hash", "payload",
    )


def served_changes(rows: DataFrame) -> DataFrame:
    return rows.select(
        *COLLECTION, "id", "seq", F.col("deleted_at").isNotNull().alias("deleted"),
        rfc3339(F.col("ingested_at")).alias("ingested_at"), "content_hash", "payload",
    )


def _text(value: Column) -> Column:
    """A JSON string; ids and times hold no control characters."""
    inner = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def body(rows: DataFrame, change: bool = False) -> Column:
    """One served row as JSON, the canonical payload nested as it is stored."""
    parts = ['{"id":', _text(F.col("id")), ',"seq":', F.col("seq").cast("string")]
    if change:
        parts += [',"deleted":', F.col("deleted").cast("string")]
    parts += [
        ',"ingested_at":', _text(F.col("ingested_at")),
        ',"content_hash":', _text(F.col("content_hash")),
        ',"payload":', F.col("payload"), "}",
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def page_bodies(pages: DataFrame, records: DataFrame, change: bool = False) -> DataFrame:
    """One JSON document per page; ``pages`` comes from the listing or the change feed.

    A page is bounded by its record count and byte budget, so it may be gathered.
    """
    served = served_changes(pages) if change else served_records(pages)
    rows = served.join(
        pages.select(*COLLECTION, "seq", "next_cursor"), [*COLLECTION, "seq"]
    ).select(*COLLECTION, "seq", "next_cursor", body(served, change).alias("_body"))
    gathered = rows.groupBy(*COLLECTION).agg(
        F.array_sort(F.collect_list(F.struct("seq", "_body"))).alias("_rows"),
        F.max("next_cursor").alias("next_cursor"),
    )
    positions = sized(max_positions(records))
    name = "changes" if change else "records"
    listed = F.array_join(F.transform("_rows", lambda row: row["_body"]), ",")
    return gathered.join(positions, COLLECTION, "left").select(
        *COLLECTION,
        F.concat(
            F.lit(f'{{"{name}":['), listed, F.lit('],"next_cursor":'),
            F.coalesce(F.col("next_cursor").cast("string"), F.lit("null")),
            F.lit(',"max_seq":'), F.coalesce("max_seq", F.lit(0)).cast("string"), F.lit("}"),
        ).alias("body"),
    )


def manifest_bodies(manifests: DataFrame) -> DataFrame:
    return manifests.select(
        *COLLECTION,
        F.concat(
            F.lit('{"count":'), F.col("count").cast("string"), F.lit(',"checksum":"'),
            F.col("checksum"), F.lit('","max_seq":'),
            F.coalesce("max_seq", F.lit(0)).cast("string"), F.lit("}"),
        ).alias("body"),
    )


def digest_bodies(pages: DataFrame) -> DataFrame:
    """One JSON document per digest page; a page is bounded by its record count."""
    entry = F.concat(
        F.lit('{"id":'), _text(F.col("id")), F.lit(',"content_hash":'), _text(F.col("content_hash")), F.lit("}")
    )
    gathered = pages.groupBy(*COLLECTION).agg(
        F.array_sort(F.collect_list(F.struct("id", entry.alias("entry")))).alias("_rows"),
        F.max("next_cursor").alias("_next"),
    )
    listed = F.array_join(F.transform("_rows", lambda row: row["entry"]), ",")
    return gathered.select(
        *COLLECTION,
        F.concat(
            F.lit('{"records":['), listed, F.lit('],"next_cursor":'),
            F.coalesce(_text(F.col("_next")), F.lit("null")), F.lit("}"),
        ).alias("body"),
    )


def answers(results: DataFrame, rejects: DataFrame) -> DataFrame:
    """What the sender of each operation, or of each refused batch, is told, as JSON.

    ``results`` comes from ``Applied.results()``. Operations: batch_id, ord, status 200 and the
    outcome with what was dropped. Refused batches: the position that refused it, status and error.
    """
    told = F.struct(
        F.col("id"), F.col("op"), F.col("outcome"), F.col("seq"),
        F.transform(
            F.filter(F.coalesce("dropped", F.array()), lambda d: d.isNotNull()),
            lambda d: F.struct(d["path"].alias("path"), d["reason"].alias("reason"), d["expected"].alias("expected"), d["found"].alias("found")),
        ).alias("dropped"),
    )
    done = results.select("batch_id", "ord", F.lit(200).alias("status"), F.to_json(told).alias("body"))
    error = F.struct(F.struct("code", "message").alias("error"))
    refused = rejects.select("batch_id", "ord", "status", F.to_json(error).alias("body"))
    return done.unionByName(refused)
