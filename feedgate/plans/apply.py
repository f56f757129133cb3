"""The ingest job: operations in, record table and reports out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgate.limits import EMPTY_DOCUMENT, EMPTY_DOCUMENT_HASH, MAX_BATCH_OPS, MAX_PAYLOAD_BYTES
from feedgate.operators import gates, merge
from feedgate.operators.indexing import with_index_columns
from feedgate.operators.numbering import assign_sequence, number_rows
from feedgate.operators.release import release
from feedgate.sources.scratch import save
from feedgate.spec import SpecSet

OPS = (
    "batch_id string, batch_seq long, ord int, source string, collection string, op string, "
    "id string, payload string, arrived_at timestamp"
)
RECORD = (
    "source string, collection string, id string, seq long, payload string, "
    "content_hash string, payload_bytes int, ingested_at timestamp, deleted_at timestamp"
)


def empty_records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def judge(
    ops: DataFrame,
    specs: SpecSet,
    credentials: DataFrame | None = None,
    max_payload_bytes: int = MAX_PAYLOAD_BYTES,
) -> DataFrame:
    """Released operations with ``record_id`` and ``code``; no exchange."""
    if credentials is not None:
        ops = gates.attribute_source(ops, credentials)
    return gates.envelope_gate(release(ops, specs), specs, max_payload_bytes)


@dataclass(frozen=True)
class Applied:
    """Everything a run produces."""

    before: DataFrame | None
    """The record table the run began with."""
    changes: DataFrame
    """The rows written by this run, one per changed key: its part of the change feed."""
    outcomes: DataFrame
    """batch_id, ord, source, collection, id, op, outcome, seq for every accepted operation."""
    rejects: DataFrame
    """One row per refused batch."""
    staged: DataFrame
    """Every operation as judged, with its drop report."""

    @cached_property
    def records(self) -> DataFrame:
        """The record table afterwards; nothing is done for it unless it is asked for."""
        return self.changes if self.before is None else merge.merge_records(self.before, self.changes)

    def results(self) -> DataFrame:
        """What a sender is told: outcomes together with the fields that were dropped."""
        reports = self.staged.select("batch_id", "ord", "dropped")
        return self.outcomes.join(reports, ["batch_id", "ord"], "left")


def apply_ops(
    records: DataFrame | None,
    ops: DataFrame,
    specs: SpecSet,
    credentials: DataFrame | None = None,
    *,
    start: int | None = None,
    max_batch_ops: int = MAX_BATCH_OPS,
    max_payload_bytes: int = MAX_PAYLOAD_BYTES,
    hot_threshold: int = merge.HOT_KEY_OPS,
) -> Applied:
    """Judge, release, hash and merge operations into a record table.

    ``batch_seq`` orders batches, ``batch_id`` those of one number; ``ord`` orders the operations
    of one batch. An operation without any of them refuses its batch. Two intermediate tables are written: the judged operations, read once for
    their short columns and once for the payloads that win, and the numbered outcomes. Beside them, tables
    of short rows: refused batches, marked places, and the operations that win.
    ``start`` is the highest position used so far, looked up in ``records`` if not given.
    """
    staged = save(judge(ops, specs, credentials, max_payload_bytes), "staged")
    rejects = gates.sized(gates.batch_verdicts(staged, max_batch_ops), "rejects")
    accepted = gates.accept_batches(staged, rejects).select(
        "source",
        "collection",
        F.col("record_id").alias("id"),
        "batch_id",
        "batch_seq",
        "ord",
        "op",
        F.when(F.col("op") == "upsert", merge.packed(F.col("content_hash"))).alias("content_hash"),
    )
    outcomes = merge.detect_outcomes(accepted, records, hot_threshold=hot_threshold, mark_last=True)
    if start is None:
        start = 0 if records is None else records.agg(F.max("seq")).first()[0] or 0
    numbered = assign_sequence(outcomes.drop("content_hash"), start)
    changes = with_index_columns(merge.changed_records(numbered, staged), specs)
    return Applied(records, changes, numbered.drop("_last"), rejects, staged)


@dataclass(frozen=True)
class Reprojected:
    """A record table released once more."""

    before: DataFrame
    changes: DataFrame
    """Rows written again: narrower documents, and tombstones of what could not be released."""
    outcomes: DataFrame
    """source, collection, id, outcome, code, seq of every live row of a declared collection."""
    undeclared: DataFrame
    """source, collection, rows: live rows that no specification covers."""

    @cached_property
    def records(self) -> DataFrame:
        return merge.merge_records(self.before, self.changes)

    def withheld(self) -> DataFrame:
        """Rows that could not be released, with the code that says why."""
        return self.outcomes.filter(F.col("code").isNotNull())


def reproject(
    records: DataFrame,
    specs: SpecSet,
    *,
    start: int | None = None,
    withhold_undeclared: bool = False,
) -> Reprojected:
    """Stored live rows released once more, after specifications have become narrower.

    Rows that lose something are written again at new positions, in the order of their old ones; the
    others stay as they are, so running it twice changes nothing the second time. Every row is judged by
    itself: one that can no longer be released, whatever the reason, is withheld as a tombstone and never
    kept as it was, and has no effect on others. Size is no reason: a row only gets smaller. Rows of collections that ``specs`` does not name are
    reported and left alone, or withheld too. The rows' own digests tell what has changed, so nothing is
    joined or grouped. Earlier commits of a table hold the wider rows until they are expired.
    """
    declared = F.col("collection").isin(list(specs))
    alive = records.filter(F.col("deleted_at").isNull())
    ops = alive.select(
        *merge.KEY, F.lit("upsert").alias("op"), "payload",
        F.col("seq").alias("_seq"), F.col("content_hash").alias("_before"), F.col("ingested_at").alias("_since"),
    )
    judged = judge(ops if withhold_undeclared else ops.filter(declared), specs, max_payload_bytes=2**31 - 1)
    refused = F.col("code").isNotNull()
    outcome = F.when(refused, "tombstoned").when(F.col("content_hash") == F.col("_before"), "unchanged").otherwise("stored")
    columns = (*merge.KEY, "payload", "content_hash", "payload_bytes", "code", "_seq", "_since")
    staged = save(judged.withColumn("outcome", outcome).select(*columns, "outcome"), "reprojected")
    if start is None:
        start = records.agg(F.max("seq")).first()[0] or 0
    # Numbered together with their documents, rows need no join to meet their positions.
    moved = number_rows(staged.filter(F.col("outcome") != "unchanged"), [F.col("_seq").asc()], "_number", "reprojected-places")
    moved = moved.withColumn("seq", (F.col("_number") + start).cast("long"))
    short = [*merge.KEY, "outcome", "code"]
    stayed = staged.filter(F.col("outcome") == "unchanged").select(*short, F.lit(None).cast("long").alias("seq"))
    outcomes = stayed.unionByName(moved.select(*short, "seq"))
    gone = F.col("outcome") == "tombstoned"
    changes = moved.select(
        *merge.KEY,
        "seq",
        F.when(gone, EMPTY_DOCUMENT).otherwise(F.col("payload")).alias("payload"),
        F.when(gone, EMPTY_DOCUMENT_HASH).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(gone, len(EMPTY_DOCUMENT)).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.col("_since").alias("ingested_at"),
        F.when(gone, F.coalesce("_since", F.current_timestamp())).alias("deleted_at"),
    )
    undeclared = alive.filter(F.coalesce(~declared, F.lit(True))).groupBy("source", "collection").agg(F.count(F.lit(1)).alias("rows"))
    return Reprojected(records, with_index_columns(changes, specs), outcomes, undeclared)
