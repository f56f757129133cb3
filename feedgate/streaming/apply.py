"""Applying a stream of operations to a record table."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedgate.operators.counters import OutcomeCounter
from feedgate.operators.gates import sized
from feedgate.plans.apply import apply_ops
from feedgate.sources.scratch import save, scoped
from feedgate.sources.table import LEASE_SECONDS, Expired, RecordTable

#: How long operations wait for the rest of their batch.
PATIENCE_SECONDS = 3600.0

_SINCE = "_since"
WAITING = "waiting"


def split_whole(ops: DataFrame, now: float, patience: float) -> tuple[DataFrame, DataFrame]:
    """Operations of batches that can be judged, and those that wait for the rest of their batch.

    ``ops`` declare in ``batch_ops`` how many operations their batch has, and say ``_since`` when they
    came. A batch is whole when that many are there. One that has waited too long, whose operations
    disagree about the number, of which there are more, or that declares none, is judged as it is and marked, so
    that all of it is refused. Sizes are counted on short rows; payloads are moved by their file and filtered.
    """
    count, least, most = F.count(F.lit(1)), F.min("batch_ops"), F.max("batch_ops")
    sizes = ops.groupBy("batch_id").agg(
        count.alias("n"), least.alias("least"), most.alias("most"), F.count("batch_ops").alias("declared"), F.min(_SINCE).alias("since")
    )
    n, agreed = F.col("n"), (F.col("declared") == F.col("n")) & (F.col("least") == F.col("most"))
    verdict = (
        F.when(F.col("batch_id").isNull(), "whole")  # refused for want of a name
        .when(F.col("declared") == 0, "incomplete_batch")
        .when(~agreed | (n > F.col("most")), "invalid_body")
        .when(n == F.col("most"), "whole")
        .when(F.col("since") <= now - patience, "incomplete_batch")
        .otherwise("waits")
    )
    judged = sized(sizes.select(F.col("batch_id").alias("_batch"), verdict.alias("_verdict")), "batches")
    joined = ops.join(judged, F.col("batch_id").eqNullSafe(F.col("_batch"))).drop("_batch")
    error = F.coalesce("envelope_error", F.when(F.col("_verdict") != "whole", F.col("_verdict")))
    ready = joined.filter(F.col("_verdict") != "waits").withColumn("envelope_error", error)
    return ready.drop("_verdict", _SINCE, "batch_ops"), joined.filter(F.col("_verdict") == "waits").drop("_verdict")


def apply_stream(
    ops: DataFrame,
    table: RecordTable,
    checkpoint: str,
    credentials: DataFrame | None = None,
    *,
    available_now: bool = True,
    on_applied=None,
    patience_seconds: float = PATIENCE_SECONDS,
    files_are_batches: bool = False,
) -> StreamingQuery:
    """Run the ingest job on every micro-batch and commit what it changes.

    A commit carries the stream's own id, from its checkpoint, and the micro-batch's number: one that
    is replayed after a failure finds its commit and is skipped, and other streams or earlier batches
    on the same table are never mistaken for it. The rejects and results of a micro-batch are part of
    its commit (``table.reports``), so they survive whatever happens after it, and so are the outcomes by
    collection, counted as the results are written (``table.outcome_totals``); ``on_applied`` is a
    convenience on top. Compaction is left to a job of its own.

    Batches are all or nothing, however they arrive. Each operation declares the number of operations of
    its batch; those of a batch that is not whole yet wait in the commit of their micro-batch, from where
    the next one takes them, and are neither judged nor stored. After ``patience_seconds`` they are refused
    as ``incomplete_batch``, as are batches that declare no number. A batch takes effect when it becomes
    whole. With ``files_are_batches`` the caller states that no batch spans two files instead; then
    numbers are not looked at, nothing waits, and a batch that does span files is judged piece by piece.

    Only collections that the micro-batch names are read, and what a step writes in between is removed
    at its end.
    """
    spark = table.spark
    names: list[str] = []

    def stream_id() -> str:
        if not names:
            [line] = spark.read.text(f"{checkpoint}/metadata").head(1)
            names.append(json.loads(line[0])["id"])
        return names[0]

    def step(batch: DataFrame, number: int) -> None:
        stream = stream_id()
        if table.committed(stream, number) is not None:
            return
        with scoped(spark):
            waits = None
            if files_are_batches:
                ready = batch.drop("batch_ops")
            else:
                now = time.time()
                arrived = batch.withColumn(_SINCE, F.lit(now))
                before = table.last_report(stream, WAITING)
                if before is not None:
                    arrived = before.select(arrived.columns).unionByName(arrived)
                ready, waits = split_whole(save(arrived, "arrived"), now, patience_seconds)
            met = ready.select("collection").distinct()
            met = [row[0] for row in met.filter(met.collection.isin(list(table.specs))).collect()]
            applied = apply_ops(
                table.read(collections=met), ready, table.specs, credentials, start=table.max_seq()
            )
            counter = OutcomeCounter(met)
            reports = {"rejects": applied.rejects, "results": counter.watch(applied.results())}
            if waits is not None and not waits.isEmpty():
                reports[WAITING] = waits
            commit = table.commit(applied.changes, batch=(stream, number), reports=reports, counter=counter)
            if on_applied is not None:
                on_applied(applied, commit)

    if "batch_ops" not in ops.columns and not files_are_batches:
        ops = ops.withColumn("batch_ops", F.lit(None).cast("int"))
    if "envelope_error" not in ops.columns:
        ops = ops.withColumn("envelope_error", F.lit(None).cast("string"))
    writer = ops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def feed_stream(
    table: RecordTable,
    files_per_trigger: int | None = None,
    *,
    after_seq: int = 0,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """The change feed as a stream: every commit's rows above a position, as they are appended to the log.

    A commit is moved into the log as a whole, so none is seen half written. The position is where a new
    consumer begins; from then on its streaming checkpoint plays the part of its cursor. A position whose
    commits have been removed in part raises, and files or bytes limit what a micro-batch takes.
    """
    gone = table.expired()
    if gone and after_seq < table.seq_of(gone):
        raise Expired(f"positions up to {table.seq_of(gone)} have been removed, the feed cannot go on after {after_seq}")
    reader = table.spark.readStream.schema(table.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    rows = reader.parquet(f"{table.path}/log/commit=*")
    return rows.filter(F.col("seq") > after_seq) if after_seq else rows


def follow_feed(
    table: RecordTable,
    consumer: str,
    checkpoint: str,
    step: Callable[[DataFrame, int], None],
    *,
    after_seq: int = 0,
    files_per_trigger: int | None = None,
    lease_seconds: float = LEASE_SECONDS,
    available_now: bool = True,
) -> StreamingQuery:
    """Give a consumer the feed in micro-batches, and keep its place in the table's register.

    After each step the consumer is registered with the last commit it has read to the end, so that what
    it has yet to read is neither expired nor purged while its lease runs. A consumer that comes back after
    its lease, when commits it has not read are gone, gets :class:`Expired`, not a feed with a gap.
    ``step`` may see a micro-batch again after a failure, with the same number.
    """
    known = table.consumers().get(consumer)
    if known is None:
        rows = feed_stream(table, files_per_trigger, after_seq=after_seq)
        table.register(consumer, table.expired(), lease_seconds)
    else:
        if known.commit < table.expired():
            raise Expired(f"commits up to {table.expired()} have been removed, {consumer} had read {known.commit}")
        rows = feed_stream(table, files_per_trigger, after_seq=max(after_seq, table.seq_of(table.expired())))
    place = F.regexp_extract("_metadata.file_path", r"/commit=(\d+)/", 1).cast("long")
    placed = rows.select("*", place.alias("_commit"))

    def read(batch: DataFrame, number: int) -> None:
        step(batch.drop("_commit"), number)
        # Files come in the order of their commits; of the last one there may be more to come.
        last = batch.agg(F.max("_commit")).first()[0]
        if last is not None:
            done = max(last - 1, table.consumers()[consumer].commit)
            table.register(consumer, done, lease_seconds)

    writer = placed.writeStream.foreachBatch(read).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
