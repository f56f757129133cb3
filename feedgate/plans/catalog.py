"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgate.operators import (
    counters,
    freshness,
    gates,
    integrity,
    merge,
    positions,
    reads,
    replica,
    shapes,
    summary,
    tree,
    walk,
)
from feedgate.operators.numbering import assign_sequence
from feedgate.operators.release import coverage, dropped_fields, fingerprint, release
from feedgate.plans import inputs
from feedgate.plans.apply import apply_ops, judge, reproject
from feedgate.plans.backfill import RawZone
from feedgate.plans.backfill import backfill as backfilled
from feedgate.plans.inputs import only
from feedgate.sources import envelopes
from feedgate.sources.scratch import new_path, save
from feedgate.sources.table import Expired, RecordTable
from feedgate.streaming import outcomes
from feedgate.streaming.apply import apply_stream, feed_stream, follow_feed

Query = Callable[[SparkSession, str], DataFrame]

PRODUCT, ACTIVITY = only("part.sheet"), only("user.activity")
ORDERS, TEXTS = only("sales.order"), only(*inputs.TEXTS)
LINES, VECTORS = only("text.lines"), only("vector")

FEED_COLUMNS = ["source", "collection", "id", "seq", "payload", "content_hash", "payload_bytes"]


# ---------------------------------------------------------------- sources and sinks


def envelope_read(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "lines")
    envelopes.write_lines(inputs.event_ops(spark, folder), path)
    ops = envelopes.read_lines(spark, path)
    return ops.select("batch_id", "batch_seq", "ord", "source", "collection", "op", "id", "payload", "envelope_error")


def envelope_stream(spark: SparkSession, folder: str) -> DataFrame:
    path, out = new_path(spark, "lines"), new_path(spark, "stream")
    envelopes.write_lines(inputs.event_ops(spark, folder), path)
    stream = envelopes.stream_lines(spark, path)
    writer = stream.writeStream.format("parquet").option("path", f"{out}/rows")
    writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    ops = spark.read.parquet(f"{out}/rows")
    return ops.select("batch_id", "batch_seq", "ord", "source", "collection", "op", "id", "payload", "envelope_error")


def record_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    kept = RecordTable(spark, new_path(spark, "table"), PRODUCT)
    kept.commit(apply_ops(None, inputs.part_ops(spark, folder), PRODUCT, start=0).changes)
    kept.compact()
    return kept.read().select(*FEED_COLUMNS, "idx_string_brand", "idx_number_size")


# ---------------------------------------------------------------- gates


def identifier_gate(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.table(spark, folder, "pages").select(F.col("url").alias("value"))
    parts = inputs.table(spark, folder, "part").select(F.col("p_name").alias("value"))
    docs = inputs.table(spark, folder, "documents").select(F.col("text").alias("value"))
    values = pages.unionByName(parts).unionByName(docs)
    as_id = gates.identifier_gate(values, "value", "id").withColumn("grammar", F.lit("id"))
    as_name = gates.identifier_gate(values, "value", "name").withColumn("grammar", F.lit("name"))
    both = as_id.unionByName(as_name)
    return both.select("grammar", F.sha2("value", 256).alias("value_hash"), "ident_error")


def collection_gate(spark: SparkSession, folder: str) -> DataFrame:
    ops = inputs.document_ops(spark, folder).select("source", "collection", "id")
    known, unknown = gates.collection_gate(ops, only("text.en", "text.de"))
    return known.withColumn("code", F.lit(None).cast("string")).unionByName(unknown)


def envelope_gate(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(inputs.mixed_ops(spark, folder), ACTIVITY)
    return judged.select("batch_id", "ord", "op", "record_id", "code")


def record_id_extraction(spark: SparkSession, folder: str) -> DataFrame:
    released = release(inputs.keyed_docs(spark, folder), ACTIVITY)
    return released.select("batch_id", "ord", "doc_id")


def payload_size_gate(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(inputs.document_ops(spark, folder), TEXTS, max_payload_bytes=8192)
    return judged.select("id", "payload_bytes", "code")


def source_attribution(spark: SparkSession, folder: str) -> DataFrame:
    supplier = inputs.table(spark, folder, "supplier")
    credentials = supplier.select(
        F.sha2("s_name", 256).alias("token_hash"),
        F.concat(F.lit("supplier-"), F.col("s_suppkey")).alias("source"),
        F.when(F.col("s_acctbal") < 0, F.lit("2024-01-01")).cast("timestamp").alias("revoked_at"),
    )
    name = F.format_string("Supplier#%09d", F.col("l_suppkey"))
    ops = inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.sha2(name, 256).alias("token_hash"), F.lit("forged").alias("source"),
    )
    return gates.attribute_source(ops, credentials)


def atomic_batch_gate(spark: SparkSession, folder: str) -> DataFrame:
    ops = inputs.document_ops(spark, folder).withColumns(
        {"batch_id": F.col("source"), "ord": F.col("batch_seq").cast("int")}
    )
    judged = save(judge(ops, TEXTS, max_payload_bytes=10_000), "judged")
    return gates.batch_verdicts(judged, max_ops=52).select("batch_id", "ord", "status", "code")


def digest_gate(spark: SparkSession, folder: str) -> DataFrame:
    digest = F.upper(F.sha2("text", 256))
    sent = inputs.table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "de", F.substring(digest, 2, 70))
        .when(F.col("lang") == "fr", F.concat(F.lit("Z"), F.substring(digest, 2, 70)))
        .otherwise(digest)
        .alias("content_hash"),
    )
    usable, malformed = gates.digest_gate(sent)
    return usable.withColumn("digest_error", F.lit(None).cast("string")).unionByName(malformed)


# ---------------------------------------------------------------- projection and hashing


def release_projection(spark: SparkSession, folder: str) -> DataFrame:
    released = release(inputs.part_ops(spark, folder), PRODUCT)
    return released.select("doc_id", "payload", "content_hash", "payload_bytes")


def dropped_report(spark: SparkSession, folder: str) -> DataFrame:
    parts = release(inputs.part_ops(spark, folder), PRODUCT)
    return dropped_fields(parts, "source", "collection", "doc_id")


def nested_release(spark: SparkSession, folder: str) -> DataFrame:
    released = release(inputs.line_documents(spark, folder), LINES)
    return released.select("doc_id", "payload", "content_hash", F.size("dropped").alias("n_dropped"))


def nested_dropped_report(spark: SparkSession, folder: str) -> DataFrame:
    return dropped_fields(release(inputs.line_documents(spark, folder), LINES), "doc_id")


def field_coverage(spark: SparkSession, folder: str) -> DataFrame:
    parts = release(inputs.part_ops(spark, folder), PRODUCT)
    orders = release(inputs.order_ops(spark, folder), ORDERS)
    return coverage(parts).unionByName(coverage(orders))


def content_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    documents = inputs.document_ops(spark, folder).select("id", "payload")
    return fingerprint(documents)


def exact_numbers(spark: SparkSession, folder: str) -> DataFrame:
    released = release(inputs.vector_docs(spark, folder), VECTORS)
    return released.select("doc_id", "payload", "content_hash")


# ---------------------------------------------------------------- change capture


def _applied_events(spark: SparkSession, folder: str):
    return apply_ops(None, inputs.event_ops(spark, folder), ACTIVITY)


def _event_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    judged = save(judge(inputs.event_ops(spark, folder), ACTIVITY), "judged")
    ops = judged.select(
        "source", "collection", F.col("record_id").alias("id"), "batch_id", "batch_seq", "ord", "op",
        F.when(F.col("op") == "upsert", F.col("content_hash")).alias("content_hash"),
    )
    return merge.detect_outcomes(ops)


def outcome_detection(spark: SparkSession, folder: str) -> DataFrame:
    return _event_outcomes(spark, folder).select("batch_id", "ord", "id", "op", "outcome")


def sequence_assignment(spark: SparkSession, folder: str) -> DataFrame:
    numbered = assign_sequence(_event_outcomes(spark, folder), 1000)
    return numbered.select("batch_id", "ord", "outcome", "seq")


def idempotent_upsert(spark: SparkSession, folder: str) -> DataFrame:
    before = inputs.records(spark, folder, "order")
    after = apply_ops(before, inputs.order_ops(spark, folder, run=2), ORDERS)
    return after.records.select(*FEED_COLUMNS)


def tombstone_delete(spark: SparkSession, folder: str) -> DataFrame:
    after = _applied_events(spark, folder).records
    dead = after.filter(F.col("deleted_at").isNotNull())
    return dead.select(*FEED_COLUMNS)


def apply_batch(spark: SparkSession, folder: str) -> DataFrame:
    after = _applied_events(spark, folder).records
    return after.select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"))


def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.records(spark, folder, "line").select(*FEED_COLUMNS, "idx_number_part")


def _event_table(spark: SparkSession, folder: str) -> RecordTable:
    """The events applied as a stream of line files."""
    path = new_path(spark, "lines")
    envelopes.write_lines(inputs.event_ops(spark, folder), path)
    kept = RecordTable(spark, new_path(spark, "table"), ACTIVITY)
    stream = envelopes.stream_lines(spark, path)
    apply_stream(stream, kept, new_path(spark, "state")).awaitTermination()
    return kept


def stream_onto_table(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the events as a batch commit, the rest as three micro-batches and a restart that finds nothing."""
    ops = inputs.event_ops(spark, folder)
    last = ops.agg(F.max("batch_seq")).first()[0]
    kept = RecordTable(spark, new_path(spark, "table"), ACTIVITY)
    part = F.floor(F.col("batch_seq") * 6 / (last + 1))
    kept.commit(apply_ops(None, ops.filter(part < 3), ACTIVITY, start=0).changes)
    path, state = new_path(spark, "lines"), new_path(spark, "state")
    for number in (3, 4, 5, 6):
        if number < 6:
            envelopes.write_lines(ops.filter(part == number), path)
        apply_stream(envelopes.stream_lines(spark, path), kept, state).awaitTermination()
    kept.compact()
    return kept.read().select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"))


#: Of these batches, by number modulo seven, one piece never arrives; others come whole with the first pieces.
LOST, AT_ONCE = 3, 5


def split_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches whose thirds arrive in three micro-batches, some at once and some never whole; a fourth gives up on those."""
    ops = inputs.event_ops(spark, folder)
    kind, third = F.col("batch_seq") % 7, F.col("ord") % 3
    turn = F.when(kind == AT_ONCE, 0).otherwise(third)
    counts = ops.groupBy("batch_id").agg(F.count(F.lit(1)).cast("int").alias("batch_ops"))
    pieces = save(ops.join(counts, "batch_id").withColumn("turn", turn), "pieces")
    pieces = pieces.filter((F.col("turn") < 2) | (kind != LOST))
    late = ops.limit(1).withColumns({"batch_id": F.lit("late"), "batch_seq": F.lit(-1).cast("long"), "batch_ops": F.lit(2)})
    kept = RecordTable(spark, new_path(spark, "table"), ACTIVITY)
    path, state = new_path(spark, "lines"), new_path(spark, "state")
    for number in range(4):
        envelopes.write_lines(pieces.filter(F.col("turn") == number).drop("turn") if number < 3 else late, path)
        patience = 3600.0 if number < 3 else 0.0
        apply_stream(envelopes.stream_lines(spark, path), kept, state, patience_seconds=patience).awaitTermination()
    empty = {"batch_id": F.lit(None).cast("string"), "code": F.lit(None).cast("string")}
    rows = kept.read().select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted")).withColumns(empty)
    refused = kept.reports("rejects").select("batch_id", "code")
    return rows.unionByName(refused.filter("batch_id <> 'late'"), allowMissingColumns=True)


def stateful_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the events as a snapshot, the rest through state kept in the stream, in three runs and one without news."""
    ops = inputs.event_ops(spark, folder)
    last = ops.agg(F.max("batch_seq")).first()[0]
    part = F.floor(F.col("batch_seq") * 6 / (last + 1))
    before = judge(ops.filter(part < 3), ACTIVITY)
    first = merge.detect_outcomes(outcomes.accepted_upserts(before))
    base = save(apply_ops(None, ops.filter(part < 3), ACTIVITY, start=0).records, "base")
    path, out = new_path(spark, "lines"), new_path(spark, "outcomes")
    key, provider = outcomes.STORE
    setting = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        for number in (3, 4, 5, 6):
            if number < 6:
                envelopes.write_lines(ops.filter(part == number), path)
            accepted = outcomes.accepted_upserts(judge(envelopes.stream_lines(spark, path), ACTIVITY))
            writer = outcomes.stream_outcomes(accepted, base).writeStream.format("parquet").option("path", f"{out}/rows")
            writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if setting is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, setting)
    columns = ["batch_id", "ord", "id", "op", "outcome"]
    return first.select(*columns).unionByName(spark.read.parquet(f"{out}/rows").select(*columns))


def _event_commits(spark: SparkSession, folder: str, parts: int) -> RecordTable:
    """The events as so many commits."""
    ops = inputs.event_ops(spark, folder)
    last = ops.agg(F.max("batch_seq")).first()[0]
    kept = RecordTable(spark, new_path(spark, "table"), ACTIVITY)
    part = F.floor(F.col("batch_seq") * parts / (last + 1))
    for number in range(parts):
        applied = apply_ops(kept.read(), ops.filter(part == number), ACTIVITY, start=kept.max_seq())
        kept.commit(applied.changes)
    return kept


def read_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of a table after its log has been compacted and expired: those left are whole, the others refuse."""
    kept = _event_commits(spark, folder, 3)
    kept.compact()
    kept.commit(apply_ops(kept.read(), inputs.event_ops(spark, folder).limit(0), ACTIVITY, start=kept.max_seq()).changes)
    kept.compact()
    kept.expire(keep_bases=2, keep_commits=1)
    found = []
    for version in (1, 2, 3, 4):
        try:
            rows = kept.read(upto=version).select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"))
        except Expired:
            rows = spark.range(1).select(F.lit("expired").alias("source"))
        found.append(rows.withColumn("version", F.lit(version)))
    whole = found[-1]
    for rows in found[:-1]:
        whole = whole.unionByName(rows, allowMissingColumns=True)
    return whole


def purge_after_lag(spark: SparkSession, folder: str) -> DataFrame:
    """Deletions that a consumer three quarters through has read are gone from the table, later ones are there."""
    kept = _event_commits(spark, folder, 4)
    kept.register("quick", 4)
    kept.register("slow", 3)
    kept.purge_tombstones()
    return kept.read().select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"))


def faulty_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of lines of which every fifth lacks places, repeats one, or lacks its own name."""
    path = new_path(spark, "lines")
    batch, at = F.col("batch_seq") % 5, F.col("ord")
    ops = inputs.event_ops(spark, folder)
    ops = ops.withColumns(
        {
            "ord": F.when((batch == 1) & (at == 7), None).when((batch == 2) & (at == 8), 7).otherwise(at).cast("int"),
            "batch_id": F.when(~((batch == 3) & (at == 9)), F.col("batch_id")),
        }
    )
    envelopes.write_lines(ops, path)
    applied = apply_ops(None, envelopes.read_lines(spark, path), ACTIVITY)
    refused = applied.rejects.select("batch_id", "ord", "code", F.lit(0).cast("long").alias("done"))
    done = applied.outcomes.groupBy("batch_id").agg(F.count("*").alias("done"))
    none = {"ord": F.lit(None).cast("int"), "code": F.lit(None).cast("string")}
    return refused.unionByName(done.withColumns(none))


def batch_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of two collections, of which some are no list, have a stray key, trailing text, or are too large."""
    path = inputs.batch_files(spark, folder)
    specs = only("part.sheet", "sales.order")
    ops = envelopes.read_batches(spark, f"{path}/*/*/part-*", source="erp", max_body_bytes=inputs.BODY_BYTES)
    applied = apply_ops(None, ops, specs)
    place = r"/collection=([^/]+)/batch_seq=(\d+)/"
    name = F.concat_ws("/", F.regexp_extract("batch_id", place, 1), F.regexp_extract("batch_id", place, 2)).alias("file")
    refused = applied.rejects.select(name, "code", F.lit(0).cast("long").alias("stored"))
    stored = applied.outcomes.filter("outcome = 'stored'").groupBy("batch_id").agg(F.count("*").alias("stored"))
    return refused.unionByName(stored.select(name, F.lit(None).cast("string").alias("code"), "stored"))


def ingest_answers(spark: SparkSession, folder: str) -> DataFrame:
    applied = _applied_events(spark, folder)
    return shapes.answers(applied.results(), applied.rejects).select("batch_id", "ord", "status", "body")


def streaming_apply(spark: SparkSession, folder: str) -> DataFrame:
    rows = _event_table(spark, folder).read()
    return rows.select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"))


def integrity_check(spark: SparkSession, folder: str) -> DataFrame:
    """A record table as an unchecked import would make it, with its faults counted."""
    lines = inputs.table(spark, folder, "lineitem").select(
        F.lit("erp").alias("source"), F.lit("sales.line").alias("collection"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        (F.col("l_partkey") - 1).alias("seq"), F.col("l_returnflag").alias("payload"),
        F.sha2("l_returnflag", 256).alias("content_hash"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).cast("timestamp").alias("deleted_at"),
    )
    pages = inputs.table(spark, folder, "pages").select(
        F.lit("Web").alias("source"), F.lit("page").alias("collection"), F.col("url").alias("id"),
        (F.col("page_id") + 10_000_000).alias("seq"), F.lit("{}").alias("payload"),
        F.md5("html").alias("content_hash"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return integrity.integrity_report(lines.unionByName(pages))


# ---------------------------------------------------------------- reads


def stored_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Records as they are stored, deleted ones as tombstones."""
    keys = inputs.table(spark, folder, "customer").select(
        F.lit("app").alias("source"), F.lit("user.activity").alias("collection"),
        F.col("c_custkey").cast("string").alias("id"),
    )
    found = reads.lookup_many(inputs.records(spark, folder, "event"), keys, served=False)
    return found.select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"))


def keyed_lookup(spark: SparkSession, folder: str) -> DataFrame:
    keys = inputs.table(spark, folder, "customer").select(
        F.lit("app").alias("source"), F.lit("user.activity").alias("collection"),
        F.col("c_custkey").cast("string").alias("id"),
    )
    return reads.lookup_many(inputs.records(spark, folder, "event"), keys).select(*FEED_COLUMNS)


def declared_filter(spark: SparkSession, folder: str) -> DataFrame:
    spec = PRODUCT["part.sheet"]
    chosen = reads.parse_filter(spec, [("brand", "Brand#2"), ("size", "11.0")])
    rows = inputs.records(spark, folder, "part")
    return rows.filter(reads.filter_column(spec, chosen, rows.columns)).select(*FEED_COLUMNS)


def filtered_listing(spark: SparkSession, folder: str) -> DataFrame:
    spec = ACTIVITY["user.activity"]
    rows = inputs.records(spark, folder, "event")
    page = reads.listing(rows, spec, "app", [("type", "view")], after=50, limit=25)
    return page.select(*FEED_COLUMNS, "next_cursor")


def sorted_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of products by brand, each page being full."""
    rows, spec = inputs.records(spark, folder, "part"), PRODUCT["part.sheet"]
    last = reads.sorted_listing(rows, spec, "erp", "brand", limit=30).agg(F.max("next_value"), F.max("next_cursor")).first()
    page = reads.sorted_listing(rows, spec, "erp", "brand", after=(last[0], last[1]), limit=30)
    return page.select(*FEED_COLUMNS, "next_value", "next_cursor")


def reprojection(spark: SparkSession, folder: str) -> DataFrame:
    """Stored orders under a specification that no longer releases their priority."""
    return reproject(inputs.records(spark, folder, "order"), inputs.NARROWER).records.select(*FEED_COLUMNS)


def reprojection_of_many(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, products and activity under narrower specifications of the first two; one product in fifty is unreadable."""
    broken = F.when((F.col("collection") == "part.sheet") & (F.col("id").cast("long") % 50 == 0), F.lit("[1]"))
    rows = inputs.records(spark, folder, "order")
    for name in ("part", "event"):
        rows = rows.unionByName(inputs.records(spark, folder, name), allowMissingColumns=True)
    rows = rows.withColumn("payload", F.coalesce(broken, "payload"))
    done = reproject(rows, inputs.NARROWER_STILL, start=10_000_000)
    why = done.withheld().select(*merge.KEY, "code")
    out = done.records.join(why, merge.KEY, "left")
    columns = [name for name in FEED_COLUMNS if name != "seq"]
    return out.select(*columns, (F.col("seq") > 10_000_000).alias("moved"), F.col("deleted_at").isNotNull().alias("deleted"), "code")


def backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Products whose grade was no text, after grades may be numbers: released again from the raw documents kept."""
    ops = inputs.part_ops(spark, folder)
    zone = RawZone(spark, new_path(spark, "zone"))
    applied = apply_ops(None, ops, PRODUCT, start=0)
    rows = save(applied.records, "records")
    zone.keep(applied, ops)
    return backfilled(rows, zone, PRODUCT, inputs.NUMBERED_GRADES).records.select(*FEED_COLUMNS)


def byte_budget_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.records(spark, folder, "document")
    page = reads.first_pages(reads.live(rows), limit=20, max_bytes=40_000)
    return page.select("source", "collection", "id", "seq", "payload_bytes", "next_cursor")


def page_walk(spark: SparkSession, folder: str) -> DataFrame:
    rows = reads.live(inputs.records(spark, folder, "document"))
    return walk.page_summary(rows, limit=10, max_bytes=30_000)


def change_feed(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.records(spark, folder, "event")
    page = reads.changes(rows, ACTIVITY["user.activity"], "app", since=100, limit=1000)
    return page.select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"), "next_cursor")


def change_feed_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page that is full, so that it offers a cursor."""
    rows = inputs.records(spark, folder, "event")
    page = reads.changes(rows, ACTIVITY["user.activity"], "app", since=10, limit=10)
    return page.select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"), "next_cursor")


def change_feed_stream(spark: SparkSession, folder: str) -> DataFrame:
    kept, out = _event_table(spark, folder), new_path(spark, "feed")
    writer = feed_stream(kept).writeStream.format("parquet").option("path", f"{out}/rows")
    writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(kept.schema).parquet(f"{out}/rows")
    return rows.select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"))


def feed_from_position(spark: SparkSession, folder: str) -> DataFrame:
    """The feed after the first of four commits, a commit per micro-batch, for a consumer that registers."""
    kept, out = _event_commits(spark, folder, 4), new_path(spark, "feed")
    begin = kept.seq_of(1)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/turn={number}")

    follow_feed(kept, "copy", f"{out}/state", store, after_seq=begin, files_per_trigger=1).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows/*")
    return rows.select(*FEED_COLUMNS, F.col("deleted_at").isNotNull().alias("deleted"))


def replica_fold(spark: SparkSession, folder: str) -> DataFrame:
    before = inputs.records(spark, folder, "order")
    after = apply_ops(before, inputs.order_ops(spark, folder, run=2), ORDERS)
    feed = before.unionByName(after.changes)
    return replica.fold_feed(None, feed).select(*FEED_COLUMNS)


def replica_catch_up(spark: SparkSession, folder: str) -> DataFrame:
    """A replica of the first orders meets a feed of changes and of deletions, part of it twice."""
    before = inputs.records(spark, folder, "order")
    moved = inputs.order_ops(spark, folder, run=2)
    gone = inputs.order_removals(spark, folder)
    feed = apply_ops(before, moved.unionByName(gone), ORDERS).changes
    again = feed.filter(F.col("seq") % 3 == 0)
    return replica.fold_feed(before, feed.unionByName(again)).select(*FEED_COLUMNS)


def max_position(spark: SparkSession, folder: str) -> DataFrame:
    both = inputs.records(spark, folder, "event").select("source", "collection", "seq").unionByName(
        inputs.records(spark, folder, "document").select("source", "collection", "seq")
    )
    return summary.max_positions(both)


def collection_checksum(spark: SparkSession, folder: str) -> DataFrame:
    return summary.collection_checksums(inputs.records(spark, folder, "document"))


def chained_checksum(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.records(spark, folder, "line")
    return summary.collection_checksums(rows)


def bucketed_checksum(spark: SparkSession, folder: str) -> DataFrame:
    """The parallel checksum of a collection: one digest over those of its buckets."""
    return summary.bucketed_checksums(summary.bucket_digests(inputs.records(spark, folder, "line"), buckets=64))


def drift_of_some(spark: SparkSession, folder: str) -> DataFrame:
    """Drift of two collections of texts, two more being skipped because their checksums agree."""
    rows = inputs.records(spark, folder, "document")
    lang = F.col("collection")
    changed = lang.isin("text.de", "text.fr") & (F.col("id").cast("long") % 10 == 0)
    theirs = summary.live(rows).withColumn("content_hash", F.when(changed, F.sha2("id", 256)).otherwise(F.col("content_hash")))
    return summary.drift_report(rows, theirs, summary.collection_checksums(theirs))


def bucket_digest(spark: SparkSession, folder: str) -> DataFrame:
    return summary.bucket_digests(inputs.records(spark, folder, "line"), buckets=64)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    events = summary.manifests(inputs.records(spark, folder, "event"))
    return events.unionByName(summary.manifests(inputs.records(spark, folder, "part")))


def digest_listing(spark: SparkSession, folder: str) -> DataFrame:
    return reads.first_digest_pages(inputs.records(spark, folder, "document"), limit=12)


def digest_listing_after(spark: SparkSession, folder: str) -> DataFrame:
    """The second digest page of every collection, as served bodies."""
    rows = inputs.records(spark, folder, "document")
    first = reads.first_digest_pages(rows, limit=3)
    cursors = first.groupBy("source", "collection").agg(F.max("next_cursor").alias("after"))
    return shapes.digest_bodies(reads.first_digest_pages(rows, limit=3, cursors=cursors.dropna()))


def manifest_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return shapes.manifest_bodies(manifest(spark, folder))


def complete_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Field coverage where some collections lose nothing."""
    mixed = inputs.mixed_ops(spark, folder).filter("payload IS NOT NULL")
    return coverage(release(mixed, ACTIVITY)).unionByName(coverage(release(inputs.event_ops(spark, folder), ACTIVITY)))


def _their_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of a sender whose urgent orders moved on and whose list is its own."""
    moved = release(inputs.order_ops(spark, folder, run=2), ORDERS)
    return moved.select(
        "source", "collection",
        F.when(F.col("payload").contains('"5-LOW"'), F.concat("doc_id", F.lit("x")))
        .otherwise(F.col("doc_id")).alias("id"),
        "content_hash",
    )


def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    return summary.drift_report(inputs.records(spark, folder, "order"), _their_orders(spark, folder))


def tree_drift(spark: SparkSession, folder: str) -> DataFrame:
    """The same drift by descending two stored trees."""
    ours = tree.Listing.write(summary.live(inputs.records(spark, folder, "order")), new_path(spark, "ours"))
    theirs = tree.Listing.write(_their_orders(spark, folder), new_path(spark, "theirs"))
    return tree.tree_drift(ours, theirs)


def position_bitmaps(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of an unchecked import that occur in several rows, or in none, by bitmaps per commit."""
    lines = inputs.table(spark, folder, "lineitem").select((F.col("l_partkey") * 3 + 1).alias("seq"), F.col("l_linenumber").alias("commit"))
    kept = save(positions.position_bitmaps(lines, F.col("commit")), "bitmaps")
    highest = lines.agg(F.max("seq")).first()[0]
    twice = positions.repeated(kept, lines).withColumn("fault", F.lit("repeated"))
    never = positions.gaps(kept, highest).select("seq", F.lit(0).cast("long").alias("rows"), F.lit("missing").alias("fault"))
    return twice.unionByName(never)


def freshness_check(spark: SparkSession, folder: str) -> DataFrame:
    """Consumers of every collection, some of which hold the current validator."""
    now = freshness.collection_validators(inputs.records(spark, folder, "document"), limit=50)
    current = now.select("source", "collection", F.col("listing").alias("validator"), "max_seq")
    held = current.select(
        "source", "collection",
        F.when(F.col("collection") == "text.en", F.concat(F.lit('"m.1", W/'), F.col("validator")))
        .when(F.col("collection") == "text.de", F.lit("*"))
        .otherwise(F.concat(F.lit('"l.'), F.col("max_seq") - 1, F.lit('.0.50"'))).alias("held"),
    )
    return freshness.stale_views(held, current.drop("max_seq"))


def served_changes(spark: SparkSession, folder: str) -> DataFrame:
    served = shapes.served_changes(inputs.records(spark, folder, "event"))
    return served.withColumn("body", shapes.body(served, change=True))


def served_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = inputs.records(spark, folder, "document")
    page = reads.first_pages(reads.live(rows), limit=5)
    return shapes.page_bodies(page, rows)


# ---------------------------------------------------------------- counters


def dropped_totals(spark: SparkSession, folder: str) -> DataFrame:
    ops = inputs.line_documents(spark, folder)
    by_source = {"batch_id": F.col("source"), "ord": F.col("batch_seq").cast("int")}
    judged = judge(ops.withColumns(by_source), LINES, max_payload_bytes=20_000)
    judged = save(judged.select("batch_id", "ord", "collection", "code", "dropped"), "judged")
    refused = gates.batch_verdicts(judged)
    parts = judge(inputs.part_ops(spark, folder), PRODUCT)
    return counters.dropped_totals(judged, refused).unionByName(counters.dropped_totals(parts))


def committed_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of the events by collection, as four micro-batches counted them while they were committed."""
    ops = inputs.event_ops(spark, folder)
    last = ops.agg(F.max("batch_seq")).first()[0]
    counts = ops.groupBy("batch_id").agg(F.count(F.lit(1)).cast("int").alias("batch_ops"))
    ops = save(ops.join(counts, "batch_id").withColumn("turn", F.floor(F.col("batch_seq") * 4 / (last + 1))), "turns")
    kept = RecordTable(spark, new_path(spark, "table"), ACTIVITY)
    path, state = new_path(spark, "lines"), new_path(spark, "state")
    for number in range(4):
        envelopes.write_lines(ops.filter(F.col("turn") == number).drop("turn"), path)
        apply_stream(envelopes.stream_lines(spark, path), kept, state).awaitTermination()
    return kept.outcome_totals().groupBy("collection", "outcome").agg(F.sum("total").alias("total"))


def outcome_totals(spark: SparkSession, folder: str) -> DataFrame:
    return counters.outcome_totals(_event_outcomes(spark, folder))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        envelope_read, envelope_stream, record_snapshot, identifier_gate, collection_gate,
        envelope_gate, record_id_extraction, payload_size_gate, source_attribution,
        atomic_batch_gate, digest_gate, release_projection, dropped_report, nested_release,
        nested_dropped_report, field_coverage, content_fingerprint, exact_numbers,
        outcome_detection, sequence_assignment, idempotent_upsert, tombstone_delete, apply_batch,
        repeated_lines, streaming_apply, integrity_check, keyed_lookup, declared_filter,
        filtered_listing, byte_budget_pages, page_walk, change_feed, change_feed_stream,
        replica_fold, max_position, collection_checksum, chained_checksum, manifest,
        digest_listing, drift_report, freshness_check, served_changes, served_pages,
        dropped_totals, outcome_totals, stream_onto_table, faulty_lines, batch_files, ingest_answers,
        change_feed_page, digest_listing_after, manifest_bodies, complete_documents, bucket_digest,
        replica_catch_up, sorted_page, reprojection, reprojection_of_many,
        split_batches, stateful_outcomes, read_as_of, purge_after_lag, tree_drift,
        position_bitmaps, backfill, stored_lookup, bucketed_checksum, drift_of_some,
        feed_from_position, committed_totals,
    )
}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Product rows released, hashed, merged and summed up in a manifest."""
    applied = apply_ops(None, inputs.part_ops(spark, folder), PRODUCT)
    return summary.manifests(applied.records)
