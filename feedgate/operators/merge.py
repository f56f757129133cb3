"""Change capture: what every operation does, and the record table that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedgate.limits import EMPTY_DOCUMENT, EMPTY_DOCUMENT_HASH
from feedgate.operators.gates import sized

KEY = ["source", "collection", "id"]

# A key with more operations than this in one run is cut into blocks of batches.
HOT_KEY_OPS = 500_000
BATCHES_PER_BLOCK = 256
# Keys are counted in so many buckets before they are counted one by one.
KEY_BUCKETS = 8192


def _outcome(previous: Column) -> Column:
    """What an operation does, given the state (op, hash) its record was left in."""
    live = F.coalesce(previous["op"] == "upsert", F.lit(False))
    same = live & previous["content_hash"].eqNullSafe(F.col("content_hash"))
    return (
        F.when(F.col("op") == "delete", F.when(live, "tombstoned").otherwise("unchanged"))
        .when(same, "unchanged")
        .otherwise("stored")
    )


def base_states(records: DataFrame) -> DataFrame:
    """The record table as earlier operations: a live row is an upsert, a tombstone a delete."""
    return records.select(
        *KEY,
        F.when(F.col("deleted_at").isNull(), "upsert").otherwise("delete").alias("op"),
        F.when(F.col("deleted_at").isNull(), F.col("content_hash")).alias("content_hash"),
    )


def packed(digest: Column) -> Column:
    """A SHA-256 in hex as its bytes, half as long to move; NULL for any other text."""
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.unhex(digest))


def touched(records: DataFrame, ops: DataFrame) -> DataFrame:
    """Base rows an operation addresses. The keys are written first, so that the planner knows
    their size: a small run's keys are broadcast and thin out the base before any exchange."""
    return records.join(sized(ops.select(*KEY).distinct(), "touched"), KEY, "left_semi")


def hot_keys(ops: DataFrame, threshold: int = HOT_KEY_OPS) -> DataFrame:
    """Keys with more operations than the threshold.

    Operations are counted by buckets of keys first, a short list whatever their number: a hot key's
    bucket is hot too, and usually none is. Only the keys of hot buckets are counted one by one.
    """
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(KEY_BUCKETS)).cast("int")
    counts = ops.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    hot = [row[0] for row in counts.filter(F.col("_n") > threshold).select("_bucket").collect()]
    if not hot:
        return ops.select(*KEY).limit(0)
    within = F.array_contains(F.lit(hot), bucket) if len(hot) < KEY_BUCKETS // 2 else F.lit(True)
    counts = ops.filter(within).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > threshold).drop("_n")


def detect_outcomes(
    ops: DataFrame,
    records: DataFrame | None = None,
    hot_threshold: int = HOT_KEY_OPS,
    batches_per_block: int = BATCHES_PER_BLOCK,
    mark_last: bool = False,
) -> DataFrame:
    """Add ``outcome``: ``stored``, ``tombstoned`` or ``unchanged``, in order of arrival.

    What an operation leaves behind depends on itself alone, so its outcome needs only the
    operation before it on the same key, or else the stored record. The stored records join
    as operations that came first, which makes it one exchange on the key and one ``lag``.

    Keys with very many operations are cut into blocks of batches. Inside a block ``lag``
    works as before; the state before a block is the last operation of the block before it,
    taken from one short row per key and block.

    With ``mark_last``, ``_last`` marks the last operation that changed its key, as long as no key is
    hot; it comes from the same exchange. Digests may be texts, or bytes as :func:`packed` makes them.
    """
    columns = ops.columns
    frame = ops.withColumn("_base", F.lit(False))
    if records is not None:
        base = base_states(touched(records, ops)).withColumn("_base", F.lit(True))
        if dict(ops.dtypes)["content_hash"] == "binary":
            base = base.withColumn("content_hash", packed(F.col("content_hash")))
        frame = frame.unionByName(base, allowMissingColumns=True)
    real = ~F.col("_base")
    # Batches of one number, which several collections may send, are ordered by name.
    order = [F.col("_base").desc(), *(F.col(c).asc_nulls_first() for c in ("batch_seq", "batch_id", "ord"))]
    state = F.struct("op", "content_hash")

    hot = hot_keys(ops, hot_threshold)
    if hot.isEmpty():
        within = Window.partitionBy(*KEY).orderBy(*order)
        if not mark_last:
            lagged = frame.withColumn("_previous", F.lag(state).over(within))
            return lagged.filter(real).select(*columns, _outcome(F.col("_previous")).alias("outcome"))
        judged = frame.withColumns({"_previous": F.lag(state).over(within), "_at": F.row_number().over(within)})
        judged = judged.withColumn("outcome", _outcome(F.col("_previous")))
        whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        changed = F.when(real & (F.col("outcome") != "unchanged"), F.col("_at"))
        judged = judged.withColumn("_last", F.col("_at").eqNullSafe(F.last(changed, ignorenulls=True).over(whole)))
        return judged.filter(real).select(*columns, "outcome", "_last")

    marked = frame.join(hot.withColumn("_hot", F.lit(True)), KEY, "left")
    block = F.when(F.col("_base"), -1).otherwise(F.floor(F.col("batch_seq") / batches_per_block))
    blocked = marked.withColumn("_block", F.when(F.col("_hot"), block).otherwise(F.lit(0)))
    within = Window.partitionBy(*KEY, "_block").orderBy(*order)
    lagged = blocked.withColumn("_previous", F.lag(state).over(within))

    last = blocked.filter("_hot").groupBy(*KEY, "_block").agg(
        F.max_by(state, F.struct("batch_seq", "batch_id", "ord")).alias("_last")
    )
    across = Window.partitionBy(*KEY).orderBy("_block")
    carried = last.select(*KEY, "_block", F.lag("_last").over(across).alias("_carried"))
    return (
        lagged.join(carried, [*KEY, "_block"], "left")
        .filter(real)
        .select(
            *columns,
            _outcome(F.coalesce("_previous", "_carried")).alias("outcome"),
        )
    )


def last_changes(numbered: DataFrame) -> DataFrame:
    """Per key the last operation that changed it, as marked, or else found by an aggregate that combines before
    the exchange."""
    if "_last" in numbered.columns:
        return numbered.filter("_last").select(*KEY, "seq", "op", "batch_id", "ord")
    latest = F.max(F.struct("seq", "op", "batch_id", "ord")).alias("_last")
    return (
        numbered.filter(F.col("seq").isNotNull()).groupBy(*KEY).agg(latest).select(*KEY, "_last.*")
    )


def changed_records(numbered: DataFrame, staged: DataFrame) -> DataFrame:
    """The rows a run writes: full records for last upserts, tombstones for last deletes."""
    # The digest of a payload is taken again where it has arrived, which costs less than moving it.
    documents = staged.select("batch_id", "ord", "payload", "payload_bytes", "arrived_at")
    # The few short rows that won are written first: if they are small they are broadcast, and the
    # payloads of operations that lost or changed nothing are never moved.
    winners = sized(last_changes(numbered), "winners")
    joined = winners.join(documents, ["batch_id", "ord"])
    delete = F.col("op") == "delete"
    return joined.select(
        *KEY,
        "seq",
        F.when(delete, EMPTY_DOCUMENT).otherwise(F.col("payload")).alias("payload"),
        F.when(delete, EMPTY_DOCUMENT_HASH).otherwise(F.sha2("payload", 256)).alias("content_hash"),
        F.when(delete, len(EMPTY_DOCUMENT)).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.col("arrived_at").alias("ingested_at"),
        F.when(delete, F.col("arrived_at")).alias("deleted_at"),
    )


def merge_records(records: DataFrame, changes: DataFrame) -> DataFrame:
    """The record table after a run: untouched rows as they are, changed rows replaced.

    Untouched rows, usually nearly all, are not moved when the changed keys are few.
    """
    kept = records.join(sized(changes.select(*KEY), "changed"), KEY, "left_anti")
    return kept.unionByName(changes, allowMissingColumns=True)
