"""Gates: which operations, batches, names and digests are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgate.functions.idents import id_error, name_error
from feedgate.functions.labels import digest_error
from feedgate.limits import MAX_BATCH_OPS, MAX_PAYLOAD_BYTES
from feedgate.sources.scratch import save
from feedgate.spec import SpecSet

# Reject codes with their status and what they tell the sender, in the order a
# batch is judged. A batch-level code of a smaller rank hides every code of a larger one;
# codes of the last rank are compared by the position of the operation.
REJECTS = {
    "unauthorized": (1, 401, "the credential is unknown or was withdrawn"),
    "invalid_path": (2, 400, "the collection name is not usable"),
    "unknown_collection": (3, 404, "no specification covers this collection"),
    "invalid_body": (4, 400, "the body is not a list of operations"),
    "body_too_large": (4, 413, "the body is too large"),
    "incomplete_batch": (4, 400, "operations of the batch are missing"),
    "batch_too_large": (5, 400, "the batch carries too many operations"),
    "missing_payload": (6, 400, "an upsert needs a payload"),
    "missing_id": (6, 400, "the operation has no usable record id"),
    "invalid_payload": (6, 400, "a payload must be an object"),
    "payload_too_large": (6, 413, "the released payload is too large"),
    "payload_on_delete": (6, 400, "a delete carries no payload"),
}
OPERATION_RANK = 6
# Places of a batch that are marked in one word.
_WORD = 64
# A side of more bytes than this, counted by rows as they are in memory, is not broadcast.
MAX_BROADCAST_BYTES = 32 * 1024 * 1024

def rank_of(code: Column) -> Column:
    return _lookup(code, 0).cast("int")


def _lookup(code: Column, field: int) -> Column:
    pairs = [F.lit(x) for name, row in REJECTS.items() for x in (name, str(row[field]))]
    return F.element_at(F.create_map(*pairs), code)


def sized(frame: DataFrame, label: str = "side") -> DataFrame:
    """A side of short rows, written first: the planner then knows its bytes and broadcasts it or not.

    It knows those of the files, in which keys that are in order take a byte or less each. A side of so many
    rows that the driver could not hold it, however small its files, is marked to be joined by a shuffle.
    """
    saved = save(frame, label)
    rows = saved.count()  # from the footers
    return saved.hint("merge") if rows * row_bytes(saved) > MAX_BROADCAST_BYTES else saved


def row_bytes(frame: DataFrame) -> int:
    """Bytes the planner takes a row in memory for: eight, and for each column what its type has by default."""
    return 8 + frame._jdf.schema().defaultSize()


def identifier_gate(frame: DataFrame, column: str = "id", grammar: str = "id") -> DataFrame:
    """Add ``ident_error``: NULL for usable identifiers, else the first violated rule."""
    rule = {"id": id_error, "name": name_error}[grammar]
    return frame.withColumn("ident_error", rule(F.col(column)))


def collection_gate(frame: DataFrame, specs: SpecSet) -> tuple[DataFrame, DataFrame]:
    """Rows of declared collections, and the others with their reject code.

    A list of names instead of a join, so that the test reaches the scan as a partition filter.
    """
    declared = F.col("collection").isin(list(specs))
    refused = frame.filter(F.coalesce(~declared, F.lit(True)))
    return frame.filter(declared), refused.withColumn("code", F.lit("unknown_collection"))


def digest_gate(digests: DataFrame, column: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """Usable digests in lower case, and malformed ones with ``digest_error``."""
    judged = digests.withColumn("digest_error", digest_error(F.col(column)))
    usable = judged.filter(F.col("digest_error").isNull()).drop("digest_error")
    return (
        usable.withColumn(column, F.lower(column)),
        judged.filter(F.col("digest_error").isNotNull()),
    )


def attribute_source(ops: DataFrame, credentials: DataFrame) -> DataFrame:
    """Set ``source`` from the credential hash an operation came with, and from nothing else.

    Unknown and revoked credentials leave ``source`` NULL, which the envelope gate reports as
    ``unauthorized``. The credentials are broadcast if their bytes allow it; else the join is an
    ordinary one, which adaptive execution splits for a hot credential.
    """
    usable = credentials.filter(F.col("revoked_at").isNull()).select("token_hash", "source")
    return ops.drop("source").join(sized(usable, "credentials"), "token_hash", "left").drop("token_hash")


def envelope_gate(
    released: DataFrame, specs: SpecSet, max_payload_bytes: int = MAX_PAYLOAD_BYTES
) -> DataFrame:
    """Add ``record_id`` and ``code``: why an operation is refused, NULL if it is fine.

    Expects released operations, with the optional columns ``envelope_error`` (the source
    could not read the envelope) and ``body_bytes`` judged by the source itself.
    """
    envelope_error = (
        F.col("envelope_error") if "envelope_error" in released.columns else F.lit(None)
    ).cast("string")
    upsert, delete = F.col("op") == "upsert", F.col("op") == "delete"
    state = F.col("doc_state")
    has_payload = F.coalesce(state != "null", F.lit(False))
    record_id = F.when(upsert, F.coalesce("id", "doc_id")).otherwise(F.col("id"))
    # Without its batch and place an operation cannot be ordered, nor its batch refused as a whole.
    placed = F.lit(True)
    for name in ("batch_id", "batch_seq", "ord"):
        if name in released.columns:
            placed = placed & F.col(name).isNotNull()
    bad_body = (
        ~placed
        | F.coalesce(~F.col("op").isin("upsert", "delete"), F.lit(True))
        | (F.col("id").isNotNull() & id_error(F.col("id")).isNotNull())
        | F.coalesce(state == "invalid", F.lit(False))
    )
    code = (
        F.when(F.col("source").isNull(), "unauthorized")
        .when(name_error(F.col("source")).isNotNull(), "unauthorized")
        .when(name_error(F.col("collection")).isNotNull(), "invalid_path")
        .when(~F.col("collection").isin(list(specs)), "unknown_collection")
        .when(envelope_error.isNotNull(), envelope_error)
        .when(bad_body, "invalid_body")
        .when(upsert & ~has_payload, "missing_payload")
        .when(upsert & id_error(record_id).isNotNull(), "missing_id")
        .when(upsert & (state != "object"), "invalid_payload")
        .when(upsert & size_error(F.col("payload_bytes"), max_payload_bytes), "payload_too_large")
        .when(delete & has_payload, "payload_on_delete")
        .when(delete & F.col("id").isNull(), "missing_id")
    )
    return released.withColumns({"record_id": record_id, "code": code})


def size_error(payload_bytes: Column, limit: int = MAX_PAYLOAD_BYTES) -> Column:
    """Whether a released document is larger than a record may be."""
    return payload_bytes > limit


def batch_verdicts(judged: DataFrame, max_ops: int = MAX_BATCH_OPS) -> DataFrame:
    """One row per refused batch: the code that refuses it and the position it was found at.

    Two operations in the same place of a batch refuse it, because their order is unknown. Places are
    marked in words of 64 bits, so what is exchanged is a row per 64 places and not per operation; a word
    with fewer marks than operations has places that repeat, and only those words are looked at again.
    Counts, marks and first errors combine before each exchange, so a batch of any size is cheap.
    """
    rank = rank_of(F.col("code"))
    at = F.when(rank == OPERATION_RANK, F.col("ord")).otherwise(F.lit(-1))
    error = F.when(
        F.col("code").isNotNull(),
        F.struct(rank.alias("rank"), at.alias("at"), F.col("ord"), F.col("code")),
    )
    word = F.floor(F.col("ord") / _WORD).alias("word")
    mark = F.expr(f"shiftleft(1L, CAST(pmod(ord, {_WORD}) AS INT))")
    words = judged.groupBy("batch_id", word).agg(F.count(F.lit(1)).alias("n"), F.bit_or(mark).alias("marks"))
    words = sized(words, "places")
    errors = judged.filter(F.col("code").isNotNull()).groupBy("batch_id").agg(F.min(error).alias("first"))
    found = words.select("batch_id", "n").unionByName(errors, allowMissingColumns=True)
    # Operations without a place have no marks; two of them are in the same place.
    crowded = words.filter(F.col("n") > F.coalesce(F.bit_count("marks"), F.lit(1)))
    if not crowded.isEmpty():
        crowded = crowded.select(F.col("batch_id").alias("_batch"), F.col("word").alias("_word"))
        here = F.col("batch_id").eqNullSafe(F.col("_batch")) & F.col("word").eqNullSafe(F.col("_word"))
        places = judged.select("batch_id", "ord", word).join(crowded, here, "left_semi").groupBy("batch_id", "ord").count()
        twice = F.struct(
            F.lit(REJECTS["invalid_body"][0]).alias("rank"), F.lit(-1).alias("at"), F.col("ord"), F.lit("invalid_body").alias("code")
        )
        repeated = places.filter(F.col("count") > 1).select("batch_id", twice.alias("first"))
        found = found.unionByName(repeated, allowMissingColumns=True)
    totals = found.groupBy("batch_id").agg(F.sum("n").alias("ops"), F.min("first").alias("first"))
    too_many = (F.col("ops") > max_ops) & (
        F.col("first").isNull() | (F.col("first.rank") > REJECTS["batch_too_large"][0])
    )
    code = F.when(too_many, "batch_too_large").otherwise(F.col("first.code"))
    return totals.select(
        "batch_id",
        F.when(~too_many, F.col("first.ord")).alias("ord"),
        _lookup(code, 1).cast("int").alias("status"),
        F.when(code == "body_too_large", "payload_too_large").otherwise(code).alias("code"),
        _lookup(code, 2).alias("message"),
        rank_of(code).alias("rank"),
    ).filter(F.col("code").isNotNull())


def accept_batches(judged: DataFrame, refused: DataFrame) -> DataFrame:
    """Operations of batches in which nothing was wrong."""
    verdicts = refused.select(F.col("batch_id").alias("_refused"))
    return judged.join(verdicts, F.col("batch_id").eqNullSafe(F.col("_refused")), "left_anti")
