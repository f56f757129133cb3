"""Reading operations: batch files, line-delimited streams and existing tables.

A batch file is one JSON array of ``{"op", "id", "payload"}`` for one collection. A line file
carries one operation per line together with ``batch_id, batch_seq, ord, collection``, either
``token_hash`` or ``source``, and in ``batch_ops`` the number of operations of its batch, by which a
stream knows when a batch is whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedgate.limits import MAX_BODY_BYTES

_ENVELOPE = ["op", "id", "payload"]
_ENVELOPE_TYPE = "op string, id string, payload string"
_LINE = ["batch_id", "batch_seq", "ord", "batch_ops", "source", "token_hash", "collection", "arrived_at"]
_LINE_TYPE = (
    "batch_id string, batch_seq long, ord int, batch_ops int, source string, token_hash string, "
    f"collection string, arrived_at timestamp, {_ENVELOPE_TYPE}"
)

# What an overflowing number turns into when a payload is cut out of its envelope.
_OVERFLOW = 'Infinity"'


def _problem(text: Column, allowed: list[str], tree: Column, overflow: Column, required: tuple[str, ...] = ()) -> Column:
    """``invalid_body`` for unknown keys, missing places, wrong member types, or text Spark read leniently."""
    kinds = [
        F.schema_of_variant(F.try_variant_get(tree, f"$.{name}", "variant")) for name in ("op", "id")
    ]
    op_kind, id_kind = kinds
    stray = F.exists(F.json_object_keys(text), lambda key: ~key.isin(allowed))
    bad = (
        tree.isNull()
        | F.coalesce(stray, F.lit(True))
        | F.coalesce(op_kind != "STRING", F.lit(True))
        | F.coalesce(~id_kind.isin("STRING", "VOID"), F.lit(False))
        | F.coalesce(overflow, F.lit(False))
    )
    for name in required:
        bad = bad | F.col(f"_e.{name}").isNull()
    return F.when(bad, F.lit("invalid_body"))


def _payload(raw: Column, tree: Column) -> Column:
    """The payload as JSON text: strings lose their quotes when cut out, so they are restored."""
    member = F.try_variant_get(tree, "$.payload", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.to_json(member)).otherwise(raw)


def read_batches(
    spark: SparkSession,
    path: str,
    collection: str | None = None,
    source: str | None = None,
    max_body_bytes: int = MAX_BODY_BYTES,
) -> DataFrame:
    """Batch files as operations, ``ord`` being the position in the array.

    Files are named ``…<collection>/<batch_seq>.json`` unless ``collection`` is given, or lie in folders
    ``…collection=<name>/batch_seq=<n>/`` as Spark writes them; one whose name is no number is ordered by its time. Files of equal number are ordered by path, their ``batch_id``. A file
    over the size limit is reported without being read, however large: the limit is a filter on the listing,
    and the scan that reports the others asks for no content. A file that is not an array of envelopes
    is reported as well. Both show up as a single row with ``envelope_error``.
    """
    listing = spark.read.format("binaryFile").load(path)
    small = listing.filter(F.col("length") <= max_body_bytes)
    large = listing.filter(F.col("length") > max_body_bytes).drop("content").withColumn("content", F.lit(None).cast("binary"))
    foldered = F.nullif(F.regexp_extract("path", r"/collection=([^/]+)/batch_seq=\d+/[^/]*$", 1), F.lit(""))
    named = F.coalesce(foldered, F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    files = small.unionByName(large).select(
        F.col("path").alias("batch_id"),
        F.coalesce(
            F.regexp_extract("path", r"/batch_seq=(\d+)/[^/]*$", 1).try_cast("long"),
            F.regexp_extract("path", r"(\d+)\.json$", 1).try_cast("long"),
            F.unix_micros("modificationTime"),
        ).alias("batch_seq"),
        F.lit(source).cast("string").alias("source"),
        (F.lit(collection) if collection else named).alias("collection"),
        F.col("modificationTime").alias("arrived_at"),
        (F.col("length") > max_body_bytes).alias("_large"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("_text"),
    )
    checked = files.withColumn(
        "_whole", F.try_parse_json(F.concat(F.lit("["), F.col("_text"), F.lit(","), F.xxhash64("_text"), F.lit("]")))
    )
    # Trailing text displaces the checksum; see feedgate.functions.release.well_formed.
    sound = F.try_variant_get("_whole", "$[1]", "bigint").eqNullSafe(F.xxhash64("_text")) & F.try_variant_get(
        "_whole", "$[2]", "variant"
    ).isNull()
    elements = F.when(sound, F.try_variant_get("_whole", "$[0]", "array<variant>"))
    texts = F.from_json("_text", "array<string>")
    listed = checked.select(
        "*", F.when(elements.isNotNull(), F.arrays_zip(elements.alias("tree"), texts.alias("text"))).alias("_list")
    )
    usable = F.col("_list").isNotNull()
    one = F.array(F.lit(None).cast("struct<tree:variant,text:string>"))
    rows = listed.select(
        "batch_id", "batch_seq", "source", "collection", "arrived_at", "_large", usable.alias("_usable"),
        F.col("_text").contains(_OVERFLOW).alias("_mentioned"),
        F.posexplode(F.when(usable, F.col("_list")).otherwise(one)).alias("ord", "_item"),
    ).withColumn("_e", F.from_json("_item.text", _ENVELOPE_TYPE))
    error = (
        F.when(F.col("_large"), "body_too_large")
        .when(~F.col("_usable"), "invalid_body")
        .otherwise(
            _problem(
                F.col("_item.text"),
                _ENVELOPE,
                F.col("_item.tree"),
                F.col("_item.text").contains(_OVERFLOW) & ~F.col("_mentioned"),
            )
        )
    )
    return rows.select(
        "batch_id", "batch_seq", F.col("ord").cast("int").alias("ord"), "source", "collection",
        F.col("_e.op").alias("op"), F.col("_e.id").alias("id"),
        _payload(F.col("_e.payload"), F.col("_item.tree")).alias("payload"),
        "arrived_at", error.alias("envelope_error"),
    )


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of text as operations; works on a batch and on a stream alike."""
    text = F.col(column)
    parsed = lines.select(
        text.alias("_line"), F.try_parse_json(text).alias("_tree"), F.from_json(text, _LINE_TYPE).alias("_e")
    )
    return parsed.select(
        *[F.col(f"_e.{name}").alias(name) for name in _LINE],
        F.col("_e.op").alias("op"),
        F.col("_e.id").alias("id"),
        _payload(F.col("_e.payload"), F.col("_tree")).alias("payload"),
        _problem(
            F.col("_line"),
            _LINE + _ENVELOPE,
            F.col("_tree"),
            F.col("_e.payload").contains(_OVERFLOW) & ~F.col("_line").contains(_OVERFLOW),
            ("batch_id", "batch_seq", "ord"),
        ).alias("envelope_error"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same operations arriving continuously, as files appear in ``path``."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_lines(reader.text(path))


def write_lines(ops: DataFrame, path: str) -> None:
    """Operations as line-delimited JSON that :func:`read_lines` reads back; a batch is in one file, in order.

    Without a column ``batch_ops`` the operations are taken to be whole batches, and are counted. To write
    a piece of a batch, say in that column how many operations the batch has.
    """
    # A batch has one number, so its rows fall into one range, where they are counted without another exchange.
    placed = ops.repartitionByRange("batch_seq", "batch_id")
    if "batch_ops" not in ops.columns:
        batch = Window.partitionBy("batch_seq", "batch_id")
        placed = placed.withColumn("batch_ops", F.count(F.lit(1)).over(batch).cast("int"))
    fields = [c for c in (*_LINE, "op", "id") if c in placed.columns]
    head = F.to_json(F.struct(*[F.col(c) for c in fields]))
    line = F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"payload":'), F.col("payload"), F.lit("}"))
    placed.sortWithinPartitions("batch_seq", "batch_id", "ord").withColumn("_head", head).select(
        F.when(F.col("payload").isNull(), F.col("_head")).otherwise(line).alias("value")
    ).write.mode("append").text(path)
