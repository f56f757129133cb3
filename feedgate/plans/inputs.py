"""Operations and record tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgate.operators.numbering import number_rows
from feedgate.plans.apply import apply_ops
from feedgate.sources.scratch import new_path, save
from feedgate.spec import SpecSet

SPECS = SpecSet.parse(
    [
        {
            "collection": "part.sheet",
            "id": "$.id",
            "fields": {
                "name": {"type": "string", "index": True},
                "brand": {"type": "string", "index": True},
                "size": {"type": "number", "index": True},
                "cents": {"type": "number"},
                "grade": {"type": "string"},
                "traits": {"type": "object", "allow": ["type", "shelf"]},
            },
            "filters": ["name", "brand", "size"],
            "sort": ["seq", "brand", "size"],
        },
        {
            "collection": "user.activity",
            "id": "$.user.id",
            "fields": {
                "type": {"type": "string", "index": True},
                "tier": {"type": "number", "index": True},
            },
            "filters": ["type", "tier"],
        },
        {
            "collection": "sales.order",
            "id": "$.key",
            "fields": {
                "status": {"type": "string", "index": True},
                "priority": {"type": "string"},
                "cents": {"type": "number"},
            },
            "filters": ["status"],
        },
        {
            "collection": "sales.line",
            "id": "$.key",
            "fields": {
                "part": {"type": "number", "index": True},
                "flags": {"type": "object", "allow": ["returned", "status"]},
            },
            "filters": ["part"],
            "cache": {"shared_max_age": 600},
        },
        *(
            {
                "collection": f"text.{lang}",
                "id": "$.id",
                "fields": {
                    "text": {"type": "string"},
                    "chars": {"type": "number"},
                },
            }
            for lang in ("de", "en", "es", "fr")
        ),
        {
            "collection": "text.lines",
            "id": "$.id",
            "fields": {
                "lines": {
                    "type": "array",
                    "items": {
                        "type": "object",
                        "allow": {"n": {"type": "number"}, "text": {"type": "string"}},
                    },
                },
            },
        },
        {
            "collection": "vector",
            "id": "$.id",
            "fields": {
                "label": {"type": "number"},
                "values": {"type": "array", "items": {"type": "number"}},
            },
        },
    ]
)

#: Orders as they may be declared later on.
NARROWER = SpecSet.parse(
    [
        {
            "collection": "sales.order",
            "id": "$.key",
            "fields": {"status": {"type": "string", "index": True}, "cents": {"type": "number"}},
            "filters": ["status"],
        }
    ]
)

#: The same, and products without their names and traits.
NARROWER_STILL = SpecSet.parse(
    [
        {
            "collection": "sales.order",
            "id": "$.key",
            "fields": {"status": {"type": "string", "index": True}, "cents": {"type": "number"}},
            "filters": ["status"],
        },
        {
            "collection": "part.sheet",
            "id": "$.id",
            "fields": {
                "brand": {"type": "string", "index": True},
                "size": {"type": "number", "index": True},
                "cents": {"type": "number"},
            },
            "filters": ["brand", "size"],
        },
    ]
)

#: Products whose grade is a number instead of a text.
NUMBERED_GRADES = SpecSet.parse(
    [
        {
            "collection": "part.sheet",
            "id": "$.id",
            "fields": {
                "name": {"type": "string", "index": True},
                "brand": {"type": "string", "index": True},
                "size": {"type": "number", "index": True},
                "cents": {"type": "number"},
                "grade": {"type": "number"},
                "traits": {"type": "object", "allow": ["type", "shelf"]},
            },
            "filters": ["name", "brand", "size"],
        }
    ]
)

TEXTS = ("text.de", "text.en", "text.es", "text.fr")


def only(*names: str) -> SpecSet:
    return SpecSet(SPECS[name] for name in names)


_FIXED_TIME = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, as many splits as its files have."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ops(
    rows: DataFrame,
    *,
    source: Column,
    collection: Column,
    batch: Column,
    ord: Column,
    payload: Column | None,
    op: Column | None = None,
    id: Column | None = None,
    at: Column | None = None,
) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        F.concat(collection, F.lit("-"), batch.cast("string")).alias("batch_id"),
        batch.cast("long").alias("batch_seq"),
        ord.cast("int").alias("ord"),
        source.alias("source"),
        collection.alias("collection"),
        (F.lit("upsert") if op is None else op).alias("op"),
        (null if id is None else id.cast("string")).alias("id"),
        (null if payload is None else payload).alias("payload"),
        (F.lit(_FIXED_TIME) if at is None else at).cast("timestamp").alias("arrived_at"),
    )


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def part_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Products; every second size class sends a grade of the wrong type."""
    part = table(spark, folder, "part")
    common = [
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
        F.col("p_brand").alias("brand"),
        cents("p_retailprice").alias("cents"),
        F.struct(
            F.col("p_type").alias("type"), F.col("p_size").alias("shelf"), F.lit(1).alias("bin")
        ).alias("traits"),
        (F.col("p_partkey") * 7).alias("internal_code"),
    ]
    graded = F.when(
        F.col("p_size") % 2 == 0, F.to_json(F.struct(*common, F.col("p_type").alias("grade")))
    ).otherwise(F.to_json(F.struct(*common, F.col("p_size").alias("grade"))))
    return _ops(
        part,
        source=F.lit("erp"),
        collection=F.lit("part.sheet"),
        batch=F.floor(F.col("p_partkey") / 500),
        ord=F.col("p_partkey") % 500,
        payload=graded,
    )


def event_ops(spark: SparkSession, folder: str) -> DataFrame:
    """User state changing over time: every key has many operations, errors delete."""
    events = table(spark, folder, "events")
    tier = F.floor(F.get_json_object("props", "$.k").cast("int") / 50)
    payload = F.to_json(
        F.struct(
            F.col("event_type").alias("type"),
            tier.alias("tier"),
            F.struct(F.col("user_id").alias("id")).alias("user"),
        )
    )
    error = F.col("event_type") == "error"
    return _ops(
        events,
        source=F.lit("app"),
        collection=F.lit("user.activity"),
        batch=F.floor(F.col("event_id") / 100),
        ord=F.col("event_id") % 100,
        op=F.when(error, "delete").otherwise("upsert"),
        id=F.col("user_id"),
        payload=F.when(~error, payload),
        at=F.col("ts"),
    )


def mixed_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Operations of which each event type makes a different mistake, or none."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    payload = F.to_json(F.struct(kind.alias("type"), F.col("value").alias("tier")))
    return _ops(
        events,
        source=F.lit("app"),
        collection=F.lit("user.activity"),
        batch=F.floor(F.col("event_id") / 100),
        ord=F.col("event_id") % 100,
        op=F.when(kind.isin("error", "signup"), "delete").otherwise("upsert"),
        id=F.when(kind != "purchase", F.col("user_id")),
        payload=F.when(kind.isin("click", "signup", "purchase"), payload),
        at=F.col("ts"),
    )


def keyed_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose id is a number, a text, a fraction, a flag, or not there."""
    events = table(spark, folder, "events")

    def document(value: Column | None) -> Column:
        user = F.struct(F.lit(1).alias("x") if value is None else value.alias("id"))
        return F.to_json(F.struct(user.alias("user"), F.col("event_type").alias("type")))

    kind = F.col("event_type")
    return _ops(
        events,
        source=F.lit("app"),
        collection=F.lit("user.activity"),
        batch=F.floor(F.col("event_id") / 100),
        ord=F.col("event_id") % 100,
        payload=F.when(kind == "click", document(F.col("user_id")))
        .when(kind == "view", document(F.concat(F.lit("u-"), F.col("user_id"))))
        .when(kind == "purchase", document(F.col("user_id") + F.lit(0.5)))
        .when(kind == "signup", document(F.col("user_id") > 10))
        .otherwise(document(None)),
    )


def order_ops(spark: SparkSession, folder: str, run: int = 1) -> DataFrame:
    """Orders; in the second run urgent ones come back closed and the rest as they were."""
    orders = table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    if run == 2:
        status = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("X")).otherwise(status)
    payload = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("key"),
            status.alias("status"),
            F.col("o_orderpriority").alias("priority"),
            cents("o_totalprice").alias("cents"),
        )
    )
    return _ops(
        orders,
        source=F.lit("erp"),
        collection=F.lit("sales.order"),
        batch=F.floor(F.col("o_orderkey") / 500),
        ord=F.col("o_orderkey") % 500,
        payload=payload,
        at=F.col("o_orderdate"),
    )


def order_removals(spark: SparkSession, folder: str) -> DataFrame:
    """Deletions of all orders of low priority, in batches behind those of the second run."""
    orders = table(spark, folder, "orders").filter("o_orderpriority = '5-LOW'")
    return _ops(
        orders,
        source=F.lit("erp"),
        collection=F.lit("sales.order"),
        batch=F.floor(F.col("o_orderkey") / 500) + 1_000_000_000,
        ord=F.col("o_orderkey") % 500,
        op=F.lit("delete"),
        id=F.col("o_orderkey"),
        payload=None,
    )


#: Size limit of the files below; one kind of fault exceeds it.
BODY_BYTES = 300_000


def batch_files(spark: SparkSession, folder: str) -> str:
    """A folder of ``collection=…/batch_seq=…/`` files, each a JSON array of operations, as Spark writes them.

    Of every seven files one is not an array, one has a stray key, one trailing text, one is too large.
    """
    path = new_path(spark, "batches")
    ops = part_ops(spark, folder).unionByName(order_ops(spark, folder)).withColumn("place", F.col("batch_seq") % 7)
    stray = F.when((F.col("place") == 2) & (F.col("ord") == 3), F.lit(',"note":1')).otherwise("")
    envelope = F.concat(F.lit('{"op":"upsert"'), stray, F.lit(',"payload":'), F.col("payload"), F.lit("}"))
    listed = ops.groupBy("collection", "batch_seq", "place").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", envelope.alias("e")))), lambda x: x["e"]), ",").alias("list")
    )
    body = F.concat(F.lit("["), F.col("list"), F.lit("]"))
    text = (
        F.when(F.col("place") == 1, F.concat(F.lit('{"ops":'), body, F.lit("}")))
        .when(F.col("place") == 3, F.concat(body, F.lit(" x")))
        .when(F.col("place") == 4, F.concat(body, F.repeat(F.lit(" "), BODY_BYTES)))
        .otherwise(body)
    )
    rows = listed.select("collection", "batch_seq", text.alias("value"))
    rows.write.partitionBy("collection", "batch_seq").text(path)
    return path


def line_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines, whose keys repeat; numbered in the order of all their columns."""
    lines = table(spark, folder, "lineitem")
    order = [F.col(c).asc() for c in lines.columns]
    sent = ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount", "l_shipdate"]
    numbered = number_rows(lines, order, "n", "lines", keep=sent)
    payload = F.to_json(
        F.struct(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"),
            F.col("l_partkey").alias("part"),
            F.struct(
                F.col("l_returnflag").alias("returned"), F.col("l_linestatus").alias("status")
            ).alias("flags"),
            F.col("l_discount").alias("discount"),
        )
    )
    return _ops(
        numbered,
        source=F.lit("erp"),
        collection=F.lit("sales.line"),
        batch=F.floor((F.col("n") - 1) / 1000),
        ord=(F.col("n") - 1) % 1000,
        payload=payload,
        at=F.col("l_shipdate"),
    )


def document_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, by source and language, each in a batch of its own."""
    documents = table(spark, folder, "documents")
    payload = F.to_json(
        F.struct(
            F.col("text"),
            F.col("n_chars").alias("chars"),
            F.col("lang"),
            F.col("doc_id").alias("id"),
        )
    )
    return _ops(
        documents,
        source=F.col("source"),
        collection=F.concat(F.lit("text."), F.col("lang")),
        batch=F.col("doc_id"),
        ord=F.lit(0),
        id=F.col("doc_id"),
        payload=payload,
    )


def line_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as arrays of numbered lines, with a length nobody declared."""
    documents = table(spark, folder, "documents")
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, n: F.struct(n.alias("n"), line.alias("text"), F.length(line).alias("size")),
    )
    payload = F.to_json(F.struct(F.col("doc_id").alias("id"), lines.alias("lines")))
    return _ops(
        documents,
        source=F.col("source"),
        collection=F.lit("text.lines"),
        batch=F.col("doc_id"),
        ord=F.lit(0),
        payload=payload,
    )


def vector_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings, whose numbers mostly need the exact number form."""
    vectors = table(spark, folder, "embeddings")
    payload = F.to_json(
        F.struct(
            F.col("vec_id").alias("id"),
            F.col("embedding").cast("array<double>").alias("values"),
            F.col("label"),
        )
    )
    return _ops(
        vectors,
        source=F.lit("ml"),
        collection=F.lit("vector"),
        batch=F.col("vec_id"),
        ord=F.lit(0),
        payload=payload,
    )


_BUILDERS = {
    "part": (part_ops, only("part.sheet")),
    "event": (event_ops, only("user.activity")),
    "order": (order_ops, only("sales.order")),
    "line": (line_ops, only("sales.line")),
    "document": (document_ops, only(*TEXTS)),
}
_written: dict[tuple[str, str, str], DataFrame] = {}


def records(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The record table of one input, written on first use and then read like any other."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        build, specs = _BUILDERS[name]
        applied = apply_ops(None, build(spark, folder), specs)
        _written[key] = save(applied.records, f"records-{name}")
    return _written[key]
