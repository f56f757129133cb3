"""Collection checksums, manifests and drift."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgate.operators.gates import sized
from feedgate.operators.merge import packed

COLLECTION = ["source", "collection"]

# SHA-256 of "[]", the checksum of a collection without live records.
EMPTY_CHECKSUM = "4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945"

# Buckets of ids that are digested apart.
BUCKETS = 4096


# Texts of a chained digest travel in compressed pieces of about so many bytes.
PIECE_BYTES = 1 << 16


def _pair() -> Column:
    """``,["id","hash"]`` in canonical form, from :func:`_short` columns; ids hold no control characters."""
    escaped = F.replace(F.replace("id", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    digest = F.coalesce(F.lower(F.hex("_bytes")), F.col("_other"))
    return F.concat(F.lit(',["'), escaped, F.lit('","'), digest, F.lit('"]'))


def _short(records: DataFrame, *keys: Column | str) -> DataFrame:
    """What live pairs need before they are in order: digests as bytes, texts that are none as they are."""
    digest = packed(F.col("content_hash"))
    other = F.when(digest.isNull(), F.col("content_hash"))
    return live(records).select(*keys, "id", digest.alias("_bytes"), other.alias("_other"))


def live(records: DataFrame) -> DataFrame:
    return records.filter(F.col("deleted_at").isNull())


def collection_checksums(records: DataFrame) -> DataFrame:
    """Per collection the SHA-256 over its live ``[id, hash]`` pairs in id order.

    The digest is defined over one byte string per collection, so its bytes have to be taken in order.
    Everything else is done by ranges of ids: sorting, writing out the pairs, and joining them to compressed
    pieces. One task per collection is left to hash its pieces one after the other, in constant memory.
    ``bucket_digests`` is the parallel form, whose digest differs.
    """
    order = [*COLLECTION, "id"]
    ordered = _short(records, *COLLECTION).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = ordered.select(*COLLECTION, F.monotonically_increasing_id().alias("place"), _pair().alias("_text"))
    kinds = {field.name: field.dataType.simpleString() for field in texts.schema}
    schema = ", ".join([*(f"{key} {kinds[key]}" for key in COLLECTION), "place long, size long, _text binary"])
    pieces = texts.mapInArrow(_joined, schema).repartition(*COLLECTION).sortWithinPartitions(*COLLECTION, "place")
    return _hashed(pieces.select(*COLLECTION, "size", "_text"), COLLECTION, "checksum")


def bucket_digests(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``source, collection, bucket, digest`` of the live ``[id, hash]`` pairs of each bucket of ids.

    A record's bucket is a hash of its id, so buckets are alike in size, are digested in parallel, and
    two tables that differ in a few records differ in as many buckets.
    """
    bucket = F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long") % buckets
    keys = [*COLLECTION, "bucket"]
    pairs = _short(records, *COLLECTION, bucket.alias("bucket"))
    ordered = pairs.repartition(*keys).sortWithinPartitions(*keys, "id")
    return _hashed(ordered.select(*keys, _pair().alias("_text")), keys, "digest")


def bucketed_checksums(digests: DataFrame) -> DataFrame:
    """One digest per collection over its bucket digests; at most as many as there are buckets."""
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "digest")))
    text = F.array_join(F.transform(ordered, lambda e: F.concat_ws(":", e["bucket"], e["digest"])), ",")
    return digests.groupBy(*COLLECTION).agg(F.sha2(text, 256).alias("digest"))


def _stretches(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Where the rows of each group begin and end."""
    changed = np.zeros(batch.num_rows, bool)
    for column in (batch.column(key) for key in keys):
        same = pc.equal(column[1:], column[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
        changed[1:] |= ~same
    edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
    yield from zip(edges, edges[1:])


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of the texts of a batch."""
    texts = batch.column("_text").cast(pa.large_binary())
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :], memoryview(texts.buffers()[2] or b"")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring texts of a collection as compressed pieces, with the place of their first row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, data = _texts(batch)
        rows, sizes, pieces = [], [], []
        for start, end in _stretches(batch, COLLECTION):
            while start < end:
                stop = int(np.searchsorted(offsets[: end + 1], offsets[start] + PIECE_BYTES, "right")) - 1
                stop = min(max(stop, start + 1), end)
                piece = data[offsets[start] : offsets[stop]]
                rows.append(start)
                sizes.append(len(piece))
                pieces.append(pa.compress(piece, codec="zstd", asbytes=True) if len(piece) else b"")
                start = stop
        first = batch.select([*COLLECTION, "place"]).take(pa.array(rows))
        columns = [*first.columns, pa.array(sizes, pa.int64()), pa.array(pieces, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [*COLLECTION, "place", "size", "_text"])


def _hashed(ordered: DataFrame, keys: list[str], name: str) -> DataFrame:
    """SHA-256 of the comma-led texts of each group, in the order they have, as a JSON array."""
    kinds = {field.name: field.dataType.simpleString() for field in ordered.schema}
    schema = ", ".join([*(f"{key} {kinds[key]}" for key in keys), f"{name} string"])
    return ordered.mapInArrow(_hasher(keys, name), schema)


def _hasher(keys: list[str], name: str):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, first, kinds = None, None, True, []

        def result() -> pa.RecordBatch:
            digest.update(b"]")
            values = [*([value] for value in current), [digest.hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [*kinds, pa.string()])], [*keys, name])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(key) for key in keys]
            kinds = [column.type for column in columns]
            sizes = batch.column("size").to_pylist() if "size" in batch.schema.names else None
            offsets, data = _texts(batch)
            for start, end in _stretches(batch, keys):
                key = [column[start].as_py() for column in columns]
                if key != current:
                    if current is not None:
                        yield result()
                    current, digest, first = key, hashlib.sha256(b"["), True
                if sizes is None:
                    parts = [data[offsets[start] : offsets[end]]]
                else:
                    parts = (
                        memoryview(pa.decompress(data[offsets[n] : offsets[n + 1]], sizes[n], codec="zstd"))
                        for n in range(start, end)
                        if sizes[n]
                    )
                for part in parts:
                    digest.update(part[1:] if first else part)  # the first text has no comma before it
                    first = first and not len(part)
        if current is not None:
            yield result()

    return hashed


def max_positions(records: DataFrame) -> DataFrame:
    """Highest feed position per collection, tombstones included."""
    return records.groupBy(*COLLECTION).agg(F.max("seq").alias("max_seq"))


def manifests(records: DataFrame) -> DataFrame:
    """Live count, checksum and highest position of every collection."""
    totals = records.groupBy(*COLLECTION).agg(
        F.count_if(F.col("deleted_at").isNull()).alias("count"), F.max("seq").alias("max_seq")
    )
    checksums = collection_checksums(records)
    return totals.join(checksums, COLLECTION, "left").select(
        *COLLECTION,
        "count",
        F.coalesce("checksum", F.lit(EMPTY_CHECKSUM)).alias("checksum"),
        "max_seq",
    )


def drift_report(
    records: DataFrame, digests: DataFrame, checksums: DataFrame | None = None
) -> DataFrame:
    """Ids that differ between a sender's digests and the live records.

    ``drift`` is ``missing`` (the sender has it, we do not), ``extra`` or ``changed``. With the
    sender's ``checksums`` per collection, collections that agree are skipped altogether.
    """
    ours = live(records).select(*COLLECTION, "id", F.col("content_hash").alias("_ours"))
    theirs = digests.select(*COLLECTION, "id", F.col("content_hash").alias("_theirs"))
    if checksums is not None:
        equal = collection_checksums(records).join(checksums, [*COLLECTION, "checksum"], "left_semi")
        equal = sized(equal.select(*COLLECTION))
        ours = ours.join(equal, COLLECTION, "left_anti")
        theirs = theirs.join(equal, COLLECTION, "left_anti")
    joined = ours.join(theirs, [*COLLECTION, "id"], "full_outer")
    drift = (
        F.when(F.col("_ours").isNull(), "missing")
        .when(F.col("_theirs").isNull(), "extra")
        .when(F.col("_ours") != F.col("_theirs"), "changed")
    )
    return joined.select(*COLLECTION, "id", drift.alias("drift")).filter(F.col("drift").isNotNull())
