"""Raw documents kept by choice, and backfill after specifications have become wider.

What a release removes is gone from the record table. A table's owner may keep the raw documents that lost
something for a time, apart from the table and under their own rules of access:

``<path>/raw/day=…/``    source, collection, id, seq, payload: the document as it was sent
``<path>/index/day=…/``  source, collection, id, seq, label: what it lost, places in arrays written ``[]``

``seq`` is the position the document was stored at, so a raw document is used only while its record still
stands there: one that was changed or deleted since is never brought back. When a specification comes to
declare a place, the index names the documents that lost something there, and only these are read and
released again, at new positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgate.functions.labels import label_path
from feedgate.operators import merge
from feedgate.operators.gates import sized
from feedgate.operators.indexing import with_index_columns
from feedgate.operators.numbering import number_rows
from feedgate.plans.apply import Applied, Reprojected, judge
from feedgate.sources.scratch import delete, file_system, save
from feedgate.spec import FieldSpec, SpecSet

AT = [*merge.KEY, "seq"]
_RAW = "source string, collection string, id string, seq long, payload string, arrived_at timestamp, day date"
_INDEX = "source string, collection string, id string, seq long, label string, day date"


def declared_places(specs: SpecSet, collection: str) -> set[tuple[str, str]]:
    """(label, kind) of every place a collection's specification declares."""

    def walk(label: str, spec: FieldSpec) -> Iterator[tuple[str, str]]:
        yield label, spec.kind
        for name, inner in spec.allow.items():
            yield from walk(f"{label}.{name}", inner)
        if spec.items is not None:
            yield from walk(f"{label}[]", spec.items)

    if collection not in specs:
        return set()
    return {place for name, spec in specs[collection].fields.items() for place in walk(name, spec)}


def newly_declared(before: SpecSet, after: SpecSet) -> dict[str, list[str]]:
    """Per collection the labels that are declared now and were not, or were with another kind."""
    found = {name: declared_places(after, name) - declared_places(before, name) for name in after}
    return {name: sorted({label for label, _ in places}) for name, places in found.items() if places}


class RawZone:
    """Raw documents of a record table, and an index of what they lost."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, kind: str, schema: str) -> DataFrame:
        path, system = file_system(self.spark, f"{self.path}/{kind}")
        if not system.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")

    def raw(self) -> DataFrame:
        return self._read("raw", _RAW)

    def index(self) -> DataFrame:
        return self._read("index", _INDEX)

    def keep(self, applied: Applied, ops: DataFrame) -> None:
        """Keep of a run what it stored and cut: ``ops`` are the operations it was given.

        Positions and reports are short rows; they are written first and thin out the documents.
        """
        # Either side is a part of a written table, whose bytes say little of its rows: both are told the planner anew.
        stored = sized(applied.outcomes.filter("outcome = 'stored'").select("batch_id", "ord", *AT), "kept")
        lost = sized(applied.staged.filter(F.size("dropped") > 0).select("batch_id", "ord", "dropped"), "reports")
        self._write(
            sized(stored.join(lost, ["batch_id", "ord"]), "lost"),
            ops.select("batch_id", "ord", "payload", "arrived_at"),
            ["batch_id", "ord"],
        )

    def _write(self, lost: DataFrame, documents: DataFrame, on: list[str]) -> None:
        """``lost``: on, key, seq, dropped; ``documents``: on, payload, arrived_at."""
        rows = sized(lost.drop("dropped").join(documents, on), "raw").withColumn("day", F.to_date("arrived_at"))
        columns = [name.split()[0] for name in _RAW.split(", ")]
        rows.select(columns).write.mode("append").partitionBy("day").parquet(f"{self.path}/raw")
        labels = F.array_distinct(F.transform("dropped", lambda report: label_path(report["path"])))
        named = lost.select(*AT, F.explode(labels).alias("label")).join(rows.select(*AT, "day"), AT)
        # Sorted by label, so that a backfill skips the row groups of other places.
        order = ["collection", "label", "seq"]
        named = named.repartitionByRange(*order).sortWithinPartitions(*order)
        named.select([name.split()[0] for name in _INDEX.split(", ")]).write.mode("append").partitionBy("day").parquet(f"{self.path}/index")

    def expire(self, before: date) -> None:
        """Remove what was sent before a day, the index first: what it does not name is never used."""
        for kind in ("index", "raw"):
            path, system = file_system(self.spark, f"{self.path}/{kind}/day=*")
            for status in system.globStatus(path) or []:
                folder = str(status.getPath())
                if folder.rsplit("=", 1)[1] < before.isoformat():
                    delete(self.spark, folder)

    def follow(self, moves: DataFrame, specs: SpecSet) -> None:
        """Raw documents whose records were written again at new positions, kept for those as well.

        ``moves`` has the key, ``seq`` and ``new_seq``; ``specs`` is what the records were released with, by
        which what they have lost is found anew.
        """
        moved = self.raw().drop("day").join(sized(moves.select(*AT, "new_seq"), "moves"), AT)
        moved = moved.drop("seq").withColumnRenamed("new_seq", "seq").withColumn("op", F.lit("upsert"))
        judged = judge(moved, specs, max_payload_bytes=2**31 - 1)
        lost = sized(judged.filter(F.size("dropped") > 0).select(*AT, "dropped"), "lost")
        if not lost.isEmpty():
            self._write(lost, moved.select(*AT, "payload", "arrived_at"), AT)


def _named(places: dict[str, list[str]]) -> Column:
    found = F.lit(False)
    for collection, labels in places.items():
        found = found | ((F.col("collection") == collection) & F.col("label").isin(labels))
    return found


def backfill(records: DataFrame, zone: RawZone, before: SpecSet, after: SpecSet, *, start: int | None = None) -> Reprojected:
    """Records that lost something at a place ``after`` declares and ``before`` did not, released again from raw.

    Documents that the new specification refuses, and those that come out as they are, stay; the outcomes
    say so. Commit ``changes`` like any run's, then let :meth:`RawZone.follow` take :func:`moves`, so that
    the next backfill finds them.
    """
    places = newly_declared(before, after)
    alive = records.filter(F.col("deleted_at").isNull())
    lost = zone.index().filter(_named(places)).select(*AT).distinct()
    current = alive.select(*AT, F.col("content_hash").alias("_before")).join(sized(lost, "lost"), AT, "left_semi")
    current = sized(current, "current")
    raw = zone.raw().drop("day").join(current, AT).dropDuplicates(AT)
    ops = raw.select(*merge.KEY, F.lit("upsert").alias("op"), "payload", F.col("seq").alias("_seq"), "_before", F.col("arrived_at").alias("_at"))
    judged = judge(ops, after)
    same = F.col("code").isNotNull() | (F.col("content_hash") == F.col("_before"))
    columns = (*merge.KEY, "payload", "content_hash", "payload_bytes", "code", "_seq", "_at")
    staged = save(judged.withColumn("outcome", F.when(same, "unchanged").otherwise("stored")).select(*columns, "outcome"), "backfilled")
    if start is None:
        start = records.agg(F.max("seq")).first()[0] or 0
    moved = staged.filter("outcome = 'stored'")
    numbered = number_rows(moved.select(*merge.KEY, "_seq"), [F.col("_seq").asc()], "_number", "backfilled-places")
    numbered = sized(numbered.select(*merge.KEY, (F.col("_number") + start).cast("long").alias("seq")), "backfilled-seq")
    changes = moved.join(numbered, merge.KEY).select(
        *merge.KEY, "seq", "payload", "content_hash", "payload_bytes",
        F.col("_at").alias("ingested_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    outcomes = staged.select(*merge.KEY, "outcome", "code").join(numbered, merge.KEY, "left")
    none = outcomes.select("source", "collection", F.lit(0).cast("long").alias("rows")).limit(0)
    return Reprojected(records, with_index_columns(changes, after), outcomes, none)


def moves(done: Reprojected) -> DataFrame:
    """Key, old and new position of the records a reprojection or backfill wrote again."""
    new = done.outcomes.filter("outcome = 'stored'").select(*merge.KEY, F.col("seq").alias("new_seq"))
    return done.before.select(*AT).join(sized(new, "moved"), merge.KEY)
