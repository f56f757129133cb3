"""Drift found by descending two trees of digests.

A listing of ``source, collection, id, content_hash`` is kept in the order of a hash of its ids, which
cuts every collection into LEAVES stretches. A stretch has a digest, and so have sixteen stretches
together, and so on up to the collection. A digest is the exclusive or of a 128-bit hash of each pair,
with their number: digests of parts merge in any order, and a change is taken out and put in the same way,
so a tree moves on with a run's changes without reading what stayed.

Two listings are compared from the top: only below nodes that differ are nodes looked at, and only the
stretches that differ in the end are read. Ids are dealt out by their hash, so stretches are alike in size.
The digests tell differences from accidents apart, not from forgery.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedgate.operators.gates import sized
from feedgate.operators.summary import COLLECTION, live

#: Levels below a collection; each node has sixteen nodes below it.
DEPTH = 3
LEAVES = 16**DEPTH
#: Leaves that share a folder of the stored listing.
_FOLDER = 256
#: Rows of a page, the least that is read of a file, however many stretches the file holds.
_PAGE_ROWS = 256
_LANES = ("x1", "x2")


def leaf_of(id: Column) -> Column:
    """The stretch an id falls into: the first bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64(id), 64 - 4 * DEPTH).cast("int")


def _pairs(listing: DataFrame) -> DataFrame:
    return listing.select(*COLLECTION, "id", "content_hash", leaf_of(F.col("id")).alias("leaf"))


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    lanes = [F.bit_xor(lane).alias(lane) for lane in _LANES]
    return rows.groupBy(*COLLECTION, *keys).agg(*lanes, F.sum("n").alias("n"))


def leaf_digests(listing: DataFrame, sign: int = 1) -> DataFrame:
    """``source, collection, leaf, x1, x2, n``; ``sign`` -1 makes the digests of what is taken out."""
    hashes = [F.xxhash64(F.lit(k), "id", "content_hash").alias(lane) for k, lane in enumerate(_LANES)]
    rows = _pairs(listing).select(*COLLECTION, "leaf", *hashes, F.lit(sign).cast("long").alias("n"))
    return _summed(rows, "leaf")


def merged(*digests: DataFrame) -> DataFrame:
    """Leaf digests of several parts as those of the whole; empty stretches go."""
    return _summed(reduce(DataFrame.unionByName, digests), "leaf").filter(F.col("n") != 0)


def moved_on(digests: DataFrame, before: DataFrame, changes: DataFrame) -> DataFrame:
    """Leaf digests after a run: ``before`` has the rows it replaced, ``changes`` those it wrote."""
    return merged(digests, leaf_digests(live(before), -1), leaf_digests(live(changes)))


class Listing:
    """A stored listing with its leaf digests: ``<path>/rows`` by stretch, ``<path>/leaves``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, listing: DataFrame, path: str) -> Listing:
        """Store a listing: one range exchange, files that each hold neighbouring stretches."""
        kept = cls(listing.sparkSession, path)
        order = ["folder", "leaf", *COLLECTION, "id"]
        rows = _pairs(listing).withColumn("folder", F.floor(F.col("leaf") / _FOLDER).cast("int"))
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("folder").option(
            "parquet.page.row.count.limit", _PAGE_ROWS
        ).parquet(f"{kept.path}/rows")
        leaf_digests(kept.rows()).write.parquet(f"{kept.path}/leaves")
        return kept

    def rows(self) -> DataFrame:
        schema = "source string, collection string, id string, content_hash string, leaf int, folder int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows")

    def leaves(self) -> DataFrame:
        schema = "source string, collection string, leaf int, x1 long, x2 long, n long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/leaves")


def differing_leaves(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``source, collection, leaf`` of the stretches whose digests differ, found from the top of both trees.

    Each level is a join of the nodes below those that differ one level up, at most LEAVES per collection.
    """
    differ: DataFrame | None = None
    for level in range(DEPTH + 1):
        width = 16 ** (DEPTH - level)
        sides = []
        for digests, lane in ((ours, "_a"), (theirs, "_b")):
            rows = digests
            if differ is not None:
                above = F.floor(F.col("leaf") / (width * 16)).cast("int")
                rows = rows.withColumn("_above", above).join(differ, [*COLLECTION, "_above"], "left_semi")
            nodes = _summed(rows.withColumn("_node", F.floor(F.col("leaf") / width).cast("int")), "_node")
            sides.append(nodes.select(*COLLECTION, "_node", F.struct(*_LANES, "n").alias(lane)))
        joined = sides[0].join(sides[1], [*COLLECTION, "_node"], "full_outer")
        found = joined.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*COLLECTION, F.col("_node").alias("_above"))
        differ = sized(found, "differing")
    return differ.withColumnRenamed("_above", "leaf")


def _within(numbers: list[int]) -> Column:
    """A filter on folder and leaf for ascending leaves, neighbours joined into one range."""
    ranges: list[list[int]] = []
    for number in numbers:
        if ranges and number == ranges[-1][1] + 1:
            ranges[-1][1] = number
        else:
            ranges.append([number, number])
    folders = sorted({number // _FOLDER for number in numbers})
    if not ranges:
        return F.lit(False)
    stretches = " OR ".join(f"leaf BETWEEN {first} AND {last}" for first, last in ranges)
    return F.expr(f"folder IN ({', '.join(map(str, folders))}) AND ({stretches})")


def tree_drift(ours: Listing, theirs: Listing) -> DataFrame:
    """What :func:`~feedgate.operators.summary.drift_report` finds, reading only stretches that differ.

    Their numbers, of which there are at most LEAVES however large the listings are, become ranges that
    skip the folders and row groups of all others.
    """
    differ = differing_leaves(ours.leaves(), theirs.leaves())
    wanted = _within(sorted(row[0] for row in differ.select("leaf").distinct().collect()))

    def read(listing: Listing, name: str) -> DataFrame:
        rows = listing.rows().filter(wanted)
        rows = rows.join(differ, [*COLLECTION, "leaf"], "left_semi")
        return rows.select(*COLLECTION, "id", F.col("content_hash").alias(name))

    joined = read(ours, "_ours").join(read(theirs, "_theirs"), [*COLLECTION, "id"], "full_outer")
    drift = (
        F.when(F.col("_ours").isNull(), "missing")
        .when(F.col("_theirs").isNull(), "extra")
        .when(F.col("_ours") != F.col("_theirs"), "changed")
    )
    return joined.select(*COLLECTION, "id", drift.alias("drift")).filter(F.col("drift").isNotNull())
