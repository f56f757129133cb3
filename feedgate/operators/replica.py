"""Folding a change feed into a consumer's own copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgate.operators.gates import sized
from feedgate.operators.merge import KEY


def newest(changes: DataFrame) -> DataFrame:
    """The newest change per key, once.

    Which position is newest is an aggregate of short rows; the rows themselves are only filtered by
    it. The short table is written first, so that a small one is broadcast.
    """
    places = changes.groupBy(*KEY, "seq").agg(F.count(F.lit(1)).alias("_n"))
    latest = places.groupBy(*KEY).agg(F.max(F.struct("seq", "_n")).alias("_last")).select(*KEY, "_last.*")
    latest = sized(latest, "newest")
    at = [*KEY, "seq"]
    once = changes.join(latest.filter(F.col("_n") == 1), at, "left_semi")
    repeated = latest.filter(F.col("_n") > 1)
    if repeated.isEmpty():
        return once
    return once.unionByName(changes.join(repeated, at, "left_semi").dropDuplicates(KEY))


def fold_feed(replica: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The replica after a stretch of the feed: newest position wins, deletions remove.

    Replayed or late stretches do no harm, because an older position never replaces a newer one.
    Rows of keys the stretch does not mention are not moved when it mentions few keys.
    """
    if replica is None:
        return newest(changes).filter(F.col("deleted_at").isNull())
    keys = sized(changes.select(*KEY).distinct(), "mentioned")
    untouched = replica.join(keys, KEY, "left_anti")
    met = replica.join(keys, KEY, "left_semi")
    folded = newest(met.unionByName(changes, allowMissingColumns=True))
    return untouched.unionByName(
        folded.filter(F.col("deleted_at").isNull()), allowMissingColumns=True
    )
