"""Totals by label: dropped fields and ingest outcomes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from feedgate.functions.labels import label_path
from feedgate.operators.gates import OPERATION_RANK


def dropped_totals(judged: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Dropped fields by collection, field and reason.

    Operations are counted as they are prepared. A batch refused as a whole is never prepared;
    one refused for an operation is counted up to that operation, which itself counts only if
    its payload was released before it failed.
    """
    if refused is not None:
        verdicts = refused.select("batch_id", F.col("ord").alias("_stop"), F.col("rank").alias("_rank"))
        judged = judged.join(verdicts, "batch_id", "left")
        prepared = F.col("_rank").isNull() | (
            (F.col("_rank") == OPERATION_RANK) & (F.col("ord") <= F.col("_stop"))
        )
        reached = F.col("code").isNull() | (F.col("code") == "payload_too_large")
        judged = judged.filter(prepared & reached)
    fields = judged.select("collection", F.explode_outer("dropped").alias("_report"))
    return fields.filter(F.col("_report").isNotNull()).groupBy(
        "collection",
        label_path(F.col("_report.path")).alias("field"),
        F.col("_report.reason").alias("reason"),
    ).agg(F.count(F.lit(1)).alias("total"))


#: The outcomes an accepted operation can have.
OUTCOMES = ("stored", "unchanged", "tombstoned")
TOTALS = "collection string, outcome string, total long"


class OutcomeCounter:
    """Outcomes by collection, counted while the rows that are watched are written, without a pass of their own.

    Counts are taken in the tasks that write. Each partition is written by one successful task, so one that is
    run again after a loss is not counted twice, as long as no exchange stands between ``watch`` and the write.
    There are three numbers for each collection named; rows of others are not counted.
    """

    def __init__(self, collections: Iterable[str]):
        self._labels = [(collection, outcome) for collection in sorted(collections) for outcome in OUTCOMES]
        self._observed = Observation()

    def watch(self, outcomes: DataFrame) -> DataFrame:
        """The same rows; to be written once."""
        counts = [
            F.count_if((F.col("collection") == collection) & (F.col("outcome") == outcome)).alias(f"n{i}")
            for i, (collection, outcome) in enumerate(self._labels)
        ]
        return outcomes.observe(self._observed, F.count(F.lit(1)).alias("rows"), *counts)

    def totals(self) -> list[tuple[str, str, int]]:
        """Collection, outcome and number of rows where there are any, once the rows have been written."""
        found = self._observed.get
        counted = [(*label, found.get(f"n{i}", 0)) for i, label in enumerate(self._labels)]
        return [row for row in counted if row[2]]


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("collection", "outcome").agg(F.count(F.lit(1)).alias("total"))
