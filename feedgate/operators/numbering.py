"""Dense global row numbers without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedgate.sources.scratch import save

_PART_BITS = 33


def number_rows(
    frame: DataFrame, order: list[Column], column: str, label: str, keep: list[str] | None = None
) -> DataFrame:
    """Add ``column``: 1, 2, 3 … in the given total order. ``keep`` names the columns needed afterwards.

    One range exchange puts the rows in order; the position inside a range is known when the
    sorted rows are written, and the number of earlier rows is a running sum over one row per
    range. The rows are numbered from the written table, so a lost executor cannot renumber
    them. No range depends on a key, so no key can be too hot.
    """
    ordered = (
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(*(keep or frame.columns), F.monotonically_increasing_id().alias("_at"))
    )
    saved = save(ordered, label).withColumns(
        {
            "_part": F.shiftright("_at", _PART_BITS),
            "_local": F.col("_at").bitwiseAND(2**_PART_BITS - 1),
        }
    )
    # One row per shuffle partition, whatever the size of the data.
    sizes = saved.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return saved.join(F.broadcast(offsets), "_part").select(
        *(keep or frame.columns), (F.col("_before") + F.col("_local") + 1).alias(column)
    )


def assign_sequence(outcomes: DataFrame, start: Column | int, label: str = "sequence") -> DataFrame:
    """Give every change the next feed position, in batch order; unchanged rows get none."""
    changed = F.col("outcome") != "unchanged"
    order = [(~changed).asc(), *(F.col(c).asc() for c in ("batch_seq", "batch_id", "ord"))]
    numbered = number_rows(outcomes, order, "_number", label)
    start = F.lit(start) if isinstance(start, int) else start
    return numbered.select(
        *outcomes.columns,
        F.when(changed, F.col("_number") + start).cast("long").alias("seq"),
    )
