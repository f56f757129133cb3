"""Cutting whole collections into pages, in parallel.

A page ends where the record count or the byte budget is used up, so where it starts depends
on every page before it. But a page never holds more than ``limit`` records. A collection is
therefore cut into blocks of fixed size, and each block works out, for each of the ``limit`` places where a
page might enter it, where that run of pages enters the next block. These short tables are
composed, GROUP blocks at a time, up a tree; going down again, each group's entry gives the
entries of its members, and in the end each block has its real one. A second pass over the blocks
then cuts the pages. No task ever holds more than a block of rows or GROUP tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedgate.limits import clamp_bytes, clamp_records
from feedgate.operators.gates import sized
from feedgate.operators.numbering import number_rows
from feedgate.operators.summary import COLLECTION
from feedgate.sources.scratch import save

BLOCK_ROWS = 131_072
# Tables that are composed in one step.
GROUP = 64


def _next_starts(sizes: np.ndarray, limit: int, budget: int) -> np.ndarray:
    """For a page starting at each row, the row the following page starts at."""
    spent = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    rows = np.arange(len(sizes))
    by_bytes = np.searchsorted(spent, spent[:-1] + budget, side="right") - 1
    return np.minimum(np.maximum(by_bytes, rows + 1), rows + limit)


def _exits(sizes: np.ndarray, own: int, limit: int, budget: int) -> list[int]:
    """Where a run of pages entering at each of the first ``limit`` rows enters the next block."""
    target = _next_starts(sizes, limit, budget)[:own]
    while (inside := target < own).any():
        target = np.where(inside, target[np.minimum(target, own - 1)], target)
    leaves = (target - own).tolist()
    return (leaves[:limit] + [entry - own for entry in range(own, limit)])[:limit]


def _opening(following: np.ndarray, own: int, entry: int) -> np.ndarray:
    """Which of the block's own rows open a page, given the first that does."""
    jump = np.append(np.minimum(following[:own], own), own)
    opens = np.zeros(own + 1, bool)
    opens[min(entry, own)] = True
    while True:  # doubles the number of pages that are followed
        opens[jump[np.flatnonzero(opens)]] = True
        if (jump == own).all():
            return opens[:own]
        jump = jump[jump]


def page_walk(
    rows: DataFrame,
    limit: int | None = None,
    max_bytes: int | None = None,
    block_rows: int = BLOCK_ROWS,
    group: int = GROUP,
) -> DataFrame:
    """The page every row is served on when each collection is walked to its end.

    Returns ``source, collection, seq, payload_bytes, page``, pages counted from 1. Give it live rows for a
    listing, or all rows for the change feed.
    """
    limit, budget = clamp_records(limit), clamp_bytes(max_bytes)
    slim = rows.select(*COLLECTION, "seq", F.col("payload_bytes").cast("long").alias("_size"))
    order = [F.col(c).asc() for c in (*COLLECTION, "seq")]
    numbered = number_rows(slim, order, "_n", "walk")
    bounds = sized(numbered.groupBy(*COLLECTION).agg(F.min("_n").alias("_first")))
    # A block holds at least a page, so an overhang reaches only into the block that follows.
    width = F.lit(max(block_rows, limit)).cast("long")
    place = F.col("_n") - F.col("_first")
    placed = numbered.join(bounds, COLLECTION).select(
        *COLLECTION,
        "seq",
        "_size",
        F.floor(place / width).alias("_block"),
        (place % width).alias("_at"),
    )
    overhang = placed.filter((F.col("_block") > 0) & (F.col("_at") < limit)).withColumns(
        {"_block": F.col("_block") - 1, "_own": F.lit(False)}
    )
    blocks = save(placed.withColumn("_own", F.lit(True)).unionByName(overhang), "walk-blocks")

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        own = int(pdf["_own"].sum())
        first = pdf.iloc[0]
        table = _exits(pdf["_size"].to_numpy(), own, limit, budget)
        return pd.DataFrame(
            {"source": [first["source"]], "collection": [first["collection"]],
             "_block": [first["_block"]], "_exits": [table]}
        )

    grouped = blocks.groupBy(*COLLECTION, "_block")
    tables = grouped.applyInPandas(
        exits, "source string, collection string, _block long, _exits array<int>"
    )
    entered = blocks.join(_entries(save(tables, "walk-tables"), group), [*COLLECTION, "_block"])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        own = int(pdf["_own"].sum())
        following = _next_starts(pdf["_size"].to_numpy(), limit, budget)
        opens = np.zeros(len(pdf), dtype=np.int64)
        opens[:own] = _opening(following, own, int(pdf["_entry"].iloc[0]))
        pdf = pdf.assign(_opened=np.cumsum(opens))
        return pdf.loc[pdf["_own"], ["source", "collection", "_block", "seq", "_size", "_opened"]]

    opened = save(
        entered.groupBy(*COLLECTION, "_block").applyInPandas(
            cut,
            "source string, collection string, _block long, seq long, _size long, _opened long",
        ),
        "walk-pages",
    )
    per_block = opened.groupBy(*COLLECTION, "_block").agg(F.max("_opened").alias("_pages"))
    before = Window.partitionBy(*COLLECTION).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = per_block.select(
        *COLLECTION, "_block", F.coalesce(F.sum("_pages").over(before), F.lit(0)).alias("_earlier")
    )
    return opened.join(sized(earlier), [*COLLECTION, "_block"]).select(
        *COLLECTION,
        "seq",
        F.col("_size").alias("payload_bytes"),
        (F.col("_earlier") + F.col("_opened")).alias("page"),
    )


def _entries(tables: DataFrame, group: int) -> DataFrame:
    """``source, collection, _block, _entry``: where the walk enters each block."""
    kind = "source string, collection string, _block long, "
    levels = [tables]
    while (levels[-1].agg(F.max("_block")).first()[0] or 0) > 0:
        above = levels[-1].withColumn("_group", F.floor(F.col("_block") / group))
        composed = above.groupBy(*COLLECTION, "_group").applyInPandas(_composed, kind + "_exits array<int>")
        levels.append(save(composed, "walk-composed"))
    known = levels[-1].select(*COLLECTION, "_block", F.lit(0).cast("long").alias("_entry"))
    for below in reversed(levels[:-1]):
        at = known.select(*COLLECTION, F.col("_block").alias("_group"), "_entry")
        members = below.withColumn("_group", F.floor(F.col("_block") / group)).join(at, [*COLLECTION, "_group"])
        known = save(members.groupBy(*COLLECTION, "_group").applyInPandas(_descended, kind + "_entry long"), "walk-entries")
    return known


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_block")
    whole = None
    for table in pdf["_exits"]:
        table = np.asarray(table)
        whole = table if whole is None else table[whole]
    first = pdf.iloc[0]
    return pd.DataFrame(
        {"source": [first["source"]], "collection": [first["collection"]], "_block": [first["_group"]], "_exits": [whole.tolist()]}
    )


def _descended(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_block")
    at, found = int(pdf["_entry"].iloc[0]), []
    for table in pdf["_exits"]:
        found.append(at)
        at = int(table[at])
    return pdf[["source", "collection", "_block"]].assign(_entry=found)


def page_summary(
    rows: DataFrame,
    limit: int | None = None,
    max_bytes: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per page: its records, bytes, span and the cursor that leads on from it."""
    pages = page_walk(rows, limit, max_bytes, block_rows)
    per_page = pages.groupBy(*COLLECTION, "page").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("payload_bytes").alias("bytes"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )
    last = sized(per_page.groupBy(*COLLECTION).agg(F.max("page").alias("_last")))
    more = (F.col("page") < F.col("_last")) | (F.col("records") == clamp_records(limit))
    return (
        per_page.join(last, COLLECTION)
        .withColumn("next_cursor", F.when(more, F.col("last_seq")))
        .drop("_last")
    )
