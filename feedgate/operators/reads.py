"""Keyed lookups, filtered listings, the change feed and digest pages."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedgate.limits import clamp_bytes, clamp_records
from feedgate.operators.gates import sized
from feedgate.operators.indexing import index_column, index_value
from feedgate.operators.summary import COLLECTION, live
from feedgate.spec import CollectionSpec, SpecError, check_field_name

KEY = [*COLLECTION, "id"]


class FilterError(ValueError):
    """A filter the collection does not offer; ``reason`` says which rule it breaks."""

    def __init__(self, reason: str, field: str):
        super().__init__(f"{field}: {reason}")
        self.reason, self.field = reason, field


_INTEGER = re.compile(r"[+-]?[0-9]+")
_REAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def _coerce(field: str, kind: str, text: str):
    if kind in ("string", "scalar"):
        return text
    if kind == "boolean":
        if text in ("true", "false"):
            return text == "true"
    elif kind == "number":
        if _INTEGER.fullmatch(text) and -(2**63) <= int(text) < 2**63:
            return int(text)
        if _REAL.fullmatch(text) and math.isfinite(float(text)):
            return float(text)
    raise FilterError("wrong_type", field)


def parse_filter(spec: CollectionSpec, pairs: Iterable[tuple[str, str]]) -> dict:
    """Field/value pairs as typed values; only declared filters, each at most once."""
    chosen: dict = {}
    for field, text in pairs:
        try:
            check_field_name(field)
        except SpecError:
            raise FilterError("unknown_field", field) from None
        if field not in spec.fields:
            raise FilterError("unknown_field", field)
        if field not in spec.filters:
            raise FilterError("not_filterable", field)
        value = _coerce(field, spec.fields[field].kind, text)
        if field in chosen:
            raise FilterError("duplicate", field)
        chosen[field] = value
    return dict(sorted(chosen.items()))


def filter_column(spec: CollectionSpec, chosen: dict, columns: Iterable[str]) -> Column:
    """All chosen values must match; typed index columns are used where the table has them."""
    condition = F.lit(True)
    for field, value in chosen.items():
        node = spec.fields[field]
        name = index_column(field, node)
        own = F.col(f"`{name}`") if name in columns else index_value(
            field, node, F.try_parse_json("payload")
        )
        condition = condition & (own == F.lit(float(value) if node.kind == "number" else value))
        if isinstance(value, int) and abs(value) >= 2**53:
            exact = index_value(field, node, F.try_parse_json("payload"), "decimal(38,0)")
            condition = condition & exact.eqNullSafe(F.lit(str(int(value))).cast("decimal(38,0)"))
    return condition


def lookup(records: DataFrame, source: str, collection: str, id: str, served: bool = True) -> DataFrame:
    """One record. The served view hides tombstones, the stored view does not."""
    rows = live(records) if served else records
    return rows.filter(
        (F.col("source") == source) & (F.col("collection") == collection) & (F.col("id") == id)
    )


def lookup_many(records: DataFrame, keys: DataFrame, served: bool = True) -> DataFrame:
    """The records of a key table; a small key table is broadcast, so records stay in place."""
    rows = live(records) if served else records
    return rows.join(sized(keys.select(*KEY).distinct()), KEY, "left_semi")


def listing(
    records: DataFrame,
    spec: CollectionSpec,
    source: str,
    filters: Iterable[tuple[str, str]] = (),
    after: int | None = None,
    limit: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One page of a collection in feed order, tombstones left out."""
    chosen = parse_filter(spec, filters)
    rows = live(records).filter(
        (F.col("source") == source) & (F.col("collection") == spec.collection)
    )
    rows = rows.filter(filter_column(spec, chosen, records.columns))
    return _page(rows, after, limit, max_bytes)


def sorted_listing(
    records: DataFrame,
    spec: CollectionSpec,
    source: str,
    field: str,
    filters: Iterable[tuple[str, str]] = (),
    after: tuple[str | float | bool, int] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One page of live rows by a field declared for sorting, then by position; rows without it go last.

    ``after`` is the value and position of the last row seen, from ``next_value`` and ``next_cursor``,
    which are set on a full page.
    """
    if field not in spec.sort or field == "seq":
        raise FilterError("not_sortable", field)
    name = index_column(field, spec.fields[field])
    value = F.col(name) if name in records.columns else index_value(field, spec.fields[field], F.try_parse_json("payload"))
    rows = live(records).filter((F.col("source") == source) & (F.col("collection") == spec.collection))
    rows = rows.filter(filter_column(spec, parse_filter(spec, filters), records.columns)).withColumn("_value", value)
    if after is not None:
        last, seq = F.lit(after[0]), F.lit(after[1])
        missing = F.col("_value").isNull()
        if after[0] is None:
            rows = rows.filter(missing & (F.col("seq") > seq))
        else:
            rows = rows.filter(missing | (F.col("_value") > last) | ((F.col("_value") == last) & (F.col("seq") > seq)))
    size = clamp_records(limit)
    page = rows.orderBy(F.col("_value").asc_nulls_last(), "seq").limit(size)
    whole = Window.partitionBy(*COLLECTION)
    ends = F.max(F.struct(F.col("_value").isNull().alias("none"), F.col("_value").alias("value"), F.col("seq").alias("seq")))
    page = page.withColumns({"_end": ends.over(whole), "_full": F.count(F.lit(1)).over(whole) == size})
    return page.withColumns(
        {"next_value": F.when(F.col("_full"), F.col("_end.value")), "next_cursor": F.when(F.col("_full"), F.col("_end.seq"))}
    ).drop("_value", "_end", "_full")


def changes(
    records: DataFrame,
    spec: CollectionSpec,
    source: str,
    since: int | None = None,
    limit: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """One page of the change feed: newest state per record, tombstones included."""
    rows = records.filter(
        (F.col("source") == source) & (F.col("collection") == spec.collection)
    )
    return _page(rows, since, limit, max_bytes)


def _page(rows: DataFrame, after: int | None, limit: int | None, max_bytes: int | None) -> DataFrame:
    size = clamp_records(limit)
    page = rows.filter(F.col("seq") > (after or 0)).orderBy("seq").limit(size)
    return cut_pages(page, size, clamp_bytes(max_bytes))


def first_pages(
    rows: DataFrame,
    limit: int | None = None,
    max_bytes: int | None = None,
    cursors: DataFrame | None = None,
) -> DataFrame:
    """The next page of every collection at once, each after its own cursor.

    ``cursors`` has ``source, collection, cursor``. Short rows are ranked, the limit being applied
    before the exchange as well as after it; then only the rows of the pages are fetched whole.
    """
    size = clamp_records(limit)
    if cursors is not None:
        rows = rows.join(sized(cursors), COLLECTION, "left").filter(
            F.col("seq") > F.coalesce("cursor", F.lit(0))
        ).drop("cursor")
    rank = F.row_number().over(Window.partitionBy(*COLLECTION).orderBy("seq"))
    short = rows.select(*COLLECTION, "seq", "payload_bytes")
    page = short.withColumn("_rank", rank).filter(F.col("_rank") <= size).drop("_rank")
    kept = sized(cut_pages(page, size, clamp_bytes(max_bytes)).drop("payload_bytes"), "page")
    return rows.join(kept, [*COLLECTION, "seq"]).select(*rows.columns, "next_cursor")


def cut_pages(page: DataFrame, size: int, budget: int) -> DataFrame:
    """Spend the byte budget on at most ``size`` rows per collection; add ``next_cursor``.

    The first row always stays. A cursor is offered if the page is full or was cut.
    """
    in_order = Window.partitionBy(*COLLECTION).orderBy("seq")
    whole = Window.partitionBy(*COLLECTION)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.col("_at") == 1) | (F.col("_spent") <= budget)
    measured = page.withColumns(
        {
            "_at": F.row_number().over(in_order),
            "_spent": F.sum(F.col("payload_bytes").cast("long")).over(so_far),
            "_rows": F.count(F.lit(1)).over(whole),
        }
    )
    more = (F.col("_rows") == size) | (F.col("_kept") < F.col("_rows"))
    return (
        measured.filter(fits)
        .withColumns({"_kept": F.count(F.lit(1)).over(whole), "_end": F.max("seq").over(whole)})
        .withColumn("next_cursor", F.when(more, F.col("_end")))
        .drop("_at", "_spent", "_rows", "_kept", "_end")
    )


def digest_page(
    records: DataFrame,
    source: str,
    collection: str,
    after: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Live ``id, content_hash`` in id order; ``next_cursor`` is set only if the page is full."""
    size = clamp_records(limit)
    rows = live(records).filter(
        (F.col("source") == source) & (F.col("collection") == collection)
    )
    page = rows.filter(F.col("id") > (after or "")).orderBy("id").limit(size)
    whole = Window.partitionBy(*COLLECTION)
    full = F.count(F.lit(1)).over(whole) == size
    return page.select(
        *COLLECTION, "id", "content_hash", F.when(full, F.max("id").over(whole)).alias("next_cursor")
    )


def first_digest_pages(
    records: DataFrame, limit: int | None = None, cursors: DataFrame | None = None
) -> DataFrame:
    """The next digest page of every collection at once, each after its own cursor, if it has one.

    ``cursors`` has ``source, collection, after``.
    """
    size = clamp_records(limit)
    rows = live(records).select(*COLLECTION, "id", "content_hash")
    if cursors is not None:
        rows = rows.join(sized(cursors, "cursors"), COLLECTION, "left").filter(
            F.col("id") > F.coalesce("after", F.lit(""))
        ).drop("after")
    rank = F.row_number().over(Window.partitionBy(*COLLECTION).orderBy("id"))
    page = rows.withColumn("_rank", rank).filter(F.col("_rank") <= size)
    whole = Window.partitionBy(*COLLECTION)
    full = F.count(F.lit(1)).over(whole) == size
    return page.withColumn("next_cursor", F.when(full, F.max("id").over(whole))).drop("_rank")
