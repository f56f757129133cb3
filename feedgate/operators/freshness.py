"""Validators: telling a consumer that nothing it holds has changed."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgate.functions.exact import canonical
from feedgate.functions.labels import strip_weak
from feedgate.limits import clamp_records
from feedgate.operators.summary import COLLECTION, max_positions


def _quoted(*parts: Column) -> Column:
    return F.concat(F.lit('"'), F.concat_ws(".", *parts), F.lit('"'))


def _paged(kind: str, max_seq: Column, cursor: Column, limit: int | None) -> list[Column]:
    return [
        F.lit(kind),
        F.coalesce(max_seq, F.lit(0)).cast("string"),
        F.coalesce(cursor, F.lit(0)).cast("string"),
        F.lit(str(clamp_records(limit))),
    ]


def listing_validator(
    max_seq: Column, cursor: Column, limit: int | None = None, chosen: dict | None = None
) -> Column:
    """``l.position.cursor.limit``, and a fingerprint of the filter if there is one."""
    parts = _paged("l", max_seq, cursor, limit)
    if chosen:
        parts.append(F.lit(hashlib.sha256(canonical(chosen).encode()).hexdigest()[:16]))
    return _quoted(*parts)


def changes_validator(max_seq: Column, cursor: Column, limit: int | None = None) -> Column:
    return _quoted(*_paged("c", max_seq, cursor, limit))


def manifest_validator(max_seq: Column) -> Column:
    return _quoted(F.lit("m"), F.coalesce(max_seq, F.lit(0)).cast("string"))


def record_validator(content_hash: Column) -> Column:
    return _quoted(content_hash)


def is_fresh(held: Column, current: Column) -> Column:
    """Weak comparison of a held list of validators, or ``*``, with the current one."""
    candidates = F.split(held, ",")
    wanted = strip_weak(current)
    match = F.exists(
        candidates,
        lambda c: (F.regexp_replace(c, r"\A\s+|\s+\z", "") == "*")
        | (strip_weak(F.regexp_replace(c, r"\A\s+|\s+\z", "")) == wanted),
    )
    return F.coalesce(match, F.lit(False))


def collection_validators(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Current validators of every collection's first page, first change page and manifest."""
    seq, start = F.col("max_seq"), F.lit(0)
    return max_positions(records).select(
        *COLLECTION,
        "max_seq",
        listing_validator(seq, start, limit).alias("listing"),
        changes_validator(seq, start, limit).alias("changes"),
        manifest_validator(seq).alias("manifest"),
    )


def stale_views(held: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``held`` (key columns, ``held``) whose view has to be read again.

    ``current`` has the same key columns and ``validator``. A view that no longer exists is
    stale as well.
    """
    keys = [c for c in held.columns if c in current.columns]
    joined = held.join(current, keys, "left")
    gone = F.col("validator").isNull()
    return joined.filter(gone | ~is_fresh(F.col("held"), F.col("validator"))).select(
        *held.columns, "validator"
    )
