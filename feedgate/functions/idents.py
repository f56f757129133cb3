"""Identifier grammars as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedgate.limits import MAX_ID_BYTES, MAX_NAME_BYTES


def _grade(value: Column, longest: int, bad_char: str, bad_edge: str) -> Column:
    """First violation in the order empty, too_long, char, boundary; NULL when usable."""
    return (
        F.when(value.isNull(), F.lit("missing"))
        .when(value == "", F.lit("empty"))
        .when(F.octet_length(value) > longest, F.lit("too_long"))
        .when(value.rlike(bad_char), F.lit("char"))
        .when(value.rlike(bad_edge), F.lit("boundary"))
    )


def name_error(value: Column) -> Column:
    """Sources and collections: lower-case ASCII, digits and inner ``. _ -``."""
    return _grade(value, MAX_NAME_BYTES, r"[^a-z0-9._-]", r"\A[^a-z0-9]|[^a-z0-9]\z")


def id_error(value: Column) -> Column:
    """Record ids: no control characters, no ``/ ? #``, no surrounding whitespace."""
    return _grade(
        value, MAX_ID_BYTES, r"[\p{Cc}/?#]", r"\A\p{IsWhite_Space}|\p{IsWhite_Space}\z"
    )
