"""Small text columns: metric labels, validators, timestamps, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_path(path: Column) -> Column:
    """``images[3].w`` becomes ``images[].w`` so that labels stay a closed set."""
    return F.regexp_replace(path, r"(?<=\[)[^\[\]]+", "")


def rfc3339(at: Column) -> Column:
    """UTC time with microseconds; the session time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def strip_weak(validator: Column) -> Column:
    return F.regexp_replace(validator, r"\AW/", "")


def digest_error(digest: Column) -> Column:
    """A digest is 64 hexadecimal characters; the length is judged before the alphabet."""
    return (
        F.when(digest.isNull(), F.lit("missing"))
        .when(F.octet_length(digest) != 64, F.lit("length"))
        .when(~digest.rlike(r"\A[0-9a-fA-F]{64}\z"), F.lit("not_hex"))
    )
