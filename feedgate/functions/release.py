"""Whole documents in columns: what is one, and which need the exact treatment.

Documents arrive as JSON text and are parsed into a VARIANT. Texts whose parsed form may have lost
what the strict rules look at go to :mod:`feedgate.functions.exact`, as do all that are released.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedgate.limits import MAX_JSON_DEPTH


def parsed(text: Column) -> Column:
    """VARIANT ``[document, checksum]``; see :func:`well_formed`."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text), F.lit("]")))


def well_formed(pair: Column, text: Column) -> Column:
    """Whether the text is exactly one JSON value.

    The parser ignores anything after the first value. Inside brackets and followed by a
    checksum of itself, trailing text either breaks the syntax or displaces the checksum.
    """
    return F.coalesce(
        F.try_variant_get(pair, "$[1]", "bigint").eqNullSafe(F.xxhash64(text))
        & F.try_variant_get(pair, "$[2]", "variant").isNull(),
        F.lit(False),
    )


def suspicious(text: Column) -> Column:
    """Text whose parsed form may have lost what the strict rules look at."""
    lone = (
        r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"
        r"|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F]"
    )
    brackets = F.length(text) - F.length(F.translate(text, "[{", ""))
    return (
        (text.contains("\\u") & text.rlike(lone))
        | F.when(brackets >= MAX_JSON_DEPTH, _nesting(text) >= MAX_JSON_DEPTH).otherwise(False)
        | text.rlike(r"[0-9](?:[eE]\+?[0-9]{3}|[0-9]{299})")
    )


def _nesting(text: Column) -> Column:
    """How deep the brackets of well-formed JSON go, those inside strings left out."""
    outside = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "")
    brackets = F.split(F.regexp_replace(outside, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(depth: Column, bracket: Column) -> Column:
        now = depth["now"] + F.when(bracket.isin("[", "{"), 1).when(bracket.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(depth["most"], now).alias("most"))

    return F.aggregate(brackets, start, step, lambda depth: depth["most"])
