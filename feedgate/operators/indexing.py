"""Typed columns for filterable fields, so that filters reach the parquet scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgate.spec import CollectionSpec, FieldSpec, SpecSet

_TYPES = {"string": "string", "scalar": "string", "number": "double", "boolean": "boolean"}


_PLAIN = re.compile(r"[a-z][a-z0-9_]*")


def index_column(name: str, spec: FieldSpec) -> str:
    """A column name no other field has, in any letter case; field names are case-sensitive and free.

    Names that are not plain go in as hex behind an underscore, with which no plain name begins.
    """
    return f"idx_{spec.kind}_{name if _PLAIN.fullmatch(name) else '_' + name.encode().hex()}"


def index_value(name: str, spec: FieldSpec, document: Column, kind: str | None = None) -> Column:
    """A top-level member of a parsed payload as a typed value."""
    if re.search(r"[\"'\\\[\]]", name):  # no path can hold these
        member = F.try_element_at(F.try_variant_get(document, "$", "map<string,variant>"), F.lit(name))
    else:
        member = F.try_variant_get(document, f'$["{name}"]', "variant")
    value = F.try_variant_get(member, "$", kind or _TYPES[spec.kind])
    if spec.kind in ("string", "scalar"):
        # Filters on untyped scalars compare text with text.
        return F.when(F.schema_of_variant(member) == "STRING", value)
    return value


def index_columns(specs: SpecSet | CollectionSpec, document: Column) -> dict[str, Column]:
    specs = [specs] if isinstance(specs, CollectionSpec) else specs.values()
    found: dict[str, Column] = {}
    for spec in specs:
        for name, field in spec.indexed_fields.items():
            found[index_column(name, field)] = index_value(name, field, document)
    return found


def with_index_columns(records: DataFrame, specs: SpecSet | CollectionSpec) -> DataFrame:
    """Add one typed column per indexed field, parsing each payload once."""
    columns = index_columns(specs, F.col("_doc"))
    if not columns:
        return records
    parsed = records.withColumn("_doc", F.try_parse_json("payload"))
    return parsed.withColumns(columns).drop("_doc")
