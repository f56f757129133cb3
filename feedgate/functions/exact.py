"""What documents are cut down to, decided one by one inside an Arrow UDF.

A specification becomes a tree of short functions that give the canonical text of what they keep,
so that no document is put together again. Fingerprints hand over only the documents the native
columns cannot vouch for: numbers that Spark prints differently from the canonical form, unusual
escapes, unusual depth, or text that is not JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from json.encoder import encode_basestring

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from feedgate.limits import MAX_JSON_DEPTH
from feedgate.spec import CollectionSpec, FieldSpec, SpecSet

_I64_MIN, _U64_MAX = -(2**63), 2**64 - 1


class Refused(ValueError):
    """Text that is not one acceptable JSON value."""


def number_text(value: int | float) -> str:
    """Integers in decimal; doubles as ECMAScript prints them."""
    if isinstance(value, int):
        return str(value)
    if value == 0:
        return "0"
    mantissa, _, exponent = f"{abs(value)!r}".partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0)
    if whole == "0":
        point = int(exponent or 0) - (len(fraction) - len(fraction.lstrip("0")))
    digits = digits.rstrip("0")
    size = len(digits)
    if size <= point <= 21:
        text = digits + "0" * (point - size)
    elif 0 < point <= 21:
        text = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        power = point - 1
        text = digits[0] + ("." + digits[1:] if size > 1 else "")
        text += f"e{'+' if power > 0 else '-'}{abs(power)}"
    return "-" + text if value < 0 else text


def canonical(value) -> str:
    """RFC 8785 text of a parsed JSON value."""
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda key: key.encode("utf-16-be"))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"


def _integer(digits: str) -> int | float:
    value = int(digits) if len(digits) < 25 else None
    if value is None or not _I64_MIN <= value <= _U64_MAX or digits == "-0":
        return _real(digits)
    return value


def _real(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise Refused("number out of range")
    return value


def _constant(name: str):
    raise Refused(name)


_DECODER = json.JSONDecoder(parse_int=_integer, parse_float=_real, parse_constant=_constant)


def parse(text: str):
    """Strict parse: finite numbers, whole characters, bounded depth."""
    try:
        value = _DECODER.decode(text)
        # Plain characters cannot be halves, and few brackets cannot be deep.
        if "\\u" in text or not text.isascii() or text.count("[") + text.count("{") >= MAX_JSON_DEPTH:
            _check(value, 0)
        return value
    except (ValueError, RecursionError) as error:
        raise Refused(str(error)) from error


def _check(value, depth: int) -> None:
    if isinstance(value, str):
        value.encode("utf-8")  # a lone surrogate raises
    elif isinstance(value, (list, dict)):
        if depth >= MAX_JSON_DEPTH:
            raise Refused("nested too deeply")
        if isinstance(value, dict):
            for key in value:
                key.encode("utf-8")
            value = value.values()
        for child in value:
            _check(child, depth + 1)


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


# What a place keeps of a value at a path: its canonical text, or None with a report of why not.
Keep = Callable[[object, str, list], "str | None"]
_TEXTS = {
    str: encode_basestring,
    int: str,
    float: number_text,
    bool: {True: "true", False: "false"}.__getitem__,
    type(None): lambda _: "null",
}
_FITS = {"string": {str}, "number": {int, float}, "boolean": {bool}, "scalar": set(_TEXTS), "array": {list}, "object": {dict}}


def _keeper(spec: FieldSpec) -> Keep:
    kind, fits = spec.kind, _FITS[spec.kind]
    if kind == "object":
        members = _members(spec.allow)
    elif kind == "array":
        items = _keeper(spec.items)

    def keep(value, path: str, report: list) -> str | None:
        if type(value) not in fits:
            report.append((path, "type_mismatch", kind, kind_of(value)))
            return None
        if kind == "object":
            return members(value, path + ".", report)
        if kind == "array":
            kept = [items(item, f"{path}[{at}]", report) for at, item in enumerate(value)]
            return "[" + ",".join([text for text in kept if text is not None]) + "]"
        return _TEXTS[type(value)](value)

    return keep


def _members(allow) -> Keep:
    keepers = {name: _keeper(spec) for name, spec in allow.items()}
    # Reports are in the order of characters, payloads in that of UTF-16 code units.
    labels = [(name, encode_basestring(name) + ":") for name in sorted(allow, key=lambda name: name.encode("utf-16-be"))]

    def keep(members, prefix: str, report: list) -> str:
        kept = {}
        for key in sorted(members):
            keeper = keepers.get(key)
            if keeper is None:
                report.append((prefix + key, "unknown_key", None, None))
            else:
                kept[key] = keeper(members[key], prefix + key, report)
        return "{" + ",".join([label + kept[name] for name, label in labels if kept.get(name) is not None]) + "}"

    return keep


def decider(spec: CollectionSpec) -> Callable[[str], tuple]:
    """State, id, canonical payload and report of one document, as a function of its text."""
    members, id_path = _members(spec.fields), spec.id_path

    def decide(text: str) -> tuple:
        try:
            document = parse(text)
        except Refused:
            return "invalid", None, None, None
        at = document
        for segment in id_path:
            at = at.get(segment) if isinstance(at, dict) else None
        doc_id = at if isinstance(at, str) else None
        if isinstance(at, int) and not isinstance(at, bool):
            doc_id = str(at)
        if not isinstance(document, dict):
            return kind_of(document), doc_id, None, None
        report: list = []
        return "object", doc_id, members(document, "", report), report

    return decide


_REPORT = ("path", "reason", "expected", "found")
RELEASED_TYPE = (
    "state string, doc_id string, payload string, "
    "dropped array<struct<path:string,reason:string,expected:string,found:string>>"
)


def released(specs: SpecSet, collection: Column, text: Column) -> Column:
    """Struct of :data:`RELEASED_TYPE`, its fields NULL where the text is or no specification covers it."""
    by_name = dict(specs)
    deciders: dict[str, Callable[[str], tuple]] = {}

    def run(names: pa.Array, texts: pa.Array) -> pa.Array:
        columns: tuple[list, list, list] = ([], [], [])
        offsets, reports = [], []
        for name, value in zip(names.to_pylist(), texts.to_pylist()):
            report = None
            if value is None or name not in by_name:
                row = (None, None, None)
            else:
                decide = deciders.get(name) or deciders.setdefault(name, decider(by_name[name]))
                *row, report = decide(value)
            for column, cell in zip(columns, row):
                column.append(cell)
            offsets.append(None if report is None else len(reports))
            reports.extend(report or ())
        offsets.append(len(reports))
        places = zip(*reports) if reports else [()] * len(_REPORT)
        entries = pa.StructArray.from_arrays([pa.array(place, pa.string()) for place in places], list(_REPORT))
        dropped = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
        parts = [*(pa.array(column, pa.string()) for column in columns), dropped]
        return pa.StructArray.from_arrays(parts, ["state", "doc_id", "payload", "dropped"])

    # Marked so that the optimizer does not copy it, and all it depends on, into filters.
    return F.arrow_udf(run, RELEASED_TYPE).asNondeterministic()(collection, text)


def exact_text(text: Column, needed: Column) -> Column:
    """Canonical text of the documents where ``needed`` holds, NULL elsewhere and for what is no document."""

    def fingerprinted(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(parse(text))
        except Refused:
            return None

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprinted(text) for text in texts], dtype=object)

    # Marked so that the optimizer does not copy it, and all it depends on, into filters.
    return F.pandas_udf(run, "string").asNondeterministic()(F.when(needed, text))
