"""Sequential models, written from the rules: of the release, and of the record table."""

import hashlib
import json
import re
from decimal import Decimal

KINDS = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}


class Refused(ValueError):
    """A text that is not one sound JSON document."""


def number(value):
    """The shortest text of a number in plain or exponent form, as scripts in browsers print it."""
    if isinstance(value, int) and -(2**63) <= value < 2**64:
        return str(value)
    value = float(value)
    if value == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text, point = "".join(map(str, digits)), len(digits) + exponent
    if 0 < point <= 21:
        body = text.ljust(point, "0")[:point] + ("." + text[point:] if len(text) > point else "")
    elif -6 < point <= 0:
        body = "0." + "0" * -point + text
    else:
        body = text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + body


def written(value):
    """Canonical JSON: keys by UTF-16, no spaces, few escapes."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{written(k)}:{written(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(written, value)) + "]"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\x7f")
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return number(value)


def read(text):
    def constant(name):
        raise Refused(name)

    def real(digits):
        value = float(digits)
        if value in (float("inf"), float("-inf")):
            raise Refused(digits)
        return value

    def whole(digits):
        # A whole number beyond 64 bits, and minus zero, is a real one.
        return real(digits) if digits == "-0" or not -(2**63) <= int(digits) < 2**64 else int(digits)

    try:
        value = json.loads(text, parse_constant=constant, parse_float=real, parse_int=whole)
        json.dumps(value, ensure_ascii=False).encode()
    except (ValueError, RecursionError) as error:
        raise Refused(text) from error
    bare = re.sub(r'"(?:[^"\\\\]|\\\\.)*"', "", text)
    depth = most = 0
    for sign in bare:
        depth += (sign in "[{") - (sign in "]}")
        most = max(most, depth)
    if most > 128:
        raise Refused("too deep")
    return value


def keep(spec, value, path, lost):
    """(whether it is kept, what is kept); appends what is lost as (path, reason, expected, found)."""
    kind = KINDS[type(value)]
    if spec.kind == "object" and kind == "object":
        return True, members(spec.allow, value, path + ".", lost)
    if spec.kind == "array" and kind == "array":
        items = [keep(spec.items, item, f"{path}[{i}]", lost) for i, item in enumerate(value)]
        return True, [item for kept, item in items if kept]
    if kind == spec.kind or (spec.kind == "scalar" and kind not in ("object", "array")):
        return True, value
    lost.append((path, "type_mismatch", spec.kind, kind))
    return False, None


def members(allow, document, prefix, lost):
    result = {}
    for name in sorted(document, key=lambda k: k.encode()):
        if name not in allow:
            lost.append((prefix + name, "unknown_key", None, None))
            continue
        kept, value = keep(allow[name], document[name], prefix + name, lost)
        if kept:
            result[name] = value
    return result


def released(spec, text):
    """state, doc_id, payload and dropped of a document, as dictionaries."""
    try:
        document = read(text)
    except Refused:
        return {"state": "invalid"}
    state, at = KINDS[type(document)], document
    for name in spec.id_path:
        at = at.get(name, {}) if isinstance(at, dict) else {}
    kind = KINDS[type(at)]
    result = {"state": state, "doc_id": at if kind == "string" else str(at) if type(at) is int else None}
    if state == "object":
        lost = []
        result["payload"] = written(members(spec.fields, document, "", lost))
        result["dropped"] = [dict(zip(("path", "reason", "expected", "found"), row)) for row in lost]
    return result


class Table:
    """Operations applied one by one."""

    def __init__(self, specs):
        self.specs, self.rows, self.seq = specs, {}, 0

    def apply(self, op):
        key = (op["source"], op["collection"], op["id"])
        row = self.rows.get(key)
        if op["op"] == "delete":
            if row is None or row["deleted"]:
                return "unchanged", None
            payload, deleted, outcome = "{}", True, "tombstoned"
        else:
            payload = released(self.specs[op["collection"]], op["payload"])["payload"]
            if row is not None and not row["deleted"] and row["payload"] == payload:
                return "unchanged", None
            deleted, outcome = False, "stored"
        self.seq += 1
        self.rows[key] = {
            "payload": payload,
            "deleted": deleted,
            "seq": self.seq,
            "hash": hashlib.sha256(payload.encode()).hexdigest(),
        }
        return outcome, self.seq

    def run(self, ops):
        ordered = sorted(ops, key=lambda op: (op["batch_seq"], op["ord"]))
        return {(op["batch_id"], op["ord"]): self.apply(op) for op in ordered}
