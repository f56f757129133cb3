"""Collection specifications: which fields of a document may be released.

A specification is small driver-side configuration. It is validated once and then compiled
into Spark columns by :mod:`feedgate.functions.exact`; nothing here touches data.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from feedgate.limits import DEFAULT_SHARED_MAX_AGE, MAX_NAME_BYTES

SCALARS = ("string", "number", "boolean", "scalar")
_NAME = re.compile(r"[a-z0-9]([a-z0-9._-]*[a-z0-9])?")


class SpecError(ValueError):
    """A specification that must not be used."""


def check_collection_name(name: Any) -> str:
    if not isinstance(name, str) or not name:
        raise SpecError("a collection name must be a non-empty string")
    if len(name.encode()) > MAX_NAME_BYTES:
        raise SpecError(f"collection name is longer than {MAX_NAME_BYTES} bytes")
    if not _NAME.fullmatch(name):
        raise SpecError(f"{name!r} is not a usable collection name")
    return name


def check_field_name(name: Any) -> str:
    """Field names may hold almost anything, but never a dot or a control character."""
    if not isinstance(name, str) or not name:
        raise SpecError("a field name must be a non-empty string")
    if len(name.encode()) > MAX_NAME_BYTES:
        raise SpecError(f"field name is longer than {MAX_NAME_BYTES} bytes")
    if "." in name or any(unicodedata.category(c) == "Cc" for c in name):
        raise SpecError(f"field name {name!r} holds a dot or a control character")
    return name


@dataclass(frozen=True)
class FieldSpec:
    """One node of the allow-list tree.

    ``kind`` is ``string``, ``number``, ``boolean``, ``scalar`` (any non-container value,
    null included), ``object`` or ``array``.
    """

    kind: str
    index: bool = False
    allow: Mapping[str, FieldSpec] = field(default_factory=dict)
    items: FieldSpec | None = None

    @staticmethod
    def scalar(kind: str, index: bool = False) -> FieldSpec:
        if kind not in SCALARS:
            raise SpecError(f"{kind!r} is not a scalar type")
        return FieldSpec(kind, index=index)

    @staticmethod
    def object(allow: Mapping[str, FieldSpec] | Iterable[str]) -> FieldSpec:
        if not isinstance(allow, Mapping):
            allow = {name: FieldSpec("scalar") for name in allow}
        if not allow:
            raise SpecError("an object needs a non-empty allow list")
        return FieldSpec("object", allow={check_field_name(k): v for k, v in allow.items()})

    @staticmethod
    def array(items: FieldSpec) -> FieldSpec:
        return FieldSpec("array", items=items)

    @property
    def indexed(self) -> bool:
        return self.kind in SCALARS and self.index

    @staticmethod
    def parse(node: Any, where: str = "field") -> FieldSpec:
        """Build from the declared form, refusing misspelled keys."""
        if not isinstance(node, Mapping):
            raise SpecError(f"{where}: expected a mapping with a type")
        kind = node.get("type")
        keys = set(node) - {"type"}
        if kind in ("string", "number", "boolean"):
            if keys - {"index"}:
                raise SpecError(f"{where}: unknown key {sorted(keys - {'index'})[0]!r}")
            index = node.get("index", False)
            if not isinstance(index, bool):
                raise SpecError(f"{where}: index must be true or false")
            return FieldSpec.scalar(kind, index)
        if kind == "object":
            if keys != {"allow"}:
                raise SpecError(f"{where}: an object takes exactly an allow list")
            allow = node["allow"]
            if isinstance(allow, Mapping):
                allow = {k: FieldSpec.parse(v, f"{where}.{k}") for k, v in allow.items()}
            elif not isinstance(allow, (list, tuple)):
                raise SpecError(f"{where}: allow must be a list of names or a mapping")
            return FieldSpec.object(allow)
        if kind == "array":
            if keys != {"items"}:
                raise SpecError(f"{where}: an array takes exactly an items specification")
            return FieldSpec.array(FieldSpec.parse(node["items"], f"{where}[]"))
        raise SpecError(f"{where}: unknown type {kind!r}")


def parse_id_path(text: Any) -> tuple[str, ...]:
    """``$.a.b`` and ``a.b`` name the same place."""
    if not isinstance(text, str):
        raise SpecError("an id path must be a string")
    body = text[2:] if text.startswith("$.") else text
    return tuple(check_field_name(part) for part in body.split("."))


@dataclass(frozen=True)
class CollectionSpec:
    """A validated collection: where the id sits and what may be released."""

    collection: str
    id_path: tuple[str, ...]
    fields: Mapping[str, FieldSpec]
    filters: tuple[str, ...] = ()
    sort: tuple[str, ...] = ()
    shared_max_age: int = DEFAULT_SHARED_MAX_AGE

    def __post_init__(self) -> None:
        check_collection_name(self.collection)
        if not self.id_path:
            raise SpecError("an id path needs at least one segment")
        for part in self.id_path:
            check_field_name(part)
        if not self.fields:
            raise SpecError("a collection needs at least one field")
        for name, spec in self.fields.items():
            check_field_name(name)
            _check_tree(spec, name)
        for usage, names in (("filters", self.filters), ("sort", self.sort)):
            for name in names:
                if names.count(name) > 1:
                    raise SpecError(f"{usage}: {name!r} is listed twice")
                if usage == "sort" and name == "seq":
                    continue
                if name not in self.fields:
                    raise SpecError(f"{usage}: {name!r} is not a declared field")
                if not self.fields[name].indexed:
                    raise SpecError(f"{usage}: {name!r} is not an indexed scalar")
        age = self.shared_max_age
        if isinstance(age, bool) or not isinstance(age, int) or not 0 <= age < 2**32:
            raise SpecError("shared_max_age must be a whole number of seconds")

    @property
    def indexed_fields(self) -> dict[str, FieldSpec]:
        return {name: spec for name, spec in sorted(self.fields.items()) if spec.indexed}

    @staticmethod
    def parse(node: Any) -> CollectionSpec:
        if not isinstance(node, Mapping):
            raise SpecError("a collection must be a mapping")
        known = {"collection", "id", "fields", "filters", "sort", "cache"}
        if set(node) - known:
            raise SpecError(f"unknown key {sorted(set(node) - known)[0]!r}")
        for key in ("collection", "id", "fields"):
            if key not in node:
                raise SpecError(f"missing key {key!r}")
        if not isinstance(node["fields"], Mapping):
            raise SpecError("fields must be a mapping")
        cache = node.get("cache") or {}
        if set(cache) - {"shared_max_age"}:
            raise SpecError("cache only takes shared_max_age")
        return CollectionSpec(
            collection=node["collection"],
            id_path=parse_id_path(node["id"]),
            fields={k: FieldSpec.parse(v, k) for k, v in node["fields"].items()},
            filters=tuple(node.get("filters") or ()),
            sort=tuple(node.get("sort") or ()),
            shared_max_age=cache.get("shared_max_age", DEFAULT_SHARED_MAX_AGE),
        )


def _check_tree(spec: FieldSpec, path: str) -> None:
    if not isinstance(spec, FieldSpec):
        raise SpecError(f"{path}: not a field specification")
    if spec.kind == "object":
        if not spec.allow:
            raise SpecError(f"{path}: an object needs a non-empty allow list")
        for name, child in spec.allow.items():
            _check_tree(child, f"{path}.{check_field_name(name)}")
    elif spec.kind == "array":
        if spec.items is None:
            raise SpecError(f"{path}: an array needs an items specification")
        _check_tree(spec.items, f"{path}[]")
    elif spec.kind not in SCALARS:
        raise SpecError(f"{path}: unknown type {spec.kind!r}")


class SpecSet(Mapping[str, CollectionSpec]):
    """All declared collections; one name can be declared only once."""

    def __init__(self, specs: Iterable[CollectionSpec]):
        self._specs: dict[str, CollectionSpec] = {}
        for spec in specs:
            if spec.collection in self._specs:
                raise SpecError(f"collection {spec.collection!r} is declared twice")
            self._specs[spec.collection] = spec
        self._specs = dict(sorted(self._specs.items()))

    def __getitem__(self, name: str) -> CollectionSpec:
        return self._specs[name]

    def __iter__(self):
        return iter(self._specs)

    def __len__(self) -> int:
        return len(self._specs)

    @staticmethod
    def parse(nodes: Iterable[Any]) -> SpecSet:
        return SpecSet(CollectionSpec.parse(node) for node in nodes)

    @staticmethod
    def load(*paths: str | Path) -> SpecSet:
        """Read job configuration files, JSON or (where PyYAML is installed) YAML."""
        return SpecSet.parse(_load_file(Path(path)) for path in paths)


def _load_file(path: Path) -> Any:
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as error:
            raise SpecError("reading YAML needs PyYAML; use JSON instead") from error
        return yaml.safe_load(text)
    return json.loads(text)
