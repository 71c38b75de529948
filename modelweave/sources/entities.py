"""Model entities and their loaders."""

from __future__ import annotations

import importlib.resources
import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..plans import ast


@dataclass(frozen=True)
class Multiplicity:
    lower: int
    upper: int | None

    @classmethod
    def of(cls, node: dict) -> Multiplicity:
        return cls(node["lowerBound"], node.get("upperBound"))

    @property
    def optional(self) -> bool:
        return self.lower == 0

    @property
    def many(self) -> bool:
        return self.upper is None or self.upper > 1


@dataclass(frozen=True)
class Property:
    name: str
    type: str
    multiplicity: Multiplicity
    doc: str | None

    @property
    def complex(self) -> bool:
        return "::" in self.type


@dataclass(frozen=True)
class Derived:
    name: str
    body: Any
    type: str
    multiplicity: Multiplicity
    doc: str | None


@dataclass(frozen=True)
class ClassEntity:
    path: str
    supers: list[str]
    properties: list[Property]
    derived: list[Derived]
    constraints: dict[str, dict]  # name -> lambda in JSON; decoded where used, so that a bad one fails alone
    doc: str | None


@dataclass(frozen=True)
class EnumEntity:
    path: str
    values: list[str]
    doc: str | None


@dataclass(frozen=True)
class MappingEntity:
    path: str
    class_path: str | None
    schema: str | None
    table: str | None
    columns: dict[str, str]
    enums: dict[str, dict[str, list[str]]] = field(default_factory=dict)  # property -> value -> source values

    @property
    def relational(self) -> bool:
        return self.table is not None


@dataclass(frozen=True)
class ServiceEntity:
    path: str
    query: Any
    mapping: str


def _doc(node: dict) -> str | None:
    return next((v["value"] for v in node.get("taggedValues", []) if v.get("tag", {}).get("value") == "doc"), None)


def _class(path: str, c: dict) -> ClassEntity:
    return ClassEntity(
        path,
        [s if isinstance(s, str) else s["path"] for s in c.get("superTypes", [])],
        [Property(p["name"], p["type"], Multiplicity.of(p["multiplicity"]), _doc(p)) for p in c.get("properties", [])],
        [Derived(q["name"], q["body"], q.get("returnType", "String"), Multiplicity.of(q.get("returnMultiplicity", {"lowerBound": 1, "upperBound": 1})), _doc(q)) for q in c.get("qualifiedProperties", [])],
        {x["name"]: x["functionDefinition"] for x in c.get("constraints", [])},
        _doc(c),
    )


def _mapping(path: str, c: dict) -> MappingEntity:
    own = next(iter(c.get("classMappings", [])), None)
    if own is None or own["_type"] != "relational" or own.get("mainTable", {}).get("_type") != "Table":
        return MappingEntity(path, own["class"] if own else None, None, None, {})
    enums = {e.get("id") or e["enumeration"].replace("::", "_"): e for e in c.get("enumerationMappings", [])}
    columns, sources = {}, {}
    for p in own.get("propertyMappings", []):
        operation = p["relationalOperation"]
        if p["_type"] != "relationalPropertyMapping" or operation["_type"] != "column":
            continue  # computed and joined properties have no column of their own
        name = p["property"]["property"]
        columns[name] = operation["column"]
        if e := enums.get(p.get("enumMappingId")):
            sources[name] = {v["enumValue"]: [s["value"] if isinstance(s, dict) else s for s in v["sourceValues"]] for v in e["enumValueMappings"]}
    table = own["mainTable"]
    return MappingEntity(path, own["class"], table["schema"], table["table"], columns, sources)


def _service(path: str, c: dict) -> ServiceEntity:
    run = c["execution"]
    if run["_type"] != "pureSingleExecution":
        raise ValueError(f"{path}: only services with a single execution are supported")
    if run["func"].get("parameters"):
        raise ValueError(f"{path}: services with parameters are not supported")
    return ServiceEntity(path, ast.decode(run["func"]), run["mapping"])


_KINDS = {"class": _class, "mapping": _mapping, "service": _service, "enumeration": lambda path, c: EnumEntity(path, [v["value"] for v in c["values"]], _doc(c))}


def decode(documents: Iterable[dict]) -> dict[str, Any]:
    """Entities by path; kinds that have no meaning here (stores, connections, runtimes) are kept as JSON."""
    found: dict[str, Any] = {}
    for d in documents:
        c = d["content"]
        path = f"{c['package']}::{c['name']}"
        kind = c["_type"].lower()
        found[path] = _KINDS[kind](path, c) if kind in _KINDS else d
    if not found:
        raise ValueError("no entities found")
    return found


def from_directory(path: str) -> dict[str, Any]:
    """All JSON files below a directory."""
    root = Path(path)
    if not root.exists():
        raise FileNotFoundError(f"{path} doesn't exist")
    if not root.is_dir():
        raise NotADirectoryError(f"{path} is not a directory")
    return decode(json.loads(p.read_text()) for p in sorted(root.rglob("*.json")))


def from_package(name: str) -> dict[str, Any]:
    """All JSON files that an importable package carries."""

    def walk(place):
        for x in sorted(place.iterdir(), key=lambda x: x.name):
            if x.is_dir():
                yield from walk(x)
            elif x.name.endswith(".json"):
                yield json.loads(x.read_text())

    return decode(walk(importlib.resources.files(name)))
