"""Nodes of the language, and their JSON form."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    owner: Any
    name: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Many:
    items: tuple


@dataclass(frozen=True)
class Path:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Lambda:
    params: tuple[str, ...]
    body: Any


#: Function names of the JSON form that have an operator in the text form.
OPERATORS = {
    "greaterThan": ">", "greaterThanEqual": ">=", "lessThan": "<", "lessThanEqual": "<=", "equal": "==",
    "and": "&&", "or": "||", "plus": "+", "minus": "-", "times": "*",
}
LITERALS = ("integer", "string", "float", "decimal", "boolean", "strictDate", "dateTime")


def decode(node: dict) -> Any:
    """JSON to node; an unknown kind fails."""
    kind = node.get("_type")
    if kind == "lambda":
        return Lambda(tuple(p["name"] for p in node.get("parameters", [])), _only(node["body"]))
    if kind == "func":
        return Call(node["function"], tuple(decode(p) for p in node["parameters"]))
    if kind == "property":
        return Prop(decode(node["parameters"][0]), node["property"])
    if kind == "var":
        return Var(node["name"])
    if kind == "collection":
        return Many(tuple(decode(v) for v in node["values"]))
    if kind == "packageableElementPtr":
        return Path(node["fullPath"])
    if kind in LITERALS:
        values = [_value(kind, v) for v in node["values"]]
        return Lit(values[0]) if len(values) == 1 else Many(tuple(map(Lit, values)))
    raise ValueError(f"unknown expression: {kind}")


def _value(kind: str, value: Any) -> Any:
    if kind == "strictDate":
        return dt.date.fromisoformat(value.removeprefix("%"))
    return dt.datetime.fromisoformat(value.removeprefix("%")) if kind == "dateTime" else value


def _only(body: list[dict]) -> Any:
    if len(body) != 1:
        raise ValueError("only bodies of a single expression are supported")
    return decode(body[0])


def first(body: list[dict]) -> Any:
    """The expression of a derived property."""
    return _only(body)


def encode(node: Any) -> dict:
    """Node to JSON."""
    one = {"lowerBound": 1, "upperBound": 1}
    match node:
        case Lambda(params, body):
            return {"_type": "lambda", "body": [encode(body)], "parameters": [{"_type": "var", "name": p} for p in params]}
        case Call(name, args):
            return {"_type": "func", "function": name, "parameters": [encode(a) for a in args]}
        case Prop(owner, name):
            return {"_type": "property", "property": name, "parameters": [encode(owner)]}
        case Var(name):
            return {"_type": "var", "name": name}
        case Many(items):
            return {"_type": "collection", "multiplicity": {"lowerBound": len(items), "upperBound": len(items)}, "values": [encode(i) for i in items]}
        case Path(name):
            return {"_type": "packageableElementPtr", "fullPath": name}
        case Lit(value):
            kind = {bool: "boolean", int: "integer", float: "float", str: "string", dt.date: "strictDate", dt.datetime: "dateTime"}[type(value)]
            return {"_type": kind, "multiplicity": one, "values": [value.isoformat() if isinstance(value, dt.date) else value]}
    raise ValueError(f"not a node: {node!r}")


def children(node: Any) -> tuple:
    match node:
        case Lambda(_, body):
            return (body,)
        case Call(_, args):
            return args
        case Prop(owner, _):
            return (owner,)
        case Many(items):
            return items
    return ()


def properties(node: Any) -> set[str]:
    """First-level property names that an expression reads from its variables."""
    own = {node.name} if isinstance(node, Prop) and isinstance(node.owner, Var) else set()
    return own.union(*(properties(c) for c in children(node)))
