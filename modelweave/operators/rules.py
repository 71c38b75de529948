"""Expectations: technical rules from types and multiplicities, and constraints of classes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import Call, Lit, Many, Prop, Var


@dataclass(frozen=True)
class Rule:
    """``expression``: a node, or JSON that is still to be decoded; ``sql`` and ``column`` on property names.

    Columns are made on demand, so that texts need no session.
    """

    expression: Any
    sql: str | None = None
    column: Callable[[], Column] | None = None


def _read(path: list[str]) -> Any:
    node: Any = Var("this")
    for p in path:
        node = Prop(node, p)
    return node


def technical(model: Any, class_path: str, parent: tuple[str, ...] = ()) -> dict[str, Rule]:
    """Rules of all stored properties of a class: mandatory, size, allowed values, nested.

    Rules of a nested object hold for optional parents, too: where the parent is null, its mandatory parts are.
    """
    found: dict[str, Rule] = {}
    for p in model.all_properties(class_path):
        path = [*parent, p.name]
        name, node, m = ".".join(path), _read(path), p.multiplicity

        def col(path=path) -> Column:
            return F.col(".".join(f"`{x}`" for x in path))

        if m.lower >= 1:
            found[f"[{name}] is mandatory"] = Rule(Call("isNotEmpty", (node,)), f"{name} IS NOT NULL", lambda col=col: col().isNotNull())
        if m.many:
            low = Call("greaterThanEqual", (Call("size", (node,)), Lit(m.lower)))
            if m.upper is None:
                inner, sql = low, f"SIZE({name}) >= {m.lower}"
            else:
                inner, sql = Call("and", (low, Call("lessThanEqual", (Call("size", (node,)), Lit(m.upper))))), f"(SIZE({name}) BETWEEN {m.lower} AND {m.upper})"

            def sized(col=col, m=m) -> Column:
                n = F.size(col())
                return col().isNull() | (n >= m.lower if m.upper is None else n.between(m.lower, m.upper))

            found[f"[{name}] has invalid size"] = Rule(Call("or", (Call("isEmpty", (node,)), inner)), f"{name} IS NULL OR {sql}", sized)
        if not p.complex:
            continue
        if model.is_enum(p.type):
            values = model.enum_values(p.type)
            allowed = "(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"
            sql = f"forall({name}, x -> x IN {allowed})" if m.many else f"{name} IN {allowed}"

            def known(col=col, m=m, values=values) -> Column:
                return col().isNull() | (F.forall(col(), lambda x: x.isin(values)) if m.many else col().isin(values))

            node = Call("or", (Call("isEmpty", (node,)), Call("in", (node, Many(tuple(map(Lit, values)))))))
            found[f"[{name}] not allowed value"] = Rule(node, f"{name} IS NULL OR {sql}", known)
        elif not m.many:  # elements of arrays have no rules of their own
            found.update(technical(model, p.type, tuple(path)))
    return found


def expectations(model: Any, class_path: str) -> dict[str, Rule]:
    """All rules of a class, inherited ones first; of equal names the last one holds."""
    entity = model.class_of(class_path)
    found: dict[str, Rule] = {}
    for parent in entity.supers:
        found.update(expectations(model, parent))
    found.update(technical(model, class_path))
    found.update({name: Rule(body) for name, body in entity.constraints.items()})
    return found
