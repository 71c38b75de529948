"""Lowering of expressions and queries, to Spark columns and DataFrames or to SQL text.

One walk over the nodes serves both: a target makes the pieces.  Comparisons whose operand is optional
are guarded, so that they are false and never null; derived properties are expanded in place.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ast import Call, Lambda, Lit, Many, Path, Prop, Var
from .ast import first as first_of


class ColumnTarget:
    """Spark columns."""

    def column(self, name: str) -> Column:
        return F.col(".".join(f"`{x}`" for x in name.split(".")))

    lit = staticmethod(F.lit)
    is_null = staticmethod(lambda c: c.isNull())
    not_null = staticmethod(lambda c: c.isNotNull())
    negate = staticmethod(lambda c: ~c)
    both = staticmethod(lambda a, b: a & b)
    either = staticmethod(lambda a, b: a | b)
    within = staticmethod(lambda c, values: c.isin(values))
    each_within = staticmethod(lambda c, values: F.forall(c, lambda x: x.isin(values)))
    size = staticmethod(F.size)
    starts = staticmethod(lambda c, prefix: c.startswith(prefix))
    concat = staticmethod(lambda parts: F.concat(*parts))
    substring = staticmethod(F.substring)
    output = staticmethod(lambda name: F.col(f"`{name}`"))
    years = staticmethod(lambda a, b: F.year(b) - F.year(a))
    months = staticmethod(lambda a, b: (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a)))
    days = staticmethod(lambda a, b: F.date_diff(b, a))
    today = staticmethod(F.current_date)
    average = staticmethod(lambda c: F.avg(c.cast("double")))
    count = staticmethod(F.count)
    aggregate = staticmethod(lambda name, c: {"sum": F.sum, "min": F.min, "max": F.max}[name](c))

    def compare(self, symbol: str, a: Column, b: Column) -> Column:
        return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b, "==": a == b}[symbol]

    def arithmetic(self, symbol: str, a: Column, b: Column) -> Column:
        return {"+": a + b, "-": a - b, "*": a * b}[symbol]


class Loose(str):
    """SQL text whose outermost operator isn't in parentheses: it gets them as an operand."""


class Difference(Loose):
    """A difference, which binds tighter than a comparison."""


def _tight(c: str) -> str:
    return f"({c})" if isinstance(c, Loose) else c


@dataclass
class SqlTarget:
    """SQL text: of a query (lower case, columns of an alias) or of a rule (upper case)."""

    alias: str | None = None

    def word(self, text: str) -> str:
        return text if self.alias else text.upper()

    def column(self, name: str) -> str:
        return f"`{self.alias}`.{name}" if self.alias else name

    def output(self, name: str) -> str:
        return f"`{self.alias}`.`{name}`" if self.alias else f"`{name}`"

    def lit(self, value: Any) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, dt.datetime):
            return f"timestamp '{value.isoformat(sep=' ')}'"
        if isinstance(value, dt.date):
            return f"date '{value.isoformat()}'"
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else str(value)

    def is_null(self, c):
        return Loose(f"{_tight(c)} {self.word('is null')}")

    def not_null(self, c):
        return Loose(f"{_tight(c)} {self.word('is not null')}")

    def negate(self, c):
        return Loose(f"{self.word('not')} {c}")

    def both(self, a, b):
        return f"({a} {self.word('and')} {b})"

    def either(self, a, b):
        return f"({a} {self.word('or')} {b})"

    def within(self, c, values):
        return Loose(f"{_tight(c)} {self.word('in')} ({', '.join(map(self.lit, values))})")

    def each_within(self, c, values):
        return f"forall({c}, x -> {self.within('x', values)})"

    def size(self, c):
        return f"{self.word('size')}({c})"

    def starts(self, c, prefix):
        return f"startswith({c}, {prefix})"

    def concat(self, parts):
        return f"concat({', '.join(parts)})"

    def substring(self, c, start, n):
        return f"substring({c}, {start}, {n})"

    def years(self, a, b):
        return Difference(f"year({b}) - year({a})")

    def months(self, a, b):
        return f"((year({b}) - year({a})) * 12 + (month({b}) - month({a})))"

    def days(self, a, b):
        return f"datediff({b}, {a})"

    def today(self):
        return "current_date"

    def average(self, c):
        return f"avg(1.0 * {_tight(c)})"

    def count(self, c):
        return f"count({c})"

    def aggregate(self, name, c):
        return f"{name}({c})"

    def compare(self, symbol, a, b):
        a, b = (c if isinstance(c, Difference) else _tight(c) for c in (a, b))
        return Loose(f"{a} {'=' if symbol == '==' else symbol} {b}")

    def arithmetic(self, symbol, a, b):
        return f"({_tight(a)} {symbol} {_tight(b)})"


@dataclass(frozen=True)
class Typed:
    value: Any
    optional: bool = False
    text: bool = False  # is it a string?
    many: bool = False


@dataclass
class Scope:
    """What an expression may read: the class, and the name of each property's column."""

    model: Any  # lookups of classes and enumerations
    class_path: str
    names: dict[str, str]
    enums: dict[str, dict[str, list[str]]]
    expanding: tuple[str, ...] = ()
    row: dict[str, Typed] | None = None  # after a projection or grouping: the columns that came out

    def after(self, outputs: dict[str, Typed]) -> Scope:
        return Scope(self.model, self.class_path, self.names, self.enums, (), outputs)


_UNITS = {"YEARS": "years", "MONTHS": "months", "DAYS": "days"}
_COMPARE = {"greaterThan": ">", "greaterThanEqual": ">=", "lessThan": "<", "lessThanEqual": "<="}


def lower(node: Any, scope: Scope, target: Any) -> Typed:
    """The value of an expression over ``$this`` or a lambda's variable."""

    def value(n: Any) -> Typed:
        return lower(n, scope, target)

    match node:
        case Lambda(_, body):
            return value(body)
        case Lit(v):
            return Typed(target.lit(v), text=isinstance(v, str))
        case Prop(Var(), name):
            return _property(name, scope, target)
        case Prop(Prop() as owner, name):
            return _nested(owner, name, scope, target)
        case Call("today", _):
            return Typed(target.today())
        case Call("isEmpty", (a,)):
            return Typed(target.is_null(value(a).value))
        case Call("isNotEmpty", (a,)):
            return Typed(target.not_null(value(a).value))
        case Call("not", (a,)):
            return Typed(target.negate(value(a).value))
        case Call("and" | "or" as name, args):
            parts = [value(a).value for a in args]
            out = parts[0]
            for p in parts[1:]:
                out = target.both(out, p) if name == "and" else target.either(out, p)
            return Typed(out)
        case Call("in", (a, Many(items))):
            own = value(a)
            return Typed((target.each_within if own.many else target.within)(own.value, _sources(a, [_literal(i) for i in items], scope)))
        case Call("equal", (a, b)):
            return Typed(target.compare("==", value(a).value, value(b).value))
        case Call(name, (a, b)) if name in _COMPARE:
            left, right = value(a), value(b)
            out = target.compare(_COMPARE[name], left.value, right.value)
            for side in (right, left):
                if side.optional:
                    out = target.both(target.not_null(side.value), out)
            return Typed(out)
        case Call("size", (a,)):
            return Typed(target.size(value(a).value))
        case Call("startsWith", (a, b)):
            return Typed(target.starts(value(a).value, value(b).value))
        case Call("substring", (a, b, c)):
            return Typed(target.substring(value(a).value, _literal(b), _literal(c)), text=True)
        case Call("plus", (Many(items),)):
            parts = [value(i) for i in items]
            if any(p.text for p in parts):
                return Typed(target.concat([p.value for p in parts]), text=True)
            out = parts[0].value
            for p in parts[1:]:
                out = target.arithmetic("+", out, p.value)
            return Typed(out, any(p.optional for p in parts))
        case Call("minus" | "times" as name, args):  # an extension
            sides = [value(a) for a in (args[0].items if isinstance(args[0], Many) else args)]
            out = sides[0].value
            for s in sides[1:]:
                out = target.arithmetic("-" if name == "minus" else "*", out, s.value)
            return Typed(out, any(s.optional for s in sides))
        case Call("dateDiff", (a, b, Prop(Path("DurationUnit"), unit))):
            if unit not in _UNITS:
                raise ValueError(f"dateDiff in {unit} is not supported")
            return Typed(getattr(target, _UNITS[unit])(value(a).value, value(b).value))
        case Call(name, _):
            raise ValueError(f"unknown function: {name}")
    raise ValueError(f"not a value: {node!r}")


def _literal(node: Any) -> Any:
    match node:
        case Lit(v):
            return v
        case Prop(Path(), name):  # a value of an enumeration
            return name
    raise ValueError("a literal is expected")


def _sources(node: Any, values: list, scope: Scope) -> list:
    """Values of an enumeration as the mapped column stores them."""
    known = scope.enums.get(node.name, {}) if isinstance(node, Prop) and isinstance(node.owner, Var) else {}
    return [s for v in values for s in known.get(v, [v])]


def _property(name: str, scope: Scope, target: Any) -> Typed:
    if scope.row is not None:
        if name not in scope.row:
            raise ValueError(f"there is no column {name} at this step")
        own = scope.row[name]
        return Typed(target.output(name), own.optional, own.text, own.many)
    for p in scope.model.all_properties(scope.class_path):
        if p.name == name:
            if name not in scope.names:
                raise ValueError(f"property {name} is not mapped to a column")
            kind = "text" if p.type == "String" or scope.model.is_enum(p.type) else ""
            return Typed(target.column(scope.names[name]), p.multiplicity.optional, bool(kind), p.multiplicity.many)
    for d in scope.model.derived_properties(scope.class_path):
        if d.name == name:
            if name in scope.expanding:
                raise ValueError(f"derived property {name} refers to itself")
            inner = Scope(scope.model, scope.class_path, scope.names, scope.enums, (*scope.expanding, name))
            got = lower(first_of(d.body), inner, target)
            return Typed(got.value, d.multiplicity.optional, got.text or d.type == "String")
    raise ValueError(f"{scope.class_path} has no property {name}")


def _nested(owner: Prop, name: str, scope: Scope, target: Any) -> Typed:
    chain = [name]
    while isinstance(owner, Prop):
        chain.insert(0, owner.name)
        owner = owner.owner
    path, optional, p = scope.class_path, False, None
    for step in chain:
        p = next((x for x in scope.model.all_properties(path) if x.name == step), None)
        if p is None:
            raise ValueError(f"{path} has no property {step}")
        optional |= p.multiplicity.optional
        path = p.type
    return Typed(target.column(".".join([scope.names.get(chain[0], chain[0]), *chain[1:]])), optional, p.type == "String", p.multiplicity.many)


@dataclass
class Query:
    """A functional query, taken apart: one step after another over all instances of a class."""

    class_path: str
    filters: list[Any]
    steps: list[tuple[str, tuple]]


def take_apart(node: Any) -> Query:
    steps: list[tuple[str, tuple]] = []
    while isinstance(node, (Call, Lambda)):
        if isinstance(node, Lambda):
            node = node.body
        elif node.name == "getAll":
            if not isinstance(node.args[0], Path):
                raise ValueError("getAll needs a class")
            steps.reverse()
            filters = []
            while steps and steps[0][0] == "filter":
                filters.append(steps.pop(0)[1][0])
            return Query(node.args[0].name, filters, steps)
        elif node.name in ("filter", "project", "groupBy", "sort", "take"):
            steps.append((node.name, node.args[1:]))
            node = node.args[0]
        else:
            raise ValueError(f"unknown query step: {node.name}")
    raise ValueError("a query begins with all instances of a class")


def _items(node: Any) -> tuple:
    return node.items if isinstance(node, Many) else (node,)


def _aggregate(node: Any, scope: Scope, target: Any) -> Any:
    match node:
        case Call("agg", (of, Lambda(_, Call(name, _)))):
            inner = lower(of, scope, target).value
            if name == "average":
                return target.average(inner)
            if name == "count":
                return target.count(inner)
            if name in ("sum", "min", "max"):  # extensions
                return target.aggregate(name, inner)
            raise ValueError(f"unknown aggregate: {name}")
    raise ValueError("an aggregate is expected")


def _order(node: Any) -> list[tuple[str, bool]]:
    return [(_literal(c.args[0]), c.name == "desc") for c in _items(node) if isinstance(c, Call) and c.name in ("asc", "desc")]


def _outputs(name: str, args: tuple, scope: Scope, target: Any) -> tuple[dict[str, Typed], int]:
    """The columns that a projection or grouping gives, and how many of them are keys."""
    if name == "project":
        return {_literal(n): lower(e, scope, target) for e, n in zip(_items(args[0]), _items(args[1]), strict=True)}, 0
    keys, aggregates, names = _items(args[0]), _items(args[1]), [_literal(n) for n in _items(args[2])]
    values = [lower(k, scope, target) for k in keys] + [Typed(_aggregate(a, scope, target), optional=True) for a in aggregates]
    return dict(zip(names, values, strict=True)), len(keys)


def to_frame(query: Query, scope: Scope, source: Callable[[], DataFrame], extra: list[Any] = ()) -> DataFrame:
    """Build the DataFrame; filters, pruning and top-k are left to the optimiser."""
    target = ColumnTarget()
    df = source()
    for condition in [*query.filters, *extra]:
        df = df.filter(lower(condition, scope, target).value)
    for name, args in query.steps:
        if name in ("project", "groupBy"):
            outputs, keys = _outputs(name, args, scope, target)
            columns = [v.value.alias(n) for n, v in outputs.items()]
            df = df.select(*columns) if name == "project" else df.groupBy(*columns[:keys]).agg(*columns[keys:])
            scope = scope.after(outputs)
        elif name == "filter":
            df = df.filter(lower(args[0], scope, target).value)
        elif name == "sort":
            df = df.orderBy(*((F.desc if down else F.asc)(f"`{c}`") for c, down in _order(args[0])))
        else:
            df = df.limit(_literal(args[0]))
    return df


def to_sql(query: Query, scope: Scope, table: str, extra: list[Any] = ()) -> str:
    """The same query as one SQL statement; a step that can't join the ones before it reads them as a subquery."""
    target = SqlTarget("root")
    source, columns, where, group, order, limit = table, "*", [], "", "", ""

    def statement() -> str:
        return f"select {columns} from {source} as `root`" + (f" where {' and '.join(where)}" if where else "") + group + order + limit

    for name, args in [*(("filter", (f,)) for f in [*query.filters, *extra]), *query.steps]:
        ended = {"filter": columns != "*" or order or limit, "project": columns != "*" or order or limit, "groupBy": columns != "*" or order or limit, "sort": limit, "take": limit}[name]
        if ended:
            source, columns, where, group, order, limit = f"({statement()})", "*", [], "", "", ""
        if name == "filter":
            where.append(str(lower(args[0], scope, target).value))
        elif name in ("project", "groupBy"):
            outputs, keys = _outputs(name, args, scope, target)
            columns = ", ".join(f"{v.value} as `{n}`" for n, v in outputs.items())
            if name == "groupBy":
                group = " group by " + ", ".join(f"`{n}`" for n in [*outputs][:keys])
            scope = scope.after(outputs)
        elif name == "sort":
            order = " order by " + ", ".join(f"`{c}` {'desc' if down else 'asc'}" for c, down in _order(args[0]))
        else:
            limit = f" limit {_literal(args[0])}"
    return statement()
