"""The facade: a loaded model and everything that it gives for a class, a mapping or a service."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.types import spark_type
from ..plans import ast, lower, text
from ..sources import entities as E
from . import frames
from .rules import Rule, expectations

Resolver = Callable[[str], DataFrame]


class Model:
    """Entities by path.  References between them are checked when the model is made."""

    def __init__(self, entities: dict[str, Any]):
        self.entities = dict(entities)
        self._check()

    @classmethod
    def from_directory(cls, path: str) -> Model:
        return cls(E.from_directory(path))

    @classmethod
    def from_package(cls, name: str) -> Model:
        return cls(E.from_package(name))

    # entities

    def entity_names(self) -> set[str]:
        return set(self.entities)

    def entity(self, path: str) -> Any:
        if path not in self.entities:
            raise ValueError(f"there is no entity {path}")
        return self.entities[path]

    def class_of(self, path: str) -> E.ClassEntity:
        found = self.entity(path)
        if not isinstance(found, E.ClassEntity):
            raise ValueError(f"{path} is not a class")
        return found

    def mapping_of(self, path: str) -> E.MappingEntity:
        found = self.entity(path)
        if not isinstance(found, E.MappingEntity):
            raise ValueError(f"{path} is not a mapping")
        if not found.relational:
            raise ValueError(f"{path} is not a relational mapping")
        return found

    def is_enum(self, path: str) -> bool:
        return isinstance(self.entities.get(path), E.EnumEntity)

    def enum_values(self, path: str) -> list[str]:
        return self.entity(path).values

    def all_properties(self, path: str, below: tuple[str, ...] = ()) -> list[E.Property]:
        """Stored properties, those of supertypes first."""
        if path in below:
            raise ValueError(f"{path} is its own supertype")
        own = self.class_of(path)
        return [p for s in own.supers for p in self.all_properties(s, (*below, path))] + own.properties

    def derived_properties(self, path: str, inherit: bool = False) -> list[E.Derived]:
        """A class's own derived properties; with ``inherit`` also those of its supertypes."""
        own = self.class_of(path)
        if not inherit:
            return own.derived
        found = {d.name: d for s in own.supers for d in self.derived_properties(s, True)}
        return list((found | {d.name: d for d in own.derived}).values())

    def _check(self) -> None:
        for path, e in self.entities.items():
            if isinstance(e, E.ClassEntity):
                for name in [*e.supers, *(p.type for p in e.properties if p.complex)]:
                    if name not in self.entities:
                        raise ValueError(f"{path} refers to {name}, which doesn't exist")
            elif isinstance(e, E.MappingEntity) and e.class_path and e.class_path not in self.entities:
                raise ValueError(f"{path} maps {e.class_path}, which doesn't exist")
            elif isinstance(e, E.ServiceEntity) and e.mapping not in self.entities:
                raise ValueError(f"{path} uses {e.mapping}, which doesn't exist")

    # schemas

    def schema(self, path: str) -> T.StructType:
        """Schema of a class, or of a mapping's table."""
        found = self.entity(path)
        if isinstance(found, E.ClassEntity):
            return T.StructType([self._field(p, (path,)) for p in self.all_properties(path)])
        if isinstance(found, E.MappingEntity):
            columns = self.transformations(path)
            fields = self.schema(found.class_path).fields
            if missing := [f.name for f in fields if f.name not in columns]:
                raise ValueError(f"{path} maps no column for {', '.join(missing)}")
            return T.StructType([T.StructField(columns[f.name], f.dataType, f.nullable, f.metadata) for f in fields])
        raise ValueError(f"{path} is neither a class nor a mapping")

    def _field(self, p: E.Property, within: tuple[str, ...]) -> T.StructField:
        doc = p.doc
        if not p.complex:
            kind: T.DataType = spark_type(p.type)
        else:
            found = self.entity(p.type)
            doc = doc or getattr(found, "doc", None)
            if isinstance(found, E.EnumEntity):
                kind = T.StringType()
            elif isinstance(found, E.ClassEntity):
                if p.type in within:
                    raise ValueError(f"{p.type} contains itself")
                kind = T.StructType([self._field(x, (*within, p.type)) for x in self.all_properties(p.type)])
            else:
                raise ValueError(f"{p.type} is neither a class nor an enumeration")
        if p.multiplicity.many:
            kind = T.ArrayType(kind)
        return T.StructField(p.name, kind, p.multiplicity.optional, {"comment": doc} if doc else {})

    def transformations(self, mapping: str) -> dict[str, str]:
        """Property to column, for properties that are a column."""
        return dict(self.mapping_of(mapping).columns)

    def table(self, mapping: str) -> str:
        own = self.mapping_of(mapping)
        return f"{own.schema}.{own.table}"

    def create_table(self, spark: SparkSession, mapping: str, path: str | None = None, fmt: str = "parquet") -> str:
        """Create the mapping's table unless it exists, all columns nullable; returns its name."""
        name, schema = self.table(mapping), self.schema(mapping)
        if not spark.catalog.tableExists(name):
            loose = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])
            options = {"path": path} if path else {}
            spark.catalog.createTable(name, source=fmt, schema=loose, description=f"Table of {self.mapping_of(mapping).class_path}", **options)
        return name

    # rules

    def expectations(self, path: str, compile: bool = True) -> dict[str, str | Exception]:
        """Rules by name, as model text or, compiled, as SQL: on property names for a class, where
        constraints are left out, and on columns for a mapping.  A rule that fails is its error."""
        found = self.entity(path)
        if isinstance(found, E.ClassEntity):
            rules = expectations(self, path)
            if compile:
                return {name: r.sql for name, r in rules.items() if r.sql is not None}
            return {name: _attempt(lambda r=r: text.to_text(_node(r))) for name, r in rules.items()}
        own = self.mapping_of(path)
        rules = expectations(self, own.class_path)
        if not compile:
            return {name: _attempt(lambda r=r: text.to_text(_node(r))) for name, r in rules.items()}
        return {name: _attempt(lambda r=r: lower.lower(_node(r), self._scope(own), lower.SqlTarget()).value) for name, r in rules.items()}

    def rules(self, path: str) -> dict[str, Column]:
        """Rules that compile, as columns: on property names for a class, on columns for a mapping."""
        found = self.entity(path)
        if isinstance(found, E.ClassEntity):
            return {name: r.column() for name, r in expectations(self, path).items() if r.column is not None}
        own = self.mapping_of(path)
        tried = {name: _attempt(lambda r=r: lower.lower(_node(r), self._scope(own), lower.ColumnTarget()).value) for name, r in expectations(self, own.class_path).items()}
        return {name: c for name, c in tried.items() if not isinstance(c, Exception)}

    def derivations(self, mapping: str, compile: bool = True, inherit: bool = False) -> dict[str, str | Exception]:
        """Derived properties by name, as model text or SQL."""
        own = self.mapping_of(mapping)
        target = lower.SqlTarget()

        def one(d: E.Derived) -> str:
            node = ast.first(d.body)
            return lower.lower(node, self._scope(own), target).value if compile else text.to_text(node)

        return {d.name: _attempt(lambda d=d: one(d)) for d in self.derived_properties(own.class_path, inherit)}

    def derived_columns(self, mapping: str, inherit: bool = False) -> dict[str, Column]:
        own = self.mapping_of(mapping)
        return {d.name: lower.lower(ast.first(d.body), self._scope(own), lower.ColumnTarget()).value for d in self.derived_properties(own.class_path, inherit)}

    # frames

    def transform(self, df: DataFrame, mapping: str) -> DataFrame:
        return frames.transform(df, self.transformations(mapping))

    def validate(self, df: DataFrame, path: str, name: str = frames.VIOLATIONS) -> DataFrame:
        return frames.validate(df, self.rules(path), name)

    def derive(self, df: DataFrame, mapping: str) -> DataFrame:
        return frames.derive(df, self.derived_columns(mapping))

    # queries

    def _scope(self, mapping: E.MappingEntity) -> lower.Scope:
        return lower.Scope(self, mapping.class_path, mapping.columns, mapping.enums)

    def _plan(self, path: str, strict: bool) -> tuple[lower.Query, E.MappingEntity, list[Any]]:
        """(query, mapping, rules to filter by) of a mapping or a service."""
        found = self.entity(path)
        if isinstance(found, E.ServiceEntity):
            own = self.mapping_of(found.mapping)
            query = lower.take_apart(found.query)
            if query.class_path != own.class_path:
                raise ValueError(f"{path} asks for {query.class_path}, but {found.mapping} maps {own.class_path}")
            return query, own, []
        own = self.mapping_of(path)
        names = [p.name for p in self.all_properties(own.class_path) if p.name in own.columns] + [d.name for d in self.derived_properties(own.class_path)]
        step = ("project", (ast.Many(tuple(ast.Lambda(("x",), ast.Prop(ast.Var("x"), n)) for n in names)), ast.Many(tuple(map(ast.Lit, names)))))
        chosen = []
        for rule in expectations(self, own.class_path).values():
            node = _attempt(lambda rule=rule: _node(rule))
            # rules on derived properties only are applied if asked for; rules that don't compile never
            if isinstance(node, Exception) or isinstance(_attempt(lambda node=node: lower.lower(node, self._scope(own), lower.SqlTarget())), Exception):
                continue
            if strict or _reads(node) & own.columns.keys():
                chosen.append(node)
        return lower.Query(own.class_path, [], [step]), own, chosen

    def sql(self, path: str, strict: bool = False) -> str:
        """The query of a mapping or service as SQL text."""
        query, own, rules = self._plan(path, strict)
        return lower.to_sql(query, self._scope(own), f"{own.schema}.{own.table}", rules)

    def query(self, spark: SparkSession, path: str, resolve: Resolver | None = None, strict: bool = False) -> DataFrame:
        """The query of a mapping or service as a DataFrame.  ``resolve`` gives the frame of a table's name."""
        query, own, rules = self._plan(path, strict)
        return lower.to_frame(query, self._scope(own), lambda: (resolve or spark.table)(f"{own.schema}.{own.table}"), rules)

    def ask(self, spark: SparkSession, question: str, mapping: str, resolve: Resolver | None = None) -> DataFrame:
        """A query given as text, checked against the model."""
        own = self.mapping_of(mapping)
        query = self.parse(question)
        return lower.to_frame(query, self._scope(own), lambda: (resolve or spark.table)(f"{own.schema}.{own.table}"))

    def explain(self, question: str, mapping: str) -> str:
        """The SQL of a query given as text."""
        own = self.mapping_of(mapping)
        return lower.to_sql(self.parse(question), self._scope(own), f"{own.schema}.{own.table}")

    def parse(self, question: str) -> lower.Query:
        query = lower.take_apart(text.parse(question))
        self.class_of(query.class_path)
        return query


def _node(rule: Rule) -> Any:
    return ast.decode(rule.expression) if isinstance(rule.expression, dict) else rule.expression


def _reads(node: Any) -> set[str]:
    """Names of the properties that a rule starts from."""
    return ast.properties(node)


def _attempt(f: Callable[[], Any]) -> Any:
    """A rule that can't be compiled doesn't keep the others from it."""
    try:
        return f()
    except (ValueError, KeyError, TypeError) as e:
        return e
