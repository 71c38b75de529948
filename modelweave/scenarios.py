"""Queries over the driver's tables with nulls and violations put in, and their SQL.

The tables hold hardly a null and keep most rules, so rules, guards and nested objects are tried on
frames in which expressions over keys make some values null, empty, too long or unknown.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import models
from .operators import codegen, frames
from .operators.model import Model
from .plans import ast, text
from .sources import entities
from .sources import tables as tables_io

Query = Callable[[SparkSession, str], DataFrame]
_model: list[Model] = []


def _m(lower: int, upper: int | None = 1) -> dict:
    return {"lowerBound": lower} | ({} if upper is None else {"upperBound": upper})


def _class(name: str, properties: list[tuple], derived: list[tuple] = (), constraints: list[tuple] = (), supers: list[str] = ()) -> dict:
    def body(own: str) -> list[dict]:
        return [ast.encode(text.parse(own))]

    return {
        "content": {
            "_type": "class", "package": "shop", "name": name, "superTypes": [f"shop::{s}" for s in supers],
            "properties": [{"name": n, "type": k, "multiplicity": m} for n, k, m in properties],
            "qualifiedProperties": [{"name": n, "body": body(b), "returnType": k, "returnMultiplicity": _m(0)} for n, k, b in derived],
            "constraints": [{"name": n, "functionDefinition": b if isinstance(b, dict) else {"_type": "lambda", "parameters": [], "body": body(b)}} for n, b in constraints],
        }
    }


def _mapping(name: str, of: str, columns: dict[str, str]) -> dict:
    rows = [{"_type": "relationalPropertyMapping", "property": {"property": p}, "relationalOperation": {"_type": "column", "column": c}} for p, c in columns.items()]
    table = {"_type": "Table", "schema": "shop", "table": name}
    return {"content": {"_type": "mapping", "package": "map", "name": name, "classMappings": [{"_type": "relational", "class": f"shop::{of}", "mainTable": table, "propertyMappings": rows}]}}


def model() -> Model:
    if not _model:
        kind = {"content": {"_type": "Enumeration", "package": "shop", "name": "Kind", "values": [{"value": v} for v in ("BUILDING", "MACHINERY", "FURNITURE")]}}
        party = _class("Party", [("key", "Number", _m(1)), ("name", "String", _m(1))], constraints=[("[name] begins as it should", "$this.name->startsWith('Customer#')")])
        place = _class("Place", [("nation", "Integer", _m(1)), ("phone", "String", _m(0)), ("kind", "shop::Kind", _m(0))])
        client = _class(
            "Client",
            [("balance", "Decimal", _m(0)), ("kind", "shop::Kind", _m(0)), ("tags", "String", _m(1, 2)), ("codes", "Integer", _m(2, None)), ("home", "shop::Place", _m(0)), ("places", "shop::Place", _m(0, None))],
            constraints=[("[balance] is positive", "$this.balance > 0"), ("[key] is odd one out", {"_type": "lambda", "parameters": [], "body": [{"_type": "unknown"}]})],
            supers=["Party"],
        )
        sale = _class(
            "Sale",
            [("key", "Number", _m(1)), ("ordered", "Date", _m(1)), ("shipped", "Date", _m(0)), ("line", "Integer", _m(1)), ("amount", "Decimal", _m(0))],
            [("age", "Integer", "$this.ordered->dateDiff($this.shipped,DurationUnit.YEARS)"), ("months", "Integer", "$this.ordered->dateDiff($this.shipped,DurationUnit.MONTHS)"),
             ("days", "Integer", "$this.ordered->dateDiff($this.shipped,DurationUnit.DAYS)"), ("twice", "Integer", "$this.age * 2"), ("less", "Integer", "$this.line - $this.age"),
             ("both", "Integer", "$this.age + $this.twice - $this.line * $this.age"), ("since", "Integer", "$this.ordered->dateDiff(today(),DurationUnit.YEARS)")],
            [("[shipped] after all", "$this.age >= 0"), ("[line] and [age]", "$this.line - $this.age > 1")],
        )
        other = {"content": {"_type": "mapping", "package": "map", "name": "other", "classMappings": [{"_type": "pureInstance", "class": "shop::Party"}]}}
        clients = {"key": "k", "name": "full_name", "balance": "money", "kind": "segment", "tags": "tag_list", "codes": "code_list", "home": "address", "places": "addresses"}
        sales = {"key": "l_orderkey", "ordered": "o_orderdate", "shipped": "l_shipdate", "line": "l_linenumber", "amount": "l_extendedprice"}
        _model.append(Model(entities.decode([kind, party, place, client, sale, other, _mapping("clients", "Client", clients), _mapping("sales", "Sale", sales), _mapping("parties", "Party", {"key": "k", "name": "full_name"})])))
    return _model[0]


#: Columns of clients: property, expression in Spark, expression in DuckDB (None: the same).
_CLIENT = [
    ("key", "if(c_custkey % 41 = 0, null, c_custkey)", "CASE WHEN c_custkey % 41 <> 0 THEN c_custkey END"),
    ("name", "case when c_custkey % 11 = 0 then null when c_custkey % 7 = 0 then 'nobody' else c_name end", None),
    ("balance", "case when c_custkey % 5 <> 0 then c_acctbal end", None),
    ("kind", "case when c_custkey % 6 <> 0 then c_mktsegment end", None),
    ("tags", "case c_custkey % 4 when 0 then array() when 1 then array('a') when 2 then array('a', 'b', 'c') end", "CASE c_custkey % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a'] WHEN 2 THEN ['a', 'b', 'c'] END"),
    ("codes", "case c_custkey % 3 when 0 then array(1) when 1 then array(1, 2, 3) end", "CASE c_custkey % 3 WHEN 0 THEN [1] WHEN 1 THEN [1, 2, 3] END"),
    (
        "home",
        "case when c_custkey % 9 <> 0 then named_struct('nation', if(c_custkey % 8 = 0, null, c_nationkey), 'phone', 'x', 'kind', if(c_custkey % 2 = 0, c_mktsegment, null)) end",
        "CASE WHEN c_custkey % 9 <> 0 THEN {'nation': CASE WHEN c_custkey % 8 <> 0 THEN c_nationkey END, 'phone': 'x', 'kind': CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END} END",
    ),
    ("places", "case when c_custkey % 2 = 0 then array(named_struct('nation', cast(null as int), 'phone', cast(null as string), 'kind', 'nothing')) end", "CASE WHEN c_custkey % 2 = 0 THEN [{'nation': NULL::INTEGER, 'phone': NULL::VARCHAR, 'kind': 'nothing'}] END"),
]


def _clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw clients: the class's property names, and the row's own key."""
    schema = {f.name: f.dataType.simpleString() for f in model().schema("shop::Client")}  # nulls are allowed anywhere
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", *(F.expr(e).cast(schema[p]).alias(p) for p, e, _ in _CLIENT))


_CLIENT_SQL = "(SELECT c_custkey, " + ", ".join(f"{d or e} AS {p}" for p, e, d in _CLIENT) + " FROM customer)"
_KINDS = "('BUILDING', 'MACHINERY', 'FURNITURE')"
#: Rules of the class by name, and when they are broken.
_BROKEN = {
    "[key] is mandatory": "key IS NULL",
    "[name] is mandatory": "name IS NULL",
    "[kind] not allowed value": f"kind IS NOT NULL AND kind NOT IN {_KINDS}",
    "[tags] is mandatory": "tags IS NULL",
    "[tags] has invalid size": "tags IS NOT NULL AND len(tags) NOT BETWEEN 1 AND 2",
    "[codes] is mandatory": "codes IS NULL",
    "[codes] has invalid size": "codes IS NOT NULL AND len(codes) < 2",
    "[home.nation] is mandatory": "home IS NULL OR home.nation IS NULL",
    "[home.kind] not allowed value": f"home.kind IS NOT NULL AND home.kind NOT IN {_KINDS}",
}
_CONSTRAINTS = {"[name] begins as it should": "name IS NULL OR NOT starts_with(name, 'Customer#')", "[balance] is positive": "balance IS NULL OR balance <= 0"}


def _broken_sql(rules: dict[str, str]) -> str:
    listed = ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in rules.items())
    return f"SELECT c_custkey, coalesce(array_to_string(list_sort([{listed}]), ';'), '') AS violations FROM {_CLIENT_SQL}"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", F.array_join(F.array_sort("violations"), ";").alias("violations"))


def _class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(model().validate(_clients(spark, sf_dir), "shop::Client"))


def _mapping_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(model().validate(model().transform(_clients(spark, sf_dir), "map::clients"), "map::clients"))


def _rules_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules' SQL text in place of columns; the rule that can't be compiled is left out, alone."""
    rules = {k: v for k, v in model().expectations("map::clients").items() if not isinstance(v, Exception)}
    return _shown(frames.validate(model().transform(_clients(spark, sf_dir), "map::clients"), rules))


def _isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, "error" if isinstance(v, Exception) else "compiled") for k, v in model().expectations("map::clients").items()], "name string, outcome string")


def _client_query(question: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = model().transform(_clients(spark, sf_dir), "map::clients")
        return model().ask(spark, f"shop::Client->getAll()->{question}", "map::clients", lambda _: frame)

    return run


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice", F.expr("if(l_linenumber = 3, null, cast(l_shipdate as date))").alias("l_shipdate"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


_SALES_SQL = "(SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber <> 3 THEN CAST(l_shipdate AS DATE) END AS l_shipdate, CAST(o_orderdate AS DATE) AS o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _derived(as_text: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = model().derivations("map::sales") if as_text else model().derived_columns("map::sales")
        return frames.derive(_sales(spark, sf_dir), own).select("l_orderkey", "l_linenumber", *(F.col(c).cast("int").alias(c) for c in own))

    return run


_DERIVED_SQL = f"""
    SELECT l_orderkey, l_linenumber, CAST(a AS INTEGER) AS age, CAST(a * 12 + month(l_shipdate) - month(o_orderdate) AS INTEGER) AS months, CAST(l_shipdate - o_orderdate AS INTEGER) AS days,
           CAST(a * 2 AS INTEGER) AS twice, CAST(l_linenumber - a AS INTEGER) AS less, CAST(a + a * 2 - l_linenumber * a AS INTEGER) AS both, CAST(year(current_date) - year(o_orderdate) AS INTEGER) AS since
    FROM (SELECT *, year(l_shipdate) - year(o_orderdate) AS a FROM {_SALES_SQL})"""


def _asked(question: str, as_text: bool) -> Query:
    """A question as a DataFrame, or its SQL text run by Spark."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame, asked = _sales(spark, sf_dir), f"shop::Sale->getAll()->{question}"
        if as_text:
            return spark.sql(model().explain(asked, "map::sales").replace("shop.sales", "{sales}"), sales=frame)
        return model().ask(spark, asked, "map::sales", lambda _: frame)

    return run


_STEPS = {
    "after_take": (
        "project([x|$x.key, x|$x.line, x|$x.amount], ['key', 'line', 'amount'])->sort([desc('amount'), asc('key'), asc('line')])->take(50)->sort([asc('key'), asc('line')])->take(20)",
        f"SELECT * FROM (SELECT l_orderkey AS key, l_linenumber AS line, l_extendedprice AS amount FROM {_SALES_SQL} ORDER BY amount DESC, key, line LIMIT 50) ORDER BY key, line LIMIT 20",
    ),
    "grouped_filter": (
        "project([x|$x.key, x|$x.age], ['key', 'years'])->filter(x|$x.years >= 0)->groupBy([x|$x.years], [agg(x|$x.key, y|$y->count())], ['years', 'sales'])->filter(x|$x.sales > 10)",
        f"SELECT CAST(years AS INTEGER) AS years, sales FROM (SELECT years, count(l_orderkey) AS sales FROM (SELECT l_orderkey, year(l_shipdate) - year(o_orderdate) AS years FROM {_SALES_SQL}) WHERE years >= 0 GROUP BY 1) WHERE sales > 10",
    ),
    "dates": (
        "filter(x|$x.ordered >= %1996-01-01 && !($x.shipped > %1996-06-30))->project([x|$x.key, x|$x.line], ['key', 'line'])",
        f"SELECT l_orderkey AS key, l_linenumber AS line FROM {_SALES_SQL} WHERE o_orderdate >= DATE '1996-01-01' AND NOT (l_shipdate IS NOT NULL AND l_shipdate > DATE '1996-06-30')",
    ),
}


def _schema(path: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(model().schema(path))], "place int, field string, type string, nullable boolean")

    return run


def _class_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(model().expectations("shop::Client").items()), "name string, value string")


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a directory, and what each bad path says."""
    own = Model.from_directory(str(Path(models.__file__).parent))
    rows = [(name, type(own.entity(name)).__name__) for name in own.entity_names()]
    asked = {"no directory": lambda: Model.from_directory("/no/such/folder"), "a file": lambda: Model.from_directory(models.__file__), "no entity": lambda: own.entity("trade::nothing"), "not relational": lambda: model().table("map::other"), "not a mapping": lambda: own.table("trade::entity::Order")}
    for name, f in asked.items():
        try:
            f()
            rows.append((name, "no error"))
        except (ValueError, OSError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "name string, outcome string")


_LOADED = [
    *((f"trade::entity::{n}", "ClassEntity") for n in ("Customer", "Item", "Nation", "OpenVector", "Order", "Part", "Region", "Shipment", "Vector")),
    *((f"trade::entity::{n}", "EnumEntity") for n in ("OrderStatus", "Segment")),
    *((f"trade::mapping::{n}", "MappingEntity") for n in ("customer", "item", "nation", "open_vector", "order", "part", "region", "shipment", "vector")),
    *((f"trade::service::{n}", "ServiceEntity") for n in ("segments", "top_orders")),
    ("no directory", "FileNotFoundError"), ("a file", "NotADirectoryError"), ("no entity", "ValueError"), ("not relational", "ValueError"), ("not a mapping", "ValueError"),
]

_NESTED = T.StructType(
    [
        T.StructField("order_key", T.LongType(), False),
        T.StructField("buyer", T.StructType([T.StructField("full_name", T.StringType(), False), T.StructField("home", T.StructType([T.StructField("city", T.StringType())]))])),
        T.StructField("lines", T.ArrayType(T.StructType([T.StructField("amount", T.DoubleType(), False), T.StructField("shipped", T.DateType())])), False, {"comment": "what was sold"}),
    ]
)


def _lines(spark: SparkSession, text_: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text_.splitlines())), "line int, text string")


def _nested_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, codegen.from_schema("shop::made", "shop", "receipt", _NESTED))


def _with_tables(spark: SparkSession, sf_dir: str, f: Callable[[str], DataFrame]) -> DataFrame:
    """``f`` of the name of a new database of its own with tables region and nation."""
    name = f"modelweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    try:
        for t in ("region", "nation"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").write.saveAsTable(f"{name}.{t}")
        return f(name)
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the classes that are made from a database and from one table of it."""

    def run(name: str) -> DataFrame:
        rows = []
        for source, text_ in (("database", codegen.from_database(spark, "shop::made", name)), ("table", codegen.from_table(spark, "shop::made", name, "region"))):
            own = codegen.parse_model(text_)
            for path in sorted(own.entity_names()):
                if "::mapping::" in path:
                    rows += [(source, path, f.name, f.dataType.simpleString()) for f in own.schema(path)]
        return spark.createDataFrame(rows, "source string, mapping string, col string, type string")

    return _with_tables(spark, sf_dir, run)


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table after appends whose columns are as many, too many, and too many but accepted."""

    def run(name: str) -> DataFrame:
        table, rows = f"{name}.region", spark.read.parquet(f"{sf_dir}/region.parquet")
        more = rows.withColumn("extra", F.col("r_regionkey") * 10)
        tables_io.append(rows, table)
        try:
            tables_io.append(more, table)
            refused = False
        except ValueError:
            refused = True
        tables_io.append(more, table, evolve=True)
        known = {r["col_name"] for r in tables_io.describe(spark, table).collect()}
        found = spark.table(table).groupBy("r_regionkey", "extra").count().collect()
        return spark.createDataFrame([(r["r_regionkey"], r["extra"], r["count"], refused, {"extra", "Provider"} <= known) for r in found], "r_regionkey int, extra int, n long, refused boolean, described boolean")

    return _with_tables(spark, sf_dir, run)


def queries() -> dict[str, Query]:
    found = {
        "rules_of_class_with_nulls": _class_rules,
        "rules_of_mapping_with_nulls": _mapping_rules,
        "rules_as_text_with_nulls": _rules_as_text,
        "rule_that_fails_alone": _isolation,
        "expectations_nested": _class_texts,
        "filter_optional_with_nulls": _client_query("filter(x|!($x.balance > 0))->project([x|$x.name, x|$x.balance], ['name', 'balance'])"),
        "filter_empty_with_nulls": _client_query("filter(x|$x.kind->isEmpty() || $x.balance < 100)->project([x|$x.name, x|$x.kind, x|$x.balance], ['name', 'kind', 'balance'])"),
        "filter_not_empty_with_nulls": _client_query("filter(x|$x.tags->isNotEmpty() && $x.tags->size() >= 1)->project([x|$x.name, x|$x.home.nation], ['name', 'nation'])"),
        "schema_inherited": _schema("shop::Client"),
        "schema_of_mapping_inherited": _schema("map::clients"),
        "derivations_arithmetic": _derived(True),
        "derive_arithmetic": _derived(False),
        "load_directory": _loaded,
        "codegen_nested": _nested_text,
        "codegen_of_database": _generated,
        "append_drift": _drift,
    }
    for name, (question, _) in _STEPS.items():
        found[f"steps_{name}"], found[f"steps_{name}_as_text"] = _asked(question, False), _asked(question, True)
    return found


def _values(columns: str, rows: list[tuple]) -> str:
    def one(v) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


_PLACE = "struct<nation:int,phone:string,kind:string>"
_FIELDS = [
    ("key", "k", "bigint", False), ("name", "full_name", "string", False), ("balance", "money", "double", True), ("kind", "segment", "string", True), ("tags", "tag_list", "array<string>", False),
    ("codes", "code_list", "array<int>", False), ("home", "address", _PLACE, True), ("places", "addresses", f"array<{_PLACE}>", True),
]


def oracle_sql() -> dict[str, str]:
    found = {
        "rules_of_class_with_nulls": _broken_sql(_BROKEN),
        "rules_of_mapping_with_nulls": _broken_sql(_BROKEN | _CONSTRAINTS),
        "rules_as_text_with_nulls": _broken_sql(_BROKEN | _CONSTRAINTS),
        "rule_that_fails_alone": _values("name, outcome", [*((k, "compiled") for k in [*_BROKEN, *_CONSTRAINTS, "[places] has invalid size"]), ("[key] is odd one out", "error")]),
        "expectations_nested": _values(
            "name, value",
            [
                ("[key] is mandatory", "key IS NOT NULL"), ("[name] is mandatory", "name IS NOT NULL"), ("[kind] not allowed value", f"kind IS NULL OR kind IN {_KINDS}"),
                ("[tags] is mandatory", "tags IS NOT NULL"), ("[tags] has invalid size", "tags IS NULL OR (SIZE(tags) BETWEEN 1 AND 2)"), ("[codes] is mandatory", "codes IS NOT NULL"),
                ("[codes] has invalid size", "codes IS NULL OR SIZE(codes) >= 2"), ("[home.nation] is mandatory", "home.nation IS NOT NULL"),
                ("[home.kind] not allowed value", f"home.kind IS NULL OR home.kind IN {_KINDS}"), ("[places] has invalid size", "places IS NULL OR SIZE(places) >= 0"),
            ],
        ),
        "filter_optional_with_nulls": f"SELECT name, balance FROM {_CLIENT_SQL} WHERE NOT (balance IS NOT NULL AND balance > 0)",
        "filter_empty_with_nulls": f"SELECT name, kind, balance FROM {_CLIENT_SQL} WHERE kind IS NULL OR (balance IS NOT NULL AND balance < 100)",
        "filter_not_empty_with_nulls": f"SELECT name, home.nation AS nation FROM {_CLIENT_SQL} WHERE tags IS NOT NULL AND len(tags) >= 1",
        "schema_inherited": _values("place, field, type, nullable", [(k, p, kind, null) for k, (p, _, kind, null) in enumerate(_FIELDS)]),
        "schema_of_mapping_inherited": _values("place, field, type, nullable", [(k, c, kind, null) for k, (_, c, kind, null) in enumerate(_FIELDS)]),
        "derivations_arithmetic": _DERIVED_SQL,
        "derive_arithmetic": _DERIVED_SQL,
        "load_directory": _values("name, outcome", _LOADED),
        "codegen_nested": _values("line, text", list(enumerate(_NESTED_TEXT.splitlines()))),
        "codegen_of_database": _values(
            "source, mapping, col, type",
            [*(("database", "shop::made::mapping::Nation", c, t) for c, t in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))), *((s, "shop::made::mapping::Region", c, t) for s in ("database", "table") for c, t in (("r_regionkey", "int"), ("r_name", "string")))],
        ),
        "append_drift": "SELECT r_regionkey, extra, n, true AS refused, true AS described FROM (SELECT r_regionkey, CAST(NULL AS INTEGER) AS extra, CAST(2 AS BIGINT) AS n FROM region UNION ALL SELECT r_regionkey, CAST(r_regionkey * 10 AS INTEGER), 1 FROM region)",
    }
    for name, (_, sql) in _STEPS.items():
        found[f"steps_{name}"] = found[f"steps_{name}_as_text"] = sql
    return found


_NESTED_TEXT = """###Pure
Class shop::made::classes::ReceiptBuyerHome
{
  city: String[0..1];
}

Class shop::made::classes::ReceiptBuyerBase
{
  fullName: String[1];
}

Class shop::made::classes::ReceiptBuyer extends shop::made::classes::ReceiptBuyerBase
{
  home: shop::made::classes::ReceiptBuyerHome[0..1];
}

Class shop::made::classes::ReceiptBuyerSerializable extends shop::made::classes::ReceiptBuyerBase
{
  {meta::pure::profiles::doc.doc = 'JSON wrapper for nested property [home]'} home: String[0..1];
}

Class shop::made::classes::ReceiptLines
{
  amount: Decimal[1];
  shipped: Date[0..1];
}

Class shop::made::classes::ReceiptBase
{
  orderKey: Number[1];
}

Class shop::made::classes::Receipt extends shop::made::classes::ReceiptBase
{
  buyer: shop::made::classes::ReceiptBuyer[0..1];
  {meta::pure::profiles::doc.doc = 'what was sold'} lines: shop::made::classes::ReceiptLines[1..*];
}

Class shop::made::classes::ReceiptSerializable extends shop::made::classes::ReceiptBase
{
  {meta::pure::profiles::doc.doc = 'JSON wrapper for nested property [buyer]'} buyer: String[0..1];
  {meta::pure::profiles::doc.doc = 'JSON wrapper for nested property [lines]'} lines: String[1..*];
}

###Mapping
Mapping shop::made::mapping::Receipt
(
  *shop::made::classes::ReceiptSerializable: Relational
  {
    ~primaryKey
    (
      [shop::made::Store]shop.receipt.order_key,
      [shop::made::Store]shop.receipt.buyer,
      [shop::made::Store]shop.receipt.lines
    )
    ~mainTable [shop::made::Store]shop.receipt
    orderKey: [shop::made::Store]shop.receipt.order_key,
    buyer: [shop::made::Store]shop.receipt.buyer,
    lines: [shop::made::Store]shop.receipt.lines
  }
)

###Relational
Database shop::made::Store
(
  Schema shop
  (
    Table receipt
    (
      order_key BIGINT,
      buyer VARCHAR(2147483647),
      lines VARCHAR(2147483647)
    )
  )
)
"""
