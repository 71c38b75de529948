"""Queries over the driver's tables, one or more per operator, and their SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scenarios
from .operators import codegen, frames
from .operators.model import Model, Resolver
from .sources import tables as tables_io

_ENTITY, _MAPPING = "trade::entity::", "trade::mapping::"
_models: dict[str, Model] = {}


def model() -> Model:
    if "own" not in _models:
        _models["own"] = Model.from_package("modelweave.models")
    return _models["own"]


def resolver(spark: SparkSession, sf_dir: str) -> Resolver:
    """Tables of the model as Parquet files; a shipment is an item with its order."""

    def read(name: str) -> DataFrame:
        own = name.split(".")[1]
        if own == "shipment":
            items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
            orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
            return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return spark.read.parquet(f"{sf_dir}/{own}.parquet")

    return read


def _asked(question: str, mapping: str) -> Callable[[SparkSession, str], DataFrame]:
    text = f"{_ENTITY}{question}"
    return lambda spark, sf_dir: model().ask(spark, text, _MAPPING + mapping, resolver(spark, sf_dir))


def _run(path: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: model().query(spark, f"trade::{path}", resolver(spark, sf_dir), **options)


def _raw(spark: SparkSession, sf_dir: str, mapping: str) -> DataFrame:
    """A table with the names of its class, as raw data come."""
    names = model().transformations(_MAPPING + mapping)
    return resolver(spark, sf_dir)(model().table(_MAPPING + mapping)).select(*(F.col(c).alias(p) for p, c in names.items()))


def _validated(spark: SparkSession, sf_dir: str, mapping: str = "customer") -> DataFrame:
    own = _MAPPING + mapping
    return model().validate(model().transform(_raw(spark, sf_dir, mapping), own), own)


def _key_and_rules(mapping: str, *keys: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _validated(spark, sf_dir, mapping).select(*keys, F.array_join("violations", ";").alias("violations"))

    return run


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.explode_violations(_validated(spark, sf_dir)).select("c_custkey", "violations")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.violation_counts(_validated(spark, sf_dir)).withColumnRenamed("count", "n")


def _derived(mapping: str, key: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _MAPPING + mapping
        return model().derive(resolver(spark, sf_dir)(model().table(own)), own).select(*key, *model().derived_columns(own))

    return run


def _pairs(get: Callable[[Model], dict[str, str]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(list(get(model()).items()), "name string, value string")

    return run


def _schema(path: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment", "")) for f in model().schema(f"trade::{path}")]
        return spark.createDataFrame(rows, "field string, type string, nullable boolean, comment string")

    return run


def _codegen(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = codegen.from_schema("trade::generated", "trade", "nation", spark.read.parquet(f"{sf_dir}/nation.parquet").schema)
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


def _codegen_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema becomes a model, and the model the query of its table."""
    text = codegen.from_schema("trade::generated", "trade", "nation", spark.read.parquet(f"{sf_dir}/nation.parquet").schema)
    return codegen.parse_model(text).query(spark, "trade::generated::mapping::Nation", resolver(spark, sf_dir))


_made: list[tuple[SparkSession, str]] = []


def _shared(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; removed when the driver ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="modelweave-")
    _made.append((spark, path := f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone: nothing is left to remove it with
            return


def _json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark, "json")
    _raw(spark, sf_dir, "nation").write.json(path)
    return tables_io.read_json(spark, model(), path, _ENTITY + "Nation")


def _create_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model with the mapping's table in a database of its own, so that nobody's table is touched."""
    own, database = _MAPPING + "nation", f"modelweave_{uuid.uuid4().hex}"
    entities = dict(model().entities)
    entities[own] = replace(entities[own], schema=database)
    apart = Model(entities)
    spark.sql(f"CREATE DATABASE {database}")
    name = apart.create_table(spark, own, _shared(spark, "table"))
    tables_io.append(apart.transform(_raw(spark, sf_dir, "nation"), own), name)
    rows = spark.table(name)
    found = spark.createDataFrame(rows.collect(), rows.schema)  # 25 rows: a nation each
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "scan_all": _asked("Region->getAll()->project([x|$x.regionKey, x|$x.name], ['key', 'name'])", "region"),
        "filter_gt_mandatory": _asked("Item->getAll()->filter(x|$x.quantity > 45)->project([x|$x.orderKey, x|$x.line, x|$x.quantity], ['orderKey', 'line', 'quantity'])", "item"),
        "filter_gt_optional": _asked("Order->getAll()->filter(x|$x.totalPrice > 300000)->project([x|$x.orderKey, x|$x.totalPrice], ['orderKey', 'totalPrice'])", "order"),
        "filter_ge_le": _asked("Part->getAll()->filter(x|$x.size >= 10 && $x.size <= 12)->project([x|$x.partKey, x|$x.size], ['partKey', 'size'])", "part"),
        "filter_equal": _asked("Item->getAll()->filter(x|$x.flag = 'R')->project([x|$x.orderKey, x|$x.line], ['orderKey', 'line'])", "item"),
        "filter_in": _asked("Customer->getAll()->filter(x|$x.segment->in(['BUILDING', 'HOUSEHOLD']))->project([x|$x.customerKey, x|$x.segment], ['customerKey', 'segment'])", "customer"),
        "filter_in_enum_sources": _asked("Order->getAll()->filter(x|$x.status->in(['Open']))->project([x|$x.orderKey, x|$x.status], ['orderKey', 'status'])", "order"),
        "filter_not_empty": _asked("Customer->getAll()->filter(x|!$x.segment->isEmpty())->project([x|$x.customerKey], ['customerKey'])", "customer"),
        "filter_or_and": _asked("Customer->getAll()->filter(x|$x.balance > 9000 || ($x.nation > 20 && $x.segment->isNotEmpty()))->project([x|$x.customerKey, x|$x.nation], ['customerKey', 'nation'])", "customer"),
        "filter_chained": _asked("Customer->getAll()->filter(x|$x.balance > 5000)->filter(x|$x.nation > 10)->project([x|$x.customerKey], ['customerKey'])", "customer"),
        "filter_starts_with": _asked("Part->getAll()->filter(x|$x.brand->startsWith('Brand#1'))->project([x|$x.partKey, x|$x.brand], ['partKey', 'brand'])", "part"),
        "project_rename": _asked("Order->getAll()->project([x|$x.orderKey, x|$x.priority], ['Order Key', 'Priority'])", "order"),
        "project_derived": _asked("Order->getAll()->project([x|$x.orderKey, x|$x.code], ['orderKey', 'code'])", "order"),
        "derive_substring_concat": _derived("customer", ["c_custkey"]),
        "derive_date_diff_years": _derived("shipment", ["o_orderkey", "l_linenumber"]),
        "group_average_count": _asked("Customer->getAll()->groupBy([x|$x.nation], [agg(x|$x.balance, y|$y->average()), agg(x|$x.customerKey, y|$y->count())], ['nation', 'balance', 'customers'])", "customer"),
        "group_sum_min_max": _asked("Item->getAll()->groupBy([x|$x.flag], [agg(x|$x.quantity, y|$y->sum()), agg(x|$x.price, y|$y->min()), agg(x|$x.price, y|$y->max())], ['flag', 'quantity', 'low', 'high'])", "item"),
        "sort_take": _asked("Order->getAll()->project([x|$x.orderKey, x|$x.totalPrice], ['key', 'price'])->sort([desc('price'), asc('key')])->take(25)", "order"),
        "mapping_query": _run("mapping::item"),
        "mapping_query_default": _run("mapping::shipment"),
        "mapping_query_strict": _run("mapping::shipment", strict=True),
        "service_query": _run("service::segments"),
        "service_project": _run("service::top_orders"),
        "transform_columns": lambda spark, sf_dir: model().transform(_raw(spark, sf_dir, "nation"), _MAPPING + "nation"),
        "validate_violations": _key_and_rules("customer", "c_custkey"),
        "explode_violations": _violations,
        "violation_metrics": _metrics,
        "rule_mandatory": _key_and_rules("nation", "n_nationkey"),
        "rule_enum": _key_and_rules("order", "o_orderkey"),
        "rule_size_bounded": _key_and_rules("vector", "vec_id"),
        "rule_size_unbounded": _key_and_rules("open_vector", "vec_id"),
        "schema_class": _schema("entity::Order"),
        "schema_mapping": _schema("mapping::vector"),
        "transformations": _pairs(lambda m: m.transformations(_MAPPING + "customer")),
        "expectations": _pairs(lambda m: m.expectations(_MAPPING + "customer")),
        "expectations_class": _pairs(lambda m: m.expectations(_ENTITY + "Vector")),
        "expectations_text": _pairs(lambda m: m.expectations(_MAPPING + "customer", compile=False)),
        "derivations": _pairs(lambda m: m.derivations(_MAPPING + "order")),
        "derivations_text": _pairs(lambda m: m.derivations(_MAPPING + "order", compile=False)),
        "target_table": _pairs(lambda m: {"order": m.table(_MAPPING + "order")}),
        "sql_service": _pairs(lambda m: {"segments": m.sql("trade::service::segments")}),
        "codegen_table": _codegen,
        "codegen_round_trip": _codegen_sql,
        "read_json_schema": _json_round_trip,
        "create_append_table": _create_append,
        **scenarios.queries(),
    }


_CUSTOMER_RULES = """
    CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD') THEN NULL ELSE '[segment] not allowed value' END AS v1,
    CASE WHEN c_acctbal > 0 THEN NULL ELSE '[balance] should be positive' END AS v2"""


def _values(columns: str, *rows: tuple) -> str:
    def one(v) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def oracle_sql() -> dict[str, str]:
    return {
        "scan_all": "SELECT r_regionkey AS key, r_name AS name FROM region",
        "filter_gt_mandatory": "SELECT l_orderkey AS orderKey, l_linenumber AS line, l_quantity AS quantity FROM lineitem WHERE l_quantity > 45",
        "filter_gt_optional": "SELECT o_orderkey AS orderKey, o_totalprice AS totalPrice FROM orders WHERE o_totalprice IS NOT NULL AND o_totalprice > 300000",
        "filter_ge_le": "SELECT p_partkey AS partKey, p_size AS size FROM part WHERE p_size >= 10 AND p_size <= 12",
        "filter_equal": "SELECT l_orderkey AS orderKey, l_linenumber AS line FROM lineitem WHERE l_returnflag = 'R'",
        "filter_in": "SELECT c_custkey AS customerKey, c_mktsegment AS segment FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')",
        "filter_in_enum_sources": "SELECT o_orderkey AS orderKey, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ('O')",
        "filter_not_empty": "SELECT c_custkey AS customerKey FROM customer WHERE NOT c_mktsegment IS NULL",
        "filter_or_and": "SELECT c_custkey AS customerKey, c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 OR (c_nationkey > 20 AND c_mktsegment IS NOT NULL)",
        "filter_chained": "SELECT c_custkey AS customerKey FROM customer WHERE c_acctbal > 5000 AND c_nationkey > 10",
        "filter_starts_with": "SELECT p_partkey AS partKey, p_brand AS brand FROM part WHERE starts_with(p_brand, 'Brand#1')",
        "project_rename": 'SELECT o_orderkey AS "Order Key", o_orderpriority AS "Priority" FROM orders',
        "project_derived": "SELECT o_orderkey AS orderKey, substring(o_orderstatus, 1, 1) || substring(o_orderpriority, 1, 1) AS code FROM orders",
        "derive_substring_concat": "SELECT c_custkey, substring(c_mktsegment, 1, 1) || substring(c_name, 1, 4) AS tag FROM customer",
        "derive_date_diff_years": "SELECT o_orderkey, l_linenumber, CAST(year(l_shipdate) - year(o_orderdate) AS INTEGER) AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "group_average_count": "SELECT c_nationkey AS nation, avg(c_acctbal) AS balance, count(c_custkey) AS customers FROM customer GROUP BY 1",
        "group_sum_min_max": "SELECT l_returnflag AS flag, sum(l_quantity) AS quantity, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1",
        "sort_take": "SELECT o_orderkey AS key, o_totalprice AS price FROM orders ORDER BY price DESC, key LIMIT 25",
        "mapping_query": "SELECT l_orderkey AS orderKey, l_linenumber AS line, l_quantity AS quantity, l_extendedprice AS price, l_returnflag AS flag FROM lineitem WHERE l_quantity > 5 AND l_extendedprice <= 50000",
        "mapping_query_default": "SELECT o_orderkey AS orderKey, l_linenumber AS line, o_orderdate AS orderDate, l_shipdate AS shipDate, CAST(year(l_shipdate) - year(o_orderdate) AS INTEGER) AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "mapping_query_strict": "SELECT o_orderkey AS orderKey, l_linenumber AS line, o_orderdate AS orderDate, l_shipdate AS shipDate, CAST(year(l_shipdate) - year(o_orderdate) AS INTEGER) AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(l_shipdate) - year(o_orderdate) > 0",
        "service_query": 'SELECT c_mktsegment AS "Segment", avg(c_acctbal) AS "Balance", count(c_custkey) AS "Customers" FROM customer WHERE NOT c_mktsegment IS NULL GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10',
        "service_project": "SELECT o_orderkey AS \"Order\", o_totalprice AS \"Total Price\", substring(o_orderstatus, 1, 1) || substring(o_orderpriority, 1, 1) AS \"Code\" FROM orders WHERE starts_with(o_orderpriority, '1') ORDER BY 2 DESC, 1 LIMIT 10",
        "transform_columns": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "validate_violations": f"SELECT c_custkey, concat_ws(';', v1, v2) AS violations FROM (SELECT c_custkey, {_CUSTOMER_RULES} FROM customer)",
        "explode_violations": f"SELECT c_custkey, v AS violations FROM (SELECT c_custkey, unnest([v1, v2]) AS v FROM (SELECT c_custkey, {_CUSTOMER_RULES} FROM customer)) WHERE v IS NOT NULL",
        "violation_metrics": f"SELECT v AS violations, count(*) AS n FROM (SELECT unnest([v1, v2]) AS v FROM (SELECT {_CUSTOMER_RULES} FROM customer)) WHERE v IS NOT NULL GROUP BY 1",
        "rule_mandatory": "SELECT n_nationkey, concat_ws(';', CASE WHEN n_nationkey IS NULL THEN '[nationKey] is mandatory' END, CASE WHEN n_name IS NULL THEN '[name] is mandatory' END, CASE WHEN n_regionkey IS NULL THEN '[regionKey] is mandatory' END) AS violations FROM nation",
        "rule_enum": "SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderstatus IN ('F', 'O', 'Partial') THEN NULL ELSE '[status] not allowed value' END, CASE WHEN o_totalprice > 0 THEN NULL ELSE '[total price] should be positive' END, CASE WHEN o_totalprice >= 100000 THEN NULL ELSE '[total price] should be high' END) AS violations FROM orders",
        "rule_size_bounded": "SELECT vec_id, CASE WHEN len(embedding) BETWEEN 1 AND 32 THEN '' ELSE '[components] has invalid size' END AS violations FROM embeddings",
        "rule_size_unbounded": "SELECT vec_id, CASE WHEN len(embedding) >= 1 THEN '' ELSE '[components] has invalid size' END AS violations FROM embeddings",
        "schema_class": _values(
            "field, type, nullable, comment", ("orderKey", "bigint", False, "Key of the order"), ("customerKey", "bigint", False, ""), ("status", "string", True, "State of the order"),
            ("totalPrice", "double", True, "Price of all items"), ("orderDate", "timestamp", False, ""), ("priority", "string", False, ""),
        ),
        "schema_mapping": _values("field, type, nullable, comment", ("vec_id", "bigint", False, ""), ("embedding", "array<float>", False, ""), ("label", "int", True, "")),
        "transformations": _values("name, value", ("customerKey", "c_custkey"), ("name", "c_name"), ("nation", "c_nationkey"), ("balance", "c_acctbal"), ("segment", "c_mktsegment")),
        "expectations": _values(
            "name, value", ("[customerKey] is mandatory", "c_custkey IS NOT NULL"), ("[name] is mandatory", "c_name IS NOT NULL"), ("[nation] is mandatory", "c_nationkey IS NOT NULL"),
            ("[segment] not allowed value", "(c_mktsegment IS NULL OR c_mktsegment IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD'))"), ("[balance] should be positive", "(c_acctbal IS NOT NULL AND c_acctbal > 0)"),
        ),
        "expectations_class": _values("name, value", ("[vectorId] is mandatory", "vectorId IS NOT NULL"), ("[components] is mandatory", "components IS NOT NULL"), ("[components] has invalid size", "components IS NULL OR (SIZE(components) BETWEEN 1 AND 32)")),
        "expectations_text": _values(
            "name, value", ("[customerKey] is mandatory", "$this.customerKey->isNotEmpty()"), ("[name] is mandatory", "$this.name->isNotEmpty()"), ("[nation] is mandatory", "$this.nation->isNotEmpty()"),
            ("[segment] not allowed value", "$this.segment->isEmpty() || $this.segment->in(['MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD'])"), ("[balance] should be positive", "$this.balance > 0"),
        ),
        "derivations": _values("name, value", ("code", "concat(substring(o_orderstatus, 0, 1), substring(o_orderpriority, 0, 1))")),
        "derivations_text": _values("name, value", ("code", "$this.status->substring(0,1) + $this.priority->substring(0,1)")),
        "target_table": _values("name, value", ("order", "trade.orders")),
        "sql_service": _values(
            "name, value",
            ("segments", "select `root`.c_mktsegment as `Segment`, avg(1.0 * `root`.c_acctbal) as `Balance`, count(`root`.c_custkey) as `Customers` from trade.customer as `root` where not `root`.c_mktsegment is null group by `Segment` order by `Customers` desc, `Segment` asc limit 10"),
        ),
        "codegen_table": _values("line, text", *enumerate(_NATION_TEXT.splitlines())),
        "codegen_round_trip": 'SELECT n_nationkey AS "nNationkey", n_name AS "nName", n_regionkey AS "nRegionkey" FROM nation',
        "read_json_schema": "SELECT n_nationkey AS nationKey, n_name AS name, n_regionkey AS regionKey FROM nation",
        "create_append_table": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
        **scenarios.oracle_sql(),
    }


_NATION_TEXT = """###Pure
Class trade::generated::classes::Nation
{
  nNationkey: Integer[0..1];
  nName: String[0..1];
  nRegionkey: Integer[0..1];
}

###Mapping
Mapping trade::generated::mapping::Nation
(
  *trade::generated::classes::Nation: Relational
  {
    ~primaryKey
    (
      [trade::generated::Store]trade.nation.n_nationkey,
      [trade::generated::Store]trade.nation.n_name,
      [trade::generated::Store]trade.nation.n_regionkey
    )
    ~mainTable [trade::generated::Store]trade.nation
    nNationkey: [trade::generated::Store]trade.nation.n_nationkey,
    nName: [trade::generated::Store]trade.nation.n_name,
    nRegionkey: [trade::generated::Store]trade.nation.n_regionkey
  }
)

###Relational
Database trade::generated::Store
(
  Schema trade
  (
    Table nation
    (
      n_nationkey INTEGER,
      n_name VARCHAR(2147483647),
      n_regionkey INTEGER
    )
  )
)
"""
