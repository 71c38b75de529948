"""Reading and writing with a model's schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.model import Model


def read_json(spark: SparkSession, model: Model, path: str, class_path: str) -> DataFrame:
    """JSON lines with the schema of a class; nothing is inferred."""
    return spark.read.schema(model.schema(class_path)).json(path)


def append(df: DataFrame, table: str, evolve: bool = False) -> None:
    """Append to a table by name.  Columns that the table lacks are refused, or with ``evolve`` added to it."""
    spark = df.sparkSession
    known = {f.name.lower() for f in spark.table(table).schema}
    new = [f for f in df.schema if f.name.lower() not in known]
    if new and not evolve:
        raise ValueError(f"{table} has no column {', '.join(f.name for f in new)}")
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    spark.catalog.refreshTable(table)
    target = spark.table(table)
    have = {c.lower(): c for c in df.columns}
    rows = df.selectExpr(*(f"`{have[f.name.lower()]}` as `{f.name}`" if f.name.lower() in have else f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in target.schema))
    rows.write.insertInto(table)


def describe(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"DESCRIBE EXTENDED {table}")


def _needs_versions(spark: SparkSession, table: str) -> None:
    provider = {r["col_name"]: r["data_type"] for r in describe(spark, table).collect()}.get("Provider", "")
    if provider.lower() != "delta":
        raise NotImplementedError(f"{table} is kept as {provider or 'an unknown format'}; history needs a table format with versions (delta)")


def history(spark: SparkSession, table: str) -> DataFrame:
    _needs_versions(spark, table)
    return spark.sql(f"DESCRIBE HISTORY {table}")


def as_of(spark: SparkSession, table: str, version: int) -> DataFrame:
    _needs_versions(spark, table)
    return spark.read.option("versionAsOf", version).table(table)
