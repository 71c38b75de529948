"""Operators on DataFrames: rename, validate, derive; all of them are projections that also stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default name of the column that holds violated rules.
VIOLATIONS = "violations"


def transform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rename properties to columns in one projection, so that swapped names are right.

    Names that the frame lacks are ignored, other columns stay as they are.
    """
    return df.select(*(F.col(f"`{c}`").alias(columns.get(c, c)) for c in df.columns))


def as_column(rule: Column | str) -> Column:
    return F.expr(rule) if isinstance(rule, str) else rule


def validate(df: DataFrame, rules: dict[str, Column | str], name: str = VIOLATIONS) -> DataFrame:
    """Add the names of the rules that a row violates, in the rules' order.

    A rule that is null counts as violated.  No row is dropped; a clean one has an empty array.
    """
    if not rules:
        return df.withColumn(name, F.array().cast("array<string>"))
    broken = [F.when(~F.coalesce(as_column(rule), F.lit(False)), F.lit(rule_name)) for rule_name, rule in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*broken)))


def explode_violations(df: DataFrame, name: str = VIOLATIONS) -> DataFrame:
    """One row per violation; clean rows vanish."""
    return df.withColumn(name, F.explode(name))


def violation_counts(df: DataFrame, name: str = VIOLATIONS) -> DataFrame:
    """Violations per rule, of an exploded or unexploded frame."""
    own = explode_violations(df, name) if dict(df.dtypes)[name].startswith("array") else df
    return own.groupBy(name).count()


def derive(df: DataFrame, derivations: dict[str, Column | str]) -> DataFrame:
    """Add derived columns in one projection."""
    return df.withColumns({name: as_column(c) for name, c in derivations.items()})
