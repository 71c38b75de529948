"""Model-driven analytics on Spark."""

from .operators.codegen import from_database, from_schema, from_schemas, from_table, is_valid, parse_model
from .operators.frames import derive, explode_violations, transform, validate, violation_counts
from .operators.model import Model

__all__ = ["Model", "derive", "explode_violations", "from_database", "from_schema", "from_schemas", "from_table", "is_valid", "parse_model", "transform", "validate", "violation_counts"]
