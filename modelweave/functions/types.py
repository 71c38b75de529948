"""Type maps between models, Spark and relational stores."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: types of the model language and what they are in Spark
FORWARD: dict[str, T.DataType] = {
    "String": T.StringType(),
    "Boolean": T.BooleanType(),
    "Byte": T.ByteType(),
    "Binary": T.BinaryType(),
    "Integer": T.IntegerType(),
    "Short": T.ShortType(),
    "Number": T.LongType(),
    "Float": T.FloatType(),
    "Decimal": T.DoubleType(),
    "Date": T.DateType(),
    "StrictDate": T.DateType(),
    "DateTime": T.TimestampType(),
}

# fixed values: types of Spark and what they are in models and relational stores
REVERSE: dict[type, tuple[str, str]] = {
    T.FloatType: ("Float", "DOUBLE"),
    T.DoubleType: ("Decimal", "DOUBLE"),
    T.ByteType: ("Integer", "TINYINT"),
    T.ShortType: ("Integer", "SMALLINT"),
    T.IntegerType: ("Integer", "INTEGER"),
    T.LongType: ("Number", "BIGINT"),
    T.StringType: ("String", "VARCHAR(2147483647)"),
    T.BooleanType: ("Boolean", "BIT"),
    T.BinaryType: ("Binary", "BINARY(2147483647)"),
    T.DateType: ("Date", "DATE"),
    T.TimestampType: ("DateTime", "TIMESTAMP"),
    T.TimestampNTZType: ("DateTime", "TIMESTAMP"),  # our extension
}
NESTED_COLUMN = "VARCHAR(2147483647)"


def spark_type(name: str) -> T.DataType:
    if name not in FORWARD:
        raise ValueError(f"unsupported type: {name}")
    return FORWARD[name]


def model_type(kind: T.DataType) -> tuple[str, str]:
    """(model type, column type); arrays are those of their elements."""
    if isinstance(kind, T.ArrayType):
        return model_type(kind.elementType)
    found = REVERSE.get(type(kind))
    if found is None:
        raise ValueError(f"unsupported type: {kind.simpleString()}")
    return found
