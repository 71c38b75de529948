"""Rename, validate and derive on a stream.  All are projections: no state, no shuffle, no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.model import Model


def read_json(spark: SparkSession, model: Model, path: str, class_path: str) -> DataFrame:
    """JSON files as they arrive, with the schema of a class."""
    return spark.readStream.schema(model.schema(class_path)).json(path)


def apply(model: Model, mapping: str, stream: DataFrame) -> DataFrame:
    """Physical columns, violated rules and derived columns of a stream of a class's properties."""
    return model.derive(model.validate(model.transform(stream, mapping), mapping), mapping)


def write(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):
    """Write what is there and stop; the checkpoint makes a restart go on where it ended."""
    return stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
