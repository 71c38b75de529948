"""What the two vector operators share: which vectors take part, and their exact products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame) -> DataFrame:
    """Column ``ok``: the vector isn't null or zero and has no null or non-finite component."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return embeddings.withColumn("ok", F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)))
