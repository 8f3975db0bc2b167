"""Which search to run, from bucket counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import partitioned_graph
from ..operators.knn import in_range, knn


def strategy(selected: int, total: int, buckets: int) -> str:
    """'bucket' for one bucket, 'global' where nearly everything is selected, else 'range'."""
    if buckets == 1:
        return "bucket"
    return "global" if total and selected / total > 0.99 else "range"


def build_strategy(rows: int, buckets: int, exact: int = 15_000) -> str:
    """Exact joins within buckets of up to `exact` rows on average; coarse cells beyond."""
    return "exact" if rows <= exact * max(1, buckets) else "cells"


def knn_range_auto(queries: DataFrame, vectors: DataFrame, start: int, end: int, k: int = 10) -> DataFrame:
    inside = (F.col("ts") >= start) & (F.col("ts") < end)
    total, selected, buckets = vectors.agg(F.count("*"), F.count(F.when(inside, 1)), F.countDistinct(F.when(inside, F.col("ts")))).first()
    return knn(queries, vectors if strategy(selected, total, buckets) == "global" else in_range(vectors, start, end), k)


def partitioned_graph_auto(vectors: DataFrame, **parameters) -> DataFrame:
    """partitioned_graph() with remote candidates from all pairs of a small table, from coarse cells beyond."""
    return partitioned_graph(vectors, exact=build_strategy(vectors.count(), 1) == "exact", **parameters)
