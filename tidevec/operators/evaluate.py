"""Recall, bound errors and graph statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(result: DataFrame, truth: DataFrame) -> DataFrame:
    hits = truth.select("qid", "id").join(result.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(F.count("hit").alias("hits"), F.count("*").alias("truth"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def bound_errors(result: DataFrame, vectors: DataFrame, start: int, end: int) -> DataFrame:
    return result.join(vectors.select("id", "ts"), "id").agg(F.count(F.when((F.col("ts") < start) | (F.col("ts") >= end), 1)).alias("errors"), F.count("*").alias("results"))


def bucket_spread(truth: DataFrame, vectors: DataFrame) -> DataFrame:
    n = truth.join(vectors.select("id", "ts"), "id").groupBy("qid").agg(F.countDistinct("ts").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("spread"), (F.ceil(F.avg("n")) + 1).cast("long").alias("probe"))


def degree_stats(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    d = vectors.select(F.col("id").alias("src")).join(edges.groupBy("src").count(), "src", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    return d.agg(F.round(F.avg("n"), 6).alias("avg_degree"), F.min("n").alias("min_degree"), F.max("n").alias("max_degree"), F.count(F.when(F.col("n") == 0, 1)).alias("no_edges"))


def overlap(edges: DataFrame, truth: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").alias("qid"), F.col("dst").alias("id")).distinct().withColumn("hit", F.lit(1))
    return truth.filter("qid <> id").join(e, ["qid", "id"], "left").agg(F.round(F.count("hit") / F.count("*"), 6).alias("overlap"))
