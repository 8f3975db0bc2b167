"""Binary vector files, and index snapshots in Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def fvecs(spark: SparkSession, path: str) -> DataFrame:
    """file, n, v of .fvecs files (records of an int32 dimension and so many float32); mixed dimensions in a file are an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not raw:
                    continue
                dim = int(np.frombuffer(raw, "<i4", 1)[0])
                rows = np.frombuffer(raw, "<f4").reshape(-1, dim + 1)
                if (rows[:, 0].copy().view("<i4") != dim).any():
                    raise ValueError(f"{name}: dimensions differ")
                for at in range(0, len(rows), 10_000):
                    v = rows[at : at + 10_000, 1:]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(np.arange(at, at + len(v))), pa.array(list(v), pa.list_(pa.float32()))], names=["file", "n", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, n long, v array<float>")


def raw_floats(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """n, v of a headerless row-major float32 file of at most 2 GB, which one task reads."""
    rows = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                v = np.frombuffer(raw, "<f4").reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(list(v), pa.list_(pa.float32()))], names=["n", "v"])

    return rows.mapInArrow(parse, "n long, v array<float>")


def to_fvecs(vectors: list[list[float]]) -> bytes:
    out = bytearray()
    for v in vectors:
        out += np.int32(len(v)).astype("<i4").tobytes() + np.asarray(v, "<f4").tobytes()
    return bytes(out)


def save_index(path: str, vectors: DataFrame, edges: DataFrame, degree: int, local: int) -> None:
    """vectors partitioned by bucket, edges, and a row of parameters with the format's version."""
    vectors.write.mode("overwrite").partitionBy("ts").parquet(f"{path}/vectors")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    meta = vectors.agg(F.lit(VERSION).alias("version"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim"), F.lit(degree).alias("degree"), F.lit(local).alias("local_degree"), F.count("*").alias("size"))
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    if meta["version"] != VERSION:
        raise ValueError(f"index version {meta['version']}, not {VERSION}")
    vectors = spark.read.parquet(f"{path}/vectors").withColumn("ts", F.col("ts").cast("long"))
    return vectors, spark.read.parquet(f"{path}/edges"), meta


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)
