"""Tables written in the shared checkpoint folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where that is unset and the master is local, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidevec-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidevec-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f.rpartition("/")[0])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose frames are gone; otherwise they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fold(doc_id, buckets: int):
    """crc32 of doc_id as text, modulo buckets; null where doc_id is null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % buckets


def batched(df: DataFrame, rows: int = 1000, size: int = 4 << 20) -> DataFrame:
    """df, after bounding the batches that Python workers get in its session, by rows and bytes. Operators call it themselves, as a session's default is 10,000 rows of any length.

    The bounds stay in force in the session, since frames are evaluated later; smaller ones that it has already are kept.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")
    if not now.isdigit() or int(now) > size:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
