"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import read, written

#: Rows of the communication matrix at most, whatever the number of input partitions.
BLOCKS = 4096


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard in a uniform shuffle with shard sizes at most one apart.

    The rows of the matrix are drawn in turn from the multivariate hypergeometric law of what the
    shards still have room for, so that the sums of rows and columns are exact.
    """
    total = sum(counts)
    room = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for b, n in enumerate(counts):
        left, rest = n, int(room.sum())
        for j in range(shards):  # marginal by marginal
            rest -= int(room[j])
            if left and room[j]:
                take = _hypergeometric(rng, int(room[j]), rest, left)
                out[b, j], left = take, left - take
        room -= out[b]
    return out


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """A draw from the hypergeometric law, of any size: its chances relative to the most likely number follow from the ratios of neighbours.

    They are summed as far as 12 deviations and more from that number, beyond which less than a double's last bit lies.
    """
    low, high, total = max(0, draws - bad), min(good, draws), good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = 12 * math.isqrt(draws * good // total * bad // total * (total - draws) // max(1, total - 1) + 1) + 60
    up = np.arange(mode, min(high, mode + spread), dtype=np.float64)
    down = np.arange(mode, max(low, mode - spread), -1, dtype=np.float64)
    above = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    below = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    chances = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return mode - len(below) + int(np.searchsorted(chances, rng.random() * chances[-1], "right"))


def shuffled_into_shards(df: DataFrame, shards: int = 16, seed: int = 17, cell_rows: int = 200_000) -> DataFrame:
    """df with shard (0 to shards-1) and slot (gapless from 0 in each shard): a uniform random permutation.

    Counts of shards are at most one apart. Every row is dealt with by its place in the input alone, so
    nulls, ties, repeated rows and empty tables need no case of their own; columns of df named rid,
    block, cell, shard or slot would clash and are an error. df is written to the shared folder once, with a row id: later
    passes and reruns after a lost executor then see the same ids.
    """
    spark = df.sparkSession
    clash = {"rid", "block", "cell", "shard", "slot"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    rows = written(df.withColumn("rid", F.monotonically_increasing_id()))
    rows = rows.withColumn("block", F.shiftright("rid", 33) % BLOCKS)
    counts = sorted((r[0], r[1]) for r in rows.groupBy("block").count().collect())  # BLOCKS rows at most
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    ends = spark.createDataFrame(
        [(int(b), [int(x) for x in np.cumsum(matrix[i])]) for i, (b, _) in enumerate(counts)],
        T.StructType([T.StructField("block", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))]),
    )
    rand = lambda salt: F.xxhash64(F.lit(seed + salt), F.col("rid"))
    local = F.row_number().over(Window.partitionBy("block").orderBy(rand(1), "rid")) - 1
    dealt = rows.withColumn("k", local).join(F.broadcast(ends), "block")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("k"))).cast("int")).drop("k", "ends")
    # The second permutation: cells of the random order first, so that no task sorts a whole shard.
    total = sum(n for _, n in counts)
    cells = max(1, -(-total // shards // cell_rows))
    dealt = dealt.withColumn("cell", F.pmod(rand(2), F.lit(cells)).cast("int"))
    if cells == 1:
        before = F.lit(0)
    else:
        dealt = written(dealt)
        sums = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # shards * cells rows
        first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        dealt = dealt.join(sums.select("shard", "cell", first.alias("before")), ["shard", "cell"])
        before = F.col("before")
    inner = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(rand(3), "rid")) - 1
    return dealt.withColumn("slot", (before + inner).cast("long")).select(*df.columns, "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shuffled_into_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
