"""Exact nearest neighbours: pruned scans, equi-joins on the bucket and ranked windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import l2_sq
from .blocks import BLOCK, nearest

#: Numbers (ids and parts of vectors) that a side of a join may hold to be broadcast: 64 MB. Beyond, it is shuffled.
BROADCAST_NUMBERS = 8 << 20


def bucketized(embeddings: DataFrame, size: int = 50, last: int | None = None) -> DataFrame:
    """id, ts, v, label: ts = id / size, at most `last` if given."""
    ts = F.floor(F.col("vec_id") / size).cast("long")
    ts = ts if last is None else F.least(ts, F.lit(last))
    return embeddings.select(F.col("vec_id").alias("id"), ts.alias("ts"), F.col("embedding").cast("array<double>").alias("v"), "label")


def in_range(vectors: DataFrame, start: int, end: int) -> DataFrame:
    """Buckets start <= ts < end; on a table partitioned by ts this prunes files."""
    return vectors.filter((F.col("ts") >= start) & (F.col("ts") < end))


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").alias("qid"), F.col("ts").alias("qts"), F.col("v").alias("qv"))


def queries_of(vectors: DataFrame, every: int = 25) -> DataFrame:
    return as_queries(vectors.filter(F.col("id") % every == 0))


def fits(rows: DataFrame, vector: str | None = None, numbers: int | None = None) -> bool:
    """Whether rows, of a few numbers each and an array column `vector`, hold BROADCAST_NUMBERS (or numbers, if fewer) at most; at most so many rows are counted."""
    most = min(numbers or BROADCAST_NUMBERS, BROADCAST_NUMBERS)
    if vector is None:
        return rows.limit(most // 4 + 1).count() <= most // 4
    n = rows.select(F.coalesce(F.size(vector), F.lit(0)).alias("n")).limit(most // 4 + 1).agg(F.coalesce(F.sum(F.col("n") + 4), F.lit(0))).first()[0]
    return n <= most


def small(rows: DataFrame, vector: str | None = None) -> DataFrame:
    """rows, marked for broadcast if they fit, else as they are for a shuffled join."""
    return F.broadcast(rows) if fits(rows, vector) else rows


def top(pairs: DataFrame, k: int, key: str = "qid", order: tuple[str | Column, ...] = ("dist", "id")) -> DataFrame:
    """The first k of each key; Spark keeps k per key and task before the shuffle."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "l2", by_bucket: bool = False, other_bucket: bool = False) -> DataFrame:
    """qid, rank, id, dist of the k vectors nearest to each query, ties by id; metric: l2, or inner_product or cosine, largest first.

    All pairs are compared in blocks (see blocks.nearest); queries of a few blocks are broadcast. by_bucket: only
    vectors of the query's own bucket (an equi-join, by l2); other_bucket: only those of other buckets. Ranks go by the distance
    as it is, unrounded; vectors without a distance (nulls, other dimensions) come last.
    """
    if by_bucket:
        q = small(queries, "qv")
        pairs = vectors.join(q, vectors["ts"] == q["qts"]).select("qid", "id", l2_sq("v", "qv").alias("dist"))
    else:
        pairs = nearest(queries, vectors, k, metric, other_bucket=other_bucket, broadcast=fits(queries, "qv", 8 * BLOCK))
    ranked = top(pairs, k, order=(F.asc_nulls_last("dist") if metric == "l2" else F.desc("dist"), "id"))
    return ranked.select("qid", "rank", "id", "dist")


def knn_graph(vectors: DataFrame, k: int = 8, by_bucket: bool = True) -> DataFrame:
    """src, rank, dst, dist: each vector's k nearest others, in its bucket or in all (compared in blocks)."""
    if by_bucket:
        a = vectors.select(F.col("id").alias("src"), F.col("ts").alias("sts"), F.col("v").alias("sv"))
        pairs = a.join(vectors, (a["src"] != vectors["id"]) & (a["sts"] == vectors["ts"])).select("src", F.col("id").alias("dst"), l2_sq("sv", "v").alias("dist"))
    else:
        pairs = nearest(as_queries(vectors), vectors, k, others=True).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")
    return top(pairs, k, "src", (F.asc_nulls_last("dist"), "dst")).select("src", "rank", "dst", "dist")


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact distances of (qid, id) candidates, ranked; ids that vectors lacks are dropped."""
    pairs = candidates.distinct().join(vectors.select("id", "v"), "id").join(small(queries, "qv"), "qid")
    return top(pairs.select("qid", "id", l2_sq("v", "qv").alias("dist")), k).select("qid", "rank", "id", "dist")


def merge_topk(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    both = a.select("qid", "id", "dist").unionByName(b.select("qid", "id", "dist"))
    return top(both.groupBy("qid", "id").agg(F.min("dist").alias("dist")), k).select("qid", "rank", "id", "dist")


def pad(result: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k rows for each query; id and dist are null where there are fewer results."""
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("rank"))
    return slots.join(result, ["qid", "rank"], "left").select("qid", "rank", "id", "dist")
