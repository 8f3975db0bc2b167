"""Insertion of a batch into a partitioned graph, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import wang_hash
from .knn import as_queries, knn, small, top


def assigned(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """batch (ts, v, n: its order) with ids from the largest of existing on."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    return batch.crossJoin(F.broadcast(last)).select((F.col("last") + F.row_number().over(Window.orderBy("n"))).cast("long").alias("id"), "ts", "v")


def candidates(existing: DataFrame, batch: DataFrame, k: int = 8) -> DataFrame:
    """new_id, rank, id, dist among all existing rows."""
    return knn(as_queries(batch), existing, k).withColumnRenamed("qid", "new_id")


def local_candidates(existing: DataFrame, batch: DataFrame, k: int = 8) -> DataFrame:
    """The same among existing and new rows of the batch row's bucket, itself aside."""
    every = existing.select("id", "ts", "v").unionByName(batch.select("id", "ts", "v"))
    near = knn(as_queries(batch), every, k + 1, by_bucket=True).filter("qid <> id")
    return top(near.select("qid", "id", "dist"), k).select(F.col("qid").alias("new_id"), "rank", "id", "dist")


def filled(existing: DataFrame, batch: DataFrame, local: int = 2, remote: int = 2, k: int = 8) -> DataFrame:
    """src, slot, dst, kind: the new rows' edges; remote slots take other buckets first, then any candidate that is left."""
    own = local_candidates(existing, batch, k).filter(F.col("rank") <= local).select(F.col("new_id").alias("src"), (F.col("rank") - 1).alias("slot"), F.col("id").alias("dst"), F.lit("local").alias("kind"))
    c = candidates(existing, batch, k).join(own.select(F.col("src").alias("new_id"), F.col("dst").alias("id")), ["new_id", "id"], "left_anti")
    c = c.join(existing.select("id", "ts"), "id").join(small(batch.select(F.col("id").alias("new_id"), F.col("ts").alias("nts"))), "new_id")
    w = Window.partitionBy("new_id").orderBy(F.col("ts") == F.col("nts"), "rank")
    far = c.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= remote)
    return own.unionByName(far.select(F.col("new_id").alias("src"), (F.col("n") - 1 + local).cast("long").alias("slot"), F.col("id").alias("dst"), F.lit("remote").alias("kind")))


def mailbox(edges: DataFrame, vectors: DataFrame, local: int = 2, remote: int = 2) -> DataFrame:
    """node, kind, pos, src: who asks each node for an edge back; half of its slots of a kind at most. Remote requests within a bucket are dropped."""
    t = vectors.select("id", "ts")
    e = edges.join(t.select(F.col("id").alias("src"), F.col("ts").alias("sts")), "src").join(t.select(F.col("id").alias("dst"), "ts"), "dst")
    e = e.filter((F.col("kind") == "local") | (F.col("sts") != F.col("ts")))
    w = Window.partitionBy("dst", "kind").orderBy("slot", "src")
    cap = F.when(F.col("kind") == "local", local // 2).otherwise(remote // 2)
    return e.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).filter(F.col("pos") < cap).select(F.col("dst").alias("node"), "kind", "pos", "src")


def applied(requests: DataFrame, existing: DataFrame, local: int = 2, remote: int = 2) -> DataFrame:
    """node, slot, src: slots of existing rows that requests overwrite, the last request per slot winning.

    A local request goes to the first half of the slots one time in ten, else to the second half; a remote one to any remote slot. Chance is the
    hash of node and position.
    """
    r = requests.join(existing.select(F.col("id").alias("node")), "node", "left_semi")
    h = wang_hash(F.col("node") + F.col("pos"))
    g = wang_hash(h)
    half = max(1, local // 2)
    own = F.when(h % 10 == 0, g % half).otherwise(half + g % max(1, local - half))
    slot = F.when(F.col("kind") == "local", own).otherwise(local + g % remote)
    w = Window.partitionBy("node", "slot").orderBy(F.desc("pos"), F.desc("src"))
    return r.withColumn("slot", slot.cast("long")).withColumn("n", F.row_number().over(w)).filter("n = 1").select("node", "slot", "src")


def inserted(existing: DataFrame, graph: DataFrame, batch: DataFrame, local: int = 2, remote: int = 2) -> DataFrame:
    """The graph (src, slot, dst, kind) after a batch: a new snapshot."""
    new = filled(existing, batch, local, remote)
    every = existing.select("id", "ts").unionByName(batch.select("id", "ts"))
    over = applied(mailbox(new, every, local, remote), existing, local, remote).select(F.col("node").alias("src"), "slot", F.col("src").alias("dst"), F.when(F.col("slot") < local, "local").otherwise("remote").alias("kind"))
    return graph.join(over.select("src", "slot"), ["src", "slot"], "left_anti").unionByName(over).unionByName(new)
