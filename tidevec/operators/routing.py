"""Two-level search: centroids vote for buckets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import l2_sq
from .blocks import BLOCK, counted, nearest
from .knn import fits, knn, small, top

#: Buckets that a search in blocks tells apart, a bit for each query and bucket.
MOST_BUCKETS = 1 << 16


def mean_rows(vectors: DataFrame) -> DataFrame:
    """cid, ts, dim, value: two means per bucket (of even and of odd ids)."""
    cid = (F.col("ts") * 2 + F.col("id") % 2).alias("cid")
    return vectors.select(cid, "ts", F.posexplode("v").alias("dim", "x")).groupBy("cid", "ts", "dim").agg(F.round(F.avg("x"), 9).alias("value"))


def as_vectors(rows: DataFrame) -> DataFrame:
    """cid, ts, centroid of mean_rows()."""
    return rows.groupBy("cid", "ts").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("c")).select("cid", "ts", F.col("c.value").alias("centroid"))


def lloyd_step(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, cid: each vector's nearest centroid within its bucket; the means of these are the next centroids."""
    pairs = vectors.join(centroids, "ts").select("id", "cid", l2_sq("v", "centroid").alias("dist"))
    return top(pairs, 1, "id", ("dist", "cid")).select("id", "cid")


def kmeans_centroids(vectors: DataFrame, k: int | None = None, steps: int = 30, sample: int = 20_000, most: int = 2048, seed: int = 3) -> DataFrame:
    """cid, ts, centroid: k centroids of each bucket (16 times the root of its rows if k is not given, at most `most` and one a row) by Lloyd steps, until nothing moves.

    They are fitted on about `sample` rows of a bucket at most, chosen by a hash of the id, so no task holds a whole bucket; which centroid is a
    vector's, lloyd_step() tells for every row. Null vectors are left out; a centroid that loses all rows stays where it is. No rows: no centroids.
    """
    rows = vectors.filter("v is not null").select("id", "ts", "v")
    sizes = rows.groupBy("ts").agg(F.count("*").alias("n"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / (1 << 30)
    some = rows.join(sizes, "ts").filter(chance * F.col("n") < sample)

    def fit(key, frame):
        frame = frame.sort_values("id")
        x, n = np.stack(frame["v"].to_numpy()).astype(float), int(frame["n"].iloc[0])
        want = min(k or math.ceil(16 * math.sqrt(n)), most, len(x))
        c = x[np.random.default_rng(seed).permutation(len(x))[:want]].copy()
        own = None
        for _ in range(steps):
            far = (c * c).sum(axis=1)
            last, own = own, np.concatenate([(far - 2 * (x[i : i + 2048] @ c.T)).argmin(axis=1) for i in range(0, len(x), 2048)])
            if last is not None and (last == own).all():
                break
            order = np.argsort(own, kind="stable")
            used, first = np.unique(own[order], return_index=True)
            c[used] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
        return pd.DataFrame({"cid": int(key[0]) * most + np.arange(want), "ts": int(key[0]), "centroid": list(c)})

    return some.groupBy("ts").applyInPandas(fit, "cid long, ts long, centroid array<double>")


def votes(queries: DataFrame, centroids: DataFrame, probe: int = 3) -> DataFrame:
    """qid, ts, votes among the 10 * probe nearest centroids."""
    if not fits(queries, "qv"):
        raise ValueError("too many queries to compare with all centroids: split them")
    return counted(queries, centroids, "cid", "centroid", 10 * probe)


def probed(votes_: DataFrame, probe: int = 3) -> DataFrame:
    return top(votes_, probe, "qid", (F.desc("votes"), "ts")).select("qid", "ts", F.col("rank").alias("ord"))


def routed_knn(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int = 10, probe: int = 3) -> DataFrame:
    """Exact search in each query's `probe` best buckets: an equi-join on the bucket, or block against block where these are a quarter of all buckets or more."""
    best = probed(votes(queries, centroids, probe), probe).select("qid", "ts")
    told = vectors.filter("ts is not null").select("ts").distinct().limit(4 * probe + 1).toArrow()["ts"]
    if 0 < len(told) <= min(4 * probe, MOST_BUCKETS):
        pairs = nearest(queries, vectors, k, broadcast=fits(queries, "qv", 8 * BLOCK), own=(best.filter("ts is not null"), np.sort(np.asarray(told))))
        return top(pairs, k, order=(F.asc_nulls_last("dist"), "id")).select("qid", "rank", "id", "dist")
    where = best.join(small(queries.select("qid", "qv"), "qv"), "qid").select("qid", "qv", "ts")
    pairs = vectors.join(small(where, "qv"), "ts").select("qid", "id", l2_sq("v", "qv").alias("dist"))
    return top(pairs, k, order=(F.asc_nulls_last("dist"), "id")).select("qid", "rank", "id", "dist")


def entry_points(vectors: DataFrame, centroids: DataFrame, n: int = 5) -> DataFrame:
    """cid, rank, id: the rows of its bucket nearest to each centroid."""
    q = centroids.select(F.col("cid").alias("qid"), F.col("ts").alias("qts"), F.col("centroid").alias("qv"))
    return knn(q, vectors, n, by_bucket=True).select(F.col("qid").alias("cid"), "rank", "id")


def virtual_index(vectors: DataFrame, centroids: DataFrame, degree: int = 32, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """A graph over the centroids (src, slot, dst), from coarse cells, and each centroid's entry points (cid, rank, id) into its bucket."""
    from .cells import knn_cells
    from .graph import merged, pruned

    nodes = centroids.select(F.col("cid").alias("id"), "ts", F.col("centroid").alias("v"))
    return merged(pruned(knn_cells(nodes, 2 * degree), degree), degree), entry_points(vectors, centroids, n)
