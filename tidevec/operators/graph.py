"""Proximity graphs as dataflow: prune by detours, reverse, merge, remote edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import wang_hash
from .blocks import nearest
from .cells import knn_cells
from .knn import as_queries, knn_graph, top


def detours(graph: DataFrame) -> DataFrame:
    """src, dst, rank, detour: for edge A-B, the neighbours D of A before B that have B as a neighbour; 255 at most."""
    e = graph.select("src", "dst", "rank")
    ad = e.select("src", F.col("dst").alias("mid"), F.col("rank").alias("mid_rank"))
    db = e.select(F.col("src").alias("mid"), "dst")
    n = ad.join(db, "mid").join(e, ["src", "dst"]).filter("mid_rank < rank").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return e.join(n, ["src", "dst"], "left").select("src", "dst", "rank", F.least(F.coalesce("n", F.lit(0)), F.lit(255)).cast("long").alias("detour"))


def pruned(graph: DataFrame, degree: int = 4) -> DataFrame:
    """src, slot, dst, detour: the edges with the fewest detours, nearer ones first."""
    w = Window.partitionBy("src").orderBy("detour", "rank")
    return detours(graph).withColumn("slot", (F.row_number().over(w) - 1).cast("long")).filter(F.col("slot") < degree).select("src", "slot", "dst", "detour")


def occluded(graph: DataFrame, vectors: DataFrame, degree: int = 4) -> DataFrame:
    """src, slot, dst: the `degree` neighbours that a robust prune keeps of ranked candidates (src, rank, dst, dist).

    From near to far, a candidate is taken unless it lies nearer to one taken before than to src; free slots go to those passed over, near ones first.
    """
    rows = graph.join(vectors.select(F.col("id").alias("dst"), "v"), "dst")
    lists = rows.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist", "v"))).alias("m"))
    l2 = "aggregate(zip_with(r.v, c.v, (x, y) -> (x - y) * (x - y)), 0D, (s, z) -> s + z)"
    taken = f"aggregate(m, slice(m, 1, 0), (t, c) -> if(size(t) >= {degree} or exists(t, r -> {l2} < c.dist), t, concat(t, array(c))), t -> transform(t, c -> c.dst))"
    full = lists.select("src", F.transform("m", lambda c: c["dst"]).alias("all"), F.expr(taken).alias("t"))
    kept = F.slice(F.concat("t", F.array_except("all", "t")), 1, degree)
    return full.select("src", F.posexplode(kept).alias("slot", "dst")).select("src", F.col("slot").cast("long").alias("slot"), "dst")


def reversed_(edges: DataFrame, degree: int = 4) -> DataFrame:
    """dst, pos, src: for each node, who points at it, by slot and source, `degree` at most."""
    w = Window.partitionBy("dst").orderBy("slot", "src")
    return edges.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).filter(F.col("pos") < degree).select("dst", "pos", "src")


def merged(edges: DataFrame, degree: int = 4) -> DataFrame:
    """src, slot, dst: forward and reverse neighbours in turn, each the next not yet taken, never the node itself."""
    ordered = lambda key, at, to: F.transform(F.sort_array(F.collect_list(F.struct(key, at))), lambda x: x[at]).alias(to)
    fwd = edges.groupBy("src").agg(ordered("slot", "dst", "f"))
    rev = reversed_(edges, degree).groupBy(F.col("dst").alias("src")).agg(ordered("pos", "src", "r"))
    both = fwd.join(rev, "src", "full").select("src", F.coalesce("f", F.array().cast("array<bigint>")).alias("f"), F.coalesce("r", F.array().cast("array<bigint>")).alias("r"))
    fold = f"aggregate(sequence(1, {2 * degree}), cast(array() as array<bigint>), (t, i) -> if(size(t) >= {degree}, t, concat(t, slice(filter(if(i % 2 = 1, f, r), x -> not array_contains(t, x) and x <> src), 1, 1))))"
    return both.select("src", F.posexplode(F.expr(fold)).alias("slot", "dst")).select("src", F.col("slot").cast("long").alias("slot"), "dst")


def ordinals(vectors: DataFrame) -> DataFrame:
    """ts, o: the place of each bucket among all; as many rows as buckets."""
    return vectors.select("ts").distinct().withColumn("o", F.row_number().over(Window.orderBy("ts")).cast("long"))


def remote_edges(candidates: DataFrame, vectors: DataFrame, remote: int = 3, local: int = 2) -> DataFrame:
    """src, slot, dst, class of up to `remote` edges to other buckets from ranked candidates (src, rank, dst).

    A third from buckets nearby (a fifth of all buckets away, at least one), then far ones, then what is left nearby.
    """
    o = ordinals(vectors)
    near = F.greatest(F.lit(1), F.floor(F.lit(o.count()) / 5))
    place = vectors.select("id", "ts").join(F.broadcast(o), "ts")
    c = candidates.join(place.select(F.col("id").alias("src"), F.col("o").alias("so")), "src").join(place.select(F.col("id").alias("dst"), F.col("o").alias("do")), "dst").filter("so <> do")
    c = c.withColumn("near", F.abs(F.col("so") - F.col("do")) <= near)
    c = c.withColumn("n", F.row_number().over(Window.partitionBy("src", "near").orderBy("rank")))
    kind = F.when(F.col("near") & (F.col("n") <= remote // 3), 0).when(~F.col("near"), 1).otherwise(2)
    c = c.withColumn("k", kind).withColumn("slot", (F.row_number().over(Window.partitionBy("src").orderBy("k", "rank")) - 1).cast("long")).filter(F.col("slot") < remote)
    return c.select("src", (F.col("slot") + local).alias("slot"), "dst", F.when(F.col("near"), "near").otherwise("far").alias("class"))


def with_reverse(remote: DataFrame, own: DataFrame, degree: int = 4, local: int = 2, cap: int = 32) -> DataFrame:
    """src, slot, dst: remote edges (slots local to degree - 1) after nodes took edges back to those that point at them.

    Half of a node's remote slots, rounded down, stay as they are. Those who point at it come by (slot, src), `cap` at most; one that is a
    neighbour already, remote or in the own edges' slots below local, is passed over. It gets the first of the other slots that is free, or else
    the one that the next hash in a chain of its own, begun at the node's id, names. Nodes without remote edges take part; no edges give no rows. Repeated
    rows count once, and of two edges in one slot the larger dst stays.
    """
    n = degree - local
    strong, weak = n // 2, n - n // 2
    free = F.lit(-1).cast("long")
    held = remote.groupBy("src").agg(*[F.max(F.when(F.col("slot") == i, F.col("dst"))).alias(f"s{i}") for i in range(local, degree)])
    near = own.filter(F.col("slot") < local).groupBy("src").agg(F.collect_set("dst").alias("near"))
    w = Window.partitionBy("dst").orderBy("slot", "src")
    asked = remote.select("src", "slot", "dst").distinct().withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= cap)
    asked = asked.groupBy(F.col("dst").alias("src")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "src"))), lambda x: x["src"]).alias("back"))
    rows = held.join(asked, "src", "full").join(near, "src", "left")
    slots = [F.coalesce(f"s{i}", free) for i in range(local, degree)]
    none = F.array().cast("array<bigint>")
    rows = rows.select("src", F.array(*slots).alias("r"), F.coalesce("near", none).alias("near"), F.coalesce("back", none).alias("back"))

    def step(a, c):
        found = F.array_position(F.slice(a["r"], strong + 1, weak), free)
        chain = F.when(found > 0, a["h"]).otherwise(wang_hash(a["h"]))
        at = strong + F.when(found > 0, found - 1).otherwise(chain % weak)
        took = F.struct(F.transform(a["r"], lambda x, i: F.when(i == at, c).otherwise(x)).alias("r"), chain.alias("h"))
        return F.when(F.array_contains(a["r"], c) | F.array_contains("near", c), a).otherwise(took)

    done = F.aggregate("back", F.struct("r", wang_hash(F.col("src")).alias("h")), step, lambda a: a["r"])
    return rows.select("src", F.posexplode(done).alias("i", "dst")).filter(F.col("dst") != free).select("src", (F.col("i") + local).cast("long").alias("slot"), "dst")


def partitioned_graph(vectors: DataFrame, k: int = 8, degree: int = 4, local: int = 2, reach: int = 32, exact: bool = True) -> DataFrame:
    """src, slot, dst, kind: local slots from the bucket's own graph, remote slots from all; a bucket's edges fill remote slots that stay empty.

    exact: candidates for remote slots come from all pairs, compared in blocks; else from coarse cells (knn_cells()).
    """
    own = merged(pruned(knn_graph(vectors, k), degree), degree)
    if exact:
        pairs = nearest(as_queries(vectors), vectors, reach, other_bucket=True).select(F.col("qid").alias("src"), F.col("id").alias("dst"), "dist")
        ranked = top(pairs, reach, "src", (F.asc_nulls_last("dist"), "dst"))
    else:
        ranked = knn_cells(vectors, reach, other_bucket=True)
    far = remote_edges(ranked, vectors, degree - local, local).select("src", "slot", "dst", F.lit("remote").alias("kind"))
    mine = own.withColumn("kind", F.lit("local"))
    filler = mine.join(far.select("src", "slot"), ["src", "slot"], "left_anti")
    return far.unionByName(filler.select("src", "slot", "dst", "kind"))
