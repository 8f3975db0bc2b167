"""The vector engine's queries over the driver's tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vector import l2_sq, wang_hash
from .operators import evaluate, graph, insert, routing, search
from .operators.cells import knn_cells
from .operators.knn import as_queries, bucketized, in_range, knn, knn_graph, merge_topk, pad, queries_of, rerank
from .plans.planner import knn_range_auto, partitioned_graph_auto
from .streaming.inserts import counted, sessions

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None, dist: bool = False):
    """Registers a query with its SQL. dist: it has distances, which both round to six places after everything is ranked."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.withColumn("dist", F.round("dist", 6)) if "dist" in out.columns else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = f"SELECT * REPLACE (round(dist, 6) AS dist) FROM ({sql})" if dist else sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        self.events = spark.read.parquet(f"{sf_dir}/events.parquet")
        self.v = bucketized(self.embeddings)
        self.q = queries_of(self.v)
        self.new = self.v.filter("id % 25 = 24").select("id", "ts", "v")
        self.old = self.v.filter("id % 25 <> 24").select("id", "ts", "v")


# --- SQL building blocks -------------------------------------------------------------------------------------------


def dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


V = "v AS (SELECT vec_id AS id, cast(floor(vec_id / 50) AS BIGINT) AS ts, cast(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
Q = "q AS (SELECT id AS qid, ts AS qts, v AS qv FROM v WHERE id % 25 = 0)"
BASE = f"WITH RECURSIVE {V}, {Q}"


def ranked(on: str, k: int = 10, score: str | None = None, desc: str = "", q: str = "q", v: str = "v") -> str:
    return f"SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist {desc}, id) AS rank FROM (SELECT qid, id, {score or dist('v', 'qv')} AS dist FROM {q} JOIN {v} ON {on})) WHERE rank <= {k}"


def graph_of(on: str, k: int = 8) -> str:
    return f"SELECT src, rank, dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (SELECT a.id AS src, b.id AS dst, {dist('a.v', 'b.v')} AS dist FROM v a JOIN v b ON a.id <> b.id AND {on})) WHERE rank <= {k}"


G = f"g AS MATERIALIZED ({graph_of('a.ts = b.ts')})"
DET = "det AS MATERIALIZED (SELECT g.src, g.dst, g.rank, least(coalesce(n, 0), 255) AS detour FROM g LEFT JOIN (SELECT ad.src, e.dst, count(*) AS n FROM g ad JOIN g db ON db.src = ad.dst JOIN g e ON e.src = ad.src AND e.dst = db.dst WHERE ad.rank < e.rank GROUP BY ALL) x ON x.src = g.src AND x.dst = g.dst)"
PRU = "pru AS MATERIALIZED (SELECT src, slot, dst, detour FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY detour, rank) - 1 AS slot FROM det) WHERE slot < 4)"
REV = "rev AS MATERIALIZED (SELECT dst, pos, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY slot, src) - 1 AS pos FROM pru) WHERE pos < 4)"
MER = """lists AS MATERIALIZED (SELECT coalesce(f.src, r.dst) AS src, coalesce(f.f, []) AS f, coalesce(r.r, []) AS r FROM (SELECT src, list(dst ORDER BY slot) AS f FROM pru GROUP BY src) f FULL JOIN (SELECT dst, list(src ORDER BY pos) AS r FROM rev GROUP BY dst) r ON f.src = r.dst),
m AS (SELECT src, f, r, 0 AS step, cast([] AS BIGINT[]) AS t FROM lists UNION ALL
  SELECT src, f, r, step + 1, CASE WHEN len(t) >= 4 THEN t ELSE list_concat(t, list_slice(list_filter(CASE WHEN step % 2 = 0 THEN f ELSE r END, lambda x: NOT list_contains(t, x) AND x <> src), 1, 1)) END FROM m WHERE step < 8),
mer AS MATERIALIZED (SELECT src, cast(i - 1 AS BIGINT) AS slot, t[i] AS dst FROM m, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i) WHERE step = 8)"""
ORD = "o AS (SELECT ts, row_number() OVER (ORDER BY ts) AS o FROM (SELECT DISTINCT ts FROM v))"
GRAPH = f"{BASE}, {G}, {DET}, {PRU}, {REV}, {MER}"


def remote(r: int, k: int = 32) -> str:
    return f"""{ORD}, cand AS MATERIALIZED ({graph_of('a.ts <> b.ts', k)}),
c1 AS (SELECT cand.src, cand.rank, cand.dst, abs(x.o - y.o) <= greatest(1, floor((SELECT count(*) FROM o) / 5)) AS near FROM cand JOIN v a ON a.id = src JOIN v b ON b.id = dst JOIN o x ON x.ts = a.ts JOIN o y ON y.ts = b.ts),
c2 AS (SELECT *, row_number() OVER (PARTITION BY src, near ORDER BY rank) AS n FROM c1),
c3 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN near AND n <= {r // 3} THEN 0 WHEN NOT near THEN 1 ELSE 2 END, rank) - 1 AS slot FROM c2),
rem AS MATERIALIZED (SELECT src, slot + 2 AS slot, dst, CASE WHEN near THEN 'near' ELSE 'far' END AS class FROM c3 WHERE slot < {r})"""


def wang(x: str) -> str:
    a = f"((xor(xor({x}, 61), ({x}) >> 16) * 9) & 4294967295)"
    b = f"((xor({a}, {a} >> 4) * 668265261) & 4294967295)"
    return f"xor({b}, {b} >> 15)"


SEEDS = f"seeds AS MATERIALIZED (SELECT id FROM v ORDER BY {wang('(id + 17)')}, id LIMIT 8)"
EDGES = f"{GRAPH}, {remote(2)}, e AS MATERIALIZED (SELECT src, slot, dst, 'remote' AS kind FROM rem UNION ALL SELECT src, slot, dst, 'local' FROM mer WHERE NOT EXISTS (SELECT 1 FROM rem WHERE rem.src = mer.src AND rem.slot = mer.slot))"


def hops(n: int, edges: str, where: str, seeds: str = "seeds") -> str:
    out = [f"s0 AS MATERIALIZED (SELECT qid, id, {dist('v', 'qv')} AS dist, false AS visited FROM q CROSS JOIN (SELECT v.id, v.v FROM v JOIN {seeds} USING (id) WHERE {where}))"]
    for i in range(n):
        out.append(f"""b{i} AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM s{i} WHERE NOT visited) WHERE r <= 2),
k{i} AS (SELECT DISTINCT b.qid, x.dst AS id FROM b{i} b JOIN {edges} x ON x.src = b.id WHERE NOT EXISTS (SELECT 1 FROM s{i} s WHERE s.qid = b.qid AND s.id = x.dst)),
s{i + 1} AS MATERIALIZED (SELECT qid, id, dist, visited FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM (
  SELECT s.qid, s.id, s.dist, s.visited OR b.id IS NOT NULL AS visited FROM s{i} s LEFT JOIN b{i} b ON b.qid = s.qid AND b.id = s.id
  UNION ALL SELECT k.qid, k.id, {dist('v.v', 'q.qv')}, false FROM k{i} k JOIN v ON v.id = k.id JOIN q ON q.qid = k.qid WHERE {where})) WHERE r <= 16)""")
    return ",\n".join(out)


def best(n: int) -> str:
    return f"SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank, id, dist FROM s{n} QUALIFY rank <= 10"


NEW = "old AS (SELECT * FROM v WHERE id % 25 <> 24), new AS (SELECT id AS qid, ts AS qts, v AS qv FROM v WHERE id % 25 = 24)"
LOCAL = f"lc AS MATERIALIZED (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT qid, id, dist FROM ({ranked('ts = qts', 9, q='new')}) WHERE qid <> id) QUALIFY rank <= 8)"
GLOBAL = f"gc AS MATERIALIZED ({ranked('true', 8, q='new', v='old')})"
FILL = f"""{BASE}, {NEW}, {LOCAL}, {GLOBAL},
own AS (SELECT qid AS src, rank - 1 AS slot, id AS dst, 'local' AS kind FROM lc WHERE rank <= 2),
far AS (SELECT gc.qid AS src, row_number() OVER (PARTITION BY gc.qid ORDER BY old.ts = new.qts, gc.rank) + 1 AS slot, gc.id AS dst, 'remote' AS kind FROM gc JOIN old USING (id) JOIN new ON new.qid = gc.qid
  WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.src = gc.qid AND own.dst = gc.id) QUALIFY slot <= 3),
fill AS MATERIALIZED (SELECT * FROM own UNION ALL SELECT * FROM far)"""
MAIL = f"""{FILL}, mail AS MATERIALIZED (SELECT f.dst AS node, f.kind, row_number() OVER (PARTITION BY f.dst, f.kind ORDER BY f.slot, f.src) - 1 AS pos, f.src FROM fill f JOIN v a ON a.id = f.src JOIN v b ON b.id = f.dst
  WHERE f.kind = 'local' OR a.ts <> b.ts QUALIFY pos < 1)"""
MEANS = "means AS MATERIALIZED (SELECT ts * 2 + id % 2 AS cid, ts, i - 1 AS dim, round(avg(v[i]), 9) AS value FROM v, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) GROUP BY ALL)"
CENT = f"{BASE}, {MEANS}, cent AS MATERIALIZED (SELECT cid, ts, list(value ORDER BY dim) AS c FROM means GROUP BY ALL)"
VOTES = f"{CENT}, near AS (SELECT qid, ts FROM (SELECT qid, ts, row_number() OVER (PARTITION BY qid ORDER BY {dist('c', 'qv')}, cid) AS r FROM q CROSS JOIN cent) WHERE r <= 30), votes AS MATERIALIZED (SELECT qid, ts, count(*) AS votes FROM near GROUP BY ALL), probed AS MATERIALIZED (SELECT qid, ts, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, ts) AS ord FROM votes QUALIFY ord <= 3)"


# --- scans, buckets, filters ---------------------------------------------------------------------------------------


@query("SELECT vec_id AS id, cast(len(embedding) AS INTEGER) AS dim, label FROM embeddings")
def scan_embeddings(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"), "label")


@query(f"WITH {V} SELECT id, ts FROM v")
def bucketize(t: Tables) -> DataFrame:
    return t.v.select("id", "ts")


@query(f"WITH {V} SELECT id, least(ts, 5) AS ts FROM v")
def bucketize_clamped(t: Tables) -> DataFrame:
    return bucketized(t.embeddings, last=5).select("id", "ts")


@query(f"WITH {V} SELECT ts, count(*) AS n FROM v GROUP BY ts")
def bucket_sizes(t: Tables) -> DataFrame:
    return t.v.groupBy("ts").agg(F.count("*").alias("n"))


QUERIES["bucket_histogram"], ORACLE["bucket_histogram"] = QUERIES["bucket_sizes"], ORACLE["bucket_sizes"]


@query(f"WITH {V} SELECT ts, cast(coalesce(sum(count(*)) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM v GROUP BY ts")
def bucket_offsets(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    before = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)  # over one row per bucket
    return t.v.groupBy("ts").agg(F.count("*").alias("n")).select("ts", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


@query(f"WITH {V} SELECT ts, id FROM v WHERE ts = 3")
def ids_by_bucket(t: Tables) -> DataFrame:
    return t.v.filter("ts = 3").select("ts", "id")


@query(f"WITH {V} SELECT ts, row_number() OVER (PARTITION BY ts ORDER BY id) - 1 AS local_idx, id FROM v")
def local_index(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    return t.v.select("ts", (F.row_number().over(Window.partitionBy("ts").orderBy("id")) - 1).cast("long").alias("local_idx"), "id")


QUERIES["group_by_bucket"], ORACLE["group_by_bucket"] = QUERIES["local_index"], ORACLE["local_index"]


@query(f"{BASE} SELECT qid AS a, id AS b, {dist('v', 'qv')} AS dist FROM q JOIN v ON ts = qts", dist=True)
def l2_distance(t: Tables) -> DataFrame:
    return t.v.join(F.broadcast(t.q), F.col("ts") == F.col("qts")).select(F.col("qid").alias("a"), F.col("id").alias("b"), l2_sq("v", "qv").alias("dist"))


@query(f"WITH {V} SELECT id, {wang('id')} AS h FROM v")
def wang_hash_ids(t: Tables) -> DataFrame:
    return t.v.select("id", wang_hash(F.col("id")).alias("h"))


for _name, _cond in (("filter_bucket_eq", "ts = 3"), ("filter_bucket_range", "ts >= 2 AND ts < 5"), ("filter_bucket_between", "ts BETWEEN 2 AND 5")):
    QUERIES[_name] = lambda spark, d, c=_cond: Tables(spark, d).v.filter(c).select("id", "ts")
    ORACLE[_name] = f"WITH {V} SELECT id, ts FROM v WHERE {_cond}"


# --- exact search --------------------------------------------------------------------------------------------------


@query(f"{BASE} {ranked('true')}", dist=True)
def knn_global(t: Tables) -> DataFrame:
    return knn(t.q, t.v)


@query(f"{BASE} {ranked('ts = qts')}", dist=True)
def knn_bucket(t: Tables) -> DataFrame:
    return knn(t.q, t.v, by_bucket=True)


@query(f"{BASE} {ranked('ts >= 2 AND ts < 6')}", dist=True)
def knn_range(t: Tables) -> DataFrame:
    return knn(t.q, in_range(t.v, 2, 6))


@query(ORACLE["knn_range"])
def knn_range_planned(t: Tables) -> DataFrame:
    return knn_range_auto(t.q, t.v, 2, 6)


@query(f"{BASE} {ranked('ts <> qts')}", dist=True)
def knn_cross_bucket(t: Tables) -> DataFrame:
    return knn(t.q, t.v, other_bucket=True)


DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


@query(f"{BASE} {ranked('true', score=DOT.format(a='v', b='qv'), desc='DESC')}", dist=True)
def knn_inner_product(t: Tables) -> DataFrame:
    return knn(t.q, t.v, metric="inner_product")


@query(f"{BASE} {ranked('true', score=DOT.format(a='v', b='qv') + ' / sqrt(' + DOT.format(a='v', b='v') + ' * ' + DOT.format(a='qv', b='qv') + ')', desc='DESC')}", dist=True)
def knn_cosine(t: Tables) -> DataFrame:
    return knn(t.q, t.v, metric="cosine")


@query(f"{BASE} {ranked('id % 7 = qid % 7')}", dist=True)
def rerank_exact(t: Tables) -> DataFrame:
    c = t.v.join(F.broadcast(t.q), F.col("id") % 7 == F.col("qid") % 7).select("qid", "id")
    return rerank(c, t.q, t.v, 10)


@query(f"{BASE} {ranked('ts IN (1, 2, 3, 4, 5)')}", dist=True)
def merge_topk_lists(t: Tables) -> DataFrame:
    return merge_topk(knn(t.q, in_range(t.v, 1, 4)), knn(t.q, in_range(t.v, 3, 6)), 10)


@query(f"{BASE} {ranked('ts IN (1, 3, 5)')}", dist=True)
def merge_bucket_topk(t: Tables) -> DataFrame:
    one = lambda b: knn(t.q, t.v.filter(F.col("ts") == b))
    return merge_topk(merge_topk(one(1), one(3), 10), one(5), 10)


@query(f"{BASE}, r AS ({ranked('id < 4')}) SELECT qid, s.rank, r.id, r.dist FROM (SELECT qid, unnest(range(1, 11)) AS rank FROM q) s LEFT JOIN r USING (qid, rank)", dist=True)
def pad_topk(t: Tables) -> DataFrame:
    return pad(knn(t.q, t.v.filter("id < 4")), t.q, 10)


# --- graph ---------------------------------------------------------------------------------------------------------


@query(f"{BASE} {graph_of('true')}", dist=True)
def knn_graph_exact(t: Tables) -> DataFrame:
    return knn_graph(t.v, 8, by_bucket=False)


@query()
def knn_graph_cells(t: Tables) -> DataFrame:
    return knn_cells(t.v, 10)


@query(f"{BASE} {graph_of('a.ts = b.ts')}", dist=True)
def knn_graph_bucket(t: Tables) -> DataFrame:
    return knn_graph(t.v)


@query(f"{BASE}, {G}, {DET} SELECT src, dst, rank, detour FROM det")
def detour_count(t: Tables) -> DataFrame:
    return graph.detours(knn_graph(t.v))


@query(f"{BASE}, {G}, {DET}, {PRU} SELECT * FROM pru")
def prune_graph(t: Tables) -> DataFrame:
    return graph.pruned(knn_graph(t.v))


@query()
def robust_prune(t: Tables) -> DataFrame:
    return graph.occluded(knn_graph(t.v), t.v)


@query(f"{BASE}, {G}, {DET}, {PRU}, {REV} SELECT * FROM rev")
def reverse_graph(t: Tables) -> DataFrame:
    return graph.reversed_(graph.pruned(knn_graph(t.v)))


@query(f"{BASE}, {G}, {DET}, {PRU} SELECT dst, count(*) AS n FROM pru GROUP BY dst")
def in_degree(t: Tables) -> DataFrame:
    return graph.pruned(knn_graph(t.v)).groupBy("dst").agg(F.count("*").alias("n"))


@query(f"{GRAPH} SELECT src, slot, dst FROM mer")
def merge_graph(t: Tables) -> DataFrame:
    return graph.merged(graph.pruned(knn_graph(t.v)))


GLOBAL_GRAPH = GRAPH.replace(G, f"g AS MATERIALIZED ({graph_of('true')})")


@query(f"{GLOBAL_GRAPH} SELECT src, slot, dst FROM mer")
def build_graph(t: Tables) -> DataFrame:
    return graph.merged(graph.pruned(knn_graph(t.v, by_bucket=False)))


@query(f"{BASE}, {remote(3)} SELECT src, slot, dst, class FROM rem")
def remote_edges(t: Tables) -> DataFrame:
    c = knn(as_queries(t.v), t.v, 32, other_bucket=True).select(F.col("qid").alias("src"), "rank", F.col("id").alias("dst"))
    return graph.remote_edges(c, t.v)


@query()
def remote_reverse_inject(t: Tables) -> DataFrame:
    return graph.with_reverse(remote_edges(t), merge_graph(t), degree=5)


@query(f"{EDGES} SELECT * FROM e")
def build_partitioned_graph(t: Tables) -> DataFrame:
    return graph.partitioned_graph(t.v)


@query(ORACLE["build_partitioned_graph"])
def build_graph_planned(t: Tables) -> DataFrame:
    return partitioned_graph_auto(t.v)


@query(f"{GRAPH}, d AS (SELECT v.id, count(mer.src) AS n FROM v LEFT JOIN mer ON mer.src = v.id GROUP BY ALL) SELECT round(avg(n), 6) AS avg_degree, min(n) AS min_degree, max(n) AS max_degree, count(*) FILTER (n = 0) AS no_edges FROM d")
def degree_stats(t: Tables) -> DataFrame:
    return evaluate.degree_stats(merge_graph(t), t.v)


@query(f"{GRAPH}, r AS ({ranked('ts = qts')}) SELECT round(count(mer.dst) / count(*), 6) AS overlap FROM r LEFT JOIN mer ON mer.src = r.qid AND mer.dst = r.id WHERE r.qid <> r.id")
def graph_gt_overlap(t: Tables) -> DataFrame:
    return evaluate.overlap(merge_graph(t), knn_bucket(t))


# --- seeds and beam search -----------------------------------------------------------------------------------------


@query(f"{BASE}, {SEEDS} SELECT id FROM seeds")
def sample_seeds(t: Tables) -> DataFrame:
    return search.sampled_seeds(t.v)


@query("SELECT DISTINCT (2654435769 * i) % (SELECT count(*) FROM embeddings) AS id FROM (SELECT unnest(range(1, 17)) AS i)")
def seed_random(t: Tables) -> DataFrame:
    return search.random_seeds(t.spark, t.v.count(), 16)


@query(f"{BASE}, {SEEDS} SELECT qid, id FROM q CROSS JOIN seeds")
def seed_broadcast(t: Tables) -> DataFrame:
    return t.q.select("qid").crossJoin(F.broadcast(search.sampled_seeds(t.v)))


@query("WITH given AS (SELECT i, CASE WHEN i % 3 = 0 THEN NULL ELSE i * 7 END AS id FROM (SELECT unnest(range(1, 9)) AS i)) SELECT DISTINCT coalesce(id, (2654435769 * i) % (SELECT count(*) FROM embeddings)) AS id FROM given")
def seed_provided(t: Tables) -> DataFrame:
    n = t.v.count()
    i = F.col("id")
    return t.spark.range(1, 9).select(F.coalesce(F.when(i % 3 != 0, i * 7), F.lit(2654435769) * i % n).alias("id")).distinct()


@query(f"{BASE} SELECT DISTINCT qid, id FROM q JOIN v ON id % 5 = qid % 3 WHERE NOT (ts = qts)")
def visited_dedup(t: Tables) -> DataFrame:
    pairs = t.v.join(F.broadcast(t.q), F.col("id") % 5 == F.col("qid") % 3)
    seen = t.v.join(F.broadcast(t.q), F.col("ts") == F.col("qts")).select("qid", "id")
    return pairs.select("qid", "id").distinct().join(seen, ["qid", "id"], "left_anti")


@query(f"{GRAPH}, {SEEDS}, {hops(1, 'mer', 'true')} SELECT * FROM s1", dist=True)
def beam_hop(t: Tables) -> DataFrame:
    return search.hop(search.started(t.q, search.sampled_seeds(t.v), t.v), merge_graph(t), t.v, t.q)


@query(f"{EDGES}, {SEEDS}, {hops(2, 'e', 'true')} {best(2)}", dist=True)
def beam_two_hops_global(t: Tables) -> DataFrame:
    return search.beam(t.q, search.sampled_seeds(t.v), graph.partitioned_graph(t.v), t.v, hops=2)


@query(f"{GRAPH}, seeds AS (SELECT id FROM v WHERE ts = 3 ORDER BY {wang('(id + 17)')}, id LIMIT 8), {hops(2, 'mer', 'v.ts = 3')} {best(2)}", dist=True)
def beam_two_hops_bucket(t: Tables) -> DataFrame:
    inside = t.v.filter("ts = 3")
    return search.beam(t.q, search.sampled_seeds(inside), merge_graph(t), inside, hops=2)


@query(f"{EDGES}, seeds AS (SELECT id FROM v WHERE ts >= 2 AND ts < 6 ORDER BY {wang('(id + 17)')}, id LIMIT 8), {hops(2, 'e', 'v.ts >= 2 AND v.ts < 6')} {best(2)}", dist=True)
def beam_two_hops_range(t: Tables) -> DataFrame:
    inside = in_range(t.v, 2, 6)
    return search.beam(t.q, search.sampled_seeds(inside), graph.partitioned_graph(t.v), inside, hops=2)


#: Edges of a node, and what the beams below keep and expand in a hop. SQL cannot follow until no node is open, so they have no twin.
DEGREE, ITOPK, WIDTH, HOPS = 32, 128, 16, 100


def _converged(t: Tables, edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Beam search within `inside` until no open node is left. The edges and each hop are checkpointed: in the cluster's folder, a local one only where that is unset."""
    if not t.spark.sparkContext.getCheckpointDir():
        t.spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidevec-"))
    return search.beam(t.q, search.sampled_seeds(inside, max(32, ITOPK // 4)), edges.checkpoint(), inside, hops=HOPS, itopk=ITOPK, width=WIDTH, checkpoint=True)


def _wide(t: Tables) -> DataFrame:
    return graph.partitioned_graph(t.v, 2 * DEGREE, DEGREE, DEGREE // 2, 2 * DEGREE, exact=False)


@query()
def beam_search_global(t: Tables) -> DataFrame:
    return _converged(t, _wide(t), t.v)


@query()
def beam_search_bucket(t: Tables) -> DataFrame:
    inside = t.v.filter("ts = 3")
    return _converged(t, graph.merged(graph.pruned(knn_graph(inside, 2 * DEGREE), DEGREE), DEGREE), inside)


@query()
def beam_search_range(t: Tables) -> DataFrame:
    return _converged(t, _wide(t), in_range(t.v, 2, 6))


# --- insertion -----------------------------------------------------------------------------------------------------


@query(f"{BASE}, {NEW} SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY qid) AS id, qts AS ts FROM new")
def insert_assign_ids(t: Tables) -> DataFrame:
    return insert.assigned(t.old, t.new.withColumn("n", F.col("id"))).select("id", "ts")


@query(f"{BASE}, {NEW}, {GLOBAL} SELECT qid AS new_id, rank, id, dist FROM gc", dist=True)
def insert_candidates(t: Tables) -> DataFrame:
    return insert.candidates(t.old, t.new)


@query(f"{BASE}, {NEW}, {LOCAL} SELECT qid AS new_id, rank, id, dist FROM lc", dist=True)
def insert_local_candidates(t: Tables) -> DataFrame:
    return insert.local_candidates(t.old, t.new)


@query(f"{BASE}, n AS (SELECT * FROM v WHERE id % 25 = 24), new AS (SELECT id AS qid, v AS qv FROM n) {ranked('id <> qid', 4, q='new', v='n')}", dist=True)
def insert_batch_knn(t: Tables) -> DataFrame:
    return knn_graph(t.new, 4, by_bucket=False).select(F.col("src").alias("qid"), "rank", F.col("dst").alias("id"), "dist")


@query(f"{FILL} SELECT * FROM fill")
def insert_fill_edges(t: Tables) -> DataFrame:
    return insert.filled(t.old, t.new)


@query(f"{MAIL} SELECT * FROM mail")
def insert_mailbox(t: Tables) -> DataFrame:
    return insert.mailbox(insert.filled(t.old, t.new), t.v)


H = wang("(node + pos)")


@query(f"{MAIL}, a AS (SELECT node, CASE WHEN kind = 'remote' THEN 2 + g % 2 WHEN h % 10 = 0 THEN g % 1 ELSE 1 + g % 1 END AS slot, pos, src FROM (SELECT *, {wang('h')} AS g FROM (SELECT *, {H} AS h FROM mail JOIN old ON old.id = node))) SELECT node, slot, src FROM a QUALIFY row_number() OVER (PARTITION BY node, slot ORDER BY pos DESC, src DESC) = 1")
def insert_apply(t: Tables) -> DataFrame:
    return insert.applied(insert.mailbox(insert.filled(t.old, t.new), t.v), t.old)


@query()
def insert_batch(t: Tables) -> DataFrame:
    return insert.inserted(t.old, graph.partitioned_graph(t.old), t.new)


# --- routing -------------------------------------------------------------------------------------------------------


@query(f"{CENT} SELECT cid, ts, cast(dim AS INTEGER) AS dim, round(value, 6) AS value FROM means")
def bucket_centroids(t: Tables) -> DataFrame:
    return routing.mean_rows(t.v).withColumn("value", F.round("value", 6))


def _centroids(t: Tables) -> DataFrame:
    return routing.as_vectors(routing.mean_rows(t.v))


@query(f"{CENT} SELECT id, cid FROM (SELECT id, cid, row_number() OVER (PARTITION BY id ORDER BY {dist('v', 'c')}, cid) AS r FROM v JOIN cent USING (ts)) WHERE r = 1")
def lloyd_step(t: Tables) -> DataFrame:
    return routing.lloyd_step(t.v, _centroids(t))


@query(f"{CENT} SELECT cid, rank, id FROM (SELECT cid, id, row_number() OVER (PARTITION BY cid ORDER BY {dist('v', 'c')}, id) AS rank FROM v JOIN cent USING (ts)) WHERE rank <= 5")
def entry_points(t: Tables) -> DataFrame:
    return routing.entry_points(t.v, _centroids(t))


@query(f"{VOTES} SELECT * FROM votes")
def bucket_votes(t: Tables) -> DataFrame:
    return routing.votes(t.q, _centroids(t))


@query(f"{VOTES} SELECT * FROM probed")
def probe_buckets(t: Tables) -> DataFrame:
    return routing.probed(routing.votes(t.q, _centroids(t)))


ROUTED = f"SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT q.qid, v.id, {dist('v.v', 'q.qv')} AS dist FROM probed JOIN q USING (qid) JOIN v USING (ts))) WHERE rank <= 10"


@query(f"{VOTES} {ROUTED}", dist=True)
def routed_knn(t: Tables) -> DataFrame:
    return routing.routed_knn(t.q, t.v, _centroids(t))


@query()
def bucket_centroids_kmeans(t: Tables) -> DataFrame:
    return routing.kmeans_centroids(t.v)


@query()
def routed_kmeans_knn(t: Tables) -> DataFrame:
    """Routing by k-means centroids; four in five buckets are searched, as vectors near each other lie in many of them."""
    return routing.routed_knn(t.q, t.v, routing.kmeans_centroids(t.v).checkpoint(), probe=_most_buckets(t))


def _most_buckets(t: Tables) -> int:
    if not t.spark.sparkContext.getCheckpointDir():
        t.spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidevec-"))
    return max(1, -(-4 * t.v.select("ts").distinct().count() // 5))


@query()
def virtual_index_graph(t: Tables) -> DataFrame:
    return routing.virtual_index(t.v, routing.kmeans_centroids(t.v))[0]


@query()
def virtual_index_entries(t: Tables) -> DataFrame:
    return routing.virtual_index(t.v, routing.kmeans_centroids(t.v))[1]


# --- evaluation ----------------------------------------------------------------------------------------------------


@query(f"{VOTES}, r AS ({ROUTED}), g AS ({ranked('true')}) SELECT count(r.id) AS hits, count(*) AS truth, round(count(r.id) / count(*), 6) AS recall FROM g LEFT JOIN r ON r.qid = g.qid AND r.id = g.id")
def recall_at_k(t: Tables) -> DataFrame:
    return evaluate.recall(routed_knn(t), knn_global(t))


@query(f"{BASE}, r AS ({ranked('true')}) SELECT count(*) FILTER (ts < 2 OR ts >= 6) AS errors, count(*) AS results FROM r JOIN v USING (id)")
def bound_errors(t: Tables) -> DataFrame:
    return evaluate.bound_errors(knn_global(t), t.v, 2, 6)


@query(f"{BASE}, r AS ({ranked('true')}), n AS (SELECT qid, count(DISTINCT ts) AS n FROM r JOIN v USING (id) GROUP BY qid) SELECT round(avg(n), 6) AS spread, cast(ceil(avg(n)) + 1 AS BIGINT) AS probe FROM n")
def gt_bucket_spread(t: Tables) -> DataFrame:
    return evaluate.bucket_spread(knn_global(t), t.v)


# --- event time (extensions) ---------------------------------------------------------------------------------------


@query("SELECT cast(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_bucket_counts(t: Tables) -> DataFrame:
    return counted(t.events)


@query("SELECT b AS bucket, event_type, count(*) AS n FROM (SELECT event_type, unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800]) AS x FROM events), LATERAL (SELECT cast(x AS BIGINT) AS b) GROUP BY ALL")
def event_sliding_counts(t: Tables) -> DataFrame:
    return counted(t.events, width="1 hour", slide="30 minutes")


@query("SELECT user_id, cast(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 1800 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def event_session_counts(t: Tables) -> DataFrame:
    return sessions(t.events)
