import math
import os
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidevec import catalogue
from tidevec.operators import blocks, cells, evaluate, graph, insert, routing, search
from tidevec.operators import knn as knn_module
from tidevec.operators.knn import knn, knn_graph, pad, queries_of
from tidevec.sources import vectors as files
from tidevec.streaming import inserts

D = "/root/testdata/sf0.001"


def ramp(spark, n=40, size=10):
    return spark.createDataFrame([(i, i // size, [i * 0.5] * 4) for i in range(n)], "id long, ts long, v array<double>")


@pytest.mark.parametrize("name", ["knn_range", "merge_graph", "remote_edges", "beam_two_hops_range", "insert_fill_edges", "routed_knn", "event_session_counts"])
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"create view {f[:-8]} as select * from '{D}/{f}'")
    df = catalogue.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    want = c.sql(f"select {', '.join(chr(34) + x + chr(34) for x in cols)} from ({catalogue.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


def test_robust_prune(spark):
    rnd = random.Random(3)
    at = {i: [rnd.random() for _ in range(3)] for i in range(30)}
    v = spark.createDataFrame([(i, 0, x) for i, x in at.items()], "id long, ts long, v array<double>")
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(at[a], at[b]))
    want = []
    for a in at:
        near = sorted((b for b in at if b != a), key=lambda b: (far(a, b), b))[:8]
        took = []
        for b in near:
            if len(took) < 4 and all(far(c, b) >= far(a, b) for c in took):
                took.append(b)
        want += [(a, i, b) for i, b in enumerate((took + [b for b in near if b not in took])[:4])]
    assert sorted(map(tuple, graph.occluded(knn_graph(v), v).collect())) == sorted(want)


def mixed32(x):
    m = 0xFFFFFFFF
    x = ((x ^ 61 ^ (x >> 16)) * 9) & m
    x ^= x >> 4
    x = (x * 668265261) & m
    return x ^ (x >> 15)


@pytest.mark.parametrize("degree,local,cap", [(4, 2, 32), (9, 4, 32), (7, 6, 32), (9, 4, 3)])
def test_reverse_of_remote_edges(spark, degree, local, cap):
    rnd = random.Random(degree * 100 + cap)
    far = [(a, s, b) for a in range(60) if a % 7 for s, b in enumerate(rnd.sample([x for x in range(20) if x != a], rnd.randint(0, degree - local)), local)]
    own = [(a, s, b) for a in range(60) for s, b in enumerate(rnd.sample(range(60), degree))]
    rows = {a: [None] * (degree - local) for a in range(60)}
    for a, s, b in far:
        rows[a][s - local] = b
    keep = (degree - local) // 2
    want, full = [], 0
    for a, row in rows.items():
        row, h = list(row), mixed32(a)
        for _, c in sorted((s, src) for src, s, b in far if b == a)[:cap]:
            if c in row or (a, c) in {(x, b) for x, s, b in own if s < local}:
                continue
            open_ = [i for i in range(keep, degree - local) if row[i] is None]
            if not open_:
                h = mixed32(h)
                full += 1
            row[open_[0] if open_ else keep + h % (degree - local - keep)] = c
        want += [(a, i + local, b) for i, b in enumerate(row) if b is not None]
    make = lambda e: spark.createDataFrame(e, "src long, slot long, dst long")
    assert full and sorted(want) != sorted(far)
    assert sorted(map(tuple, graph.with_reverse(make(far + far[:9]), make(own), degree, local, cap).collect())) == sorted(want)
    assert graph.with_reverse(make([]), make(own), degree, local, cap).count() == 0


def test_ramp_neighbours_and_no_self_loops(spark):
    g = knn_graph(ramp(spark), 2).collect()
    assert all(r.src != r.dst for r in g)
    assert {r.dst for r in g if r.src == 5} == {4, 6}
    assert {r.dst for r in g if r.src == 10} == {11, 12}  # never across buckets


def test_small_bucket_gives_fewer_edges_and_pad_fills(spark):
    v = ramp(spark, 3)
    assert knn_graph(v, 8).count() == 6
    q = queries_of(v)
    rows = pad(knn(q, v, 5), q, 5).orderBy("rank").collect()
    assert [r.id for r in rows] == [0, 1, 2, None, None]


def test_triangle_has_one_detour(spark):
    g = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 2)], "src long, rank long, dst long")
    assert {(r.src, r.dst): r.detour for r in graph.detours(g).collect()} == {(0, 1): 0, (0, 2): 1, (1, 2): 0}


def test_partitioned_graph_kinds_and_wide_beam_is_exact(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    v = ramp(spark)
    e = graph.partitioned_graph(v).checkpoint()
    ts = {r.id: r.ts for r in v.collect()}
    rows = e.collect()
    assert all((ts[r.src] != ts[r.dst]) == (r.kind == "remote") for r in rows)
    assert max(r.slot for r in rows) < 4
    # The graph is directed and small: a beam as wide as the table finds the nearest of what can be reached from its seeds.
    seeds = search.sampled_seeds(v)
    reached, todo = set(), [r.id for r in seeds.collect()]
    while todo:
        x = todo.pop()
        if x not in reached:
            reached.add(x)
            todo += [r.dst for r in rows if r.src == x]
    q = queries_of(v, 20)
    got = search.beam(q, seeds, e, v, k=3, hops=12, itopk=40, width=8, checkpoint=True)
    truth = knn(q, v.filter(v["id"].isin(sorted(reached))), 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, truth.collect()))


@pytest.mark.parametrize("name, where", [("beam_search_global", "true"), ("beam_search_bucket", "ts = 3"), ("beam_search_range", "ts >= 2 and ts < 6")])
def test_converged_beam_finds_the_nearest(spark, tmp_path, name, where):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    t = catalogue.Tables(spark, D)
    got = catalogue.QUERIES[name](spark, D).checkpoint()
    inside = t.v.filter(where)
    assert got.join(inside, "id", "left_anti").count() == 0
    assert evaluate.recall(got, knn(t.q, inside)).first().recall >= 0.9


def test_fvecs_and_index_round_trip(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(files.to_fvecs([[1, 2, 3], [4, 5, 6]]))
    assert [r.v for r in files.fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("n").collect()] == [[1, 2, 3], [4, 5, 6]]
    v = ramp(spark)
    files.save_index(str(tmp_path / "i"), v, graph.partitioned_graph(v), 4, 2)
    back, edges, meta = files.load_index(spark, str(tmp_path / "i"))
    assert meta == {"version": 1, "dim": 4, "degree": 4, "local_degree": 2, "size": 40}
    assert sorted(map(tuple, back.select("id", "ts").collect())) == sorted(map(tuple, v.select("id", "ts").collect()))
    assert edges.count() > 0


def test_ranks_go_by_unrounded_distances(spark):
    v = spark.createDataFrame([(i, 0, [1e-4 * i]) for i in range(20)], "id long, ts long, v array<double>")
    g = knn_graph(v, 2).collect()
    assert {r.dst for r in g if r.src == 9} == {8, 10}
    q = v.filter("id = 9").selectExpr("id as qid", "ts as qts", "v as qv")
    assert {r.id for r in knn(q, v, 3).collect()} == {8, 9, 10}


def test_hops_leave_no_shuffles_behind_and_count_queries_once(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    v = ramp(spark, 200).checkpoint()
    chain = v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    counted, keep = [], search.small
    monkeypatch.setattr(search, "small", lambda *a: counted.append(a) or keep(*a))
    alive = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = alive()
    got = search.beam(queries_of(v, 100), v.filter("id = 0").select("id"), chain, v, k=1, hops=6, checkpoint=True)
    time.sleep(2)
    assert alive() - before < 12  # about those of one hop
    assert len(counted) == 1
    assert {(r.qid, r.id) for r in got.collect()} == {(0, 0), (100, 6)}


def test_cells_find_the_nearest_and_split_crowded_cells(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(1500, 12))
    x[:500] = x[0] + rnd.normal(size=(500, 12)) * 1e-4  # one crowded cell
    v = spark.createDataFrame([(i, i % 7, row) for i, row in enumerate(x.tolist())] + [(5000, 1, None)], "id long, ts long, v array<double>")
    old, cells.BLOCK = cells.BLOCK, 100
    got = cells.knn_cells(v, 5, probe=16).collect()
    cells.BLOCK = old
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    want = {(i, int(j)) for i, row in enumerate(far) for j in np.argsort(row, kind="stable")[:5]}
    found = {(r.src, r.dst) for r in got}
    assert len(got) == 7500 and len(found & want) > 0.9 * len(want)
    assert all(abs(r.dist - far[r.src, r.dst]) < 1e-12 for r in got)
    every = {(r.src, r.dst) for r in cells.knn_cells(v, 5, probe=1500).collect()}
    assert every == want
    ts = {r.id: r.ts for r in v.collect()}
    assert all(ts[r.src] != ts[r.dst] for r in cells.knn_cells(v, 3, other_bucket=True).collect())
    assert cells.knn_cells(v.limit(0), 5).count() == 0


def test_kmeans_routing_finds_the_nearest(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    t = catalogue.Tables(spark, D)
    assert evaluate.recall(catalogue.QUERIES["routed_kmeans_knn"](spark, D), knn(t.q, t.v)).first().recall >= 0.85
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(size=(50, 3)) * 0.01 + at for at in (0, 5, 9)])
    v = spark.createDataFrame([(i, 4, row) for i, row in enumerate(x.tolist())], "id long, ts long, v array<double>")
    got = np.array([r.centroid for r in routing.kmeans_centroids(v, 12).collect()])
    assert len(got) == 12 and np.abs(got[:, None] - np.array([0, 5, 9])[None, :, None]).max(axis=2).min(axis=1).max() < 0.1
    near = routing.lloyd_step(v, routing.kmeans_centroids(v, 12))
    assert near.count() == 150


def test_insert_batch_adds_every_new_row_and_keeps_slots(spark):
    v = ramp(spark, 40)
    old, new = v.filter("id < 36"), v.filter("id >= 36")
    before = graph.partitioned_graph(old)
    after = insert.inserted(old, before, new).collect()
    slots = [(r.src, r.slot) for r in after]
    assert len(set(slots)) == len(slots) and {36, 37, 38, 39} <= {r.src for r in after}
    assert any(r.dst >= 36 for r in after if r.src < 36)  # old rows point back


def test_streamed_windows_and_inserts(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet")
    events.limit(300).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = inserts.counted(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    out.awaitTermination()
    want = inserts.counted(events.limit(300)).agg({"n": "sum"}).first()[0]
    assert spark.sql("select sum(n) from counts").first()[0] == want == 300
    taken = []
    q = inserts.insert_stream(stream, lambda df, n: taken.append((n, df.count())), str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert taken == [(0, 300)]


ODD = [None, [], [1.0], [float("nan"), 1.0], [float("inf"), 0.0], [None, 1.0], [0.0, 0.0], [1e200, 1e-200], [-1e-200, 0.0]]


@pytest.mark.parametrize("metric", ["l2", "inner_product", "cosine"])
@pytest.mark.parametrize("limits", [{}, {"ROWS": 3, "PAIRS": 5, "HELD": 2}])
def test_blocks_find_what_all_pairs_hold(spark, monkeypatch, metric, limits):
    for name, value in limits.items():
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(knn_module, "BROADCAST_NUMBERS", 8 << 20 if not limits else 8)  # not all queries are broadcast
    rnd = random.Random(7)
    vectors = [[float(rnd.randint(-2, 2)) for _ in range(2)] for _ in range(40)] + (ODD if metric != "cosine" else ODD[:3] + ODD[5:7])
    rows = [(i, i // 6, x) for i, x in enumerate(vectors)]
    table = spark.createDataFrame(rows, "id long, ts long, v array<double>")
    sums = {"l2": lambda a, b: sum((x - y) * (x - y) for x, y in zip(a, b)), "inner_product": lambda a, b: sum(x * y for x, y in zip(a, b))}
    dot = sums["inner_product"]
    sums["cosine"] = lambda a, b: dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) if dot(a, a) * dot(b, b) else None

    def key(a, b):
        if a is None or b is None or len(a) != len(b) or None in a + b or (d := sums[metric](a, b)) is None:
            return 2, 0.0
        return (0 if metric == "l2" else -1, 0.0) if d != d else (0, d if metric == "l2" else -d)

    key2 = lambda a, b: (1, 0.0) if metric == "l2" and None not in (a, b) and len(a) == len(b) and None not in a + b and sums["l2"](a, b) != sums["l2"](a, b) else key(a, b)
    for other in (False, True):
        got = {}
        for r in knn(queries_of(table, 1), table, 5, metric, other_bucket=other).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        for q, ts, a in rows:
            assert got[q] == [i for i, t, b in sorted((x for x in rows if not other or x[1] != ts), key=lambda x: (key2(a, x[2]), x[0]))[:5]], (q, a)
    if metric == "l2":
        graph_of = {}
        for r in knn_graph(table, 5, by_bucket=False).orderBy("src", "rank").collect():
            graph_of.setdefault(r.src, []).append(r.dst)
        for q, _, a in rows:
            assert graph_of[q] == [i for i, t, b in sorted((x for x in rows if x[0] != q), key=lambda x: (key2(a, x[2]), x[0]))[:5]], (q, a)


def test_exact_graphs_meet_blocks_not_rows(spark):
    """A join of rows with rows took minutes on 10,000 vectors."""
    t = catalogue.Tables(spark, D)
    for df in (knn_graph(t.v, by_bucket=False), knn(t.q, t.v), graph.partitioned_graph(t.v)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        after = plan.split("Join Cross")[1:]
        assert after and all("MapInArrow" in x for x in after)


def test_the_sample_for_cells_is_no_list_of_rows(spark, monkeypatch):
    table = ramp(spark, 300)
    sizes, keep = [], type(table).collect

    def told(df):
        out = keep(df)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(type(table), "collect", told)
    assert cells.centres(table, 5).shape == (5, 4)
    assert max(sizes, default=0) <= 1


def test_routing_in_blocks_is_the_plain_search(spark, monkeypatch):
    """Votes and searches by brute force, with ties, a null and a short vector; a search of most buckets makes no row of a pair."""
    from tidevec.operators import blocks

    monkeypatch.setattr(blocks, "ROWS", 64)
    x = np.random.default_rng(8).integers(0, 3, (300, 4)).astype(float)
    rows = [(i, i // 30, r) for i, r in enumerate(x.tolist())]
    v = spark.createDataFrame([*rows, (900, 2, None), (901, 2, [1.0])], "id long, ts long, v array<double>")
    cent = spark.createDataFrame([(1000 + i, ts, r) for i, ts, r in rows[::3]], "cid long, ts long, centroid array<double>")
    q = spark.createDataFrame([(i, r) for i, _, r in rows[::11]], "qid long, qv array<double>")
    for probe in (8, 2):  # of ten buckets: in blocks, and by a join
        want_votes, want = set(), set()
        for i, _, r in rows[::11]:
            near = sorted((sum((a - b) ** 2 for a, b in zip(c, r)), 1000 + j, ts) for j, ts, c in rows[::3])[: 10 * probe]
            n = {ts: sum(t == ts for _, _, t in near) for _, _, ts in near}
            want_votes |= {(i, ts, m) for ts, m in n.items()}
            best = {ts for _, ts in sorted((-m, ts) for ts, m in n.items())[:probe]}
            found = sorted((sum((a - b) ** 2 for a, b in zip(c, r)), j) for j, ts, c in rows if ts in best)[:10]
            want |= {(i, rank, j, d) for rank, (d, j) in enumerate(found, 1)}
        assert {tuple(r) for r in routing.votes(q, cent, probe).select("qid", "ts", "votes").collect()} == want_votes
        out = routing.routed_knn(q, v, cent, probe=probe)
        assert {tuple(r) for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan or probe == 2
