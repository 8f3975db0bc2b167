"""Exact nearest neighbours, block against block: a product of matrices rules pairs out, and what is left is measured as SQL does."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a block of vectors and its most rows; numbers in a partition of blocks that a task holds; rows of results a task holds; pairs measured at once.
BLOCK, ROWS, PART, HELD, PAIRS = 1 << 17, 2048, 4 << 20, 1 << 20, 1 << 16
#: Stands for a null id or bucket; as nulls do, it comes first.
NULL = -(1 << 63)


def bounded(df: DataFrame, size: int = 16 << 20) -> DataFrame:
    """df, after bounding the bytes of the batches that Python workers get in its session, as a row may hold a block. A smaller bound is kept."""
    conf = df.sparkSession.conf
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= size:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def packed(rows: DataFrame, key: str, bucket: str | None, vector: str, to: str, own: str | None = None, most_rows: int = ROWS) -> DataFrame:
    """Blocks of rows with vectors of one length: {to} (a number of the block), {to}_dim (-1: vectors that are null or hold nulls), {to}_ids, {to}_ts, {to}_v and {to}_own (a binary column, as long in every row; else empty), packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, ts, v, some_own = zip(*held.pop(dim))
            ids, ts, v = np.concatenate(ids), np.concatenate(ts), np.concatenate(v)
            mark = hash((ids.tobytes(), ts.tobytes(), v.tobytes())) & (1 << 62) - 1
            return pa.RecordBatch.from_pydict({to: [mark], f"{to}_dim": pa.array([dim], pa.int32())} | {f"{to}_{n}": pa.array([x.tobytes()], pa.binary()) for n, x in (("ids", ids), ("ts", ts), ("v", v))} | {f"{to}_own": pa.array([b"".join(x for part in some_own for x in part)], pa.binary())})

        for batch in batches:
            ids, ts = (np.asarray(batch.column(i).fill_null(NULL)) for i in (0, 1))
            lists, owns = batch.column(2), batch.column(3).to_pylist() if own else []
            sizes = np.asarray(lists.value_lengths().fill_null(-1)).astype(np.int64)
            flat = lists.flatten()
            starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            if flat.null_count:
                gone = np.append(0, np.cumsum(np.asarray(flat.is_null())))
                dims = np.where((sizes > 0) & (gone[starts + np.maximum(sizes, 0)] > gone[starts]), -1, sizes)
            else:
                dims = sizes
            numbers = np.asarray(flat.fill_null(0.0))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                width = max(dim, 0)
                x = numbers[starts[at][:, None] + np.arange(width)] if width else np.zeros((len(at), 0))
                most = max(1, min(most_rows, BLOCK // max(1, width)))
                for i in range(0, len(at), most):
                    some = at[i : i + most]
                    have = sum(len(p[0]) for p in held.get(dim, []))
                    if have and have + len(some) > most:
                        yield block(dim)
                    held.setdefault(dim, []).append((ids[some], ts[some], x[i : i + most], [owns[j] for j in some.tolist()] if own else []))
        for dim in list(held):
            yield block(dim)

    where = F.col(bucket).cast("long") if bucket else F.lit(0).cast("long")
    told = rows.select(F.col(key).cast("long"), where.alias("_ts"), F.col(vector).cast("array<double>").alias("_v"), *([F.col(own)] if own else []))
    return told.mapInArrow(pack, f"{to} long, {to}_dim int, {to}_ids binary, {to}_ts binary, {to}_v binary, {to}_own binary")


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the rows, left to right."""
    return np.cumsum(x, axis=1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))


def measured(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """The distance or score of each row of x with that of y, every sum taken left to right as functions.vector does; a cosine with a zero vector is masked by _order."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            d = x - y
            return _sums(d * d)
        dot = _sums(x * y)
        return dot if metric == "inner_product" else dot / np.sqrt(_sums(x * x) * _sums(y * y))


class Side:
    """Vectors of a block, with what the product of matrices needs. rough: rows that it could not tell exactly enough."""

    def __init__(self, ids: bytes, ts: bytes, v: bytes, dim: int, metric: str) -> None:
        self.ids, self.ts, self.dim = np.frombuffer(ids, np.int64), np.frombuffer(ts, np.int64), dim
        self.v = np.frombuffer(v, np.float64).reshape(len(self.ids), max(dim, 0))
        with np.errstate(all="ignore"):
            self.square = np.einsum("ij,ij->i", self.v, self.v)
            self.rough = ~(self.square < 1e150)
            self.unit = self.v
            if metric == "cosine":
                self.rough |= ~(self.square > 1e-150)
                self.unit = self.v / np.sqrt(np.where(self.rough, 1, self.square))[:, None]
        if self.rough.any():
            self.unit = np.where(self.rough[:, None], 0.0, self.unit)
            self.square = np.where(self.rough, 0.0, self.square)


class Best:
    """The k best of each query of a block so far, as rows (query, class, distance to sort by, id, distance), best first: numbers, then NaN (first if descending), then nulls."""

    def __init__(self, queries: Side, k: int, metric: str, others: bool, other_bucket: bool, buckets: np.ndarray | None = None, own: bytes = b"") -> None:
        self.q, self.k, self.metric, self.others, self.other_bucket, self.buckets = queries, k, metric, others, other_bucket, buckets
        n = len(queries.ids)
        if buckets is not None:
            self.own = np.unpackbits(np.frombuffer(own, np.uint8).reshape(n, -1), axis=1, count=len(buckets)).view(bool)
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0), np.zeros(0, np.int64)
        self.limit = np.full(n, np.inf)  # what sorts after it cannot be among the k best

    def _allowed(self, y: Side) -> np.ndarray | None:
        q, out = self.q, None
        if self.others:
            out = (q.ids[:, None] != y.ids) & (q.ids != NULL)[:, None] & (y.ids != NULL)
        if self.other_bucket:
            apart = (q.ts[:, None] != y.ts) & (q.ts != NULL)[:, None] & (y.ts != NULL)
            out = apart if out is None else out & apart
        if self.buckets is not None:
            at = np.minimum(np.searchsorted(self.buckets, y.ts), len(self.buckets) - 1)
            within = self.own[:, at] & (self.buckets[at] == y.ts)
            out = within if out is None else out & within
        return out

    def add(self, y: Side) -> None:
        q, ok = self.q, self._allowed(y)
        if q.dim != y.dim or q.dim < 0:
            # no distance: the smallest ids, where there are too few others
            few = np.flatnonzero(np.isposinf(self.limit))
            by = np.argsort(y.ids, kind="stable")
            allowed = np.ones((len(few), len(by)), bool) if ok is None else ok[np.ix_(few, by)]
            r, c = np.nonzero(allowed & (np.cumsum(allowed, axis=1) <= self.k))
            self._merge(few[r], np.full(len(r), 2, np.int8), np.zeros(len(r)), y.ids[by[c]])
            return
        about = q.unit @ y.unit.T
        if self.metric == "l2":
            about = q.square[:, None] + y.square - 2 * about
            slack = (q.square + y.square.max(initial=0)) * (4e-15 * (q.dim + 64)) + 1e-300
        else:
            about = -about
            size = 1.0 if self.metric == "cosine" else np.sqrt(q.square * y.square.max(initial=0))
            slack = np.broadcast_to(size * (4e-15 * (q.dim + 64)) + 1e-300, len(q.ids))
        if ok is not None:
            about[~ok] = np.inf
        limit = self.limit
        open_ = np.isposinf(limit)
        if open_.any():
            least = about[open_]
            if q.rough.any() or y.rough.any():
                least = np.where(q.rough[open_][:, None] | y.rough, np.inf, least)
            limit = limit.copy()
            limit[open_] = np.partition(least, self.k - 1, axis=1)[:, self.k - 1] + slack[open_] if least.shape[1] >= self.k else np.inf
        near = about <= (limit + slack)[:, None]
        if q.rough.any() or y.rough.any():
            near |= q.rough[:, None] | y.rough
        if ok is not None:
            near &= ok
        r, c = np.nonzero(near)
        for i in range(0, len(r), PAIRS):
            self._measure(y, r[i : i + PAIRS], c[i : i + PAIRS])

    def _measure(self, y: Side, r: np.ndarray, c: np.ndarray) -> None:
        dist = measured(self.q.v[r], y.v[c], self.metric)
        kind = np.where(np.isnan(dist), 1, 0).astype(np.int8)
        if self.metric != "l2":
            dist, kind = -dist, np.where(np.isnan(dist), -1, 0).astype(np.int8)
        if self.metric == "cosine":
            kind[~self.q.v[r].any(axis=1) | ~y.v[c].any(axis=1)] = 2
        told = (kind != 0) | ~(dist > self.limit[r])
        self._merge(r[told], kind[told], np.where(kind == 0, dist, 0.0)[told], y.ids[c[told]])

    def _merge(self, r: np.ndarray, kind: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        if not len(r):
            return
        new = np.zeros(len(self.q.ids), bool)
        new[r] = True
        mine = new[self.rows[0]]
        both = [np.concatenate([a[mine], b]) for a, b in zip(self.rows, (r, kind, dist, ids))]
        by = np.lexsort((both[3], both[2], both[1], both[0]))
        both = [x[by] for x in both]
        first = np.flatnonzero(np.append(True, both[0][1:] != both[0][:-1]))
        place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        last = place == self.k - 1
        self.limit[both[0][last]] = np.where(both[1][last] > 0, np.inf, np.where(both[1][last] < 0, -np.inf, both[2][last]))
        self.rows = tuple(np.concatenate([a[~mine], b[place < self.k]]) for a, b in zip(self.rows, both))

    def told(self) -> pa.RecordBatch:
        r, kind, dist, ids = self.rows
        dist = np.where(abs(kind) == 1, np.nan, dist if self.metric == "l2" else 0.0 - dist)
        qid = self.q.ids[r]
        return pa.RecordBatch.from_arrays([pa.array(qid, mask=qid == NULL), pa.array(ids, mask=ids == NULL), pa.array(dist, mask=kind == 2)], names=["qid", "id", "dist"])


def _bits(places: DataFrame, buckets: np.ndarray) -> DataFrame:
    """qid, _own: a bit for each bucket, set for those of the query."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros((batch.num_rows, len(buckets)), bool)
            lists = batch.column(1)
            bits[np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths())), np.searchsorted(buckets, np.asarray(lists.flatten()))] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["qid", "_own"])

    return places.groupBy("qid").agg(F.collect_list("ts").alias("ts")).mapInArrow(pack, "qid long, _own binary")


class Voters:
    """The k nearest of many rows to each query of a block, by l2, ties by id; distances that are infinite, NaN or missing come last. Counted by bucket."""

    def __init__(self, queries: Side, k: int) -> None:
        self.q, self.k, self.width = queries, k, 0
        self.kept = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, y: Side) -> None:
        q = self.q
        dist = np.full((len(q.ids), len(y.ids)), np.inf)
        if q.dim == y.dim and q.dim >= 0:
            a, b = np.ascontiguousarray(q.v.T), np.ascontiguousarray(y.v.T)
            with np.errstate(all="ignore"):
                for i in range(0, len(y.ids), 256):
                    sums = np.zeros((len(q.ids), len(y.ids[i : i + 256])))
                    for x, z in zip(a, b[:, i : i + 256]):  # left to right, as functions.vector does
                        part = x[:, None] - z
                        part *= part
                        sums += part
                    dist[:, i : i + 256] = np.where(np.isnan(sums), np.inf, sums)
        self.new.append((dist, y.ids, y.ts))
        self.width += len(y.ids)
        if self.width >= self.k:
            self._keep()

    def _keep(self) -> None:
        if not self.new:
            return
        dists, ids, ts = (np.concatenate(x, axis=-1) for x in zip(*self.new))
        for i, old in enumerate(self.kept):
            both = tuple(np.concatenate(x) for x in zip(old, (dists[i], ids, ts)))
            if len(both[0]) > self.k:
                edge = np.partition(both[0], self.k - 1)[self.k - 1]
                near, ties = np.flatnonzero(both[0] < edge), np.flatnonzero(both[0] == edge)
                ties = ties[np.argsort(both[1][ties], kind="stable")[: self.k - len(near)]]
                at = np.append(near, ties)
                both = tuple(x[at] for x in both)
            self.kept[i] = both
        self.new, self.width = [], 0

    def told(self) -> Iterator[pa.RecordBatch]:
        self._keep()
        for qid, (_, _, ts) in zip(self.q.ids, self.kept):
            bucket, n = np.unique(ts, return_counts=True)
            key = np.full(len(n), qid)
            yield pa.RecordBatch.from_arrays([pa.array(key, mask=key == NULL), pa.array(bucket, mask=bucket == NULL), pa.array(n.astype(np.int64))], names=["qid", "ts", "votes"])


def counted(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """qid, ts, votes: how many of the k rows (key, ts, vector) nearest to each query (qid, qv), ties by key, lie in each bucket.

    Each task takes blocks of queries, as many as it can hold k rows for, and all rows pass by it: nothing of a pair leaves its task.
    """
    bounded(rows)
    most = max(1, min(ROWS, 2 * HELD // k))
    left = packed(queries, "qid", None, "qv", "q", most_rows=most)
    # Small blocks: those that partitions of queries begin are many.
    n = queries.count()
    met = left.repartition(max(1, min(-(-n // most), 1000))).crossJoin(packed(rows, key, "ts", vector, "x").repartition(1).hint("shuffle_replicate_nl"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters: dict[int, Voters] = {}
        sides = [f"{x}_{n}" for x in "qx" for n in ("ids", "ts", "v", "dim")]
        for batch in batches:
            marks, *cols = (batch.column(batch.schema.get_field_index(x)) for x in ["q", *sides])
            for i, mark in enumerate(marks.to_pylist()):
                if mark not in voters:
                    voters[mark] = Voters(Side(*(c[i].as_py() for c in cols[:4]), "l2"), k)
                voters[mark].add(Side(*(c[i].as_py() for c in cols[4:]), "l2"))
        for v in voters.values():
            yield from v.told()

    return met.mapInArrow(count, "qid long, ts long, votes long")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", others: bool = False, other_bucket: bool = False, broadcast: bool = False, own: tuple[DataFrame, np.ndarray] | None = None) -> DataFrame:
    """qid, id, dist: for each query (qid, qts, qv), vectors (id, ts, v) among which its k nearest are, ties by id, in doubles summed left to right.

    metric: l2, or inner_product or cosine, of which the largest are wanted. others: only vectors with another id; other_bucket: only those of other
    buckets; own: only those of its own buckets (a table of qid and ts, each once, and all its ts in order; queries that it lacks find nothing). All pairs of blocks meet, of any number: with broadcast those of queries (a bounded set) go to the vectors, else tasks take a block and a
    part of the vectors, so work grows with the product of both sides. The product of matrices tells which pairs cannot be among the k best, with its error allowed for.
    Vectors without a distance (nulls, other lengths, zero ones for a cosine) come last; repeated rows count as often as they occur.
    """
    bounded(vectors)
    asked, buckets = (queries.join(_bits(*own), "qid"), own[1]) if own else (queries, None)
    left = packed(asked, "qid", "qts" if other_bucket else None, "qv", "q", "_own" if own else None)
    right = packed(vectors, "id", "ts" if other_bucket or own else None, "v", "x")
    if broadcast:
        met = right.crossJoin(F.broadcast(left))
    else:
        size = lambda df, v: df.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.size(v), F.lit(0))), F.lit(0))).first()
        (n, many), (m, much) = size(queries, "qv"), size(vectors, "v")
        parts = lambda rows, numbers: max(math.ceil(rows / ROWS), math.ceil(numbers / BLOCK), 1)
        met = left.repartition(min(parts(n, many), 1000)).crossJoin(right.repartition(max(1, math.ceil(much / PART), math.ceil(m / PART))).hint("shuffle_replicate_nl"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        sides: dict[int, Side] = {}
        names = ["q", "q_ids", "q_ts", "q_v", "q_dim", "x", "x_ids", "x_ts", "x_v", "x_dim", "q_own"]
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(x)) for x in names]
            for i in range(batch.num_rows):
                mark = cols[0][i].as_py()
                if mark not in best:
                    best[mark] = Best(Side(*(c[i].as_py() for c in cols[1:5]), metric), k, metric, others, other_bucket, buckets, cols[10][i].as_py())
                other = cols[5][i].as_py()
                if other not in sides:
                    if len(sides) * BLOCK > PART:
                        sides.clear()
                    sides[other] = Side(*(c[i].as_py() for c in cols[6:10]), metric)
                best[mark].add(sides[other])
            if sum(len(b.rows[0]) for b in best.values()) > HELD and len(best) > 1:
                for b in list(best)[:-1]:
                    yield best.pop(b).told()
        for b in best.values():
            yield b.told()

    return met.mapInArrow(compare, "qid long, id long, dist double")
