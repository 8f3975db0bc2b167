"""Embedding near-dedup by whole key cells.

Exact copies are linked first. Then, in each pass, vectors of a label whose signs of the same random projections are all equal
form a cell, and a cell is compared as a whole, in blocks, however crowded it is; without projections, as op8 has it, the label is one cell. Links of all
passes are united to components; then every vector is compared with all of its component, so that counts of links are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Forest, components, small_enough
from .store import batched, read, written
from .workers import tidy

#: Vectors in a block of a component that is compared with other blocks.
BLOCK = 4096


#: Vectors in a block of a key cell.
CELL = 1024

#: Vectors of a label and dimension that its crowding is measured on.
SAMPLE = 256

#: Multiplications that cost about as much as a vector's way through a pass.
PASS = 64_000


def plan(rows: int, agree: np.ndarray, least: float, missed: float, cost: float) -> tuple[int, int]:
    """Projections per key and passes, so that a pair at the least cosine shares no cell with a chance of `missed` at most.

    Two vectors at an angle agree in a sign with the chance 1 - angle/pi, whatever else the label holds; passes are independent.
    agree has this chance for sampled pairs. It tells how crowded cells are, so it sets the cost alone (a pass costs a vector as much as
    `cost` comparisons), never the bound. Where cells stay crowded the answer is (0, 1): everything is compared.
    """
    best, found = (0, 1, cost + rows / 2), 1 - math.acos(least) / math.pi
    for bits in range(1, 63 if found < 1 else 1):
        passes = max(1, math.ceil(math.log(missed) / math.log1p(-(found**bits))))
        price = passes * (cost + float((agree**bits).mean()) * rows / 2)
        if price < best[2]:
            best = (bits, passes, price)
    return best[:2]


def _units(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles of a binary column of equal lengths, and the same scaled to unit length."""
    raw = np.stack([np.frombuffer(b.as_py(), np.float64) for b in x])
    return raw, raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _valid(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """rid, label, dim and vec (doubles, packed) of the rows that can link at all."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & fine)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = []
            for x in batch.column(3):
                d = np.array(x.as_py(), np.float64)
                vec.append((d / np.abs(d).max()).tobytes())  # squares of tiny or huge numbers would not fit; the cosine is the same
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(vec, pa.binary())], names=["rid", "label", "dim", "vec"])

    return good.select("rid", F.col(label).cast("string").alias("label"), F.size(vector).alias("dim"), v.alias("vec")).mapInArrow(tidy(pack), "rid long, label string, dim int, vec binary")


def _planned(rows: DataFrame, least: float, missed: float, work: int) -> DataFrame:
    """rows (rid, label, dim, vec) with the bits and passes of their label and dimension; plans are made by executors, as labels may be many. Where no pair may be missed there are no bits."""
    if not missed:
        return rows.select("rid", "label", "dim", "vec", F.lit(0).alias("bits"), F.lit(1).alias("passes"))
    sizes = rows.groupBy("label", "dim").agg(F.count("*").alias("c"))
    large = small_enough(written(sizes.filter(F.col("c") * F.col("dim") > 2 * work)))  # for fewer, a second pass costs more than it can save

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for dim, c, vecs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                x = _units(vecs.values)[1]
                cosine = (x @ x.T)[np.triu_indices(len(x), 1)]
                out.append(plan(c, 1 - np.arccos(np.clip(cosine, -1, 1)) / math.pi, least, missed, work / dim) if len(x) > 1 else (0, 1))
            bits, passes = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bits, pa.int32()), pa.array(passes, pa.int32())], names=["label", "dim", "bits", "passes"])

    some = rows.join(large, ["label", "dim"]).filter(F.pmod(F.xxhash64(F.lit(2), "rid"), F.ceil(F.col("c") / SAMPLE)) == 0)
    plans = some.groupBy("label", "dim", "c").agg(F.collect_list("vec").alias("vecs")).mapInArrow(tidy(measure), "label string, dim int, bits int, passes int")
    out = rows.join(small_enough(written(plans)), ["label", "dim"], "left")
    return out.select("rid", "label", "dim", "vec", F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce("passes", F.lit(1)).alias("passes"))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """A row per pass of each of rows (rid, label, dim, vec, bits, passes), with its cell's key."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            kinds = np.stack([batch.column(i).to_numpy() for i in (2, 4, 5)], axis=1)
            for d, bits, passes in np.unique(kinds, axis=0).tolist():
                part = batch.take(pa.array(np.flatnonzero((kinds == (d, bits, passes)).all(axis=1))))
                if (d, bits, passes) not in planes:
                    planes[d, bits, passes] = np.random.default_rng((seed, d)).normal(size=(d, passes * bits))
                sign = (_units(part.column(3))[1] @ planes[d, bits, passes] > 0).reshape(part.num_rows, passes, bits)
                keys = (sign * (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).sum(axis=2, dtype=np.int64)
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), p, np.int32)), *part.columns[1:3], pa.array(keys[:, p]), part.column(0), part.column(3)], names=["pass", "label", "dim", "key", "rid", "vec"])

    return rows.mapInArrow(tidy(project), "pass int, label string, dim int, key long, rid long, vec binary")


def _compared(rids: np.ndarray, x: np.ndarray, rids2: np.ndarray, y: np.ndarray, least: float, forest: Forest) -> None:
    """Links between rows of x and of y go to the forest, once for each set of rows of y that is connected already."""
    stands = np.arange(len(y))
    for at in range(0, len(x), 512):
        hits = x[at : at + 512] @ y.T >= least
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            first, *more = np.unique(stands[hits[i]]).tolist()
            forest.join(int(rids[at + i]), int(rids2[first]))
            for other in more:
                forest.join(int(rids2[other]), int(rids2[first]))
                stands[stands == other] = first


def _cells(planned: DataFrame, least: float, seed: int, block: int = CELL) -> DataFrame:
    """a, b: what links in the cells of all passes, as a forest per partition. Cells of more than `block` vectors are compared block against block."""
    cell = ["pass", "label", "dim", "key"]
    keyed = _keyed(planned, seed)
    heavy = written(keyed.groupBy(*cell).count().filter(F.col("count") > block).select(*cell, F.ceil(F.col("count") / block).alias("blocks")))
    lists = lambda df, *by: df.groupBy(*cell, *by).agg(F.collect_list("rid").alias("rids"), F.collect_list("vec").alias("vecs"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for columns in zip(*batch.columns):
                rids, vecs, rids2, vecs2 = (*columns, *columns)[:4]
                _compared(rids.values.to_numpy(), _units(vecs.values)[1], rids2.values.to_numpy(), _units(vecs2.values)[1], least, forest)
        nodes, roots = forest.links()
        for at in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(z[at : at + 50_000], np.int64)) for z in (nodes, roots)], names=["a", "b"])

    linked = lambda df: df.mapInArrow(tidy(link), "a long, b long")
    if not heavy.limit(1).count():
        return linked(lists(keyed).filter("size(rids) > 1").select("rids", "vecs"))
    light = lists(keyed.join(small_enough(heavy), cell, "left_anti")).filter("size(rids) > 1").select("rids", "vecs")
    rows = keyed.join(small_enough(heavy), cell).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "rid"), "blocks"))
    parts = written(lists(rows, "blocks", "block"))
    ways = F.ceil(F.sqrt("blocks"))  # the pairs of a cell's blocks are dealt to so many tasks
    left = parts.withColumn("way", F.pmod("block", ways)).drop("blocks")
    right = parts.select(*cell, F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("way"), F.col("block").alias("block2"), F.col("rids").alias("rids2"), F.col("vecs").alias("vecs2"))
    met = left.join(right, [*cell, "way"]).filter("block <= block2").select("rids", "vecs", "rids2", "vecs2")
    return linked(light).unionByName(linked(met))


def _counted(members: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """rid, n: how many others of its component (root) each of members (root, rid, vec) links with.

    In a component of more than one block, a member whose angle to the root plus the largest such angle is within the
    threshold links with all others, by the triangle inequality. Everyone else is compared block against block.
    """
    limit = math.acos(least) - 1e-6
    sizes = members.groupBy("root").agg(F.count("*").alias("c"))
    sized = members.join(sizes, "root")
    large = sized.filter(F.col("c") > block)

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("ij,ij->i", _units(batch.column(3))[1], _units(batch.column(4))[1])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["root", "rid", "c", "angle"])

    leaders = large.filter("rid = root").select("root", F.col("vec").alias("lead"))
    spread = written(large.join(leaders, "root").select("root", "rid", "c", "vec", "lead").mapInArrow(tidy(angles), "root long, rid long, c long, angle double"))
    widest = spread.groupBy("root").agg(F.max("angle").alias("widest"))
    sure = spread.join(widest, "root").filter(F.col("angle") + F.col("widest") <= limit).select("rid", (F.col("c") - 1).alias("n"))
    rows = sized.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "rid"), F.ceil(F.col("c") / block)))
    rows = rows.join(sure.select("rid", F.lit(True).alias("sure")), "rid", "left")
    lists = lambda df, r, v: df.groupBy("root", "block").agg(F.collect_list("rid").alias(r), F.collect_list("vec").alias(v))
    rows = written(rows)
    open_ = lists(rows.filter("sure is null"), "rids", "vecs")
    other = lists(rows.join(open_.select("root").distinct(), "root", "left_semi"), "rids2", "vecs2").withColumnRenamed("block", "block2")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rids, a, rids2, b in zip(*batch.columns):
                x, y = _units(a.values)[1], _units(b.values)[1]
                own = np.isin(rids.values.to_numpy(), rids2.values.to_numpy())
                n = np.concatenate([(x[i : i + 512] @ y.T >= least).sum(axis=1) for i in range(0, len(x), 512)]) - own
                yield pa.RecordBatch.from_arrays([rids.values, pa.array(n.astype(np.int64))], names=["rid", "n"])

    met = open_.join(other, "root").select("rids", "vecs", "rids2", "vecs2")
    return met.mapInArrow(tidy(count), "rid long, n long").groupBy("rid").agg(F.sum("n").alias("n")).unionByName(sure)


def near_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, missed: float = 0.0, seed: int = 23, work: int = PASS) -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id reachable) and kept, a row per row of table.

    Vectors link if label and dimension are equal and their cosine, in doubles, is at least `least`. Null, empty and zero
    vectors, those with null or non-finite components and those with a null label link with nothing. Repeated rows
    are vectors of their own (with a cosine of 1); rows with a null vec_id link but name no component. No partners are capped.
    missed: 0 finds all pairs at every size, as each label is one cell, so the work grows with the square of a label. Else plan() bounds the chance that
    a pair is missed by it, however the vectors of a label lie; labels that are small or lie in a narrow cone are then compared in full all the same.
    Other columns are not read; an empty table gives no rows.
    """
    table = batched(table)
    rows = written(table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("y")).withColumn("rid", F.monotonically_increasing_id()))
    good = written(_valid(rows, "v", "y"))
    alike = ["label", "dim", "vec"]
    firsts = written(good.groupBy(*alike).agg(F.min("rid").alias("rid"), F.count("*").alias("copies")))
    again = good.join(firsts.filter("copies > 1").select(*alike, F.col("rid").alias("first")), alike).filter("rid <> first")
    planned = written(_planned(firsts.select("rid", *alike), least, missed, work))
    links = _cells(planned, least, seed).unionByName(again.select(F.col("rid").alias("a"), F.col("first").alias("b")))
    stars = written(components(written(links)))
    roots = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    members = written(good.join(roots, good["rid"] == roots["node"]).select("root", "rid", "vec"))
    counts = _counted(members, least)
    named = rows.select("rid", "vec_id").join(members.select("rid", "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    low = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = named.join(low, "root").join(counts, "rid", "left")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", kept.alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))
