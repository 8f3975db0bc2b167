"""Connected components of link tables, as dataflow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, written
from .workers import tidy


class Forest:
    """Union-find over int64 numbers; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        self.joins(a, b)

    def joins(self, a: int, b: int) -> bool:
        """Unites two sets; whether they were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def links(self) -> tuple[list[int], list[int]]:
        """(node, root) of every node that is not a root."""
        nodes = [x for x in list(self.up) if self.up[x] != x]
        return nodes, [self.root(x) for x in nodes]


def _contracted(links: DataFrame) -> DataFrame:
    """The links of each partition as stars around their local roots."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        nodes, roots = forest.links()
        for at in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x[at : at + 50_000], np.int64)) for x in (nodes, roots)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(tidy(contract), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest number reachable) for every number in links (a, b long), other than the roots themselves.

    Large-star and small-star steps in turn: every link moves to the smallest neighbour of its ends until
    each component is a star. Both take a minimum per number (combined before the shuffle) and a join, which
    adaptive execution splits where a hub has very many links. Nulls and links of a number with itself don't count.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = written(_contracted(links))
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("p"))
        after = written(small.select(F.col("p.x").alias("a"), F.col("p.y").alias("b")).filter("a <> b").distinct())
        state = mark(after)
        dropped(now)
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def small_enough(df: DataFrame, rows: int = 300_000) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows (narrow ones: a few MB), else as it is, for a shuffled join. df is counted: give a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Keys:
    """A bitmap of the hashes of the rows of keys (a written table) in its columns, about 16 bits for each and `most` in all. It goes to the driver and is broadcast: 8 MB at most, however many keys there are."""

    def __init__(self, keys: DataFrame, columns: list[str], most: int = 1 << 26) -> None:
        self.columns, self.size = columns, min(most, 1 << max(10, (8 * keys.count()).bit_length()))
        bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
        told = keys.select(self._place().alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        words = np.zeros(self.size // 64, np.int64)
        words[np.asarray(told.column("word"))] = np.asarray(told.column("bits"))
        row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
        self.frame = keys.sparkSession.createDataFrame(pa.table({"_bits": row}))

    def _place(self):
        return F.pmod(F.xxhash64(*self.columns), F.lit(self.size))

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of df that may be among the keys, and those that are not. Few of the former are not either, unless `most` is too small for the keys: join them. No row is shuffled."""
        place = self._place()
        told = F.getbit(F.get("_bits", F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1
        both = df.crossJoin(F.broadcast(self.frame))
        return both.filter(told).select(*df.columns), both.filter(~told).select(*df.columns)
