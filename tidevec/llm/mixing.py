"""Mixing sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import read, written
from .texts import WORD

#: More membership patterns than this do not fit the flow on the driver: an error, not a cut.
MAX_PATTERNS = 65_536
#: Of the 64 bits of a document's seeded hash, so many are looked at in each of two rounds for the last one taken.
BITS = 12
#: Fixed weights, by the source's place in code-point order (null last), repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: dict[str | None, int], share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, float]:
    """Each source's words: share of all by weight, at most `most` times its own size, the excess reshared until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > most * sizes[s] * total]
        if not over:
            return {s: float(out.get(s, left * weight[s] / total)) for s in order}
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return {s: float(out[s]) for s in order}


def routed(patterns: list[tuple[tuple, int]], quota: dict, repeats: int) -> list[int]:
    """Words taken of each pattern (its sources, its words) by a min-cost flow to the sources' quotas.

    The k-th copy of a pattern's words costs k, so costs are convex, and a path's cost is that of the
    copy it enters by: shortest paths first means to fill the network copy by copy, a blocking flow each.
    """
    n, sources = len(patterns), list(quota)
    at = {s: 1 + n + j for j, s in enumerate(sources)}
    end = 1 + n + len(sources)
    to, cap, adjacent = [], [], [[] for _ in range(end + 1)]

    def arc(a: int, b: int, c: int) -> int:
        for x, y, z in ((a, b, c), (b, a, 0)):
            adjacent[x].append(len(to))
            to.append(y)
            cap.append(z)
        return len(to) - 2

    entry = []
    for i, (members, words) in enumerate(patterns):
        entry.append(arc(0, 1 + i, 0))
        for s in members:
            arc(1 + i, at[s], repeats * words)
    for s in sources:
        arc(at[s], end, int(quota[s]))
    taken = [0] * n
    for _ in range(repeats):
        for i, (_, words) in enumerate(patterns):
            cap[entry[i]] += words
        while True:
            level = {0: 0}
            queue = deque([0])
            while queue:
                x = queue.popleft()
                for e in adjacent[x]:
                    if cap[e] and to[e] not in level:
                        level[to[e]] = level[x] + 1
                        queue.append(to[e])
            if end not in level:
                break
            place, path = [0] * (end + 1), []
            x = 0
            while True:
                if x == end:
                    least = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= least
                        cap[e ^ 1] += least
                    taken[to[path[0]] - 1] += least
                    x, path = 0, []
                elif place[x] < len(adjacent[x]):
                    e = adjacent[x][place[x]]
                    if cap[e] and level.get(to[e], -1) == level[x] + 1:
                        path.append(e)
                        x = to[e]
                    else:
                        place[x] += 1
                elif path:
                    x = to[path.pop() ^ 1]
                    place[x] += 1
                else:
                    break
    return taken


def mix(rows: DataFrame, quota: dict, repeats: int = 2) -> DataFrame:
    """pattern, copies, cut: a row per membership pattern says how often the mix takes its documents.

    rows: members (sorted array of sources), size (words), h (a seeded hash; equal h are taken alike).
    Every document of a pattern is taken `copies` times, and once more if its h, as unsigned bits, is below
    cut (null: none). rows is read four times: give a written table. The last document taken is
    found by two histograms of the hash, so no task ever sorts a pattern. No rows: no patterns.
    """
    spark = rows.sparkSession
    unsigned = F.col("h").bitwiseXOR(F.lit(-(2**63)))  # the order of the unsigned bits
    rows = rows.select("members", "size", unsigned.alias("u"), F.shiftrightunsigned("h", 64 - BITS).alias("b1"), (F.shiftrightunsigned("h", 64 - 2 * BITS) % (1 << BITS)).alias("b2"))
    found = rows.groupBy("members").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources: merge sources first")
    patterns = sorted(((tuple(r[0]), int(r[1])) for r in found), key=repr)
    flow = routed(patterns, quota, repeats)
    plan = {p: [f // w if w else 0, f % w if w else 0] for (p, w), f in zip(patterns, flow)}
    kind = T.StructType([T.StructField("members", T.ArrayType(T.StringType())), T.StructField("rest", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType())])

    def crossing(rows: DataFrame, keys: list[str], state: dict) -> dict:
        """Of each pattern in state (pattern -> rest, cells so far), the first key at which the sum of sizes passes rest, and what is then left."""
        if not state:
            return {}
        known = F.broadcast(spark.createDataFrame([(list(p), *x) for p, x in state.items()], kind))
        inside = rows.join(known, rows["members"].eqNullSafe(known["members"])).drop(known["members"])
        inside = inside.filter((F.col("c1").isNull() | (F.col("c1") == F.col("b1"))) & (F.col("c2").isNull() | (F.col("c2") == F.col("b2"))))
        sums = inside.groupBy("members", "rest", *keys).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("members").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
        passed = sums.withColumn("run", run).filter("run > rest").groupBy("members").agg(F.min(F.struct(*keys, (F.col("rest") - F.col("run") + F.col("n")).alias("left"))).alias("x"))
        return {tuple(r[0]): (r[1][keys[0]], r[1]["left"]) for r in passed.collect()}

    state = {p: (rest, None, None) for p, (_, rest) in plan.items() if rest}
    one = crossing(rows, ["b1"], state)
    two = crossing(rows, ["b2"], {p: (left, c, None) for p, (c, left) in one.items()})
    last = crossing(rows, ["u"], {p: (left, one[p][0], c) for p, (c, left) in two.items()})
    out = T.StructType([T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("copies", T.IntegerType()), T.StructField("cut", T.LongType())])
    return spark.createDataFrame([(list(p), int(c), int(last[p][0]) if p in last else None) for p, (c, _) in plan.items()], out)


def sized(docs: DataFrame, seed: int = 5) -> DataFrame:
    """row (docs' columns, whatever their names), size (words, null text: 0), members (its source alone) and h (seeded, of doc_id, text and source: rows equal in these are taken alike)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.struct("*").alias("row"), size.alias("size"), F.array(F.col("source").cast("string")).alias("members"), F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("h"))


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (of sized()) with copies: how often the mix takes each. Null sources are one pattern; no rows, none."""
    more = F.col("cut").isNotNull() & (F.col("h").bitwiseXOR(F.lit(-(2**63))) < F.col("cut"))
    joined = rows.join(F.broadcast(plan), rows["members"].eqNullSafe(plan["pattern"]))  # a row per pattern, MAX_PATTERNS at most
    return joined.select(*[rows[c] for c in rows.columns], (plan["copies"] + more.cast("int")).alias("copies"))


def source_targets(rows: DataFrame) -> tuple[dict, dict]:
    got = rows.groupBy(F.col("members")[0].alias("s")).agg(F.sum("size")).limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} sources")
    sizes = {r[0]: int(r[1]) for r in got}
    return sizes, targets(sizes)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs (extra ones too). Null sources are a source."""
    rows = sized(docs)
    narrow = written(rows.select("members", "size", "h"))
    plan = mix(narrow, source_targets(narrow)[1])
    return taken(rows, plan).select("row", F.explode(F.expr("array_repeat(0, copies)"))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(sized(read(spark, sf_dir, "documents")).select("row.doc_id", "row.source", "size", "members", "h"))
    sizes, want = source_targets(rows)
    plan = mix(rows, want)
    about = spark.createDataFrame([(s, sizes[s], want[s]) for s in sizes], "name string, source_size long, target double")
    out = taken(rows, plan)
    out = out.join(F.broadcast(about), out["source"].eqNullSafe(about["name"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
