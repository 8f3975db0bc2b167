"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import batched, fold, read
from .training import labelled
from .workers import tidy

#: Slots of hashed words; those of statistics follow.
SLOTS = 1 << 15
#: Upper bounds of the bins of each statistic, all of them ratios or logarithms.
BINS = {
    "log_words": (1, 2, 3, 4, 5, 6, 7, 8),
    "word_bytes": (2, 3, 4, 5, 6, 8, 11, 16),
    "distinct": (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "stutter": (0.005, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6, 0.8),
    "upper": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.6, 0.8),
    "symbols": (0.0005, 0.002, 0.005, 0.01, 0.03, 0.06, 0.12, 0.25),
    "marks": (0.0005, 0.002, 0.005, 0.01, 0.03, 0.06, 0.12, 0.25),
    "stops": (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.15),
    "digits": (0.001, 0.005, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5),
    "lines": (0.01, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "log_chars": (3, 4, 5, 6, 7, 8, 9, 10),
}
WIDTH = SLOTS + 9 * len(BINS)
UPPER, SYMBOLS, MARKS, STOPS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&|<>", b"!?{}[]=_~^\\/@", b".,;:", b"0123456789"


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """bias + <w, x> + sum over factors of ((sum v x)^2 - sum (v x)^2) / 2, in time linear in the features. Every row has a feature."""
        v = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat((v * v).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weights[slots] * values, starts) + ((sums * sums).sum(axis=1) - squares) / 2


def _featured():
    """(text, n_chars) -> slots and values; words share a norm of 2, statistics weigh 0.5 each."""
    cache: dict[bytes, int] = {}

    def features(text: bytes, n_chars: int | None) -> tuple[list[int], list[float]]:
        words = text.split()
        n, kinds = len(words), set(words)
        if len(cache) > 100_000:
            cache.clear()
        slots = set()
        for w in kinds:
            s = cache.get(w)
            if s is None:
                s = cache[w] = zlib.crc32(w.lower()) % SLOTS
            slots.add(s)
        size, some = max(1, len(text)), max(1, n)
        count = lambda of: (len(text) - len(text.translate(None, of))) / size
        lines = [x for x in text.split(b"\n") if x.strip()]
        stats = (
            math.log2(1 + n) / 1.6,
            (size - text.count(b" ")) / some,
            len(kinds) / some,
            sum(map(bytes.__eq__, words, words[1:])) / some,
            count(UPPER),
            count(SYMBOLS),
            count(MARKS),
            count(STOPS),
            count(DIGITS),
            1 - len(set(lines)) / max(1, len(lines)),
            math.log(1 + max(0, n_chars or 0)),
        )
        out = sorted(slots)
        values = [2 / math.sqrt(max(1, len(out)))] * len(out)
        for i, (x, bins) in enumerate(zip(stats, BINS.values())):
            out.append(SLOTS + 9 * i + bisect.bisect_left(bins, x))
            values.append(0.5)
        return out, values

    return features


def fit(rows: list, rank: int = 8, epochs: int = 8, batch: int = 128, rate: float = 0.1, l2: float = 1e-5, seed: int = 1) -> Machine:
    """Logistic loss by AdaGrad over (y, slots, values) rows. One class or no rows: a constant score."""
    rng = np.random.default_rng(seed)
    y = np.array([r[0] for r in rows], np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    m = Machine(math.log(share / (1 - share)), np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, rank)))
    if len(set(y.tolist())) < 2:
        m.factors[:] = 0
        return m
    slots = [np.frombuffer(r[1], np.int32) for r in rows]
    values = [np.frombuffer(r[2], np.float32) for r in rows]
    gw, gv, gb = np.full(WIDTH, 1e-6), np.full((WIDTH, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            s, x = np.concatenate([slots[i] for i in pick]), np.concatenate([values[i] for i in pick]).astype(np.float64)
            sizes = np.array([len(slots[i]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            row = np.repeat(np.arange(len(pick)), sizes)
            v = m.factors[s] * x[:, None]
            sums = np.add.reduceat(v, starts, axis=0)
            z = m.bias + np.add.reduceat(m.weights[s] * x, starts) + ((sums * sums).sum(1) - np.add.reduceat((v * v).sum(1), starts)) / 2
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            e = err[row] * x
            used, inverse = np.unique(s, return_inverse=True)
            dw = np.bincount(inverse, e, len(used)) + l2 * m.weights[used]
            pull = e[:, None] * (sums[row] - v)
            dv = np.stack([np.bincount(inverse, pull[:, f], len(used)) for f in range(rank)], axis=1) + l2 * m.factors[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += err.sum() ** 2
            m.weights[used] -= rate * dw / np.sqrt(gw[used])
            m.factors[used] -= rate * dv / np.sqrt(gv[used])
            m.bias -= rate * err.sum() / math.sqrt(gb)
    return m


def _columns(docs: DataFrame) -> list:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col("text").cast("binary").alias("text"), chars.alias("n_chars")]


def trained(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = 12_000, size: int = 96 << 20) -> Machine:
    """A machine fitted on at most `rows` labelled documents outside the held-out fold, of at most `size` bytes together; their features, not their texts, go to the driver.

    Null texts count as empty, repeated rows each; see labelled() for null labels and ids. No labels: a constant score.
    """
    docs = batched(docs)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _featured()
        for batch in batches:
            got = [features(t.as_py() or b"", c.as_py()) for t, c in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(s, np.int32).tobytes() for s, _ in got], pa.binary()), pa.array([np.array(v, np.float32).tobytes() for _, v in got], pa.binary())], names=["y", "slots", "values"])

    sample = labelled(docs, labels, "quality", folds, held_out, rows, size, dict(zip(("text", "n_chars"), _columns(docs))))
    got = sample.mapInArrow(tidy(featured), "y int, slots binary, values binary").collect()
    return fit(sorted((r[0], bytes(r[1]), bytes(r[2])) for r in got))


def scored(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with score, 0 to 1. Null texts score as empty ones; rows are scored one by one; extra columns pass through if kept."""
    docs = batched(docs)
    bias, weights, factors = machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32)
    keep_fields = [docs.schema[c] for c in keep]
    n = len(keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = _featured(), Machine(bias, weights, factors)
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = [features(t.as_py() or b"", c.as_py()) for t, c in zip(part.column(n), part.column(n + 1))]
                sizes = np.array([len(s) for s, _ in got])
                s, x = np.concatenate([np.array(s, np.int32) for s, _ in got]), np.concatenate([np.array(v, np.float32) for _, v in got])
                z = m.logits(s, x, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=[*keep, "score"])

    from pyspark.sql import types as T

    return docs.select(*keep, *[c.alias(f"_{i}") for i, c in enumerate(_columns(docs))]).mapInArrow(tidy(score), T.StructType([*keep_fields, T.StructField("score", T.DoubleType())]))


#: Documents below this score are rejected.
LEAST = 0.3


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored(docs, machine, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
