"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make document scores and offsets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import batched, fold, read, written
from .training import labelled
from .workers import tidy

#: Tokens of a chain that are worked off in step; longer chains are cut into chunks whose transfer matrices are exact.
CHUNK = 128
#: Tokens whose marginals are worked out at once, but for a longer chain.
SLICE = 250_000
STRIP = b".,;:!?\"'()[]{}*#$%&|<>-_"


@dataclass
class Field:
    """States clean (0) and toxic (1). odds: log of a token's toxic against its clean emission by its feature; 0 is a word outside the lexicon."""

    lexicon: dict[bytes, int]
    odds: np.ndarray
    start: float
    moves: np.ndarray  # 2 x 2, logarithms

    def marginals(self, features: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For chains end to end: each token's chance of being toxic, and the expected starts and moves (for fitting)."""
        n = len(features)
        if not n:
            return np.zeros(0), np.zeros(2), np.zeros((2, 2))
        chunks = -(-sizes // CHUNK)
        count = int(chunks.sum())
        chain = np.repeat(np.arange(len(sizes)), chunks)
        first = np.cumsum(chunks) - chunks
        within = np.arange(count) - first[chain]
        begin = (np.cumsum(sizes) - sizes)[chain] + within * CHUNK
        length = np.minimum(sizes[chain] - within * CHUNK, CHUNK)
        steps = int(length.max())
        place = np.minimum(begin[:, None] + np.arange(steps), n - 1)
        real = np.arange(steps) < length[:, None]
        toxic = np.where(real, np.exp(self.odds)[features[place]], 1.0).T.copy()  # steps x chunks
        head = (within == 0) & (length > 0)
        a = np.exp(self.moves)
        a = np.broadcast_to(a[:, :, None], (2, 2, count))
        eye = np.eye(2)[:, :, None]
        live = real.T
        # psi_t = moves x emission; a chain's first token has no move but the start's odds
        opening = np.zeros((2, 2, count))
        opening[:, 0] = 1.0
        opening[:, 1] = math.exp(self.start)

        def psi(t: int) -> np.ndarray:
            m = np.where(head, opening, a) if t == 0 else a
            out = np.stack([m[:, 0], m[:, 1] * toxic[t]], axis=1)
            return out if live[t].all() else np.where(live[t], out, eye)

        mats = [psi(t) for t in range(steps)]
        product = np.broadcast_to(eye, (2, 2, count)).copy()
        for m in mats:
            product = np.stack([product[:, 0] * m[0, j] + product[:, 1] * m[1, j] for j in (0, 1)], axis=1)
            product /= product.sum(axis=(0, 1))
        alpha = np.full((2, count), 0.5)
        beta = np.full((2, count), 0.5)
        most = int(chunks.max()) if len(chunks) else 0
        by_place = np.argsort(within, kind="stable")
        edges = np.searchsorted(within[by_place], np.arange(most + 1))
        for k in range(most - 1):  # into the next chunk of each chain that has one
            c = by_place[edges[k] : edges[k + 1]]
            c = c[within[c] + 1 < chunks[chain[c]]]
            v = np.stack([(alpha[:, c] * product[:, j, c]).sum(0) for j in (0, 1)])
            alpha[:, c + 1] = v / v.sum(0)
        for k in range(most - 1, 0, -1):
            c = by_place[edges[k] : edges[k + 1]]
            v = np.stack([(product[i][:, c] * beta[:, c]).sum(0) for i in (0, 1)])
            beta[:, c - 1] = v / v.sum(0)
        fore = []
        for m in mats:
            alpha = np.stack([alpha[0] * m[0, j] + alpha[1] * m[1, j] for j in (0, 1)])
            alpha /= alpha.sum(0)
            fore.append(alpha)
        chance = np.zeros((steps, count))
        starts, moved = np.zeros(2), np.zeros((2, 2))
        for t in range(steps - 1, -1, -1):
            both = fore[t] * beta
            both /= both.sum(0)
            chance[t] = both[1]
            pairs = (fore[t - 1][:, None] if t else None, mats[t] * beta[None])
            if t:
                joint = pairs[0] * pairs[1]
                joint = joint / joint.sum(axis=(0, 1)) * live[t]
                moved += joint.sum(axis=2)
            else:
                starts += (both * head).sum(axis=1)
            beta = np.stack([(mats[t][i] * beta).sum(0) for i in (0, 1)])
            beta /= beta.sum(0)
        out = np.zeros(n)
        out[place[real]] = chance.T[real]
        return out, starts, moved


def _reader(lexicon: dict[bytes, int]):
    """text -> its words' features."""

    def features(text: bytes) -> list[int]:
        get, cache = lexicon.get, seen
        if len(cache) > 100_000:
            cache.clear()
        out = []
        for w in text.split():
            f = cache.get(w)
            if f is None:
                f = cache[w] = get(w.strip(STRIP).lower(), 0)
            out.append(f)
        return out

    seen: dict[bytes, int] = {}
    return features


def lexicon(sample: DataFrame, entries: int = 4096, sure: float = 3.0) -> list[tuple[bytes, int, int]]:
    """Words that toxic documents of the sample (columns y, text as bytes) have more often than chance allows among so many words: word, toxic and other documents with it.

    A word's evidence is its documents times the divergence of its toxic share from that of all documents;
    it must pass the logarithm of the number of words by `sure`. At most `entries` words, those with the most evidence, go to the driver.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                kinds = {w.strip(STRIP).lower() for w in (t.as_py() or b"").split()}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(kinds), pa.binary()), pa.array([y] * len(kinds), pa.int32())], names=["word", "y"])

    sums = written(sample.select("y", "text").mapInArrow(tidy(words), "word binary, y int").groupBy("word").agg(F.sum("y").alias("bad"), F.count("*").alias("n")))
    docs, bad_docs, kinds = *sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first(), sums.count()
    if not 0 < bad_docs < docs:
        return []
    p, share = F.col("bad") / F.col("n"), bad_docs / docs
    other = F.when(p < 1, (1 - p) * F.ln((1 - p) / (1 - share))).otherwise(0.0)
    evidence = F.col("n") * (p * F.ln(p / share) + other)
    told = sums.filter((F.col("bad") * 2 > F.col("n")) & (evidence > math.log(kinds) + sure))
    best = told.orderBy(F.desc(evidence), "word").limit(entries)
    return [(bytes(r["word"]), r["bad"], r["n"] - r["bad"]) for r in best.collect()]


def fit(docs: list[tuple[int, np.ndarray]], words: list[bytes], telling: np.ndarray, steps: int = 60) -> Field:
    """Maximum likelihood (with a small ridge) by resilient gradient steps on labelled tokens: in toxic documents, those whose word is telling."""
    f = Field({w: i + 1 for i, w in enumerate(words)}, np.concatenate([[-4.0], np.full(len(words), 1.0)]), -4.0, np.zeros((2, 2)))
    if not docs or not any(y for y, _ in docs):
        f.odds[:], f.start = -20.0, -20.0
        return f
    sizes = np.array([len(x) for _, x in docs])
    features = np.concatenate([x for _, x in docs])
    tags = (np.repeat([y for y, _ in docs], sizes) == 1) & telling[features]
    at = np.cumsum(sizes) - sizes
    inner = np.ones(len(features), bool)
    inner[at[sizes > 0]] = False
    follows = np.flatnonzero(inner)
    seen_moves = np.bincount(2 * tags[follows - 1] + tags[follows], minlength=4).reshape(2, 2).astype(float)
    seen_start = float(tags[at[sizes > 0]].sum())
    seen_odds = np.bincount(features, tags, len(f.odds))
    step = np.full(len(f.odds) + 4, 0.3)
    last = np.zeros_like(step)
    ends = np.cumsum(sizes)
    cuts = [0]
    while cuts[-1] < len(sizes):  # chains are worked off in slices, whose arrays stay small
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, at[cuts[-1]] + SLICE, "right"))))
    slices = [(slice(a, b), slice(int(at[a]), int(ends[b - 1]))) for a, b in zip(cuts, cuts[1:])]
    for _ in range(steps):
        expected, starts, moved = np.zeros(len(f.odds)), np.zeros(2), np.zeros((2, 2))
        for chains, tokens in slices:
            chance, begun, went = f.marginals(features[tokens], sizes[chains])
            expected += np.bincount(features[tokens], chance, len(f.odds))
            starts += begun
            moved += went
        g = np.concatenate([seen_odds - expected, [seen_start - starts[1]], (seen_moves - moved).ravel()[1:]])
        here = np.concatenate([f.odds, [f.start], f.moves.ravel()[1:]])
        g -= 0.05 * here
        same = g * last
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-4, 1.0)
        g[same < 0] = 0
        here += np.sign(g) * step
        last = g
        f.odds, f.start, f.moves = here[: len(f.odds)], float(here[len(f.odds)]), np.concatenate([[0.0], here[len(f.odds) + 1 :]]).reshape(2, 2)
    return f


def trained(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = 8000, size: int = 64 << 20) -> Field:
    """A field fitted on at most `rows` labelled documents outside the held-out fold, of at most `size` bytes together; without toxic ones, a field that finds nothing.

    Two bytes for each of their words go to the driver. Null texts have no words; repeated rows count each; see labelled() for null labels and ids.
    """
    docs = batched(docs)
    sample = labelled(docs, labels, "toxic", folds, held_out, rows, size, {"text": F.col("text").cast("binary")})
    told = lexicon(sample)
    words = [w for w, _, _ in told]
    telling = np.array([False] + [bad >= 4 * other for _, bad, other in told])
    table = {w: i + 1 for i, w in enumerate(words)}

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _reader(table)
        for batch in batches:
            got = [np.array(features(t.as_py() or b""), np.int16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["y", "features"])

    got = sample.select("y", "text").mapInArrow(tidy(tagged), "y int, features binary").collect()
    rows_ = sorted((r[0], bytes(r[1])) for r in got)
    return fit([(y, np.frombuffer(x, np.int16)) for y, x in rows_], words, telling)


def scored(docs: DataFrame, field: Field, span_least: float = 0.5) -> DataFrame:
    """doc_id, score (the largest chance of a token to be toxic) and spans: byte offsets [start, end) of runs of words with a chance of at least span_least.

    Null and empty texts score 0 with no spans; rows are scored one by one; other columns are not read.
    """
    docs = batched(docs)
    table, odds, start, moves = field.lexicon, field.odds, field.start, field.moves

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        features, f, word = _reader(table), Field(table, odds, start, moves), re.compile(rb"[^\x20\x09-\x0D]+")
        for batch in batches:
            scores, spans = [], []
            texts = [t.as_py() or b"" for t in batch.column(1)]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1_000_000):
                    size += len(texts[end])
                    end += 1
                own = [np.array(features(t), np.int16) for t in texts[at:end]]
                sizes = np.array([len(x) for x in own])
                chance, _, _ = f.marginals(np.concatenate(own), sizes)
                begin = 0
                for t, n in zip(texts[at:end], sizes.tolist()):
                    c = chance[begin : begin + n]
                    begin += n
                    scores.append(float(c.max()) if n else 0.0)
                    found: list[dict] = []
                    if n and scores[-1] >= span_least:
                        for i, m in enumerate(word.finditer(t)):
                            if c[i] >= span_least:
                                if found and i == last + 1:
                                    found[-1]["end"] = m.end()
                                else:
                                    found.append({"start": m.start(), "end": m.end()})
                                last = i
                    spans.append(found)
                at = end
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(score), "doc_id long, score double, spans array<struct<start: long, end: long>>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return scored(docs, field).select("doc_id", held.alias("held_out"), F.col("score"), (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
