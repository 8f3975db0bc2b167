"""Language ID by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import batched, fold, read, written
from .workers import tidy

#: N-grams in a profile, and the distance that an n-gram adds which the other profile lacks.
TOP = 300
#: N-grams that a worker holds before it counts them, but for one longer text; and languages at most, as their profiles go to the driver.
HELD, MAX_LANGUAGES = 500_000, 4096


def _grams():
    """text -> its n-grams (1 to 3 letters, words' ends as a letter of their own) as 63-bit numbers; None without a letter."""
    letter = np.zeros(0x110000, bool)
    known = np.zeros(0x110000, bool)

    def grams(text: str) -> np.ndarray | None:
        code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        if not len(code):
            return None
        if not known[code].all():
            for c in np.unique(code).tolist():
                known[c], letter[c] = True, chr(c).isalpha()
        is_letter = letter[code]
        if not is_letter.any():
            return None
        c = np.where(is_letter, code, 1).astype(np.int64)
        c = np.concatenate([[1], c, [1]])
        c = c[np.concatenate([[True], (c[1:] != 1) | (c[:-1] != 1)])]
        two = (c[:-1] << 21) | c[1:]
        return np.concatenate([c[c != 1], two, (two[:-1] << 21) | c[2:]])

    return grams


def _ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The top n-grams, most frequent first; the smaller number wins a tie."""
    if len(grams) > 4 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))[:top]]


def _first(known: DataFrame, rows: int) -> DataFrame:
    """lang and last: of each language in known (lang, h), the 24 leading bits of the seeded hash h up to which it has `rows` rows; all ones if it has fewer.

    Two histograms of twelve bits each, combined before they are shuffled, so no task ever sorts a language. known is read twice.
    """
    high, low = F.shiftrightunsigned("h", 52), F.shiftrightunsigned("h", 40) % 4096
    run = F.sum("n").over(Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    one = known.groupBy("lang", high.alias("b")).agg(F.count("*").alias("n")).withColumn("run", run).filter(f"run >= {rows}")
    one = one.groupBy("lang").agg(F.min(F.struct("b", (F.col("run") - F.col("n")).alias("before"))).alias("x")).select("lang", F.col("x.b").alias("cell"), F.col("x.before").alias("before"))
    inside = known.join(F.broadcast(one.withColumnRenamed("lang", "l")), (F.col("lang") == F.col("l")) & (high == F.col("cell")))
    two = inside.groupBy("lang", "cell", "before", low.alias("b")).agg(F.count("*").alias("n")).withColumn("run", F.col("before") + run).filter(f"run >= {rows}")
    return two.groupBy("lang").agg(F.min(F.col("cell") * 4096 + F.col("b")).alias("last"))


def profiles(docs: DataFrame, folds: int = 3, held_out: int = 1, rows: int = 2000, top: int = TOP) -> dict[str, np.ndarray]:
    """Language -> its most frequent n-grams in order, from about `rows` documents of each language outside the held-out fold.

    They are the first by a seeded hash of doc_id; those that share the last one's 24 leading bits come along. Texts, ids or languages that
    are null are not learned from, repeated rows count each, columns other than doc_id, lang and text are not read; with no row at all there are no profiles.
    More than MAX_LANGUAGES are an error.
    """
    docs = batched(docs.select("doc_id", "lang", "text"))
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", folds) != held_out))
    known = known.withColumn("h", F.xxhash64(F.lit(9), "doc_id"))
    last = written(_first(known.select("lang", "h"), rows).withColumnRenamed("lang", "y"))
    if last.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sample = known.join(F.broadcast(last), known["lang"] == last["y"], "left").filter(F.col("last").isNull() | (F.shiftrightunsigned("h", 40) <= F.col("last"))).select(F.col("lang").alias("y"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams()

        def told(y: str, parts: list) -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([y] * len(g)), pa.array(g), pa.array(n.astype(np.int64))], names=["y", "gram", "n"])

        for batch in batches:
            by: dict[str, list] = {}
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (g := grams(t.as_py())) is not None:
                    by.setdefault(y, []).append(g)
                    if sum(map(len, by[y])) > HELD:
                        yield told(y, by.pop(y))
            for y, parts in by.items():
                yield told(y, parts)

    sums = sample.mapInArrow(tidy(counted), "y string, gram long, n long").groupBy("y", "gram").agg(F.sum("n").alias("n"))
    best = sums.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= top)
    out: dict[str, list] = {}
    for y, gram, _ in sorted(((x["y"], x["gram"], x["r"]) for x in best.collect()), key=lambda x: (x[0], x[2])):
        out.setdefault(y, []).append(gram)
    return {y: np.array(g, np.int64) for y, g in out.items()}


def identified(docs: DataFrame, known: dict[str, np.ndarray], top: int = TOP) -> DataFrame:
    """doc_id, lang_pred and score: the language at the least out-of-place distance (ties: the first by name) and 1 minus that distance over the largest possible.

    und and 0 where the text is null or has no letter, or no language was learned. Rows are judged one by one; other columns are not read.
    """
    docs = batched(docs)
    names = sorted(known)
    every = np.unique(np.concatenate([known[y] for y in names])) if names else np.zeros(0, np.int64)
    place = np.full((len(every) + 1, max(1, len(names))), -1, np.int32)
    for j, y in enumerate(names):
        place[np.searchsorted(every, known[y]), j] = np.arange(len(known[y]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams()
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(1):
                t = t.as_py()
                g = grams(t) if t and names else None
                if g is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                own = _ranked(*np.unique(g, return_counts=True), top)
                i = np.searchsorted(every, own)
                i[(i == len(every)) | (every[np.minimum(i, len(every) - 1)] != own)] = len(every)
                p = place[i]
                d = np.where(p < 0, top, np.minimum(top, np.abs(p - np.arange(len(own))[:, None]))).sum(axis=0)
                langs.append(names[int(d.argmin())])
                scores.append(1 - float(d.min()) / (top * len(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(judge), "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return identified(docs, profiles(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
