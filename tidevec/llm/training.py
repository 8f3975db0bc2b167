"""Bounded samples of labelled rows to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fold, written


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, size: int, columns: dict[str, Column], seed: int = 3) -> DataFrame:
    """y and the columns (name -> expression over docs), as a written table, of labelled documents outside the held-out fold.

    They are taken in the order of a seeded hash of doc_id: at most `rows` labelled ids, and of these as many as have `size` bytes of text together. Null
    labels and ids are left out; a document with several labels counts once for each, as does each of several documents with one id. Columns of
    docs that columns does not name are not read, so no name clashes.
    """
    h = F.xxhash64(F.lit(seed), F.col("y_id"))
    known = labels.filter(F.col(label).isNotNull() & (fold("doc_id", folds) != held_out)).select(F.col("doc_id").alias("y_id"), F.col(label).cast("int").alias("y"))
    chosen = known.select("y_id", "y", h.alias("y_at")).orderBy("y_at", "y_id").limit(rows)  # `rows` numbers at most: small enough to broadcast
    narrow = docs.select(F.col("doc_id").alias("y_doc"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("y_size"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("x"))
    sample = written(narrow.join(F.broadcast(chosen), narrow["y_doc"] == chosen["y_id"]).select("y", "y_at", "y_size", "x"))
    sums, last = 0, None
    for at, n in sorted(tuple(r) for r in sample.groupBy("y_at").agg(F.sum("y_size")).collect()):  # `rows` numbers at most
        sums += n
        if sums > size and last is not None:
            return sample.filter(F.col("y_at") <= last).select("y", "x.*")
        last = at
    return sample.select("y", "x.*")
