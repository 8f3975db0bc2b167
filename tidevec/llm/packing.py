"""Packing token pieces into sequences: first-fit decreasing in randomised groups of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import batched, read, written
from .workers import tidy

#: Token after each document.
END = 0


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    """text -> uint32 ids as of Tokenizer.encode(text, add_special_tokens=False) over the .json beside path, the byte-level vocabulary's ranks.

    tiktoken is about four times as fast with equal ids; texts with the string of a token added to the vocabulary go to that library.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = path.replace(".tiktoken", ".json")
    with open(library, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f).get("added_tokens") or []]
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = []

    def ids(text: str) -> np.ndarray:
        try:
            if not any(x in text for x in added):
                return fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # its regex gives up on runs of spaces of about a million
            if isinstance(e, KeyboardInterrupt):
                raise
        from tokenizers import Tokenizer

        if not slow:
            slow.append(Tokenizer.from_file(library))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return ids


PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"


def tokenised(docs: DataFrame, sequence: int = 1024, path: str | None = None) -> DataFrame:
    """Pieces of at most sequence tokens of each document: doc_id, start, length, doc_tokens and ids (uint32, little-endian).

    Null and empty texts give one piece, the end token. Rows are taken one by one: repeated rows give
    repeated pieces, an empty table none. Other columns are not read.
    """
    docs = batched(docs)
    path = path or vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                raw = ids.tobytes()
                for start in range(0, len(ids), sequence):
                    end = min(start + sequence, len(ids))
                    for to, x in zip(out, (doc, start, end - start, len(ids), raw[4 * start : 4 * end])):
                        to.append(x)
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut), PIECE)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; the longest go first, each to the first bin that has room.

    A tournament tree holds the largest room left below each inner node, so that the first bin with
    room is found in one way down from the root.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node >>= 1
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def packed(pieces: DataFrame, sequence: int = 1024, seed: int = 11, group: int = 16_384) -> DataFrame:
    """pieces (with a column length from 1 to sequence) with sequence_id and offset, gapless from 0 in each sequence.

    Pieces go by a seeded hash of their whole row and of a running number to groups of about group
    rows; no task holds more than a few groups, and equal rows spread like any others. pieces must be
    cheap to read twice and stable (a written table). Columns sequence_id and offset of pieces would clash: an error.
    """
    clash = {"sequence_id", "offset", "pack_group"} & {c.lower() for c in pieces.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here")
    groups = max(1, -(-pieces.count() // group))
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([c for c in ("doc_id", "start") if c in frame], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].to_numpy(np.int64), sequence)
        return frame[names].assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    salted = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), *names, F.monotonically_increasing_id()), F.lit(groups)))
    return salted.groupBy("pack_group").applyInPandas(fill, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """One row per piece of docs with its place in a sequence of 1024 tokens; see tokenised() and packed()."""
    pieces = tokenised(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(written(pieces)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
