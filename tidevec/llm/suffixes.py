"""Suffix-array dedup of repeated byte strings of a fixed length.

Of the suffixes of all texts, only those at anchors are sorted: the anchor of a window (a string of the length that
counts) is the first place in it with the least hash of the next GRAM bytes, so equal windows have
it at the same place, and a window whose anchor's bytes occur nowhere else is unique. Suffixes at the other anchors, with the
bytes before them that their windows reach back to, are range-partitioned by their leading bytes at sampled
splitters; each bucket sorts them by multikey quicksort, forwards and backwards, and the common prefixes of neighbours tell
which windows are equal. Leading bytes too frequent for one bucket are spread over several, and windows
found once in their bucket are then compared across buckets.

Runs of a fixed number of words are found in the same way, in texts whose words are written as hashes of WORD_BYTES bytes;
windows and anchors then begin with a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Keys, small_enough
from .store import batched, dropped, read, released, written
from .texts import flat, mixed, signed
from .workers import tidy

GRAM = 100
#: A word's hash.
WORD_BYTES = 8
#: Suffixes with the same leading bytes in a bucket, about, before they are spread over several.
HOT = 50_000
#: Positions hashed at once, and bytes of suffixes sorted at once.
SEGMENT, BUFFER = 1 << 18, 8 << 20


class Anchors:
    """Finds the anchors of all windows of `length` bytes in texts laid end to end; with a unit of WORD_BYTES, in texts of words' hashes (as uint64), where lengths and places are words."""

    def __init__(self, length: int, unit: int = 1) -> None:
        self.unit, self.length, self.gram = unit, length // unit, -(-GRAM // unit)
        self.grams = self.length - self.gram + 1
        rng = np.random.default_rng(97)
        self.table = rng.integers(0, 2**64, 256, np.uint64)
        base = 0xF1357AEA2E62A9C5
        inverse = pow(base, -1, 2**64)
        n = SEGMENT + 2 * self.length
        self.up = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, base, np.uint64)))
        self.down = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, inverse, np.uint64)))

    def find(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Hash, anchor, first and last window of each run of windows with the same anchor, as places in data."""
        valid = np.ones(len(data), bool)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            valid[max(a, b - self.length + 1) : b] = False
        for at in range(0, len(data), SEGMENT):
            ok = valid[at : at + SEGMENT]
            if ok.any():
                yield from self._segment(data[at : at + SEGMENT + self.length], ok, at)

    def _segment(self, data: np.ndarray, ok: np.ndarray, at: int) -> Iterator[tuple[np.ndarray, ...]]:
        n = len(data) - self.gram + 1
        if n < self.grams:
            return
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.table[data] if self.unit == 1 else data) * self.up[: len(data)], out=sums[1:])
        h = mixed((sums[self.gram :] - sums[: -self.gram]) * self.down[:n])
        order = (h >> np.uint64(32)).astype(np.uint32)
        low, width = order, 1
        while 2 * width <= self.grams:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = self.grams - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        ok = ok[: len(low)]
        low = low[: len(ok)]
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (low[1:] != low[:-1]) | (order[: len(low) - 1] == low[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return
        ends = np.flatnonzero(ok & ~np.append(ok[1:], False))
        last = np.minimum(np.append(first[1:] - 1, len(ok)), ends[np.searchsorted(ends, first)])
        for i in range(0, len(first), 20_000):
            f = first[i : i + 20_000]
            a = f + order[f[:, None] + np.arange(self.grams)].argmin(axis=1)
            yield h[a], a + at, f + at, last[i : i + 20_000] + at


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts laid end to end begin and end."""
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    # a word ends with its text
    border = np.zeros(len(data) + 1, bool)
    border[starts] = True
    begins = np.flatnonzero(inside & (border[:-1] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (border[1:] | ~np.append(inside[1:], False))) + 1
    return begins, ends


class Words:
    """Texts as hashes of their words, and the word each begins with: equal runs of words, whatever white space parts them, become equal bytes."""

    LONG = 64

    def __init__(self) -> None:
        self.table = np.random.default_rng(53).integers(0, 2**64, 256, np.uint64)
        base = 0xF1357AEA2E62A9C5
        self.up = np.cumprod(np.append(np.ones(1, np.uint64), np.full(self.LONG, base, np.uint64)))

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        begins, ends = _words(data, starts)
        sizes = ends - begins
        hashes = np.zeros(len(begins), np.uint64)
        step = SEGMENT // 8
        for at in range(0, len(begins), step):
            short = at + np.flatnonzero(sizes[at : at + step] <= self.LONG)
            if not len(short):
                continue
            n = sizes[short]
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            letters = data[np.repeat(begins[short], n) + place]
            hashes[short] = mixed(np.add.reduceat(self.table[letters] * self.up[place], first) + n.astype(np.uint64))
        for i in np.flatnonzero(sizes > self.LONG).tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(data[begins[i] : ends[i]].tobytes())
        return hashes, np.searchsorted(begins, starts)


def _keys(docs: DataFrame) -> DataFrame:
    """k1, k2 and data: rows with equal keys have equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64(text).alias("k2"), text.cast("binary").alias("data"))


def _anchors(docs: DataFrame, length: int, words: bool = False) -> DataFrame:
    """h, k1, k2 and places: of each anchor with the hash h, its place in the text, and how far before it its first and last windows begin, in one number (see _place).

    Anchors of a text with equal hashes, as a text that repeats itself has many, are told in one row where they are found together.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = WORD_BYTES if words else 1
        finder, hashed = Anchors(length, unit), Words()
        for batch in batches:
            data, starts = flat(batch.column(2))
            if words:
                data, starts = hashed.encode(data, starts)
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for h, a, lo, hi in finder.find(data, starts):
                doc = np.searchsorted(starts, lo, "right") - 1
                own = starts[doc]
                by = np.lexsort((h, doc))
                doc, h, at = doc[by], signed(h)[by], ((a - own << 24) | (a - lo << 12) | (a - hi))[by] * unit
                first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), pa.int32()), pa.array(at))
                cols = [h[first], k1[doc[first]], k2[doc[first]]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), places], names=["h", "k1", "k2", "places"])

    return _keys(docs).mapInArrow(tidy(find), "h long, k1 long, k2 long, places array<long>")


def _place(at: int) -> tuple[int, int, int]:
    """Anchor, first and last window."""
    a = at >> 24
    return a, a - (at >> 12 & 4095), a - (at & 4095)


SUFFIX = "k1 long, k2 long, a int, before binary, suffix binary, salt int, copies int"


def _suffixes(docs: DataFrame, repeated: DataFrame, length: int, words: bool = False) -> DataFrame:
    """The suffixes at repeated anchors (k1, k2, at: lists of places and salts). before and suffix reach as far as the anchor's windows; one that is found again in its own text, with all its windows, is kept once with copies = 2.

    The bytes of the others of these need no neighbour: they are merged within the text and given as rows without before and suffix, from a to salt.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            size = 0
            texts = (x.as_py() for x in batch.column(2))
            if words:
                hashes, starts = hashed.encode(*flat(batch.column(2)))
                texts = (hashes[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()))
            for k1, k2, data, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
                seen: dict[tuple, int] = {}
                known: list[tuple[int, int]] = []
                for place, salt in sorted({(x["at"], x["salt"]) for x in at}):
                    a, lo, hi = _place(place)
                    mark = (a - lo, hashlib.blake2b(data[lo : hi + length], digest_size=16).digest())
                    if mark in seen:
                        # both are repeated: this one needs no neighbour, the other is told
                        out[6][seen[mark]] = 2
                        known.append((lo, hi + length))
                        continue
                    seen[mark] = len(out[0])
                    for to, v in zip(out, (k1, k2, a, data[lo:a], data[a : hi + length], salt, 1)):
                        to.append(v)
                    size += hi + length - lo
                for s, e in _merged(known):
                    for to, v in zip(out, (k1, k2, s, None, None, e, 2)):
                        to.append(v)
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [[], [], [], [], [], [], []], 0
            yield _batch(out)

    def _batch(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["k1", "k2", "a", "before", "suffix", "salt", "copies"])

    lists = repeated.groupBy("k1", "k2").agg(F.flatten(F.collect_set("at")).alias("at"))
    # Only texts with a repeated anchor are shuffled.
    keys = written(repeated.select("k1", "k2").distinct())
    texts, _ = Keys(keys, ["k1", "k2"]).split(_keys(docs))
    return texts.join(lists, ["k1", "k2"]).select("k1", "k2", "data", "at").mapInArrow(tidy(cut), SUFFIX)


def multikey_quicksort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes in keys, and the common prefix of each with the row before it in that order.

    All ranges of rows with an equal prefix are split at once in three, by their next eight bytes against those of the range's
    middle row: less, equal and greater. Equal ones go on to the next eight bytes. A range of one row is done.
    """
    n, width = keys.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = keys
    words = words.view(">u8").astype(np.uint64)
    deepest = words.shape[1]
    order, place, depth = np.arange(n), np.arange(n), np.zeros(n, np.int64)  # depth: of the rows at place, the ranges still open
    starts = np.zeros(min(n, 1), np.int64)  # of ranges, among place
    while len(place):
        sizes = np.diff(np.append(starts, len(place)))
        rows = order[place]
        value = words[rows, depth]
        pivot = np.repeat(value[starts + sizes // 2], sizes)
        side = np.repeat(3 * np.arange(len(starts)), sizes) + (value >= pivot) + (value > pivot)
        by = np.argsort(side, kind="stable")
        side = side[by]
        order[place] = rows[by]
        depth += side % 3 == 1
        new = np.append(True, side[1:] != side[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(place)))
        open_ = (np.repeat(size, size) > 1) & (depth < deepest)
        place, depth, starts = place[open_], depth[open_], np.flatnonzero(new[open_])
    prefix = np.zeros(n, np.int64)
    if n > 1:
        differ = words[order[1:]] ^ words[order[:-1]]
        first = (differ != 0).argmax(axis=1)
        word = np.take_along_axis(differ, first[:, None], axis=1)[:, 0]
        same = sum((word >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(8))
        prefix[1:] = np.where(word == 0, width, 8 * first + same)
    return order, np.minimum(prefix, width)


def repeated_windows(before: list[bytes], suffix: list[bytes], copies: np.ndarray, length: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether the window that begins d units (of so many bytes) before suffix i occurs again: [i, d], and whether i is the first with it, with the least and largest number of bytes before each i."""
    n, reach = len(suffix), length - GRAM
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, reach), np.uint8)
    for i, (b, s) in enumerate(zip(before, suffix)):
        right[i, : len(s)] = np.frombuffer(s, np.uint8)
        left[i, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
    most = np.array([len(b) for b in before])
    least = np.array([length - len(s) for s in suffix])
    out, one = np.zeros((n, reach // unit + 1), bool), np.zeros((n, reach // unit + 1), bool)
    r_order, r_prefix = multikey_quicksort(right)
    l_order, l_prefix = multikey_quicksort(left)
    r_class, l_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(int(least.min()), int(most.max()) + 1, unit):
        use = np.flatnonzero((least <= d) & (d <= most))
        if not len(use):
            continue
        r_class[r_order] = np.cumsum(r_prefix < length - d)
        l_class[l_order] = np.cumsum(l_prefix < d)
        key = r_class[use] * (n + 1) + l_class[use]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(use), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        out[use, d // unit] = twice | (copies[use] > 1)
        one[use[by[np.append(True, ~same)]], d // unit] = True
    return out, one, least, most


def _spans(hit: np.ndarray, a: np.ndarray, length: int, unit: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the bytes that runs of true windows cover."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return row, a[row] - (past - 1) * unit, a[row] - first * unit + length


def _buckets(suffixes: DataFrame, length: int, words: bool = False) -> DataFrame:
    """k1, k2, s, e: bytes to remove; or, with fp, a window of spread leading bytes, once per bucket: with its place if the bucket has it once, else without."""
    # Rows without a suffix have nothing to be sorted by: a hash spreads them.
    lead = F.coalesce(F.substring("suffix", 1, GRAM), F.unhex(F.hex(F.xxhash64("k1", "k2", "a"))))
    unit = WORD_BYTES if words else 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            known = rows.filter(pc.is_null(rows.column("suffix")))
            places = [pa.array(known.column(c).to_numpy()) for c in ("k1", "k2", "a", "salt")]
            yield pa.RecordBatch.from_arrays([*places, pa.nulls(known.num_rows, pa.binary())], names=["k1", "k2", "s", "e", "fp"])
            rows = rows.filter(pc.is_valid(rows.column("suffix")))
            if not rows.num_rows:
                return
            k1, k2, a, salt, copies = (rows.column(c).to_numpy() for c in ("k1", "k2", "a", "salt", "copies"))
            before, suffix = rows.column("before").to_pylist(), rows.column("suffix").to_pylist()
            hit, one, least, most = repeated_windows(before, suffix, copies, length, unit)
            row, s, e = _spans(hit, a, length, unit)
            yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.nulls(len(row), pa.binary())], names=["k1", "k2", "s", "e", "fp"])
            # A window that this bucket has twice is told once, so that other buckets see it.
            row, d = np.nonzero(one & (salt >= 0)[:, None])
            for at in range(0, len(row), 50_000):
                i, x = row[at : at + 50_000], d[at : at + 50_000]
                fp = [xxhash.xxh3_128_digest((before[j] + suffix[j])[m : m + length]) for j, m in zip(i.tolist(), (most[i] - x * unit).tolist())]
                known = hit[i, x]
                begin = (a[i] - x * unit).astype(np.int32)
                places = [pa.array(v, mask=known) for v in (k1[i], k2[i], begin, begin + np.int32(length))]
                yield pa.RecordBatch.from_arrays([*places, pa.array(fp, pa.binary())], names=["k1", "k2", "s", "e", "fp"])

        held, size, last = [], 0, None
        for batch in batches:
            leads = [x.as_py()[:GRAM] if x.is_valid else None for x in batch.column("suffix")]
            start = 0
            for i, x in enumerate(leads):
                if size > BUFFER and x != last:
                    yield from done(pa.Table.from_batches([*held, batch.slice(start, i - start)]))
                    held, size, start = [], 0, i
                last = x
                size += length + 200
            held.append(batch.slice(start))
        if held:
            yield from done(pa.Table.from_batches(held))

    return suffixes.repartitionByRange(lead, "salt").sortWithinPartitions(lead, "salt").mapInArrow(tidy(work), "k1 long, k2 long, s int, e int, fp binary")


def repeats(docs: DataFrame, length: int = 400, hot: int = HOT, words: bool = False) -> DataFrame:
    """k1, k2 and spans: for each row key with any, the byte ranges [s, e) that windows found more than once cover; words: of the texts' words as hashes."""
    docs = batched(docs)
    of = {"words": True} if words else {}
    anchors = written(_anchors(docs, length, **of))
    # Written, so that the join below reads two plain tables and a passage that very many texts hold can be split among tasks.
    counts = written(anchors.groupBy("h").agg(F.sum(F.size("places")).alias("c")).filter("c > 1"))
    spread = lambda at: F.when(F.col("c") > hot, F.pmod(F.xxhash64("k1", "k2", at), F.ceil(F.col("c") / hot)).cast("int")).otherwise(F.lit(-1))
    # Places stay in their text's list: a row for each would be as many as a passage's copies.
    once = small_enough(counts)
    met = Keys(counts, ["h"]).split(anchors)[0] if once is counts else anchors
    repeated = met.join(once, "h").select("k1", "k2", F.transform("places", lambda at: F.struct(at.alias("at"), spread(at).alias("salt"))).alias("at"))
    found = written(_buckets(_suffixes(docs, repeated, length, **of), length, **of))
    dropped(anchors, counts)
    del repeated
    released(docs.sparkSession)
    # Across the boundaries of buckets that share leading bytes: equal windows have equal fingerprints.
    open_ = found.filter("fp is not null")
    again = open_.groupBy("fp").agg(F.count("*").alias("c")).filter("c > 1").select("fp")
    across = open_.filter("s is not null").join(again, "fp", "left_semi").select("k1", "k2", "s", "e")
    all_ = found.filter("fp is null").select("k1", "k2", "s", "e").unionByName(across)
    return all_.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _of_words(text: bytes, spans: list) -> list[tuple[int, int]]:
    """The bytes of text from the first to the last word of each run in spans, which are ranges of the words as hashes."""
    if not spans:
        return []
    begins, ends = _words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    runs = ((s // WORD_BYTES, e // WORD_BYTES) for s, e in _merged(spans))
    return [(int(begins[a]), int(ends[b - 1])) for a, b in runs]


def deduplicated(docs: DataFrame, columns: list[str], length: int = 400, hot: int = HOT, as_text: bool = False, words: int = 0, words_stay: bool = False) -> DataFrame:
    """The columns of docs with data (the bytes left of text; as_text: a string without the halves of characters that were cut), n_bytes, n_removed, n_spans.

    Every byte covered by a string of `length` bytes that also starts elsewhere, in the same text or another, is removed; strings are judged
    on the input and never cross texts. With words, which is 13 or more, every run of so many words that is also found elsewhere is removed too, from its first
    word's first byte to its last word's last; white space tells words apart and is not compared (between two words of runs it goes with them), words are compared as 64-bit hashes. With words_stay
    such runs are not removed, but told: n_repeated, one column more, counts the bytes that strings or runs found elsewhere cover, removed ones included. Null texts are empty; texts shorter than `length` stay whole; rows with equal
    doc_id and text are copies of each other; an empty table gives no rows.
    """
    if words and words * WORD_BYTES < GRAM:
        raise ValueError(f"runs of {words} words are too short: {-(-GRAM // WORD_BYTES)} at least")
    docs = batched(docs)
    counts = ["n_bytes", "n_removed", "n_spans", *["n_repeated"] * words_stay]
    names = [*columns, "data", *counts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(columns)
        for batch in batches:
            data, sizes, gone, runs, repeated = [], [], [], [], []
            for text, spans, of_words in zip(batch.column(n), batch.column(n + 1), batch.column(n + 2)):
                text = text.as_py()
                told, said = ([(x["s"], x["e"]) for x in v.as_py() or []] for v in (spans, of_words))
                every = _merged(told + _of_words(text, said))
                merged = _merged(told) if words_stay else every
                repeated.append(sum(e - s for s, e in every))
                sizes.append(len(text))
                runs.append(len(merged))
                if merged:
                    ends = [0, *(e for _, e in merged)]
                    text = b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in merged), len(text)]))
                gone.append(sizes[-1] - len(text))
                data.append(text.decode("utf-8", "ignore") if as_text else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(data, pa.string() if as_text else pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs, repeated)[: len(counts)])], names=names)

    from pyspark.sql import types as T

    kind = "array<struct<s:int,e:int>>"
    spans = written(repeats(docs, length, hot)).withColumn("runs", F.lit(None).cast(kind))
    if words:
        released(docs.sparkSession)
        runs = written(repeats(docs, words * WORD_BYTES, hot, words=True))
        parts = spans, runs
        spans = spans.unionByName(runs.select("k1", "k2", F.lit(None).cast(kind).alias("spans"), F.col("spans").alias("runs")))
        spans = written(spans.groupBy("k1", "k2").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "runs"))))
        dropped(*parts)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_k1"), F.xxhash64(text).alias("_k2"), text.cast("binary").alias("_data"))
    # Texts that nothing is removed from stay where they are; only the others are shuffled.
    spans = spans.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    some, others = Keys(spans, ["_k1", "_k2"]).split(keyed)
    some = some.join(spans, ["_k1", "_k2"], "left").select(*columns, "_data", "spans", "runs")
    joined = others.select(*columns, "_data", *(F.lit(None).cast(kind).alias(c) for c in ("spans", "runs"))).unionByName(some)
    longs = [T.StructField(x, T.LongType()) for x in counts]
    return joined.mapInArrow(tidy(cut), T.StructType([*(docs.schema[c] for c in columns), T.StructField("data", T.StringType() if as_text else T.BinaryType()), *longs]))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's removal of 400-byte strings; n_repeated also counts runs of 50 words that occur elsewhere, which stay."""
    out = deduplicated(read(spark, sf_dir, "documents"), ["doc_id"], words=50, words_stay=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"), "n_repeated")
