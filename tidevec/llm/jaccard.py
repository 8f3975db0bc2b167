"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is folded into bits: each shingle flips the bit that its hash names, so shared
shingles cancel out and the Hamming distance of two sketches is at most the size of the symmetric
difference. Within a band of set sizes, a similarity of t bounds that difference by a number d; of d + 1 + s pieces of the sketch
at least s + 1 are then equal. Documents meet on equal pieces, and every pair so met is verified or already
connected, so no link that matters for the components is lost. Pieces without any flipped bit say nothing, and unrelated sets would
meet on them: a set names them only if it has more than s. Of a linked pair's s + 1 equal pieces one is then not empty, or both ends
have more than s empty ones and both name them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import Keys, components, small_enough
from .store import batched, dropped, read, released, written
from .texts import mixed, signed
from .workers import tidy

#: Bytes of piece keys that a bucket holds on average; a task sorts one bucket at a time.
BUCKET = 16 << 20
#: Bytes of a piece key that are shuffled.
KEY = 6
#: Documents, and bytes of their sketches, about, in a block of a large group that must be compared pair by pair, and the most documents in a group that is not large.
BLOCK, BLOCK_BYTES, FEW = 2048, 2 << 20, 48


def _shingler(width: int):
    """text -> sorted distinct 64-bit hashes of its shingles of `width` words; shorter texts are one shingle; no words, none."""
    import xxhash

    class Codes(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > 100_000:
                self.clear()
            code = self[word] = xxhash.xxh3_64_intdigest(word) - 2**63
            return code

    code_of = Codes().__getitem__
    odd = np.random.default_rng(31).integers(0, 2**64, width, np.uint64) | np.uint64(1)

    def shingles(text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        code = np.fromiter(map(code_of, words), np.int64, len(words)).view(np.uint64)
        n = len(code) - width + 1
        h = code[:n] * odd[0]
        for k in range(1, width):
            h += code[k : k + n] * odd[k]
        h = mixed(h)
        h.sort()
        return h[np.append(True, h[1:] != h[:-1])]

    return shingles


def bands(percent: int) -> tuple:
    """size -> its band; band -> the largest size in it. A set's partners are in its own band or a neighbouring one."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(tops[-1] * 100 // percent if tops[-1] * 100 // percent > tops[-1] else tops[-1] + 1)
    tops = np.array(tops, np.int64)
    return lambda n: int(np.searchsorted(tops, n)), lambda b: int(tops[b])


def difference(top: int, percent: int) -> int:
    """The symmetric difference of two sets of at most `top` elements each with a similarity of at least percent/100, at most: (1-t)/(1+t) of the sum of sizes."""
    return (100 - percent) * 2 * top // (100 + percent)


@lru_cache(None)
def spare(top: int, percent: int) -> int:
    """Pieces beyond d + 1 in a band: about as many as its smallest sets, those of the band below, leave empty, and five deviations more.

    In bands of very small sets, where more pieces would leave more of them empty, at most d + 3; this sets the cost only.
    """
    least, need, more = max(1, top * percent * percent // 10_000), difference(top, percent) + 1, 0
    for _ in range(4):
        empty = (need + more) * (1 - 1 / (need + more)) ** least
        more = min(math.ceil(empty + 5 * math.sqrt(empty)), need + 2)
    return more


def piece_keys(shingles: np.ndarray, band: int, top: int, percent: int, flips: np.ndarray | None = None) -> np.ndarray:
    """Keys of the d + 1 + s pieces of a set's parity sketch in a band: 64 bits for each piece, whose bit flips are folded by XOR. Empty ones only if more than s are.

    shingles are sorted hashes, so their upper halves name the pieces in order. flips: folds() of them, if at hand.
    """
    free = spare(top, percent)
    pieces = difference(top, percent) + 1 + free
    which = ((shingles >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    sums = folds(shingles) if flips is None else flips
    at = np.searchsorted(which, np.arange(pieces + 1, dtype=np.uint64))
    parity = sums[at[1:]] ^ sums[at[:-1]]
    keys = mixed(parity + np.arange(pieces, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((band + 1) * 0xC2B2AE3D27D4EB4F % 2**64))
    told = parity != 0
    return keys[told] if pieces - np.count_nonzero(told) <= free else keys


def folds(shingles: np.ndarray) -> np.ndarray:
    """Running XOR of what each shingle flips."""
    out = np.zeros(len(shingles) + 1, np.uint64)
    np.bitwise_xor.accumulate(mixed(shingles ^ np.uint64(0xA0761D6478BD642F)), out=out[1:])
    return out


def parity_bits(shingles: np.ndarray, words: int) -> np.ndarray:
    """The sketch itself, of 64 * words bits: for filtering pairs by Hamming distance."""
    h = mixed(shingles ^ np.uint64(0x8EBC6AF09C88C6E3))
    bit = (h >> np.uint64(32)) % np.uint64(64 * words)
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def _short(keys: np.ndarray) -> np.ndarray:
    """The upper KEY bytes of each key. Sets that meet on equal ones are verified, so keys that differ below cost a comparison and lose nothing."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY :])


def _long(short: bytes) -> np.ndarray:
    """The keys of _short(), with zeros below."""
    out = np.zeros((len(short) // KEY, 8), np.uint8)
    out[:, 8 - KEY :] = np.frombuffer(short, np.uint8).reshape(-1, KEY)
    return out.view("<u8").ravel().astype(np.uint64)


def _pieces(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """Two kinds of rows. With keys: bucket, keys, sigs: piece keys with their sets' signatures, packed by bucket; equal sets of a batch once.

    Without keys: doc_id, row (a hash of the text), n (size of the set), sig (a 64-bit hash of it, null if empty) and a bucket that means nothing.
    """
    import xxhash

    names = ["bucket", "keys", "sigs", "doc_id", "row", "n", "sig"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (band_of, top_of) = _shingler(width), bands(percent)
        for batch in batches:
            keys, sigs, done, sizes, own_sigs = [], [], set(), [], []
            for t in batch.column(2):
                s = shingles(t.as_py() or b"")
                sizes.append(len(s))
                if not len(s):
                    own_sigs.append(None)
                    continue
                sig = xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63
                own_sigs.append(sig)
                if sig in done:
                    continue
                done.add(sig)
                own, flips = band_of(len(s)), folds(s)
                for band in (own, own + 1):  # the larger set of a pair is in its own band or in the next
                    k = piece_keys(s, band, top_of(band), percent, flips)
                    keys.append(k)
                    sigs.append(np.full(len(k), sig, np.int64))
            rows = batch.num_rows
            spread = np.arange(rows, dtype=np.int64) * 7919 % buckets
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.binary()), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(own_sigs, pa.int64())], names=names)
            if not keys:
                continue
            key, sig = np.concatenate(keys), np.concatenate(sigs)
            bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            key, sig, bucket = key[order], sig[order], bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            for at in range(0, len(cuts) - 1, 5000):
                part = cuts[at : at + 5001]
                offsets = lambda size: pa.array(((part - part[0]) * size).astype(np.int32)).buffers()[1]  # noqa: E731, B023
                pack = lambda x, size: pa.BinaryArray.from_buffers(pa.binary(), len(part) - 1, [None, offsets(size), pa.py_buffer(x[part[0] : part[-1]].tobytes())])  # noqa: E731, B023
                empty = pa.nulls(len(part) - 1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[part[:-1]].astype(np.int64)), pack(_short(key), KEY), pack(sig, 8), empty, empty, empty, empty], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(cut), "bucket long, keys binary, sigs binary, doc_id long, row long, n long, sig long")


def _groups(pieces: DataFrame, buckets: int, chunk: int = 4 << 20) -> DataFrame:
    """gid, sig: signatures that meet on a piece, each set of them once per bucket; and the rows doc_id, row, n, sig of pieces as they are, with a null gid.

    A bucket that a hot key makes longer than `chunk` keys is worked off in chunks, each of which also holds one
    signature of every key before it; its groups are then numbered by key, so a key's members share a gid.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(key: np.ndarray, sig: np.ndarray, by_key: bool) -> tuple:
            """What is left of (key, sig) without repeats, and the groups of two and more as (gid, sig)."""
            order = np.lexsort((sig, key))
            key, sig = key[order], sig[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
            key, sig = key[new], sig[new]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            many = np.flatnonzero(sizes > 1)
            if by_key:
                gid = key[starts]
            else:
                gid = np.bitwise_xor.reduceat(mixed(sig.view(np.uint64) ^ np.uint64(0xE7037ED1A0B428DB)), starts) if len(starts) else key
                many = many[np.unique(gid[many], return_index=True)[1]]
            take = np.repeat(starts[many], sizes[many]) + np.arange(sizes[many].sum()) - np.repeat(np.cumsum(sizes[many]) - sizes[many], sizes[many])
            return key, sig, starts, np.repeat(gid[many], sizes[many]), sig[take]

        def out(gid: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(gid), 100_000):
                g, m = signed(np.ascontiguousarray(gid[at : at + 100_000])), sig[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(m), *[pa.nulls(len(g), pa.int64())] * 3], names=["gid", "sig", "doc_id", "row", "n"])

        def flush(keys: list, sigs: list, full: bool, rest: list) -> Iterator[pa.RecordBatch]:
            """One chunk of a bucket. rest holds, for the chunks before, one (key, sig) of each key: what later chunks link to."""
            key, sig, starts, gid, member = groups(np.concatenate([*keys, *rest[:1]]), np.concatenate([*sigs, *rest[1:]]), full or bool(rest))
            rest[:] = [key[starts], sig[starts]]
            yield from out(gid, member)

        bucket, keys, sigs, size, rest = None, [], [], 0, []
        for batch in batches:
            plain = batch.filter(pc.is_null(batch.column("keys")))
            yield pa.RecordBatch.from_arrays([pa.nulls(plain.num_rows, pa.int64()), *(plain.column(c) for c in ("sig", "doc_id", "row", "n"))], names=["gid", "sig", "doc_id", "row", "n"])
            batch = batch.filter(pc.is_valid(batch.column("keys")))
            for b, k, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != bucket or size >= chunk:
                    if keys:
                        yield from flush(keys, sigs, b == bucket, rest)
                    keys, sigs, size = [], [], 0
                    if b != bucket:
                        bucket, rest = b, []
                keys.append(_long(k.as_py()))
                sigs.append(np.frombuffer(s.as_py(), np.int64))
                size += len(keys[-1])
        if keys:
            yield from flush(keys, sigs, False, rest)

    return pieces.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), "gid long, sig long, doc_id long, row long, n long")


def _sets(docs: DataFrame, width: int, texts: bool = False) -> DataFrame:
    """sig, n and sketch (2 to 4 bits per shingle, 256 at least), or text, of the texts of docs that have words. Texts travel rather than hashes, since they compress."""
    import xxhash

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _shingler(width)
        for batch in batches:
            sets = [shingles(t.as_py() or b"") for t in batch.column(0)]
            some = [i for i, x in enumerate(sets) if len(x)]
            sets = [sets[i] for i in some]
            sigs = [xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 for x in sets]
            last = batch.column(0).take(pa.array(some, pa.int64())) if texts else pa.array([parity_bits(x, 1 << max(2, math.ceil(math.log2(len(x) / 32)))).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), last], names=["sig", "n", name])

    name = "text" if texts else "sketch"
    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(tidy(build), f"sig long, n long, {name} binary")


def _found(docs: DataFrame, one: DataFrame, sigs: DataFrame) -> DataFrame:
    """The texts of docs, one of each of the sets sigs (a written table) at least: found by doc_id (one: sig, id) where there is one. A bitmap of ids lets
    some others through: join the sets. No text is shuffled, however many ids there are."""
    ids = written(one.filter("id is not null").join(small_enough(sigs), "sig", "left_semi").select("id").distinct())
    named, _ = Keys(ids, ["id"]).split(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text"))
    return named.select("text").unionByName(docs.filter("doc_id is null").select("text"))


def _verified(pairs: DataFrame, docs: DataFrame, one: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b: a written table) whose sets are at least percent/100 alike. Only texts of sets among them are read again, so few move where few pairs are left."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, p = _shingler(width), None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, p = a, shingles(x.as_py())
                q = shingles(y.as_py())
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            keep = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    sigs = written(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct())
    sets = written(_sets(_found(docs, one, sigs), width, texts=True).join(small_enough(sigs), "sig", "left_semi").dropDuplicates(["sig"]))
    side = lambda name: sets.select(F.col("sig").alias(name), F.col("n").alias(f"n{name}"), F.col("text").alias(f"s{name}"))
    # The member first: of the two ends, it is the one that is not shared by many pairs.
    joined = pairs.join(side("b"), "b").join(side("a"), "a").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    out = written(joined.select("a", "b", "sa", "sb").mapInArrow(tidy(check), "a long, b long"))
    dropped(sigs, sets)
    return out


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and the Hamming distance of sketches do not rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n, x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4))):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                while len(q) > len(p):  # a wide sketch's halves, folded by XOR, are the narrower sketch
                    q = q[: len(q) // 2] ^ q[len(q) // 2 :]
                if int(np.bitwise_count(p ^ q).sum()) * (100 + percent) <= (100 - percent) * n:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    side = lambda name: sets.select(F.col("sig").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").filter(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return joined.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "sa", "sb").mapInArrow(tidy(check), "a long, b long")


def _stars(members: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of one member, by a seeded hash, of each component in a group with one of the group's first component."""
    h = F.xxhash64(F.lit(seed), "sig")
    one = members.groupBy("gid", "root").agg(F.min(F.struct(h.alias("h"), "sig")).alias("m"))
    low = one.groupBy("gid").agg(F.min("m").alias("low"))
    pairs = one.join(low, "gid").select(F.col("m.sig").alias("x"), F.col("low.sig").alias("y")).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(members: DataFrame) -> DataFrame:
    """All pairs (a, b) of members of different components in groups of at most FEW."""
    lists = members.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("sig", "root"))).alias("m"))
    pairs = F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> y.root <> x.root), y -> struct(x.sig as a, y.sig as b))))")
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components (root) whose sketches and sizes allow a link: all such pairs of a group are among them.

    members: gid, sig, root and c, the size of the group. Near copies share many groups, so each set is taken once, into its largest one, its home; homes of
    which a group has members are compared, block by block. sets: sig, n and wide, the sketch; rows that it lacks are left out.
    """
    at_home = members.withColumn("home", F.max(F.struct("c", "gid")).over(Window.partitionBy("sig"))["gid"])
    at_home = written(at_home.select("gid", "home", "sig", "root"))
    met = at_home.groupBy("gid").agg(F.sort_array(F.collect_set("home")).alias("homes")).select("homes").distinct()
    pairs = F.expr("flatten(transform(homes, (x, k) -> transform(slice(homes, k + 1, size(homes)), y -> struct(x as h, y as g))))")
    met = met.select(F.explode(pairs).alias("p")).select("p.h", "p.g").distinct()
    rows = at_home.select("home", "sig", "root").distinct().join(sets.select("sig", "n", F.col("wide").alias("sketch")), "sig")
    sizes = at_home.select("home", "sig").distinct().join(sets.select("sig", F.octet_length("wide").alias("bytes")), "sig")
    sizes = sizes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(7), "sig"), F.col("blocks")).cast("long")
    blocks = written(rows.join(sizes, "home").withColumn("block", block).groupBy("home", "block").agg(F.collect_list(F.struct("sig", "root", "n", "sketch")).alias("rows")))
    left, right = blocks.select(F.col("home").alias("h"), F.col("block").alias("i"), F.col("rows").alias("x")), blocks.select(F.col("home").alias("g"), F.col("block").alias("j"), F.col("rows").alias("y"))
    met = met.join(left, "h").join(right, "g").filter("h <> g or i <= j").select("x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(rows: pa.ListScalar) -> dict:
            r = rows.values
            return {c: r.field(c).to_numpy(zero_copy_only=False) for c in ("sig", "root", "n")} | {"bits": [np.frombuffer(b, np.uint64) for b in r.field("sketch").to_pylist()]}

        def by_width(x: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            widths = np.array([len(b) for b in x["bits"]])
            for w in np.unique(widths):
                rows = np.flatnonzero(widths == w)
                yield rows, np.stack([x["bits"][i] for i in rows])

        def narrow(bits: np.ndarray, width: int) -> np.ndarray:
            """A wide sketch's halves, folded by XOR, are the narrower sketch."""
            while bits.shape[1] > width:
                bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
            return bits

        for batch in batches:
            for p, q in zip(batch.column(0), batch.column(1)):
                x, y = columns(p), columns(q)
                for rx, bx in by_width(x):
                    for ry, by in by_width(y):
                        width = min(bx.shape[1], by.shape[1])
                        u, v = narrow(bx, width), narrow(by, width)
                        n, root, sig = y["n"][ry], y["root"][ry], y["sig"][ry]
                        for i, bits in zip(rx.tolist(), u):
                            own = x["n"][i]
                            ok = (x["root"][i] != root) & (100 * np.minimum(own, n) >= percent * np.maximum(own, n))
                            if not ok.any():
                                continue
                            ok &= np.bitwise_count(v ^ bits).sum(axis=1) * (100 + percent) <= (100 - percent) * (own + n)
                            hit = sig[ok]
                            if len(hit):
                                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(hit, x["sig"][i])), pa.array(np.maximum(hit, x["sig"][i]))], names=["a", "b"])

    return met.mapInArrow(tidy(compare), "a long, b long").distinct()


def grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row (xxhash64 of the text), n_shingles and root (a number of its component; null without words) per row.

    A component holds what links of a Jaccard similarity of percent/100 or more reach; which pairs link is not told, as pairs
    whose ends are connected already are not compared. Equal sets are one node, so copies never meet pairwise. Other
    columns than doc_id and text are not read; an empty table gives no rows.
    """
    docs = batched(docs.select("doc_id", "text"))
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = size / 6 * 2 * 1.2 * 2 * (100 - percent) / (100 + percent)  # of words of five bytes; only the size of buckets hangs on it
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(16 * pieces / BUCKET))
    met = written(_groups(_pieces(docs, width, percent, buckets), buckets))
    released(spark)
    rows = written(met.filter("gid is null").select("doc_id", "row", "n", "sig"))
    groups = written(met.filter("gid is not null").select("gid", "sig").distinct())
    dropped(met)
    involved = written(groups.select("sig").distinct())
    # One row of each set that met another: its text is read again, found by doc_id where there is one.
    one = written(rows.filter("sig is not null").join(small_enough(involved), "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("id")))
    sets = written(_sets(_found(docs, one, involved), width).join(small_enough(involved), "sig", "left_semi").dropDuplicates(["sig"]))
    released(spark)
    # First one pair for each set, with the smallest that it meets; what they do not connect is compared across components.
    low = groups.groupBy("gid").agg(F.min("sig").alias("a"))
    stars = groups.join(low, "gid").filter("a <> sig").groupBy(F.col("sig").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    stars = written(_possible(stars, sets, percent))
    links = _verified(stars, docs, one, width, percent)
    del low
    released(spark)
    roots = written(components(links))
    failed, made = None, [links, stars]
    for step in (1, 2, 0):
        members = groups.join(roots, groups["sig"] == roots["node"], "left").select("gid", "sig", F.coalesce("root", "sig").alias("root"))
        state = members.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).filter("lo <> hi").select("gid", "c")
        rest = written(members.join(state, "gid"))
        if step:
            tried = _possible(_stars(rest, step), sets, percent)
        else:  # whatever is still in several components is compared pair by pair
            tried = _possible(_apart(rest.filter(F.col("c") <= FEW)), sets, percent).unionByName(_across(rest.filter(F.col("c") > FEW), sets.withColumnRenamed("sketch", "wide"), percent)).distinct()
        tried = written(tried if failed is None else tried.join(failed, ["a", "b"], "left_anti"))
        more = _verified(tried, docs, one, width, percent) if tried.limit(1).count() else tried
        if more.limit(1).count():
            links = links.unionByName(more)
            roots = written(components(links))
        out = tried.join(more, ["a", "b"], "left_anti")
        failed = out if failed is None else failed.unionByName(out)
        made += [tried] if more is tried else [tried, more]
        dropped(rest)
        del members, state, out
        released(spark)
    dropped(*made, groups, involved, one, sets)
    return rows.join(roots, rows["sig"] == roots["node"], "left").select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("root", "sig").alias("root"))


def linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of its component, see grouped()) per row.

    Texts without words, null or empty, have an empty set and link with nothing: component_id is their doc_id. Rows with
    a null doc_id link like others but name no component.
    """
    set_of = grouped(docs, width, percent)
    least = set_of.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return set_of.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(read(spark, sf_dir, "documents"), width=4, percent=85)
