"""Small fixtures against brute force; each holds nulls, empty texts, repeats and an extra column."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidevec.llm import jaccard, langid, mixing, packing, quality, rules, sharding, suffixes, toxicity, vectors
from tidevec.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(rnd.randint(2, 7)))
    passage = " ".join(word() for _ in range(110))
    rows = []
    for i in range(60):
        words = [word() for _ in range(rnd.randint(60, 160))]
        text = " ".join(words) + (" " + passage + " " if i % 7 == 0 else "") + " ".join(word() for _ in range(20))
        rows.append((i, text))
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(200 + i, rows[i][1].replace("a", "A", 1) + f" tail{i}") for i in range(5)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "aé" * 700), (None, rows[0][1]), (304, "be be be " * 90), (305, "one two"), (305, "one two")]
    return spark.createDataFrame([(a, t, "en", f"s{(a or 0) % 3}" if a != 301 else None, len(t) if t else None, "x") for a, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    low = (text or "").encode().lower().split()
    return {tuple(low[i : i + k]) for i in range(max(1, len(low) - k + 1))} if low else set()


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, empty, width, percent):
    rows = docs.collect()
    sets = [shingles(r.text, width) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    want = sorted((repr(r.doc_id), len(sets[i]), least[root(i)]) for i, r in enumerate(rows))
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.linked(docs, width, percent).collect()) == want
    assert jaccard.linked(empty, width, percent).count() == 0


def test_large_groups_that_overlap_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = {sig: np.unique(np.concatenate([base[rng.random(200) < 0.97], rng.integers(0, 2**63, 4).astype(np.uint64)])) for sig in range(-20, 20)}
    root = {sig: sig // 2 for sig in sets}
    sketch = {sig: jaccard.parity_bits(x, 8 if sig % 3 else 16) for sig, x in sets.items()}
    groups = {gid * 97 - 1500: [sig for sig in sets if rng.random() < 0.5] for gid in range(40)}
    rows = [(gid, sig, root[sig], len(sigs)) for gid, sigs in groups.items() for sig in sigs]
    told = spark.createDataFrame([(sig, len(x), sketch[sig].tobytes()) for sig, x in sets.items()], "sig long, n long, wide binary")

    def possible(a, b):
        p, q = sorted((sketch[a], sketch[b]), key=len)
        q = q if len(p) == len(q) else q[: len(p)] ^ q[len(p) :]
        n = len(sets[a]), len(sets[b])
        return 100 * min(n) >= 80 * max(n) and int(np.bitwise_count(p ^ q).sum()) * 180 <= 20 * sum(n)

    want = {(a, b) for sigs in groups.values() for a in sigs for b in sigs if a < b and root[a] != root[b] and possible(a, b)}
    size = jaccard.BLOCK
    for jaccard.BLOCK in (5, size):
        got = list(map(tuple, jaccard._across(spark.createDataFrame(rows, "gid long, sig long, root long, c long"), told, 80).collect()))
        assert want and want <= set(got) and len(set(got)) == len(got) and all(a < b and root[a] != root[b] and possible(a, b) for a, b in got)


def test_parity_sketch_bounds_the_difference():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 2**64, 200, np.uint64))
    b = np.unique(np.concatenate([a[10:], rnd.integers(0, 2**64, 12, np.uint64)]))
    x, y = jaccard.parity_bits(a, 16), jaccard.parity_bits(b, 16)
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert len(np.intersect1d(jaccard.piece_keys(a, 9, 210, 80), jaccard.piece_keys(b, 9, 210, 80)))


def test_linked_sets_share_a_key_and_unrelated_ones_of_a_size_do_not():
    rnd = np.random.default_rng(2)
    new = lambda n: rnd.integers(0, 2**64, n, np.uint64)
    for percent in (80, 85):
        band_of, top_of = jaccard.bands(percent)
        keys = lambda x, band: jaccard.piece_keys(x, band, top_of(band), percent)
        for n in [*range(1, 60), 300, 1000] * 4:
            a = np.unique(new(n))
            drop = int(rnd.integers(0, (100 - percent) * n // 100 + 1))
            add = max(0, (100 * (n - drop)) // percent - n)  # the most that leaves them linked
            b = np.unique(np.concatenate([a[drop:], new(int(rnd.integers(0, add + 1)))]))
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                bands = [{x, x + 1} for x in (band_of(len(a)), band_of(len(b)))]
                assert any(len(np.intersect1d(keys(a, x), keys(b, x))) for x in bands[0] & bands[1])
        some = [np.unique(new(n)) for n in (200,) * 400]
        got = np.concatenate([np.unique(keys(x, band)) for x in some for band in (band_of(len(x)), band_of(len(x)) + 1)])
        assert len(np.unique(got)) == len(got)


@pytest.mark.parametrize("hot", [50_000, 2])
def test_suffixes(docs, empty, hot):
    turns = [(701, "repeat('round and ', 400)"), (702, "concat('x', repeat('round and ', 300), 'once')"), (703, "repeat('0', 1300)"), (704, "repeat('0', 400)")]
    for i, text in turns:  # texts that repeat themselves
        docs = docs.unionByName(docs.filter("doc_id = 0").selectExpr(f"{i} as doc_id", f"{text} as text", "lang", "source", "n_chars", "score"))
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 399):
            seen.setdefault(t[p : p + 400], []).append((i, p))
    marks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        for i, p in places if len(places) > 1 else []:
            marks[i][p : p + 400] = True
    want = sorted((repr(r.doc_id), len(t), int(m.sum()), int((np.diff(np.append(0, m)) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()) for r, t, m in zip(rows, texts, marks))
    got = suffixes.deduplicated(docs, ["doc_id"], hot=hot).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.data).hexdigest()) for r in got) == want
    assert suffixes.deduplicated(empty, ["doc_id"]).count() == 0


def test_multikey_quicksort():
    keys = np.random.default_rng(2).integers(0, 2, (300, 21), np.uint8)
    order, prefix = suffixes.multikey_quicksort(keys)
    rows = [bytes(keys[i]) for i in order]
    assert rows == sorted(rows)
    for i in range(1, len(rows)):
        same = next((k for k in range(21) if rows[i][k] != rows[i - 1][k]), 21)
        assert prefix[i] == same


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.vocabulary("byte_bpe_50k.json"))
    docs = docs.unionByName(docs.filter("doc_id = 0").selectExpr("700 as doc_id", "'a <|endoftext|> b<|endoftext|>' as text", "lang", "source", "n_chars", "score"))
    assert 50256 in slow.encode("a <|endoftext|> b", add_special_tokens=False).ids
    want = {}
    for r in docs.collect():
        ids = slow.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id] = ids
    rows = packing.pack_documents(docs).collect()
    by = {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(len(want[r.doc_id]) for r in docs.collect())
    assert packing.pack_documents(empty).count() == 0


def test_first_fit_decreasing_is_first_fit():
    lengths = np.random.default_rng(3).integers(1, 1025, 300)
    bins, _ = packing.first_fit_decreasing(lengths, 1024)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        b = next((b for b, free in enumerate(room) if free >= lengths[i]), len(room))
        if b == len(room):
            room.append(1024)
        room[b] -= lengths[i]
        want[i] = b
    assert bins.tolist() == [want[i] for i in range(300)]


def test_mixing(docs, empty):
    assert mixing.targets({"a": 10, "b": 100, None: 0}) == {"a": 20.0, "b": 145.0, None: 0.0}
    # overlapping sources: the shared pattern serves whichever quota is short, and first copies go before second ones
    assert mixing.routed([(("a",), 10), (("a", "b"), 10), (("b",), 10)], {"a": 15, "b": 15}, 2) == [10, 10, 10]
    rows = mixing.sized(docs)
    plan = mixing.mix(rows, mixing.source_targets(rows)[1])
    got = mixing.taken(rows, plan).collect()
    assert len(got) == docs.count() and all(0 <= r.copies <= 2 for r in got)
    again = mixing.taken(rows, plan).select("row.doc_id", "copies").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixing.taken(rows, mixing.mix(rows, mixing.source_targets(rows)[1])).select("row.doc_id", "copies").collect())
    assert mixing.mixed_documents(empty).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shuffled_into_shards(docs.select("doc_id", "text"), 7, cell_rows=3).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(x) for x in slots.values()]
    assert len(rows) == docs.count() and max(sizes) - min(sizes) <= 1
    rng = np.random.default_rng(4)
    for good, bad, draws in ((7, 9, 6), (50, 3, 20), (1, 1000, 3)):
        got, want = ([f(good, bad, draws) for _ in range(20_000)] for f in (lambda *x: sharding._hypergeometric(rng, *x), rng.hypergeometric))
        assert np.abs(np.bincount(got, minlength=draws + 1) - np.bincount(want, minlength=draws + 1)).max() < 500
    big = np.array([sharding._hypergeometric(rng, 10**11, 15 * 10**11, 4 * 10**8) for _ in range(300)])
    mean, deviation = 4e8 / 16, (4e8 / 16 * 15 / 16 * (1 - 4e8 / 16e11)) ** 0.5
    assert abs(big.mean() - mean) < deviation / 3 and abs(big.std() / deviation - 1) < 0.2
    m = sharding.communication_matrix([5, 0, 20, 8], 3, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 20, 8] and m.sum(axis=0).tolist() == [11, 11, 11]
    assert sharding.shuffled_into_shards(empty.select("doc_id")).count() == 0


def test_rules(docs, empty):
    for r, t in zip(rules.features(docs).collect(), [x.text or "" for x in docs.collect()]):
        words = t.encode().split()
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(hit), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(w.decode()) for w in words)
    out = rules.scored_documents(docs)
    assert out.count() == docs.count() and out.filter("base_failed and kept").count() == 0
    assert rules.scored_documents(empty).count() == 0


def test_models(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 9 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for out in (quality.scored(docs, quality.trained(docs, labels), ["doc_id"]), toxicity.scored(docs, toxicity.trained(docs, labels)), langid.identified(docs, langid.profiles(docs))):
        rows = out.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    und = {r.doc_id: r.lang_pred for r in langid.identified(docs, langid.profiles(docs)).collect()}
    assert und[300] == und[302] == "und" and und[5] == "en"
    assert quality.scored(empty, quality.trained(empty, labels.limit(0)), ["doc_id"]).count() == 0
    assert toxicity.scored(empty, toxicity.trained(empty, labels)).count() == 0
    assert langid.identified(docs, {}).filter("lang_pred <> 'und'").count() == 0


def test_field_marginals_match_enumeration():
    rnd = np.random.default_rng(5)
    f = toxicity.Field({}, rnd.normal(size=3), -0.3, rnd.normal(size=(2, 2)))
    x = rnd.integers(0, 3, 9)
    weight = np.zeros(9)
    total = 0.0
    for tags in np.ndindex(*[2] * 9):
        s = sum(f.odds[x[i]] for i in range(9) if tags[i]) + f.start * tags[0] + sum(f.moves[a, b] for a, b in zip(tags, tags[1:]))
        total += np.exp(s)
        weight += np.exp(s) * np.array(tags)
    for chunk in (4, 128):
        toxicity.CHUNK, old = chunk, toxicity.CHUNK
        got, _, _ = f.marginals(np.concatenate([x, x[:2]]), np.array([9, 0, 2]))
        toxicity.CHUNK = old
        assert np.allclose(got[:9], weight / total)


def test_machine_identity():
    rnd = np.random.default_rng(6)
    m = quality.Machine(0.1, rnd.normal(size=quality.WIDTH), rnd.normal(size=(quality.WIDTH, 3)))
    s, x = np.array([3, 9, 40]), np.array([0.5, 1.0, 2.0])
    pairs = sum(m.factors[s[i]] @ m.factors[s[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert np.isclose(m.logits(s, x, np.array([0]))[0], 0.1 + m.weights[s] @ x + pairs)


def test_vectors(spark):
    rnd = np.random.default_rng(7)
    rows = []
    for i in range(150):
        base = rnd.normal(size=8) if i % 5 else np.ones(8)
        rows.append((i, (base + rnd.normal(size=8) * 0.02).tolist(), i % 2))
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [1.0] * 8, None), (904, [], 1), (905, rows[0][1], 0), (905, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [r for r in rows if r[1] and r[2] is not None and np.isfinite(r[1]).all() and np.any(r[1])]
    want = {}
    for i, v, y in ok:
        want[i] = sum(1 for _, w, z in ok if z == y and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93) - 1
    for block in (4096, 10):
        vectors._counted.__defaults__ = (block,)
        got = vectors.near_vectors(df).collect()
        assert len(got) == len(rows)
        assert all(r.n_links == want.get(r.vec_id, 0) for r in got)
    vectors._counted.__defaults__ = (vectors.BLOCK,)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def cone(rows, narrow, seed=5):
    """Vectors of 64 numbers at a cosine of about `narrow` to each other; each odd one is at 0.94 to the even one before."""
    rnd = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    axis = unit(rnd.normal(size=64))
    x = unit(np.sqrt(narrow) * axis + np.sqrt(1 - narrow) * unit(rnd.normal(size=(rows // 2, 64))))
    side = rnd.normal(size=x.shape)
    side = unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    return np.stack([x, 0.94 * x + np.sqrt(1 - 0.94**2) * side], axis=1).reshape(-1, 64)


@pytest.mark.parametrize("narrow, work", [(0.85, vectors.PASS), (0.0, 640)])
def test_recall_does_not_depend_on_where_a_label_lies(spark, narrow, work):
    x = cone(6000, narrow)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").selectExpr("*", "1 as label")
    got = {r.vec_id: r.component_id for r in vectors.near_vectors(df, work=work).collect()}
    pairs = np.argwhere(np.triu(x @ x.T >= 0.93, 1)).tolist()
    assert len(pairs) >= 3000
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)


def test_plan_compares_all_only_where_projections_do_not_part():
    assert vectors.plan(10**6, np.full(9, 0.9), 0.93, 0.02, 1000) == (0, 1)
    bits, passes = vectors.plan(10**6, np.full(9, 0.5), 0.93, 0.02, 1000)
    assert bits > 1 and (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** passes <= 0.02


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {95: 90, 100: 90}
