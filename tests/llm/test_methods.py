"""Methods against brute force, simulations and held-out rows; columns whose names clash; the pipeline's stages."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidevec.llm import langid, mixing, packing, quality, rules, sharding, store, suffixes, toxicity

CLASH = ["y", "size", "h", "copy", "copies", "members", "y_id", "row", "last", "block"]


@pytest.fixture(scope="module")
def clashing(spark):
    rnd = random.Random(8)
    words = {"aa": ["ka", "lo", "mi", "tau"], "bb": ["zer", "qux", "wyn"]}
    rows = [(i, " ".join(rnd.choice(words["aa" if i % 2 else "bb"]) for _ in range(60 + i % 7)), "aa" if i % 2 else "bb", f"s{i % 3}", 9, *["x"] * len(CLASH)) for i in range(90)]
    rows += [(None, None, None, None, None, *[None] * len(CLASH)), (500, "", "aa", "s0", 0, *["x"] * len(CLASH))] + [rows[4]] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASH))


def test_expectation_maximisation_finds_kinds_and_a_noisy_rule_loses_its_weight():
    rng = np.random.default_rng(3)
    n, patterns = 40_000, Counter()
    kind = rng.choice(3, n, p=[0.85, 0.1, 0.05])
    chance = np.array([[0.01, 0.02, 0.03, 0.01, 0.01, 0.01, 0.2], [0.7, 0.6, 0.5, 0.01, 0.01, 0.02, 0.2], [0.01, 0.02, 0.03, 0.8, 0.9, 0.6, 0.2]])
    bad = rng.random((n, 7)) < chance[kind]
    silent = rng.random((n, 7)) < 0.2
    votes = [tuple(None if s else int(not b) for b, s in zip(x, y)) for x, y in zip(bad.tolist(), silent.tolist())]
    patterns.update(votes)
    got = rules.accuracies(patterns, 7)
    assert len(got.shares) == 3 and abs(got.shares[0] - 0.85) < 0.02
    at = [0, int(got.bad[1:, 0].argmax()) + 1, int(got.bad[1:, 3].argmax()) + 1]
    assert np.abs(got.bad[at] - chance).max() < 0.05
    quality_ = got.posterior([(1, 1, 1, 1, 1, 1, 0), (0, 0, 1, 1, 1, 1, 1), (1, 1, None, 0, 0, 1, None), (None,) * 7])
    assert quality_[0] > 0.98 and quality_[1] < 0.1 and quality_[2] < 0.02 and 0.8 < quality_[3] < 0.9
    assert np.mean((got.posterior(votes) >= 0.5) == (kind == 0)) > 0.95
    assert rules.accuracies({}, 7).posterior([(None,) * 7])[0] > 0.5


def test_columns_that_clash(spark, clashing):
    labels = spark.createDataFrame([(i, i % 2, int(i % 9 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    n = clashing.count()
    assert quality.scored(clashing, quality.trained(clashing, labels), ["doc_id"]).count() == n
    assert toxicity.scored(clashing, toxicity.trained(clashing, labels)).count() == n
    assert langid.identified(clashing, langid.profiles(clashing)).count() == n
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns and mixed.filter("copy is null or copy = 'x'").count() == mixed.count() > 0
    out = suffixes.deduplicated(clashing, ["doc_id", *[c for c in CLASH if c != "size"]], as_text=True)
    assert out.count() == n
    assert sharding.shuffled_into_shards(clashing.drop("block", "row"), 3).count() == n
    assert packing.pack_documents(clashing).count() == n
    assert rules.scored_documents(clashing).count() == n


def test_language_profiles_and_distances(clashing):
    known = langid.profiles(clashing, top=20)
    texts = {y: [r.text for r in clashing.collect() if r.lang == y and r.text and r.doc_id is not None and store_fold(r.doc_id, 3) != 1] for y in ("aa", "bb")}

    def grams(text):
        w = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        joined = " " + " ".join(w) + " "
        return Counter(g for k in (1, 2, 3) for i in range(len(joined) - k + 1) if (g := joined[i : i + k]).strip() and not (k == 1 and g == " "))

    def ranks(counts, top=20):
        code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return [code(g) for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:top]]

    want = {y: ranks(sum((grams(t) for t in ts), Counter())) for y, ts in texts.items()}
    assert {y: g.tolist() for y, g in known.items()} == want
    for r in langid.identified(clashing, known, top=20).join(clashing.select("doc_id", "text"), "doc_id").collect():
        if not r.text:
            assert r.lang_pred == "und"
            continue
        own = ranks(grams(r.text))
        far = {y: sum(min(20, abs(i - want[y].index(g))) if g in want[y] else 20 for i, g in enumerate(own)) for y in want}
        best = min(sorted(far), key=far.get)
        assert (r.lang_pred, round(r.score, 9)) == (best, round(1 - far[best] / (20 * len(own)), 9))


def store_fold(doc_id, buckets):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % buckets


def test_language_sample_is_the_first_by_hash(spark):
    df = spark.createDataFrame([("aa", (i * 2654435761 % 2**32 - 2**31) << 32 | i) for i in range(3000)] + [("bb", -5), ("bb", 7)], "lang string, h long")
    unsigned = sorted(h % 2**64 for y, h in df.collect() if y == "aa")
    got = {r.lang: r["last"] for r in langid._first(df, 100).collect()}
    assert got == {"aa": unsigned[99] >> 40}


def test_flow_is_a_minimum():
    rnd = random.Random(1)
    for _ in range(60):
        sources = "abc"[: rnd.randint(1, 3)]
        patterns = [(tuple(sorted(rnd.sample(sources, rnd.randint(1, len(sources))))), rnd.randint(1, 3)) for _ in range(rnd.randint(1, 3))]
        patterns = list(dict(patterns).items())
        quota = {s: rnd.randint(0, 5) for s in sources}

        def feasible(take):
            # by Hall's theorem: every set of patterns must fit into the quotas of the sources it reaches
            some = range(len(patterns))
            return all(sum(take[i] for i in pick) <= sum(quota[s] for s in {s for i in pick for s in patterns[i][0]}) for k in range(1, len(patterns) + 1) for pick in itertools.combinations(some, k))

        cost = lambda take: sum(c * min(max(t - (c - 1) * w, 0), w) for t, (_, w) in zip(take, patterns) for c in (1, 2))
        every = [t for t in itertools.product(*[range(2 * w + 1) for _, w in patterns]) if feasible(t)]
        most = max(map(sum, every))
        got = mixing.routed(patterns, quota, 2)
        assert feasible(got) and sum(got) == most and cost(got) == min(cost(t) for t in every if sum(t) == most)


def test_mix_comes_near_its_targets(spark):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rnd.randint(1, 30), rnd.choice(["a", "b", "b", "b", None])) for i in range(3000)], "doc_id long, text string, source string")
    rows = store.written(mixing.sized(docs))
    sizes, want = mixing.source_targets(rows)
    got = mixing.taken(rows, mixing.mix(rows, want)).selectExpr("row.source", "copies * size as n").groupBy("source").sum("n").collect()
    assert sum(sizes.values()) * 1.5 == pytest.approx(sum(want.values()))
    for source, n in got:
        assert abs(n - want[source]) <= 30


def test_models_on_held_out_rows(spark):
    rnd = random.Random(5)
    clean, foul = [f"word{i}" for i in range(300)], ["vile", "scum", "rotten"]
    rows, labels = [], []
    for i in range(1500):
        words = [rnd.choice(clean) for _ in range(rnd.randint(20, 80))]
        toxic, junk = i % 5 == 0, i % 3 == 0
        if toxic:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(foul) for _ in range(3)]
        if junk:
            words = [w for w in words for _ in (0, 1)]
        rows.append((i, " ".join(words), len(words)))
        labels.append((i, int(not junk), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(4)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    got = quality.scored(docs, quality.trained(docs, told), ["doc_id"]).collect()
    held = [r for r in got if store_fold(r.doc_id, 5) == 0]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id][0] for r in held]) > 0.97
    got = toxicity.scored(docs, toxicity.trained(docs, told)).collect()
    held = [r for r in got if store_fold(r.doc_id, 4) == 2]
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id][1] for r in held]) > 0.97
    texts = {i: t for i, t, _ in rows}
    found = [(x.start, x.end, texts[r.doc_id]) for r in held if truth[r.doc_id][1] for x in r.spans]
    assert found and all(set(t[a:b].split()) <= set(foul) for a, b, t in found)
    # a bound on the bytes of the sample takes fewer rows, in the same order
    few = toxicity.labelled(docs, told, "toxic", 4, 2, 8000, 20_000, {"text": docs["text"]}).collect()
    assert 0 < sum(len(r.text) for r in few) <= 20_000
    slices, toxicity.SLICE = toxicity.SLICE, 700
    again = toxicity.trained(docs, told)
    toxicity.SLICE = slices
    assert np.allclose(again.odds, toxicity.trained(docs, told).odds, atol=0.05)


def test_near_duplicates_keep_what_is_unique(spark):
    rnd = random.Random(6)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (2, a), (3, a), (3, b), (4, c), (4, c), (4, c + " tail"), (None, b + " more"), (None, text()), (7, None), (7, None), (8, ""), (9, "two words"), (9, "two words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, row string")
    got = corpus_pipeline.no_near_duplicates(spark, docs, "")
    kept = sorted((repr(r.doc_id), r.text) if r.text is not None else (repr(r.doc_id), "null") for r in got.collect())
    unique = rows[8][1]
    assert kept == sorted([("1", a), ("4", c), ("None", b + " more"), ("None", unique), ("7", "null"), ("7", "null"), ("8", ""), ("9", "two words")])
    assert corpus_pipeline.no_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline_stages_on_a_small_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack_sequences":
            assert docs.columns == names
        if name in ("quality_classifier", "ngram_jaccard_join", "suffix_array_dedup"):
            assert 0 < docs.count() <= before
            before = docs.count()
    assert docs.count() > 0
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_jaccard_moves_texts_of_possible_pairs_only(spark, monkeypatch):
    """Sets that meet on a common phrase and do not link are told apart by their sketches; their texts stay where they are."""
    from tidevec.llm import jaccard

    texts = [" ".join(f"w{i}x{j}" for j in range(40)) + " this phrase is in every text" for i in range(40)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, texts[0] + " end"])], "doc_id long, text string")
    made, keep = [], jaccard.written

    def told(df):
        out = keep(df)
        if "text" in df.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", told)
    roots = {r.doc_id: r.root for r in jaccard.grouped(docs).collect()}
    assert roots[0] == roots[40] and len(set(roots.values())) == 40
    assert sum(made) == 2, made


def test_places_of_anchors_are_not_rows(spark, monkeypatch):
    from tidevec.llm import suffixes

    plans, keep = [], suffixes._suffixes

    def told(docs, repeated, length):
        plans.append(repeated._jdf.queryExecution().optimizedPlan().toString())
        return keep(docs, repeated, length)

    monkeypatch.setattr(suffixes, "_suffixes", told)
    passage = "".join(chr(97 + i * i % 23) for i in range(500))
    docs = spark.createDataFrame([(i, f"{i} {passage} {i * 7} " * 2) for i in range(6)], "doc_id long, text string")
    assert all(r.n_removed >= 1000 for r in suffixes.deduplicated(docs, ["doc_id"]).collect())
    assert plans and "Generate" not in plans[0]


def test_shuffled_piece_keys_are_short_and_keep_their_bucket():
    from tidevec.llm import jaccard

    keys = np.random.default_rng(1).integers(0, 2**64, 500, np.uint64)
    back = jaccard._long(jaccard._short(keys).tobytes())
    assert jaccard._short(keys).nbytes == 6 * len(keys) and (back == keys >> np.uint64(16) << np.uint64(16)).all()


def test_no_link_hangs_on_the_size_of_a_label(spark):
    """Pairs just above the threshold in a label that is planned like one large enough for projections, which lost some."""
    from tidevec.llm import vectors

    rng = np.random.default_rng(4)
    x = rng.normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    rows = [(i, z.tolist(), 1) for i, z in enumerate(np.concatenate([x, y]))]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), work=640).collect()  # as a larger label would be planned
    assert sum(r.n_links == 1 and r.component_id == r.vec_id % 2500 for r in got) == 5000


def test_texts_without_repeats_are_not_shuffled(spark):
    from tidevec.llm import suffixes

    rnd = np.random.default_rng(3)
    texts = [rnd.bytes(2000).hex() for _ in range(200)]
    texts += [f"one {texts[0][:500]} and", f"two {'x' * 300}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    def shuffled():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before, keep = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.n_removed for r in suffixes.deduplicated(docs, ["doc_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    moved = shuffled() - before
    assert moved < 200_000, moved  # the texts have 800,000 bytes
    assert {k for k, n in got.items() if n} == {0, 200} and got[0] == got[200] == 500 and len(got) == 202


def test_near_duplicates_shuffle_no_texts_of_others(spark, monkeypatch):
    """As on large tables, where no table of keys is small enough for a broadcast."""
    from tidevec.llm import jaccard

    rnd = np.random.default_rng(5)
    texts = [" ".join(rnd.bytes(100).hex() for _ in range(20)) for _ in range(300)]
    texts += [texts[0], f"{texts[1]} end", texts[0]]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")

    def shuffled():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    for module in (jaccard, corpus_pipeline):
        monkeypatch.setattr(module, "small_enough", lambda df: df)
    before, keep = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(r.doc_id for r in corpus_pipeline.no_near_duplicates(spark, docs, "").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    moved = shuffled() - before
    assert got == list(range(300))
    assert moved < 800_000, moved  # the texts have 1,200,000 bytes


@pytest.mark.parametrize("hot", [50_000, 2])
def test_runs_of_words_that_texts_share_are_removed(spark, hot):
    """Shared runs of 50 words with fewer than 400 bytes, against brute force over all windows of words."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    some = lambda n: [word() for _ in range(n)]
    fifty, short, long, endless = some(50), some(49), some(70), ["x" * 90 + "yz"[i % 2] for i in range(55)]
    rows = [(i, " ".join(some(40) + p + some(30))) for i, p in enumerate([fifty, fifty, short, short, long, long[5:62], long[20:], fifty[:49]])]
    rows += [(10, "\n".join(fifty)), (11, " \t".join(fifty) + "\r\n"), (12, " ".join(endless)), (13, " ".join(some(9) + endless)), (14, "be " * 52), (15, "be " * 50), (16, "no " * 50)]
    rows += [(17, None), (18, ""), (19, " \n "), (None, rows[2][1]), (20, " ".join(fifty)[1:]), (21, " ".join(fifty + long)), (22, " ".join(fifty) + "."), (23, "\u00a0".join(fifty))]
    texts = [(t or "").encode() for _, t in rows]
    words = [list(re.finditer(rb"[^\x20\x09-\x0D]+", t)) for t in texts]
    seen = {}
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            seen.setdefault(tuple(x.group() for x in w[p : p + 50]), []).append((i, p))
    marks = [np.zeros(len(t), bool) for t in texts]
    hit = {(i, q) for places in seen.values() if len(places) > 1 for i, p in places for q in range(p, p + 50)}
    for i, q in hit:
        marks[i][words[i][q].start() : words[i][q + 1].start() if (i, q + 1) in hit else words[i][q].end()] = True
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 399):
            seen.setdefault(t[p : p + 400], []).append((i, p))
    for i, p in (x for places in seen.values() if len(places) > 1 for x in places):
        marks[i][p : p + 400] = True
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    want = sorted((repr(i), int(m.sum()), np.frombuffer(t, np.uint8)[~m].tobytes()) for (i, _), t, m in zip(rows, texts, marks))
    got = suffixes.deduplicated(docs, ["doc_id"], hot=hot, words=50).collect()
    assert sorted((repr(r.doc_id), r.n_removed, bytes(r.data)) for r in got) == want
    assert sum(n > 0 for _, n, _ in want) >= 12 and suffixes.deduplicated(docs.limit(0), ["doc_id"], words=50).count() == 0
    left = {r.doc_id: r.text for r in corpus_pipeline.no_repeated_passages(spark, docs, "").collect()}
    assert left[10] == "" and left[17] is None and left[3] == rows[3][1] and " ".join(fifty) not in left[0] + left[1]


def test_op7_tells_passages_of_over_50_words_that_stay(spark, tmp_path):
    """Of fewer than 400 bytes: the contract's columns leave them, n_repeated counts them."""
    rnd = random.Random(21)
    some = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(n))
    passage, short, long = some(52), some(49), some(120)
    texts = [f"{some(30)} {passage} {some(30)}", f"{passage}\n{some(20)}", some(90), f"{some(9)} {short}", f"{short} {some(9)}", f"{some(9)} {long}", f"{long} {some(9)} {passage}", None, ""]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in suffixes.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(passage) < 400 < len(long) and len(rows) == len(texts)
    contract = suffixes.deduplicated(spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id"]).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.data).hexdigest()) for r in contract} == {i: tuple(r)[1:5] for i, r in rows.items()}
    assert [rows[i].n_removed > 0 for i in range(9)] == [i in (5, 6) for i in range(9)] and rows[0].kept_sha256 == hashlib.sha256(texts[0].encode()).hexdigest()
    told = {i: r.n_repeated - r.n_removed for i, r in rows.items()}
    assert told[0] == told[1] == told[6] == len(passage) and told[5] == 0 and all(rows[i].n_repeated == 0 for i in (2, 3, 4, 7, 8))
