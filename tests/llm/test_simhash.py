import random

import numpy as np
import pytest
import xxhash

from glyphmill.llm import simhash

SCHEMA = "doc_id long, text string, u string"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Éa", "ÄB", "x y"]
    docs = [(i, " ".join(r.choices(vocab, k=r.randint(1, 60))), "x") for i in range(150)]
    for i in range(150, 400):
        w = docs[r.randrange(150)][1].split(" ")
        if r.random() < 0.8 and len(w) > 1:
            w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((i, "\t".join(w), "y"))
    docs += [(400, None, None), (401, "", None), (402, " \n", None), (403, "One", None), (404, "one", None)]
    got = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    fps = {i: brute_fp(t) for i, t, _ in docs}
    assert {i: x.fingerprint for i, x in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: x.component_id for i, x in got.items()} == brute_roots(fps)


def test_trie_pairs_exhaustive():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)] + [base]))
    got = set()
    for i, j in simhash.trie_pairs(keys, np.array([0]), np.array([len(keys)]), 0, 3):
        got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    want = {(a, b) for b in range(len(keys)) for a in range(b) if bin(int(keys[a]) ^ int(keys[b])).count("1") <= 3}
    assert got == want


def test_empty_and_repeats(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = simhash.near_duplicates(spark.createDataFrame([(5, "a b c d", "u"), (5, "a b c d", "u"), (None, "a b c d", "v")], SCHEMA)).collect()
    assert sorted((x.doc_id or -1, x.component_id) for x in rows) == [(-1, None), (5, 5), (5, 5)] or len(rows) == 3
    kept = simhash.keep_one(spark.createDataFrame([(5, "a b c d", "u"), (7, "a b c d", "u")], SCHEMA))
    assert [x.doc_id for x in kept.collect()] == [5] and kept.columns == ["doc_id", "text", "u"]


def jaccard_roots(texts, similarity):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_copies_against_brute_force(spark, monkeypatch):
    """A dense group, chains of growing distance, pairs on both sides of the threshold, short and empty texts."""
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(3000)] + ["É", "é"]
    text = lambda n: r.choices(vocab, k=n)
    docs = [(i, " ".join(text(r.randint(0, 120)))) for i in range(200)]
    base = text(300)
    for i in range(200, 280):
        w = list(base)
        for p in r.sample(range(300), r.randint(0, 6)):
            w[p] = r.choice(vocab)
        docs.append((i, " ".join(w)))
    w = text(150)
    for i in range(280, 300):  # each is near to the one before
        w = list(w)
        for p in r.sample(range(150), 2):
            w[p] = r.choice(vocab)
        docs.append((i, "\n".join(w).upper()))
    for i in range(300, 340):
        w = docs[r.randrange(200)][1].split()
        for p in r.sample(range(len(w)), min(len(w), r.randint(0, 4))):
            w[p] = r.choice(vocab)
        docs.append((i, "\t".join(w)))
    docs += [(340, None), (341, ""), (342, " \n"), (343, "One two"), (344, "one TWO"), (345, "one two"), (346, "a a a a a a a a"), (347, "a a a a a")]
    want = jaccard_roots(dict(docs), 0.8)
    assert len({v for v in want.values()}) < 290
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for lay in simhash.LAYOUTS:
        monkeypatch.setattr(simhash, "layout_for", lambda n, rows, lay=lay: lay)
        got = {x.doc_id: x.class_id for x in simhash.near_copies(table).collect()}
        wrong = [i for i in want if got[i] != want[i]]
        assert not wrong, (lay, wrong)
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == {i for i, v in want.items() if i == v}
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def margins(lay, sets, r):
    """Margins of sets of hashes, each given as a list of shingle numbers."""
    h = r.integers(0, 2**64, max(max(x) for x in sets) + 1, dtype=np.uint64)
    off = np.cumsum([0] + [len(x) for x in sets])
    return simhash._margins(h[np.concatenate(sets)], off, lay.words)


@pytest.mark.parametrize("lay", simhash.LAYOUTS)
def test_pairs_meet_in_exactly_one_bucket(lay):
    rng = np.random.default_rng(4)
    base = rng.integers(-30, 31, (1, 64 * lay.words))
    m = (base + rng.integers(-12, 13, (60, 64 * lay.words))).astype(np.int32)
    keys, bits, weak = simhash.probes(m, lay), np.packbits(m > 0, axis=1, bitorder="little").view("<u8"), simhash.weak_bits(m, lay).view(np.uint64)
    assert keys.shape[1] == lay.blocks << lay.flips and keys.max() < 2**31
    shared = 0
    for i in range(len(m)):
        for j in range(i):
            both = np.intersect1d(keys[i], keys[j])
            three = [[np.repeat(w, len(both)) for w in x] for x in (bits[i] ^ bits[j], weak[i] | weak[j], weak[i] & weak[j])]
            assert simhash.first_meeting(both, *three, lay).sum() == (len(both) > 0)
            shared += len(both) > 1
    assert shared > 100


@pytest.mark.parametrize("lay", simhash.LAYOUTS)
def test_pairs_at_the_threshold_meet(lay):
    """Of pairs of sets at 0.8 exactly, 97 of 100 share a bucket in every layout, and all but a few at 0.9."""
    r = np.random.default_rng(11)
    for common, own, least in ((288, 36, 0.97), (306, 17, 0.995)):
        sets = [np.r_[np.arange(common), common + own * k + np.arange(own)] + i * 400 for i in range(400) for k in range(2)]
        keys = simhash.probes(margins(lay, sets, r), lay)
        met = np.mean([len(np.intersect1d(keys[2 * i], keys[2 * i + 1])) > 0 for i in range(400)])
        assert met >= least, (lay, common, met)


def test_layout_follows_the_number_of_texts():
    """Buckets hold BUCKET_ROWS on average at most, up to 34 thousand million texts."""
    assert [simhash.LAYOUTS.index(simhash.layout_for(n)) for n in (0, 1, 10**8, 10**9, 4 * 10**9, 10**10, 10**12)] == [0, 0, 0, 1, 1, 2, 2]
    for n in (10**6, 10**8, 10**9, 3 * 10**10):
        lay = simhash.layout_for(n)
        assert n * 2**lay.flips / 2**lay.width <= simhash.BUCKET_ROWS


def test_runs_join_every_pair_of_similar_sizes():
    """Buckets of over 100 rows: only pairs of one step of sizes or of neighbours are looked at, and none of similar sizes is left out."""
    r = np.random.default_rng(6)
    for rows in (300, 1200):
        key, n = r.integers(0, 2, rows), np.r_[np.arange(1, 101), (10 ** r.uniform(0, 4.3, rows - 100)).astype(np.int64)]
        f0 = r.integers(0, 2**63, rows, dtype=np.uint64)
        order, starts, ends, also = simhash._runs(key, n, f0, 0.8)
        key, n, f0 = key[order], n[order], f0[order]
        got = [(i, j) for a, b in simhash.trie_pairs(f0, starts, ends, 0, 64, None, also) for i, j in zip(a.tolist(), b.tolist())]
        want = {(i, j) for j in range(rows) for i in range(j) if key[i] == key[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])}
        assert len(got) == len(set(got)) and want <= set(got)
        assert len(got) < rows**2 / 4 / 6  # of rows ** 2 / 4 pairs in two buckets
    same = simhash._runs(np.zeros(3, np.int64), np.array([5, 5, 6]), np.zeros(3, np.uint64), 1.0)
    assert [e - s for s, e in zip(same[1], same[2])] == [2, 1]
