import random

import numpy as np

from glyphmill.llm import passages

SCHEMA = "doc_id long, text string, class_id string"


def test_common_is_lcs():
    r = random.Random(1)
    for _ in range(200):
        x, y = ([r.randrange(5) for _ in range(r.randint(0, 14))] for _ in range(2))
        d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                d[i + 1][j + 1] = d[i][j] + 1 if a == b else max(d[i][j + 1], d[i + 1][j])
        assert passages.common(np.array(x), np.array(y)) == d[-1][-1]


def test_chain_against_quadratic():
    r = np.random.default_rng(4)
    for _ in range(100):
        m = int(r.integers(1, 12))
        a, b, n = r.integers(0, 60, m), r.integers(0, 60, m), r.integers(1, 9, m)
        best = np.zeros(m)
        for i in np.lexsort((b, a)):
            gains = [best[j] - passages.GAP_COST * (a[i] - a[j] - n[j] + b[i] - b[j] - n[j]) for j in range(m) if a[j] + n[j] <= a[i] and b[j] + n[j] <= b[i] and j != i]
            best[i] = n[i] + max([0, *gains])
        top = passages.chain(a, b, n)[0]
        score = n[top[0]] + sum(n[j] - passages.GAP_COST * (a[j] - a[i] - n[i] + b[j] - b[i] - n[i]) for i, j in zip(top, top[1:]))
        assert abs(score - best.max()) < 1e-9


def test_planted_passages(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    exact, fuzzy = text(60), text(120)
    docs, hit = [], set()
    for i in range(40):
        docs.append((i, " ".join(text(r.randint(0, 300))), None))
    for i in range(40, 60):
        docs.append((i, " ".join(text(80) + exact + text(50)), None))
        hit.add(i)
    for i in range(60, 80):
        w = list(fuzzy)
        for p in (20, 57, 90):
            w[p : p + 2] = text(r.randint(0, 3))
        docs.append((i, ", ".join(text(30) + w + text(90)).upper(), None))
        hit.add(i)
    for i in (85, 86, 87):
        docs.append((i, " ".join(text(9) + ["of"] * (50 + 10 * (i - 85)) + text(i - 80)), None))
        hit.add(i)
    docs += [(80, " ".join(exact[:45]), None), (81, None, None), (82, "", None), (83, docs[0][1], None), (None, "x y", None), (84, docs[41][1], None)]
    got = {x.doc_id: x for x in passages.fuzzy_passages(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert len(got) == len(docs)
    assert {i for i, x in got.items() if x.n_links} == hit | {84}
    assert {got[i].class_id for i in range(40, 60)} == {40} and {got[i].class_id for i in range(60, 80)} == {60}
    assert all(abs(got[i].dup_words - 60) <= 1 and got[i].spans[0].s == 80 for i in range(40, 60))
    assert all(got[i].dup_words >= 105 for i in range(60, 80))
    assert (got[83].text_class, got[83].class_id, got[83].n_copies) == (0, 0, 1) and got[None].class_id is None


def test_links_do_not_depend_on_batches():
    import pyarrow as pa

    r = np.random.default_rng(2)
    rows = sorted({(int(a), int(b), int(c)) for a, b, c in zip(r.integers(0, 6, 400), r.integers(0, 9, 400), r.integers(0, 30, 400))})
    found = []
    for size in (1, 3, 50, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + size])], ["h", "doc", "pos"]) for i in range(0, len(rows), size)]
        found.append(sorted((t for b in passages.link_batches(batches) for t in zip(*(c.to_pylist() for c in b.columns))), key=str))
    assert found[0] == found[1] == found[2] == found[3] and all(t[0] < t[2] for t in found[0] if t[1] is not None)
    docs = {}
    for h, d, _ in rows:
        docs.setdefault(h, []).append(d)
    docs = {h: d for h, d in docs.items() if len(set(d)) > 2 or (len(set(d)) == 2 and d.count(min(d)) > 1)}
    assert sorted((h, d, p) for h, none, d, p in found[0] if none is None) == sorted(r for r in rows if r[0] in docs)


def test_long_runs_whose_pieces_stand_elsewhere(spark):
    """Two documents share 60 (then 120) words in a row; each 14 to 30 words of them stand in other documents as well."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    for n, piece in ((60, 30), (60, 14), (120, 14), (50, 25)):
        shared = text(n)
        docs = [(1000, " ".join(text(40) + shared + text(40))), (2000, " ".join(text(70) + shared + text(10)))]
        for k, at in enumerate(range(0, n - piece + 1, max(1, piece // 2))):
            docs += [(i + 20 * k, " ".join(text(50) + shared[at : at + piece] + text(50))) for i in (1, 2, 1001, 1002, 2001, 2002)]
        got = {x.doc_id: x for x in passages.fuzzy_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got[1000].n_links and got[2000].n_links and got[2000].class_id == got[1000].class_id == 1000, (n, piece)
        assert got[1000].dup_words >= n


def test_edits_all_over_a_passage(spark):
    """Passages of 60 words with every ninth one another, of 80 with one in fourteen left out, begun and ended by edits."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    docs, want = [], []
    for k in range(30):
        base = text(60 if k % 2 else 80)
        other = [word() if i % 9 == 4 else w for i, w in enumerate(base)] if k % 2 else [w for i, w in enumerate(base) if i % 14 != 5]
        docs += [(2 * k, " ".join(text(40) + base + text(30))), (2 * k + 1, " ".join(text(20) + other + text(60)))]
        want.append((2 * k, 2 * k + 1))
    got = {x.doc_id: x for x in passages.fuzzy_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = [got[b].class_id == a and got[a].n_links == got[b].n_links == 1 for a, b in want]
    assert sum(found) == len(found)


def test_edge_has_the_best_beginnings():
    r = np.random.default_rng(3)
    for _ in range(200):
        x, y = (r.integers(0, 4, int(r.integers(0, 12))) for _ in range(2))
        for n, (gain, i, j, same) in enumerate(passages.edge(x, y, 0.8)):
            near = range(max(0, j - passages.SHIFT), min(len(x), j + passages.SHIFT) + 1)
            best = max(passages.common(x[:k], y[:j]) - 0.8 * max(k, j) for k in near)
            assert j == n and i in near and abs(gain - best) < 1e-9 and same == passages.common(x[:i], y[:j])


def test_empty_table(spark):
    assert passages.fuzzy_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_by_length_and_edits(spark):
    """Random substitutions that leave 0.82 or more of the words equal, and every sixth word another."""
    r, docs, pairs = random.Random(9), [], {}
    word = lambda: f"w{r.randrange(10**6)}"
    fill = lambda: [word() for _ in range(60)]
    for n in (50, 55, 60, 80, 120):
        for rate in (0.05, 0.1, 0.15, "sixth"):
            for _ in range(30):
                same = 0
                while same < 0.82 * n:
                    p = [word() for _ in range(n)]
                    q = [word() if (k % 6 == 5 if rate == "sixth" else r.random() < rate) else w for k, w in enumerate(p)]
                    same = sum(a == b for a, b in zip(p, q))
                pairs.setdefault((n, rate), []).append(len(docs))
                docs += [(len(docs) + k, " ".join(fill() + x + fill())) for k, x in enumerate((p, q))]
    got = {x.doc_id: x.class_id for x in passages.fuzzy_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for kind, firsts in pairs.items():
        least = 0.6 if kind[1] == "sixth" else 0.9  # runs of five words at most are the hardest case
        assert sum(got[i] == got[i + 1] for i in firsts) >= least * len(firsts), kind
    assert all(c in (i, i - 1) for i, c in got.items())


def test_edited_passage_whose_pieces_stand_elsewhere(spark):
    r = random.Random(2)
    word = lambda: f"w{r.randrange(10**6)}"
    fill = lambda n=60: [word() for _ in range(n)]
    w = fill(80)
    edited = [word() if k % 10 == 9 else x for k, x in enumerate(w)]
    apart = lambda: sum((fill(25) + w[k : k + 9] for k in range(0, 80, 10)), [])
    docs = [(1, apart()), (10, fill() + w + fill()), (11, apart()), (20, fill() + edited + fill()), (21, apart()), (22, apart())]
    got = {x.doc_id: (x.class_id, x.n_links) for x in passages.fuzzy_passages(spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")).collect()}
    assert got == {1: (1, 0), 10: (10, 1), 11: (11, 0), 20: (10, 1), 21: (21, 0), 22: (22, 0)}


def test_edges_reach_the_length():
    x = np.arange(60, dtype=np.uint32)
    y = x.copy()
    y[[3, 9, 15, 30, 41, 47, 49]] += 1000
    got = passages.align(np.r_[x[:50], x[:0]], y[:50], [16], [16], [14], 50, 0.8)
    assert [(a, b, c, d) for a, b, c, d, _ in got] == [(0, 50, 0, 50)] and got[0][4] == 0.86


def test_every_pair_of_a_seed_is_settled(spark, monkeypatch):
    """An edited pair meets though its pieces stand in many documents between, all links of a common passage count, also in parts."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**6)}"
    fill = lambda n=60: [word() for _ in range(n)]
    w, common = fill(80), fill(60)
    edited = [word() if k % 10 == 9 else x for k, x in enumerate(w)]
    apart = lambda: sum((fill(25) + w[k : k + 9] for k in range(0, 80, 10)), [])
    docs = [(i, apart()) for i in (1, 2, 20, 30, 31, 40)] + [(10, fill() + w + fill()), (50, fill() + edited + fill())]
    docs += [(100 + i, fill(i) + common + fill(9)) for i in range(30)]
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")
    for size in (passages.BLOCK, 8):
        monkeypatch.setattr(passages, "BLOCK", size)
        got = {x.doc_id: x for x in passages.fuzzy_passages(rows).collect()}
        assert (got[10].class_id, got[50].class_id, got[10].n_links, got[50].n_links) == (10, 10, 1, 1)
        assert all(got[i].n_links == 0 for i in (1, 2, 20, 30, 31, 40))
        assert all((x.class_id, x.n_links, x.dup_words) == (100, 29, 60) for i, x in got.items() if i >= 100)


def test_shared_seeds_do_not_depend_on_batches():
    import pyarrow as pa

    r = np.random.default_rng(8)
    rows = sorted({(int(a), int(b), int(c)) for a, b, c in zip(r.integers(0, 60, 400), r.integers(0, 9, 400), r.integers(0, 30, 400))})
    seeds = {}
    for h, d, p in rows:
        seeds.setdefault(h, []).append(d)
    want = [(h, d, p, len(seeds[h]) == len(set(seeds[h])) <= passages.BEFORE + 2) for h, d, p in rows if len(set(seeds[h])) > 1]
    for size in (1, 2, 3, 7, 50, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + size]), (pa.int64(), pa.int64(), pa.int32()))], ["h", "doc", "pos"]) for i in range(0, len(rows), size)]
        assert [t for b in passages.shared(iter(batches)) for t in zip(*(c.tolist() for c in b))] == want
