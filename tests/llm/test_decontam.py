import random

import numpy as np

from glyphmill.llm import decontam


def world(seed=1):
    r = random.Random(seed)
    syll = "the an er in on ti sh ou ea ly".split()
    common = ["the", "and", "of", "to", "in"]
    word = lambda: r.choice(common) if r.random() < 0.4 else "".join(r.choices(syll, k=r.randint(2, 4)))
    text = lambda n: [word() for _ in range(n)]
    return r, text


def test_planted(spark, monkeypatch):
    r, text = world()
    items = [(i, " ".join(text(r.randint(14, 59))).capitalize() + ".", "q") for i in range(50)]
    docs, want = [], {}
    for i in range(400):
        w = text(r.randint(1, 400))
        if i % 8 == 0:
            item = r.choice(items)
            body = item[1].split()
            if i % 16 == 0:  # a paraphrase: every seventh word replaced
                body = [x if j % 7 else text(1)[0] for j, x in enumerate(body)]
            at = r.randrange(len(w) + 1)
            w[at:at] = body
            want[i] = item[0]
        docs.append((i, " ".join(w), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (None, items[3][1], "x"), (0, docs[0][1], "x")]
    items += [(77, None, "q"), (78, "...", "q"), (None, "the", "q"), (3, items[3][1], "q")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string, leaks string")
    got = decontam.contamination(d, b).collect()
    assert len(got) == len(docs)
    held = {x.doc_id: [y.item_id for y in x.leaks] for x in got}
    assert held[None] == [3] and held[900] == held[901] == []
    assert {i for i, v in held.items() if v and i is not None} == set(want)
    assert all(want[i] in held[i] for i in want)
    monkeypatch.setattr(decontam, "ITEMS", 20)
    again = decontam.contamination(d, b).collect()
    assert {x.doc_id: [y.item_id for y in x.leaks] for x in again} == held


def test_items_of_any_length(spark):
    """Items of 4 to 900 words, copied whole or with words replaced, at any offset of a text."""
    r, text = world(3)
    lengths = [4, 5, 6, 8, 11, 12, 16, 60, 65, 100, 161, 200, 400, 900]
    items = [(i, " ".join(text(n))) for i, n in enumerate(lengths)]
    docs, want = [], {}
    for i in range(224):
        w, item = text(r.randint(0, 60)), i % len(items)
        body = items[item][1].split()
        if i % 2 and len(body) >= 60:  # a paraphrase: every seventh word replaced
            body = [x if j % 7 else text(1)[0] for j, x in enumerate(body)]
        docs.append((i, " ".join(w + body + text(r.randint(0, 60)))))
        want[i] = item
    docs += [(1000 + i, " ".join(text(r.randint(1, 400)))) for i in range(100)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    held = {x.doc_id: [y.item_id for y in x.leaks] for x in decontam.contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [(i, len(items[k][1].split())) for i, k in want.items() if k not in held[i]] == []
    long = {k for k, n in enumerate(lengths) if n >= 16}
    assert not any(long & set(v) for i, v in held.items() if i >= 1000)


def test_texts_of_one_piece_stay_apart():
    """What a text holds is the same whatever text comes next in its batch."""
    item = [f"w{i}" for i in range(46)]
    docs = [" ".join(item[:35]), " ".join(item[:1] * 100)]
    look = decontam.Lookup(np.unique(decontam._words_of(" ".join(item))))
    n = len(look.known)
    space = decontam.Space(np.eye(n + 1, n, dtype=np.float32), np.ones(n), np.ones(n))
    items = decontam.prepare([1], [look(decontam._words_of(" ".join(item)))], space)
    terms = [look(decontam._words_of(t)) for t in docs]
    alone = [decontam.found_in(t, np.array([0, len(t)]), items, space)[0] for t in terms]
    assert [bool(x) for x in alone] == [True, False]
    assert decontam.found_in(np.concatenate(terms), np.cumsum([0, *map(len, terms)]), items, space) == alone


def test_sketch_spans_the_leading_space(spark):
    """With few terms the randomised singular values equal those of the exact TF-IDF matrix."""
    r, _ = world()
    vocab = [f"t{i}" for i in range(20)]
    texts = [" ".join(r.choices(vocab, k=32)) for _ in range(300)]
    known = np.unique([decontam._words_of(v)[0] for v in vocab])
    look = decontam.Lookup(known)
    space = decontam.sketch(spark.createDataFrame([(t,) for t in texts], "text string"), look, 20)
    a = np.zeros((300, 20))
    for i, t in enumerate(texts):
        np.add.at(a[i], look(decontam._words_of(t)), 1)
    idf = np.log(301 / ((a > 0).sum(axis=0) + 1)) + 1
    exact = np.linalg.svd(a * idf, compute_uv=False)
    assert np.allclose(space.idf, idf) and np.allclose(np.sort(space.singular)[::-1], exact, rtol=1e-3)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [x.leaks for x in decontam.contamination(d, b).collect()] == [[]]
    assert decontam.contamination(d.limit(0), b).count() == 0
