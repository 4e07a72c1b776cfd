import random

import numpy as np

from glyphmill.llm import toxicity


def corpus(n, seed):
    """Toxic: an insult with a group mention; either alone is clean."""
    r = random.Random(seed)
    insults, groups = ["idiotic", "vermin"], ["northerners", "southerners"]
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(5, 60))
        kind = r.randrange(4)
        if kind & 1:
            w.insert(r.randrange(len(w)), r.choice(insults))
        if kind & 2:
            w.insert(r.randrange(len(w)), r.choice(groups).upper())
        docs.append((i, " ".join(w), "z"))
        labels.append((i, int(kind == 3), 1))
    return docs, labels


def test_learns_pairs(spark):
    docs, labels = corpus(3000, 1)
    docs += [(9000, None, "z"), (9001, "", "z"), (None, "word1", "z"), (0, docs[0][1], "z")]
    labels += [(9000, None, 1), (None, 1, 1), (5, labels[5][1], 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, predicted string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(d, lab)
    got = toxicity.score(d.withColumn("held", toxicity.held_out(d["doc_id"])), model).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 for x in got)
    truth = {i: y for i, y, _ in labels[:3000]}
    held = [(x.score >= 0.5, truth[x.doc_id] == 1) for x in got if x.held and x.doc_id in truth]
    assert len(held) > 400 and np.mean([a == b for a, b in held]) > 0.97


def test_edges(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [round(x.score) for x in toxicity.score(d, toxicity.fit(d, none)).collect()] == [0, 0]
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), none)).count() == 0


def test_margin_is_pairwise_sum():
    r = np.random.default_rng(1)
    m = toxicity.Model(np.zeros(0, int), 0.3, r.standard_normal(9), r.standard_normal((9, 4)))
    f = np.array([1, 3, 8])
    want = 0.3 + m.weights[f].sum() + sum(m.factors[a] @ m.factors[b] for i, a in enumerate(f) for b in f[:i])
    assert abs(m.margins(np.zeros(3, int), f, 1)[0] - want) < 1e-9
