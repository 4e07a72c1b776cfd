import hashlib
import random

import pytest

from glyphmill.llm import repeats

SCHEMA = "doc_id long, text string, kgram string"


def brute(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((d, p))
    gone = [bytearray(len(t)) for t in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, p in at:
                gone[d][p : p + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("most", [repeats.MOST, 3, 1])  # fewer: the anchors' windows are counted one by one
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST", most)
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdeé ") for _ in range(n))
    shared = [word(n) for n in (150, 180, 200, 260, 400, 700)]
    texts = [word(r.randint(0, 300)) + r.choice(shared) + word(r.randint(0, 300)) + r.choice(shared)[r.randint(0, 40) :] + word(9) for _ in range(60)]
    texts += [texts[0], texts[1], None, "", "a" * 900, "ab" * 500, word(160), texts[5][:170] + "!" + texts[5][170:], word(50000) + shared[0]]
    docs = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "y")]
    got = repeats.remove_repeats(spark.createDataFrame(docs, SCHEMA), 160, keep_text=True).collect()
    assert len(got) == len(docs)
    raw = [(t or "").encode() for _, t, _ in docs]
    want = {}
    for (i, _, _), t, g in zip(docs, raw, brute(raw, 160)):
        kept = bytes(c for c, x in zip(t, g) if not x)
        runs = sum(1 for j, x in enumerate(g) if x and not (j and g[j - 1]))
        want[i] = (len(t), sum(g), runs, hashlib.sha256(kept).hexdigest(), kept)
    assert sum(w[1] > 0 for w in want.values()) > 20
    for x in got:
        assert x.has_repeat == (x.n_removed > 0) and (x.longest > 0) == x.has_repeat and x.longest <= x.n_removed
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) == want[x.doc_id]


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_anchor_of_many_contexts(spark):
    r = random.Random(5)
    line = "".join(r.choice("abcdefgh ") for _ in range(300))
    letters = lambda n: "".join(r.choice("stuvwxyz") for _ in range(n))
    texts = [letters(150) + line + letters(150) for _ in range(repeats.MOST + 50)]
    texts += [f"{texts[7][20:550]}{i}" for i in range(3)]
    got = {x.doc_id: x for x in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400).collect()}
    assert {i for i, x in got.items() if x.has_repeat} == {7, *range(repeats.MOST + 50, repeats.MOST + 53)}
    assert got[7].n_removed == 530


def test_passages_of_over_50_words_go_by_their_bytes(spark):
    r = random.Random(8)
    passage = lambda n: (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(67)))[:n]
    texts = [c + x + c for x in (passage(359), passage(399), passage(400)) for c in "pq"]  # 60, 67 and 67 words
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = lambda n: [(x.n_bytes, x.n_removed) for x in repeats.remove_repeats(docs, n).orderBy("doc_id").collect()]
    assert at(400) == [(361, 0)] * 2 + [(401, 0)] * 2 + [(402, 400)] * 2
    assert at(300) == [(361, 359)] * 2 + [(401, 399)] * 2 + [(402, 400)] * 2
