"""Edit distances of whole batches against the plain dynamic programme."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.functions import edits, udf
from glyphmill.functions import text as tx
from glyphmill.operators import compare, metrics


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def pairs(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        letters = r.choice(["ab", "abcdefghéß漢😀 "])
        a = [r.choice(letters) for _ in range(r.choice([0, 1, 7, 64, 65, 130, 200]))]
        b = list(a)
        for _ in range(r.choice([0, 1, 5, 20, 100])):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choice(letters) * r.randrange(2)
        if r.random() < 0.2:
            b = [r.choice(letters) for _ in range(r.randrange(200))]
        yield "".join(a), "".join(b)


def test_texts_and_lists_as_the_plain_programme(monkeypatch):
    both = list(pairs(400, 1)) + [("a" * 300, "b" * 300), ("ab", "ab" * 100)]
    want = [plain(a, b) for a, b in both]
    a, b = (pa.array(x) for x in zip(*both))
    lists = [pa.array([list(t) for t in x], pa.list_(pa.string())) for x in zip(*both)]
    for few, kinds, items in ((16, 128, 1 << 20), (0, 128, 5000), (0, 0, 1 << 20), (1 << 30, 128, 1 << 20)):
        for name, value in (("FEW", few), ("KINDS", kinds), ("ITEMS", items)):
            monkeypatch.setattr(edits, name, value)
        assert edits.of_texts(a, b).to_pylist() == want
        assert edits.of_lists(*lists).to_pylist() == want


def test_nulls_slices_and_no_rows():
    a, b = pa.array(["xyz", "abc", None, ""]), pa.array(["xyz", "", "a", "äb"])
    assert edits.of_texts(a, b).to_pylist() == [0, 3, None, 2]
    assert edits.of_texts(a.slice(1), b.slice(1)).to_pylist() == [3, None, 2]
    assert edits.of_texts(a.slice(0, 0), b.slice(0, 0)).to_pylist() == []
    lists = pa.array([["a", None], None, []]), pa.array([["a", "b"], ["c"], ["d", "e"]])
    assert edits.of_lists(*lists).to_pylist() == [1, None, 2]


def test_words_of_a_pair_have_no_bound(spark):
    """Pairs of over 20,000 different words were refused before."""
    words = [f"w{i}" for i in range(20_500)]
    other = words[1:] + ["x"]
    row = spark.createDataFrame([(words, other), (["a"], None)], "r array<string>, h array<string>")
    assert [r[0] for r in row.select(tx.word_distance("r", "h")).collect()] == [2, None]


def test_many_pairs_of_full_lines_in_one_pass():
    r = np.random.default_rng(1)
    lines = ["".join(r.choice(list("etaoinshrdlu "), 512)) for _ in range(300)]
    worn = [x.replace("th", "ht").replace("a", "ä") for x in lines]
    got = edits.of_texts(pa.array(lines), pa.array(worn)).to_pylist()
    assert got[:5] == [plain(a, b) for a, b in zip(lines[:5], worn[:5])]


def test_columns_in_a_sum(spark):
    df = spark.createDataFrame([("abc", "abd"), ("th", "ht"), ("x", "")], "r string, h string")
    assert df.agg(F.sum(tx.char_distance("r", "h").cast("long"))).first()[0] == 4


def test_poisson_weights_at_the_edges_of_the_prime():
    """The same weights as by division, in bytes: a task's block of them stays small."""
    prime, draws = metrics._PRIME, np.arange(500)
    at = np.concatenate([np.arange(200) * 7919 + 10**12, np.arange(400) + prime - 200, [0, 2**62]])
    for seed in (0, 3):
        x = ((at % prime * 48271)[:, None] + (draws * 69621 + seed * 16807 % prime)[None, :]) % prime
        x = x * 1583458089 % prime
        x = (x ^ (x >> 15)) * 784588716 % prime
        got = metrics.poisson_weights(at, draws, seed)
        assert got.dtype == np.uint8 and (got == np.searchsorted(np.array(metrics.POISSON), x, "right")).all()


def test_shared_words_need_no_shuffle(spark):
    lists = pa.array([["a", "a", "b"], [], None, ["x"]]), pa.array([["a", "b", "b", "a"], ["c"], ["d"], ["x", "x"]])
    assert edits.shared(*lists).to_pylist() == [3, 0, None, 1]
    df = spark.createDataFrame([(1, "A b a", "a c"), (2, "", "x"), (3, None, "x")], "id int, reference string, hypothesis string")
    out = compare.token_overlap(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(x.token_precision, round(x.token_recall, 6), x.token_f1) for x in out.orderBy("id").collect()] == [(0.5, 0.333333, 0.4), (0, 0, 0), (0, 0, 0)]


def test_few_changes_take_narrow_bands(monkeypatch):
    """Lines with few changes were all worked out in words of 64 diagonals, from their first item to their last."""
    r = random.Random(4)
    both = []
    for _ in range(600):
        a = [r.choice("abcdefgh ") for _ in range(r.choice([40, 90, 200, 500]))]
        b = list(a)
        for _ in range(r.choice([2, 6, 9])):
            k = r.randrange(len(b) - 1)
            b[k : k + 2] = r.choice([[b[k + 1], b[k]], ["x", b[k + 1]], [b[k]], [b[k], "y", b[k + 1]]] if r.random() < 0.1 else [[b[k + 1], b[k]], ["x", b[k + 1]]])
        both.append(("".join(a), "".join(b)))
    seen, banded = [], edits._banded
    monkeypatch.setattr(edits, "_banded", lambda *x: seen.append((x[8] if len(x) > 8 else np.uint64, len(x[1]), int(x[2].sum()))) or banded(*x))
    got = edits.of_texts(*(pa.array(x) for x in zip(*both))).to_pylist()
    assert got == [plain(a, b) for a, b in both]
    assert {w for w, *_ in seen} >= {np.uint16, np.uint32}
    assert sum(n for w, n, _ in seen if w is not np.uint64) > 400 and sum(x for *_, x in seen) < 0.95 * sum(len(a) for a, _ in both)


def test_batches_go_together(monkeypatch):
    calls = []
    f = lambda a, b: calls.append(len(a)) or edits.of_texts(a, b)
    batches = [(pa.array(a), pa.array(b)) for a, b in ((["ab", None], ["b", "x"]), ([], []), (["abc"], ["xyz"]))]
    batches[1] = tuple(c.cast(pa.string()) for c in batches[1])
    assert [x.to_pylist() for x in edits.together(f, iter(batches))] == [[1, None], [], [3]] and calls == [3]
    monkeypatch.setattr(edits, "ITEMS", 1)
    assert [x.to_pylist() for x in edits.together(f, iter(batches))] == [[1, None], [], [3]] and calls == [3, 2, 1]
    assert list(edits.together(f, iter([]))) == []


def test_words_of_texts_as_of_lists():
    a, b = ["a b c", "", "x", None, "é b"], ["a c", "x y", "", "a", "é c b"]
    lists = [pa.array([None if t is None else t.split() for t in x], pa.list_(pa.string())) for x in (a, b)]
    texts = [pa.array(x) for x in (a, b)]
    assert edits.of_words(*texts).to_pylist() == edits.of_lists(*lists).to_pylist() == [1, 2, 1, None, 1]
    assert edits.of_words(*(t.slice(1) for t in texts)).to_pylist() == [2, 1, None, 1]


def test_collapsed_pairs_look_for_no_white_space(spark):
    """Every scored line was searched for white space three times more."""
    df = spark.createDataFrame([("a b", "a  b"), ("", "x"), ("b c", None)], "reference string, hypothesis string")
    plan = metrics.pair_metrics(df, collapsed=True).select("char_edits", "word_edits", "ref_words")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "lambdafunction" not in plan
    same = df.where("hypothesis is null or hypothesis = 'x'")
    assert metrics.pair_metrics(same, collapsed=True).collect() == metrics.pair_metrics(same).collect()


def test_stretches_of_words_as_by_matching_blocks(monkeypatch):
    """Lines whose words change in place were matched block by block, a pair after the other."""
    r, rows, calls = random.Random(9), [], []
    for _ in range(1500):
        a = [r.choice(["the", "a", "and", "of", "x", "then", "b", "c"]) for _ in range(r.choice([0, 1, 2, 8, 30]))]
        kind = r.randrange(6)
        b = [w.replace("th", "ht") for w in a]
        if kind == 0:
            b = []
        elif kind == 1:
            b = [r.choice(["a", "b", "x"]) if r.random() < 0.2 else w for w in a]
        elif kind == 2:
            b = b[r.randrange(3) :] + ["new"] * r.randrange(2)
        elif kind == 3:
            b = [w if r.random() < 0.5 else "the" for w in b]
        rows.append((a, b))
    kind = pa.list_(pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), *(pa.array(x, kind) for x in zip(*rows))], ["id", "r", "h"])
    want, plainly = [udf.opcodes(a, b) for a, b in rows], udf.opcodes
    monkeypatch.setattr(udf, "opcodes", lambda a, b: calls.append(1) or plainly(a, b))
    (got,) = udf.matched(iter([batch]))
    assert got.column("ops").to_pylist() == want and got.column("id").to_pylist() == list(range(len(rows)))
    assert 0 < len(calls) < len(rows) * 0.7
    (none,) = udf.matched(iter([batch.slice(0, 0)]))
    assert none.num_rows == 0
    (part,) = udf.matched(iter([batch.slice(700, 300)]))
    assert part.column("ops").to_pylist() == want[700:1000]


def test_only_doubtful_stretches_are_worked_out(monkeypatch):
    """Equally long lines were worked out from their first change to their last."""
    r = random.Random(6)
    both = []
    for k in range(400):
        a = [r.choice("etaoinshrdlu ,.bcfgmpwy") for _ in range(r.choice([60, 200, 512]))]
        b = list(a)
        for at in range(r.randrange(9), len(b) - 1, 11):
            b[at : at + 2] = r.choice([[b[at + 1], b[at]], ["ä", b[at + 1]]])
        if k % 4 == 0:  # a stretch that moved by some places: changes in place are not the shortest way
            by, at = r.choice([1, 2, 3, 5, 9, 20]), r.randrange(30)
            b[at : at + 40] = b[at + by : at + 40] + ["x"] * by
        both.append(("".join(a), "".join(b)))
    seen, banded = [], edits._banded
    monkeypatch.setattr(edits, "_banded", lambda *x: seen.append(int(x[2].sum())) or banded(*x))
    want = [edits._whole(list(a), list(b)) for a, b in both]
    assert any(w < sum(x != y for x, y in zip(a, b)) for w, (a, b) in zip(want, both))
    assert edits.of_texts(*(pa.array(x) for x in zip(*both))).to_pylist() == want
    assert sum(seen) < 0.4 * sum(len(a) for a, _ in both)


def test_doubtful_stretches_of_few_letters_and_all_reaches(monkeypatch):
    r = random.Random(7)
    both = []
    for _ in range(300):
        letters = r.choice(["ab", "abcd", "abcdefghijklmnop", [chr(0x4E00 + i) for i in range(400)]])
        a = [r.choice(letters) for _ in range(r.choice([3, 9, 30, 64, 131, 300]))]
        b = list(a)
        for _ in range(r.choice([1, 3, 8])):
            by, at, n = r.choice([1, 2, 3, 8, 16, 33]), r.randrange(len(b)), r.choice([2, 9, 70])
            part = b[at : at + n]
            by = min(by, len(part))
            b[at : at + n] = r.choice([part[by:] + part[:by], part[:-by] + [r.choice(letters)] * by if len(part) > by else part[::-1]])
        if len(b) == len(a):
            both.append(("".join(a), "".join(b)))
    want = [edits._whole(list(a), list(b)) for a, b in both]
    monkeypatch.setattr(edits, "NARROW", 0)
    for step, reach in ((1 << 19, 63), (300, 63), (5000, 31)):
        monkeypatch.setattr(edits, "STEP", step)
        monkeypatch.setattr(edits, "REACH", reach)
        assert edits.of_texts(*(pa.array(x) for x in zip(*both))).to_pylist() == want
