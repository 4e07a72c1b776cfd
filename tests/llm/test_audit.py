import re
from itertools import permutations

from glyphmill.llm import audit

DOCS = "source string, doc_id long, text string, `filter` string, n string"
LABELS = "doc_id long, quality int, toxic int, source string"


def brute(docs, labels):
    fails = []
    for source, i, t in docs:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        x = set()
        if len(words) < 200:
            x.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            x.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            x.add("C")
        if re.search("[#$%&*|]", t):
            x.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for _, j, u in docs):
            x.add("E")
        fails.append((source or "", x, any(q == 1 for j, q, _ in labels if j == i and i is not None), any(q == 1 for j, _, q in labels if j == i and i is not None)))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        shapley = dict.fromkeys(audit.FILTERS, 0)
        for order in permutations(audit.FILTERS):
            for k, c in enumerate(order):
                before = set(order[:k])
                gone = [(x, g, t) for x, g, t in mine if c in x and not x & before]
                shapley[c] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not x & (before | {c}) for x, _, _ in mine), len(gone), sum(c in x and bool(x & before) for x, _, _ in mine), sum(x == {c} for x, _, _ in mine), sum(g for _, g, _ in gone), sum(t for _, _, t in gone)
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels):
    got = audit.interactions(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS), spark.createDataFrame([(*x, "z") for x in labels], LABELS))
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}


def test_against_every_order(spark):
    long = " ".join(f"word{i}" for i in range(250))
    docs = [
        ("a", 1, long), ("a", 2, long), ("b", 3, long), ("b", 3, long), ("b", 4, "x " * 300), ("a", 5, "\tAB\x0bcd\n"), ("a", 6, None), (None, 7, ""), ("", 8, long + " 5 %"), ("a", None, long), (None, None, "Ä ß"),
        ("a", 9, "one more " + long), ("b", 10, long.upper()), ("c", 11, "w " * 60_000 + "#"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (6, None, 1), (10, 1, None), (None, 1, 1), (99, 1, 1)]
    got = run(spark, docs, labels)
    assert got == brute(docs, labels) and len(got) == 4 * 600


def test_empty(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    assert run(spark, [("a", 1, "few words")], []) == brute([("a", 1, "few words")], [])


def test_lattice(spark):
    steps = [(r.applied, r.filter) for r in audit.steps(spark).collect()]
    assert len(audit.lattice()) == len(set(audit.lattice())) == 80 and len(steps) == 600 and set(steps) == set(audit.lattice())
