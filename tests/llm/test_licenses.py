import random
import re

import pytest

from glyphmill.llm import licenses
from glyphmill.llm.licenses import Template

SCHEMA = "doc_id long, text string, labels int, template string"


def words_of(text):
    lower = (text or "").translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, templates, containment):
    """Every block of every text against every template."""
    out = []
    for i, t in rows:
        w = words_of(t)
        for x in templates:
            tokens, s = set(x.text.split()), licenses.stride_of(len(x.text.split()))
            for k in range(max(-(-len(w) // s) - 2, 0) + 1):
                block = set(w[k * s : (k + 2) * s])
                if len(block & tokens) >= containment * len(tokens) - 1e-9:
                    out.append((i, x.name, set(x.key.split()) <= block, k * s, round(len(block & tokens) / len(tokens), 9)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("containment", [0.5, 0.8, 1.0])
def test_join_is_exact(spark, containment):
    r = random.Random(5)
    templates = (*licenses.TEMPLATES, Template("short", "s", "", "b a"), Template("long", "l", "a", " ".join(f"w{i}" for i in range(70)) + " a"))
    pool = sorted({w for t in templates for w in t.text.split()}) + ["x", "ä"]
    rows = [(i, " ".join(r.choices(pool, k=r.choice([1, 7, 16, 17, 40, 300])))) for i in range(60)]
    for i, t in enumerate(templates):
        own = t.text.split()
        for n in (1, 2, 3):
            edited = [w for w in own if r.random() > 0.15 * n]
            rows.append((100 + 3 * i + n, " ".join(r.choices(pool[:40], k=r.randrange(30)) + edited + ["y"] * r.randrange(30))))
    rows += [(900, None), (901, ""), (901, "Released under the MIT-License"), (None, "released, UNDER the\nmit license")]
    got = licenses.matching_blocks(frame(spark, rows), templates, containment).collect()
    assert sorted(((x.doc_id, x.template, x.keyed, x.word, round(x.containment, 9)) for x in got), key=repr) == brute(rows, templates, containment)


def test_documents(spark):
    rows = [
        (1, "Das ist mit Lizenz. Released under the MIT License."), (2, "released under teh MIT license"), (2, "clean text of the same id"), (3, None), (4, "..."), (5, "mit LICENSE mit\tlicense cc by"), (None, "apache license"),
        (6, "plain " * 100_000 + "Licensed under the Apache  License (version 2.0)"), (7, "Licensed under CC BY-NC 4.0."), (8, "MIT"), (9, "license mit, cc" * 3), (9, "license mit, cc" * 3),
    ]
    got = sorted(map(tuple, licenses.licenses(frame(spark, rows)).drop("templates").collect()), key=repr)
    assert got == sorted([
        (1, 9, 1, 7, 7, "mit", "mit", 1.0), (2, 5, 1, 3, 3, "mit", "mit", 1.0), (2, 6, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0), (4, 0, 0, None, None, "", "", 0.0),
        (5, 6, 3, 0, 4, "cc-by,mit", "cc-by,mit", 1.0), (None, 2, 1, 0, 0, "apache", "apache", 1.0), (6, 100_008, 1, 100_003, 100_003, "apache", "apache", 1.0), (7, 7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc", 1.0),
        (8, 1, 0, None, None, "", "", 0.0), (9, 7, 0, None, None, "", "", 0.0), (9, 7, 0, None, None, "", "", 0.0),
    ], key=repr)


def test_edited_notice_is_found_and_empty_table(spark):
    rows = [(1, "This work is now licensed under the terms of the GNU general license, version 3"), (2, "permission is hereby given to any person obtaining a copy of this software and documentation free of charge, files to deal in the software granted without restriction")]
    got = {r.doc_id: (r.base_labels, r.labels) for r in licenses.licenses(frame(spark, rows)).collect()}
    assert got == {1: ("", "gpl"), 2: ("", "mit")}
    assert licenses.licenses(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        licenses.licenses(frame(spark, []), ())
