import random

import duckdb

from glyphmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string"


def brute(rows):
    convs = {}
    for c, n, role, text, _ in rows:
        if c is not None:
            convs.setdefault(c, []).append((n is None, n or 0, role or "", text or ""))
    convs = {c: tuple(x[2:] for x in sorted(t)) for c, t in convs.items()}
    out = {}
    for c, t in convs.items():
        if not any((len(u) > len(t) and u[: len(t)] == t) or (u == t and d < c) for d, u in convs.items() if d != c):
            out[c] = (len(t), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t))
    return out


def rows():
    r = random.Random(3)
    out = []
    for c in range(120):
        base = random.Random(c % 25)
        turns = [(base.choice(["user", "assistant", None]), base.choice(["hi", "yes", "ok ü", None, ""])) for _ in range(8)]
        for n in range(r.randint(1, 8)):
            out.append((c, n, *turns[n], "x"))
    out += [(200, 5, "user", "a", None), (200, 5, "user", "a", None), (201, None, "user", "a", None), (None, 0, "user", "a", None)]
    return out + [(300, n, "user", f"t{n}", None) for n in range(700)] + [(301, n, "user", f"t{n}", None) for n in range(600)]


def test_against_brute_force_and_sql(spark):
    data = rows()
    got = {x.conv_id: (x.n_turns, x.text) for x in chat.format_chats(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == brute(data) and 301 not in got
    db = duckdb.connect()
    db.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", [x[:4] for x in data])
    assert {r[0]: r[1:] for r in db.execute(chat.ORACLE).fetchall()} == got


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
