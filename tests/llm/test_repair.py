import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from glyphmill.llm import repair

SCHEMA = "conv string, conv_id long, turn long, role string, text string, audit int"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """Cost, audit and lines of (role, text, fault) rows by a search over labelled paths with whole strings."""
    todo, seen = [(0, "", 0, "", [])], set()
    best = None
    while todo:
        cost, audit, i, roles, lines = heapq.heappop(todo)
        if best and cost > best[0]:
            break
        state = roles[-1:]
        if i == len(rows) and GRAMMAR.match(roles):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        if (audit, i) in seen:
            continue
        seen.add((audit, i))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        made = [("u", "user"), ("a", "assistant")]
        for c, name in made:
            if c in follows and not audit.endswith("III"):
                heapq.heappush(todo, (cost + 3, audit + "I", i, roles + c, [*lines, f"{name}:"]))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[0] in follows:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, roles + role[0], [*lines, f"{role}:{text}"]))
                for c, name in made:
                    if c in follows:
                        heapq.heappush(todo, (cost + 3 + more, audit + "R", i + 1, roles + c, [*lines, f"{name}:{text}"]))
    return best


def brute(rows):
    out, convs = {}, {}
    for c, turn, role, text in rows:
        convs.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        convs[c] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for c, x in convs.items():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        faulty, seen = [], set()
        for _, role, text in x:
            ink = re.sub(r"[\x20\x09-\x0D]", "", text)
            faulty.append((role, text, "blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, _, _ in x if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(x))
        cost, audit, lines = cheapest(faulty)
        out[c] = (gaps, *(sum(f[2] == k for f in faulty) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, rows):
    got = repair.repair_damaged(spark.createDataFrame([("x", *r, 1) for r in rows], SCHEMA)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_against_search_over_strings(spark):
    r = random.Random(3)
    rows = []
    for c in range(150):
        for turn in r.sample(range(12), r.randrange(1, 7)):
            rows.append((c, turn, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "ua"]), r.choice(["Yes.", "No", "Why? ", " ", "", None, "Yes.", "Ende ä!\n", "a\x0b"])))
    rows += [(200, None, "user", "One."), (200, None, "assistant", "Two."), (200, 5, "user", "x"), (None, 1, "user", "Hm."), (None, None, None, None), (201, 3, "user", "Same."), (201, 3, "user", "Same."), (201, 3, "assistant", "Other.")]
    want = brute(rows)
    assert run(spark, rows) == want
    assert any(re.search("[DIKR]{3}", v[6]) for v in want.values()) and {c for v in want.values() for c in v[6]} == set("DIKR")


def test_grammar_is_met_and_dropped_rows(spark):
    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")])[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, []) == {}


def test_long_conversation_streams(spark):
    """Batches of a few rows; one conversation of 5,000 rows and long texts among short ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for t in range(5000)] + [(2, 0, "user", "y" * 300_000 + "."), (2, 1, "assistant", "z.")]
        got = run(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kinds = [zlib.crc32(f"1:{t}".encode()) % 20 for t in range(5000)]
    assert got[1][0] == sum(k == 0 for k in kinds[1:-1]) + (kinds[0] == 0) * 0 and got[1][1] == kinds.count(1) and got[1][2] == kinds.count(3)
    assert len(re.sub("I", "", got[1][6])) == 5000 - kinds.count(0) + kinds.count(3)


@pytest.mark.parametrize("rows", [[("u", "")], [("s", ""), ("u", "")], [("a", ""), ("a", ""), ("u", "truncated")], [("t", "")]])
def test_lattice(rows):
    x = repair.Lattice()
    for role, fault in reversed(rows):
        x.read(role, fault)
    cost, audit, _ = cheapest([(role, "t", fault) for role, fault in rows])
    assert (x.cost[repair.START], x.audit("".join(r for r, _ in rows))) == (cost, audit)
