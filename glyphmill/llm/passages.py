"""Fuzzy repeated passages: shared k-word seeds, collinear chains with gap costs, aligned chains."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import _io, _vec, graph

#: Words of a seed, and seeds in a row of which the least is taken (so 7 equal words always share one).
SEED, WINDOW = 5, 3
#: Documents before it, by id, that each of a seed's documents meets, beside the first.
BEFORE = 2
#: Words from one seed to the next of one diagonal that still make one run, and what a word of a gap costs a chain.
REACH, GAP_COST = SEED + WINDOW, 0.15
#: Words of a passage that may lie outside its seeds; words by which the two sides of an end may be shifted.
SPARE, SHIFT = 35, 5
#: The same for a stretch of a chain whose words are at hand already.
AT_HAND = 40
#: Documents of a seed that meet in one group; the documents of a seed with more meet by twos of such parts.
BLOCK = 1024
#: Items of a table of two sides' words at once, and links of pairs that are chained at once.
CELLS, LINKS = 1 << 21, 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def seeds_of(buf: np.ndarray, off: np.ndarray, least: int):
    """(text, seed hash, word place) of the window minima of each text of at least `least` words."""
    _, _, hashes, at = _vec.words(buf, off)
    n = np.diff(at)
    counts = np.where(n >= least, n - SEED + 1 - WINDOW + 1, 0)
    owner, place = _vec.expand(np.maximum(counts, 0))
    if not len(owner):
        return None
    h = _vec.shingle_hash(hashes, SEED)
    ranked = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    a = (_vec.window_min(ranked, WINDOW)[at[owner] + place] & _LOW).astype(np.int64)
    new = np.r_[True, (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])]
    a, owner = a[new], owner[new]
    return owner, h[a], a - at[owner]


def shared(batches):
    """Rows (seed, document, place), sorted -> those of seeds of two documents or more, and whether the seed has few: BEFORE + 2 at most, once each.

    What is carried from batch to batch are a seed's rows while one document has it, or few; a seed of few comes out whole.
    """
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32())], ["h", "doc", "pos"])
    held, many, last = none, None, False
    for b in itertools.chain(batches, [None]):
        if b is None:
            last = True
        t = pa.Table.from_batches([x for x in (held, b) if x is not None], schema=none.schema)
        if not t.num_rows:
            continue
        h, doc, pos = (c.to_numpy() for c in t.columns)
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.append(start, len(h)))
        more = doc[start] != doc[start + n - 1]
        again = np.r_[False, (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])]
        few = more & (n <= BEFORE + 2) & (np.add.reduceat(again, start, dtype=np.int64) == 0)
        if many is not None and h[0] == many:
            more[0], few[0] = True, False
        done = np.ones(len(start), bool)
        if not last:
            done[-1] = more[-1] and not few[-1] and (n[-1] > BEFORE + 2 or h[start[-1]] == many)
            many = h[-1] if done[-1] else None
        held = none if done[-1] else pa.RecordBatch.from_arrays([pa.array(x[start[-1] :]) for x in (h, doc, pos)], ["h", "doc", "pos"])
        out = np.repeat(more & done, n)
        yield h[out], doc[out], pos[out], np.repeat(few, n)[out]


def meetings(batches):
    """Rows sorted by seed, document and place -> (no h, da, pa, db, pb) links of all pairs of a seed's few documents; (h, document, place) of the other seeds that are shared."""
    names = ["h", "da", "pa", "db", "pb"]
    for h, doc, pos, few in shared(batches):
        x = [pa.array(c[~few]) for c in (h, doc, pos)]
        yield pa.RecordBatch.from_arrays([*x, pa.nulls(len(x[0]), pa.int64()), pa.nulls(len(x[0]), pa.int32())], names)
        for b in link_batches([pa.RecordBatch.from_arrays([pa.array(c[few]) for c in (h, doc, pos)], ["h", "doc", "pos"])]):
            links = b.filter(b.column(1).is_valid())
            yield pa.RecordBatch.from_arrays([pa.nulls(links.num_rows, pa.int64()), *links.columns], names)


def _windows(least: int) -> tuple[int, int, int]:
    """Words between the first and last seed of a chain that can be a passage, to the next seed of a chain of one so far, and to one that makes it so wide.

    A chain goes on while its words exceed GAP_COST times its gaps' words, of both sides.
    """
    width = least - SPARE - SEED
    return width, int(SEED / GAP_COST) + 2 * SEED, int((width + SEED - 1) * (1 + 1 / GAP_COST)) + SEED


def contexts(batches, least: int):
    """Rows (h, doc, pos) sorted by document and place -> a row a seed and document with 16-bit codes of what stands around: (close, direct, far) after, and before.

    far are those that alone make a chain wide enough, direct those of them that it can reach in one step; rows without any can begin no chain and are left out.
    """
    width, step, reach = _windows(least)
    for t in _vec.in_groups(batches, ["doc"], 50_000):
        h, doc, pos = (t[x].to_numpy() for x in ("h", "doc", "pos"))
        run = np.cumsum(np.r_[True, doc[1:] != doc[:-1]]).astype(np.int64)
        place = run << 32 | pos
        order = np.lexsort((h, run))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (run[order][1:] != run[order][:-1])]
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        alone = np.bincount(group) == 1
        code = (h & 0xFFFF).astype(np.int64)
        at = lambda d, side="left": np.searchsorted(place, place + d, side)
        lists = []
        for kind, lo, hi in ((0, at(1), at(width)), (1, at(width), at(step - width, "right")), (2, at(step - width, "right"), at(reach, "right")), (3, at(-width), np.where(alone[group], np.arange(len(h)), 0))):
            owner, k = _vec.expand(np.maximum(hi - lo, 0))
            lists.append(group[owner] << 18 | kind << 16 | code[lo[owner] + k])
        keys = np.unique(np.concatenate(lists))
        of, kind = keys >> 18, keys >> 16 & 3
        sizes = np.stack([np.bincount(of[kind == k], minlength=len(alone)) for k in range(4)])
        first = order[new]
        kept = sizes[1] + sizes[2] > 0
        ends = np.cumsum(sizes.sum(0))
        data = (keys & 0xFFFF).astype(np.uint16)
        parts = [data[e - n : e].tobytes() for e, n in zip(ends[kept].tolist(), sizes.sum(0)[kept].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(h[first][kept]), pa.array(doc[first][kept]), *(pa.array(x[kept].astype(np.int32)) for x in sizes[:3]), pa.array(parts, pa.binary())], ["h", "doc", "close", "direct", "far", "codes"])


def _sets(rows: list[np.ndarray]) -> np.ndarray:
    """(row, code) as ones, of codes that two rows or more have."""
    n = np.array([len(r) for r in rows])
    codes, column, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    often = np.cumsum(count > 1) - 1
    kept = count[column] > 1
    out = np.zeros((len(rows), int((count > 1).sum())), np.float32)
    out[np.repeat(np.arange(len(rows)), n)[kept], often[column[kept]]] = 1
    return out


def candidates(batches):
    """Rows of contexts() by seed and part, sorted -> (h, i, j, doc, others): the documents with which each can have a chain that begins at the seed.

    That is so if both have a seed after it that is far enough, in one step or with another between; and no seed just before it, as they meet there then.
    """
    for t in _vec.in_groups(batches, ["h", "i", "j"], 20_000):
        h, i, j, b, doc = (t[x].to_numpy() for x in ("h", "i", "j", "b", "doc"))
        sizes = np.stack([t[x].to_numpy() for x in ("close", "direct", "far")]).cumsum(0)
        codes = [np.frombuffer(x, np.uint16) for x in t["codes"].to_pylist()]
        bounds = np.append(np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]), len(h))
        rows, found = [], []
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
            if hi - lo < 2:
                continue
            c, (x, y, z) = codes[lo:hi], sizes[:, lo:hi].tolist()
            far = _sets([v[p:q] for v, p, q in zip(c, x, z)])
            meet = far @ far.T > 0
            if not np.any(meet[np.triu_indices(hi - lo, 1)]):
                continue
            after, direct = _sets([np.unique(v[:q]) for v, q in zip(c, z)]), _sets([v[p:q] for v, p, q in zip(c, x, y)])
            before = _sets([v[q:] for v, q in zip(c, z)])
            meet &= (direct @ direct.T > 0) | (after @ after.T > 1)
            meet &= before @ before.T == 0
            if i[lo] != j[lo]:
                meet &= b[lo:hi, None] != b[None, lo:hi]
            np.fill_diagonal(meet, False)
            some = np.flatnonzero(meet.any(1))
            rows += (some + lo).tolist()
            found += [doc[lo:hi][meet[k]] for k in some.tolist()]
        if rows:
            others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f) for f in found])), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*(pa.array(v[rows]) for v in (h, i, j, doc)), others], ["h", "i", "j", "doc", "others"])


def link_batches(batches):
    """Rows sorted by seed, document and place -> links of each to the seed's first document and the BEFORE ones before.

    So all pairs of BEFORE + 2 documents meet, and a document has BEFORE + 1 links a seed at most. The n-th occurrence in a
    document goes with the n-th of the other (or its last), so runs of one repeated word line up too. What is
    carried from batch to batch are a seed's occurrences in its first and last documents, so a seed of any number
    of documents streams through. Where these links may not be all, in three documents or more or with
    repeats in the first of two, the seed's occurrences go out too (seed as da, no pa), to be linked where they go on alike.
    """
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        h, doc, pos = (b.column(i).to_numpy() for i in range(3))
        skip = 0
        if held is not None and held[0][0] == h[0]:
            skip = len(held[0])
            h, doc, pos = (np.concatenate([x, y]) for x, y in zip(held, (h, doc, pos)))
        new_seed = np.r_[True, h[1:] != h[:-1]]
        new_run = new_seed | np.r_[True, doc[1:] != doc[:-1]]
        start = np.append(np.flatnonzero(new_run), len(h))
        run = np.cumsum(new_run) - 1
        first = np.maximum.accumulate(np.where(new_seed[start[:-1]], np.arange(len(start) - 1), 0))[run]
        place = np.arange(len(h)) - start[run]
        fresh = np.arange(len(h)) >= skip
        star, near = np.flatnonzero((run > first) & fresh), np.flatnonzero((run > first + 1) & fresh)
        with_ = lambda rows, other: start[other] + np.minimum(place[rows], start[other + 1] - start[other] - 1)
        left, right = [with_(star, first[star])], [star]
        for back in range(1, BEFORE + 1):
            rows = near[run[near] - back > first[near]]
            left.append(with_(rows, run[rows] - back))
            right.append(rows)
        left, right = np.concatenate(left), np.concatenate(right)
        again = start[first + 1] - start[first] > 1  # the first document has the seed more than once
        second = np.flatnonzero((run == first + 1) & again & fresh)
        head = (place == 0) & fresh & ((run == first + 1) & again | (run == first + 2) & ~again)  # what came before goes out as well
        early, step = _vec.expand((start[run] - start[first])[head])
        asked = np.concatenate([near, second, start[first[head]][early] + step])
        linked = np.arange(len(left) + len(asked)) < len(left)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([doc[left], h[asked]])),
                pa.array(np.concatenate([pos[left], pos[asked]]), mask=~linked),
                pa.array(np.concatenate([doc[right], doc[asked]])),
                pa.array(np.concatenate([pos[right], pos[asked]])),
            ],
            ["da", "pa", "db", "pb"],
        )
        runs = sorted({int(first[-1]), *range(max(int(run[-1]) - BEFORE, int(first[-1])), int(run[-1]) + 1)})
        keep = np.concatenate([np.arange(start[r], start[r + 1]) for r in runs])
        held = h[keep], doc[keep], pos[keep]


def chain(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Disjoint best chains of runs (starts a, b; n words each), each run in one of them, in order.

    A run follows another that ends before it in both texts. Fenwick tree over ends in b: the
    prefix maximum of score + cost * (end in a + end in b), entered once the end in a is passed.
    """
    if len(a) == 1:
        return [[0]]
    order = np.lexsort((b, a))
    ends = np.argsort(a + n, kind="stable")
    grid = np.unique(b + n)
    slot = np.searchsorted(grid, b + n) + 1
    upto = np.searchsorted(grid, b, "right")
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(grid) + 1)
    score, back, done = [0.0] * len(a), [-1] * len(a), 0
    for i in order.tolist():
        while done < len(ends) and a[ends[done]] + n[ends[done]] <= a[i]:
            j = int(ends[done])
            done += 1
            value, k = (score[j] + GAP_COST * float(a[j] + b[j] + 2 * n[j]), j), int(slot[j])
            while k < len(tree):
                if value > tree[k]:
                    tree[k] = value
                k += k & -k
        best, k = (0.0, -1), int(upto[i])
        while k:
            if tree[k] > best:
                best = tree[k]
            k -= k & -k
        gain = best[0] - GAP_COST * float(a[i] + b[i])
        score[i] = float(n[i]) + max(0.0, gain)
        back[i] = best[1] if best[1] >= 0 and gain > 0 else -1
    out, used = [], [False] * len(a)
    for i in sorted(range(len(a)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(path[::-1])
    return out


def chains(batches, least: int):
    """Links (n equal words from a place in either text) sorted by pair -> chains that can reach `least` words in both."""
    for t in _vec.in_groups(batches, ["da", "db"], 100_000):
        da, pa_, db, pb, m = (t[x].to_numpy().astype(np.int64) for x in ("da", "pa", "db", "pb", "n"))
        order = np.lexsort((pb, pa_, pb - pa_, db, da))
        da, pa_, db, pb, m = (x[order] for x in (da, pa_, db, pb, m))
        new_pair = np.r_[True, (da[1:] != da[:-1]) | (db[1:] != db[:-1])]
        new_line = new_pair | np.r_[True, pb[1:] - pa_[1:] != pb[:-1] - pa_[:-1]]
        line = np.cumsum(new_line) << 40
        ends = np.maximum.accumulate(pa_ + m + line) - line  # the furthest end so far on the diagonal
        new = new_line | np.r_[True, pa_[1:] - ends[:-1] > REACH - SEED]
        s = np.flatnonzero(new)
        e = np.r_[s[1:], len(da)] - 1
        a, b, n = pa_[s], pb[s], ends[e] - pa_[s]
        pair = np.flatnonzero(new_pair[s])
        width = np.maximum.reduceat(a + n, pair) - np.minimum.reduceat(a, pair)
        wide = np.maximum.reduceat(b + n, pair) - np.minimum.reduceat(b, pair)
        out = {k: [] for k in ("cid", "da", "db", "a", "b", "n")}
        stop = np.r_[pair[1:], len(s)]
        for k in np.flatnonzero(np.minimum(width, wide) + SPARE >= least).tolist():
            lo, hi = int(pair[k]), int(stop[k])
            x, y, z = a[lo:hi], b[lo:hi], n[lo:hi]
            for path in chain(x, y, z):
                f, g = path[0], path[-1]
                if min(x[g] + z[g] - x[f], y[g] + z[g] - y[f]) + SPARE >= least:
                    for key, v in (("da", da[s[lo]]), ("db", db[s[lo]]), ("a", x[path]), ("b", y[path]), ("n", z[path])):
                        out[key].append(v)
        ids = pa.list_(pa.int32())
        lists = [pa.array([v.astype(np.int32) for v in out[x]], ids) for x in ("a", "b", "n")]
        yield pa.RecordBatch.from_arrays([pa.array(out["da"], pa.int64()), pa.array(out["db"], pa.int64()), *lists], ["da", "db", "a", "b", "n"])


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence (bit-parallel, one big integer for x)."""
    if not len(x) or not len(y):
        return 0
    masks: dict[int, int] = {}
    for i, c in enumerate(x.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for c in y.tolist():
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


def edge(x: np.ndarray, y: np.ndarray, similarity: float) -> list[tuple[float, int, int, int]]:
    """(gain, i, j, same) for j = 0, 1, ...: the beginnings x[:i], y[:j], at most SHIFT apart in length, with most words
    equal in order, and how far these exceed similarity * max(i, j).

    Bit-parallel as in common(): the zeros among the first i bits are the words equal to y[:j] in order.
    """
    out, masks = [(0.0, 0, 0, 0)], {}
    for i, c in enumerate(x.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for j, c in enumerate(y.tolist(), 1):
        if j - SHIFT > len(x):
            break
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
        best = None
        for i in range(max(0, j - SHIFT), min(len(x), j + SHIFT) + 1):
            same = i - (v & ((1 << i) - 1)).bit_count()
            here = (same - similarity * max(i, j), i, j, same)
            if best is None or here > best:
                best = here
        out.append(best)
    return out


def ends(left: list[tuple[float, int, int, int]], right: list[tuple[float, int, int, int]], core: float, width: int, wide: int, least: int):
    """The pair of edges with most gain by which a core of width and wide words reaches `least` on both sides, or None."""
    g, i, j, _ = (np.array(c) for c in zip(*left))
    h, k, m, _ = (np.array(c) for c in zip(*right))
    total = core + g[:, None] + h[None, :]
    long_enough = np.minimum(width + i[:, None] + k[None, :], wide + j[:, None] + m[None, :]) >= least
    total = np.where(long_enough, total, -np.inf)
    at = int(total.argmax())
    return divmod(at, len(right)) if total.flat[at] >= -1e-9 else None


def align(wa: np.ndarray, wb: np.ndarray, a, b, n, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages (start and end in wa, in wb, similarity) of at least `least` words along one chain.

    Runs extend over equal words, gaps are aligned by longest common subsequence, and so is what
    lies beyond the ends as far as that pays. Of the chain, the stretches stay whose equal words
    are at least `similarity` of the longer side.
    """
    runs: list[list[int]] = []
    for s, t, m in zip(a, b, n):
        s, t, m = int(s), int(t), int(m)
        if runs:
            ps, pt, pm = runs[-1]
            room = min(s - ps - pm, t - pt - pm)
            ahead = wa[ps + pm : ps + pm + room] == wb[pt + pm : pt + pm + room]
            pm += int(np.argmin(ahead)) if not ahead.all() else room
            runs[-1][2] = pm
            room = min(s - ps - pm, t - pt - pm)
        else:
            room = min(s, t)
        behind = (wa[s - room : s] == wb[t - room : t])[::-1]
        back = int(np.argmin(behind)) if not behind.all() else room
        runs.append([s - back, t - back, m + back])
    s, t, m = runs[-1]
    room = min(len(wa) - s - m, len(wb) - t - m)
    ahead = wa[s + m : s + m + room] == wb[t + m : t + m + room]
    runs[-1][2] = m + (int(np.argmin(ahead)) if not ahead.all() else room)
    equal = [int((wa[s : s + m] == wb[t : t + m]).sum()) for s, t, m in runs]
    gaps = []
    for (s, t, m), (s2, t2, _) in zip(runs, runs[1:]):
        x, y = wa[s + m : s2], wb[t + m : t2]
        gaps.append((common(x, y), max(len(x), len(y))))
    out = []
    todo = [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        best, start, total, pick = 0.0, lo, 0.0, None
        for i in range(lo, hi):
            if i > lo:
                total += gaps[i - 1][0] - similarity * gaps[i - 1][1]
            if total < 0 or i == lo:
                total, start = 0.0, i
            total += equal[i] - similarity * runs[i][2]
            if total > best or pick is None:
                best, pick = total, (start, i)
        f, g = pick
        (s, t, _), (s2, t2, m2) = runs[f], runs[g]
        same = sum(equal[f : g + 1]) + sum(x for x, _ in gaps[f:g])
        e, u = s2 + m2, t2 + m2
        if min(e - s, u - t) + AT_HAND >= least:
            sides = [(wa[max(0, s - least) : s][::-1], wb[max(0, t - least) : t][::-1]), (wa[e : e + least], wb[u : u + least])]
            # Words that both ends hold at all bound what any alignment of them can find.
            most = same + sum(int(np.isin(x, y).sum()) for x, y in sides)
            if most >= similarity * least:
                edges = [edge(x, y, similarity) for x, y in sides]
                if picked := ends(*edges, same - similarity * max(e - s, u - t), e - s, u - t, least):
                    (_, i, j, more), (_, k, l, rest) = (x[p] for x, p in zip(edges, picked))
                    s, t, e, u, same = s - i, t - j, e + k, u + l, same + more + rest
        long, short = max(e - s, u - t), min(e - s, u - t)
        if short >= least and same >= similarity * long:
            out.append((s, e, t, u, same / long))
        todo += [x for x in ((lo, f), (g + 1, hi)) if x[0] < x[1]]
    return out


def _on_a_line(w: list[np.ndarray], place: list[int], x: int, ys: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether text x shares a passage with each of ys on the diagonal of their places, the words of x in such passages).

    A passage is there where `least` words in a row have `similarity` equal ones, place by place; its ends are equal words.
    """
    wx = w[x]
    n, ok, cover = len(wx), np.zeros(len(ys), bool), np.zeros(len(wx), bool)
    if n < least:
        return ok, cover
    need = int(np.ceil(similarity * least - 1e-9))
    each = np.arange(n, dtype=np.int32)
    for at in range(0, len(ys), max(1, CELLS // n)):
        part = ys[at : at + max(1, CELLS // n)].tolist()
        equal = np.zeros((len(part), n), bool)
        for row, y in zip(equal, part):
            wy, d = w[y], place[y] - place[x]
            lo, hi = max(0, -d), min(n, len(wy) - d)
            if hi > lo:
                np.equal(wx[lo:hi], wy[lo + d : hi + d], out=row[lo:hi])
        total = np.zeros((len(part), n + 1), np.int32)
        np.cumsum(equal, axis=1, out=total[:, 1:])
        good = total[:, least:] - total[:, :-least] >= need
        k = np.flatnonzero(good.any(1))
        if not len(k):
            continue
        equal, good = equal[k], good[k]
        inside = np.zeros((len(k), n + 1), np.int32)
        inside[:, : n + 1 - least] += good
        inside[:, least:] -= good
        inside = np.cumsum(inside, axis=1)[:, :n] > 0
        begins, stops = inside.copy(), inside.copy()
        begins[:, 1:] &= ~inside[:, :-1]
        stops[:, :-1] &= ~inside[:, 1:]
        after = np.maximum.accumulate(np.where(equal, each, -1), axis=1) >= np.maximum.accumulate(np.where(begins, each, -1), axis=1)
        back = lambda m: np.minimum.accumulate(np.where(m, each, n)[:, ::-1], axis=1)[:, ::-1]
        inside &= after & (back(equal) <= back(stops))
        whole = inside.sum(1) >= least
        ok[at + k[whole]] = True
        cover |= inside[whole].any(0)
    return ok, cover


def _keyed(h: np.ndarray, pos: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(seed and number in its run, place) of a text's seeds sorted by hash and place, numbered from the start of their runs and, in runs of several, from the end.

    A run are places of one seed at most SEED words apart: a repeated word or two. Two of them line up from either end.
    """
    new = np.r_[True, (h[1:] != h[:-1]) | (pos[1:] - pos[:-1] > SEED)][: len(h)]
    start = np.flatnonzero(new)
    owner, k = _vec.expand(np.diff(np.append(start, len(h))))
    n = np.bincount(owner, minlength=len(start))[owner]
    out = []
    for number, rows in ((k, slice(None)), (n - 1 - k, n > 1)):
        key, at = (h.view(np.uint64) + _vec.mix(number.astype(np.uint64)))[rows], pos[rows]
        order = np.argsort(key, kind="stable")
        out.append((key[order], at[order]))
    return out


def _pair_links(x: list[tuple[np.ndarray, np.ndarray]], y: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places in two texts of the seeds that both have, each run of one with each of the other (_keyed)."""
    found = []
    for (h, p), (g, q) in ((x[0], y[0]), *([(x[1], y[1])] if len(x[1][0]) and len(y[1][0]) else [])):
        lo = np.searchsorted(g, h)
        owner, k = _vec.expand(np.searchsorted(g, h, "right") - lo)
        found.append(p[owner].astype(np.int64) << 32 | q[lo[owner] + k])
    both = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def _chained(w: list[np.ndarray], keyed: list, cover: list[np.ndarray], linked: set, pairs: list[tuple[int, int]], least: int, similarity: float):
    """Mark in cover and linked what the pairs of texts share along the chains of all their common seeds.

    The longest chain of a pair is aligned first; one that lies in words of passages found already is left out where the pair is linked.
    """
    at = 0
    while at < len(pairs):
        held, size = [], 0
        while at < len(pairs) and size < LINKS:
            x, y = pairs[at]
            at += 1
            p, q = _pair_links(keyed[x], keyed[y])
            if len(p) and min(p.max() - p.min(), q.max() - q.min()) + SEED + SPARE >= least:
                held.append((x, y, p, q))
                size += len(p)
        if not held:
            continue
        n = [len(p) for _, _, p, _ in held]
        a, b = (np.repeat([r[k] for r in held], n) for k in (0, 1))
        links = [a, np.concatenate([r[2] for r in held]), b, np.concatenate([r[3] for r in held]), np.full(len(a), SEED)]
        for t in chains([pa.RecordBatch.from_arrays([pa.array(c) for c in links], ["da", "pa", "db", "pb", "n"])], least):
            for r in sorted(t.to_pylist(), key=lambda r: (r["da"], r["db"], -sum(r["n"]))):
                x, y, a, b, n = (r[k] for k in ("da", "db", "a", "b", "n"))
                if (x, y) in linked and cover[x][a[0] : a[-1] + n[-1]].all() and cover[y][b[0] : b[-1] + n[-1]].all():
                    continue
                for s, e, u, v, _ in align(w[x], w[y], np.array(a), np.array(b), n, least, similarity):
                    linked.add((x, y))
                    cover[x][s:e] = True
                    cover[y][u:v] = True


def _left_over(seeds: list, cover: list[np.ndarray], linked: list[np.ndarray], width: int) -> list[tuple[int, int]]:
    """Pairs of linked texts with common seeds outside their passages so far that lie width words apart: there may be more on other diagonals."""
    n = np.array([len(h) for h, _ in seeds])
    owner = np.repeat(np.arange(len(seeds)), n)
    h, pos = (np.concatenate([x[k] for x in seeds]) for k in (0, 1))
    begins = np.repeat(np.cumsum([0, *(len(c) for c in cover[:-1])]), n)
    words = np.concatenate(cover)
    bare = ~(words[begins + pos] & words[begins + pos + SEED - 1])
    codes, group = np.unique(h, return_inverse=True)
    of = np.unique(group << 32 | owner)  # which texts have a seed, by seed
    size = np.bincount(of >> 32, minlength=len(codes))
    start, of = np.cumsum(size) - size, of & 0xFFFFFFFF
    bare &= size[group] > 1
    at, out = np.append(0, np.cumsum(n)), []
    for x in np.unique(owner[bare]).tolist():
        if not len(linked[x]):
            continue
        rows = np.flatnonzero(bare[at[x] : at[x + 1]]) + at[x]
        if np.ptp(pos[rows]) < width:
            continue
        k, step = _vec.expand(size[group[rows]])
        y, p = of[start[group[rows]][k] + step], pos[rows][k]
        mine = np.zeros(len(seeds), bool)
        mine[linked[x]] = True
        y, p = y[mine[y]], p[mine[y]]
        order = np.argsort(y, kind="stable")
        y, p = y[order], p[order]
        first = np.flatnonzero(np.r_[True, y[1:] != y[:-1]]) if len(y) else np.zeros(0, int)
        if len(first):
            far = np.maximum.reduceat(p, first) - np.minimum.reduceat(p, first) >= width
            out += [(min(x, v), max(x, v)) for v in y[first][far].tolist()]
    return sorted(set(out))


def settle(batches, least: int, similarity: float):
    """Rows (h, i, j, doc, others, text), sorted: each group's documents with those they may share passages with -> (doc, root, others, spans).

    Every pair is settled: at once where a passage lies on the diagonal of the seed, else along the chains of all seeds that both
    texts have. others are the ids with a shared passage and spans the words in those, as bytes; root is the smallest id that the links here reach.
    """
    for t in _vec.in_groups(batches, ["h", "i", "j"], 400):
        h, i, j, doc = (t[x].to_numpy() for x in ("h", "i", "j", "doc"))
        ids, first, own = np.unique(doc, return_index=True, return_inverse=True)
        text = t["text"].combine_chunks().take(pa.array(first))
        w, seeds, keyed = [], [], []
        for _, buf, off in _vec.pieces(text):
            _, _, hashes, at = _vec.words(buf, off)
            codes = (hashes & _LOW).astype(np.uint32)
            w += [codes[p:q] for p, q in zip(at[:-1].tolist(), at[1:].tolist())]
            owner, g, pos = got if (got := seeds_of(buf, off, least)) is not None else [np.zeros(0, np.int64)] * 3
            order = np.lexsort((pos, g.view(np.int64), owner))
            owner, g, pos = owner[order], g.view(np.int64)[order], pos[order]
            cut = np.searchsorted(owner, np.arange(len(off)))
            seeds += [(g[p:q], pos[p:q]) for p, q in zip(cut[:-1].tolist(), cut[1:].tolist())]
            keyed += [_keyed(g[p:q], pos[p:q]) for p, q in zip(cut[:-1].tolist(), cut[1:].tolist())]
        lists = t["others"].combine_chunks()
        ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), np.searchsorted(ids, lists.flatten().to_numpy())
        cover = [np.zeros(len(x), bool) for x in w]
        linked: list[list[np.ndarray]] = [[] for _ in w]
        later = []
        bounds = np.append(np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]), len(h))
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
            place = [0] * len(w)
            if i[lo] >= 0:
                for x in own[lo:hi].tolist():
                    place[x] = int(seeds[x][1][np.searchsorted(seeds[x][0], h[lo])])
            for k in range(lo, hi):
                x, ys = int(own[k]), flat[ends[k] : ends[k + 1]]
                if i[lo] >= 0:
                    ok, words = _on_a_line(w, place, x, ys, least, similarity)
                    cover[x] |= words
                    linked[x].append(ys[ok])
                    ys = ys[~ok]
                later.append(np.stack([np.full(len(ys), x), ys])[:, ys > x])
        pairs = np.concatenate(later, axis=1)
        pairs = np.unique(pairs[0] << 32 | pairs[1])
        hits: set[tuple[int, int]] = set()
        _chained(w, keyed, cover, hits, list(zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist())), least, similarity)
        for x, y in hits:
            linked[x].append(np.array([y]))
            linked[y].append(np.array([x]))
        linked = [np.unique(np.concatenate(c)) if c else np.zeros(0, np.int64) for c in linked]
        more = [p for p in _left_over(seeds, cover, linked, least - SPARE - SEED) if p not in hits]
        _chained(w, keyed, cover, set(more), more, least, similarity)
        some = [x for x, c in enumerate(linked) if len(c)]
        root, before = np.arange(len(ids)), None
        while before is None or (root != before).any():
            before = root.copy()
            for x in some:
                least_root = min(root[x], root[linked[x]].min())
                root[x] = root[linked[x]] = least_root
        spans = [np.flatnonzero(np.diff(cover[x], prepend=False, append=False)).astype(np.int32).tobytes() for x in some]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[some]), pa.array(ids[root[some]]), pa.array([ids[linked[x]].tobytes() for x in some], pa.binary()), pa.array(spans, pa.binary())], ["doc", "root", "others", "spans"]
        )


def gathered(batches):
    """Rows of settle() sorted by document -> (document, number of different others, spans joined where they overlap or meet)."""
    for t in _vec.in_groups(batches, ["doc"], 1000):
        doc, others, spans = t["doc"].to_numpy(), t["others"].to_pylist(), t["spans"].to_pylist()
        bounds = np.append(np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)).tolist()
        links, joined = [], []
        for lo, hi in zip(bounds, bounds[1:]):
            links.append(len(np.unique(np.frombuffer(b"".join(others[lo:hi]), np.int64))))
            both = np.frombuffer(b"".join(spans[lo:hi]), np.int32).reshape(-1, 2)
            both = both[np.argsort(both[:, 0], kind="stable")]
            upto = np.maximum.accumulate(both[:, 1])
            begins = np.flatnonzero(np.r_[True, both[1:, 0] > upto[:-1]])
            joined.append([{"s": s, "e": e} for s, e in zip(both[begins, 0].tolist(), upto[np.append(begins[1:], len(both)) - 1].tolist())])
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays([pa.array(doc[bounds[:-1]]), pa.array(links, pa.int64()), pa.array(joined, kind)], ["info_doc", "n_links", "spans"])


def settled(texts: DataFrame, least: int, similarity: float) -> DataFrame:
    """texts(doc long, text) of different texts -> rows of settle(), all pairs with a chain of seeds that can be a passage among them.

    Pairs with a seed of few documents are candidates if such seeds lie wide enough apart or either text's other seeds may help;
    pairs that meet in seeds of more documents are found by what stands around these (`contexts`, `candidates`).
    """
    spark = texts.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def seed(batches):
        for b in batches:
            for at, buf, off in _vec.pieces(b.column(1)):
                if (got := seeds_of(buf, off, least)) is not None:
                    owner, h, pos = got
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(owner + at)), pa.array(pos.astype(np.int32))], ["h", "doc", "pos"])

    met = _io.cut(
        texts.mapInArrow(seed, "h long, doc long, pos int")
        .repartition("h")
        .sortWithinPartitions("h", "doc", "pos")
        .mapInArrow(meetings, "h long, da long, pa int, db long, pb int")
    )
    often = met.where("h is not null").select("h", F.col("da").alias("doc"), F.col("pa").alias("pos"))
    around = _io.cut(
        often.repartition("doc").sortWithinPartitions("doc", "pos").mapInArrow(lambda it: contexts(it, least), "h long, doc long, close int, direct int, far int, codes binary")
    )
    large = around.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("h").alias("large"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = around.join(large, around["h"] == large["large"], "left").select("h", "doc", "close", "direct", "far", "codes", parts.alias("parts"), F.pmod(F.xxhash64("doc"), parts).cast("int").alias("b"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o")
    asked = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "doc").mapInArrow(candidates, "h long, i int, j int, doc long, others array<long>")
    wide = lambda c: F.max(c) - F.min(c)
    few = met.where("h is null").groupBy("da", "db").agg(F.least(wide("pa"), wide("pb")).alias("width"))
    helped = often.select(F.col("doc").alias("of")).distinct()
    few = few.join(helped.withColumnRenamed("of", "of_a"), F.col("da") == F.col("of_a"), "left").join(helped.withColumnRenamed("of", "of_b"), F.col("db") == F.col("of_b"), "left")
    few = _io.cut(few.where((F.col("width") + SEED + SPARE >= least) | F.col("of_a").isNotNull() & F.col("of_b").isNotNull()).select("da", "db"))
    sides = few.groupBy("da").agg(F.collect_list("db").alias("others")).select(F.col("da").alias("h"), F.col("da").alias("doc"), "others")
    sides = sides.unionByName(few.select(F.col("da").alias("h"), F.col("db").alias("doc"), F.array("da").alias("others")))
    asked = _io.cut(asked.unionByName(sides.select("h", F.lit(-1).alias("i"), F.lit(0).alias("j"), "doc", "others")))
    _io.small_batches(spark)
    known = texts.withColumnRenamed("doc", "text_doc")
    whole = asked.join(known, F.col("doc") == F.col("text_doc")).select("h", "i", "j", "doc", "others", "text")
    return whole.repartition(n_tasks, "h", "i", "j").sortWithinPartitions("h", "i", "j", "doc").mapInArrow(
        lambda it: settle(it, least, similarity), "doc long, root long, others binary, spans binary"
    )


def fuzzy_passages(docs: DataFrame, least: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_class, class_id, n_copies, n_links, n_spans, dup_words, spans.

    text_class is the smallest doc_id with the same text, class_id the smallest doc_id reached over
    links and copies, n_copies the other rows of the same text. Two texts are linked if they share a
    passage of at least `least` words of which `similarity` or more are equal in order; spans are the
    text's shared passages (first word, end), joined where they overlap. All pairs of texts with a chain of common seeds that
    can be a passage are settled, whatever their number (`settled`).
    n_links counts the texts that a text shares a passage with. A text with copies
    is itself a shared passage if it has `least` words. Null text counts as empty, very long texts are seeded whole; rows without
    an id come back with nulls; rows of one id count as one document; other columns may have any names. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    _io.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = _io.cut(rows.select("doc", F.md5("text").alias("mark"), (F.octet_length("text") > 0).alias("full")))
    classes = marks.where("doc is not null").groupBy("mark").agg(F.min("doc").alias("text_class"), F.count("*").alias("rows"), F.max("full").alias("full"))
    members = _io.cut(marks.select("doc", "mark").join(classes, "mark", "left").select("doc", "text_class", "rows", "full"))
    copies = members.where("doc != text_class").select(F.col("doc").alias("copy")).distinct()
    n_copies = copies.count()
    known = rows.where("doc is not null")
    texts = known.join(_io.sized(copies, n_copies * 16), known["doc"] == copies["copy"], "left_anti").select("doc", "text")
    found = _io.cut(settled(texts, least, similarity))
    stars = graph.components(found.select(F.col("doc").alias("u"), F.col("root").alias("v")))
    info = found.repartition("doc").sortWithinPartitions("doc").mapInArrow(gathered, "info_doc long, n_links long, spans array<struct<s:int,e:int>>")
    info = info.join(stars, F.col("info_doc") == F.col("u"), "left").select("info_doc", "n_links", "spans", F.coalesce("root", "info_doc").alias("class_id"))
    out = members.join(info, members["text_class"] == info["info_doc"], "left")
    return out.select(
        F.col("doc").alias("doc_id"),
        F.when(F.col("doc").isNotNull(), F.col("text_class")).alias("text_class"),
        F.when(F.col("doc").isNotNull(), F.coalesce("class_id", "text_class")).alias("class_id"),
        F.when(F.col("doc").isNotNull(), F.col("rows") - 1).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
        F.coalesce(F.expr("aggregate(spans, 0, (n, x) -> n + x.e - x.s)"), F.lit(0)).alias("dup_words"),
        "spans",
    )
