"""Unit-cost edit distances of many pairs at once, bit-parallel, in Arrow batches.

Where one side begins the other, their lengths tell; of others, equal beginnings and ends are left out. Of equally long sides with many changes
only the stretches where insertions and deletions could beat changes in place are worked out (`_in_place`). A word of bits
holds 16, 32 or 64 diagonals of the pair's matrix, and a column is a few operations on whole arrays of pairs. A distance inside the
band is exact if no path outside can be shorter; the other pairs go again with a band of twice the width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that go together, items of either side at once, widest band in words of 64 bits, longest side in a band, most kinds of items in a table, fewest pairs a word, fewest
#: pairs that are worth columns of their own.
PAIRS, ITEMS, WIDEST, LONGEST, KINDS, FEW, APART = 1 << 13, 1 << 24, 16, 1 << 11, 128, 16, 512
#: Farthest diagonal that `_doubtful` looks at, items that go through it at once, and changes that are too few for it: they fit the narrowest band.
REACH, STEP, NARROW = 63, 1 << 19, 15


def _flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... n places of each."""
    ends = np.cumsum(n)
    size = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if size and int(start.max()) + size < 1 << 31 else np.int64
    out = np.repeat((start - ends + n).astype(kind), n)
    out += np.arange(size, dtype=kind)
    return out


def _table(p: np.ndarray, kinds: int, kind: type) -> np.ndarray:
    """(word, kind, row): the places of each kind of item in the rows of p, as bits."""
    out = np.empty((p.shape[1] // (8 * kind().itemsize), kinds, len(p)), kind)
    for k in range(kinds):
        out[:, k] = np.packbits((p == k).reshape(-1), bitorder="little").view(kind).reshape(len(p), -1).T
    return out


def _matches(t: np.ndarray, p: np.ndarray, alive: np.ndarray, kinds: int, width: int, kind: type):
    """A column after the other: which of the rows in the band, of width words, hold its item, (word, pair).

    Few kinds of items are looked up in a table of their places, else the rows are compared.
    """
    size = 8 * kind().itemsize
    if kinds > KINDS:
        for c, k in enumerate(alive.tolist()):
            equal = p[:k, c : c + size * width] == t[:k, c : c + 1]
            yield np.packbits(equal.reshape(-1), bitorder="little").view(kind).reshape(k, width).T
        return
    table = _table(p, kinds, kind).reshape(p.shape[1] // size, -1)
    at = t.T.astype(np.int64) * len(p) + np.arange(len(p))
    for c, k in enumerate(alive.tolist()):
        word, bit = c // size, c % size
        found = [table[word + w].take(at[c, :k]) for w in range(width + (bit > 0))]
        yield [found[w] >> kind(bit) | found[w + 1] << kind(size - bit) for w in range(width)] if bit else found


def _banded(text: np.ndarray, i: np.ndarray, n: np.ndarray, pattern: np.ndarray, j: np.ndarray, m: np.ndarray, width: int, kinds: int, word: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(distance, whether exact) of n >= m items below kinds, sorted by falling n, in a band of width words of diagonals."""
    size, one = 8 * word().itemsize, word(1)
    bits, delta = size * width, n - m
    below = (bits - 1 - delta) // 2  # diagonals below the last cell's, and above the first one's
    kind = _kind(kinds)
    rows = np.repeat(np.arange(len(n), dtype=np.int32), n)
    t = np.zeros((len(n), int(n[0])), kind)
    t[rows, _flat(np.zeros_like(n), n)] = text[_flat(i, n)]
    rows = np.repeat(np.arange(len(n), dtype=np.int32), m)
    p = np.full((len(n), -(-int(n[0]) // size) * size + bits), kinds, kind)
    p[rows, _flat(delta + below, m)] = pattern[_flat(j, m)]
    # Rows of the matrix from 1 on rise by one in column 0, the rows above it are level.
    lead = (delta + below)[None, :] - size * np.arange(width)[:, None]
    vp = np.where(lead >= size, word(0), ~word(0) << np.clip(lead, 0, size - 1).astype(word))
    vn = np.zeros_like(vp)
    last, bit = below // size, (below % size).astype(word)
    each, hits = np.arange(len(n)), np.zeros(len(n), word)
    d, spare = np.empty_like(vp), np.empty((3, len(n)), word)
    alive = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), "right")  # pairs that reach a column
    for k, match in zip(alive.tolist(), _matches(t, p, alive, kinds, width, word)):
        x, y, z = (o[:k] for o in spare)
        carry = None
        for w in range(width):
            pm, up, now = match[w], vp[w, :k], d[w, :k]
            np.bitwise_and(pm, up, out=now)
            now += up
            if width > 1:
                over = now < up
                if carry is not None:
                    now += carry
                    over |= now < carry
                carry = over.astype(word)
            now ^= up
            now |= pm
            now |= vn[w, :k]
        np.right_shift(d[0, :k] if width == 1 else d[last[:k], each[:k]], bit[:k], out=x)
        x &= one
        hits[:k] += x
        for w in range(width):
            now, up, down = d[w, :k], vp[w, :k], vn[w, :k]
            np.bitwise_or(now, up, out=x)
            np.invert(x, out=x)
            x |= down  # rises along the row
            np.bitwise_and(now, up, out=y)  # falls along the row
            np.right_shift(now, one, out=z)
            if w + 1 < width:
                z |= d[w + 1, :k] << word(size - 1)
            np.bitwise_and(z, x, out=down)
            z |= x
            np.invert(z, out=z)
            np.bitwise_or(z, y, out=up)
    far = n - hits.astype(np.int64)
    return far, far <= 2 * below + delta + 1


def _whole(text: list, pattern: list) -> int:
    """The distance of one long pair: a column of the matrix in one big integer."""
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    vp, vn, far = full, 0, len(pattern)
    for c in text:
        x = masks.get(c, 0) | vn
        d = (((x & vp) + vp) ^ vp) | x
        hp, hn = (vn | ~(d | vp)) & full, d & vp
        far += bool(hp & last) - bool(hn & last)
        hp = hp << 1 | 1
        vp, vn = (hn << 1 | ~(d | hp)) & full, hp & d & full
    return far


def _coded(items: np.ndarray) -> tuple[np.ndarray, int]:
    """items as 0, 1, ..., and how many different ones there are."""
    seen = np.zeros(int(items.max(initial=0)) + 1, bool)
    seen[items] = True
    kinds = int(seen.sum())
    return (np.cumsum(seen) - 1).astype(_kind(kinds))[items], kinds


def _kind(kinds: int) -> type:
    """The smallest type that holds the codes and one more."""
    return np.uint8 if kinds < 1 << 8 else np.uint16 if kinds < 1 << 16 else np.uint32


def _groups(n: np.ndarray) -> Iterator[slice]:
    """Stretches of at most PAIRS falling sizes, none of fewer than half the first one's but for a short rest."""
    lo = 0
    while lo < len(n):
        hi = min(lo + PAIRS, len(n))
        half = int(np.searchsorted(-n, -(n[lo] // 2), "left"))
        if half - lo >= APART and hi - half >= APART:
            hi = half
        yield slice(lo, hi)
        lo = hi


def _ends(differ: np.ndarray, start: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal items before the first and after the last difference of rows; those without one have n of them after it."""
    found = np.flatnonzero(differ)
    start, n = start[rows], n[rows]
    lo, hi = np.searchsorted(found, start), np.searchsorted(found, start + n)
    some = hi > lo
    head = np.where(some, found[np.minimum(lo, len(found) - 1)] - start, n) if len(found) else n
    tail = np.where(some, start + n - 1 - found[np.maximum(hi, 1) - 1], n) if len(found) else n
    return head, tail


def _hard(both: np.ndarray, i: np.ndarray, n: np.ndarray, j: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Distances of n items of both from i on and m <= n from j on, of which apart differ place by place."""
    out = np.zeros(len(n), np.int64)
    if not len(n):
        return out
    both, kinds = _coded(np.concatenate([both[_flat(i, n)], both[_flat(j, m)]]))
    i, j = np.cumsum(n) - n, np.cumsum(m) - m + int(n.sum())
    hard, delta = np.arange(len(n)), n - m
    # Items changed place by place, and those over, bound the distance: a narrow band that holds it is enough.
    most = apart + delta
    for word, bits in ((np.uint16, 16), (np.uint32, 32)):
        fits = (delta[hard] < bits) & (most[hard] <= 2 * ((bits - 1 - delta[hard]) // 2) + delta[hard] + 1) & (n[hard] <= LONGEST)
        if np.count_nonzero(fits) < FEW:
            continue
        narrow, hard = hard[fits], hard[~fits]
        narrow = narrow[np.lexsort((m[narrow], -n[narrow]))]
        for group in _groups(n[narrow]):
            h = narrow[group]
            out[h] = _banded(both, i[h], n[h], both, j[h], m[h], 1, kinds, word)[0]
    first = np.where((apart <= n // 3) & (apart > 64 - delta), 2, 1)
    later, hard = hard[first[hard] > 1], hard[first[hard] == 1]
    width = 1
    while len(hard) or len(later):
        if width == 2:
            hard, later = np.concatenate([hard, later]), later[:0]
        hard = hard[np.lexsort((m[hard], -n[hard]))]
        near = (n[hard] <= LONGEST) & (width <= WIDEST) & (len(hard) >= FEW * width)
        for k in hard[~near].tolist():
            out[k] = _whole(both[i[k] : i[k] + n[k]].tolist(), both[j[k] : j[k] + m[k]].tolist())
        hard = hard[near]
        fits, left = hard[n[hard] - m[hard] < 64 * width], [hard[n[hard] - m[hard] >= 64 * width]]
        for group in _groups(n[fits]):
            h = fits[group]
            far, exact = _banded(both, i[h], n[h], both, j[h], m[h], width, kinds)
            out[h[exact]] = far[exact]
            left.append(h[~exact])
        hard = np.concatenate(left)
        width *= 2
    return out


def _stretches(weight: np.ndarray, least: int, changed: np.ndarray, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, one after the last) of the places in any stretch of weight least or more; joined ones with fewest changed or more."""
    p = np.cumsum(weight, dtype=np.int64)
    before = np.append(0, np.minimum(np.minimum.accumulate(p[:-1]), 0))
    inside = np.maximum.accumulate(p[::-1])[::-1] - before >= least
    ends = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2)
    total = np.append(0, np.cumsum(changed, dtype=np.int64))
    return tuple(ends[total[ends[:, 1]] - total[ends[:, 0]] >= fewest].T)


def _doubtful(both: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """(row, first place, size) of the stretches of n items of both from i and from j on where changes in place may not be the shortest way.

    A way through the matrix that beats the changes in place leaves the main diagonal and comes back, and somewhere
    does so for less than the h changes it goes round. Going k diagonals off takes 2 * k steps aside at least, so h > 2 * k.
    - k <= 2: h is 2 more, at least, than the rows whose item stands on none of the four diagonals at hand. Each of them is a
      change or a step aside, and besides there is a step along the other side.
    - k > 2: of the pairs of rows on its way, all but the first and last that stand as a whole on no diagonal at hand
      take a change or a step aside each, so h is more than these. Three times h less twice these is then 2 * k - 1 at least.
    - k > 7: likewise blocks of four rows, which take as many as their two pairs, or one if they as a whole stand on none; the first
      and last have four at most, so three times h less twice the others' is 2 * k - 5 at least.
    """
    items = np.concatenate([both[_flat(i, n)], both[_flat(j, n)]])
    kinds = int(items.max()) + 1
    if kinds > 255:
        items, kinds = _coded(items)
    if kinds >= 1 << 16:  # too many kinds for a block: all rows as they are
        return np.stack([np.arange(len(n)), np.zeros_like(n), n])
    kind = _kind(kinds)
    edge, length = REACH + 8 & ~3, (n + 3 & ~3) + 4  # padding ends each row
    start = edge + np.cumsum(length) - length
    size = int(length.sum())
    x, y = np.full((2, size + 2 * edge), kinds, kind)
    at = _flat(start, n)
    x[at], y[at] = items[: len(at)], items[len(at) :]
    differ, barrier = x != y, -6 * int(n.max()) - 6
    off = (x[2:-2] != y[1:-3]) & (x[2:-2] != y[3:-1]) & (x[2:-2] != y[:-4]) & (x[2:-2] != y[4:])
    weight = differ[2:-2].astype(np.int32)
    weight -= off
    weight[start - 3] = weight[start + length - 3] = barrier
    inside = np.zeros(len(x), bool)
    s, e = _stretches(weight, 2, differ[2:-2], 3)
    inside[_flat(s + 2, e - s)] = True
    none, tried, shifted = {}, {2: 0, 4: 0}, {}
    pairs = differ[edge : edge + size].view(np.int8)
    pairs = pairs[::2] + pairs[1::2]
    for nearest, farthest, many in ((3, 7, 2), (8, 15, 4), (16, 31, 4), (32, REACH, 4)):
        if 2 * nearest >= int(apart.max()):
            break
        for w in (2, 4)[: many // 2]:
            word, lo, hi = f"u{w * x.itemsize}", edge // w, (edge + size) // w
            here = x.view(word)[lo:hi]
            if w not in none:
                shifted[w] = [y[r : len(y) - 4 + r].copy().view(word) for r in range(w)]
                none[w] = np.ones(hi - lo, bool)
                none[w][((start + n - edge) // w)[n % w > 0]] = False  # the last one of a row is not full
            for k in range(tried[w] + 1, farthest + 1):
                for t, r in (divmod(k, w), divmod(-k, w)):
                    none[w] &= here != shifted[w][r][lo + t : hi + t]
            tried[w] = farthest
        changed, steps = pairs, none[2].view(np.int8)
        if many == 4:
            changed, steps = pairs[::2] + pairs[1::2], np.maximum(none[4].view(np.int8), steps[::2] + steps[1::2])
        weight = 3 * changed.astype(np.int32)
        weight -= 2 * steps.astype(np.int32)
        weight[(start + length - edge) // many - 1] = barrier
        s, e = _stretches(weight, 2 * nearest - (1 if many == 2 else 5), changed, 2 * nearest + 1)
        inside[_flat(many * s + edge, many * (e - s))] = True
    s, e = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2).T
    row = np.searchsorted(start, s, "right") - 1
    return np.stack([row, s - start[row], np.minimum(e, (start + n)[row]) - s])


def _in_place(both: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Distances of n items of both from i and from j on, which differ in apart <= 2 * REACH + 2 places: only doubtful stretches are worked out."""
    found = [np.zeros((3, 0), np.int64)]
    order = np.argsort(apart, kind="stable")
    for h in np.split(order, np.flatnonzero(np.diff(np.cumsum(n[order]) // STEP)) + 1):
        row, first, size = _doubtful(both, i[h], j[h], n[h], apart[h])
        found.append(np.stack([h[row], first, size]))
    row, first, size = np.concatenate(found, axis=1)
    i, j = i[row] + first, j[row] + first
    changed = np.add.reduceat(both[_flat(i, size)] != both[_flat(j, size)], np.cumsum(size) - size, dtype=np.int64) if len(row) else size
    return apart - np.bincount(row, changed - _hard(both, i, size, j, size, changed), len(n)).astype(np.int64)


def distances(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Distances of a[a_at[k]:a_at[k + 1]] and b[b_at[k]:b_at[k + 1]], both whole numbers."""
    out = np.zeros(len(a_at) - 1, np.int64)
    sizes = np.maximum(np.diff(a_at), np.diff(b_at))
    part = (np.cumsum(sizes) - sizes) // ITEMS
    for g in np.unique(part):
        rows = np.flatnonzero(part == g)
        i, n, j, m = a_at[rows], np.diff(a_at)[rows], b_at[rows], np.diff(b_at)[rows]
        low = np.minimum(n, m)
        both = [x[at[rows[0]] : at[rows[-1] + 1]] for x, at in ((a, a_at), (b, b_at))]
        level = (n == m).all()
        differ = np.append(both[0] != both[1] if level else a[_flat(i, low)] != b[_flat(j, low)], False)
        apart = np.where(low > 0, np.add.reduceat(differ, np.cumsum(low) - low, dtype=np.int64), 0)
        out[rows] = np.maximum(n, m)  # where a side is empty
        begins = (low > 0) & (apart == 0)
        out[rows[begins]] = np.abs(n - m)[begins]
        # Of equally long sides, one or two changed items are the distance: less would change fewer.
        few = (n == m) & (apart > 0) & (apart < 3)
        out[rows[few]] = apart[few]
        hard = np.flatnonzero((apart > 0) & ~few)
        both = np.concatenate(both)
        i, j = i - a_at[rows[0]], j - b_at[rows[0]] + (a_at[rows[-1] + 1] - a_at[rows[0]])
        swap = n < m
        i, j, n, m = np.where(swap, j, i), np.where(swap, i, j), np.where(swap, m, n), np.where(swap, n, m)
        # Equal beginnings and ends change no distance.
        head, tail = _ends(differ, np.cumsum(low) - low, low, hard)
        odd = n[hard] > m[hard]
        if odd.any():
            h = hard[odd]
            back = np.append(both[_flat(i[h] + n[h] - m[h], m[h])] != both[_flat(j[h], m[h])], True)
            tail[odd] = np.minimum(_ends(back, np.cumsum(m[h]) - m[h], m[h], np.arange(len(h)))[1], m[h] - head[odd])
        i[hard] += head
        j[hard] += head
        n[hard] -= head + tail
        m[hard] -= head + tail
        out[rows[hard]] = n[hard]  # where nothing of a side is left
        hard = hard[m[hard] > 0]
        near = (n[hard] == m[hard]) & (apart[hard] > NARROW) & (apart[hard] <= 2 * REACH + 2) & (n[hard] <= LONGEST)
        near, hard = hard[near], hard[~near]
        if len(near):
            out[rows[near]] = _in_place(both, i[near], j[near], n[near], apart[near])
        out[rows[hard]] = _hard(both, i[hard], n[hard], j[hard], m[hard], apart[hard])
    return out


def together(f: Callable, batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """f of each batch, worked out for several at once: a column costs little more for many pairs than for few."""
    held, size = [], 0

    def done() -> Iterator[pa.Array]:
        out, at = f(*(pa.concat_arrays(c) for c in zip(*held))), 0
        for b in held:
            yield out.slice(at, len(b[0]))
            at += len(b[0])

    for b in batches:
        held.append(b)
        size += sum(c.nbytes for c in b)
        if size >= ITEMS:
            yield from done()
            held, size = [], 0
    if held:
        yield from done()


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    text = bytes(data)[ends[0] : ends[-1]] if data else b""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=at[1:])
    return np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32), at


def _nulls(far: np.ndarray, a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(far.astype(np.int32), mask=pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False))


def of_texts(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distances in code points; null where a side is."""
    return _nulls(distances(*_points(a), *_points(b)), a, b)


def _items(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items of either side's lists in a row, as numbers of one code, and where each list starts."""
    x, y = a.flatten(), b.flatten()
    codes = pa.concat_arrays([x, y]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    at = [np.append(0, np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64) for c in (a, b)]
    return codes[: len(x)], at[0], codes[len(x) :], at[1]


def of_lists(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distances in items of lists; null where a side is."""
    return _nulls(distances(*_items(a, b)), a, b)


def of_words(a: pa.Array, b: pa.Array) -> pa.Array:
    """Distances in words of texts with one space between words; null where a side is."""
    lists = []
    for texts in (a, b):
        none = pc.equal(texts, "")
        split = pc.split_pattern(texts, " ")
        n = np.append(0, pc.subtract(pc.list_value_length(split), none.cast(pa.int32())).fill_null(0).to_numpy(zero_copy_only=False)).cumsum()
        words = split.flatten()
        lists.append(pa.ListArray.from_arrays(pa.array(n, pa.int32()), words.filter(pc.not_equal(words, "")) if pc.any(none).as_py() else words))
    return _nulls(distances(*_items(*lists)), a, b)


def shared(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many items two lists have in common, as often as both hold them; null where a side is."""
    x, x_at, y, y_at = _items(a, b)
    (x, n), (y, m) = (np.unique(np.repeat(np.arange(len(a)), np.diff(at)) << 32 | c, return_counts=True) for c, at in ((x, x_at), (y, y_at)))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return _nulls(np.bincount(both >> 32, np.minimum(n[i], m[j]), len(a)), a, b)
