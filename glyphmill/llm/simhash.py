"""SimHash fingerprints and their near-duplicate classes by a binary-trie self-join."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import _io, _vec, graph

#: Bits of a block: two fingerprints within 3 bits agree on one of the four blocks.
BLOCK = 16
#: Trie node pairs handled at once, and node pairs with so few leaf pairs that they are compared directly.
FRONTIER, LEAF_PAIRS = 1 << 18, 48


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of each word shingle; no word: zero."""
    return int(_majority([_hashes(text, shingle)])[0])


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    import xxhash

    w = text.lower().split()  # bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D only
    if not w:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) < shingle:
        return np.array([h(b" ".join(w), 42)], np.uint64)
    n = len(w) - shingle + 1
    return np.fromiter((h(b" ".join(t), 42) for t in zip(*(w[i:] for i in range(shingle)))), np.uint64, n)


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint64)
    for i, h in enumerate(hashes):
        if len(h):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(h), 8192):
                bits = np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int32)
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every whole text; a null text counts as empty and has fingerprint zero."""
    _io.small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = _majority([_hashes(t or b"", shingle) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, fp long")


def trie_pairs(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int, classes: np.ndarray | None = None, also: np.ndarray | None = None):
    """Index pairs (i, j) within budget bits, in chunks; each run [starts, ends) is a subtree of the sorted keys.

    Runs are joined with themselves; those numbered in `also` with the run behind them too.

    A node is a range of keys that share their first bits. Pairs of nodes go down together; a
    pair that takes different branches has one more differing bit, and is pruned beyond the budget.
    With classes, pairs of nodes whose keys are all of one class are pruned too.
    """
    ones: dict[int, np.ndarray] = {}
    turns = None if classes is None else np.concatenate([np.zeros(1, np.int64), np.cumsum(np.r_[False, classes[1:] != classes[:-1]])])
    many = ends - starts > 1
    stack = [(depth, starts[many], ends[many], starts[many], ends[many], np.zeros(int(many.sum()), np.int8))]
    if also is not None:
        stack.append((depth, starts[also], ends[also], starts[also + 1], ends[also + 1], np.zeros(len(also), np.int8)))
    while stack:
        d, a0, a1, b0, b1, err = stack.pop()
        if turns is not None and len(a0):
            settled = (classes[a0] == classes[b0]) & (turns[a1] == turns[a0 + 1]) & (turns[b1] == turns[b0 + 1])
            a0, a1, b0, b1, err = (x[~settled] for x in (a0, a1, b0, b1, err))
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(d, *(x[half:] for x in (a0, a1, b0, b1, err))), (d, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        na, nb = a1 - a0, b1 - b0
        tiny = (na * nb <= LEAF_PAIRS) | (d == 64)
        if tiny.any():
            for lo in range(0, int(tiny.sum()), 1 << 15):
                k = np.flatnonzero(tiny)[lo : lo + (1 << 15)]
                if d == 64:  # all keys of a node are equal; link each to the other node's first
                    owner, place = _vec.expand(na[k] + nb[k])
                    k = k[owner]
                    i = np.where(place < na[k], a0[k] + place, b0[k] + place - na[k])
                    yield i, np.where(place < na[k], b0[k], a0[k])
                    continue
                owner, place = _vec.expand(na[k] * nb[k])
                k = k[owner]
                i, j = a0[k] + place // nb[k], b0[k] + place % nb[k]
                ok = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
                yield i[ok], j[ok]
        if tiny.all():
            continue
        go = ~tiny
        a0, a1, b0, b1, err = (x[go] for x in (a0, a1, b0, b1, err))
        if d not in ones:
            bit = ((keys >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int32)
            ones[d] = np.concatenate([np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)])
        c = ones[d]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        nxt = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        x = [np.concatenate(c) for c in zip(*nxt, tuple(v[~same] for v in (am, a1, b0, bm, err + 1)))]
        keep = (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= budget)
        stack.append((d + 1, *(v[keep] for v in x)))


class Labels:
    """Smallest index linked so far, by union of whole arrays of pairs."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        of = self.of
        while len(i):
            a, b = of[i], of[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = of[of]
                if (up == of).all():
                    break
                of[:] = up


def links(reps: DataFrame, budget: int = 3) -> DataFrame:
    """reps(fp, doc_id) of distinct fingerprints -> edges (u, v) that join all within budget bits.

    Each fingerprint goes to four buckets, one for each of its 16-bit blocks, rotated so that
    the block leads. A bucket is one subtree of the binary trie over all fingerprints; its
    self-join finds every pair in it, and a spanning set of links leaves the task, so dense
    groups do not multiply. A bucket holds distinct fingerprints only.
    """
    n_blocks = 64 // BLOCK
    if budget >= n_blocks:
        raise ValueError(f"at most {n_blocks - 1} differing bits")

    def run(batches):
        for t in _vec.in_groups(batches, ["block", "lead"]):
            block, lead = t["block"].to_numpy(), t["lead"].to_numpy()
            keys, ids = t["key"].to_numpy().view(np.uint64), t["doc_id"].to_numpy()
            order = np.lexsort((keys, lead, block))
            block, lead, keys, ids = block[order], lead[order], keys[order], ids[order]
            edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (lead[1:] != lead[:-1])])
            end = np.r_[edge[1:], len(keys)]
            many = end - edge > 1
            labels = Labels(len(keys))
            for i, j in trie_pairs(keys, edge[many], end[many], BLOCK, budget):
                labels.link(i, j)
            moved = np.flatnonzero(labels.of != np.arange(len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[labels.of[moved]])], ["u", "v"])

    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    return (
        reps.select("doc_id", "fp", blocks)
        .select(
            "doc_id",
            "block",
            F.expr(f"shiftleft(fp, block * {BLOCK}) | if(block = 0, 0L, shiftrightunsigned(fp, 64 - block * {BLOCK}))").alias("key"),
        )
        .withColumn("lead", F.expr(f"shiftrightunsigned(key, {64 - BLOCK})"))
        .repartition("block", "lead")
        .sortWithinPartitions("block", "lead")
        .mapInArrow(run, "u long, v long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Documents whose fingerprints differ in at most budget bits are linked, and links carry on.
    Null and empty texts have fingerprint zero and are linked like any other. Copies fold into
    one fingerprint before the join; repeated rows come back as often as they were given. Rows
    without an id get a fingerprint and no component. Very long texts are hashed whole, and other columns are not
    read, whatever their names. An empty table gives an empty result.
    """
    marks = _io.cut(fingerprints(docs, id_col, text_col, shingle))
    reps = marks.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    stars = graph.components(links(reps, budget))
    roots = (
        reps.join(stars, reps["doc_id"] == stars["u"], "left")
        .select(F.col("fp").alias("rep_fp"), F.coalesce("root", "doc_id").alias("component_id"))
    )
    return marks.join(roots, marks["fp"] == roots["rep_fp"], "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


class Layout(NamedTuple):
    """Of near_copies(): bits of a block, how many of them, the least certain ones, are tried both ways, and blocks."""

    width: int
    flips: int
    blocks: int

    @property
    def words(self) -> int:
        """Fingerprint words of 64 bits that the blocks take."""
        return max(2, -(-self.width * self.blocks // 64))


#: The layouts by growing number of texts. Each finds as many pairs at 0.8 as the first or more; a bucket of the second
#: holds a 32nd of the rows and one of the third a 256th, for three and four times the keys.
LAYOUTS = (Layout(18, 3, 7), Layout(24, 4, 10), Layout(27, 4, 15))
#: Mean rows of a bucket beyond which the next layout is taken.
BUCKET_ROWS = 4096
#: The most differing bits of the first fingerprint word and of the first two.
FIRST, BOTH = 20, 30
#: Of near_copies(): documents of other classes that a document meets in each of its unflipped buckets before the
#: rest is settled class by class.
NEAREST = 4
#: Shingles of a class that one block of its members holds, and documents asked of it in one task.
BLOCK_SHINGLES, CHUNK_ROWS = 1 << 17, 4096


def _sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the distinct word shingles of each text, sorted; of fewer words the whole sequence."""
    _, _, hashes, at = _vec.words(buf, off, _vec.INK, _vec.lower_ascii)
    n = np.diff(at)
    owner, place = _vec.expand(np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1)))
    start = at[owner] + place
    h = _vec.shingle_hash(np.append(hashes, np.zeros(shingle, _vec.U64)), shingle)[start]
    for i in np.flatnonzero(n[owner] < shingle).tolist():
        own = hashes[start[i] : start[i] + n[owner[i]]]
        h[i] = _vec.shingle_hash(own, len(own))[0]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])][: len(h)]
    return h[new], np.searchsorted(owner[new], np.arange(len(off)))


def layout_for(texts: int, bucket_rows: int = BUCKET_ROWS) -> Layout:
    """The first layout whose buckets hold bucket_rows or fewer of so many texts on average, else the widest."""
    return next((x for x in LAYOUTS if texts << x.flips <= bucket_rows << x.width), LAYOUTS[-1])


def _margins(h: np.ndarray, off: np.ndarray, words: int = 2) -> np.ndarray:
    """How many more hashes of each text have a bit than lack it, for the bits of `words` hash words."""
    out = np.zeros((len(off) - 1, 64 * words), np.int32)
    step = (1 << 18) // words
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step, "right")) - 1)
        for at in range(off[lo], off[hi], step):  # a text of many words comes in parts
            own = h[at : min(at + step, off[hi])]
            each = np.stack([own] + [_vec.mix(own + _vec.U64(0x9E3779B97F4A7C15 * k % (1 << 64))) for k in range(1, words)], 1)
            bits = np.unpackbits(each.astype("<u8").view(np.uint8).reshape(len(own), 8 * words), axis=1, bitorder="little")
            some = np.flatnonzero(np.diff(off[lo : hi + 1])) + lo
            if hi == lo + 1:
                out[lo] += 2 * bits.sum(axis=0, dtype=np.int32) - len(own)
            else:
                out[some] = 2 * np.add.reduceat(bits, off[some] - off[lo], axis=0, dtype=np.int32) - (off[some + 1] - off[some])[:, None]
        lo = hi
    return out


def _weak(margins: np.ndarray, lay: Layout) -> np.ndarray:
    """The least certain bits of each block, by their places in the block."""
    part = margins[:, : lay.blocks * lay.width].reshape(len(margins), lay.blocks, lay.width)
    return np.argsort(np.abs(part), axis=2, kind="stable")[:, :, : lay.flips]


def probes(margins: np.ndarray, lay: Layout = LAYOUTS[0]) -> np.ndarray:
    """Bucket keys of each text: every block as it is and with its least certain bits the other way."""
    n = len(margins)
    part = margins[:, : lay.blocks * lay.width].reshape(n, lay.blocks, lay.width)
    value = ((part > 0) << np.arange(lay.width)).sum(axis=2) | np.arange(lay.blocks) << lay.width
    weak = 1 << _weak(margins, lay)
    masks = np.stack([sum((weak[:, :, k] for k in range(lay.flips) if i >> k & 1), np.zeros_like(value)) for i in range(1 << lay.flips)], 2)
    return (value[:, :, None] ^ masks).reshape(n, -1)


def weak_bits(margins: np.ndarray, lay: Layout = LAYOUTS[0]) -> np.ndarray:
    """The bits that probes() tries both ways, as masks of fingerprint words."""
    out = np.zeros(margins.shape, bool)
    weak = _weak(margins, lay) + np.arange(lay.blocks)[:, None] * lay.width
    np.put_along_axis(out, weak.reshape(len(margins), -1), True, 1)
    return np.packbits(out, axis=1, bitorder="little").view("<i8")


def _block(words: tuple, b: int, width: int) -> np.ndarray:
    """The bits of block b of fingerprint words."""
    word, at = divmod(b * width, 64)
    v = words[word] >> np.uint64(at)
    if at + width > 64:
        v = v | words[word + 1] << np.uint64(64 - at)
    return v & np.uint64((1 << width) - 1)


def first_meeting(key: np.ndarray, differ: tuple, either: tuple, both: tuple, lay: Layout = LAYOUTS[0]) -> np.ndarray:
    """Which pairs meet in bucket `key` first: each pair that shares buckets does so in exactly one of them.

    A pair shares a block's buckets if it differs there in bits only that one of them flips; the keys they share have
    the bits that both flip either way, and the one with zeros there counts, in the lowest such block.
    """
    block, value = key >> lay.width, (key & ((1 << lay.width) - 1)).astype(np.uint64)
    firm = tuple(d & ~e for d, e in zip(differ, either))
    ok = np.ones(len(key), bool)
    for b in range(lay.blocks):
        ok &= (block <= b) | (_block(firm, b, lay.width) != 0)
        ok &= (block != b) | (value & _block(both, b, lay.width) == 0)
    return ok


def _words(prefix: str, lay: Layout) -> list[str]:
    return [f"{prefix}{i}" for i in range(lay.words)]


def _runs(key: np.ndarray, n: np.ndarray, f0: np.ndarray, similarity: float):
    """(order, starts, ends, also) of rows by bucket, step of set size and f0; `also` numbers the runs that the bucket's next step follows.

    Steps are as wide as sizes of similar sets can differ, so each similar pair is of one step or of two neighbours.
    """
    width = max(math.log(1 / similarity) * (1 + 1e-9), 1e-9)
    step = np.floor(np.log(np.maximum(n, 1)) / width).astype(np.int64)
    order = np.lexsort((f0, step, key))
    key, step = key[order], step[order]
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (step[1:] != step[:-1])])
    ends = np.r_[starts[1:], len(key)]
    k, t = key[starts], step[starts]
    return order, starts, ends, np.flatnonzero((k[1:] == k[:-1]) & (t[1:] == t[:-1] + 1))


def _wide(docs: DataFrame, id_col: str, text_col: str, shingle: int, lay: Layout) -> DataFrame:
    """(doc_id, mark, n, f0, f1, ..., w0, w1, ..., keys): a hash of the shingle set, its size, fingerprint words, their flipped bits, bucket keys."""

    def run(batches):
        for b in batches:
            for at, buf, off in _vec.pieces(b.column(1)):
                h, ends = _sets(buf, off, shingle)
                total = np.concatenate([np.zeros(1, _vec.U64), np.cumsum(_vec.mix(h), dtype=np.uint64)])
                m = _margins(h, ends, lay.words)
                f = np.packbits(m > 0, axis=1, bitorder="little").view("<i8")
                keys, weak = probes(m, lay), weak_bits(m, lay)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(off) - 1), pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)), pa.array(np.diff(ends).astype(np.int32)), *(pa.array(x[:, i]) for x in (f, weak) for i in range(lay.words)), lists],
                    ["doc_id", "mark", "n", *_words("f", lay), *_words("w", lay), "keys"],
                )

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, mark long, n int, " + "".join(f"{c} long, " for c in _words("f", lay) + _words("w", lay)) + "keys array<int>")


def _proposals(buckets: DataFrame, similarity: float, most: int) -> DataFrame:
    """buckets(key, doc_id, n, f0, f1, class) -> (a, b): each document with the `most` nearest smaller ids of other classes in each bucket.

    Pairs are within the bit budgets; sets whose sizes alone exclude the similarity are no pair.
    """

    def run(batches):
        for t in _vec.in_groups(batches, ["key"]):
            key, ids, class_, n = (t[x].to_numpy() for x in ("key", "doc_id", "class", "n"))
            f0, f1 = t["f0"].to_numpy().view(np.uint64), t["f1"].to_numpy().view(np.uint64)
            order, starts, ends, also = _runs(key, n, f0, similarity)
            ids, class_, n, f0, f1 = (x[order] for x in (ids, class_, n, f0, f1))
            low, high, far = (np.zeros(0, np.int64) for _ in range(3))
            for i, j in trie_pairs(f0, starts, ends, 0, FIRST, class_, also):
                bits = np.bitwise_count(f0[i] ^ f0[j]) + np.bitwise_count(f1[i] ^ f1[j])
                ok = (bits <= BOTH) & (class_[i] != class_[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
                i, j, bits = i[ok], j[ok], bits[ok].astype(np.int64)
                swap = ids[i] > ids[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                low, high, far = np.concatenate([low, i]), np.concatenate([high, j]), np.concatenate([far, bits])
                low, high, far = _nearest(low, high, far, ids, most)
            yield pa.RecordBatch.from_arrays([pa.array(ids[low]), pa.array(ids[high])], ["a", "b"])

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _nearest(low: np.ndarray, high: np.ndarray, far: np.ndarray, ids: np.ndarray, most: int):
    """The `most` nearest partners of each high, of equal ones those of smaller ids."""
    order = np.lexsort((ids[low], far, high))
    low, high, far = low[order], high[order], far[order]
    first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]][: len(high)])
    rank = np.arange(len(high)) - np.repeat(first, np.diff(np.append(first, len(high))))
    return low[rank < most], high[rank < most], far[rank < most]


def _asked(buckets: DataFrame, similarity: float, lay: Layout) -> DataFrame:
    """buckets(key, doc_id, n, f0, f1, ..., w0, w1, ..., class, size) -> (x, class): documents with a class that holds candidates of theirs.

    Every pair of different classes within the bit budgets counts, in the first bucket that it shares; the document
    of the smaller class asks. A class is asked about once a bucket, however many of its members are near.
    """

    def run(batches):
        for t in _vec.in_groups(batches, ["key"]):
            key, ids, class_, n, size = (t[x].to_numpy() for x in ("key", "doc_id", "class", "n", "size"))
            order, starts, ends, also = _runs(key, n, t["f0"].to_numpy().view(np.uint64), similarity)
            key, ids, class_, n, size = (x[order] for x in (key, ids, class_, n, size))
            f, w = ([t[x].to_numpy().view(np.uint64)[order] for x in _words(c, lay)] for c in "fw")
            f0, f1 = f[:2]
            out = np.zeros((0, 2), np.int64)
            for i, j in trie_pairs(f0, starts, ends, 0, FIRST, class_, also):
                ok = (np.bitwise_count(f0[i] ^ f0[j]) + np.bitwise_count(f1[i] ^ f1[j]) <= BOTH) & (class_[i] != class_[j])
                ok &= np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
                i, j = i[ok], j[ok]
                ok = first_meeting(key[i], [x[i] ^ x[j] for x in f], [x[i] | x[j] for x in w], [x[i] & x[j] for x in w], lay)
                i, j = i[ok], j[ok]
                asks = (size[i] < size[j]) | ((size[i] == size[j]) & (class_[i] > class_[j]))
                new = np.stack([ids[np.where(asks, i, j)], class_[np.where(asks, j, i)]], 1)
                out = np.unique(np.concatenate([out, new]), axis=0)
                if len(out) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["x", "class"])
                    out = out[:0]
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["x", "class"])

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(run, "x long, class long")


def _answered(asked: DataFrame, members: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) from asked(x, class): x with a member of the class that is similar, exactly, if there is one.

    A class's members(doc_id, n, class) lie in blocks of some BLOCK_SHINGLES shingles, each an index of hashes that the
    documents asked of it stream past; of a block that very many ask there are several copies.
    """
    asks = asked.groupBy("class").agg(F.count("*").alias("asks"))
    parts = members.join(asks, "class").groupBy("class", "asks").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    parts = _io.cut(parts.select(F.col("class").alias("of"), "blocks", F.ceil(F.col("asks") / CHUNK_ROWS).cast("int").alias("chunks")))
    held = members.join(parts, F.col("class") == F.col("of")).select(F.col("doc_id").alias("m"), "class", "blocks", "chunks")
    own = _own_sets(held.select("m").union(asked.select("x")), texts, shingle)
    kept = held.join(own, F.col("m") == F.col("doc")).select(
        "class", F.expr("cast(pmod(xxhash64(doc), blocks) as int)").alias("block"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.lit(0).alias("asks"), "doc", "own"
    )
    put = asked.join(parts, F.col("class") == F.col("of")).join(own, F.col("x") == F.col("doc")).select(
        "class", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.expr("cast(pmod(xxhash64(doc), chunks) as int)").alias("chunk"), F.lit(1).alias("asks"), "doc", "own"
    )

    def run(batches):
        place, docs, sets, index = None, [], [], None
        for b in batches:
            found = []
            for at, asks, doc, raw in zip(zip(*(c.to_pylist() for c in b.columns[:3])), *(c.to_pylist() for c in b.columns[3:])):
                if at != place:
                    place, docs, sets, index = at, [], [], None
                h = np.frombuffer(raw, "<u8")
                if not asks:
                    docs.append(doc)
                    sets.append(h)
                elif docs:
                    if index is None:
                        n = np.array([len(s) for s in sets])
                        all_ = np.concatenate(sets)
                        order = np.argsort(all_, kind="stable")
                        index = all_[order], np.repeat(np.arange(len(sets)), n)[order], n
                    hashes, owner, n = index
                    lo, hi = (np.searchsorted(hashes, h, side) for side in ("left", "right"))
                    which, step = _vec.expand(hi - lo)
                    same = np.bincount(owner[lo[which] + step], minlength=len(docs))
                    like = np.flatnonzero(same >= similarity * (len(h) + n - same))
                    if len(like):
                        found.append((doc, docs[like[0]]))
            x, m = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(m, pa.int64())], ["a", "b"])

    at = ["class", "block", "chunk"]
    out = _io.cut(kept.union(put).repartition(*at).sortWithinPartitions(*at, "asks").mapInArrow(run, "a long, b long"))
    for t in (parts, own):
        _io.drop(t)
    return out


def _own_sets(need: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(doc, own) of the texts whose ids are in the one column of need: their sorted shingle hashes, as bytes."""

    def sets(batches):
        for b in batches:
            for at, buf, off in _vec.pieces(b.column(1)):
                h, ends = _sets(buf, off, shingle)
                raw = h.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(off) - 1), pa.array([raw[8 * s : 8 * e] for s, e in zip(ends, ends[1:])], pa.binary())], ["doc", "own"])

    need = _io.cut(need.toDF("need").distinct())
    asked = texts.join(_io.sized(need, need.count() * 16), texts["doc_id"] == need["need"], "left_semi")
    own = _io.cut(asked.mapInArrow(sets, "doc long, own binary"))
    _io.drop(need)
    return own


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least `similarity`, exactly."""

    def compare(batches):
        for b in batches:
            x, y = (c.to_pylist() for c in b.columns[2:])
            ok = []
            for s, t in zip(x, y):
                both = np.sort(np.concatenate([np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")]))
                same = int((both[1:] == both[:-1]).sum())
                ok.append(same >= similarity * (len(both) - same))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    own = _own_sets(pairs.select("a").union(pairs.select("b")), texts, shingle)
    x, y = (own.select(F.col("doc").alias(f"{c}_"), F.col("own").alias(f"own_{c}")) for c in "ab")
    both = pairs.join(x, F.col("a") == F.col("a_")).join(y, F.col("b") == F.col("b_")).select("a", "b", "own_a", "own_b")
    out = _io.cut(both.mapInArrow(compare, "a long, b long"))
    _io.drop(own)
    return out


def _star_links(stars: DataFrame) -> DataFrame:
    """The links (a, b) of classes already found: one to its root from each member, in place of all links that led there."""
    return stars.select(F.col("u").alias("a"), F.col("root").alias("b"))


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id reached over links; rows without an id have none).

    Two texts are linked if the sets of their word shingles have a Jaccard similarity of at least
    `similarity`. Candidates come from the binary-trie self-join of SimHash fingerprints: of
    texts of similarity 0.8 about 19 of 128 bits differ, mostly uncertain ones, so each block (seven of 18 bits) leads
    to its bucket as it is and with its three least certain bits the other way. Where buckets would hold over bucket_rows
    rows on average, more blocks of more bits are taken (LAYOUTS), so that buckets stay short as the table grows. In a bucket
    only sets of sizes that the similarity allows meet. The exact similarity of
    a candidate then decides. In the blocks as they are each document first meets its nearest smaller id, then the
    NEAREST nearest of other classes; these two rounds bring dense groups together with a few pairs a document. What
    is left is settled whole: for every candidate pair of different classes, in any bucket, the document of the smaller
    class is held against all members of the other class, in blocks. So no candidate is left out and no pairs of one class
    are made; a link is lost only if no bucket holds both texts (one pair in a hundred at 0.8, fewer above). Words are split at white
    space, A-Z in lower case; of fewer words than a shingle the whole sequence counts. Texts without
    words are one class. Equal sets fold first; repeated rows come back as often as given. Similarities
    below 0.6 would need a wider budget and raise. An empty table gives an empty result.
    """
    if not 0.6 <= similarity <= 1:
        raise ValueError("similarity must be between 0.6 and 1")
    _io.small_batches(docs.sparkSession)
    lay = layout_for(docs.count(), bucket_rows)
    bits = [*_words("f", lay), *_words("w", lay)]
    marks = _io.cut(_wide(docs, id_col, text_col, shingle, lay))
    reps = _io.cut(
        marks.where("doc_id is not null").groupBy("mark", "n").agg(F.min("doc_id").alias("rep"), *(F.any_value(c).alias(c) for c in (*bits, "keys")))
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = reps.where("n > 0").select(F.col("rep").alias("doc_id"), "n", *bits, "keys")
    own = F.filter("keys", lambda k, i: i % (1 << lay.flips) == 0)  # the blocks as they are
    near = _io.cut(_proposals(rows.select(F.explode(own).alias("key"), "doc_id", "n", "f0", "f1", F.col("doc_id").alias("class")), similarity, 1).distinct())
    links = _similar(near, texts, shingle, similarity)
    stars = graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ranked = rows.join(stars, F.col("doc_id") == F.col("u"), "left").select(F.explode(own).alias("key"), "doc_id", "n", "f0", "f1", F.coalesce("root", "doc_id").alias("class"))
    more = _io.cut(_proposals(ranked, similarity, NEAREST).distinct().join(near, ["a", "b"], "left_anti"))
    links = _star_links(stars).unionByName(_similar(more, texts, shingle, similarity))
    stars = graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = _io.cut(rows.join(stars, F.col("doc_id") == F.col("u"), "left").withColumn("class", F.coalesce("root", "doc_id")).drop("u", "root"))
    sizes = stars.groupBy(F.col("root").alias("of")).agg((F.count("*") + 1).cast("int").alias("size"))
    sized = known.join(sizes, F.col("class") == F.col("of"), "left").select(F.explode("keys").alias("key"), "doc_id", "n", *bits, "class", F.coalesce("size", F.lit(1)).alias("size"))
    asked = _io.cut(_asked(sized, similarity, lay).distinct())
    links = _star_links(stars).unionByName(_answered(asked, known.select("doc_id", "n", "class"), texts, shingle, similarity))
    stars = graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = reps.join(stars, F.col("rep") == F.col("u"), "left").select(F.col("mark").alias("mark_"), F.col("n").alias("n_"), F.coalesce("root", "rep").alias("class_id"))
    joined = marks.join(classes, (F.col("mark") == F.col("mark_")) & (F.col("n") == F.col("n_")), "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs without the documents that another of their near_copies() class stands for (its smallest doc_id stays).

    Rows without a doc_id stay; repeated rows of the doc_id that stays all stay.
    """
    gone = near_copies(docs, similarity, shingle).where("doc_id != class_id").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = _io.cut(gone)
    return docs.join(_io.sized(gone, gone.count() * 32), docs["doc_id"] == gone["gone_id"], "left_anti")
