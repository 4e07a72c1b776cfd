"""Exact removal of long repeated byte strings: anchored contexts instead of all suffixes.

The method asked for, refining the interleave of shard Burrows-Wheeler transforms, needs one pass
over every byte of the corpus for each byte of the string length (400), for each merge; the README
has the figures. This module keeps its aim, repeats across shards without sorting all suffixes:
every window of `length` bytes owns one anchor, its least k-gram, so equal windows have equal
anchors at equal places, and only windows whose anchor recurs are looked at again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import _io, _vec

#: Bytes of the k-gram that anchors a window; a power of two below the length.
ANCHOR = 128
#: Different contexts of one anchor that one task compares; the windows of more are counted one by one.
MOST = 4000
_LOW = np.uint64(0xFFFFFFFF)


def _kgrams(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k bytes in a row, doubled up from single bytes (k a power of two)."""
    h, s = _vec.byte_codes(buf), 1
    while s < k:
        if len(h) <= s:
            return h[:0]
        h = h[:-s] * np.uint64(pow(_vec._MUL, s, 1 << 64)) + h[s:]
        s *= 2
    return _vec.mix(h)


def anchors_of(buf: np.ndarray, off: np.ndarray, length: int, k: int):
    """(text, first window, windows - 1, anchor, k-gram hash, context hash) of each anchor's run of windows."""
    counts = np.maximum(np.diff(off) - length + 1, 0)
    owner, place = _vec.expand(counts)
    if not len(owner):
        return None
    h = _kgrams(buf, k)
    ranked = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones
    p = off[owner] + place
    a = (_vec.window_min(ranked, length - k + 1)[p] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:], len(a)] - 1
    p1, p2, a, text = p[new], p[last], a[new], owner[new]
    prefix = _vec.prefix_hash(_vec.byte_codes(buf))
    where = ((a - p1) << 20 | (p2 - p1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    context = _vec.mix(_vec.span_hash(prefix, p1, p2 + length) ^ where)
    return text, p1 - off[text], p2 - p1, a - off[text], h[a], context


def window_keys(buf: np.ndarray, off: np.ndarray, start: np.ndarray, kgram: np.ndarray, length: int):
    """(context, window, key) of every window of each context; equal keys: equal anchor, place and bytes."""
    owner, place = _vec.expand(np.diff(off) - length + 1)
    left = off[owner] + place
    key = _vec.span_hash(_vec.prefix_hash(_vec.byte_codes(buf)), left, left + length)
    at = (start[owner] - place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return owner, place, _vec.mix(key ^ at) ^ kgram.view(np.uint64)[owner]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text): the key names a row's id and text, so ids may be null or repeat."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return docs.select(F.xxhash64("id", "text").alias("key"), "id", "text")


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, length: int, k: int = ANCHOR) -> DataFrame:
    """(span_key, starts, ends): apart byte spans covered by a string of `length` bytes that starts elsewhere too.

    1. Each run of windows with one anchor gives one row with the hash of its whole context.
    2. Contexts that occur twice are repeated as they stand; counts fold before the shuffle.
    3. Anchors that recur in different contexts: one representative of each context brings its
       bytes to the anchor's group, where its windows are compared one by one. A group has
       different contexts of one anchor, not its occurrences.
    4. Anchors of more than MOST contexts have no group: each window is a row, counted by its hash with
       counts that fold before the shuffle, and windows that occur twice are looked up by a semi-join.
    """
    spark = docs.sparkSession
    _io.small_batches(spark)

    def find(batches):
        for b in batches:
            for at, buf, off in _vec.pieces(b.column(1)):
                if (got := anchors_of(buf, off, length, k)) is None:
                    continue
                text, p1, more, a, kgram, context = got
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(text + at)), *(pa.array(x.astype(np.int32)) for x in (p1, more, a)), pa.array(kgram.view(np.int64)), pa.array(context.view(np.int64))],
                    ["key", "p1", "more", "a", "kgram", "context"],
                )

    rows = _keyed(docs, id_col, text_col)
    long_enough = rows.where(F.octet_length("text") >= length)
    found = _io.cut(long_enough.select("key", "text").mapInArrow(find, "key long, p1 int, more int, a int, kgram long, context long"))
    contexts = found.groupBy("kgram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "p1", "more", "a")).alias("at")
    )
    contexts = _io.cut(contexts)
    groups = contexts.groupBy("kgram").agg(F.count("*").alias("m")).where("m > 1")
    whole = contexts.where("n > 1").select(F.col("kgram").alias("kgram_"), F.col("context").alias("context_"))
    copied = found.join(whole, (found["kgram"] == whole["kgram_"]) & (found["context"] == whole["context_"]), "left_semi").select(
        "key", F.col("p1").alias("s"), (F.col("p1") + F.col("more") + length).alias("e")
    )
    needed = (
        contexts.join(groups, "kgram")
        .groupBy(F.col("at.key").alias("need_key"))
        .agg(F.collect_list(F.struct("at.p1", "at.more", "at.a", "kgram", (F.col("n") == 1).alias("single"), (F.col("m") > MOST).alias("hot"))).alias("need"))
    )
    needed = _io.cut(needed)
    n_need, any_hot = needed.agg(F.sum(F.size("need") * 64 + 64), F.max(F.exists("need", lambda x: x["hot"]))).first()

    def fetch(batches):
        for b in batches:
            texts, need = b.column(1).cast(pa.binary()), b.column(2)
            n = np.diff(need.offsets.to_numpy())
            flat = need.flatten()
            owner = np.repeat(np.arange(b.num_rows), n)
            p1, more, a = (flat.field(x).to_numpy() for x in ("p1", "more", "a"))
            views = [memoryview(t.as_buffer()) for t in texts]
            parts = [bytes(views[o][p : p + m + length]) for o, p, m in zip(owner, p1, more)]
            yield pa.RecordBatch.from_arrays(
                [flat.field("kgram"), b.column(0).take(pa.array(owner)), flat.field("p1"), pa.array(a - p1), flat.field("single"), flat.field("hot"), pa.array(parts, pa.binary())],
                ["kgram", "key", "p1", "start", "single", "hot", "bytes"],
            )

    asked = long_enough.join(_io.sized(needed, n_need or 0), long_enough["key"] == needed["need_key"]).select("key", "text", "need")
    sent = asked.mapInArrow(fetch, "kgram long, key long, p1 int, start int, single boolean, hot boolean, bytes binary")

    def keyed(t):
        parts = t["bytes"].to_pylist()
        off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        return window_keys(np.frombuffer(b"".join(parts), np.uint8), off, t["start"].to_numpy(), t["kgram"].to_numpy(), length)

    def compare(batches):
        for t in _vec.in_groups(batches, ["kgram"], MOST):
            owner, place, keys = keyed(t)
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            hit = np.zeros(len(keys), bool)
            hit[order[1:]] |= same
            hit[order[:-1]] |= same
            hit &= t["single"].to_numpy(zero_copy_only=False)[owner]
            w = np.flatnonzero(hit)
            if not len(w):
                continue
            o, p = owner[w], place[w]
            first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)])
            last = np.r_[first[1:], len(o)] - 1
            base = t["p1"].to_numpy()[o[first]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(t["key"].to_numpy()[o[first]]), pa.array((base + p[first]).astype(np.int32)), pa.array((base + p[last] + length).astype(np.int32))],
                ["key", "s", "e"],
            )

    def windows(batches):
        for b in batches:
            owner, place, keys = keyed(b)
            at = pa.array(owner)
            p = pa.array((b["p1"].to_numpy()[owner] + place).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b["key"].take(at), p, b["single"].take(at)], ["window", "key", "p", "single"])

    def runs(batches):
        for b in batches:
            key, p = b["key"].to_numpy(), b["p"].to_numpy()
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (p[1:] > p[:-1] + 1)][: len(p)])
            last = np.r_[first[1:], len(p)][: len(first)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(p[first]), pa.array(p[last] + np.int32(length))], ["key", "s", "e"])

    found_spans = copied
    if any_hot:
        sent = _io.cut(sent)
        each = sent.where("hot").mapInArrow(windows, "window long, key long, p int, single boolean")
        twice = each.groupBy("window").count().where("count > 1").select(F.col("window").alias("window_"))
        hits = each.where("single").join(twice, F.col("window") == F.col("window_"), "left_semi").select("key", "p")
        found_spans = found_spans.unionByName(hits.repartition("key").sortWithinPartitions("key", "p").mapInArrow(runs, "key long, s int, e int"))
    part = sent.where("not hot").repartition("kgram").sortWithinPartitions("kgram").mapInArrow(compare, "key long, s int, e int")
    spans = found_spans.unionByName(part).groupBy("key").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def join(batches):
        for b in batches:
            runs = [merged(list(zip(s, e))) for s, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([[x[i] for x in r] for r in runs], pa.list_(pa.int32())) for i in (0, 1))], ["span_key", "starts", "ends"])

    return spans.mapInArrow(join, "span_key long, starts array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeat, longest (and the kept bytes with keep_text).

    has_repeat says whether anything was removed, longest is the longest removed run in bytes.

    A byte goes if a string of `length` bytes over it also starts at another place of any
    document, the same one included; all is judged on the input. Null and empty texts have no
    bytes; shorter texts lose nothing. A repeated row is another document, so both lose their
    text. Very long texts are windowed whole, in pieces; other columns are not read, whatever their names. An empty
    table gives an empty result.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    spans = _io.cut(repeated_spans(docs, id_col, text_col, length))
    n_spans = spans.agg(F.sum(F.size("starts") * 8 + 128)).first()[0] or 0
    rows = _keyed(docs, id_col, text_col)
    joined = rows.join(_io.sized(spans, n_spans), rows["key"] == spans["span_key"], "left").select("id", "text", "starts", "ends")

    def apply(batches):
        for b in batches:
            texts, n, gone, runs, sha, long, kept = b.column(1).cast(pa.binary()).to_pylist(), [], [], [], [], [], []
            for text, s, e in zip(texts, b.column(2).to_pylist(), b.column(3).to_pylist()):
                cut = list(zip(s or (), e or ()))
                ends = [0, *(e for _, e in cut)]
                left = b"".join(text[s:e] for s, e in zip(ends, [*(s for s, _ in cut), len(text)])) if cut else text
                n.append(len(text))
                gone.append(len(text) - len(left))
                runs.append(len(cut))
                sha.append(hashlib.sha256(left).hexdigest())
                long.append(max((e - s for s, e in cut), default=0))
                if keep_text:
                    kept.append(left)
            out = [b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sha, pa.string()), pa.array([x > 0 for x in gone], pa.bool_()), pa.array(long, pa.int64())]
            yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.binary())] if keep_text else out, NAMES[: 7 + keep_text])

    NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeat", "longest", "kept"]
    kind = dict(joined.dtypes)["id"]
    return joined.mapInArrow(apply, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeat boolean, longest long" + ", kept binary" * keep_text)
