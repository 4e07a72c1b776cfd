"""Benchmark decontamination by latent semantic retrieval, then ordered-word and answer checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import _io, _vec
from glyphmill.llm.passages import common

#: Words of a block; blocks of the sliding windows; words of a passage in the corpus statistics.
STEP, WINDOWS, PASSAGE = 8, (2, 4, 8), 32
#: Latent dimensions and seed of the sketch; the leading ones, which the language's common words
#: span, are left out of cosines (a quarter of them at most); cosine of a candidate window.
RANK, SEED, COMMON, COSINE = 64, 17, 16, 0.58
#: Share of an item's words in order that proves a copy, and that makes a paraphrase if the answer is there too.
COPY, PARAPHRASE = 0.75, 0.5
#: An item's answer: this share of its words, the rarest; and how many of them a paraphrase must hold.
ANSWER, ANSWERED = 0.25, 0.8
#: Items of fewer words than SHORT are found by their rarest words, in REACH words on either side of one of them.
SHORT, REACH = 12, 16
#: Items (or 64-word passages of them) of one sweep over the corpus; bounds the vocabulary, its sketch and what a task holds.
ITEMS = 1000


class Lookup:
    """Word hashes to their numbers, -1 for others: two direct tables, the rest by search."""

    def __init__(self, known: np.ndarray, bits: int = 18):
        self.known, self.tables = known, []
        rest = np.arange(len(known))
        for shift in (0, 23, 41):
            t = np.full(1 << bits, -1, np.int32)
            slot = ((known[rest] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            t[slot[::-1]] = rest[::-1]
            rest = rest[t[slot] != rest]
            self.tables.append((np.uint64(shift), np.uint64((1 << bits) - 1), t))
        self.rest = rest[np.argsort(known[rest])]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not len(self.known):
            return out
        for i, (shift, mask, t) in enumerate(self.tables):
            got = t[((h >> shift) & mask).astype(np.int64)]
            hit = (got >= 0) & (self.known[got] == h)
            out[hit] = got[hit]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.known[self.rest], h), len(self.rest) - 1)
            hit = self.known[self.rest][at] == h
            out[hit] = self.rest[at][hit]
        return out


def _tiles(terms: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's terms laid out in rows of `width` (padded with -1), and the texts' offsets among the rows."""
    n = np.diff(at)
    rows = -(-n // width)
    first = np.concatenate([[0], np.cumsum(rows)])
    owner, place = _vec.expand(n)
    flat = np.full(int(first[-1]) * width, -1, np.int32)
    flat[first[owner] * width + place] = terms
    return flat.reshape(-1, width), first


@dataclass
class Space:
    """A latent space: per term its vector (weighted by inverse document frequency; the last row, of
    unknown words, is zero) without the leading dimensions, and the singular values."""

    vectors: np.ndarray
    idf: np.ndarray
    singular: np.ndarray


def sketch(texts: DataFrame, lookup: Lookup, n_terms: int) -> Space:
    """Randomised SVD of the corpus's TF-IDF passages (rows) over n_terms terms, in one distributed pass.

    Tasks add up A'(A W) for the raw counts A and a Gaussian test matrix W, and the document
    frequencies. With the diagonal D of inverse document frequencies, D A'A W is the sketch of
    D A'A D with test matrix W/D, from which the Nystrom form gives singular values and vectors.
    """
    rank = min(RANK, max(1, n_terms))
    test = np.random.default_rng(SEED).standard_normal((n_terms + 1, rank)).astype(np.float32)
    test[n_terms] = 0

    def run(batches):
        z, df, n = np.zeros((n_terms, rank)), np.zeros(n_terms, np.int64), 0
        for b in batches:
            for _, buf, off in _vec.pieces(b.column(0)):
                _, _, h, at = _vec.words(buf, off)
                tiles, _ = _tiles(lookup(h), at, PASSAGE)
                n += len(tiles)
                y = np.zeros((len(tiles), rank), np.float32)
                for j in range(PASSAGE):
                    y += test[tiles[:, j]]
                flat = tiles.ravel()
                used = np.flatnonzero(flat >= 0)
                term, row = flat[used], used // PASSAGE
                for c, column in enumerate(np.ascontiguousarray(y.T)):
                    z[:, c] += np.bincount(term, column[row], n_terms)
                tiles.sort(axis=1)
                fresh = tiles >= 0
                fresh[:, 1:] &= tiles[:, 1:] != tiles[:, :-1]
                df += np.bincount(tiles[fresh], minlength=n_terms)
        used = np.flatnonzero(df)
        rows = [pa.array(np.r_[used, -1]), pa.array(np.r_[df[used], n]), pa.array([*z[used], np.zeros(rank)], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(rows, ["term", "df", "z"])

    parts = texts.mapInArrow(run, "term long, df long, z array<double>")
    sums = parts.groupBy("term").agg(F.sum("df").alias("df"), *(F.sum(F.col("z")[c]).alias(f"z{c}") for c in range(rank)))
    z, df, n = np.zeros((n_terms, rank)), np.zeros(n_terms), 0
    for r in sums.collect():  # a row for each term of the items
        if r.term < 0:
            n = r.df
        else:
            df[r.term] = r.df
            z[r.term] = r[2:]
    idf = np.log((n + 1) / (df + 1)) + 1
    core = test[:n_terms].astype(np.float64).T @ z
    core = (core + core.T) / 2
    values, turn = np.linalg.eigh(core + 1e-9 * max(1.0, np.trace(core)) * np.eye(rank))
    half = (idf[:, None] * z) @ (turn / np.sqrt(np.maximum(values, 1e-12)))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    u = u[:, min(COMMON, rank // 4) :]
    vectors = np.vstack([(idf[:, None] * u), np.zeros((1, u.shape[1]))]).astype(np.float32)
    return Space(vectors, idf, s)


@dataclass
class Items:
    """The benchmark's items: ids, words as term numbers, the answer's terms, which terms each holds.

    passages: (item, its words before, its words, its words after) of stretches of a window's size at
    most, and by_window their latent vectors; rare: (term, item) of short items' rarest terms, by term.
    """

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    passages: np.ndarray
    by_window: dict[int, tuple[np.ndarray, np.ndarray]]
    rare: np.ndarray
    holds: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def prepare(ids: list[int], words: list[np.ndarray], space: Space) -> Items:
    answers, passages, parts, short = [], [], [], []
    sizes = np.array(WINDOWS) * STEP
    for i, w in enumerate(words):
        terms = np.unique(w)
        rare = terms[np.argsort(-space.idf[terms], kind="stable")]
        answers.append(rare[: max(1, round(ANSWER * len(terms)))])
        if len(w) < SHORT:
            # A copy lacks (1 - COPY) of the words at most, so it has one of one more of the rarest; a paraphrase has its answer's.
            short += [(t, i) for t in rare[: max(int((1 - COPY) * len(w)) + 1, len(answers[-1]))].tolist()]
            continue
        before = 0
        for part in np.array_split(w, -(-len(w) // int(sizes.max()))):
            passages.append((i, before, len(part), len(w) - before - len(part)))
            parts.append(part)
            before += len(part)
    window = np.array([WINDOWS[int(np.argmin(np.abs(np.log(sizes / len(x)))))] for x in parts])
    vectors = _unit(np.array([space.vectors[x].sum(axis=0) for x in parts]).reshape(len(parts), space.vectors.shape[1]))
    by = {}
    for k in WINDOWS:
        own = np.flatnonzero(window == k)
        if len(own):
            by[k] = own, np.ascontiguousarray(vectors[own].T)
    holds = np.zeros((len(words), len(space.vectors)), bool)
    for i, w in enumerate(words):
        holds[i, w] = True
    return Items(ids, words, answers, np.array(passages, np.int64).reshape(-1, 4), by, np.array(sorted(short), np.int64).reshape(-1, 2), holds)


def _beside_rare(terms: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, end) around the rarest words of short items, where enough of the item's words are."""
    out: list[tuple[int, int, int, int]] = []
    if not len(items.rare):
        return out
    known = np.zeros(items.holds.shape[1], bool)
    known[items.rare[:, 0]] = True
    lengths = np.array([len(w) for w in items.words])
    places = np.flatnonzero(known[terms])
    for lo in range(0, len(places), 8192):
        pos = places[lo : lo + 8192]
        first = np.searchsorted(items.rare[:, 0], terms[pos])
        owner, k = _vec.expand(np.searchsorted(items.rare[:, 0], terms[pos], "right") - first)
        item, pos = items.rare[first[owner] + k, 1], pos[owner]
        doc = np.searchsorted(at, pos, "right") - 1
        start, end = np.maximum(at[doc], pos - REACH), np.minimum(at[doc + 1], pos + REACH + 1)
        shared = np.zeros(len(pos), np.int32)
        for j in range(-REACH, REACH + 1):
            inside = np.flatnonzero((pos + j >= start) & (pos + j < end))
            shared[inside] += items.holds[item[inside], terms[pos[inside] + j]]
        ok = np.flatnonzero(shared >= PARAPHRASE * lengths[item])
        out += zip(doc[ok].tolist(), item[ok].tolist(), (start - at[doc])[ok].tolist(), (end - at[doc])[ok].tolist())
    return out


def found_in(terms: np.ndarray, at: np.ndarray, items: Items, space: Space) -> list[list[tuple[int, float, int]]]:
    """For each text: (item id, share of its words in order, first word of the window) of each item it holds."""
    tiles, first = _tiles(terms, at, STEP)
    out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(at) - 1)]
    if not len(tiles):
        return out
    level = np.zeros((len(tiles), space.vectors.shape[1]), np.float32)
    for j in range(STEP):
        level += space.vectors[tiles[:, j]]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(first))
    size, hits = 1, {}
    while size < max(WINDOWS):
        more = np.zeros_like(level)
        more[:-size] = np.where((owner[:-size] == owner[size:])[:, None], level[size:], 0)
        level, size = level + more, size * 2
        if size not in items.by_window:
            continue
        own, vectors = items.by_window[size]
        for lo in range(0, len(level), 8192):
            near = _unit(level[lo : lo + 8192]) @ vectors
            row, col = np.divmod(np.flatnonzero(near >= COSINE), near.shape[1])
            row, passage = row + lo, own[col]
            item, _, length, _ = items.passages[passage].T
            # Words in order are words in common: count those first, a block more on either side.
            shared = np.zeros(len(row), np.int32)
            for j in range(-1, size + 1):
                at_row = row + j
                inside = np.flatnonzero((at_row >= first[owner[row]]) & (at_row < first[owner[row] + 1]))
                shared[inside] += items.holds[item[inside, None], tiles[at_row[inside]]].sum(axis=1, dtype=np.int32)
            for k in np.flatnonzero(shared >= PARAPHRASE * length).tolist():
                r = int(row[k])
                hits.setdefault((int(owner[r]), int(passage[k])), []).append((int(r - first[owner[r]]) * STEP, size * STEP))
    parts: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for doc, item, start, end in _beside_rare(terms, at, items):
        parts.setdefault((doc, item), set()).add((start, end))
    for (doc, passage), places in hits.items():
        item, before, _, after = items.passages[passage].tolist()
        runs: list[list[int]] = []
        for start, width in sorted(places):
            if runs and start <= runs[-1][2] + STEP:
                runs[-1][1:] = [start + width, start]
            else:
                runs.append([start, start + width, start])
        # The rest of a long item lies around its passage, a quarter longer at most.
        around = {(max(0, start - STEP - before * 5 // 4), end + STEP + after * 5 // 4) for start, end, _ in runs}
        parts.setdefault((doc, item), set()).update(around)
    for (doc, item), places in parts.items():
        text, words = terms[at[doc] : at[doc + 1]], items.words[item]
        best = (0.0, 0)
        for start, end in sorted(places):
            part = text[start:end]
            share = common(words, part) / len(words)
            if share > best[0] and (share >= COPY or (share >= PARAPHRASE and np.isin(items.answers[item], part).mean() >= ANSWERED)):
                best = (share, start)
        if best[0]:
            out[doc].append((items.ids[item], *best))
    return out


def _words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return _vec.words(raw, np.array([0, len(raw)]))[2]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out_col: str = "leaks") -> DataFrame:
    """docs with out_col: array of (item_id, similarity, word) of the benchmark items that each text holds.

    Words are runs of letters and digits, ASCII and Latin-1 in lower case. Windows of 16, 32 and 64 words slide
    over the whole text by 8 words; those near an item in the latent space of the corpus's TF-IDF
    passages are compared word by word. A longer item is sought by its passages of 64 words at most, and
    the whole item is compared around each; one of under 12 words is compared around its rarest words. An item is held if COPY of its words occur in order, or
    PARAPHRASE of them together with its answer. Items without words are never held. Null and
    empty texts hold nothing; all rows and columns come back, repeated rows alike; an empty table
    gives an empty result. The items' words are the vocabulary, ITEMS items a sweep, so that what
    each task holds is bounded.
    """
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is taken")
    spark = docs.sparkSession
    _io.small_batches(spark)
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    parts = bench.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.length("text") / 512)))).first()[0] or 0
    sweeps = max(1, -(-parts // ITEMS))
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("word", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("word", pa.int32())]))
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    at_col = docs.columns.index(text_col)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    out = docs
    names = [f"_{out_col}_{k}" for k in range(sweeps)] if sweeps > 1 else [out_col]
    while sweeps > 1 and set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    for k in range(sweeps):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(sweeps)) == k).collect()
        hashes = {r: _words_of(r.text) for r in sorted(set(rows))}
        hashes = {r: h for r, h in hashes.items() if len(h)}
        known = np.unique(np.concatenate(list(hashes.values()))) if hashes else np.zeros(0, np.uint64)
        lookup = Lookup(known)
        space = sketch(texts, lookup, len(known))
        items = prepare([r.item_id for r in hashes], [lookup(h) for h in hashes.values()], space)

        def run(batches, lookup=lookup, items=items, space=space, name=names[k]):
            for b in batches:
                got = []
                for _, buf, off in _vec.pieces(b.column(at_col)):
                    _, _, h, at = _vec.words(buf, off)
                    got += found_in(lookup(h), at, items, space)
                leaks = pa.array([[dict(zip(("item_id", "similarity", "word"), x)) for x in sorted(g)] for g in got], arrow)
                yield pa.RecordBatch.from_arrays([*b.columns, leaks], [*b.schema.names, name])

        fields = [*fields, T.StructField(names[k], kind)]
        out = out.mapInArrow(run, T.StructType(fields))
    if sweeps > 1:
        out = out.withColumn(out_col, F.array_sort(F.concat(*names))).drop(*names)
    return out
