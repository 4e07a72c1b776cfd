"""Toxicity by a factorisation machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import _io, _vec

#: Hash buckets of terms; a term is a whole word or a word's first 4-9 bytes.
BUCKETS, PREFIXES = 1 << 20, (4, 5, 6, 7, 8, 9)
#: Labelled rows the model is fitted on at most; terms it keeps; labelled rows a kept term must be in.
SAMPLE, TERMS, SEEN = 24_000, 1024, 6
#: Latent factors, steps, step size, weight decay and seed of the training.
FACTORS, STEPS, RATE, DECAY, SEED = 6, 250, 0.05, 2e-5, 7
#: Buckets of log2 of the number of words, one feature each.
LENGTHS = 20


def _buckets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every term occurrence, and each text's number of words."""
    starts, ends, hashes, at = _vec.words(buf, off)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    prefix = _vec.prefix_hash(_vec.byte_codes(_vec.lower(buf))) if len(buf) else None
    docs, out = [doc], [hashes]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        if len(long):
            docs.append(doc[long])
            out.append(_vec.mix(_vec.span_hash(prefix, starts[long], starts[long] + k) + np.uint64(k)))
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate(docs), (np.concatenate(out) & mask).astype(np.int64), n


def features(buf: np.ndarray, off: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), once each: a kept term; a kept term met twice or more; the length's bucket."""
    doc, bucket, n = _buckets(buf, off)
    place = np.full(BUCKETS, -1, np.int16)
    place[terms] = np.arange(len(terms))
    f = place[bucket]
    hit = f >= 0
    key, count = np.unique(doc[hit] * len(terms) + f[hit], return_counts=True) if hit.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    d, f = key // max(1, len(terms)), key % max(1, len(terms))
    twice = count > 1
    size = 2 * len(terms) + np.minimum(LENGTHS - 1, np.log2(n + 1).astype(np.int64))
    d = np.concatenate([d, d[twice], np.arange(len(n))])
    f = np.concatenate([f, f[twice] + len(terms), size])
    order = np.argsort(d, kind="stable")
    return d[order], f[order]


@dataclass
class Model:
    """score = sigmoid(bias + sum of weights + sum over pairs of the factors' products)."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, doc: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        out = np.bincount(doc, self.weights[f], n) + self.bias
        for k in range(self.factors.shape[1]):
            v = self.factors[f, k]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, f = features(buf, off, self.terms)
        return 1 / (1 + np.exp(-np.clip(self.margins(doc, f, len(off) - 1), -50, 50)))


def train(doc: np.ndarray, f: np.ndarray, y: np.ndarray, terms: np.ndarray) -> Model:
    """Full-batch Adam on the logistic loss of the factorisation machine."""
    n, m = len(y), 2 * len(terms) + LENGTHS
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    r = np.random.default_rng(SEED)
    model = Model(terms, float(np.log(rate / (1 - rate))), np.zeros(m), 0.05 * r.standard_normal((m, FACTORS)))
    theta = np.concatenate([[model.bias], model.weights, model.factors.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, v = theta[1 : m + 1], theta[m + 1 :].reshape(m, FACTORS)
        model = Model(terms, theta[0], w, v)
        p = 1 / (1 + np.exp(-np.clip(model.margins(doc, f, n), -50, 50)))
        e = (p - y) / n
        ef = e[doc]
        grad = [np.array([e.sum()]), np.bincount(f, ef, m) + DECAY * w]
        gv = np.empty((m, FACTORS))
        for k in range(FACTORS):
            x = v[f, k]
            gv[:, k] = np.bincount(f, ef * (np.bincount(doc, x, n)[doc] - x), m)
        grad = np.concatenate([*grad, (gv + DECAY * v).ravel()])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return Model(terms, float(theta[0]), theta[1 : m + 1], theta[m + 1 :].reshape(m, FACTORS))


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of label_col learned from the labelled rows outside held_out(), SAMPLE of them at most.

    The sample is the same in every run (by id hash). Terms are chosen by chi-square of their
    presence, counted in the cluster; of the sampled rows the kept terms alone reach the driver.
    Without labelled rows of both kinds the model has no terms and scores the share of label 1.
    """
    _io.small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    total = known.count()
    if total > SAMPLE:
        known = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) < int(0.95 * SAMPLE / total * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(known.limit(SAMPLE)), F.col("id") == F.col("label_id")).select("text", "y")
    rows = _io.cut(rows)

    def count(batches):
        n = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            y = b.column(1).to_numpy()
            for at, buf, off in _vec.pieces(b.column(0)):
                doc, bucket, _ = _buckets(buf, off)
                key = np.unique(doc * BUCKETS + bucket)
                for label in (0, 1):
                    n[label] += np.bincount((key % BUCKETS)[y[at + key // BUCKETS] == label], minlength=BUCKETS).astype(np.int32)
        seen = np.flatnonzero(n.sum(axis=0) > 1)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[0, seen]), pa.array(n[1, seen])], ["bucket", "clean", "toxic"])

    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    n = clean + toxic
    if not clean or not toxic:
        bias = 50.0 if toxic else -50.0
        return Model(np.zeros(0, np.int64), bias, np.zeros(LENGTHS), np.zeros((LENGTHS, FACTORS)))
    by = rows.mapInArrow(count, "bucket long, clean int, toxic int").groupBy("bucket").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    k = F.col("a") + F.col("b")
    gap = F.col("b") * F.lit(float(clean)) - F.col("a") * F.lit(float(toxic))
    chi = F.lit(float(n)) * gap * gap / (k * (F.lit(n) - k) * F.lit(float(clean) * toxic))
    best = by.where((k >= SEEN) & (k < n)).select("bucket", chi.alias("chi")).where("chi > 12").orderBy(F.desc("chi"), "bucket").limit(TERMS)
    terms = np.array(sorted(r.bucket for r in best.collect()), np.int64)

    def extract(batches):
        for b in batches:
            for at, buf, off in _vec.pieces(b.column(0)):
                doc, f = features(buf, off, terms)
                lists = np.split(f.astype(np.int32), np.searchsorted(doc, np.arange(1, len(off) - 1)))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, len(off) - 1), pa.array(lists, pa.list_(pa.int32()))], ["y", "f"])

    data = rows.mapInArrow(extract, "y int, f array<int>").collect()  # at most SAMPLE rows of kept terms
    data.sort(key=lambda r: (r.y, len(r.f), r.f))
    y = np.array([r.y for r in data], float)
    doc = np.repeat(np.arange(len(data)), [len(r.f) for r in data])
    model = train(doc, np.concatenate([np.array(r.f, np.int64) for r in data]), y, terms)
    _io.drop(rows)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the model's score (0 to 1) of each whole text; null and empty texts are texts of no words.

    Row by row without a shuffle; all rows and columns come back, repeated rows scored alike; very long texts are read whole.
    out_col must be a new name (else ValueError); an empty table stays empty.
    """
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is taken")
    _io.small_batches(docs.sparkSession)
    at_col = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            got = [model.scores(buf, off) for _, buf, off in _vec.pieces(b.column(at_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], [*b.schema.names, out_col])

    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.DoubleType())]))
