"""What the JVM cannot express: word differences by matching blocks, in Arrow batches."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

OPS = "op string, r0 int, r1 int, h0 int, h1 int"
_OPS = pa.list_(pa.struct([("op", pa.string()), ("r0", pa.int32()), ("r1", pa.int32()), ("h0", pa.int32()), ("h1", pa.int32())]))

_NAMES = ["equal", "replace", "delete", "insert"]


def opcodes(reference: list, hypothesis: list) -> list[dict]:
    """Stretches of two sequences by longest matching blocks: equal, replace, delete, insert, with their ends."""
    codes = difflib.SequenceMatcher(a=reference, b=hypothesis, autojunk=False).get_opcodes()
    return [dict(zip(("op", "r0", "r1", "h0", "h1"), c)) for c in codes]


def _aligned(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a row's opcodes are known, places of their words in x, which of these are changed).

    Known are rows of equally many words whose changed words do not occur on the other side at all: then no block
    holds a changed word, and the longest one, first in either side, is a stretch of equal words at its own place.
    """
    n = np.diff(x_at)
    same = n == np.diff(y_at)
    m = n[same]
    row = np.repeat(np.flatnonzero(same), m)
    i, j = (np.repeat(at[:-1][same] - (np.cumsum(m) - m), m) + np.arange(len(row)) for at in (x_at, y_at))
    changed = x[i] != y[j]
    keys = [r << 32 | c for r, c in ((row, x[i].astype(np.int64)), (row, y[j].astype(np.int64)))]
    within = np.isin(row, row[changed])
    foreign = [~np.isin(k[changed], other[within]) for k, other in (keys, keys[::-1])]
    same[row[changed][~(foreign[0] & foreign[1])]] = False
    kept = same[row]
    return same, i[kept], changed[kept]


def _lists(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray) -> pa.Array:
    """Opcodes of every row, as lists of _OPS."""
    known, i, changed = _aligned(x, x_at, y, y_at)
    row = np.repeat(np.flatnonzero(known), np.diff(x_at)[known])
    begins = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(changed.astype(np.int8), prepend=-1).astype(bool))
    ends = np.append(begins[1:], len(row))
    at = row[begins]
    r0 = i[begins] - x_at[at]
    r1 = r0 + ends - begins
    found = np.stack([at, changed[begins], r0, r1, r0, r1], axis=1).astype(np.int64).reshape(-1, 6)
    rest = []
    for k in np.flatnonzero(~known).tolist():
        a, b = x[x_at[k] : x_at[k + 1]].tolist(), y[y_at[k] : y_at[k + 1]].tolist()
        rest += [(k, _NAMES.index(o["op"]), o["r0"], o["r1"], o["h0"], o["h1"]) for o in opcodes(a, b)]
    found = np.concatenate([found, np.array(rest, np.int64).reshape(-1, 6)])
    found = found[np.argsort(found[:, 0], kind="stable")]
    ops = pa.array(_NAMES).take(pa.array(found[:, 1]))
    items = pa.StructArray.from_arrays([ops, *(pa.array(c.astype(np.int32)) for c in found[:, 2:].T)], fields=list(_OPS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(found[:, 0], np.arange(len(x_at))).astype(np.int32)), items)


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches with a list of the opcodes (`ops`) of the last two columns, lists of words.

    Words of a batch are coded as numbers once; rows that only differ place by place are settled together.
    """
    for b in batches:
        r, h = b.columns[-2:]
        x, y = r.flatten(), h.flatten()
        codes = pa.concat_arrays([x, y]).dictionary_encode().indices.to_numpy()
        at = [np.append(0, np.cumsum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64) for c in (r, h)]
        found = _lists(codes[: len(x)], at[0], codes[len(x) :], at[1])
        yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "ops"])
