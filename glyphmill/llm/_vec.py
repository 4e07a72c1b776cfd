"""Vectorised text primitives on Arrow string buffers, for use inside mapInArrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is a piece of its own.
PIECE = 1 << 20
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_MUL = 0x5851F42D4C957F2D | 1
_INV = pow(_MUL, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Which bytes belong to words (letters, digits, all non-ASCII).
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: All bytes but ASCII white space.
INK = np.ones(256, dtype=bool)
INK[9:14] = INK[32] = False
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n and those of its inverse, kept for the next call."""
    if len(_powers[0]) <= n:
        m = 1 << int(n).bit_length()
        for k, base in enumerate((_MUL, _INV)):
            p = np.full(m + 1, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about limit bytes; null counts as empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[r] - P[l] the polynomial hash of codes[l:r], scaled by the power l."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of the spans [left, right), independent of where they stand."""
    return mix((prefix[right] - prefix[left]) * powers(len(prefix))[1][left])


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """Bytes with the letters A-Z in lower case."""
    return _LOWER[buf]


def lower(buf: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the letters A-Z and those of Latin-1 in lower case."""
    out = _LOWER[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    x = buf[at]
    out[at[(x >= 0x80) & (x <= 0x9E) & (x != 0x97)]] += 32
    return out


def words(buf: np.ndarray, off: np.ndarray, kept: np.ndarray = _WORD, fold=lower) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words (runs of kept bytes, folded), and the texts' offsets among them."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, U64), np.zeros(len(off), np.int64)
    inside = kept[buf]
    first, last = inside.copy(), inside.copy()
    cuts = off[(off > 0) & (off < n)]
    before = inside[:-1].copy()
    before[cuts - 1] = False
    first[1:] &= ~before
    after = inside[1:].copy()
    after[cuts - 1] = False
    last[:-1] &= ~after
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hash(prefix_hash(byte_codes(fold(buf))), starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, off)


def byte_codes(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def shingle_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row (at each start; also across texts, which the caller masks)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = h[:m].copy()
    for j in range(1, k):
        out *= U64(_MUL)
        out += h[j : j + m]
    return mix(out)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row (van Herk: block prefix and suffix minima)."""
    n = len(x)
    if w <= 1 or n < w:
        return x[:0] if n < w else x.copy()
    blocks = -(-n // w)
    pad = np.full(blocks * w, np.iinfo(np.uint64).max, U64)
    pad[:n] = x
    rows = pad.reshape(blocks, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place within owner) for counts items each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def in_groups(batches, keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches sorted by keys, of about rows rows; a larger group stays whole."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.zeros(n, bool)
        for k in keys:
            x = table[k].to_numpy()
            last[1:] |= x[1:] != x[:-1]
        edge = int(np.flatnonzero(last)[-1]) if last.any() else 0
        if edge:
            yield table.slice(0, edge)
        held = table.slice(edge).to_batches()
        n -= edge
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
