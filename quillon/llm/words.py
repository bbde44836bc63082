"""Vectorised words of UTF-8 text: positions and 64-bit hashes, without Python strings.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; words never cross
documents. Hashes are polynomials in the bytes modulo two primes near 2^31, taken from
prefix sums, 62 bits with a bit mix at the end; A-Z may be folded. Two different words
have equal hashes by chance only, also where they repeat a pattern. Work goes by chunks of
about `CHUNK` bytes, cut at word ends, so memory does not grow with a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.permutation(256).astype(np.uint64) + np.uint64(1)
#: The primes.
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_BASES = [int(_RNG.integers(1 << 20, p - 1)) for p in PRIMES]
#: Up to so many bytes, sums of a byte's value (9 bits) times a power (31 bits) fit 64 bits.
_DIRECT = 1 << 23
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _power_table(base: int, p: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo p, by doubling."""
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, p)) % np.uint64(p)
        k *= 2
    return out


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime, at least n powers of its base and of the base's inverse."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        n = max(n, 2 * CHUNK)
        _POWERS[:] = [(_power_table(b, p, n), _power_table(pow(b, -1, p), p, n)) for b, p in zip(_BASES, PRIMES, strict=True)]
    return _POWERS


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs start..end of values (from 1 to 256)."""
    n, out = len(values), np.zeros(len(start), np.uint64)
    total = np.zeros(n + 1, np.uint64)
    for (up, down), prime in zip(_powers(n), PRIMES, strict=True):
        p = np.uint64(prime)
        terms = values * up[:n]
        if n > _DIRECT:
            terms %= p
        np.cumsum(terms, out=total[1:])
        out = (out << np.uint64(31)) | ((total[end] - total[start]) % p * down[start] % p)
    return mix(out + (end - start).astype(np.uint64) * _MIX1)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column on end, and the n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(off) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def _cuts(data: np.ndarray, offsets: np.ndarray):
    """Chunk bounds such that no word of a document is cut."""
    n, at = len(data), 0
    while at < n:
        to = min(n, at + CHUNK)
        while to < n:
            if offsets[np.searchsorted(offsets, to)] == to:
                break
            end = min(n, to + CHUNK)
            space = np.flatnonzero(_SPACE[data[to:end]])
            edge = offsets[np.searchsorted(offsets, to)]
            stop = min(edge, to + space[0]) if len(space) else (edge if edge <= end else -1)
            if stop >= 0:
                to = int(stop)
                break
            to = end
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, space=_SPACE):
    """Per chunk: (word hashes uint64, document of each word, starts, ends), in order.

    `space` marks the bytes that separate words.
    """
    table = _BYTE_FOLDED if fold else _BYTE
    filled = np.unique(offsets)
    for a, b in _cuts(data, offsets):
        part = data[a:b]
        gap = space[part]
        edge = np.zeros(b - a + 1, bool)
        edge[[0, b - a]] = True
        inner = filled[np.searchsorted(filled, a) : np.searchsorted(filled, b)] - a
        edge[inner] = True
        word = ~gap
        before = np.empty(b - a, bool)
        before[0] = True
        before[1:] = gap[:-1]
        start = np.flatnonzero(word & (before | edge[:-1]))
        after = np.empty(b - a, bool)
        after[-1] = True
        after[:-1] = gap[1:]
        end = np.flatnonzero(word & (after | edge[1:])) + 1
        if not len(start):
            continue
        h = run_hashes(table[part], start, end)
        doc = np.searchsorted(offsets, start + a, side="right") - 1
        yield h, doc, start + a, end + a


def all_words(column, fold: bool = True):
    """Hashes and documents of all words of a batch, and the first word of each document."""
    data, offsets = utf8(column)
    parts = [(h, d) for h, d, _, _ in words(data, offsets, fold)]
    h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    d = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    return h, d, np.searchsorted(d, np.arange(len(column) + 1))


def slices(column, limit: int = 1 << 20):
    """Bounds of runs of documents of about `limit` bytes, or of one longer document."""
    _, offsets = utf8(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(n, to)
        yield at, to
        at = to


def shingles(column, size: int):
    """Per document of a batch: its sorted distinct shingle hashes (uint64).

    With fewer than `size` words the whole sequence is one shingle; without words none.
    """
    for i, j in slices(column):
        yield from _shingles(column.slice(i, j - i), size)


def _shingles(column, size: int):
    h, _, first = all_words(column)
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    if len(full):
        for j in range(size):
            full += mix(h[j : len(full) + j] + _RNG_KEYS[j])
    full = mix(full)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                short = mix(short * _MIX1 + h[j : j + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)


_RNG_KEYS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64)
