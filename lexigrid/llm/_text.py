"""Vectorized words and word hashes over Arrow batches of texts.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so words are the same in bytes and in
characters. Texts are handled whole; batches are cut between documents to bound memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd bases have inverses modulo 2^64, so a prefix sum gives the hash of any span.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Longer tables of powers, for single long texts, are not kept.
KEPT_POWERS = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2^64 for i in 0..n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up), np.cumprod(down))
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, mixed with the span's length."""
    up, down = powers(_BASES[base], len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASES[base]))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole documents of about ``limit`` bytes (one longer text makes a slice of its own),
    each with its bytes and offsets; null texts are empty."""
    for i, j, data, offsets in _cut(batch.column(batch.schema.get_field_index(column)), limit):
        yield batch.slice(i, j - i), data, offsets


def _cut(col: pa.Array, limit: int):
    col = col.fill_null("").cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word: the sum over its bytes of a random number for the byte at its place, mixed with the length."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    upto = np.cumsum(lengths)
    place = np.arange(int(upto[-1])) - np.repeat(upto - lengths, lengths)
    at = place + np.repeat(starts, lengths)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _BYTE[data[at]]))])
    return mix(sums[upto] - sums[upto - lengths] + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(h: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of documents from the hashes of their words, by document and sorted, and the
    place of each document's first (one more at the end). Fewer words than a shingle are one shingle."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) - np.repeat(bounds[:-1], n)
    starts = np.flatnonzero((at == 0) | (at + shingle <= n[doc]))
    doc, stop = doc[starts], bounds[1:][doc[starts]]
    x = mix(h[starts] + np.uint64(1))
    for j in range(1, shingle):
        more = starts + j < stop
        x[more] = mix(x[more] * np.uint64(0x165667B19E3779F9) + h[starts[more] + j])
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[new], doc[new]
    return x, np.searchsorted(doc, np.arange(len(n) + 1))


#: Kinds of bytes for word shapes: lower case, upper case, digit, beyond ASCII; any other stands for itself.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")
_KIND[128:] = ord("a")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[128:] = True


def folded(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _FOLD[data]


def _picked(data: np.ndarray, keep: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words over the kept bytes alone."""
    upto = np.concatenate([[0], np.cumsum(keep)])
    return span_hash(_BYTE[data[keep]], upto[starts], upto[ends])


def letter_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's letters in lower case, all else left out."""
    folded = _FOLD[data]
    return _picked(folded, _LETTER[folded], starts, ends)


def shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's kinds of characters, runs of one kind as one: ``Word,`` is ``Aa,``."""
    kinds = _KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    return _picked(kinds, keep, starts, ends)
