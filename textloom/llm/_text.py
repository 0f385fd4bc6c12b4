"""Vectorised text primitives shared by the corpus operators.

Everything works on whole Arrow batches with numpy: no Python loop touches a
character or a word.  Texts are normalised once (lower case, every run of
characters other than letters, marks and digits becomes one space) and words
are hashed with a prefix-sum polynomial hash over the raw UTF-8 buffer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a Python worker; bounds numpy scratch space.
SLICE_BYTES = 1 << 20
#: And rows, at most.
SLICE_ROWS = 1 << 15

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_pow: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _pow.get(int(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _pow[int(base)] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, vectorised (a bijection on 64-bit integers)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds at most ``limit`` bytes each (one longer text stays whole)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, base + limit, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def normalise(texts: pa.Array) -> pa.Array:
    """Lower-cased words separated by single spaces; null becomes the empty string."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}\p{N}]+", " "))


def spaced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ' text text ... ' (one leading space, one trailing per text) and the n+1 offsets of the texts."""
    tailed = pc.binary_join_element_wise(texts, "", " ")
    if isinstance(tailed, pa.ChunkedArray):
        tailed = tailed.combine_chunks()
    bounds = np.frombuffer(tailed.buffers()[1], np.int32)[tailed.offset : tailed.offset + len(tailed) + 1].astype(np.int64)
    data = np.frombuffer(tailed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(tailed) else np.zeros(0, np.uint8)
    out = np.empty(len(data) + 1, np.uint8)
    out[0] = 32
    out[1:] = data
    return out, bounds - (bounds[0] if len(bounds) else 0) + 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] the position-weighted polynomial of data[i:j]."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data.astype(np.uint64) + np.uint64(1), _powers(_P, len(data)), out=c[1:])
    np.cumsum(c[1:], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, stop); equal bytes give equal hashes anywhere."""
    return mix64((c[stop] - c[start]) * _powers(_P_INV, len(c))[start])


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``spaced`` bytes, and the n+1 word offsets of the texts."""
    space = data == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(normal: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the normalised texts and the n+1 word offsets."""
    data, bounds = spaced(normal)
    starts, ends, at = words(data, bounds)
    return span_hash(prefix_hash(data), starts, ends), at


def gram_hashes(hashes: np.ndarray, at: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams and the text each belongs to, in text order.

    With ``short`` a text of 1..n-1 words gives one gram of all its words; a
    text without words gives none.
    """
    count = np.diff(at)
    total = len(hashes)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    m = total - n + 1
    if m > 0:
        full = hashes[:m].copy()
        for k in range(1, n):
            full = full * _GRAM + hashes[k : k + m]
        inside = owner[:m] == owner[n - 1 :]
        grams, of = mix64(full[inside]), owner[:m][inside]
    else:
        grams, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < n)) if short else np.zeros(0, np.int64)
    if len(few):
        value = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            more = count[few] > k
            value[more] = value[more] * _GRAM + hashes[at[few[more]] + k]
        grams = np.concatenate([grams, mix64(value ^ count[few].astype(np.uint64))])
        of = np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    return grams, of
