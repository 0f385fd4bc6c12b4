"""Gram sets of documents in memory-mapped files of the shared folder.

A set's id is its place: file number << 36 | byte offset.  A record holds the
size, a parity bitmap (a bound on overlaps without reading the set; its length
follows the size), and the grams as 48-bit values in the global order, rare
ones first, so that a prefix of the set is a prefix of the record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LEAST_BITS, MOST_BITS = 512, 1 << 17
GRAM_BITS = 48
OFFSET_BITS = 36
_OFFSET = (1 << OFFSET_BITS) - 1


def bitmap_bits(size: int) -> int:
    """About four bits for a gram, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (4 * size - 1).bit_length()))


def record(grams: np.ndarray) -> bytes:
    """``grams``: 48-bit values in global order."""
    n = bitmap_bits(len(grams))
    bits = np.bincount((grams & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return b"".join(
        [
            len(grams).to_bytes(8, "little"),
            np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(),
            (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
            (grams >> np.uint64(32)).astype(np.uint16).tobytes(),
        ]
    )


class Reader:
    """Random access to the records of a folder of files ``sets-<number>``."""

    def __init__(self, path: str):
        self.path, self.files = path, {}

    def _file(self, number: int) -> np.memmap:
        if number not in self.files:
            self.files[number] = np.memmap(f"{self.path}/sets-{number}", np.uint8, "r")
        return self.files[number]

    def size(self, sid: int) -> int:
        at = sid & _OFFSET
        return int.from_bytes(self._file(sid >> OFFSET_BITS)[at : at + 8].tobytes(), "little")

    def bitmaps(self, sids: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
        """Parity bitmaps of sets, a row for each, folded to ``bits`` (a power of two, no more than any has)."""
        out = np.empty((len(sids), bits // 64), np.uint64)
        at, have = (sids & _OFFSET) + 8, np.array([bitmap_bits(s) for s in sizes.tolist()], np.int64)
        kind = (sids >> OFFSET_BITS) << 8 | np.log2(have).astype(np.int64)  # of one file and length
        order = np.argsort(kind, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
            f, long = self._file(int(sids[some[0]] >> OFFSET_BITS)), int(have[some[0]]) // 8
            # records begin at any byte
            rows = np.ndarray(len(f) - long + 1, f"V{long}", f, strides=(1,))
            per = max(1, (8 << 20) // long)
            for i in range(0, len(some), per):
                words = rows[at[some[i : i + per]]].view(np.uint64).reshape(-1, long * 8 // bits, bits // 64)
                out[some[i : i + per]] = np.bitwise_xor.reduce(words, axis=1)
        return out

    def grams(self, sid: int, first: int | None = None) -> np.ndarray:
        """The set in global order, or its ``first`` grams."""
        n = self.size(sid)
        f, at = self._file(sid >> OFFSET_BITS), (sid & _OFFSET) + 8 + bitmap_bits(n) // 8
        k = n if first is None else min(n, first)
        low = np.frombuffer(f[at : at + 4 * k].tobytes(), np.uint32).astype(np.uint64)
        return low | np.frombuffer(f[at + 4 * n : at + 4 * n + 2 * k].tobytes(), np.uint16).astype(np.uint64) << np.uint64(32)


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array by significance, compressed: high bytes that are often zero cost little."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(raw.ravel()).to_bytes(8, "little") + pa.compress(pa.py_buffer(raw), codec="zstd", asbytes=True)


def from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(pa.py_buffer(raw).slice(8), int.from_bytes(raw[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
