"""Arrow kernels for what Catalyst can't express: clusters, normalisation, edit and match programs, byte windows.

Plain Python functions hold the semantics; ``arrow`` turns one into a Column
function that runs over Arrow batches, in slices of about SLICE_BYTES.
"""

from __future__ import annotations

import ctypes
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_CLUSTER, _SPACE = regex.compile(r"\X"), regex.compile(r"\p{White_Space}+")
#: Below U+0300 nothing joins the character before it, but line feeds carriage returns.
_JOINS = re.compile("[^\x00-\u02ff]")
#: Bytes of arguments that a worker handles at once; a longer row stays whole.
SLICE_BYTES = 1 << 20
#: White space below U+0300.
_BLANK = np.zeros(0x300, bool)
_BLANK[[*range(9, 14), 0x20, 0x85, 0xA0]] = True


def single(s: str) -> bool:
    """Whether every code point is surely a cluster of its own."""
    return "\r" not in s and (s.isascii() or _JOINS.search(s) is None)


def points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def clusters(s: str, use_graphemes: bool = True) -> list[str]:
    if not use_graphemes or single(s):
        return list(s)
    return _CLUSTER.findall(s)


def words(s: str) -> list[str]:
    """Runs of characters other than white space."""
    return s.split() if single(s) and not _SEPARATORS.search(s) else _WORD.findall(s)


#: White space for Python only.
_SEPARATORS, _WORD = re.compile("[\x1c-\x1f]"), regex.compile(r"\P{White_Space}+")


def word_counts(rows: pa.Array) -> pa.Array:
    """``word, n`` of the white-space words in each list of texts."""
    found = [Counter(w for s in texts or () if s is not None for w in words(s)) for texts in rows.to_pylist()]
    fields = {"word": pa.array([w for c in found for w in c], pa.string()), "n": np.array([n for c in found for n in c.values()], np.int64)}
    return lists([len(c) for c in found], fields, rows.is_null())


def char_bytes(s: str, use_graphemes: bool = True) -> np.ndarray:
    """Where each character begins, in bytes, and the length of the text."""
    if not use_graphemes or single(s):
        data = np.frombuffer(s.encode(), np.uint8)
        return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return np.concatenate([[0], np.cumsum([len(c.encode()) for c in _CLUSTER.findall(s)])]).astype(np.int64)


def blank(c: str) -> bool:
    return _SPACE.fullmatch(c) is not None


def normalize(s: str, scheme: str = "NFKC", use_graphemes: bool = True) -> str:
    if s.isascii():
        return s
    scheme = scheme.upper()
    if scheme not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normalization {scheme}")
    if unicodedata.is_normalized(scheme, s):
        return s
    return "".join(unicodedata.normalize(scheme, c) for c in clusters(s)) if use_graphemes else unicodedata.normalize(scheme, s)


def clean(s: str) -> str:
    return _SPACE.sub(" ", s).strip(" ")


def _byte_runs(s: str, max_bytes: int, use_graphemes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``byte_substrings`` as the starts and ends of the runs in characters, and the bytes where characters begin."""
    at = char_bytes(s, use_graphemes)
    if len(at) == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64), at
    end = np.arange(1, len(at))
    start = np.searchsorted(at, at[1:] - max_bytes, "left")  # of the longest run up to each end
    last = np.append(start[1:] > start[:-1], True) & (start < end)
    return start[last], end[last], at


def byte_substrings(s: str, max_bytes: int, use_graphemes: bool = True) -> list[tuple[int, int, int]]:
    """(byte_start, byte_end, characters) of all maximal runs of at most max_bytes bytes."""
    start, end, at = _byte_runs(s, max_bytes, use_graphemes)
    return list(zip(at[start].tolist(), at[end].tolist(), (end - start).tolist()))


def byte_values(texts: pa.Array) -> pa.Array:
    """The bytes of each text as numbers."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    mask = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(at - at[0]), pa.array(data[at[0] : at[-1]].astype(np.int32)), mask=mask)


def point_bytes(texts: pa.Array) -> pa.Array:
    """The bytes of each code point of the texts, joined by commas; 0 for the empty text."""
    return pa.array([None if t is None else ",".join(map(str, np.diff(char_bytes(t, False)).tolist())) or "0" for t in texts.to_pylist()], pa.string())


def byte_spans(texts: pa.Array, max_bytes: int) -> pa.Array:
    """The runs of ``byte_substrings`` of each text as ``start-end,start-end``."""
    found = [None if t is None else _byte_runs(t, max_bytes) for t in texts.to_pylist()]
    ends = [np.concatenate([f[2][f[side]] for f in found if f is not None] or [np.zeros(0, np.int64)]) for side in (0, 1)]
    spans = pc.binary_join_element_wise(*(pa.array(e).cast(pa.string()) for e in ends), "-")
    sizes = [0 if f is None else len(f[0]) for f in found]
    each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), spans)
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), pc.binary_join(each, ","))


def subsequences(values: list[float], k: float) -> list[tuple[int, int]]:
    """(start, end) of all maximal runs whose sum is at most k."""
    out, start, total = [], 0, 0
    for end, v in enumerate(values):
        if total + v > k and end > start:
            out.append((start, end))
        total += v
        while total > k:
            total -= values[start]
            start += 1
    if start < len(values):
        out.append((start, len(values)))
    return out


def byte_windows(s: str, max_bytes: int, context: int, use_graphemes: bool = True) -> list[tuple[int, int, int, int]]:
    """(ctx_start, window_start, window_end, ctx_end) in characters, filled greedily by bytes."""
    if max_bytes <= 2 * context:
        raise ValueError("max_bytes must be more than twice the context")
    at = char_bytes(s, use_graphemes).tolist()
    n = len(at) - 1
    if not n:
        return [(0, 0, 0, 0)]
    out, start = [], 0
    while start < n:
        end = bisect_right(at, at[start] + max_bytes - (context if start == 0 else 2 * context)) - 1
        if end == start:
            raise ValueError("a character is larger than a window")
        out.append((bisect_left(at, at[start] - context), start, end, bisect_right(at, at[end] + context) - 1))
        start = end
    return out


def _coded(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both as numbers of distinct characters, and which are white space."""
    code: dict[str, int] = {}
    x, y = (np.array([code.setdefault(c, len(code)) for c in s], np.int64) for s in (a, b))
    space = np.array([blank(c) for c in code], bool)
    return x, y, space[x] if len(x) else np.zeros(0, bool), space[y] if len(y) else np.zeros(0, bool)


def _rows(a: list[str], b: list[str], swap: bool, spaces: bool) -> Iterator[np.ndarray]:
    """Rows of the optimal string alignment distances of all prefixes, one for each prefix of ``a``."""
    x, y, blank_x, blank_y = _coded(a, b)
    m = len(y)
    index = np.arange(m + 1)
    yield index.astype(np.int32)
    before, last = None, index.astype(np.int32)
    far = np.int32(1 << 29)
    for i in range(len(x)):
        same = y == x[i]
        free = ~(blank_y | blank_x[i]) if spaces else np.ones(m, bool)
        best = last + 1
        best[1:] = np.minimum(best[1:], last[:-1] + np.where(same, 0, np.where(free, 1, far)))
        if swap and i and m > 1:
            crossed = (y[:-1] == x[i]) & (y[1:] == x[i - 1]) & ~same[1:] & free[1:]
            best[2:] = np.minimum(best[2:], np.where(crossed, before[:-2] + 1, far))
        best[0] = i + 1
        row = (np.minimum.accumulate(best - index) + index).astype(np.int32)  # insertions from the left
        yield row
        before, last = last, row


def _table(a: list[str], b: list[str], swap: bool, spaces: bool) -> np.ndarray:
    return np.stack(list(_rows(a, b, swap, spaces)))


def _last_row(a: list[str], b: list[str], swap: bool, spaces: bool) -> np.ndarray:
    return deque(_rows(a, b, swap, spaces), maxlen=1)[0]


def edit_distance(a: str, b: str, use_graphemes: bool = True, with_swap: bool = True, spaces_insert_delete_only: bool = False, normalized: bool = False) -> float:
    x, y = clusters(a, use_graphemes), clusters(b, use_graphemes)
    d = float(_last_row(x, y, with_swap, spaces_insert_delete_only)[-1]) if a != b else 0.0
    if not normalized:
        return d
    return d / max(len(x), len(y)) if x or y else float("nan")


def edit_distances(a: Sequence[str], b: Sequence[str], **options) -> list[float]:
    """Distances of the pairs of two lists of one length."""
    if len(a) != len(b):
        raise ValueError("two lists of one length are needed")
    return [edit_distance(x, y, **options) for x, y in zip(a, b)]


def prefix_distance(a: str, b: str, use_graphemes: bool = True, with_swap: bool = True, spaces_insert_delete_only: bool = False, normalized: bool = False) -> float:
    """Least distance of a to any prefix of b."""
    x = clusters(a, use_graphemes)
    d = float(_last_row(x, clusters(b, use_graphemes), with_swap, spaces_insert_delete_only).min())
    return (d / len(x) if x else float("nan")) if normalized else d


def edit_operations(a: str, b: str, use_graphemes: bool = True, with_swap: bool = True, spaces_insert_delete_only: bool = False) -> list[tuple[str, int, int]]:
    """Operations (d, i, r, s) that turn a into b, in order; of equal ways back delete, insert, replace, swap in this order."""
    x, y = clusters(a, use_graphemes), clusters(b, use_graphemes)
    t, out, i, j = _table(x, y, with_swap, spaces_insert_delete_only), [], len(x), len(y)
    while i or j:
        free = not (spaces_insert_delete_only and i and j and (blank(x[i - 1]) or blank(y[j - 1])))
        ways = []
        if i:
            ways.append((t[i - 1][j] + 1, 0, "d", i - 1, j))
        if j:
            ways.append((t[i][j - 1] + 1, 1, "i", i, j - 1))
        if i and j and (x[i - 1] == y[j - 1] or free):
            ways.append((t[i - 1][j - 1] + (x[i - 1] != y[j - 1]), 2, "k" if x[i - 1] == y[j - 1] else "r", i - 1, j - 1))
        if with_swap and i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1] and x[i - 1] != y[j - 1] and free:
            ways.append((t[i - 2][j - 2] + 1, 3, "s", i - 2, j - 2))
        _, _, op, i, j = min(ways)
        if op != "k":
            out.append((op, i, j))
    return out[::-1]


#: Cells of the tables of pairs whose distances or operations are found at once.
TABLE_CELLS = 1 << 20


def _pair_groups(a: pa.Array, b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of like lengths at once: their places, both texts as numbers of characters with ends that match nothing, both lengths.

    Rows with a null are left out.
    """
    code: dict[str, int] = {}
    number = lambda s: points(s).astype(np.int32) if single(s) else np.array([ord(c) if len(c) == 1 else code.setdefault(c, 0x110000 + len(code)) for c in clusters(s)], np.int32)
    x, y = ([None if t is None else number(t) for t in texts.to_pylist()] for texts in (a, b))
    rows = sorted((i for i in range(len(x)) if x[i] is not None and y[i] is not None), key=lambda i: (len(x[i]), len(y[i])))
    at = 0
    while at < len(rows):
        n = m = 0
        end = at
        while end < len(rows) and (end == at or (end + 1 - at) * (len(x[rows[end]]) + 1) * (max(m, len(y[rows[end]])) + 1) <= TABLE_CELLS):
            n, m = len(x[rows[end]]), max(m, len(y[rows[end]]))
            end += 1
        own = rows[at:end]
        p, q = np.full((end - at, n), -1, np.int32), np.full((end - at, m), -2, np.int32)
        for k, i in enumerate(own):
            p[k, : len(x[i])] = x[i]
            q[k, : len(y[i])] = y[i]
        yield np.array(own), p, q, np.array([len(x[i]) for i in own]), np.array([len(y[i]) for i in own])
        at = end


def _pair_rows(p: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
    """``_rows`` with swaps for many pairs at once."""
    (count, n), m = p.shape, q.shape[1]
    index = np.arange(m + 1, dtype=np.int32)
    last = np.tile(index, (count, 1))
    yield last
    before, far = None, np.int32(1 << 29)
    for i in range(n):
        same = q == p[:, i : i + 1]
        best = last + np.int32(1)
        best[:, 1:] = np.minimum(best[:, 1:], last[:, :-1] + ~same)
        if i and m > 1:
            crossed = (q[:, :-1] == p[:, i : i + 1]) & (q[:, 1:] == p[:, i - 1 : i]) & ~same[:, 1:]
            best[:, 2:] = np.minimum(best[:, 2:], np.where(crossed, before[:, :-2] + np.int32(1), far))
        best[:, 0] = i + 1
        row = np.minimum.accumulate(best - index, axis=1) + index
        yield row
        before, last = last, row


def pair_distances(a: pa.Array, b: pa.Array, prefix: bool = False) -> pa.Array:
    """``edit_distance`` or ``prefix_distance`` of the pairs of two arrays of texts."""
    out = np.full(len(a), np.nan)
    for own, p, q, n, m in _pair_groups(a, b):
        for i, row in enumerate(_pair_rows(p, q)):
            for k in np.flatnonzero(n == i) if prefix else ():
                out[own[k]] = row[k, : m[k] + 1].min()
            if not prefix:
                done = np.flatnonzero(n == i)
                out[own[done]] = row[done, m[done]]
    return pa.array(out, from_pandas=True)  # not a number stands for null only


def pair_operations(a: pa.Array, b: pa.Array) -> pa.Array:
    """``edit_operations`` of the pairs of two arrays of texts, as text."""
    out: list[str | None] = [None] * len(a)
    for own, p, q, n, m in _pair_groups(a, b):
        t = np.stack(list(_pair_rows(p, q)))
        k, far = np.flatnonzero((n > 0) | (m > 0)), np.int32(1 << 29)
        i, j = n[k], m[k]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        p, q = np.pad(p, ((0, 0), (2, 0)), constant_values=-3), np.pad(q, ((0, 0), (2, 0)), constant_values=-4)
        while len(k):
            x, y, x_before, y_before = p[k, i + 1], q[k, j + 1], p[k, i], q[k, j]
            same = x == y
            ways = np.full((4, len(k)), far)
            np.copyto(ways[0], t[i - 1, k, j] + 1, where=i > 0)
            np.copyto(ways[1], t[i, k, j - 1] + 1, where=j > 0)
            np.copyto(ways[2], t[i - 1, k, j - 1] + ~same, where=(i > 0) & (j > 0))
            np.copyto(ways[3], t[i - 2, k, j - 2] + 1, where=(i > 1) & (j > 1) & (x == y_before) & (x_before == y) & ~same)
            op = ways.argmin(axis=0)  # of equal ways the first
            i, j = i - np.array([1, 0, 1, 2])[op], j - np.array([0, 1, 1, 2])[op]
            told = ~((op == 2) & same)
            found.append((k[told], op[told], i[told], j[told]))
            left = (i > 0) | (j > 0)
            k, i, j = k[left], i[left], j[left]
        rows: list[list[str]] = [[] for _ in own]
        for part in reversed(found):
            for r, op, i, j in zip(*(x.tolist() for x in part)):
                rows[r].append(f"{'dirs'[op]}{i},{j}")
        for r, row in zip(own.tolist(), rows):
            out[r] = " ".join(row)
    return pa.array(out, pa.string())


def match_words(a: str, b: str, ignore_case: bool = False, same: Callable[[str, str], bool] | None = None) -> tuple[list[tuple[int, int]], int, int]:
    """Index pairs of a longest common subsequence of ASCII-white-space words; of equal ways the diagonal, else the right one."""
    x, y = (regex.findall(r"[^ \t\n\f\r]+", s.lower() if ignore_case else s) for s in (a, b))
    if same is None:
        code: dict[str, int] = {}
        p, q = (np.array([code.setdefault(w, len(code)) for w in s], np.int64) for s in (x, y))
        hits = lambda i: q == p[i]
    else:
        hits = lambda i: np.array([same(x[i], w) for w in y], bool)
    n, m = len(x), len(y)
    # a row of the table of lengths at a time; only its steps to the right and from above are kept, as bits
    right, above = np.zeros((n + 1, m // 8 + 1), np.uint8), np.zeros((n + 1, m // 8 + 1), np.uint8)
    last = np.zeros(m + 1, np.int32)
    for i in range(n):
        row = last.copy()
        row[1:] = np.maximum(row[1:], last[:-1] + hits(i))
        np.maximum.accumulate(row, out=row)
        right[i + 1] = np.packbits(np.diff(row, prepend=0).astype(np.uint8), bitorder="little")[: m // 8 + 1]
        above[i + 1] = np.packbits((row - last).astype(np.uint8), bitorder="little")[: m // 8 + 1]
        last = row
    bit = lambda t, i, j: int(t[i, j >> 3] >> (j & 7)) & 1
    out, i, j = [], n, m
    while i and j:
        hit = bool(hits(i - 1)[j - 1]) if same else p[i - 1] == q[j - 1]
        if bit(above, i, j) + bit(right, i - 1, j) == hit:
            i, j = i - 1, j - 1
            if hit:
                out.append((i, j))
        elif not bit(right, i, j):
            j -= 1
        else:
            i -= 1
    return out[::-1], n, m


def edited_words(a: str, b: str) -> tuple[list[int], list[int]]:
    pairs, n, m = match_words(a, b)
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    return [i for i in range(n) if i not in left], [j for j in range(m) if j not in right]


def whitespace_operations(a: str, b: str, use_graphemes: bool = True) -> list[int]:
    """0 keep, 1 insert before, 2 delete for each character of a, to reach b; they may differ in white space only."""
    if (not use_graphemes or single(a) and single(b)) and (out := _space_operations(points(a), points(b))) is not None:
        return out
    x, y = clusters(a, use_graphemes), clusters(b, use_graphemes)
    out, j = [], 0
    for c in x:
        if j < len(y) and c == y[j]:
            out.append(0)
            j += 1
        elif j < len(y) and blank(y[j]) and j + 1 < len(y) and c == y[j + 1]:
            out.append(1)
            j += 2
        elif blank(c):
            out.append(2)
        else:
            raise ValueError("texts differ in more than white space")
    return out


def blanks(p: np.ndarray) -> np.ndarray:
    return _BLANK[p] if not len(p) or p.max() < len(_BLANK) else np.isin(p, _SPACES)


#: Code points of White_Space.
_SPACES = np.array([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def _space_operations(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """``whitespace_operations`` of code points where no white space stands beside another, else null."""
    p, q = blanks(a), blanks(b)
    own, there = np.flatnonzero(~p), np.flatnonzero(~q)
    if len(own) != len(there) or (p[1:] & p[:-1]).any() or (q[1:] & q[:-1]).any() or (a[own] != b[there]).any():
        return None
    # the white space before each other character and at the end, 0 if there is none
    before = [np.append(np.where(np.diff(at, prepend=-1) > 1, s[at - 1] if len(s) else 0, 0), s[-1] if len(s) and blank[-1] else 0) for s, at, blank in ((a, own, p), (b, there, q))]
    out = np.zeros(len(a), np.int32)
    out[own[(before[1] != before[0])[:-1] & (before[1][:-1] > 0)]] = 1
    gone = (before[0] > 0) & (before[0] != before[1])
    out[np.append(own, len(a))[gone] - 1] = 2
    return out


def respaced(p: np.ndarray, new: np.ndarray, gone: np.ndarray) -> str:
    """The text of code points with a space before some, and without others."""
    many = 1 + new - gone.astype(np.int64)
    text = np.repeat(p, many)
    text[np.cumsum(many)[new] - 2] = 32
    return text.tobytes().decode("utf-32-le", "surrogatepass")


def whitespace_repair(s: str, ops: Sequence[int], use_graphemes: bool = True) -> str:
    if not use_graphemes or single(s):
        p, ops = points(s), np.asarray(ops, np.int32)
        if len(p) != len(ops):
            raise ValueError("one operation for each character is needed")
        space = blanks(p)
        return respaced(p, (ops == 1) & ~space & ~np.concatenate([[False], space[:-1]])[: len(p)], (ops == 2) & space)
    cs = clusters(s, use_graphemes)
    if len(cs) != len(ops):
        raise ValueError("one operation for each character is needed")
    out = []
    for i, (c, op) in enumerate(zip(cs, ops)):
        if op == 1 and not blank(c) and not (i and blank(cs[i - 1])):
            out.append(" ")
        if not (op == 2 and blank(c)):
            out.append(c)
    return "".join(out)


def slices(batches: Iterator[pa.Array | tuple[pa.Array, ...]]) -> Iterator[tuple[pa.Array, ...]]:
    """Batches cut into slices of about SLICE_BYTES; at the end freed memory goes back to the system."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc; else the thresholds rise with the largest array ever freed
        libc.mallopt(-3, 4 << 20)
        libc.mallopt(-1, 16 << 20)
    try:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            ends = np.cumsum(sum(_row_bytes(c) for c in columns))
            at = 0
            while at < len(ends):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                yield tuple(c.slice(at, stop - at) for c in columns)
                at = stop
            if not len(ends):
                yield columns
            del batch, columns
    finally:
        pa.default_memory_pool().release_unused()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def _row_bytes(column: pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
        size = pc.binary_length(column)
    elif pa.types.is_list(column.type):
        upto, size = np.append(0, np.cumsum(_row_bytes(column.flatten()))), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return np.diff(upto[np.append(0, np.cumsum(size))]) + 8
    else:
        return np.full(len(column), 8)
    return pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1]))
    if kind.startswith("struct<"):
        return pa.struct([(n.strip(), _arrow_type(t)) for n, t in (x.split(":") for x in kind[7:-1].split(","))])
    return {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind.strip()]


def arrow(f: Callable, kind: str, **options) -> Callable[..., Column]:
    """A Column function that applies ``f`` over Arrow batches; a null argument gives null."""

    def each(*columns: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in columns))
        return pa.array([None if any(x is None for x in row) else f(*row, **options) for row in rows], _arrow_type(kind))

    return arrow_batch(each, kind)


def arrow_batch(f: Callable[..., pa.Array], kind: str) -> Callable[..., Column]:
    """A Column function that applies ``f`` to Arrow arrays, slices of whole batches."""

    def run(batches):
        for columns in slices(batches):
            yield f(*columns)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    many = F.arrow_udf(run, kind)
    run_one = lambda batches: run(batches)
    run_one.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    one = F.arrow_udf(run_one, kind)
    return lambda *columns: one(*columns) if len(columns) == 1 else many(*columns)


def lists(sizes, fields: dict[str, np.ndarray], null: pa.Array) -> pa.Array:
    """Lists of structs with so many elements each."""
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(at), inner, mask=null)
