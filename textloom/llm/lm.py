"""Perplexity under an interpolated modified Kneser-Ney model of word trigrams.

All trigrams of the corpus are counted; what is gathered grows with it.  Tasks
combine the trigrams of some million words and send them as packed arrays to
buckets by their middle word: there the contexts (w1, w2) and the lower-order
grams (w2, w3) of a trigram are complete, so that one shuffle serves all
orders.  Middle words that would fill a bucket are split by their first word,
and their lower-order counts are added up in a second, small shuffle; so are
the counts of single words.

Each bucket is a file of sorted hashes with counts in the shared folder.
Workers map the files and interpolate when they score; discounts come from
counts of counts over the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _memory, _store, _text
from .setstore import from_planes, planes

BOS, EOS = 1, 2
#: Words that a bucket counts, about; the number of buckets grows with the corpus.
BUCKET_WORDS = 2_500_000
#: Words whose trigrams are combined before they are sent.  Ranks of fewer than 2**21 words fit a third of 64 bits.
FLUSH_WORDS = 2_000_000
#: Bytes of text that are scored together.
_SCORE_BYTES = 4 << 20
#: Share of texts (1 in ..) on which middle words that need splitting are estimated; the layout depends on it, results don't.
LAYOUT_SHARE = 32
_WORD_BITS, _PRINT_BITS = 48, 40
_MUL = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_ROW = "kind int, bucket int, " + ", ".join(f"x{i} binary" for i in range(6))
_T3, _C2, _T2, _T2M, _W = "t3", "c2", "t2", "t2m", "w"
_MERGE, _WORD, _STATS = 0, 1, 2


def prepare(texts: pa.Array) -> pa.Array:
    """Lower case; runs of white space and control characters become one space."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[\s\p{Z}\p{Cc}]+", " "))


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the words (split at white space) as ``BOS BOS words EOS`` for each text, and the n+1 offsets."""
    hashes, of = _text.word_hashes(prepare(texts))
    size = np.diff(of)
    at = np.concatenate([[0], np.cumsum(size + 3)])
    out = np.full(at[-1], BOS, np.uint64)
    out[at[1:] - 1] = EOS
    out[np.arange(len(hashes)) + np.repeat(at[:-1] + 2 - of[:-1], size)] = hashes >> np.uint64(64 - _WORD_BITS)
    return out, at


def _predicted(at: np.ndarray) -> np.ndarray:
    """Positions of words and ends, without the two symbols in front of each text."""
    size = np.diff(at) - 2
    return np.arange(int(size.sum())) + np.repeat(at[:-1] + 2 - (np.cumsum(size) - size), size)


def _print(*words: np.ndarray) -> np.ndarray:
    """40-bit fingerprints of tuples of words."""
    h = words[0] * _MUL[0]
    for w, m in zip(words[1:], _MUL[1:]):
        h += w * m
    return _text.mix64(h) >> np.uint64(64 - _PRINT_BITS)


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_starts(x)]


def _even(h: np.ndarray, buckets: int) -> np.ndarray:
    """Evenly spread buckets of hashes."""
    return ((_text.mix64(h + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


@dataclass
class Layout:
    buckets: int
    hot: np.ndarray  # middle words that are split, ascending

    def is_hot(self, w: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(w), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, w), len(self.hot) - 1)] == w

    def of(self, words: np.ndarray, r1: np.ndarray, r2: np.ndarray, r3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of trigrams (places in ``words``), and whether they are split: by the middle word; split ones also by the first, beginnings of texts by the third."""
        bucket, hot = _even(words, self.buckets)[r2], self.is_hot(words)[r2]
        for some, other in ((np.flatnonzero(hot), r1), (np.flatnonzero((words == BOS)[r2]), r3)):
            bucket[some] = _even(words[r2[some]] ^ _text.mix64(words[other[some]] + np.uint64(3)), self.buckets)
        return bucket, hot

    def merged(self, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
        return _even(_text.mix64(w2 + np.uint64(7)) ^ w3, self.buckets)


def _layout(texts: DataFrame) -> Layout:
    size = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    words = (size[0] or 0) / 6 + (size[1] or 0)
    buckets = max(1, int(-(-words // BUCKET_WORDS)))
    if buckets == 1:
        return Layout(1, np.zeros(0, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text"):
            points, _ = symbols(b.column("text"))
            w, n = np.unique(points[points > EOS], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])

    part = texts.where(F.pmod(F.xxhash64("text"), F.lit(LAYOUT_SHARE)) == 0)
    often = part.mapInArrow(_memory.lean(run), "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") * LAYOUT_SHARE > BUCKET_WORDS // 3)
    hot = often.select("w").toArrow().column("w").to_numpy()
    return Layout(buckets, np.sort(hot.view(np.uint64)))


def _count(points: np.ndarray, end: np.ndarray, layout: Layout) -> Iterator[tuple[int, list[bytes]]]:
    """Distinct trigrams that end at ``end`` with counts, packed by bucket."""
    words, rank = np.unique(points, return_inverse=True)
    rank = rank.astype(np.uint64)
    key = rank[end - 1] << np.uint64(42) | rank[end - 2] << np.uint64(21) | rank[end]
    key, n = np.unique(key, return_counts=True)
    low = np.uint64((1 << 21) - 1)
    r2, r1, r3 = (x.astype(np.int64) for x in (key >> np.uint64(42), key >> np.uint64(21) & low, key & low))
    bucket, _ = layout.of(words, r1, r2, r3)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(layout.buckets + 1))
    local = np.zeros(len(words), np.uint32)
    for k in np.flatnonzero(np.diff(cut)).tolist():
        own = order[cut[k] : cut[k + 1]]
        a, b, c = r2[own], r1[own], r3[own]
        used = np.zeros(len(words), bool)
        used[a] = used[b] = used[c] = True
        used = np.flatnonzero(used)
        local[used] = np.arange(len(used), dtype=np.uint32)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        runs = np.diff(np.append(first, len(a))).astype(np.uint32)
        step = np.diff(local[b], prepend=np.uint32(0))  # within a run they ascend
        step[first] = local[b[first]]
        yield k, [planes(x) for x in (np.diff(words[used], prepend=np.uint64(0)), local[a[first]], runs, step, local[c], n[own].astype(np.uint32))]


def _row(kind: int, bucket: int, parts: list[bytes]) -> pa.RecordBatch:
    parts = [*parts, *[b""] * (6 - len(parts))]
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]], [c.split()[0] for c in _ROW.split(", ")])


def _trigrams(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and distinct trigrams (w2, w1, w3 as places in the words, in that order) with counts."""
    own = [np.cumsum(from_planes(r[0], np.uint64), dtype=np.uint64) for r in rows]
    words = _unique(np.concatenate(own))
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for w, r in zip(own, rows):
        place = np.searchsorted(words, w).astype(np.uint32)
        runs = from_planes(r[2], np.uint32)
        parts[0].append(np.repeat(place[from_planes(r[1], np.uint32)], runs))
        total = np.cumsum(from_planes(r[3], np.uint32), dtype=np.int64)
        begin = np.cumsum(runs) - runs
        before = np.where(begin > 0, total[np.maximum(begin, 1) - 1], 0)
        parts[1].append(place[total - np.repeat(before, runs)])
        parts[2].append(place[from_planes(r[4], np.uint32)])
        parts[3].append(from_planes(r[5], np.uint32))
    w2, w1, w3, n = (np.concatenate(p) for p in parts)
    bits = int(len(words)).bit_length()
    if 3 * bits <= 64:
        s = np.uint64(bits)
        key = (w2.astype(np.uint64) << s | w1) << s | w3
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
    else:
        order = np.lexsort((w3, w1, w2))
        a, b, c = w2[order], w1[order], w3[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    first = np.flatnonzero(new)
    n = np.add.reduceat(n[order].astype(np.int64), first)
    first = order[first]
    return words, w2[first], w1[first], w3[first], n


def _contexts(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run that begins at ``first``: sum, and how many are 1, 2, and more."""
    sums = [n, n == 1, n == 2, n > 2]
    return np.stack([np.add.reduceat(x.astype(np.int64), first) for x in sums], 1) if len(first) else np.zeros((0, 4), np.int64)


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _stats(order: int, n: np.ndarray, words: int = 0) -> pa.RecordBatch:
    """Counts of counts 1 to 4, sum, and number of words of an order."""
    return _row(_STATS, order, [np.array([*[int((n == k).sum()) for k in (1, 2, 3, 4)], int(n.sum()), words], np.int64).tobytes()])


def _bigrams(words: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What single words need of complete bigrams (places in ``words``, sorted): contexts of w2, and distinct words before w3."""
    yield _stats(2, n)
    first = _starts(w2)
    after = np.bincount(w3, minlength=len(words))
    seen = np.flatnonzero(after)
    before = _contexts(first, n)
    every = np.union1d(seen, w2[first])
    values = np.zeros((len(every), 5), np.int64)
    values[np.searchsorted(every, seen), 0] = after[seen]
    values[np.searchsorted(every, w2[first]), 1:] = before
    yield pa.RecordBatch.from_arrays([pa.array(words[every].view(np.int64)), *[pa.array(values[:, k]) for k in range(5)]], ["w", *"abcde"])


def _by_bucket(kind: int, words: list[np.ndarray], values: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of sorted words (or pairs) and their values, by bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = _starts(bucket[order]).tolist() + [len(order)]
    for i, j in zip(edges[:-1], edges[1:]):
        own = order[i:j]
        parts = [planes(w[own] if k else np.diff(w[own], prepend=np.uint64(0))) for k, w in enumerate(words)]
        yield _row(kind, int(bucket[own[0]]), [*parts, planes(np.ascontiguousarray(values[own].T).ravel())])


def _lower(words: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray, layout: Layout) -> Iterator[pa.RecordBatch]:
    for b in _bigrams(words, w2, w3, n):
        if b.num_columns == 8:
            yield b
        else:
            w = b.column(0).to_numpy().view(np.uint64)
            yield from _by_bucket(_WORD, [w], np.stack([b.column(k).to_numpy() for k in range(1, 6)], 1), _even(w, layout.buckets))


def _reduce(rows: list[list[bytes]], bucket: int, layout: Layout, path: str) -> Iterator[pa.RecordBatch]:
    """The arrays of a bucket of trigrams; yields what other buckets need."""
    words, w2, w1, w3, n = _trigrams(rows)
    real = (words[w1] != BOS) | (words[w2] != BOS)  # a text's first word is predicted from BOS alone
    a, b, c, m = w2[real], w1[real], w3[real], n[real]
    _write(path, _T3, bucket, _print(words[b], words[a], words[c]), m[:, None])
    first = _starts(a, b)
    _write(path, _C2, bucket, _print(words[b[first]], words[a[first]]), _contexts(first, m))
    yield _stats(3, m)
    # the lower order counts distinct words in front, and texts where there is none
    key = w2.astype(np.uint64) << np.uint64(32) | w3
    order = np.argsort(key)
    key = key[order]
    first = _starts(key)
    pair2, pair3 = w2[order[first]], w3[order[first]]
    adjusted = np.add.reduceat(np.where(words[w2] == BOS, n, 1)[order], first)
    hot = layout.is_hot(words)[pair2]
    whole = ~hot
    _write(path, _T2, bucket, _print(words[pair2[whole]], words[pair3[whole]]), adjusted[whole][:, None])
    if whole.any():
        yield from _lower(words, pair2[whole], pair3[whole], adjusted[whole], layout)
    if hot.any():
        x, y = words[pair2[hot]], words[pair3[hot]]
        yield from _by_bucket(_MERGE, [x, y], adjusted[hot][:, None], layout.merged(x, y))


def _merge(rows: list[list[bytes]], bucket: int, layout: Layout, path: str) -> Iterator[pa.RecordBatch]:
    """Bigrams of hot middle words, added up."""
    x = np.concatenate([np.cumsum(from_planes(r[0], np.uint64), dtype=np.uint64) for r in rows])
    y = np.concatenate([from_planes(r[1], np.uint64) for r in rows])
    n = np.concatenate([from_planes(r[2], np.int64) for r in rows])
    words = _unique(np.concatenate([x, y]))
    x, y = np.searchsorted(words, x), np.searchsorted(words, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    first = _starts(x, y)
    n = np.add.reduceat(n[order], first)
    x, y = x[first], y[first]
    _write(path, _T2M, bucket, _print(words[x], words[y]), n[:, None])
    yield from _lower(words, x, y, n, layout)


def _words(rows: list[list[bytes]], bucket: int, layout: Layout, path: str) -> Iterator[pa.RecordBatch]:
    """Counts of single words and of the contexts they are."""
    w = np.concatenate([np.cumsum(from_planes(r[0], np.uint64), dtype=np.uint64) for r in rows])
    values = np.concatenate([from_planes(r[1], np.int64).reshape(5, -1).T for r in rows])
    order = np.argsort(w)
    w = w[order]
    first = _starts(w)
    values = np.add.reduceat(values[order], first, axis=0)
    _write(path, _W, bucket, _print(w[first]), values)
    seen = values[:, 0][values[:, 0] > 0]
    yield _stats(1, seen, len(seen))


def _write(path: str, name: str, bucket: int, prints: np.ndarray, values: np.ndarray) -> None:
    """A file of fingerprints in ascending order with their values.

    The leading bits of a fingerprint are implied by a directory of where they
    begin; a value is a byte: its place in a table of the most frequent ones,
    or 255 for one in the list of others.
    """
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    new = _starts(prints)
    prints, values = prints[new], values[order[new]]
    n = len(prints)
    lead = min(16, max(0, n.bit_length() - 4))
    width = -(-(_PRINT_BITS - lead) // 8)
    start = np.searchsorted(prints, np.arange((1 << lead) + 1, dtype=np.uint64) << np.uint64(_PRINT_BITS - lead)).astype(np.uint32)
    low = prints & np.uint64((1 << (_PRINT_BITS - lead)) - 1)
    packed = np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width])
    k = values.shape[1]
    # most values are those of things seen once, which are told by the first number
    codes, table = np.zeros(n, np.uint8), np.zeros((1, k), np.int64)
    once = values[:, 0] == 1
    if once.any() and (values[once] == values[once.argmax()]).all():
        table[0] = values[once.argmax()]
    else:
        once[:] = False
    more = np.flatnonzero(~once)
    if len(more):
        mixed = np.zeros(len(more), np.uint64)
        for c in range(k):
            mixed = _text.mix64(mixed ^ (values[more, c].astype(np.uint64) + np.uint64(c + 1)))
        kinds, place, of, count = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
        rank = np.empty(len(kinds), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(1, len(kinds) + 1)
        codes[more] = np.minimum(rank[of], 255)
        table = np.vstack([table, np.zeros((min(254, len(kinds)), k), np.int64)])
        table[rank[rank < 255]] = values[more[place[rank < 255]]]
    other = np.flatnonzero(codes == 255)
    rest = values[other]
    kind = np.uint32 if not rest.size or rest.max() < 1 << 32 else np.int64
    head = np.array([n, lead, width, k, len(table), len(other), np.dtype(kind).itemsize], np.int64)
    _store.write_atomically(f"{path}/{name}-{bucket}", head.tobytes(), table.tobytes(), rest.astype(kind).tobytes(), other.astype(np.uint32).tobytes(), start.tobytes(), codes.tobytes(), packed.tobytes(), bytes(8))


class _File:
    """A mapped file of ``_write``; ``made`` turns its values (a row each) into those that ``find`` gives."""

    def __init__(self, path: str, made: Callable[[np.ndarray], np.ndarray] = lambda v: v):
        self.raw = raw = np.memmap(path, np.uint8, "r")
        self.n, self.lead, width, k, tables, others, size = raw[:56].view(np.int64).tolist()
        at = 56

        def take(kind, count):
            nonlocal at
            at += count * np.dtype(kind).itemsize
            return np.frombuffer(raw, kind, count, at - count * np.dtype(kind).itemsize)

        table = made(take(np.int64, tables * k).reshape(-1, k))
        self.table = np.vstack([table, np.zeros((256 - tables, table.shape[1]), table.dtype)])
        self.rest = made(take(np.uint32 if size == 4 else np.int64, others * k).reshape(-1, k).astype(np.int64))
        self.other = take(np.uint32, others)
        self.start = take(np.uint32, (1 << self.lead) + 1)
        self.codes = take(np.uint8, self.n)
        self.low = np.ndarray((self.n,), "<u8", raw, at, (width,)) if self.n else np.zeros(0, np.uint64)
        self.mask = np.uint64((1 << 8 * width) - 1)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (a row each, zeros where there is none), and whether the fingerprint is there."""
        if not self.n:
            return np.zeros((len(prints), self.table.shape[1]), self.table.dtype), np.zeros(len(prints), bool)
        bits = np.uint64(_PRINT_BITS - self.lead)
        cell = (prints >> bits).astype(np.int64)
        low = prints & ((np.uint64(1) << bits) - np.uint64(1))
        i, end = self.start[cell].astype(np.int64), self.start[cell + 1].astype(np.int64)
        j = end
        for _ in range(int((end - i).max(initial=0)).bit_length()):
            mid = (i + j) >> 1
            less = ((self.low[np.minimum(mid, self.n - 1)] & self.mask) < low) & (i < j)
            i, j = np.where(less, mid + 1, i), np.where(less, j, mid)
        at = np.minimum(i, self.n - 1)
        found = (i < end) & ((self.low[at] & self.mask) == low)
        code = self.codes[at]
        values = self.table[np.where(found, code, 255)]
        rare = np.flatnonzero(found & (code == 255))
        values[rare] = self.rest[np.searchsorted(self.other, at[rare].astype(np.uint32))]
        return values, found


@dataclass
class Model:
    """Folder and layout of the arrays; discounts of each order; mass that unknown words share, sum of the counts of words."""

    path: str
    layout: Layout
    cuts: dict[int, np.ndarray]
    unknown: float
    total: float
    files: dict = field(default_factory=dict, repr=False)

    def file(self, name: str, bucket: int) -> _File | None:
        if (name, bucket) not in self.files:
            try:
                self.files[name, bucket] = _File(f"{self.path}/{name}-{bucket}", self._made(name))
            except FileNotFoundError:  # a bucket without rows
                self.files[name, bucket] = None
        return self.files[name, bucket]

    def find(self, name: str, bucket: np.ndarray, prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        values, found = np.zeros((len(prints), k)), np.zeros(len(prints), bool)
        key = bucket.astype(np.uint64) << np.uint64(_PRINT_BITS) | prints  # in order within a file too, so that it is read once through
        order = np.argsort(key)
        key = key[order]
        edges = _starts(key >> np.uint64(_PRINT_BITS)).tolist() + [len(order)]
        mask = np.uint64((1 << _PRINT_BITS) - 1)
        for i, j in zip(edges[:-1], edges[1:]):
            own = order[i:j]
            if f := self.file(name, int(bucket[own[0]])):
                values[own], found[own] = f.find(key[i:j] & mask)
        return values, found

    def _made(self, name: str) -> Callable[[np.ndarray], np.ndarray]:
        """Stored counts as discounted counts, and as sums and discounted shares of contexts."""
        less = lambda n, k: n - self.cuts[k][np.minimum(n, 3)]
        context = lambda v, k: [v[:, 0].astype(float), v[:, 1] * self.cuts[k][1] + v[:, 2] * self.cuts[k][2] + v[:, 3] * self.cuts[k][3]]
        if name == _W:
            return lambda v: np.stack([less(v[:, 0], 1), *context(v[:, 1:], 2)], 1)
        if name == _C2:
            return lambda v: np.stack(context(v, 3), 1)
        return lambda v: less(v, 3 if name == _T3 else 2)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log10 probabilities and number of predictions (words and the end) of each text."""
        points, at = symbols(texts)
        end = _predicted(at)
        words, of = np.unique(points, return_inverse=True)
        r1, r2, r3 = of[end - 2], of[end - 1], of[end]
        single, _ = self.find(_W, _even(words, self.layout.buckets), _print(words), 3)
        bucket, hot = self.layout.of(words, r1, r2, r3)
        w1, w2, w3 = points[end - 2], points[end - 1], points[end]
        n = np.zeros(len(end))
        pair = _print(w2, w3)
        some = np.flatnonzero(~hot)
        n[some] = self.find(_T2, bucket[some], pair[some], 1)[0][:, 0]
        some = np.flatnonzero(hot)
        n[some] = self.find(_T2M, self.layout.merged(w2[some], w3[some]), pair[some], 1)[0][:, 0]
        p = _interpolate(n, single[:, 1][r2], single[:, 2][r2], (single[:, 0] / self.total + self.unknown)[r3])
        context, _ = self.find(_C2, bucket, _print(w1, w2), 2)
        n, _ = self.find(_T3, bucket, _print(w1, w2, w3), 1)
        p = _interpolate(n[:, 0], context[:, 0], context[:, 1], p)
        size = np.diff(at) - 2
        sums = np.concatenate([[0], np.cumsum(np.log10(p))])
        edge = np.concatenate([[0], np.cumsum(size)])
        return sums[edge[1:]] - sums[edge[:-1]], size


def _interpolate(n: np.ndarray, total: np.ndarray, weight: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The lower order's probabilities alone where the context was never seen (total 0)."""
    return np.where(total > 0, (n + weight * below) / np.maximum(total, 1), below)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """0, D1, D2, D3+ from counts of counts; where a count is missing, their usual values between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    made = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *[min(max(d, 0.05), k - 0.05) for d, k in zip(made, (1, 2, 3))]])


def _each_bucket(step: Callable, layout: Layout, path: str) -> Callable:
    """A function for mapInArrow on partitions of one bucket each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bucket = [], -1
        for b in batches:
            for i in range(b.num_rows):
                bucket = b.column(1)[i].as_py()
                rows.append([b.column(2 + k)[i].as_py() for k in range(6)])
        if rows:
            yield from step(rows, bucket, layout, path)

    return _memory.lean(run)


def train(docs: DataFrame) -> Model:
    """Count all word trigrams of ``docs``, null texts left out, and store the model."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    layout = _layout(texts)
    path = _store.local_path(_store.new_dir(docs.sparkSession, "word-model"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0

        def flush():
            base = np.cumsum([0, *[len(p) for p, _ in held[:-1]]])
            points, end = np.concatenate([p for p, _ in held]), np.concatenate([e + b for (_, e), b in zip(held, base)])
            for k, parts in _count(points, end, layout):
                yield _row(_WORD, k, parts)

        for b in _text.slices(batches, "text"):
            points, at = symbols(b.column("text"))
            end = _predicted(at)
            for i in range(0, len(end), FLUSH_WORDS // 2):  # a text may be longer
                some = end[i : i + FLUSH_WORDS // 2]
                low, high = int(some[0]) - 2, int(some[-1]) + 1
                if room + high - low > FLUSH_WORDS:
                    yield from flush()
                    held, room = [], 0
                held.append((points[low:high], some - low))
                room += high - low
        if held:
            yield from flush()

    of = F.col("bucket")
    n = layout.buckets
    parts = _store.settle(texts.mapInArrow(_memory.lean(count), _ROW).repartitionById(n, of).mapInArrow(_each_bucket(_reduce, layout, path), _ROW), "lm-parts")
    more = _store.settle(parts.where(F.col("kind") == _MERGE).repartitionById(n, of).mapInArrow(_each_bucket(_merge, layout, path), _ROW), "lm-merged")
    both = parts.unionByName(more)
    last = _store.settle(both.where(F.col("kind") == _WORD).repartitionById(n, of).mapInArrow(_each_bucket(_words, layout, path), _ROW), "lm-words")
    sums = {k: np.zeros(6, np.int64) for k in (1, 2, 3)}
    # a row of six numbers for each bucket and order
    for r in both.unionByName(last).where(F.col("kind") == _STATS).select("bucket", "x0").toLocalIterator():
        sums[r["bucket"]] += np.frombuffer(bytes(r["x0"]), np.int64)
    _store.discard(parts, more, last)
    cuts = {k: discounts(*map(float, s[:4])) for k, s in sums.items()}
    n1, n2, n3, n4, total, words = sums[1].tolist()
    weight = cuts[1][1] * n1 + cuts[1][2] * n2 + cuts[1][3] * (words - n1 - n2)
    return Model(path, layout, cuts, weight / total / (words + 1) if total else 1.0, float(total or 1))


def perplexity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, perplexity, log10_prob, n_words`` of every row's whole text; its end counts as a word.

    A null text has nulls; a text without words is scored on its end alone.
    Rows are scored one by one: repeated rows repeat, a null doc_id stays
    null, other columns are not read.  An empty table gives an empty table;
    under a model of no texts every word has probability 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text", _SCORE_BYTES):
            log, n = shared.value.score(b.column("text"))
            gone = pc.is_null(b.column("text")).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(10 ** (-log / n), mask=gone), pa.array(log, mask=gone), pa.array(n, mask=gone)], ["doc_id", "perplexity", "log10_prob", "n_words"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_memory.lean(run), "doc_id bigint, perplexity double, log10_prob double, n_words bigint")


def op3_lm_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return perplexity(docs, train(docs))
