"""BPE vocabularies: corpus counts in Spark, merges by an incrementally kept pair index on the driver.

Few distinct words are merged by the driver at once.  Of more, executors keep
the symbols; the driver gets them in rounds, cut wherever a pair is too rare
for the round, so what it holds doesn't grow with the number of words.  None is
left out, and the merges are the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X


#: Symbols that the driver merges at once.
HELD_SYMBOLS = 4 << 20
#: Pairs that a round starts with, at most; fewer if their words' symbols are too many.
ROUND_PAIRS = 16_384
#: Pairs or pieces that a worker adds up before it passes them on.
ADDED_UP = 2 << 20


def word_counts(lines: DataFrame, column: str = "text", normalization: str | None = None) -> DataFrame:
    """``word, freq`` of words with the white space before them, of the text in a normal form if one is named."""
    text = K.arrow(K.normalize, "string", scheme=normalization)(column) if normalization else F.col(column)
    return lines.select(F.explode(X.words_with_leading_whitespace(text)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def pair_stats(words: DataFrame) -> DataFrame:
    """``first, second, freq`` of adjacent characters, weighted by word frequency."""
    cs = X.code_points("word")
    pairs = F.transform(X.numbers(0, F.size(cs) - 1), lambda i: F.struct(F.get(cs, i).alias("first"), F.get(cs, i + 1).alias("second")))
    return words.select(F.explode(pairs).alias("p"), "freq").groupBy("p.first", "p.second").agg(F.sum("freq").alias("freq"))


def train_bpe(lines: DataFrame, vocab_size: int, num_special_tokens: int = 0, column: str = "text", normalization: str | None = "NFKC", max_lines: int | None = None) -> list[tuple[bytes, bytes]]:
    """Merges of byte pairs, most frequent first, ties by the smaller pair; stops when no pair is left.

    ``vocab_size`` must be a multiple of 64 and leave room over 256 bytes and
    the special tokens.  Every distinct word counts; with ``max_lines`` those
    of the first lines by ``line_no``.
    """
    if vocab_size % 64 or vocab_size <= 256 + num_special_tokens:
        raise ValueError("vocab_size must be a multiple of 64 above 256 plus the special tokens")
    lines = lines if max_lines is None else lines.where(F.col("line_no") < max_lines)
    counted, most = word_counts(lines, column, normalization).persist(StorageLevel.DISK_ONLY), vocab_size - 256 - num_special_tokens
    try:
        if (counted.agg(F.sum(F.octet_length("word"))).collect()[0][0] or 0) > HELD_SYMBOLS:
            return _merge_in_rounds(counted, most)
        held = counted.toArrow()
    finally:
        counted.unpersist()
    data, at = _flat(held.column("word").combine_chunks().cast("large_string"), np.uint8)
    return merge_words(data, at, held.column("freq").to_numpy(), most)


def _flat(values: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of large strings or binaries in a row, and the n+1 offsets."""
    width = np.dtype(kind).itemsize
    if not len(values):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data.view(kind), (at - at[0]) // width


def _packed(symbols: np.ndarray, at: np.ndarray) -> pa.Array:
    """Pieces of symbols as binaries."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64) * 4), pa.py_buffer(np.ascontiguousarray(symbols, np.int32))]).cast(pa.binary())


def _merge_in_rounds(counted: DataFrame, most: int) -> list[tuple[bytes, bytes]]:
    """``merge_words`` over more words than the driver can hold.

    A round makes all merges whose count is at least ``least``.  Two symbols
    that stand side by side less often than that can't be merged in it, nor can
    the symbols that they become part of, since those meet at the same places
    only: words are cut there, and equal pieces counted together.  A symbol is
    made in one way only, so the pairs that are left have all their places.
    """
    spark = counted.sparkSession
    merges: list[tuple[bytes, bytes]] = []
    tokens, made = [bytes([b]) for b in range(256)], np.zeros((0, 2), np.int64)
    state, pairs = counted.mapInArrow(_as_symbols, "symbols binary, freq bigint").persist(StorageLevel.DISK_ONLY), ROUND_PAIRS
    try:
        while len(merges) < most:
            stats = state.mapInArrow(_pair_counts, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
            top = [r["n"] for r in stats.select("n").orderBy(F.desc("n")).limit(ROUND_PAIRS + 1).collect()]
            while top:
                least = 1 if len(top) <= pairs else min(top[pairs] + 1, top[0])
                kept = np.sort(np.array([r["pair"] for r in stats.where(F.col("n") >= least).select("pair").collect()], np.int64))
                shared = spark.sparkContext.broadcast(kept)
                pieces = state.mapInArrow(_pieces(shared), "symbols binary, freq bigint").groupBy("symbols").agg(F.sum("freq").alias("freq")).persist(StorageLevel.DISK_ONLY)
                size = (pieces.agg(F.sum(F.octet_length("symbols"))).collect()[0][0] or 0) // 4
                if size <= HELD_SYMBOLS or pairs == 1 or least == top[0]:
                    break
                pieces.unpersist()
                pairs = max(1, min(pairs, len(top)) // 4)
            stats.unpersist()
            if not top:
                break
            held = pieces.toArrow()
            pieces.unpersist()
            data, at = _flat(held.column("symbols").combine_chunks().cast("large_binary"), np.int32)
            ids: list[tuple[int, int]] = []
            merges += merge_words(data, at, held.column("freq").to_numpy(), most - len(merges), tokens, least, ids)
            del held, data, at
            pairs = min(ROUND_PAIRS, pairs * 16)
            made, before = np.array(ids, np.int64).reshape(-1, 2), state
            if len(merges) < most and least > 1:
                shared = spark.sparkContext.broadcast((made, len(tokens) - len(made)))
                state = state.mapInArrow(_merged(shared), "symbols binary, freq bigint").persist(StorageLevel.DISK_ONLY)
                state.count()
                before.unpersist()
            else:
                break
    finally:
        state.unpersist()
    return merges


def _as_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = _flat(b.column("word").cast("large_string"), np.uint8)
        yield pa.RecordBatch.from_arrays([_packed(data, at), b.column("freq")], ["symbols", "freq"])


def _pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a batch, offsets of its pieces, the pair from each symbol to the next and whether both are of one piece."""
    data, at = _flat(b.column("symbols").cast("large_binary"), np.int32)
    inside = np.ones(max(0, len(data) - 1), bool)
    ends = at[1:-1]
    inside[ends[(ends > 0) & (ends < len(data))] - 1] = False
    return data, at, data[:-1].astype(np.int64) << 32 | data[1:], inside


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(k), np.int64)
    np.add.at(out, at, np.concatenate(n))
    return k, out


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, n, held = [], [], 0
    for b in batches:
        _, at, pair, inside = _pairs(b)
        if not inside.any():
            continue
        keys.append(pair[inside])
        n.append(np.repeat(b.column("freq").to_numpy(), np.diff(at))[:-1][inside])
        held += len(keys[-1])
        if held > ADDED_UP:
            keys, n = ([x] for x in _summed(keys, n))
            held = len(keys[0])
            if held > ADDED_UP // 2:
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(n[0])], ["pair", "n"])
                keys, n, held = [], [], 0
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(keys, n)], ["pair", "n"])


def _pieces(kept):
    """Runs of symbols whose pairs are all among ``kept``, of two symbols at least, equal ones of a task mostly added up."""

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("symbols").aggregate([("freq", "sum")]).rename_columns(["symbols", "freq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, known = [], 0, kept.value
        for b in batches:
            data, at, pair, inside = _pairs(b)
            joined = inside.copy()
            joined[inside] = np.isin(pair[inside], known, assume_unique=False)
            if not joined.any():
                continue
            in_run = np.concatenate([joined, [False]]) | np.concatenate([[False], joined])
            first = np.flatnonzero(in_run & ~np.concatenate([[False], joined]))
            last = np.flatnonzero(in_run & ~np.concatenate([joined, [False]])) + 1
            freq = b.column("freq").to_numpy()[np.searchsorted(at, first, "right") - 1]
            packed = _packed(data[in_run], np.concatenate([[0], np.cumsum(last - first)]))
            tables.append(pa.table({"symbols": packed, "freq": freq}))
            held += int(in_run.sum())
            if held > ADDED_UP:
                tables = [added(tables)]
                held = tables[0].column("symbols").nbytes // 4
                if held > ADDED_UP // 2:
                    yield from tables[0].combine_chunks().to_batches()
                    tables, held = [], 0
        if tables:
            yield from added(tables).combine_chunks().to_batches()

    return run


def _merged(shared):
    """Pieces after the merges of a round; those of one symbol are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, first = shared.value
        keys = made[:, 0] << 32 | made[:, 1]
        order = np.argsort(keys)
        for b in batches:
            data, at = _flat(b.column("symbols").cast("large_binary"), np.int32)
            data, at = apply_merges(data, at, keys[order], order, first)
            more = np.diff(at) > 1
            if more.any():
                size = np.diff(at)[more]
                packed = _packed(data[np.repeat(more, np.diff(at))], np.concatenate([[0], np.cumsum(size)]))
                yield pa.RecordBatch.from_arrays([packed, pa.array(b.column("freq").to_numpy()[more])], ["symbols", "freq"])

    return run


def apply_merges(data: np.ndarray, at: np.ndarray, keys: np.ndarray, rank: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of symbols with n+1 offsets after merges, given as sorted pairs and their ranks; rank r makes symbol first + r.

    In each step all pieces make their merge of least rank, from the left.
    """
    if not len(keys) or len(data) < 2:
        return data, at
    none = np.int64(1 << 40)
    data, size = data.astype(np.int32), np.diff(at)
    piece = np.repeat(np.arange(len(size)), size)
    # symbols stay where they are; each has a link to the next one of its piece
    at_symbol = np.arange(len(data))
    while len(at_symbol) > 1:
        s, w = data[at_symbol], piece[at_symbol]
        pair = s[:-1].astype(np.int64) << 32 | s[1:]
        spot = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        r = np.where((keys[spot] == pair) & (w[:-1] == w[1:]), rank[spot], none)
        r = np.concatenate([r, [none]])
        starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        lowest = np.minimum.reduceat(r, starts)
        each = np.repeat(lowest, np.diff(np.concatenate([starts, [len(w)]])))
        hit = np.flatnonzero((r == each) & (r < none))
        if not len(hit):
            break
        # of overlapping occurrences, every second one from the left
        index = np.arange(len(hit))
        chained = np.concatenate([[False], (hit[1:] == hit[:-1] + 1)])
        hit = hit[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
        data[at_symbol[hit]] = first + r[hit]
        data[at_symbol[hit + 1]] = -1
        at_symbol = at_symbol[(each < none) & (data[at_symbol] >= 0)]
    left = data >= 0
    return data[left], np.concatenate([[0], np.cumsum(np.bincount(piece[left], minlength=len(size)))])


def merge_words(data: np.ndarray, at: np.ndarray, freq: np.ndarray, most: int, tokens: list[bytes] | None = None, least: int = 1, made: list[tuple[int, int]] | None = None) -> list[tuple[bytes, bytes]]:
    """Merges of distinct words given as concatenated symbols with n+1 offsets, and their frequencies.

    Words are one array of symbols with links to the neighbours; an index maps
    each pair to its positions, of which only those that still hold count.
    Symbols are bytes, or places in ``tokens``, which grows; merges that count
    less than ``least`` aren't made; ``made`` takes their pairs of symbols.
    """
    n = len(data)
    symbol = data.astype(np.int32)
    tokens = [bytes([b]) for b in range(256)] if tokens is None else tokens
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    size = np.diff(at)
    after[at[1:][size > 0] - 1] = -1
    before[at[:-1][size > 0]] = -1
    weight = np.repeat(freq.astype(np.int64), size)
    stats: dict[int, int] = {}
    where: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, bytes, bytes, int]] = []

    def key(p: np.ndarray) -> np.ndarray:
        return symbol[p].astype(np.int64) << 32 | symbol[after[p]]

    def change(p: np.ndarray, sign: int, enter: bool) -> set[int]:
        k = key(p)
        order = np.argsort(k, kind="stable")
        k, p = k[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        sums = np.add.reduceat(weight[p], first) if len(k) else first
        cut = [*first.tolist(), len(k)]
        for i, (one, total) in enumerate(zip(k[first].tolist(), sums.tolist())):
            stats[one] = stats.get(one, 0) + sign * total
            if enter:
                where.setdefault(one, []).append(p[cut[i] : cut[i + 1]])
        return set(k[first].tolist())

    def push(one: int) -> None:
        if stats[one] >= least:
            heapq.heappush(heap, (-stats[one], tokens[one >> 32], tokens[one & 0xFFFFFFFF], one))

    for one in change(np.flatnonzero(after >= 0).astype(np.int32), 1, True):
        push(one)
    merges: list[tuple[bytes, bytes]] = []
    while heap and len(merges) < most:
        count, left, right, one = heapq.heappop(heap)
        if stats.get(one, 0) != -count:
            if stats.get(one, 0) > 0:
                push(one)
            continue
        a, b = one >> 32, one & 0xFFFFFFFF
        if made is not None:
            made.append((a, b))
        merges.append((left, right))
        tokens.append(left + right)
        p = np.unique(np.concatenate(where.pop(one)))
        q = after[p]
        good = (symbol[p] == a) & (q >= 0)
        good &= symbol[q] == b
        p, q = p[good], q[good]
        if a == b:  # of overlapping occurrences, every second one from the left
            chained = np.zeros(len(p), bool)
            chained[1:] = p[1:] == q[:-1]
            index = np.arange(len(p))
            odd = (index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 1
            p, q = p[~odd], q[~odd]
        # the pairs that these positions take part in go, each once, and new ones come
        old = np.unique(np.concatenate([p, q[after[q] >= 0], before[p][before[p] >= 0]]))
        changed = change(old, -1, False)
        symbol[p] = len(tokens) - 1
        symbol[q] = -1
        right_of = after[q]
        after[p] = right_of
        before[right_of[right_of >= 0]] = p[right_of >= 0]
        before_p = before[p]
        new = np.unique(np.concatenate([p[right_of >= 0], before_p[before_p >= 0]]))
        changed |= change(new, 1, True)
        stats.pop(one, None)
        for k in changed:
            if k in stats:
                push(k)
    return merges


class MergeTable:
    """Encodes and decodes with trained merges: id = 256 + place of the merge, special tokens after them."""

    def __init__(self, merges: list[tuple[bytes, bytes]], specials: tuple[str, ...] = (), max_vocab_size: int | None = None):
        if max_vocab_size is not None:
            merges = merges[: max(0, max_vocab_size - len(specials) - 256)]
        self.rank = {p: i for i, p in enumerate(merges)}
        self.tokens = [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.specials = {s: len(self.tokens) + i for i, s in enumerate(dict.fromkeys(specials))}

    @property
    def vocab_size(self) -> int:
        return len(self.tokens) + len(self.specials)

    def token_to_id(self, token: str | bytes) -> int | None:
        return self.specials.get(token) if isinstance(token, str) and token in self.specials else self.ids.get(token.encode() if isinstance(token, str) else token)

    def id_to_token(self, i: int) -> bytes | None:
        every = self.continuations()
        return every[i] if 0 <= i < len(every) else None

    def continuations(self) -> list[bytes]:
        """The bytes of every id, special tokens included."""
        return [*self.tokens, *(s.encode() for s in self.specials)]

    def encode_word(self, word: str) -> list[int]:
        """Lowest rank first, of equal ones the leftmost, by a queue of pairs."""
        parts: list[bytes | None] = [bytes([b]) for b in word.encode()]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.rank.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(queue, (r, k, parts[k], parts[after[k]]))
        return [self.ids[p] for p in parts if p is not None]

    def decode(self, ids: list[int], ignore_special_tokens: bool = True) -> str:
        every = self.tokens if ignore_special_tokens else self.continuations()
        return b"".join(every[i] for i in ids if i < len(every)).decode("utf-8", "replace")
