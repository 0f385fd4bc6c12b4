"""BPE encoding and decoding with a pair occurrence index.

A partition's texts are pre-split into pieces, equal pieces are encoded once,
and all distinct pieces are merged together: an index maps each adjacent pair
that has a merge rank to all its positions; active ranks are taken from a
heap in ascending order, all positions of the pair merge at once, and the
lists of the pairs next to them are updated.  Merge ranks are given by pairs
(a merge never creates a pair of lower rank), so this equals merging each
piece by itself, lowest rank first.

The vocabulary file is a parameter; it is read on the driver and broadcast.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _memory, _text

#: A byte-level BPE with explicit merges, in the JSON layout of the `tokenizers` library.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text whose pieces are merged together.
INDEX_BYTES = 4 << 20

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    if not _classes:
        table = np.full(0x110000, _OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(every[m.start()]), ord(every[m.end() - 1])
                table[a : b + 1] = np.where((np.arange(a, b + 1) >= 0xD800) & (np.arange(a, b + 1) < 0xE000), table[a : b + 1], kind)
        _classes.append(table)
    return _classes[0]


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*((b, b) for b in plain), *((b, 256 + i) for i, b in enumerate(rest))]}


@dataclass
class Vocabulary:
    """Ids of single bytes, merges as sorted pair keys, and the bytes of every id."""

    byte_ids: np.ndarray
    keys: np.ndarray  # a << 32 | b, ascending
    ranks: np.ndarray
    pair_a: np.ndarray  # by rank
    pair_b: np.ndarray
    made: np.ndarray
    token_bytes: list[bytes]

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, sign = spec["model"]["vocab"], byte_symbols()
        raw = lambda token: bytes(sign[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        made = np.array([vocab[x + y] for x, y in merges], np.int64)
        token_bytes = [b""] * (max(vocab.values()) + 1)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        for token, i in vocab.items():
            token_bytes[i] = token.encode() if token in special else raw(token)
        byte_ids = np.zeros(256, np.int64)
        for c, byte in sign.items():
            byte_ids[byte] = vocab[c]
        keys = a << 32 | b
        order = np.argsort(keys, kind="stable")
        return cls(byte_ids, keys[order], order.astype(np.int64), a, b, made, token_bytes)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        out = np.empty(len(a), np.int32)
        for i in range(0, len(a), 1 << 18):
            key = a[i : i + (1 << 18)].astype(np.int64) << 32 | b[i : i + (1 << 18)]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[i : i + (1 << 18)] = np.where(self.keys[at] == key, self.ranks[at], -1)
        return out


def split_pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-split whole texts, vectorised over code points.

    Equals ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    Returns the code points, the starts of the pieces (a sentinel at the end),
    and for each text its n+1 offsets into the pieces and into the points.
    """
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    text_at = np.concatenate([[0], np.cumsum(chars)])
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if n == 0:
        return points, np.zeros(1, np.int64), np.zeros(len(chars) + 1, np.int64), text_at
    kind = _class_table()[points]
    first = np.zeros(n + 1, bool)  # first character of a text
    first[text_at] = True
    new_run = first[:n].copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    start = new_run.copy()
    space = kind == _SPACE
    # the last character of a run of white space before something else stands alone, or leads it if it is ' '
    ends = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    start[ends] = True
    lead = ends[points[ends] == 32]
    start[lead + 1] = False
    # contractions: an apostrophe alone in its run, not led by a space, before certain letters
    mark = np.flatnonzero(points == 39)
    mark = mark[start[mark] & (mark + 1 < n)]
    mark = mark[new_run[mark + 1] & (kind[mark + 1] == _LETTER) & ~first[mark + 1]]
    if len(mark):
        one = points[mark + 1]
        two = np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        short = np.isin(one, (115, 116, 109, 100))
        start[mark[short | long] + 1] = False
        after = np.concatenate([mark[short] + 2, mark[long] + 3])
        after = after[after < n]
        after = after[(kind[after] == _LETTER) & ~first[after]]
        start[after] = True
    at = np.flatnonzero(start)
    return points, np.append(at, n), np.searchsorted(at, text_at), text_at


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+sizes[i]-1, concatenated."""
    at = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(at - starts, sizes)


def merge_pieces(data: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of pieces given as concatenated bytes with n+1 offsets; returns ids and their n+1 offsets."""
    n = len(data)
    symbol = vocabulary.byte_ids.astype(np.int32)[data]
    if n == 0:
        return symbol, at
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[at[1:] - 1] = -1
    before[at[:-1]] = -1
    position = np.flatnonzero(after >= 0).astype(np.int32)
    rank = vocabulary.rank_of(symbol[position], symbol[position + 1])
    lists: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(position: np.ndarray, rank: np.ndarray) -> None:
        some = rank >= 0
        position, rank = position[some], rank[some]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        position, rank = position[order], rank[order]
        cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        begin = [0, *cut.tolist()]
        for r, i, j in zip(rank[begin].tolist(), begin, [*begin[1:], len(rank)]):
            if r in lists:
                lists[r].append(position[i:j])
            else:
                lists[r] = [position[i:j]]
                heapq.heappush(heap, r)

    enter(position, rank)
    while heap:
        r = heapq.heappop(heap)
        found = lists.pop(r)
        p = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
        a, b, made = vocabulary.pair_a[r], vocabulary.pair_b[r], vocabulary.made[r]
        q = after[p]
        good = (symbol[p] == a) & (q >= 0)
        good &= symbol[q] == b
        p, q = p[good], q[good]
        if not len(p):
            continue
        if a == b:  # of overlapping occurrences, every second one from the left
            chained = np.zeros(len(p), bool)
            chained[1:] = p[1:] == q[:-1]
            index = np.arange(len(p))
            odd = (index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 1
            p, q = p[~odd], q[~odd]
        symbol[p] = made
        symbol[q] = -1
        right = after[q]
        after[p] = right
        has = right >= 0
        before[right[has]] = p[has]
        left = before[p]
        near = np.concatenate([left[left >= 0], p[has]])
        if len(near):
            near = np.unique(near)
            enter(near, vocabulary.rank_of(symbol[near], symbol[after[near]]))
    alive = symbol >= 0
    return symbol[alive], np.concatenate([[0], np.cumsum(alive)])[at]


class Encoder:
    """Encodes Arrow string arrays; a bounded amount of text at a time shares one pair index."""

    def __init__(self, vocabulary: Vocabulary, merge=merge_pieces):
        self.vocabulary, self.merge = vocabulary, merge

    def encode(self, texts: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each array the ids of its texts, concatenated, and n+1 offsets; null texts count as empty."""
        hashes, firsts, parts = [], [], []
        for array in texts:
            array = pc.fill_null(array, "")
            points, at, piece_at, _ = split_pieces(array)
            c = _text.prefix_hash(points)
            h = _text.span_hash(c, at[:-1], at[1:]) ^ (at[1:] - at[:-1]).astype(np.uint64)
            unique, first = np.unique(h, return_index=True)
            size = at[first + 1] - at[first]
            hashes.append(unique)
            firsts.append((points[_ragged(at[first], size)], size))
            parts.append((h, piece_at))
        every, which = np.unique(np.concatenate(hashes), return_index=True)
        sizes = np.concatenate([s for _, s in firsts])
        points = np.concatenate([p for p, _ in firsts])
        begin = np.cumsum(sizes) - sizes
        size = sizes[which]
        points = points[_ragged(begin[which], size)]
        # code points to UTF-8 bytes, and piece sizes in bytes
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        total = np.concatenate([[0], np.cumsum(width)])
        at = total[np.concatenate([[0], np.cumsum(size)])]
        data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        ids, id_at = self.merge(data, at, self.vocabulary)
        out = []
        count = np.diff(id_at)
        for h, piece_at in parts:
            k = np.searchsorted(every, h)
            n = count[k]
            out.append((ids[_ragged(id_at[k], n)], np.concatenate([[0], np.cumsum(n)])[piece_at]))
        return out


def decode_ids(ids, vocabulary: Vocabulary) -> str:
    """The text of a list of ids; bytes that are no UTF-8 become U+FFFD, unknown ids raise IndexError."""
    table = vocabulary.token_bytes
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[pa.RecordBatch]]:
    group, held = [], 0
    for b in _text.slices(batches, column):
        group.append(b)
        held += b.column(column).nbytes
        if held >= INDEX_BYTES:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, check: bool = False) -> DataFrame:
    """``doc_id, token_ids, n_tokens`` of every row, from its whole text.

    With ``check`` a column ``round_trip`` says whether decoding the ids gives
    the text again.  A null text has null ids and null n_tokens (round_trip
    true); an empty text has no ids.  Strings of special tokens in a text are
    ordinary text.  Rows are encoded one by one: repeated rows repeat, a null
    doc_id stays null, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for group in _grouped(batches, "text"):
            for b, (ids, at) in zip(group, encoder.encode([b.column("text").cast(pa.string()) for b in group])):
                gone = pc.is_null(b.column("text")).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), pa.int32()), pa.array(ids.astype(np.int32)), mask=pa.array(gone))
                columns = [b.column("doc_id").cast(pa.int64()), lists, pa.array(np.diff(at).astype(np.int32), mask=gone)]
                names = ["doc_id", "token_ids", "n_tokens"]
                if check:
                    plain = ids.tolist()
                    columns.append(pa.array([t is None or decode_ids(plain[i:j], shared.value) == t for t, i, j in zip(b.column("text").to_pylist(), at[:-1].tolist(), at[1:].tolist())]))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_memory.lean(run), "doc_id bigint, token_ids array<int>, n_tokens int" + (", round_trip boolean" if check else ""))


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, text`` from ``doc_id, token_ids``; null ids give a null text, no ids an empty one."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if ids is None else decode_ids(ids, shared.value) for ids in b.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(_memory.lean(run), "doc_id bigint, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Vocabulary.load(), check=True)
