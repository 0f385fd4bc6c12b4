"""Token-ID payloads with a minimal perfect hash index.

Writing: every task encodes its documents and appends the raw ids to one
payload file in the shared folder; only (key, file, offset, length) rows move.
They are hashed into index shards; each shard gets a minimal perfect hash
(levels of bitmaps with popcount ranks) from its keys to entries that hold a
fingerprint and the place of the payload.  Reading: shard, slot, fingerprint,
payload slice - constant time a key, everything memory-mapped.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _memory, _store, _text, bpe

#: Keys of an index shard, about; the number of shards grows with the table.
SHARD_KEYS = 1_000_000
GAMMA = 2.0
LEVELS = 48


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: level after level, keys that own a bit alone are placed."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_text.mix64(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, maps = keys, [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = cls._at(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            maps.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys of a perfect hash must be distinct")
        bits = np.concatenate(maps) if maps else np.zeros(0, bool)
        words = np.packbits(bits, bitorder="little").view(np.uint64) if len(bits) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype(np.uint32) if len(words) else np.zeros(0, np.uint32)
        return cls(np.array(sizes, np.int64), words, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 if it surely isn't among the keys."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            bit = self.base[level] + self._at(keys[left], level, size)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[bit[hit] >> 6].astype(np.int64) + np.bitwise_count(below)
            left = left[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_text.mix64(keys + np.uint64(0x51ED270B7F4A7C15)) >> np.uint64(32)).astype(np.uint32)


_ENTRY = np.dtype([("fingerprint", "<u4"), ("file", "<u4"), ("offset", "<u8"), ("length", "<u4"), ("pad", "<u4")])


def _write_index(path: str, keys: np.ndarray, files: list[str], offset: np.ndarray, length: np.ndarray) -> None:
    h = PerfectHash.build(keys)
    names = sorted(set(files))
    number = {f: i for i, f in enumerate(names)}
    entry = np.zeros(len(keys), _ENTRY)
    slot = h.slots(keys)
    entry["fingerprint"][slot] = _fingerprint(keys)
    entry["file"][slot] = [number[f] for f in files]
    entry["offset"][slot], entry["length"][slot] = offset, length
    head = json.dumps({"files": names, "levels": h.sizes.tolist(), "words": len(h.words), "keys": len(keys)}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    _store.write_atomically(path, len(head).to_bytes(8, "little"), head, h.words.tobytes(), h.ranks.tobytes(), b"\0" * (-4 * len(h.ranks) % 8), entry.tobytes())


class IndexShard:
    """A memory-mapped index shard."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + size].tobytes())
        at, n = 8 + size, head["words"]
        words = raw[at : at + 8 * n].view(np.uint64)
        ranks = raw[at + 8 * n : at + 12 * n].view(np.uint32)
        at += 12 * n + (-4 * n % 8)
        self.files = head["files"]
        self.entries = raw[at : at + _ENTRY.itemsize * head["keys"]].view(_ENTRY)
        self.hash = PerfectHash(np.array(head["levels"], np.int64), words, ranks)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and whether the stored fingerprint agrees."""
        slot = self.hash.slots(keys)
        if not len(self.entries):
            return slot, np.zeros(len(keys), bool)
        return slot, (slot >= 0) & (self.entries["fingerprint"][np.maximum(slot, 0)] == _fingerprint(keys))


@dataclass
class TokenStore:
    """Places of a written store: index shards and payload files lie in ``path``."""

    path: str
    shards: int


class _Pieces:
    """Encodes distinct pre-split pieces with tiktoken's merge loop; same ids as the vocabulary's merges."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        ranks = {t: i for i, t in enumerate(vocabulary.token_bytes) if t != b"<|endoftext|>"}
        self.encode = tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.known = ranks

    def __call__(self, data: np.ndarray, at: np.ndarray, vocabulary: bpe.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = data.tobytes(), at.tolist()
        out, sizes = [], []
        for i, j in zip(ends[:-1], ends[1:]):
            ids = self.encode(raw[i:j])
            out += ids
            sizes.append(len(ids))
        return np.array(out, np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def write_store(docs: DataFrame, vocabulary: bpe.Vocabulary) -> TokenStore:
    """Encode ``docs`` (doc_id, text) and write payloads and index.

    Rows with a null doc_id can't be looked up and are left out; a null text
    counts as empty (length 0).  Of rows that repeat a doc_id the longest
    payload is indexed, ties by its checksum.  Other columns are not read.  An
    empty table gives a store without shards, where nothing is found.
    """
    spark = docs.sparkSession
    uri = _store.new_dir(spark, "token-store")
    path = _store.local_path(uri)
    shared = spark.sparkContext.broadcast(vocabulary)
    wide = np.uint16 if len(vocabulary.token_bytes) <= 1 << 16 else np.uint32

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.Encoder(shared.value, _Pieces(shared.value))
        name = f"payload-{uuid.uuid4().hex}.{np.dtype(wide).name}"  # a retried task writes another file
        done = 0
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{name}", "wb") as f:
            for group in bpe._grouped(batches, "text"):
                for b, (ids, at) in zip(group, encoder.encode([b.column("text").cast(pa.string()) for b in group])):
                    raw = ids.astype(wide).tobytes()
                    f.write(raw)
                    w = np.dtype(wide).itemsize
                    sums = [xxhash.xxh64_intdigest(raw[w * i : w * j]) >> 1 for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                    n = b.num_rows
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([name] * n), pa.array(at[:-1] + done), pa.array(np.diff(at)), pa.array(sums, pa.int64())], ["doc_id", "file", "offset", "length", "checksum"])
                    done += int(at[-1])
                f.flush()

    places = _store.settle(docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL").mapInArrow(_memory.lean(write), "doc_id bigint, file string, offset bigint, length bigint, checksum bigint"), "token-places")
    n = places.count()
    shards = -(-n // SHARD_KEYS)
    if not n:
        return TokenStore(path, 0)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if batches else None
        if rows is None or not rows.num_rows:
            return
        for shard in pc.unique(rows.column("shard")).to_pylist():
            own = rows.filter(pc.equal(rows.column("shard"), shard)).sort_by([("doc_id", "ascending"), ("length", "descending"), ("checksum", "ascending")])
            keys = own.column("doc_id").to_numpy()
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            own, keys = own.filter(pa.array(first)), keys[first]
            _write_index(f"{path}/index-{shard:06d}.mph", keys.view(np.uint64), own.column("file").to_pylist(), own.column("offset").to_numpy(), own.column("length").to_numpy())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_keys": pa.array([len(keys)], pa.int64())})

    placed = places.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    placed.mapInArrow(_memory.lean(_nonempty(index)), "shard int, n_keys bigint").agg(F.sum("n_keys")).collect()
    return TokenStore(path, shards)


def _nonempty(f):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from f(held)

    return run


def lookup(keys: DataFrame, store: TokenStore, with_ids: bool = False) -> DataFrame:
    """Keyed access for every row of ``keys`` (doc_id).

    Returns ``doc_id, found, shard, slot, offset, n_tokens, checksum`` (and
    ``token_ids``); a key that isn't there, a null key among them, has found =
    false and nulls.  A foreign key passes its fingerprint by chance once in
    2^32.  Repeated keys repeat.
    """
    path, shards = store.path, store.shards

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, IndexShard] = {}
        payloads: dict[str, np.memmap] = {}
        for b in batches:
            ids = b.column("doc_id")
            n = b.num_rows
            key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            valid = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            shard = pc.fill_null(b.column("shard"), 0).to_numpy(zero_copy_only=False)
            found, slot, offset, length = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            sums, lists = np.zeros(n, np.int64), [None] * n
            for s in np.unique(shard).tolist() if shards else []:
                if not os.path.exists(name := f"{path}/index-{s:06d}.mph"):
                    continue  # no key fell into this shard
                part = opened.setdefault(s, None) or IndexShard(name)
                opened[s] = part
                own = np.flatnonzero((shard == s) & valid)
                at, ok = part.find(key[own])
                own, at = own[ok], at[ok]
                e = part.entries[at]
                found[own], slot[own], offset[own], length[own] = True, at, e["offset"], e["length"]
                for k in np.lexsort((e["offset"], e["file"])).tolist():
                    f = part.files[e["file"][k]]
                    if f not in payloads:
                        full, kind = f"{path}/{f}", f.rpartition(".")[2]
                        payloads[f] = np.memmap(full, kind, "r") if os.path.getsize(full) else np.zeros(0, kind)
                    o, m = int(e["offset"][k]), int(e["length"][k])
                    ids_of = payloads[f][o : o + m]
                    sums[own[k]] = xxhash.xxh64_intdigest(ids_of.tobytes()) >> 1
                    if with_ids:
                        lists[own[k]] = ids_of.tolist()
            gone = ~found
            columns = [ids.cast(pa.int64()), pa.array(found), pa.array(shard.astype(np.int32), mask=gone), *(pa.array(x, mask=gone) for x in (slot, offset, length, sums))]
            names = ["doc_id", "found", "shard", "slot", "offset", "n_tokens", "checksum"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, shards))).cast("int")
    out = "doc_id bigint, found boolean, shard int, slot bigint, offset bigint, n_tokens bigint, checksum bigint" + (", token_ids array<int>" if with_ids else "")
    return keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).withColumn("shard", shard).mapInArrow(_memory.lean(read), out)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the store of all documents, then look every document up through the index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lookup(docs, write_store(docs, bpe.Vocabulary.load()))
