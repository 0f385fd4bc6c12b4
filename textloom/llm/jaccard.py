"""N-gram Jaccard self-join by grouped prefixes.

Documents become sets of word n-grams.  Equal sets collapse; sets that agree
in size and in their whole prefix collapse into one group.  Under a global
order (frequent grams last) two sets of Jaccard similarity >= t share a gram
of their prefixes and have sizes within a factor t, so groups are met on
prefix grams; pairs of groups are filtered by size and parity bitmaps, expanded to
member sets and verified on the whole sets of gram hashes.  Members of one
group are met on the prefixes of what their sets have beyond the common
prefix.  No cap on postings, partners or members.

A cluster of m near copies has about m * m / 2 links, and m grows with the
corpus.  So sets that share a least hash are first compared with one of them;
sets that such links connect aren't met again.  All links lie within connected
components; where they are counted, the overlaps of a component are taken from
blocks of its incidence matrix, as bits.

What moves: prefix grams and candidate pairs travel as packed numpy blobs, one
row for a bucket and task; texts never move.  Sets lie in memory-mapped files
of the shared folder, written and read by place.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _memory, _store, _text, setstore

N = 3
THRESHOLD = 0.6
#: Prefix grams met in one bucket, about; the number of buckets grows with the corpus.
BUCKET_GRAMS = 2_000_000
#: Pairs of sets verified by one task, about.
TASK_PAIRS = 40_000
#: Frequent grams broadcast to order the others before them, at most.  Only the order, not the result, depends on it.
MAX_FREQUENT = 2_000_000
#: Least hashes of a set by which it is compared with one other set each, before the join.  Only the cost depends on it.
SKETCH = 4
#: Sets, and grams, of a component that are counted against as many others at once, about.
BLOCK_SETS, BLOCK_GRAMS = 1024, 1_000_000
#: Links counted by one task, about, if all sets of a block are linked; a set costs as much as SET_CELLS.
TASK_CELLS, SET_CELLS = 1 << 24, 1 << 12
#: Grams of whole texts ordered at once, about.
RAW_GRAMS = 1 << 17
_PAIR_CHUNK = 500_000
#: Words of bits that are compared at once, about; as many as fit a cache.
_CELLS = 1 << 17
#: Bytes of bitmaps that are compared at once, about.
_BITMAP_BYTES = 32 << 20
#: Bytes of a gram in files of unordered sets, and the columns of ``_scan``.
_RAW, _SCAN = setstore.GRAM_BITS // 8, ["doc_id", "key", "number", "at", "size", "gram", "n"]
_MASK = np.uint64((1 << setstore.GRAM_BITS) - 1)


def _prefix(size: np.ndarray | int, t: float):
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each text (hashes of GRAM_BITS bits) ordered by text, then value; and the n+1 offsets."""
    w, at = _text.word_hashes(_text.normalise(texts))
    g, of = _text.gram_hashes(w, at, n)
    g = g & _MASK
    key = np.unique(of.astype(np.uint64) << np.uint64(setstore.GRAM_BITS) | g)
    return key & _MASK, np.searchsorted(key >> np.uint64(setstore.GRAM_BITS), np.arange(len(texts) + 1))


def _signature(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit hash of each set as two columns; order-free sums of mixed grams."""
    lo, hi = _text.mix64(grams + np.uint64(1)), _text.mix64(grams ^ np.uint64(0xC3A5C85C97CB3127))
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (lo, hi)]
    size = np.diff(at).astype(np.uint64)
    return np.stack([_text.mix64((s[at[1:]] - s[at[:-1]]) ^ size) for s in sums], 1)


def _sketch(grams: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """SKETCH least hashes of each set; two sets share one with the probability of their Jaccard similarity.  0 for empty sets."""
    mixed, full = _text.mix64(grams ^ np.uint64(0x5851F42D4C957F2D)), np.flatnonzero(np.diff(at))
    out = []
    for k in range(SKETCH):
        least = np.zeros(len(at) - 1, np.uint64)
        if len(full):
            odd = _text.mix64(np.array([k + 1], np.uint64)) | np.uint64(1)
            least[full] = np.minimum.reduceat(mixed * odd, at[full])
        out.append(least)
    return out


def _scan(docs: DataFrame, folder: str, n: int) -> DataFrame:
    """The sets of all texts, by value of gram, in files ``raw-<number>`` of ``folder``; each text is read this once.

    Rows (doc_id, key, number, at, size) of each document, with its place in bytes, and (gram, n) of grams
    frequent in some task's share of the corpus, with their document frequency there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        number, own = _file_number(), f"{folder}/{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            yield from _write(f, batches, number)
        os.replace(own, f"{folder}/raw-{number}")

    def _write(f, batches, number):
        seen, rows, done = [], 0, 0

        def flush():
            grams, count = np.unique(np.concatenate(seen), return_counts=True)
            often = count >= max(3, rows / 2000)
            return _scan_rows(gram=pa.array(grams[often].astype(np.int64)), n=pa.array(count[often]))

        for b in _text.slices(batches, "text"):
            grams, at = _sets(b.column("text").cast(pa.string()), n)
            f.write(np.ascontiguousarray(grams).view(np.uint8).reshape(-1, 8)[:, :_RAW].tobytes())
            f.flush()
            yield _scan_rows(doc_id=b.column("doc_id"), key=b.column("key"), number=pa.array(np.full(b.num_rows, number)), at=pa.array(done + at[:-1] * _RAW), size=pa.array(np.diff(at)))
            done += len(grams) * _RAW
            seen.append(grams)
            rows += b.num_rows
            if sum(map(len, seen)) >= 3_000_000:
                yield flush()
                seen, rows = [], 0
        if seen:
            yield flush()

    return _store.settle(docs.mapInArrow(_memory.lean(run), ", ".join(f"{c} bigint" for c in _SCAN)), "gram-scan")


def _scan_rows(**columns: pa.Array) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, pa.int64()) for c in _SCAN], _SCAN)


def _file_number() -> int:
    """Of this task's file; a retried or speculative task writes one of another number."""
    context = TaskContext.get()
    return context.partitionId() << 3 | min(context.attemptNumber(), 7)


def _frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams frequent in some task's share of the corpus and their document frequency there, sorted by gram."""
    found = scan.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "gram").limit(MAX_FREQUENT).toArrow()
    grams, count = top.column("gram").to_numpy().astype(np.uint64), top.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], count[order]


def _raw_slices(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of one file of ``_scan``, in its order, in slices; the grams of their sets and the n+1 offsets."""
    raw = None
    for b in batches:
        start, size = b.column("at").to_numpy(), b.column("size").to_numpy()
        if raw is None and size.any():
            raw = np.memmap(f"{folder}/raw-{b.column('number')[0].as_py()}", np.uint8, "r")
        ends, i = np.cumsum(size), 0
        while i < len(size):
            base = ends[i - 1] if i else 0
            j = max(i + 1, min(i + _text.SLICE_ROWS, int(np.searchsorted(ends, base + RAW_GRAMS, "right"))))
            grams = np.zeros((int(ends[j - 1] - base), 8), np.uint8)
            if len(grams):
                grams[:, :_RAW] = raw[start[i] : start[i] + len(grams) * _RAW].reshape(-1, _RAW)
            yield b.slice(i, j - i), grams.view(np.uint64).ravel(), np.concatenate([[0], ends[i:j] - base])
            i = j


class _Order:
    """Global order of grams: unlisted ones by value, then listed ones by frequency and value."""

    def __init__(self, grams: np.ndarray, count: np.ndarray):
        self.grams = grams
        self.place = np.empty(len(grams), np.uint64)
        self.place[np.lexsort((grams, count))] = np.arange(len(grams), dtype=np.uint64) + np.uint64(1 << setstore.GRAM_BITS)
        self.door = np.zeros(1 << 20, bool)
        self.door[(grams >> np.uint64(setstore.GRAM_BITS - 20)).astype(np.int64)] = True

    def key(self, grams: np.ndarray) -> np.ndarray:
        key = grams.copy()
        maybe = np.flatnonzero(self.door[(grams >> np.uint64(setstore.GRAM_BITS - 20)).astype(np.int64)])
        if len(maybe) and len(self.grams):
            k = np.minimum(np.searchsorted(self.grams, grams[maybe]), len(self.grams) - 1)
            hit = self.grams[k] == grams[maybe]
            key[maybe[hit]] = self.place[k[hit]]
        return key


def _key() -> Column:
    """64-bit hash of a document's id and text; rows that agree in both share their fate."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


class NearPairs:
    """The stages of the join over one table, as written tables.

    ``placed`` (doc_id, key, sid?, sig_a, sig_b) has every row, without a sid where
    there is no word, ``key`` as of ``_key``; ``sets`` (sid, sig_a, sig_b, rows, least_id) every
    distinct set; ``pairs`` (a, b, jaccard) verified links that connect all sets
    which links connect, ``roots`` (node, root) these components.  With
    ``counts``, ``linked`` (sid, linked) has the rows of all sets that a set is
    linked to.
    """

    def __init__(self, docs: DataFrame, n: int = N, t: float = THRESHOLD, counts: bool = False):
        self.spark, self.n, self.t = docs.sparkSession, n, t
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), _key().alias("key"))
        self.folder = _store.local_path(_store.new_dir(self.spark, "gram-sets"))
        self.placed = self._write_sets()
        # the first row of each distinct set stands for all of them
        first = F.min(F.struct("sid", "group_a", "group_b", "size", "sketch")).alias("first")
        distinct = self.placed.where("sid IS NOT NULL").groupBy("sig_a", "sig_b").agg(first, F.count("*").alias("rows"), F.min("doc_id").alias("least_id"))
        self.sets = _store.settle(distinct.select("first.*", "sig_a", "sig_b", "rows", "least_id"), "distinct-sets")
        # each step is written: otherwise one stage would run the Python workers of both its ends at once
        stars = _store.settle(self._stars(), "star-pairs")
        links = self._verify(stars)
        self.rooted = _store.settle(self.sets.select("sid", "size", "group_a", "group_b").join(components(links).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", F.lit(-1))), "rooted-sets")
        found = _store.settle(self._candidates(), "group-pairs")
        wide = _store.settle(self._expand(found), "set-pairs")
        self.pairs = links.unionByName(self._verify(wide)).distinct()
        self.roots = components(self.pairs)
        if counts:
            self.linked = self._count_links()
        _store.discard(stars, found, wide, self.members, self.groups, self.rooted)
        _store.discard_folder(self.folder)

    def _write_sets(self) -> DataFrame:
        unordered = _store.local_path(_store.new_dir(self.spark, "raw-sets"))
        scan = _scan(self.docs, unordered, self.n)
        order = self.spark.sparkContext.broadcast(_Order(*_frequent(scan)))
        folder, t = self.folder, self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            os.makedirs(folder, exist_ok=True)
            number, own = _file_number(), f"{folder}/{uuid.uuid4().hex}"
            with open(own, "wb") as f:
                yield from _write(f, batches, number)
            os.replace(own, f"{folder}/sets-{number}")

        def _write(f, batches, number):
            done = 0
            for b, grams, at in _raw_slices(unordered, batches):
                size = np.diff(at)
                owner = np.repeat(np.arange(len(size)), size)
                # keys have a bit more than grams, and a slice has at most SLICE_ROWS rows
                grams = grams[np.argsort(owner.astype(np.uint64) << np.uint64(setstore.GRAM_BITS + 1) | order.value.key(grams))]
                sig = _signature(grams, at)
                k = _prefix(size, t)
                inner = np.arange(len(grams)) - at[:-1][owner] < k[owner]
                group = []
                for salt in (7, 0x51ED270B):  # 128 bits of size and prefix
                    mixed = np.concatenate([[np.uint64(0)], np.cumsum(np.where(inner, _text.mix64(grams + np.uint64(salt)), np.uint64(0)), dtype=np.uint64)])
                    group.append(_text.mix64((mixed[at[1:]] - mixed[at[:-1]]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                least = np.stack(_sketch(grams, at), 1).view(np.int64).ravel()
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * SKETCH), pa.array(least))
                sid = np.zeros(len(size), np.int64)
                for i in np.flatnonzero(size).tolist():
                    raw = setstore.record(grams[at[i] : at[i + 1]])
                    f.write(raw)
                    sid[i] = number << setstore.OFFSET_BITS | done
                    done += len(raw)
                f.flush()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("key"), pa.array(sid, mask=size == 0), pa.array(size), *(pa.array(x.view(np.int64)) for x in (*group, np.ascontiguousarray(sig[:, 0]), np.ascontiguousarray(sig[:, 1]))), sketch],
                    ["doc_id", "key", "sid", "size", "group_a", "group_b", "sig_a", "sig_b", "sketch"],
                )

        # a task for each file; a document without grams has the place of the next one and comes before it
        files = (scan.agg(F.max("number")).first()[0] or 0) // 8 + 1
        places = scan.where("number IS NOT NULL").select("doc_id", "key", "number", "at", "size").repartitionById(files, F.shiftright("number", 3).cast("int")).sortWithinPartitions("number", "at", "size")
        out = _store.settle(places.mapInArrow(_memory.lean(run), "doc_id bigint, key bigint, sid bigint, size bigint, group_a bigint, group_b bigint, sig_a bigint, sig_b bigint, sketch array<bigint>"), "set-places")
        _store.discard(scan)
        _store.discard_folder(unordered)
        order.unpersist()
        return out

    def _stars(self) -> DataFrame:
        """Pairs (a, b), a < b, each once: of the sets that share a least hash, one of median size with all others whose sizes allow t."""
        t = self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            key, sid, size = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
            order = np.lexsort((sid, size, key))
            key, sid, size = key[order], sid[order], size[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(start, append=len(key))
            middle = np.repeat(start + length // 2, length)
            other = sid[middle]
            good = np.flatnonzero((sid != other) & (np.minimum(size, size[middle]) >= t * np.maximum(size, size[middle]) - 1e-9))
            for i in range(0, len(good), 50_000):
                a, b = sid[good[i : i + 50_000]], other[good[i : i + 50_000]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        keys = self.sets.select(F.explode("sketch").alias("key"), "sid", "size")
        return keys.repartition("key").mapInArrow(_memory.lean(run), "a bigint, b bigint").distinct()

    def _candidates(self) -> DataFrame:
        """Pairs (a, b) of sets that stand for groups and share a prefix gram, or that lie in one group and share a gram of the prefix of what is left.

        Sizes allow t, a < b, each pair once; no pairs of one root.  Two sets of one group agree in
        size s and in k prefix grams; to overlap in o grams they must share
        o - k of the s - k others, hence one of the first s - o + 1 of these.
        """
        folder, t = self.folder, self.t
        # a group has a root if all its members have that one
        one_root = F.when(F.min("root") == F.max("root"), F.min("root")).otherwise(-1).alias("root")
        groups = self.rooted.groupBy("group_a", "group_b").agg(F.min("sid").alias("gid"), F.count("*").alias("n"), F.min("size").alias("size"), one_root)
        self.groups = _store.settle(groups, "set-groups")
        several = self.groups.where("n > 1")
        of_several = several.select("group_a", "group_b", "gid", F.col("root").alias("common"))
        self.members = _store.settle(self.rooted.join(of_several, ["group_a", "group_b"]).select("sid", "gid", "root", "common"), "group-members")
        total, count = self.groups.agg(F.sum("size"), F.count("*")).first()
        buckets = max(1, -(-int((total or 0) * (1 - t) + (count or 0)) // BUCKET_GRAMS))
        entries = self.groups.select(F.col("gid").alias("sid"), F.when(F.col("n") > 1, -2).otherwise(-1).cast("bigint").alias("inside"), "root").unionByName(self.members.where("common = -1").select("sid", F.col("gid").alias("inside"), "root"))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = setstore.Reader(folder)
            held: list[tuple[np.ndarray, int, int, int, int]] = []
            room = 0

            def flush():
                grams, lengths = np.concatenate([x[0] for x in held]), np.array([len(x[0]) for x in held])
                owner = np.repeat(np.arange(len(held), dtype=np.uint32), lengths)
                ids, sizes, firsts, roots = (np.array([x[k] for x in held], kind) for k, kind in ((1, np.int64), (2, np.uint32), (3, np.int64), (4, np.int64)))
                index = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < firsts[owner]
                bucket = ((_text.mix64(grams) >> np.uint64(24)) % np.uint64(buckets)).astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint32))
                grams = grams.astype(np.uint32)
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    mine = order[cut[k] : cut[k + 1]]
                    who, at, count = np.unique(owner[mine], return_index=True, return_counts=True)
                    some = np.add.reduceat(index[mine], at, dtype=np.uint32)
                    # of each owner in turn: its grams, how many, how many of them in front; ids ascend, differences compress
                    parts = (setstore.planes(grams[mine]), setstore.planes(count.astype(np.uint32)), setstore.planes(some), setstore.planes(np.diff(ids[who], prepend=0)), setstore.planes(sizes[who]), setstore.planes(roots[who]))
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((k, *parts), (pa.int32(), *[pa.binary()] * 6))], ["bucket", "grams", "counts", "fronts", "ids", "sizes", "roots"])

            for b in batches:
                for sid, inside, root in zip(*(b.column(c).to_pylist() for c in ("sid", "inside", "root"))):
                    size = reader.size(sid)
                    k = int(_prefix(size, t))
                    both = int(np.ceil(2 * t / (1 + t) * size - 1e-9))
                    if inside < 0:
                        held.append((reader.grams(sid, k), sid, size | (inside == -2) << 31, size - both + 1, root))
                    else:
                        need = both - k
                        rest = reader.grams(sid, size - k - need + 1 + k)[k:] if need > 0 else np.zeros(1, np.uint64)
                        held.append((_text.mix64(rest ^ _text.mix64(np.array([inside], np.uint64))) & _MASK, sid, size, size, root))
                    room += len(held[-1][0])
                    if room >= BUCKET_GRAMS:
                        yield from flush()
                        held.clear()
                        room = 0
            if held:
                yield from flush()

        blobs = entries.repartitionByRange(max(1, -(-int(count or 0) // 4000)), "sid").sortWithinPartitions("sid").mapInArrow(_memory.lean(emit), "bucket int, grams binary, counts binary, fronts binary, ids binary, sizes binary, roots binary")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(1, 7)))]
            if parts:
                yield from _pack(*_bounded(setstore.Reader(folder), *_meet(parts, t), t), buckets)

        # a partition is a bucket
        packed = blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(_memory.lean(meet), "bucket int, ids binary, a binary, b binary")

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = []
            for b in batches:
                for ids, x, y in zip(*(b.column(i).to_pylist() for i in range(1, 4))):
                    ids = np.cumsum(setstore.from_planes(ids, np.int64))
                    found.append(np.stack([ids[np.cumsum(setstore.from_planes(x, np.uint32))], ids[setstore.from_planes(y, np.uint32)]], 1))
                if sum(map(len, found)) > 4 * _PAIR_CHUNK:
                    found = [_distinct(np.concatenate(found))]
            if found:
                both = _distinct(np.concatenate(found))
                for i in range(0, len(both), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(both[i : i + 50_000, 0]), pa.array(both[i : i + 50_000, 1])], ["a", "b"])

        return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(_memory.lean(once), "a bigint, b bigint")

    def _expand(self, found: DataFrame) -> DataFrame:
        """Pairs of sets: those of one group as they are, others as all members of the one with all of the other."""
        of = lambda s: self.members.select(F.col("sid").alias(s), F.col("gid").alias(f"g{s}"))
        with_groups = found.join(of("a"), "a", "left").join(of("b"), "b", "left")
        inside = with_groups.where("ga = gb").select("a", "b")
        out = with_groups.where("NOT (ga <=> gb AND ga IS NOT NULL) AND a = coalesce(ga, a) AND b = coalesce(gb, b)").select("a", "b")
        for side in ("a", "b"):
            out = out.join(self.members.select(F.col("gid").alias(side), F.col("sid").alias("more")), side, "left").withColumn(side, F.coalesce("more", side)).drop("more")
        out = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(inside)
        return out

    def _verify(self, candidates: DataFrame) -> DataFrame:
        folder, t = self.folder, self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = setstore.Reader(folder)
            for batch in batches:
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                if not len(a):
                    continue
                ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                names = ids.tolist()
                size = np.array([reader.size(i) for i in names], np.int64)
                x, y = at[: len(a)], at[len(a) :]
                shared = np.zeros(len(x), np.int64)
                held: dict[int, np.ndarray] = {}
                room = [0]

                def sorted_set(i: int) -> np.ndarray:
                    if i not in held:
                        room[0] += 8 * size[i]
                        if room[0] > 64 << 20:
                            held.clear()
                            room[0] = 8 * size[i]
                        held[i] = np.sort(reader.grams(names[i]))
                    return held[i]

                order = np.lexsort((y, x))
                cut = np.flatnonzero(np.diff(x[order], prepend=-1)).tolist() + [len(order)]
                for i, j in zip(cut[:-1], cut[1:]):
                    one, many = sorted_set(x[order[i]]), [sorted_set(k) for k in y[order[i:j]].tolist()]
                    joined = np.concatenate(many)
                    k = np.minimum(np.searchsorted(one, joined), len(one) - 1)
                    shared[order[i:j]] = np.add.reduceat(one[k] == joined, np.cumsum([0, *map(len, many[:-1])]))
                both = size[x] + size[y] - shared
                good = np.flatnonzero((shared > 0) & (shared >= t * both - 1e-9))
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good]), pa.array(shared[good] / both[good])], ["a", "b", "jaccard"])

        # as many tasks as pairs ask for; all pairs of a set in one task, as its grams are read once
        tasks = max(1, -(-candidates.count() // TASK_PAIRS))
        spread = candidates.withColumn("task", F.pmod(F.xxhash64("a", (F.xxhash64("b") % 4)), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task")).select("a", "b")
        return _store.settle(spread.mapInArrow(_memory.lean(run), "a bigint, b bigint, jaccard double"), "near-pairs")

    def _count_links(self) -> DataFrame:
        """``sid, linked``: the rows of all sets linked to a set.  Both ends of a link lie in one component, whose sets are compared block by block."""
        folder, t = self.folder, self.t
        component = Window.partitionBy("root")
        share = F.greatest(F.col("size") / BLOCK_GRAMS, F.lit(1 / BLOCK_SETS))
        each = self.sets.select("sid", "size", "rows").join(self.roots.withColumnRenamed("node", "sid"), "sid")
        each = each.withColumns({"n": F.count("*").over(component), "all": F.sum("rows").over(component), "block": F.floor(F.sum(share).over(component.orderBy("size", "sid").rowsBetween(Window.unboundedPreceding, 0)))})
        each = _store.settle(each, "component-sets")
        blocks = each.where("n > 2").groupBy("root", "block").agg(F.collect_list("sid").alias("sids"), F.collect_list("rows").alias("rows"), F.min("size").alias("low"), F.max("size").alias("high"), F.count("*").alias("n"))
        blocks = _store.settle(blocks, "set-blocks")
        left, right = (blocks.select("root", *(F.col(c).alias(f"{c}_{s}") for c in blocks.columns[1:])) for s in "ab")
        # sizes ascend with blocks
        units = left.join(right, "root").where((F.col("block_a") <= F.col("block_b")) & (F.col("high_a") >= t * F.col("low_b") - 1e-6))
        cells = units.agg(F.sum((F.col("n_a") + F.col("n_b")) * SET_CELLS + F.col("n_a") * F.col("n_b"))).first()[0] or 0
        tasks = max(1, -(-cells // TASK_CELLS))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = setstore.Reader(folder)
            for b in batches:
                for unit in b.to_pylist():
                    one = unit["block_a"] == unit["block_b"]
                    of_a, of_b = _linked(reader, unit["sids_a"], unit["rows_a"], *((None, None) if one else (unit["sids_b"], unit["rows_b"])), t)
                    yield pa.RecordBatch.from_arrays([pa.array(unit["sids_a"], pa.int64()), pa.array(of_a)], ["sid", "linked"])
                    if not one:
                        yield pa.RecordBatch.from_arrays([pa.array(unit["sids_b"], pa.int64()), pa.array(of_b)], ["sid", "linked"])

        spread = units.withColumn("task", F.pmod(F.xxhash64("root", "block_a", "block_b"), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task")).select("block_a", "block_b", "sids_a", "rows_a", "sids_b", "rows_b")
        counted = spread.mapInArrow(_memory.lean(run), "sid bigint, linked bigint").groupBy("sid").agg(F.sum("linked").alias("linked"))
        # two sets are a component because they are linked
        out = _store.settle(counted.unionByName(each.where("n = 2").select("sid", (F.col("all") - F.col("rows")).alias("linked"))), "link-counts")
        _store.discard(each, blocks)
        return out


def _bits(own: np.ndarray, column: np.ndarray, sets: int, some: np.ndarray) -> np.ndarray:
    """Which of the columns ``some`` each set has: 64-bit words by set, of entries (own, column) in order of columns."""
    i, j = np.searchsorted(column, (some[0], some[-1] + 1))
    at = np.searchsorted(some, column[i:j])
    hit = some[at] == column[i:j]
    bits = np.zeros((sets, -(-len(some) // 64) * 64), bool)
    bits[own[i:j][hit], at[hit]] = True
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T)


def _linked(reader: setstore.Reader, a: list[int], rows_a: list[int], b: list[int] | None, rows_b: list[int] | None, t: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of ``a`` the sum of ``rows_b`` over its links to sets of ``b``, and the reverse; without ``b``, links within ``a``.

    Overlaps are counted in incidence matrices of bits; grams that few sets have are counted pair by pair.  No matrix product:
    its threads would get in the way of other tasks.
    """
    one = b is None
    held = [[reader.grams(i) for i in ids] for ids in ([a] if one else [a, b])]
    size = [np.array([len(x) for x in sets], np.int64) for sets in held]
    own = [np.repeat(np.arange(len(s)), s) for s in size]
    names, column = np.unique(np.concatenate([x for sets in held for x in sets]), return_inverse=True)
    column = [column[: len(own[0])], column[len(own[0]) :]][: len(held)]
    del held
    sides = []
    for of, c in zip(own, column):
        order = np.argsort(c, kind="stable")
        sides.append((of[order], c[order], np.bincount(c, minlength=len(names))))
    sides = (sides[0], sides[-1])
    (own_a, col_a, have_a), (own_b, col_b, have_b) = sides
    size_a, size_b = size[0], size[-1]
    shared = np.zeros((len(size_a), len(size_b)), np.int64)
    pairs = have_a * have_b
    few = pairs * 128 < shared.size
    # grams of many sets
    many = np.flatnonzero((pairs > one) & ~few)
    for i in range(0, len(many), 4096):
        some = many[i : i + 4096]
        p, q = (_bits(of, c, len(s), some) for (of, c, _), s in zip(sides, (size_a, size_b)))
        tile = max(1, _CELLS // len(size_b))
        for x in range(0, len(size_a), tile):
            own = p[:, x : x + tile, None]
            step = max(1, _CELLS // (own.shape[1] * len(size_b)))
            for w in range(0, len(p), step):
                shared[x : x + tile] += np.bitwise_count(own[w : w + step] & q[w : w + step, None, :]).sum(0, dtype=np.int64)
    # grams of few
    start = np.cumsum(have_b) - have_b
    mine = np.flatnonzero((few & (pairs > one))[col_a])
    count = have_b[col_a[mine]]
    ends, i = np.cumsum(count), 0
    while i < len(mine):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 4 * _PAIR_CHUNK, "right")))
        c = count[i:j]
        left = np.repeat(mine[i:j], c)
        right = start[col_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
        shared += np.bincount(own_a[left] * len(size_b) + own_b[right], minlength=shared.size).reshape(shared.shape)
        i = j
    link = (shared > 0) & (shared >= t * (size_a[:, None] + size_b[None, :] - shared) - 1e-9)
    if one:
        np.fill_diagonal(link, False)
    link = link.astype(np.float64)
    return tuple((x @ np.array(rows, np.float64)).astype(np.int64) for x, rows in ((link, rows_a if one else rows_b), (link.T, rows_a)))


def _distinct(both: np.ndarray) -> np.ndarray:
    """The distinct rows of an array of two columns, sorted."""
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return both[np.concatenate([[True], (both[1:] != both[:-1]).any(1)])] if len(both) else both


def _meet(parts: list[tuple[bytes, ...]], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of groups of different roots that share a gram of this bucket within the size bound.

    As ids, in order, and their sizes, and pairs (x, y) of places among these, in order; whether either has several sets.
    """
    grams, counts, fronts, ids, sizes, roots = [], [], [], [], [], []
    for g, c, f, i, s, r in parts:
        grams.append(setstore.from_planes(g, np.uint32))
        counts.append(setstore.from_planes(c, np.uint32))
        fronts.append(setstore.from_planes(f, np.uint32))
        ids.append(np.cumsum(setstore.from_planes(i, np.int64)))
        sizes.append(setstore.from_planes(s, np.uint32).astype(np.int64))
        roots.append(setstore.from_planes(r, np.int64))
    gram, count, some, ids, size, root = (np.concatenate(x) for x in (grams, counts, fronts, ids, sizes, roots))
    own = np.repeat(np.arange(len(ids), dtype=np.int32), count)
    front = np.arange(len(gram)) - np.repeat(np.cumsum(count) - count, count) < some[own]
    names, dense = np.unique(ids, return_inverse=True)
    # small numbers for roots; what has none is a root of its own
    tops, numbers = np.unique(root, return_inverse=True)
    root = np.where(root < 0, len(tops) + dense, numbers).astype(np.int32)[own]
    own = dense.astype(np.int32)[own]
    of_name = np.zeros(len(names), np.int64)
    of_name[dense] = size & 0x7FFFFFFF
    several = np.bincount(dense, size >> 31, len(names)) > 0
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])[: len(gram)])
    mixed = np.zeros(0, np.int64)
    if len(gram):
        root = root[order]
        differ = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        mixed = np.flatnonzero(np.repeat(differ, np.diff(start, append=len(gram))))
    if not len(mixed):
        return names, of_name, dense[:0], dense[:0], several[:0]
    gram, own, front, root = gram[mixed], own[order[mixed]], front[order[mixed]], root[mixed]
    order = np.lexsort((own, of_name[own], gram))
    gram, own, front, root = gram[order], own[order], front[order], root[order]
    s = of_name[own]
    # the partners of an entry are those after it in its run whose size is at most size / t; to overlap enough
    # with one as large or larger, a set must share one of its first size - 2t / (1 + t) size + 1 grams
    run = np.concatenate([[0], np.cumsum(gram[1:] != gram[:-1])])
    top = int(s.max()) + 2
    reach = np.searchsorted(run * top + s, run * top + np.minimum(np.floor(s / t + 1e-9).astype(np.int64), top - 1), "right")
    # in a run, those of its most frequent root have partners only among the others
    most = np.full(int(run[-1]) + 1, -1, np.int64)
    rooted = np.flatnonzero(root < len(tops))
    if len(rooted):
        pair, often = np.unique(run[rooted] << 32 | root[rooted], return_counts=True)
        by = np.argsort(often, kind="stable")
        most[pair[by] >> 32] = pair[by] & 0xFFFFFFFF
    most = most[run] == root
    others = np.flatnonzero(~most)
    before = np.cumsum(~most)
    partners = np.concatenate([np.arange(len(s)), others])
    at = np.where(most, len(s) + before, np.arange(len(s)) + 1)
    count = np.where(front, np.where(most, before[reach - 1] - before, reach - np.arange(len(s)) - 1), 0)
    ends = np.cumsum(count)
    found, i = [], 0
    kept = np.zeros(0, np.int64)
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIR_CHUNK, "right")))
        c = count[i:j]
        left = np.repeat(np.arange(i, j), c)
        right = partners[at[left] + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)]
        good = root[left] != root[right]
        x, y = own[left[good]].astype(np.int64), own[right[good]].astype(np.int64)
        found.append(np.unique((np.minimum(x, y) * len(names) + np.maximum(x, y))[x != y]))
        if sum(map(len, found)) > max(2 * _PAIR_CHUNK, len(kept)) or j == len(s):
            kept = np.unique(np.concatenate([kept, *found]))
            found = []
        i = j
    x, y = kept // len(names), kept % len(names)
    return names, of_name, x, y, several[x] | several[y]


def _bounded(reader: setstore.Reader, names: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, several: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose parity bitmaps leave room for an overlap of t: (|a| + |b| - differing bits) / 2 bounds it.

    A group of several sets has no one bitmap; its pairs all stay.
    """
    keep = several.copy()
    sizes, kind = np.unique(size, return_inverse=True)
    bits = np.array([setstore.bitmap_bits(s) for s in sizes.tolist()], np.int64)[kind]
    bits = np.minimum(bits[x], bits[y])
    for n in np.unique(bits[~several]).tolist():
        mine = np.flatnonzero((bits == n) & ~several)
        step = max(1, _BITMAP_BYTES * 8 // n)
        for i in range(0, len(mine), step):  # pairs in order of x, so that few bitmaps are read anew
            some = mine[i : i + step]
            used, where = np.unique(np.concatenate([x[some], y[some]]), return_inverse=True)
            maps = reader.bitmaps(names[used], size[used], n)
            for j in range(0, len(some), max(1, step // 16)):
                own = slice(j, j + max(1, step // 16))
                p, q = where[: len(some)][own], where[len(some) :][own]
                apart = np.bitwise_count(maps[p] ^ maps[q]).sum(1, dtype=np.int64)
                total = size[x[some[own]]] + size[y[some[own]]]
                keep[some[own]] = (total - apart) // 2 >= np.ceil(t / (1 + t) * total - 1e-9)
    return names[x[keep]], names[y[keep]]


def _pack(a: np.ndarray, b: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    low, high = np.minimum(a, b), np.maximum(a, b)
    bucket = _text.mix64(low.view(np.uint64) ^ np.uint64(0xABCDEF)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    low, high, bucket = low[order], high[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        x, y = low[cut[k] : cut[k + 1]], high[cut[k] : cut[k + 1]]
        ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        at = np.sort(at[: len(x)].astype(np.uint64) << np.uint64(32) | at[len(x) :].astype(np.uint64))  # in order, so that it compresses
        row = (k, setstore.planes(np.diff(ids, prepend=0)), setstore.planes(np.diff((at >> np.uint64(32)).astype(np.uint32), prepend=np.uint32(0))), setstore.planes(at.astype(np.uint32)))
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "ids", "a", "b"])


def near_duplicates(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row: its class of near duplicates and the number of other rows it is linked to.

    Two rows are linked if the n-gram Jaccard similarity of their texts is at
    least t; a class is a connected component of links, and ``class_id`` the
    least doc_id in it (null if all are null).  Every link counts: between
    different texts it is found and verified, between rows of one gram set
    (similarity 1) it follows from the set's number of rows.

    Texts are compared by lower-cased words (runs of letters, marks, digits)
    as sets of hashes of ``setstore.GRAM_BITS`` bits; a text of fewer than n
    words is one gram of all its words.  Null, empty and wordless texts are
    similar to nothing: such a row is a class of its own, without links, and
    its class_id is its doc_id.  Repeated rows are rows of their own, linked
    to each other; a null doc_id stays null.  Other columns are not read.  An
    empty table gives an empty table.
    """
    found = NearPairs(docs, n, t, counts=True)
    classes = _classes(found)
    worded = found.placed.where("sid IS NOT NULL").select("doc_id", "sig_a", "sig_b").join(classes, ["sig_a", "sig_b"]).select("doc_id", "class_id", "n_links")
    alone = found.placed.where("sid IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return worded.unionByName(alone)


def _classes(found: NearPairs) -> DataFrame:
    """``sig_a, sig_b, class_id, n_links`` of every distinct set."""
    roots = found.roots.withColumnRenamed("node", "sid")
    rooted = found.sets.join(roots, "sid", "left").join(found.linked, "sid", "left").select("sig_a", "sig_b", "rows", "least_id", F.coalesce("root", "sid").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    rooted = _store.settle(rooted, "set-classes")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("class_id"))
    return rooted.join(least, "root").select("sig_a", "sig_b", "class_id", (F.col("linked") + F.col("rows") - 1).alias("n_links"))


def components(pairs: DataFrame) -> DataFrame:
    """``node, root`` for every node of the undirected graph ``pairs`` (a, b): root is the least node connected to it.

    Alternating large-star and small-star steps; every step is written to the shared folder.
    """
    edges = _store.settle(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = _store.settle(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = _store.settle(small.where("a <> b").distinct(), "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now


def drop_near_duplicates(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document left of each group of near duplicates, all columns kept.

    A group is a class of ``near_duplicates``.  The document with the least
    doc_id stays (null last), among rows that repeat a doc_id with an equal
    gram set one stays.  Texts without words stay.
    """
    spark = docs.sparkSession
    found = NearPairs(docs, n, t)
    roots = found.roots
    grouped = found.placed.where("sid IS NOT NULL").select("doc_id", "key", "sig_a", "sig_b").join(found.sets.select("sig_a", "sig_b", "sid"), ["sig_a", "sig_b"]).join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    each = grouped.groupBy(F.coalesce("root", "sid").alias("root"), "doc_id", "sig_a", "sig_b", "key").agg(F.count("*").alias("rows"))
    best = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "sig_a", "sig_b")).alias("best"), F.sum("rows").alias("n")).where("n > 1")
    decided = each.join(best, "root").withColumn("wins", F.expr("doc_id <=> best.doc_id AND sig_a = best.sig_a AND sig_b = best.sig_b"))
    # losers go; a winner that is repeated row by row, in whatever spelling, goes too and one of its rows comes back
    decided = decided.withColumn("rows", F.sum("rows").over(Window.partitionBy("root", "wins")))
    out = _store.settle(decided.where("NOT wins OR rows > 1").select("key", "wins"), "duplicate-keys")
    path, shards = _key_shards(out)
    returned = _tagged(docs, path, shards, n, True)
    kept = _tagged(docs, path, shards, n, False)
    if not out.where("wins").limit(1).count():
        return kept
    names = [f"`{c}`" for c in docs.columns]
    text_of = F.struct(F.col("text").alias("t"), F.xxhash64(*[F.col(c) for c in names]).alias("h"))
    one = returned.groupBy(returned.columns[-1]).agg(F.min_by(F.struct(*[F.col(c) for c in names]), text_of).alias("row")).select("row.*")
    return kept.unionByName(one)


def _key_shards(keys: DataFrame) -> tuple[str, int]:
    """Write (key, wins) as sorted arrays in the shared folder, for lookups without a shuffle of texts."""
    path = _store.local_path(_store.new_dir(keys.sparkSession, "key-shards"))
    shards = max(1, -(-keys.count() // 4_000_000))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            key, wins, shard = rows.column("key").to_numpy(), rows.column("wins").to_numpy().astype(bool), rows.column("shard").to_numpy()
            for s in np.unique(shard).tolist():
                for kind in (False, True):
                    _store.write_atomically(f"{path}/{s}-{int(kind)}", np.sort(key[(shard == s) & (wins == kind)]).tobytes())
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32())})

    keys.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartition(shards, "shard").mapInArrow(write, "shard int").count()
    return path, shards


class _Keys:
    def __init__(self, path: str, shards: int):
        self.path, self.shards, self.open = path, shards, {}

    def has(self, keys: np.ndarray, kind: bool) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        shard = np.mod(keys, self.shards)
        for s in np.unique(shard).tolist():
            if (s, kind) not in self.open:
                name = f"{self.path}/{s}-{int(kind)}"
                full = os.path.exists(name) and os.path.getsize(name)
                self.open[s, kind] = np.memmap(name, np.int64, "r") if full else np.zeros(0, np.int64)
            have, own = self.open[s, kind], np.flatnonzero(shard == s)
            if len(have):
                k = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
                out[own] = have[k] == keys[own]
        return out


def _tagged(docs: DataFrame, path: str, shards: int, n: int, winners: bool) -> DataFrame:
    """Rows that are listed as repeated winners, with a number of id and gram set as the last column; or rows not listed at all.

    Rows are looked up by the hash of id and text; only those of repeated winners are made into sets again.
    """
    extra = _store.free_name(docs, "key")
    schema = T.StructType([*docs.schema.fields, T.StructField(extra, T.LongType())]) if winners else docs.schema

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = _Keys(path, shards)
        for b in batches:
            key = b.column(extra).to_numpy()
            repeated = keys.has(key, True)
            rows = b.select(names).filter(pa.array(repeated if winners else ~(repeated | keys.has(key, False))))
            if not winners:
                yield rows
                continue
            for some in _text.slices([rows], "text"):
                grams, at = _sets(some.column("text").cast(pa.string()), n)
                number = _row_key(some.column("doc_id").cast(pa.int64()), _signature(grams, at).view(np.int64))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(number)], [*names, extra])

    names = docs.columns
    return docs.withColumn(extra, _key()).mapInArrow(_memory.lean(pick), schema)


def _row_key(ids: pa.Array, sig: np.ndarray) -> np.ndarray:
    """64-bit key of a doc_id (null as a value of its own) and a set's signature."""
    plain = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
    key = _text.mix64(plain + null * np.uint64(0x632BE59BD9B4E019))
    for k in range(2):
        key = _text.mix64(key ^ np.ascontiguousarray(sig[:, k]).view(np.uint64))
    return key.view(np.int64)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
s AS (
  SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS g
  FROM d WHERE len(w) > 1 OR w[1] <> ''),
u AS (SELECT g, count(*) AS n, min(doc_id) AS least, row_number() OVER () AS sid FROM s GROUP BY g),
x AS (SELECT sid, unnest(g) AS gram FROM u),
c AS (SELECT a.sid AS a, b.sid AS b, count(*) AS k FROM x a JOIN x b ON a.gram = b.gram AND a.sid < b.sid GROUP BY 1, 2),
j AS (SELECT a, b FROM c JOIN u p ON p.sid = c.a JOIN u q ON q.sid = c.b WHERE k >= 0.6 * (len(p.g) + len(q.g) - k) - 1e-9),
e AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j),
r AS (SELECT sid AS a, sid AS b FROM u UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT r.a AS sid, min(least) AS class_id FROM r JOIN u ON u.sid = r.b GROUP BY r.a),
l AS (SELECT e.a AS sid, sum(u.n) AS linked FROM e JOIN u ON u.sid = e.b GROUP BY e.a),
f AS (SELECT g, class_id, coalesce(linked, 0) + n - 1 AS n_links FROM u JOIN m USING (sid) LEFT JOIN l USING (sid))
SELECT d.doc_id, CASE WHEN s.rid IS NULL THEN d.doc_id ELSE f.class_id END AS class_id, CAST(coalesce(f.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN s USING (rid) LEFT JOIN f ON f.g = s.g
"""
