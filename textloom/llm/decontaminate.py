"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Training texts are scanned once: every window of ``n`` words is hashed and
probed; hits are verified word by word, then spans are cut or documents
dropped.  No shuffle of the texts.  The n-grams of a benchmark too large to
broadcast lie in files of the shared folder in place of memory, sorted by
hash, and are mapped and probed in the same way.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _memory, _store, _text

N = 8
DROP_FRACTION = 0.5
#: Bytes of n-grams with their hashes up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: And n-grams of a file beyond that, about.
SHARD_GRAMS = 1_000_000
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def _grams(texts: pa.Array, n: int) -> set[str]:
    found: set[str] = set()
    for t in _text.normalise(texts).to_pylist():
        w = t.split(" ")
        found.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    return found


def _hashes(grams: pa.Array, n: int) -> np.ndarray:
    w, at = _text.word_hashes(grams)
    return _text.gram_hashes(w, at, n, short=False)[0]


class _Part:
    """N-grams in ascending order of hashes: hashes, n+1 offsets, bytes."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, data: np.ndarray):
        self.hashes, self.at, self.data = hashes, at, data

    @classmethod
    def of(cls, grams: list[str], n: int) -> _Part:
        hashes = _hashes(pa.array(grams, pa.string()), n)
        order = np.argsort(hashes, kind="stable")
        raw = [grams[i].encode() for i in order.tolist()]
        return cls(hashes[order], np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8))

    @classmethod
    def mapped(cls, path: str) -> _Part:
        if not os.path.exists(path) or not os.path.getsize(path):
            return cls.of([], 1)
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.int64)[0])
        return cls(raw[8 : 8 + 8 * n].view(np.uint64), raw[8 + 8 * n : 16 + 16 * n].view(np.int64), raw[16 + 16 * n :])

    def write(self, path: str) -> None:
        _store.write_atomically(path, len(self.hashes).to_bytes(8, "little"), self.hashes.tobytes(), self.at.tobytes(), self.data.tobytes())

    def has(self, k: int, h: np.uint64, gram: bytes) -> bool:
        """Whether ``gram`` stands at place k or after it among equal hashes."""
        while k < len(self.hashes) and self.hashes[k] == h:
            if self.data[self.at[k] : self.at[k + 1]].tobytes() == gram:
                return True
            k += 1
        return False


class _Index:
    """The benchmark's n-grams in parts by hash range, in memory (one part) or as mapped files; probed by hash, verified by words."""

    def __init__(self, n: int, parts: list[_Part] | None = None, path: str = "", shards: int = 1):
        self.n, self.parts, self.path, self.shards = n, parts, path, shards
        if parts:
            self.door = np.zeros(1 << 20, bool)
            self.door[(parts[0].hashes >> np.uint64(44)).astype(np.int64)] = True

    def _probe(self, g: np.ndarray) -> list[tuple[int, int, _Part]]:
        """(index into g, place, part) of the hashes that are there."""
        if self.parts is None:
            self.parts, self.door = [_Part.mapped(f"{self.path}/{s}") for s in range(self.shards)], None
        maybe = np.arange(len(g)) if self.door is None else np.flatnonzero(self.door[(g >> np.uint64(44)).astype(np.int64)])
        if self.shards > 1:
            maybe = maybe[np.argsort(g[maybe])]
        edges = np.searchsorted(_shard_of(g[maybe], self.shards), np.arange(self.shards + 1)) if self.shards > 1 else np.array([0, len(maybe)])
        out = []
        for s in np.flatnonzero(np.diff(edges)).tolist():
            part, own = self.parts[s], maybe[edges[s] : edges[s + 1]]
            if len(part.hashes):
                k = np.minimum(np.searchsorted(part.hashes, g[own]), len(part.hashes) - 1)
                hit = part.hashes[k] == g[own]
                out += [(i, p, part) for i, p in zip(own[hit].tolist(), k[hit].tolist())]
        return out

    def hits(self, texts: pa.Array) -> dict[int, list[int]]:
        """Verified window starts (in words) by row."""
        normal = _text.normalise(texts)
        w, at = _text.word_hashes(normal)
        g, of = _text.gram_hashes(w, at, self.n, short=False)
        out: dict[int, list[int]] = {}
        words: dict[int, list[str]] = {}
        for i, k, part in sorted(self._probe(g), key=lambda x: x[0]):
            row = int(of[i])
            if row not in words:
                words = {row: normal[row].as_py().split(" ")}
            start = i - int(np.searchsorted(of, row))
            if part.has(k, g[i], " ".join(words[row][start : start + self.n]).encode()):
                out.setdefault(row, []).append(start)
        return out


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _merge(starts: list[int], n: int) -> list[tuple[int, int]]:
    spans: list[list[int]] = []
    for s in starts:
        if spans and s <= spans[-1][1]:
            spans[-1][1] = s + n
        else:
            spans.append([s, s + n])
    return [(a, b) for a, b in spans]


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    at = [m.span() for m in _WORD.finditer(text)]
    for a, b in reversed(spans):
        text = text[: at[a][0]] + text[at[min(b, len(at)) - 1][1] :]
    return text


REPORT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_windows", T.LongType()),
        T.StructField("hit_words", T.LongType()),
        T.StructField("spans", T.StringType()),
        T.StructField("action", T.StringType()),
    ]
)


def _n_words(normal: pa.Array, row: int) -> int:
    t = normal[row].as_py()
    return t.count(" ") + 1 if t else 0


def _benchmark_index(benchmark: DataFrame, n: int) -> _Index:
    """The n-gram set: in memory if its size is within BROADCAST_BYTES, else in mapped files of the shared folder."""
    texts = benchmark.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size, rows = texts.agg(F.sum(F.octet_length("text")), F.sum(F.size(F.split("text", " ")))).first()
    if (n + 1) * (size or 0) + 16 * (rows or 0) <= BROADCAST_BYTES:  # every word stands in n windows
        found = texts.toArrow().column("text").combine_chunks()
        return _Index(n, [_Part.of(sorted(_grams(found, n)), n)])
    shards = max(1, -(-int(rows) // SHARD_GRAMS))
    path = _store.local_path(_store.new_dir(benchmark.sparkSession, "benchmark-grams"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text"):
            grams = sorted(_grams(b.column("text"), n))
            for i in range(0, len(grams), 20_000):
                some = pa.array(grams[i : i + 20_000], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(_shard_of(_hashes(some, n), shards).astype(np.int32)), some], ["shard", "gram"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            _Part.of(rows.column("gram").to_pylist(), n).write(f"{path}/{rows.column('shard')[0].as_py()}")
            yield pa.RecordBatch.from_pydict({"shard": rows.column("shard").combine_chunks()[:1]})

    found = texts.mapInArrow(_memory.lean(windows), "shard int, gram string").distinct()
    found.repartitionById(shards, F.col("shard")).mapInArrow(_memory.lean(write), "shard int").count()
    return _Index(n, None, path, shards)


def _with_hits(docs: DataFrame, benchmark: DataFrame, n: int, schema: T.StructType, emit) -> DataFrame:
    """Apply ``emit(batch, {row: window starts}) -> batches`` to all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(_benchmark_index(benchmark, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.slices(batches, "text"):
            yield from emit(b, shared.value.hits(b.column("text")))

    return docs.mapInArrow(_memory.lean(run), schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = N, drop_fraction: float = DROP_FRACTION) -> DataFrame:
    """One row per document that shares at least one n-gram of words with a benchmark text.

    ``hit_windows`` counts verified windows, ``hit_words`` the words they
    cover, ``spans`` lists covered word ranges ``start-end`` (end exclusive),
    ``action`` is ``drop`` if at least ``drop_fraction`` of the words are
    covered, else ``cut``.

    Null and empty texts, and texts or benchmark texts of fewer than ``n``
    words, have no window and can't be hit.  Rows are judged one by one, so
    repeated rows give repeated results; a null doc_id is kept as null.
    Other columns are not read.  Empty tables give an empty table.
    """

    def emit(b: pa.RecordBatch, hits: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
        if not hits:
            return
        normal, rows = _text.normalise(b.column("text")), []
        ids = b.column("doc_id")
        for row, starts in sorted(hits.items()):
            spans, total = _merge(starts, n), _n_words(normal, row)
            covered = sum(e - s for s, e in spans)
            rows.append((ids[row].as_py(), total, len(starts), covered, ",".join(f"{s}-{e}" for s, e in spans), "drop" if covered >= drop_fraction * total else "cut"))
        yield pa.RecordBatch.from_pydict(dict(zip(REPORT.names, map(list, zip(*rows)))), schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hit_windows", pa.int64()), ("hit_words", pa.int64()), ("spans", pa.string()), ("action", pa.string())]))

    return _with_hits(docs.select("doc_id", "text"), benchmark, n, REPORT, emit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, drop_fraction: float = DROP_FRACTION) -> DataFrame:
    """``docs`` with benchmark passages cut out of ``text`` and documents mostly made of them left out.

    All columns are kept; ``n_chars``, where there is an integer column of
    that name, follows the cut text.  Clean documents, null and empty texts pass unchanged.  Cases are
    decided as in ``contamination_report``.
    """
    names = docs.columns

    def emit(b: pa.RecordBatch, hits: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
        if not hits:
            yield b
            return
        normal, texts, keep = _text.normalise(b.column("text")), b.column("text").to_pylist(), np.ones(b.num_rows, bool)
        for row, starts in hits.items():
            spans = _merge(starts, n)
            if sum(e - s for s, e in spans) >= drop_fraction * _n_words(normal, row):
                keep[row] = False
            else:
                texts[row] = _cut(texts[row], spans)
        columns = {c: b.column(c) for c in names}
        columns["text"] = pa.array(texts, b.column("text").type)
        if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
            fixed = columns["n_chars"].to_pylist()
            for row in hits:
                fixed[row] = len(texts[row])
            columns["n_chars"] = pa.array(fixed, columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), schema=b.schema.remove_metadata()).filter(pa.array(keep))

    return _with_hits(docs, benchmark, n, docs.schema, emit)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (
  SELECT string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
g AS (SELECT DISTINCT array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM b)),
h AS (
  SELECT rid, i FROM (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS gram
                      FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)) JOIN g USING (gram)),
m AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 8 THEN 0 ELSE 1 END AS fresh FROM h),
s AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM m),
t AS (SELECT rid, min(i) - 1 AS a, max(i) + 7 AS z, count(*) AS c FROM s GROUP BY rid, k),
u AS (SELECT rid, sum(c) AS hit_windows, sum(z - a) AS hit_words, string_agg(a || '-' || z, ',' ORDER BY a) AS spans FROM t GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(hit_windows AS BIGINT) AS hit_windows,
       CAST(hit_words AS BIGINT) AS hit_words, spans,
       CASE WHEN hit_words >= 0.5 * len(w) THEN 'drop' ELSE 'cut' END AS action
FROM u JOIN d USING (rid)
"""
