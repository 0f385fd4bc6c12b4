"""Word and character dictionaries as partial and final hash aggregations, and lookups in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Words that are searched for at once in closest-term searches; more go in several blocks.
BLOCK_KEYS = 20_000
#: Terms that a task holds keys against at once.
TERMS_AT_ONCE = 200_000


def word_dictionary(lines: DataFrame, column: str = "text", max_sequences: int | None = None) -> DataFrame:
    """``term, freq`` of the alphabetic parts of words of the cleaned text in NFKC; of ``max_sequences`` lines, if given."""
    lines = lines if max_sequences is None else lines.limit(max_sequences)
    return lines.select(F.explode(X.word_parts(X.nfkc(X.clean(column)))).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))


def char_dictionary(lines: DataFrame, column: str = "text", grams: int = 1, max_sequences: int | None = None) -> DataFrame:
    """``term, freq`` of characters (or of 3-grams with word ends) whose middle is alphabetic or punctuation, in NFKC."""
    lines = lines if max_sequences is None else lines.limit(max_sequences)
    words = lines.select(F.explode(X.whitespace_words(X.nfkc(X.clean(column)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    good = lambda c: c.rlike(r"^(\p{IsAlphabetic}+|\p{P}+)$")
    cs = X.clusters("w")
    if grams == 1:
        terms = F.filter(cs, good)
    elif grams == 3:
        padded = F.concat(F.array(F.lit("<bow>")), cs, F.array(F.lit("<eow>")))
        inner = F.filter(X.numbers(0, F.size(cs)), lambda i: good(F.get(cs, i)))
        terms = F.transform(inner, lambda i: F.array_join(F.slice(padded, i + 1, 3), " "))
    else:
        raise ValueError("only 1-grams and 3-grams")
    return words.select(F.explode(terms).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("freq"))


def top_terms(dictionary: DataFrame, max_size: int | None) -> DataFrame:
    """The most frequent terms; ties at the cut go to the larger term."""
    return dictionary if max_size is None else dictionary.orderBy(F.desc("freq"), F.desc("term")).limit(max_size)


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    """Number of terms, sum of frequencies, mean length in characters, plain and weighted."""
    n = F.size(X.clusters("term"))
    return dictionary.agg(F.count("*").alias("n_terms"), F.sum("freq").alias("freq_sum"), F.avg(n).alias("avg_length"), (F.sum(n * F.col("freq")) / F.sum("freq")).alias("weighted_length"))


def lookup(queries: DataFrame, key: Column | str, dictionary: DataFrame) -> DataFrame:
    """``queries`` with ``freq`` and ``rel_freq`` of the key in NFKC, null where it isn't in the dictionary."""
    total = dictionary.agg(F.sum("freq")).first()[0] or 1
    own = "term_"
    while own in queries.columns:
        own += "_"
    terms = dictionary.select(F.col("term").alias(own), "freq", (F.col("freq") / F.lit(total)).alias("rel_freq"))
    keyed = X.nfkc(F.col(key) if isinstance(key, str) else key)
    return queries.withColumn(own, keyed).join(terms, own, "left").drop(own)


def closest(queries: DataFrame, key: str, dictionary: DataFrame, normalized: bool = False) -> DataFrame:
    """The nearest term to the key in NFKC by Levenshtein distance in code points, ties by frequency, then by the larger term: ``key, term, freq, distance``.

    The distinct keys are sent out in blocks of BLOCK_KEYS and held against
    all terms where these lie: terms of one length at once, lengths near the
    key's first, until no other length can be nearer.  Only terms whose letters
    don't rule them out are measured.
    """
    keys = queries.select(F.col(key).cast("string").alias("k")).where("k IS NOT NULL").distinct().orderBy("k")
    words = keys.select("k", X.nfkc("k").alias("q"))
    schema = "k string, d double, freq bigint, term string"
    found, block = None, []

    def search(block: list[tuple[str, str]]) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, held, size = {}, [], 0
            for b in batches:
                held.append(b)
                size += b.num_rows
                if size >= TERMS_AT_ONCE:
                    _nearest(shared.value, pa.Table.from_batches(held), normalized, best)
                    held, size = [], 0
            if size:
                _nearest(shared.value, pa.Table.from_batches(held), normalized, best)
            rows = [(k, *best[k]) for k, _ in shared.value if k in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64(), pa.string()))], ["k", "d", "freq", "term"])

        best = F.max(F.struct((-F.col("d")).alias("d"), "freq", "term")).alias("best")
        terms = dictionary.select(F.col("term").cast("string").alias("term"), F.col("freq").cast("bigint").alias("freq")).where("term IS NOT NULL")
        # an aggregated dictionary is small in bytes, but each of its rows is held against many keys
        return terms.repartition(max(2, queries.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema).groupBy("k").agg(best)

    for r in words.toLocalIterator():
        block.append((r["k"], r["q"]))
        if len(block) == BLOCK_KEYS:
            found = search(block) if found is None else found.unionByName(search(block))
            block = []
    if block or found is None:
        found = search(block) if found is None else found.unionByName(search(block))
    return found.select(F.col("k").alias(key), F.col("best.term").alias("term"), F.col("best.freq").alias("freq"), (-F.col("best.d")).alias("distance"))


def _letters(points: np.ndarray) -> np.ndarray:
    """Two words of 64 bits for each row of code points: letters, by their last six bits, that it holds, and that it holds twice."""
    once, twice = np.zeros((2, len(points)), np.uint64)
    for c in points.T:
        bit = np.uint64(1) << (c.astype(np.uint64) & np.uint64(63))
        twice |= once & bit
        once |= bit
    return np.stack([once, twice])


def _neighbours(points: np.ndarray) -> np.ndarray:
    """64 bits for each row of code points: pairs of neighbours that it holds, ends of the row among them."""
    out, before = np.zeros(len(points), np.uint64), np.zeros(len(points), np.uint64)
    for c in [*points.T, np.zeros(len(points), np.uint32)]:
        out |= np.uint64(1) << ((before * np.uint64(29) + c) & np.uint64(63))
        before = c.astype(np.uint64)
    return out


def _nearest(keys: list[tuple[str, str]], found: pa.Table, normalized: bool, best: dict[str, tuple[float, int, str]]) -> None:
    """Better ``best`` (distance, freq, term) of the keys by the terms in ``found``.

    An edit takes one letter of a key away and adds one of a term at most, so
    letters that only one of both has, or has twice, bound the distance; it
    changes two pairs of neighbours at most, so these bound it too.
    """
    terms, freq = found.column("term").to_pylist(), found.column("freq").to_numpy()
    by: dict[int, list[int]] = {}
    for i, t in enumerate(terms):
        by.setdefault(len(t), []).append(i)
    blocks = {}
    for n, own in by.items():
        table = np.frombuffer("".join(terms[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)
        blocks[n] = np.array(own), table, _letters(table), _neighbours(table)
    for k, q in keys:
        points = np.frombuffer(q.encode("utf-32-le", "surrogatepass"), np.uint32)
        m, own_letters, own_pairs = len(points), _letters(points[None, :]), _neighbours(points[None, :])
        nearest = best.get(k, (np.inf, 0, ""))
        least = lambda n: abs(n - m) / (max(n, m, 1) if normalized else 1)
        for n in sorted(blocks, key=least):
            if least(n) > nearest[0]:
                break
            own, table, letters, pairs = blocks[n]
            scale = max(n, m, 1) if normalized else 1
            more, less = np.bitwise_count(letters & ~own_letters), np.bitwise_count(own_letters & ~letters)
            bound = np.maximum(more[0] + more[1], less[0] + less[1])
            at = np.flatnonzero(bound <= nearest[0] * scale) if np.isfinite(nearest[0]) else np.arange(len(own))
            more, less = np.bitwise_count(pairs[at] & ~own_pairs), np.bitwise_count(own_pairs & ~pairs[at])
            bound = np.maximum(bound[at], (np.maximum(more, less) + 1) // 2)
            for b in np.unique(bound).tolist():
                if max(b, abs(n - m)) / scale > nearest[0]:
                    break
                level = at[bound == b]
                for part in (level[i : i + 50_000] for i in range(0, len(level), 50_000)):
                    d = _distances(points, table[part]) / scale
                    if d.min() <= nearest[0]:
                        most = max((int(freq[i]), terms[i]) for i in own[part[d == d.min()]].tolist())
                        if d.min() < nearest[0] or most > nearest[1:]:
                            nearest = (float(d.min()), *most)
        best[k] = nearest


def _distances(q: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Levenshtein distances of q to all rows."""
    n = table.shape[1]
    row = np.tile(np.arange(n + 1, dtype=np.int16), (len(table), 1))
    index = np.arange(n + 1, dtype=np.int16)
    for i, c in enumerate(q):
        best = row + np.int16(1)
        best[:, 1:] = np.minimum(best[:, 1:], row[:, :-1] + (table != c))
        best[:, 0] = i + 1
        row = np.minimum.accumulate(best - index, axis=1) + index
    return row[:, -1].astype(np.float64)
