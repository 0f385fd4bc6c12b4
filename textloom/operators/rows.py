"""The row pipeline: sources in order, preprocessing steps, tasks, postprocessing and batches as Columns.

A row has ``input, target, file_idx, idx, seed, marks``.  A step is a function
DataFrame -> DataFrame; random steps draw from xxhash64(seed, step name, ...),
so a row's result depends on its seed only, not on partitions or retries.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..functions import text as X

Step = Callable[[DataFrame], DataFrame]
#: Rows ranked within one task when a global index is made; they are there with all their columns.
INDEX_ROWS = 50_000


#: Where the step that is being applied stands in chains and switches, from the outside in.
_place: list[int] = []


@contextmanager
def _at(i: int) -> Iterator[None]:
    _place.append(i)
    try:
        yield
    finally:
        _place.pop()


def _salt() -> int:
    """A number of the step's place, so that equal steps at different places draw different numbers."""
    return zlib.crc32(repr(_place).encode()) if _place else 0


def uniform(name: str, *more) -> Column:
    """A number in [0, 1) from the row's seed, the step's name and its place."""
    return F.pmod(F.xxhash64("seed", F.lit(name), F.lit(_salt()), *more), F.lit(1 << 40)) / float(1 << 40)


def _free(df: DataFrame, name: str) -> str:
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


# order


def with_index(df: DataFrame, key: str, *ties: str, name: str = "idx") -> DataFrame:
    """A dense 0-based index in the order of the number ``key``, then ``ties``.

    Ranks are taken within key ranges bounded by quantiles and shifted by the
    counts of the ranges before, so no task sorts everything.
    """
    n = df.count()
    parts = -(-n // INDEX_ROWS)
    part = _free(df, "range")
    edges = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    if not edges:
        rank = F.row_number().over(Window.orderBy(key, *ties)) - 1
        return df.withColumn(name, rank.cast("bigint"))
    bounds = np.array(edges)

    @F.pandas_udf("int")
    def range_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, v.to_numpy(float), "left").astype(np.int32))

    cut = df.withColumn(part, range_of(F.col(key).cast("double")))
    counts = {r[part]: r["count"] for r in cut.groupBy(part).count().collect()}  # a row for each range
    before, seen = [], 0
    for k in range(len(edges) + 1):
        before.append(seen)
        seen += counts.get(k, 0)
    rank = F.row_number().over(Window.partitionBy(part).orderBy(key, *ties)) - 1
    start = F.get(F.array(*[F.lit(x).cast("bigint") for x in before]), F.col(part))
    return cut.withColumn(name, (rank + start).cast("bigint")).drop(part)


def merge_sources(rows: DataFrame, strategy: str = "sequential", seed: int = 0) -> DataFrame:
    """``rows`` (file_idx, line_no, ...) with ``idx``: file after file, round robin, or a random source by length.

    ``weighted`` interleaves so that any prefix holds each source in
    proportion to its length, in expectation.
    """
    if strategy == "sequential":
        key = F.col("file_idx").cast("double") * float(1 << 40) + F.col("line_no")
    elif strategy == "interleaved":
        files = rows.agg(F.max("file_idx")).first()[0] or 0
        key = F.col("line_no").cast("double") * (files + 1) + F.col("file_idx")
    elif strategy == "weighted":
        total = rows.groupBy("file_idx").agg(F.count("*").alias("__n"))
        u = F.pmod(F.xxhash64(F.lit(seed), "file_idx", "line_no"), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.join(F.broadcast(total), "file_idx").withColumn("__key", (F.col("line_no") + u) / F.col("__n"))
        return with_index(rows, "__key", "file_idx", "line_no").drop("__key", "__n")
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return with_index(rows.withColumn("__key", key), "__key", "file_idx", "line_no").drop("__key")


def seeded(rows: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    return rows.withColumn("seed", F.lit(seed + epoch).cast("bigint") + F.col("idx")).withColumn("marks", F.create_map().cast("map<string,string>"))


def shard(rows: DataFrame, rank: int = 0, world: int = 1, skip: int = 0, limit: int | None = None, fast_forward: int = 0) -> DataFrame:
    """``limit`` first, then ``skip`` and ``fast_forward``, then every world-th row from ``rank``."""
    start = skip + fast_forward
    keep = (F.col("idx") >= start) & (F.pmod(F.col("idx") - start, F.lit(world)) == rank)
    return rows.where(keep if limit is None else keep & (F.col("idx") < limit))


def min_items(total: int, skip: int = 0, limit: int | None = None) -> int:
    return max(0, min(total, limit if limit is not None else total) - skip)


# preprocessing


def chain(*steps: Step) -> Step:
    def run(df: DataFrame) -> DataFrame:
        for i, step in enumerate(steps):
            with _at(i):
                df = df.transform(step)
        return df

    return run


def none(df: DataFrame) -> DataFrame:
    """The step that changes nothing."""
    return df


def on(part: str, f: Callable[[Column], Column]) -> Step:
    """Apply a Column function to ``input`` or ``target``."""
    return lambda df: df.withColumn(part, f(F.col(part)))


def _choose(which: Column, steps: Sequence[Step], df: DataFrame) -> DataFrame:
    """Run all branches on the same row, then take each row's; a column that only some branches make is null in others.

    Whatever column a branch changes or adds is its own; where ``which`` is no
    branch's number the row stays as it is.
    """
    number, whole = _free(df, "branch of the row"), _free(df, "whole row")
    keep = df.columns
    names = [f"`{c}`" for c in keep]
    out = df.select(which.alias(number), F.struct(*names).alias(whole))
    made: list[tuple[str, list[str]]] = []
    for i, step in enumerate(steps):
        temps = [number, whole, *[m for m, _ in made]]
        with _at(-1 - i):
            done = step(out.select(*[f"`{c}`" for c in temps], f"`{whole}`.*"))
        columns = [c for c in done.columns if c not in temps]
        branch = f"{number}_{i}"
        while branch in keep:
            branch += "_"
        made.append((branch, columns))
        out = done.select(*[f"`{c}`" for c in temps], F.struct(*[f"`{c}`" for c in columns]).alias(branch))
    new = [c for c in dict.fromkeys(c for _, columns in made for c in columns) if c not in keep]

    def pick(c: str) -> Column:
        value = F.col(f"`{whole}`")[c] if c in keep else F.lit(None)
        for i, (branch, columns) in enumerate(made):
            if c in columns:
                value = F.when(F.col(f"`{number}`") == i, F.col(f"`{branch}`")[c]).otherwise(value)
        return value.alias(c)

    return out.select(*map(pick, [*keep, *new]))


def switch(steps: Sequence[Step], probabilities: Sequence[float], name: str = "switch") -> Step:
    if abs(sum(probabilities) - 1) > 1e-5 or len(steps) != len(probabilities):
        raise ValueError("a probability for each step, summing to 1, is needed")

    def run(df: DataFrame) -> DataFrame:
        which, bounds = F.lit(len(steps) - 1), np.cumsum(probabilities).tolist()
        for i in reversed(range(len(steps))):
            which = F.when(uniform(name) <= bounds[i], i).otherwise(which)
        return _choose(which, steps, df)

    return run


def on_mark(key: str, value: str, step: Step) -> Step:
    return lambda df: _choose(F.when(F.element_at("marks", key) == value, 0).otherwise(-1), [step], df)


def switch_on_mark(key: str, values: Sequence[str], steps: Sequence[Step]) -> Step:
    which = F.raise_error(F.concat(F.lit(f"no step for mark {key}: "), F.coalesce(F.element_at("marks", key), F.lit("none")))).cast("int")
    for i, v in enumerate(values):
        which = F.when(F.element_at("marks", key) == v, i).otherwise(which)
    return lambda df: _choose(which, steps, df)


def per_source(steps: Sequence[Step]) -> Step:
    """The step of each row's source: the first for file_idx 0, and so on; one is needed for every source."""
    lost = F.raise_error(F.concat(F.lit("no step for source "), F.coalesce(F.col("file_idx").cast("string"), F.lit("none")))).cast("int")
    return lambda df: _choose(F.when(F.col("file_idx").between(0, len(steps) - 1), F.col("file_idx")).otherwise(lost), steps, df)


def json_decode(part: str = "input") -> Step:
    """A part that is a JSON text of a string becomes that string."""
    return on(part, X.json_string)


def chat_decode(part: str = "input", roles: dict[str, str] | None = None, start: str = "", end: str | None = "<|assistant|>\n") -> Step:
    """A part that is a JSON list of messages becomes the chat by its template."""
    return on(part, lambda c: X.format_chat(F.from_json(c, X.CHAT_TYPE), roles, start, end))


def mark(key: str, value: str) -> Step:
    return lambda df: df.withColumn("marks", F.map_concat(F.map_filter("marks", lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value))))


def overwrite(part: str) -> Step:
    """Replace ``part`` by the other part."""
    return lambda df: df.withColumn(part, F.col("target" if part == "input" else "input"))


def prefix(part: str, text: str) -> Step:
    return on(part, lambda c: F.concat(F.lit(text), c))


def suffix(part: str, text: str) -> Step:
    return on(part, lambda c: F.concat(c, F.lit(text)))


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng([abs(int(k)) for k in key])


@functools.lru_cache(4096)
def _inversion(n: int, p: float) -> tuple[float, int]:
    q = 1.0 - p
    return math.exp(n * math.log(q)), int(min(n, n * p + 10.0 * math.sqrt(n * p * q + 1)))


class Draws:
    """Numbers as a numpy Generator draws them one by one, from its raw numbers taken in bulk."""

    def __init__(self, rng: np.random.Generator):
        raw = rng.bit_generator.random_raw
        self.raw = itertools.chain.from_iterable(iter(lambda: raw(256).tolist(), None)).__next__
        self.half: int | None = None

    def random(self) -> float:
        return (self.raw() >> 11) * 2.0**-53

    def integers(self, n: int) -> int:
        """One of 0 .. n-1, n up to 2^32; a raw number serves two of them."""
        if n == 1:
            return 0
        while True:
            if self.half is None:
                x = self.raw()
                x, self.half = x & 0xFFFFFFFF, x >> 32
            else:
                x, self.half = self.half, None
            if (low := x * n & 0xFFFFFFFF) >= n or low >= (0x100000000 - n) % n:
                return x * n >> 32

    def binomial(self, n: int, p: float) -> int:
        """By inversion, as numpy has it where p is at most a half and n p at most 30."""
        if not n or not p:
            return 0
        q, (least, bound) = 1.0 - p, _inversion(n, p)
        x, part, u = 0, least, self.random()
        while u > part:
            x += 1
            if x > bound:
                x, part, u = 0, least, self.random()
            else:
                u -= part
                part = (n - x + 1) * p * part / (x * q)
        return x


def whitespace_corruption(insert_prob: float, delete_prob: float) -> Step:
    """A draw for each character of ``input``: white space may go, a space may come before others."""

    def corrupt(s: str, seed: int, salt: int) -> str:
        if K.single(s):
            p = K.points(s)
            draws, blank = _rng(seed, 11, salt).random(len(p)), K.blanks(p)
            new = ~blank & (draws < insert_prob) & ~np.concatenate([[True], blank[:-1]])[: len(p)]
            return K.respaced(p, new, blank & (draws < delete_prob))
        cs, out = K.clusters(s), []
        draws = _rng(seed, 11, salt).random(len(cs))
        for i, c in enumerate(cs):
            if K.blank(c):
                if draws[i] < delete_prob:
                    continue
            elif i and not K.blank(cs[i - 1]) and draws[i] < insert_prob:
                out.append(" ")
            out.append(c)
        return "".join(out)

    return lambda df: df.withColumn("input", K.arrow(corrupt, "string", salt=_salt())("input", "seed"))


def substring(kind: str, size: int) -> Step:
    """A random window of ``input`` by characters or bytes; ``target`` becomes the same text with its own white space."""

    def cut(s: str, seed: int, salt: int) -> str:
        if kind == "char":
            cs = K.clusters(s)
            k = min(size, len(cs))
            i = int(_rng(seed, 12, salt).integers(len(cs) - k + 1))
            return "".join(cs[i : i + k])
        found = K.byte_substrings(s, size)
        a, b, _ = found[int(_rng(seed, 12, salt).integers(len(found)))] if found else (0, 0, 0)
        return s.encode()[a:b].decode()

    def run(df: DataFrame) -> DataFrame:
        cut_in = K.arrow(cut, "string", salt=_salt())("input", "seed")
        done = df.withColumn("input", cut_in)
        found = X.find_ignoring_whitespace("target", "input")
        return done.withColumn("target", F.trim(F.coalesce(found, F.raise_error(F.lit("the target doesn't hold the substring")).cast("string"))))

    return run


def edit_word(word: str, rng: np.random.Generator, contexts: dict | None = None, ops: Sequence[str] = ("insert", "delete", "replace", "swap"), exclude: set[int] | None = None, allow_full_delete: bool = True, known: dict | None = None) -> tuple[str, set[int]]:
    """One random edit of a word that leaves characters in ``exclude`` alone; returns the word and the positions edited so far.

    ``contexts`` maps (character before, character after) to weighted
    characters that may stand between them; without it letters are drawn.
    ``known`` keeps what was made of ``contexts`` from word to word.
    """
    cs, known = K.clusters(word), {} if known is None else known
    done = _edit(cs, set(exclude or ()), rng, contexts, ops, allow_full_delete, known)
    return "".join(cs), done


def _draw(before: str, after: str, but: str | None, rng, contexts: dict | None, known: dict) -> str | None:
    """A character for a place, as Generator.choice draws it."""
    if contexts is not None and (before, after) not in contexts:
        return None
    cut = known.get((before, after, but))
    if cut is None:
        table = contexts[before, after] if contexts is not None else [(c, 1.0) for c in "abcdefghijklmnopqrstuvwxyz"]
        if but is not None and all(c != but for c, _ in table):
            return _draw(before, after, None, rng, contexts, known)
        table = [(c, w) for c, w in table if c != but]
        weight = np.array([w for _, w in table], float)
        upto = (weight / weight.sum()).cumsum() if table else weight
        cut = known[before, after, but] = [c for c, _ in table], (upto / upto[-1]).tolist() if table else []
    return cut[0][bisect_right(cut[1], rng.random())] if cut[0] else None


def _edit(cs: list[str], done: set[int], rng, contexts: dict | None, ops: Sequence[str], allow_full_delete: bool, known: dict) -> set[int]:
    """``edit_word`` on a list of characters; returns the positions edited so far."""
    op, n = ops[int(rng.integers(len(ops)))], len(cs)
    if op == "insert":
        places = [i for i in range(n + 1) if i not in done and i - 1 not in done] if done else range(n + 1)
        if places:
            i = places[int(rng.integers(len(places)))]
            if c := _draw(cs[i - 1] if i else "<bow>", cs[i] if i < n else "<eow>", None, rng, contexts, known):
                cs.insert(i, c)
                return {j + (j >= i) for j in done} | {i}
        return done
    free = [i for i in range(n) if i not in done] if done else range(n)
    if op == "delete":
        if free and (allow_full_delete or n > 1):
            i = free[int(rng.integers(len(free)))]
            del cs[i]
            return {j - (j > i) for j in done}
    elif op == "replace":
        if free:
            i = free[int(rng.integers(len(free)))]
            if c := _draw(cs[i - 1] if i else "<bow>", cs[i + 1] if i + 1 < n else "<eow>", cs[i], rng, contexts, known):
                cs[i] = c
                return done | {i}
    elif op == "swap":
        places = [i for i in free if i + 1 < n and i + 1 not in done and cs[i] != cs[i + 1]]
        if places:
            i = places[int(rng.integers(len(places)))]
            cs[i], cs[i + 1] = cs[i + 1], cs[i]
            return done | {i, i + 1}
    return done


def context_table(grams: DataFrame, temperature: float = 2.0, least: float = 1e-4) -> dict[tuple[str, str], list[tuple[str, float]]]:
    """(before, after) -> [(character, freq^(1/temperature))] from a 3-gram dictionary; rare grams are left out."""
    total = grams.agg(F.sum("freq")).first()[0] or 1
    kept = grams.where(F.col("freq") / total >= least).collect()  # at most 1/least rows
    out: dict[tuple[str, str], list[tuple[str, float]]] = {}
    for r in sorted(kept, key=lambda r: r["term"]):
        if len(p := r["term"].split(" ")) != 3:
            raise ValueError("3-grams separated by spaces are needed")
        out.setdefault((p[0], p[2]), []).append((p[1], r["freq"] ** (1 / temperature)))
    return out


def spelling_corruption(prob: float, contexts: dict | None = None, misspellings: dict[str, list[str]] | None = None, artificial_prob: float = 1.0, char_edit_prob: float = 0.2, allow_full_delete: bool = True) -> Step:
    """Each word of ``input`` is corrupted with ``prob``: by a known misspelling, else by character edits."""

    known: dict = {}
    real_words, ops = misspellings or {}, ("insert", "delete", "replace", "swap")
    plain = contexts is None or all(K.single(c) and len(c) == 1 for table in contexts.values() for c, _ in table)

    def corrupt(s: str, seed: int, salt: int) -> str:
        rng, out, every = _rng(seed, 13, salt), [], s.split(" ")
        if char_edit_prob <= 0.5 and max(map(len, every)) * char_edit_prob <= 30:
            rng = Draws(rng)
        fast = isinstance(rng, Draws)
        raw, limit = rng.raw if fast else None, prob * 2.0**53
        for word in every:
            if word and (raw() >> 11 < limit if fast else rng.random() < prob):
                real = real_words.get(word)
                if real and rng.random() >= artificial_prob:
                    word = real[int(rng.integers(len(real)))]
                elif artificial_prob > 0:
                    n, done = max(1, int(rng.binomial(len(word), char_edit_prob))), set()
                    if plain and K.single(word):  # edits leave single code points
                        cs = list(word)
                        for _ in range(n):
                            done = _edit(cs, done, rng, contexts, ops, allow_full_delete, known)
                        word = "".join(cs)
                    else:
                        for _ in range(n):
                            word, done = edit_word(word, rng, contexts, exclude=done, allow_full_delete=allow_full_delete, known=known)
            if word:
                out.append(word)
        return " ".join(out)

    return lambda df: df.withColumn("input", K.arrow(corrupt, "string", salt=_salt())("input", "seed"))


# tasks


def _minus(n: int) -> Column:
    return F.array_repeat(F.lit(-1), n)


def whitespace_task(tokenize: Callable[[Column], Column], n_prefix: int = 0, n_suffix: int = 0) -> Step:
    """``token_ids`` of the input and a keep / insert / delete label for each character."""
    ops = K.arrow(K.whitespace_operations, "array<int>")
    return lambda df: df.withColumn("token_ids", tokenize(F.col("input"))).withColumn("labels", F.concat(_minus(n_prefix), ops("input", "target"), _minus(n_suffix)))


def generation_task(tokenize: Callable[[Column], Column], separator: str = "", mask_input: bool = False, n_prefix: int = 0) -> Step:
    """Next-token labels over input, separator and target; with ``mask_input`` those of the input are -1."""

    def run(df: DataFrame) -> DataFrame:
        start = F.concat("input", F.lit(separator))
        ids = tokenize(F.concat(start, F.col("target")))
        masked = F.greatest(F.size(tokenize(start)) - 1, F.lit(0)) if mask_input else F.lit(max(0, n_prefix - 1))
        out = df.withColumn("__ids", ids)
        n = F.size("__ids")
        labels = F.concat(F.array_repeat(F.lit(-1), masked), F.slice("__ids", masked + 2, F.greatest(n - masked - 1, F.lit(0))))
        return out.withColumn("labels", labels).withColumn("token_ids", F.slice("__ids", F.lit(1), F.greatest(n - 1, F.lit(0)))).drop("__ids")

    return run


def conditional_generation_task(tokenize: Callable[[Column], Column]) -> Step:
    def run(df: DataFrame) -> DataFrame:
        out = df.withColumn("token_ids", tokenize(F.col("input"))).withColumn("__t", tokenize(F.col("target")))
        n = F.greatest(F.size("__t") - 1, F.lit(0))
        return out.withColumn("target_token_ids", F.slice("__t", F.lit(1), n)).withColumn("labels", F.slice("__t", F.lit(2), n)).drop("__t")

    return run


def classification_task(tokenize: Callable[[Column], Column], classes: Sequence[str]) -> Step:
    if len(classes) < 2 or len(set(classes)) < len(classes):
        raise ValueError("at least two classes, each once, are needed")
    at = F.array_position(F.array(*map(F.lit, classes)), F.col("target"))
    label = F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(F.concat(F.lit("unknown class "), F.col("target"))).cast("int"))
    return lambda df: df.withColumn("token_ids", tokenize(F.col("input"))).withColumn("label", label)


# postprocessing and batches


def clip_length(n: int, columns: Sequence[str] = ("token_ids", "labels")) -> Step:
    return lambda df: df.withColumns({c: F.slice(c, 1, n) for c in columns if c in df.columns})


def _geometric(u: float, p: float) -> int:
    """A geometric number from one in [0, 1), as numpy has it where p is a third at least."""
    n, total, part = 1, p, p
    while u > total:
        part *= 1.0 - p
        total += part
        n += 1
    return n


def token_masking(mask_id: int, prob: float, min_tokens: int = 1, span_prob: float = 0.5) -> Step:
    """Replace spans of tokens: a span starts with ``prob``, is geometric in length and at most half of the tokens."""

    def masked(ids: list, seed: int, salt: int) -> list:
        rng, out, i = _rng(seed, 14, salt), list(ids), 0
        if span_prob >= 1 / 3:  # a number for each token, and one for each span's length
            draws, at = rng.random(2 * len(out)), 0
            for hit in np.flatnonzero(draws < prob).tolist():
                if hit < at:
                    continue
                i += hit - at
                if i >= len(out):
                    break
                n = min(max(min_tokens, _geometric(draws[hit + 1], span_prob)), max(1, len(out) // 2), len(out) - i)
                out[i : i + n] = [mask_id] * n
                i, at = i + n + 1, hit + 2
            return out
        while i < len(out):
            if rng.random() < prob:
                n = min(max(min_tokens, int(rng.geometric(span_prob))), max(1, len(out) // 2), len(out) - i)
                out[i : i + n] = [mask_id] * n
                i += n
            i += 1
        return out

    return lambda df: df.withColumn("token_ids", K.arrow(masked, "array<int>", salt=_salt())("token_ids", "seed"))


def fixed_batches(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("batch_id", F.floor(F.col("idx") / size).cast("bigint"))


def _fold(sizes: np.ndarray, limit: int, kind: str, prefetch: int, sort: bool, shuffle: bool, rng: np.random.Generator) -> np.ndarray:
    """The batch of each row, by a buffer that is filled past ``prefetch`` limits before each batch is taken out of it."""
    weigh = (lambda n, top: n * top) if kind == "padded" else (lambda n, top: n)
    out, batch = np.zeros(len(sizes), np.int64), 0
    buffer: list[int] = []
    at, top = 0, 0
    while at < len(sizes) or buffer:
        while at < len(sizes) and (not buffer or weigh(len(buffer), top) <= limit * max(1, prefetch)):
            buffer.append(at)
            top = max(top, int(sizes[at]))
            at += 1
        if sort:
            buffer.sort(key=lambda i: sizes[i])
            if shuffle:  # a random one of the longest runs within the limit
                ends = _runs(sizes[buffer], limit, weigh)
                i, j = ends[int(rng.integers(len(ends)))]
                taken = buffer[i:j]
                del buffer[i:j]
            else:
                taken = _take(buffer, sizes, limit, weigh)
        else:
            if shuffle:
                buffer = [buffer[i] for i in rng.permutation(len(buffer))]
            taken = _take(buffer, sizes, limit, weigh) if shuffle else _take_front(buffer, sizes, limit, weigh)
        out[taken] = batch
        batch += 1
        top = int(sizes[buffer].max()) if buffer else 0
    return out


def _take(buffer: list[int], sizes: np.ndarray, limit: int, weigh) -> list[int]:
    taken, top = [], 0
    while buffer and (not taken or weigh(len(taken) + 1, max(top, sizes[buffer[-1]])) <= limit):
        taken.append(buffer.pop())
        top = max(top, sizes[taken[-1]])
    return taken


def _take_front(buffer: list[int], sizes: np.ndarray, limit: int, weigh) -> list[int]:
    n, top = 0, 0
    while n < len(buffer) and (not n or weigh(n + 1, max(top, sizes[buffer[n]])) <= limit):
        top = max(top, sizes[buffer[n]])
        n += 1
    taken = buffer[:n]
    del buffer[:n]
    return taken


def _runs(sizes: np.ndarray, limit: int, weigh) -> list[tuple[int, int]]:
    """The longest runs of ascending sizes within the limit; one row at least."""
    out, start = [], 0
    for end in range(1, len(sizes) + 1):
        while start < end - 1 and weigh(end - start, sizes[end - 1]) > limit:
            start += 1
        if out and out[-1][0] == start:
            out[-1] = (start, end)
        else:
            out.append((start, end))
    return out


def padded_batches(rows: DataFrame, limit: int, shard_rows: int = 10_000, sort: bool = False, shuffle: bool = False, seed: int = 0, kind: str = "padded", prefetch: int = 1) -> DataFrame:
    """``rows`` (idx, size, ...) with ``shard`` and ``batch_id``: count times largest size (or with ``kind`` "count" the count) is at most ``limit``, one row at least.

    Batches are made in shards of consecutive rows.  A buffer takes rows in
    order until it passes ``prefetch`` limits; a batch comes from its front,
    with ``sort`` from its largest rows, with ``shuffle`` from a shuffled
    buffer; with both it is a random one of the longest runs of the sorted
    buffer.  A shard's rows are held by one task: ``shard_rows`` bounds them.
    """
    part, batch = "shard", "batch_id"
    fields = [*rows.schema.fields, T.StructField(part, T.LongType()), T.StructField(batch, T.LongType())]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        rng = np.random.default_rng([seed, int(pdf[part].iloc[0])])
        return pdf.assign(**{batch: _fold(pdf["size"].to_numpy(np.int64), limit, kind, prefetch, sort, shuffle, rng)})

    cut = rows.withColumn(part, F.floor(F.col("idx") / shard_rows).cast("bigint"))
    return cut.groupBy(part).applyInPandas(fold, T.StructType(fields))


def batch_statistics(batched: DataFrame, *keys: str) -> DataFrame:
    """Items, sum and largest-to-smallest ratio of sizes for each batch."""
    return batched.groupBy(*(keys or ("batch_id",))).agg(F.count("*").alias("n_items"), F.sum("size").alias("sum_size"), F.max("size").alias("max_size"), (F.max("size") / F.greatest(F.min("size"), F.lit(1))).alias("size_ratio"))


def tensorize(batched: DataFrame, column: str = "token_ids", pad_id: int = 0, *keys: str) -> DataFrame:
    """Pad ``column`` to the longest of its batch, with the real ``length`` beside it."""
    longest = F.max(F.size(column)).over(Window.partitionBy(*(keys or ("batch_id",))))
    out = batched.withColumn("length", F.size(column)).withColumn("__n", longest)
    return out.withColumn(column, F.concat(column, F.array_repeat(F.lit(pad_id), F.col("__n") - F.col("length")))).drop("__n")


def inference_batches(batched: DataFrame, *keys: str) -> DataFrame:
    """One row a batch: ``n_items, sizes, indices, token_ids``, items in the order of idx."""
    said = F.array_sort(F.collect_list(F.struct("idx", "size", "token_ids")))
    grouped = batched.groupBy(*(keys or ("batch_id",))).agg(said.alias("said"))
    return grouped.select(*(keys or ("batch_id",)), F.size("said").alias("n_items"), F.col("said.size").alias("sizes"), F.col("said.idx").alias("indices"), F.col("said.token_ids").alias("token_ids"))


def first_lines(rows: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` lines of each source."""
    return rows if most is None else rows.where(F.col("line_no") < most)


def split_validation(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows by idx, and the others."""
    return rows.where(F.col("idx") < n), rows.where(F.col("idx") >= n)


def group_features(features: DataFrame, groups: DataFrame, how: str = "mean") -> DataFrame:
    """``batch, group, dim, value``: features (batch, pos, dim, value) averaged or summed over the positions of groups (batch, group, pos)."""
    if how not in ("mean", "sum"):
        raise ValueError("mean or sum")
    agg = F.avg if how == "mean" else F.sum
    return features.join(groups, ["batch", "pos"]).groupBy("batch", "group", "dim").agg(agg("value").alias("value"))
