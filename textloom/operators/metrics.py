"""Correction metrics as aggregations over rows of (input, prediction, target)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    """(f, precision, recall): denominators at least 1, f = 0 when both are 0."""
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    f = F.when(p + r > 0, (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(0.0)
    return F.struct(f.alias("f"), p.alias("precision"), r.alias("recall"))


def accuracy(pairs: DataFrame, pred: str, target: str) -> DataFrame:
    return pairs.agg(F.coalesce(F.avg(F.col(pred).eqNullSafe(F.col(target)).cast("int")), F.lit(0.0)).alias("accuracy"))


def binary_f1(pairs: DataFrame, pred: str, target: str, beta: float = 1.0) -> DataFrame:
    p, t = F.col(pred), F.col(target)
    counts = pairs.agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return counts.select(f_beta(F.col("tp"), F.col("fp"), F.col("fn"), beta).alias("x")).select("x.*")


def mean_edit_distance(pairs: DataFrame, a: str, b: str, normalized: bool = False, use_graphemes: bool = True) -> DataFrame:
    """Mean Levenshtein distance of cleaned texts in NFKC, in clusters or code points; 0 for no rows and for two empty texts.

    Pairs of ASCII texts, whose characters are code points, stay in the JVM.
    """
    x, y = X.clean(a), X.clean(b)
    plain = X.is_ascii(a) & X.is_ascii(b) & ~F.contains(F.concat(a, b), F.lit("\r"))

    def apart(s: str, t: str) -> float:
        s, t = K.normalize(s, use_graphemes=use_graphemes), K.normalize(t, use_graphemes=use_graphemes)
        d = K.edit_distance(s, t, use_graphemes, False)
        return d / max(len(K.clusters(s, use_graphemes)), len(K.clusters(t, use_graphemes)), 1) if normalized else d

    d = F.levenshtein(x, y).cast("double")
    if normalized:
        d = d / F.greatest(F.length(x), F.length(y), F.lit(1))
    other = K.arrow(apart, "double")(F.when(~plain, x), F.when(~plain, y))
    each = pairs.select(plain.alias("p"), d.alias("d"), other.alias("o"))
    return each.agg(F.coalesce(F.avg(F.when(F.col("p"), F.col("d")).otherwise(F.col("o"))), F.lit(0.0)).alias("mean_distance"))


def _operations(source: str, other: str) -> np.ndarray:
    """Keep, insert and delete (0, 1, 2) for each character of cleaned ``source``."""
    if source.isascii() and other.isascii():
        a, b = (np.frombuffer(s.encode(), np.uint8) for s in (source, other))
        own, there = np.flatnonzero(a != 32), np.flatnonzero(b != 32)
        if len(own) != len(there) or (a[own] != b[there]).any():
            raise ValueError("texts differ in more than white space")
        out = np.zeros(len(a), np.int8)
        if len(own) > 1:  # cleaned texts: one space or none before each character
            had, has = np.diff(own) > 1, np.diff(there) > 1
            out[own[1:][~had & has]] = 1
            out[own[1:][had & ~has] - 1] = 2
        return out
    return np.array(K.whitespace_operations(source, other), np.int8)


def _whitespace_counts(source: str, pred: str, target: str, mode: str) -> dict:
    source, pred, target = (K.normalize(K.clean(s)) for s in (source, pred, target))
    wanted = {"insertions": (1,), "deletions": (2,)}.get(mode, (1, 2))
    p, t = (_operations(source, x) for x in (pred, target))
    p, t = (np.where(np.isin(x, wanted), x, 0) for x in (p, t))
    tp = int(((p == t) & (p > 0)).sum())
    return {"empty": not p.any() and not t.any(), "tp": tp, "fp": int((p > 0).sum()) - tp, "fn": int((t > 0).sum()) - tp}


def _spelling_counts(source: str, pred: str, target: str, use_graphemes: bool = True) -> dict:
    """Misspelled words that the prediction restores or misses, and changed words that come out wrong."""
    source, pred, target = (K.normalize(K.clean(s)) for s in (source, pred, target))
    _, misspelled = K.edited_words(source, target)
    changed, _ = K.edited_words(source, pred)
    pairs, _, _ = K.match_words(pred, target)
    restored = {j for _, j in pairs}
    well = _well_predicted(source, pred, {i for i, _ in pairs}, use_graphemes)
    return {"empty": not misspelled and not changed, "tp": len(restored & {*misspelled}), "fp": len({*changed} - well), "fn": len({*misspelled} - restored)}


def _well_predicted(source: str, pred: str, right: set[int], use_graphemes: bool) -> set[int]:
    """Input words whose counterpart is all right: spaces kept by the alignment cut both texts into the same segments."""
    a, b = K.clusters(source, use_graphemes), K.clusters(pred, use_graphemes)
    ops = K.edit_operations(source, pred, use_graphemes, False, True)
    gone, new = {i for op, i, _ in ops if op == "d"}, {j for op, _, j in ops if op == "i"}
    kept_a = [i for i in range(len(a)) if i not in gone]
    kept_b = [j for j in range(len(b)) if j not in new]
    cuts = [(i, j) for i, j in zip(kept_a, kept_b) if a[i] == " "] + [(len(a), len(b))]
    found, i0, j0, wa, wb = set(), 0, 0, 0, 0
    for i, j in cuts:
        na, nb = a[i0:i].count(" ") + 1, b[j0:j].count(" ") + 1
        if all(w in right for w in range(wb, wb + nb)):
            found |= set(range(wa, wa + na))
        i0, j0, wa, wb = i + 1, j + 1, wa + na, wb + nb
    return found


def _f1(rows: DataFrame, counts: Column, beta: float, averaged: bool) -> DataFrame:
    each = rows.select(counts.alias("c"))
    if averaged:
        score = f_beta(F.col("c.tp"), F.col("c.fp"), F.col("c.fn"), beta)
        whole = lambda part: F.coalesce(F.avg(F.when(F.col("c.empty"), 1.0).otherwise(score[part])), F.lit(0.0)).alias(part)
        return each.agg(*map(whole, ("f", "precision", "recall")))
    sums = each.agg(*[F.coalesce(F.sum(f"c.{k}"), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")])
    return sums.select(f_beta(F.col("tp"), F.col("fp"), F.col("fn"), beta).alias("x")).select("x.*")


_COUNTS = "struct<empty:boolean,tp:int,fp:int,fn:int>"


def whitespace_f1(rows: DataFrame, source: str, pred: str, target: str, beta: float = 1.0, averaged: bool = True, mode: str = "insertions_and_deletions") -> DataFrame:
    """F-beta of white-space operations; rows where nothing was to do and nothing was done count 1 when averaged."""
    if mode not in ("insertions", "deletions", "insertions_and_deletions", "insertion_and_deletions"):
        raise ValueError(f"unknown mode {mode}")
    return _f1(rows, K.arrow(_whitespace_counts, _COUNTS, mode=mode)(source, pred, target), beta, averaged)


def spelling_f1(rows: DataFrame, source: str, pred: str, target: str, beta: float = 1.0, averaged: bool = True, use_graphemes: bool = True) -> DataFrame:
    """F-beta of corrected words."""
    return _f1(rows, K.arrow(_spelling_counts, _COUNTS, use_graphemes=use_graphemes)(source, pred, target), beta, averaged)


def average_tracker(df: DataFrame, name: str, **columns: Column) -> tuple[DataFrame, Observation]:
    """``df`` that reports the mean and sum of columns when it is run, over all tasks: ``<column>_mean`` and ``<column>_sum``."""
    seen = Observation(name)
    aggregates = [f(c).alias(f"{k}_{part}") for k, c in columns.items() for part, f in (("mean", F.avg), ("sum", F.sum))]
    return df.observe(seen, *aggregates), seen


def progress(df: DataFrame, name: str, column: str = "text") -> tuple[DataFrame, Observation]:
    """``df`` that reports ``items`` and ``bytes`` of a text column when it is run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("bytes")), seen


def clip_to_percentile(df: DataFrame, norm: str, percentile: float = 0.9, most: float | None = None) -> DataFrame:
    """``df`` with ``clip_factor``: what scales a norm down to the percentile of all norms, or to ``most`` if that is less."""
    if not 0 <= percentile <= 1:
        raise ValueError("a percentile between 0 and 1 is needed")
    bound = df.agg(F.percentile(norm, F.lit(percentile)).alias("bound"))
    limit = F.col("bound") if most is None else F.least("bound", F.lit(float(most)))
    return df.crossJoin(F.broadcast(bound)).withColumn("clip_factor", F.least(F.lit(1.0), limit / F.greatest(F.col(norm), F.lit(1e-12)))).drop("bound")
