"""Sampling and beam search over user-given next-token functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(logits: Column, seed: Column, k: int = 1) -> Column:
    """k token ids drawn without replacement from the softmax, by a seed of the row."""

    @F.pandas_udf("array<int>")
    def run(a: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for x, seed in zip(a, s):
            x = np.asarray(x, float)
            gumbel = np.random.default_rng(abs(int(seed))).gumbel(size=len(x))
            out.append(np.argsort(-(x + gumbel), kind="stable")[:k].tolist())
        return pd.Series(out)

    return run(logits, seed)


def beam_search(
    initial: list[int],
    log_probs: Callable[[list[list[int]]], list[list[float]]],
    eos: int,
    beams: int = 4,
    max_new: int = 32,
    alpha: float = 1.0,
    logit_fn: Callable[[np.ndarray, list[int]], np.ndarray] | None = None,
    stop: str = "estimated_score",
    max_outputs: int = 1,
) -> list[tuple[list[int], float]]:
    """Best finished sequences with their scores: sum of raw log probabilities over length ** alpha.

    Candidates are ranked after ``logit_fn``, scores use the raw values.
    ``stop``: ``max_outputs`` ends with enough finished, ``max_score`` when no
    open beam's score, ``estimated_score`` when no open beam's score at its
    present length is better than the worst kept.  Unfinished beams fill up.
    """
    open_beams: list[tuple[list[int], float]] = [([], 0.0)]
    done: list[tuple[list[int], float]] = []
    score = lambda ids, total: total / max(1, len(ids)) ** alpha
    for _ in range(max_new):
        rows = log_probs([initial + ids for ids, _ in open_beams])
        found = []
        for (ids, total), row in zip(open_beams, rows):
            raw = np.asarray(row, float)
            ranked = logit_fn(raw, initial + ids) if logit_fn else raw
            for t in np.argsort(-ranked, kind="stable")[: beams + 1].tolist():
                if np.isfinite(ranked[t]):
                    found.append((score([*ids, t], total + raw[t]), [*ids, t], total + raw[t]))
        found.sort(key=lambda x: (-x[0], x[1]))
        open_beams = []
        for s, ids, total in found[: 2 * beams]:
            if ids[-1] == eos:
                done.append((ids, s))
            elif len(open_beams) < beams:
                open_beams.append((ids, total))
        done.sort(key=lambda x: (-x[1], x[0]))
        if not open_beams or (len(done) >= max_outputs and (stop == "max_outputs" or score(*open_beams[0]) <= done[max_outputs - 1][1])):
            break
    rest = [(ids, score(ids, total)) for ids, total in open_beams]
    return (done + sorted(rest, key=lambda x: (-x[1], x[0])))[:max_outputs]


def beam_search_rows(rows: DataFrame, log_probs: Callable[[list[list[int]]], list[list[float]]], eos: int, **options) -> DataFrame:
    """``id, token_ids, score`` of the best sequence for each row (id, token_ids)."""

    def run(batches):
        for pdf in batches:
            best = [beam_search(list(x), log_probs, eos, **options)[0] for x in pdf["token_ids"]]
            yield pd.DataFrame({"id": pdf["id"], "token_ids": [b[0] for b in best], "score": [b[1] for b in best]})

    return rows.select("id", "token_ids").mapInPandas(run, "id bigint, token_ids array<int>, score double")
