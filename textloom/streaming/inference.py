"""Inference over a stream of texts: windows, a model function, and stateful regrouping by item."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators.rows import padded_batches, with_index


def windowed(items: DataFrame, max_length: int, context: int) -> DataFrame:
    """``item_idx, n_windows, window_idx, window`` with text of context and window, for batch and streaming DataFrames."""
    # texts are cut before windows become rows, so that no row carries the whole text
    cut = lambda w, a, b: F.substring("text", w[a] + 1, w[b] - w[a])
    names = ("ctx_start", "window_start", "window_end", "ctx_end")
    one = lambda w: F.struct(*[w[n].alias(n) for n in names], cut(w, "ctx_start", "ctx_end").alias("context"), cut(w, "window_start", "window_end").alias("window"))
    w = F.transform(X.char_windows("text", max_length, context, False), one)
    out = items.select("item_idx", w.alias("w")).select("item_idx", F.size("w").alias("n_windows"), F.posexplode("w").alias("window_idx", "w"))
    return out.select("item_idx", "n_windows", "window_idx", "w.*")


def predict(windows: DataFrame, f: Callable[[pd.Series], pd.Series], column: str = "window") -> DataFrame:
    """``output`` of a batch function of texts."""
    return windows.withColumn("output", F.pandas_udf(f, "string")(column))


def regroup(outputs: DataFrame) -> DataFrame:
    """``item_idx, output``: the outputs of an item's windows in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct("window_idx", "output")))
    return outputs.groupBy("item_idx").agg(parts.alias("p")).select("item_idx", F.array_join("p.output", "").alias("output"))


def regroup_stream(outputs: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Streaming regroup: an item is emitted as soon as all its windows are there.

    State holds the windows of open items; with ``timeout_ms`` an item still
    incomplete after that time is dropped from it (such a stream polls for ever,
    so it doesn't end by itself).  Repeated windows count once.
    """
    outputs = outputs.select("item_idx", "n_windows", "window_idx", "output")
    if not timeout_ms:
        return _regroup_buckets(outputs)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, idx, text = state.get if state.exists else (False, [], [])
        have, total = dict(zip(idx, text)), 0
        for pdf in batches:
            total = int(pdf["n_windows"].iloc[0])
            have.update(zip(pdf["window_idx"].tolist(), pdf["output"].tolist()))
        if len(have) == total:
            state.remove()
            yield pd.DataFrame({"item_idx": [key[0]], "output": ["".join(have[i] for i in sorted(have))]})
        else:
            state.update((done, list(have), list(have.values())))
            state.setTimeoutDuration(timeout_ms)

    return outputs.groupBy("item_idx").applyInPandasWithState(run, "item_idx bigint, output string", "done boolean, idx array<int>, text array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


#: Groups of items that share a state; a group's items of one trigger are in memory at once.
BUCKETS = 4096


def _regroup_buckets(outputs: DataFrame) -> DataFrame:
    """``regroup_stream`` without a time limit: a call of Python handles many items, not one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have: dict[int, dict[int, str]] = {}
        totals: dict[int, int] = {}
        rows = [zip(*state.get)] if state.exists else []
        rows += [zip(*(pdf[c].tolist() for c in ("item_idx", "n_windows", "window_idx", "output"))) for pdf in batches]
        for item, total, i, text in chain.from_iterable(rows):
            have.setdefault(item, {})[i] = text
            totals[item] = total
        done = [item for item in have if len(have[item]) == totals[item]]
        yield pd.DataFrame({"item_idx": pd.Series(done, dtype="int64"), "output": ["".join(have[k][i] for i in sorted(have[k])) for k in done]})
        for item in done:
            del have[item]
        if have:
            state.update(tuple(map(list, zip(*((item, totals[item], i, text) for item, own in have.items() for i, text in own.items())))))
        elif state.exists:
            state.remove()

    kept = "item array<bigint>, total array<int>, idx array<int>, text array<string>"
    return outputs.withColumn("bucket", F.pmod(F.xxhash64("item_idx"), F.lit(BUCKETS))).groupBy("bucket").applyInPandasWithState(run, "item_idx bigint, output string", kept, "append", GroupStateTimeout.NoTimeout)


def micro_batches(stream: DataFrame, limit: int, handle: Callable[[DataFrame, int], None], key: str = "item_idx", **options) -> DataStreamWriter:
    """A writer that cuts each trigger's rows (with ``size``) into batches of bounded size before ``handle`` gets them.

    ``handle`` receives the rows with ``idx, shard, batch_id`` and the number
    of the trigger; options are those of ``rows.padded_batches``.
    """

    def each(rows: DataFrame, number: int) -> None:
        handle(padded_batches(with_index(rows, key), limit, **options), number)

    return stream.writeStream.foreachBatch(each)
