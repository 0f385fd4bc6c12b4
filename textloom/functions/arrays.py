"""Array and number helpers, and decoding functions on arrays of logits - all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import numbers

NEG = float("-inf")


def accumulate(a: Column) -> Column:
    """Running sums of a short array (quadratic in its length; use a window for long ones)."""
    return F.transform(numbers(0, F.size(a)), lambda i: F.aggregate(F.slice(a, F.lit(1), i + 1), F.lit(0).cast("double"), lambda x, y: x + y))


def run_length_encode(a: Column, kind: str) -> Column:
    """Runs as (value, n)."""
    starts = F.filter(numbers(0, F.size(a)), lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(a)))
    return F.zip_with(starts, F.slice(ends, F.lit(1), F.size(starts)), lambda s, e: F.struct(F.get(a, s).cast(kind).alias("value"), (e - s).alias("n")))


def run_length_decode(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["n"])))


def pad(a: Column, size: Column, value) -> Column:
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(size - F.size(a), F.lit(0))))


def padding_mask(length: Column, size: Column) -> Column:
    """True at real positions."""
    return F.transform(numbers(0, size), lambda i: i < length)


def clip(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def group_weights(groups: Column, how: str = "mean") -> Column:
    """Weight of each position: 1/size of its group for means, 1 for sums."""
    return F.flatten(F.transform(groups, lambda g: F.array_repeat(1.0 / g if how == "mean" else F.lit(1.0), g)))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(F.floor(v), F.lit(high)), F.lit(low))


def eta(seconds: Column, done: Column, total: Column) -> Column:
    return seconds / done * total - seconds


def square_subsequent_mask(n: int, as_float: bool = False) -> Column:
    cell = (lambda i, j: F.when(j > i, NEG).otherwise(0.0)) if as_float else (lambda i, j: j > i)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: cell(i, j)))


def learning_rate(step: Column, kind: str, warmup: int, total: int, steps: tuple[int, ...] = (), factors: tuple[float, ...] = ()) -> Column:
    """Factor at a step after linear warm-up: linear, cosine, multi_step, constant or cont_sqrt."""
    s = step.cast("double")
    up = s / max(1, warmup)
    share = (s - warmup) / max(1, total - warmup)
    if kind == "linear":
        down = F.greatest(F.lit(0.0), 1 - share)
    elif kind == "cosine":
        down = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(share, F.lit(1.0))))
    elif kind == "multi_step":
        down = F.lit(1.0)
        for at, factor in zip(steps, factors):
            down = F.when(s >= at, factor).otherwise(down)
    elif kind == "cont_sqrt":
        down = F.sqrt(F.lit(float(max(1, warmup))) / F.greatest(s, F.lit(1.0)))
    else:
        down = F.lit(1.0)
    return F.when(s < warmup, up).otherwise(down)


def sinusoidal_position(position: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i % 2 == 0, F.sin(position * F.exp(-F.log(F.lit(10000.0)) * i / dim))).otherwise(F.cos(position * F.exp(-F.log(F.lit(10000.0)) * (i - 1) / dim))))


def alibi_slopes(heads: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(heads)), lambda i: F.pow(F.lit(2.0), -8.0 * i / heads))


# decoding


def temperature(a: Column, t: float) -> Column:
    return F.transform(a, lambda x: x / t)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, not once for each mention."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def softmax(a: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda p, q: p + q)
    over = lambda e: let(total(e), lambda z: F.transform(e, lambda x: x / z))
    return let(F.array_max(a), lambda top: let(F.transform(a, lambda x: F.exp(x - top)), over))


def ranked(a: Column) -> Column:
    """(value, index) by value descending, ties by index."""
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("n"), i.alias("i")))), lambda s: F.struct((-s["n"]).alias("value"), s["i"].alias("index")))


def greedy(a: Column, k: int = 1) -> Column:
    return F.slice(ranked(a), 1, k)


def _only(a: Column, keep: Column) -> Column:
    return let(keep, lambda kept: F.transform(a, lambda x, i: F.when(F.array_contains(kept, i), x).otherwise(NEG)))


def top_k_mask(a: Column, k: int) -> Column:
    return _only(a, F.transform(greedy(a, k), lambda s: s["index"]))


def nucleus_mask(a: Column, p: float, keep_min: int = 1) -> Column:
    """Keep the most probable tokens while the probability before them is less than p."""
    zero = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        on = (F.size(acc["kept"]) < keep_min) | (acc["sum"] < p)
        return F.struct((acc["sum"] + x["value"]).alias("sum"), F.when(on, F.array_append(acc["kept"], x["index"])).otherwise(acc["kept"]).alias("kept"))

    return _only(a, F.aggregate(ranked(softmax(a)), zero, step)["kept"])


def min_p_mask(a: Column, p: float, keep_min: int = 1) -> Column:
    kept = lambda order: F.transform(F.filter(order, lambda x, r: (r < keep_min) | (x["value"] >= F.get(order, F.lit(0))["value"] * p)), lambda x: x["index"])
    return _only(a, let(ranked(softmax(a)), kept))


def repeat_penalty(a: Column, seen: Column, penalty: float) -> Column:
    return F.transform(a, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def allow_tokens(a: Column, ids: Column) -> Column:
    return _only(a, ids)


def log_likelihood(log_probs: Column, normalise: bool = True, alpha: float = 1.0) -> Column:
    total = F.aggregate(log_probs, F.lit(0.0), lambda x, y: x + y)
    return total / F.pow(F.size(log_probs).cast("double"), F.lit(alpha)) if normalise else total


def multi_step(step: Column, values: list[tuple[int, float]], start: float) -> Column:
    """A schedule of steps: ``start``, and from each (step, value) on that value."""
    out = F.lit(start)
    for at, value in sorted(values):
        out = F.when(step >= at, F.lit(value)).otherwise(out)
    return out


def alibi_mask(n: Column, slope: Column) -> Column:
    """Rows of -slope * |i - j| for n positions."""
    return F.transform(numbers(0, n), lambda i: F.transform(numbers(0, n), lambda j: -slope * F.abs(i - j)))


def nested_weights(groups: Column, how: str = "mean") -> Column:
    """Weights of positions in groups of groups (sizes as an array of arrays): those of both levels multiplied."""
    one = lambda inner, g: 1.0 / (g * F.size(inner)) if how == "mean" else F.lit(1.0)
    return F.flatten(F.transform(groups, lambda inner: F.flatten(F.transform(inner, lambda g: F.array_repeat(one(inner, g), g)))))
