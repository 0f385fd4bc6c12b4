"""Bounded, deterministic samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, key: str, bound: int, salt: str) -> pa.Table:
    """About ``bound`` rows of ``df`` at most, chosen by a salted hash of ``key``; all rows if there are no more."""
    n = df.count()
    if n > bound:
        df = df.where(F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    return df.toArrow()
