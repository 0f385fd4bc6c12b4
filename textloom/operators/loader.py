"""A training loader: sources to batches by one set of options."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S
from . import rows as R


@dataclass(frozen=True)
class Loader:
    """Options of a loader; ``build`` makes the DataFrame of batched rows.

    ``preprocessing`` and ``postprocessing`` are steps for all rows, or lists
    with a step for each source.  ``batch_limit`` counts rows, or with
    ``batch_limit_type`` "padded_item_size" rows times the longest.
    """

    preprocessing: R.Step | Sequence[R.Step] = R.none
    task: R.Step = R.none
    postprocessing: R.Step | Sequence[R.Step] = R.none
    strategy: str = "sequential"
    batch_limit: int = 16
    batch_limit_type: str = "batch_size"
    max_length: int = 512
    shuffle: bool = False
    sort: bool = False
    prefetch_factor: int = 1
    seed: int | None = None
    skip: int = 0
    limit: int | None = None
    rank: int = 0
    world: int = 1
    epoch: int = 0
    fast_forward: int = 0
    max_lines_per_file: int | None = None

    def __post_init__(self):
        if self.shuffle and self.seed is None:
            raise ValueError("shuffling needs a seed")
        if self.batch_limit_type not in ("batch_size", "padded_item_size"):
            raise ValueError(f"unknown batch_limit_type {self.batch_limit_type}")

    def set_epoch(self, epoch: int) -> Loader:
        return replace(self, epoch=epoch)

    def set_fast_forward(self, items: int) -> Loader:
        return replace(self, fast_forward=items)

    def set_max_length(self, n: int) -> Loader:
        return replace(self, max_length=n)

    def min_items(self, rows: DataFrame) -> int:
        return R.min_items(rows.count(), self.skip, self.limit)

    def items(self, rows: DataFrame) -> DataFrame:
        """Rows (input, target, file_idx, line_no) in order, taken by this rank, through steps and task, with ``size``."""
        rows = R.merge_sources(R.first_lines(rows, self.max_lines_per_file), self.strategy, self.seed or 0)
        rows = R.seeded(R.shard(rows, self.rank, self.world, self.skip, self.limit, self.fast_forward), self.seed or 0, self.epoch)
        steps = [s if callable(s) else R.per_source(s) for s in (self.preprocessing, self.task, self.postprocessing)]
        done = R.chain(*steps, R.clip_length(self.max_length))(rows)
        return done.withColumn("size", F.size("token_ids") if "token_ids" in done.columns else F.char_length("input"))

    def build(self, rows: DataFrame) -> DataFrame:
        """``items`` with ``shard`` and ``batch_id``."""
        kind = "padded" if self.batch_limit_type == "padded_item_size" else "count"
        return R.padded_batches(self.items(rows), self.batch_limit, sort=self.sort, shuffle=self.shuffle, seed=self.seed or 0, kind=kind, prefetch=self.prefetch_factor)

    def from_files(self, spark: SparkSession, paths: Sequence[str]) -> DataFrame:
        """Batches of JSON-lines files in the given order."""
        if not paths:
            raise ValueError("no files")
        return self.build(S.read_jsonl(spark, list(paths)))


def inference_items(items: DataFrame, tokenize: Callable[[Column], Column], max_length: int, context: int) -> DataFrame:
    """Windows of items (item_idx, text) with the ``token_ids`` and ``size`` of their context, for batch and streaming DataFrames."""
    from ..streaming.inference import windowed

    out = windowed(items, max_length, context).withColumn("token_ids", tokenize(F.col("context")))
    return out.withColumn("size", F.size("token_ids")).withColumn("context_bytes", F.octet_length("context")).withColumn("window_bytes", F.octet_length("window"))
