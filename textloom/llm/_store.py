"""Where intermediate tables and binary artefacts go: the folder all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def base_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests), a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="textloom-"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_fallback[0])
    return f"file://{_fallback[0]}"


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder, as a URI that Spark's readers and writers take."""
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """The shared folder as a path that workers can open and map; only mounted file systems can be mapped."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped artefacts need a mounted shared folder, not {parsed.scheme}://")
    return parsed.path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_atomically(path: str, *parts) -> None:
    """Write buffers under a name of this attempt's own, then rename: a retried task can't leave half a file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        for part in parts:
            f.write(part)
    os.replace(own, path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later plan reads."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            discard_folder(local_path(os.path.dirname(f)))


def discard_folder(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name
