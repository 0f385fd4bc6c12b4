"""Sources and sinks: text and JSON lines, dictionaries, vocabularies, line filters."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import takewhile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value`` for each line: split at newlines, one carriage return stripped, invalid UTF-8 replaced."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(F.regexp_replace(F.make_valid_utf8("value"), r"\r$", "").alias("value"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path, lineSep="\n").count()


def file_size(spark: SparkSession, path: str) -> DataFrame:
    """``path, num_lines, num_bytes`` of each file."""
    sizes = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("num_bytes"))
    lines = spark.read.text(path, lineSep="\n").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("num_lines"))
    return sizes.join(lines, "path", "left").select("path", F.coalesce("num_lines", F.lit(0)).alias("num_lines"), "num_bytes")


def expand(spark: SparkSession, sources: Iterable[dict], error_on_empty: bool = True) -> list[str]:
    """Paths of {"type": "file", "path"} and {"type": "file_glob", "glob"} sources, in order."""
    found: list[str] = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for s in sources:
        pattern = hadoop.Path(s["path"] if s["type"] == "file" else s["glob"])
        status = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        paths = sorted(x.getPath().toString() for x in status or [])
        if not paths and error_on_empty:
            raise FileNotFoundError(f"no file matches {pattern.toString()}")
        found += paths
    return found


def parse_jsonl(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``input, target, error`` from JSON lines in ``value``.

    A line must be an object with a string ``input`` and, if any, a string
    ``target``, which defaults to the input.  Other lines have an error text
    and nulls; with ``strict`` they raise.
    """
    v = F.try_parse_json("value")
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    text = lambda p: F.try_variant_get(v, p, "string")
    error = (
        F.when(v.isNull(), "not JSON")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
        .when(kind("$.input").isNull() | (kind("$.input") != "STRING"), "input is no string")
        .when(kind("$.target").isNotNull() & (kind("$.target") != "STRING"), "target is no string")
    )
    out = lines.withColumn("error", error)
    if strict:
        out = out.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("error", F.lit(": "), "value")).cast("string")))
    good = F.col("error").isNull()
    return out.select(*[c for c in lines.columns if c != "value"], F.when(good, text("$.input")).alias("input"), F.when(good, F.coalesce(text("$.target"), text("$.input"))).alias("target"), "error")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, line_no`` of one file, numbered from 0 without gaps however the file is split into tasks.

    A line's place within its split comes from the scan; counts of the splits
    (a row each) are added up for the splits before.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace(F.make_valid_utf8("value"), r"\r$", "").alias("value"), at.alias("at"), F.monotonically_increasing_id().alias("n"))
    splits = lines.groupBy("at").agg(F.count("*").alias("rows"), F.min("n").alias("first"))
    before = F.sum("rows").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("at", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(starts, "at").select("value", (F.col("n") + F.col("shift")).alias("line_no"))


def read_jsonl(spark: SparkSession, paths: list[str], max_lines: int | None = None, keep_errors: bool = False) -> DataFrame:
    """Rows of several files with ``file_idx`` and ``line_no`` (its place in the file; bad lines leave gaps).

    Of each file the first ``max_lines`` lines count.  With ``keep_errors``
    bad lines stay, with nulls and an ``error``.
    """
    out = None
    for i, p in enumerate(paths):
        one = numbered_lines(spark, p).withColumn("file_idx", F.lit(i))
        one = one if max_lines is None else one.where(F.col("line_no") < max_lines)
        out = one if out is None else out.unionByName(one)
    rows = parse_jsonl(out)
    return rows if keep_errors else rows.where("error IS NULL").drop("error")


def read_json_values(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of each line as a VARIANT, whatever JSON it is; a line that is no JSON is an error."""
    return read_lines(spark, path).select(F.parse_json("value").alias("value"))


def from_iterator(spark: SparkSession, items: Iterable[str | None]) -> DataFrame:
    """``item_idx, text`` of an iterator's strings, up to the first None."""
    return spark.createDataFrame(list(enumerate(takewhile(lambda x: x is not None, items))), "item_idx bigint, text string")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``term, freq`` of tab-separated lines; a line without exactly two fields is an error, the last of repeated terms counts."""
    lines = numbered_lines(spark, path).select(F.trim("value").alias("v"), F.col("line_no").alias("n")).where("v <> ''")
    parts = F.split("v", "\t")
    ok = (F.size(parts) == 2) & F.try_to_number(F.get(parts, F.lit(1)), F.lit("999999999999999999")).isNotNull()
    row = F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("term"), F.get(parts, F.lit(1)).cast("bigint").alias("freq"))).otherwise(F.raise_error(F.concat(F.lit("not a dictionary line: "), "v")).cast("struct<term:string,freq:bigint>"))
    return lines.select(row.alias("r"), "n").groupBy("r.term").agg(F.max_by("r.freq", "n").alias("freq"))


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Tab-separated terms, most frequent first, in order over the part files."""
    dictionary.select(F.concat_ws("\t", "term", "freq").alias("value"), "freq", "term").orderBy(F.desc("freq"), "term").select("value").write.text(path)


def write_merges(spark: SparkSession, merges: list[tuple[bytes, bytes]], path: str) -> None:
    rows = [(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(merges)]
    spark.createDataFrame(rows, "merge_id int, first binary, second binary").coalesce(1).write.parquet(path)


def read_merges(spark: SparkSession, path: str) -> list[tuple[bytes, bytes]]:
    return [(bytes(r["first"]), bytes(r["second"])) for r in spark.read.parquet(path).orderBy("merge_id").collect()]


def read_misspellings(spark: SparkSession, path: str) -> DataFrame:
    """``word, replacements`` from a JSON object of lists."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType())))).alias("word", "replacements"))


def write_vocabulary(spark: SparkSession, tokens: list[bytes], path: str) -> None:
    spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id bigint, token binary").coalesce(1).write.parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> list[bytes]:
    return [bytes(r["token"]) for r in spark.read.parquet(path).orderBy("id").collect()]


def filter_dump_lines(lines: DataFrame, column: str = "value", min_chars: int = 10, min_words: int = 2) -> DataFrame:
    """``lines`` with the column trimmed, and whether it is ``valid``: no blank or document tag line, long enough."""
    s = F.trim(F.regexp_replace(column, r"^(?U)\s+|(?U)\s+$", ""))
    words = F.size(F.filter(F.split(s, " "), lambda w: w != ""))
    valid = (s != "") & ~s.startswith("<doc id=") & ~s.startswith("</doc>") & ((F.length(s) >= min_chars) | (words >= min_words))
    return lines.withColumn("valid", valid).withColumn(column, s)
