"""Command lines: ``python -m textloom.cli create_dictionary|train_bpe|clean ...`` under spark-submit or plain Python."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .functions import text as X
from .operators import dictionary as D
from .operators.merges import MergeTable, train_bpe
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("create_dictionary", help="count words or characters of text files")
    d.add_argument("files", nargs="+")
    d.add_argument("-o", "--out", required=True)
    d.add_argument("--max-size", type=int, default=100_000)
    d.add_argument("--key", choices=["word", "char"], default="word")
    d.add_argument("--char-grams", type=int, choices=[1, 3], default=1)
    b = sub.add_parser("train_bpe", help="learn byte-pair merges from text files")
    b.add_argument("files", nargs="+")
    b.add_argument("-o", "--out", required=True)
    b.add_argument("--vocab-size", type=int, required=True)
    b.add_argument("--num-special-tokens", type=int, default=0)
    c = sub.add_parser("clean", help="clean the white space of text files, line by line")
    c.add_argument("files", nargs="+")
    c.add_argument("-o", "--out", required=True)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    lines = files.read_lines(spark, a.files)
    if a.command == "create_dictionary":
        made = D.word_dictionary(lines, "value") if a.key == "word" else D.char_dictionary(lines, "value", a.char_grams)
        files.write_dictionary(D.top_terms(made, a.max_size), a.out)
    elif a.command == "train_bpe":
        merges = train_bpe(lines, a.vocab_size, a.num_special_tokens, "value")
        files.write_vocabulary(spark, MergeTable(merges).tokens, a.out)
    else:
        lines.select(X.clean("value").alias("value")).write.text(a.out)


if __name__ == "__main__":
    main()
