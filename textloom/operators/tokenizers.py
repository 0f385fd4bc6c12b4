"""Tokenizers as Columns: characters and bytes natively; merges and tokenizer files in Arrow batches.

Prefix and suffix ids are always added; special tokens in a text are
recognised, longest first, unless ``ignore_special_tokens``.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import kernels as K
from ..sources.files import read_merges
from .merges import MergeTable

CHARS = string.ascii_letters + string.digits + string.punctuation + " "


@dataclass(frozen=True)
class Special:
    """Special tokens, and which of them pad, lead and end."""

    tokens: tuple[str, ...] = ("<unk>", "<bos>", "<eos>", "<pad>")
    pad: str = "<pad>"
    prefix: tuple[str, ...] = ()
    suffix: tuple[str, ...] = ()

    def __post_init__(self):
        if missing := {self.pad, *self.prefix, *self.suffix} - {*self.tokens}:
            raise ValueError(f"not among the special tokens: {sorted(missing)}")

    def ids(self, offset: int) -> dict[str, int]:
        return {t: offset + i for i, t in enumerate(dict.fromkeys(self.tokens))}

    @property
    def pattern(self) -> str:
        return "|".join(re.escape(t) for t in sorted(self.tokens, key=lambda t: (-len(t), t)))


def _framed(ids: Column, special: Special, offset: int) -> Column:
    at = special.ids(offset)
    ends = [F.array(*[F.lit(at[t]) for t in side]) if side else F.array().cast("array<int>") for side in (special.prefix, special.suffix)]
    return F.concat(ends[0], ids, ends[1])


def _pieces(s: Column, special: Special, ignore: bool) -> Column:
    """The text as alternating plain pieces and special tokens."""
    if ignore or not special.tokens:
        return F.array(s)
    return F.regexp_extract_all(s, F.lit(rf"(?s)(?:{special.pattern})|(?:(?!{special.pattern}).)+"), F.lit(0))


class CharTokenizer:
    """95 ASCII characters; clusters of several code points and other characters are unknown."""

    def __init__(self, special: Special = Special()):
        self.special, self.offset = special, len(CHARS)
        self.vocab_size = len(CHARS) + len(special.ids(0))

    def tokenize(self, s: Column, ignore_special_tokens: bool = False) -> Column:
        at, unknown = self.special.ids(self.offset), self.special.ids(self.offset)["<unk>"]
        one = lambda c: F.when(F.length(c) == 1, F.coalesce(F.nullif(F.instr(F.lit(CHARS), c), F.lit(0)) - 1, F.lit(unknown))).otherwise(unknown)
        plain = lambda p: F.transform(X.clusters(p), one)
        if ignore_special_tokens or not self.special.tokens:
            return _framed(plain(s), self.special, self.offset)
        table = F.create_map(*[F.lit(x) for t, i in at.items() for x in (t, i)])
        return _framed(F.flatten(F.transform(_pieces(s, self.special, False), lambda p: F.when(F.element_at(table, p).isNotNull(), F.array(F.element_at(table, p))).otherwise(plain(p)))), self.special, self.offset)

    def continuations(self) -> list[bytes]:
        """The bytes of every id, special tokens included."""
        return [c.encode() for c in [*CHARS, *self.special.ids(0)]]

    def de_tokenize(self, ids: Column, ignore_special_tokens: bool = True) -> Column:
        names = list(self.special.ids(0))
        table = F.array(*[F.lit(t) for t in names])
        known = lambda i: F.when(i < self.offset, F.substring(F.lit(CHARS), i + 1, F.lit(1))).otherwise(F.lit("") if ignore_special_tokens else F.coalesce(F.get(table, i - self.offset), F.raise_error(F.lit("unknown id")).cast("string")))
        return F.array_join(F.transform(ids, known), "")


class ByteTokenizer:
    """UTF-8 bytes; special tokens from 256 on; padded with extra tokens to a multiple."""

    def __init__(self, special: Special = Special(), pad_to_multiple_of: int | None = None):
        size = 256 + len(special.ids(0))
        if pad_to_multiple_of:
            if pad_to_multiple_of & (pad_to_multiple_of - 1):
                raise ValueError("pad_to_multiple_of must be a power of two")
            extra = -size % pad_to_multiple_of
            special = Special((*special.tokens, *(f"<extra_token_{i}>" for i in range(extra))), special.pad, special.prefix, special.suffix)
            size += extra
        self.special, self.offset, self.vocab_size = special, 256, size

    @staticmethod
    def _bytes(s: Column) -> Column:
        each = F.split(F.decode(F.encode(s, "utf-8"), "ISO-8859-1"), "")  # a character for each byte
        return F.when(s == "", F.array().cast("array<int>")).otherwise(F.transform(each, F.ascii))

    def tokenize(self, s: Column, ignore_special_tokens: bool = False) -> Column:
        if ignore_special_tokens or not self.special.tokens:
            return _framed(K.arrow_batch(K.byte_values, "array<int>")(s), self.special, self.offset)
        table = F.create_map(*[F.lit(x) for t, i in self.special.ids(256).items() for x in (t, i)])
        return _framed(F.flatten(F.transform(_pieces(s, self.special, False), lambda p: F.when(F.element_at(table, p).isNotNull(), F.array(F.element_at(table, p))).otherwise(self._bytes(p)))), self.special, self.offset)

    def groups(self, s: Column, code_points: bool = False) -> Column:
        """Bytes of each cluster (or of each code point of each cluster) of the plain text, ends included as groups of 1."""
        if code_points:
            inner = F.transform(X.clusters(s), lambda c: F.transform(X.code_points(c), F.octet_length))
            one = F.array(F.array(F.lit(1)))
            ends = [F.flatten(F.array_repeat(one, len(side))) if side else F.array().cast("array<array<int>>") for side in (self.special.prefix, self.special.suffix)]
        else:
            inner = F.transform(X.clusters(s), F.octet_length)
            ends = [F.array_repeat(F.lit(1), len(side)) for side in (self.special.prefix, self.special.suffix)]
        return F.concat(ends[0], inner, ends[1])

    def continuations(self) -> list[bytes]:
        """The bytes of every id, special tokens included."""
        return [*(bytes([b]) for b in range(256)), *(t.encode() for t in self.special.ids(0))]

    def de_tokenize(self, ids: Column, ignore_special_tokens: bool = True) -> Column:
        table = F.array(*[F.hex(F.encode(F.lit(t), "utf-8")) for t in self.special.ids(0)])
        one = lambda i: F.when(i < 256, F.lpad(F.hex(i.cast("bigint")), 2, "0")).otherwise(F.lit("") if ignore_special_tokens else F.get(table, i - 256))
        return F.decode(F.unhex(F.array_join(F.transform(ids, one), "")), "utf-8")


def dummy_tokenize(s: Column) -> Column:
    return F.when(s.isNotNull(), F.array().cast("array<int>"))


#: Words whose ids a worker keeps.
CACHE_WORDS = 500_000


class MergeTokenizer:
    """Trained byte-pair merges over words with the white space before them; a worker encodes a word once.

    Special tokens are recognised, longest first, unless ignored; they come
    from the table, or from ``special``, which may also name a prefix and a
    suffix.
    """

    _WORD = regex.compile(r"\p{White_Space}+\P{White_Space}+|^\P{White_Space}+|\p{White_Space}+$")

    def __init__(self, table: MergeTable, special: Special | None = None):
        self.special = special or Special(tuple(table.specials) or ("<pad>",))
        missing = [t for t in self.special.tokens if t not in table.specials]
        self.table = table if not missing else MergeTable(list(table.rank), (*table.specials, *missing))

    @property
    def vocab_size(self) -> int:
        return self.table.vocab_size

    def continuations(self) -> list[bytes]:
        return self.table.continuations()

    def encode(self, ignore_special_tokens: bool = False) -> Callable[[Column], Column]:
        table, word = self.table, self._WORD
        ends = [[table.specials[t] for t in side] for side in (self.special.prefix, self.special.suffix)]
        split = None if ignore_special_tokens else regex.compile(f"({self.special.pattern})")

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str, list[int]] = {}

            def plain(t: str) -> list[int]:
                ids: list[int] = []
                for w in word.findall(t):
                    if w not in known:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        known[w] = table.encode_word(w)
                    ids += known[w]
                return ids

            def whole(t: str) -> list[int]:
                if split is None:
                    return plain(t)
                return [i for k, part in enumerate(split.split(t)) for i in ([table.specials[part]] if k % 2 else plain(part))]

            for (texts,) in K.slices(batches):
                yield pa.array([None if t is None else [*ends[0], *whole(t), *ends[1]] for t in texts.to_pylist()], pa.list_(pa.int32()))

        return run

    def decode(self, ignore_special_tokens: bool = True) -> Callable[[Column], Column]:
        return K.arrow(self.table.decode, "string", ignore_special_tokens=ignore_special_tokens)


class FileTokenizer:
    """A tokenizer.json file, loaded once a worker; missing special tokens are added."""

    def __init__(self, path: str, special: Special = Special(tokens=("<pad>",))):
        self.path, self.special = path, special

    def load(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.add_special_tokens([x for x in self.special.tokens if t.token_to_id(x) is None])
        return t

    @property
    def vocab_size(self) -> int:
        return self.load().get_vocab_size()

    def token_to_id(self, token: str) -> int | None:
        return self.load().token_to_id(token)

    def id_to_token(self, i: int) -> str | None:
        return self.load().id_to_token(i)

    def encode(self, ignore_special_tokens: bool = False) -> Callable[[Column], Column]:
        made = self

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            t = made.load()
            t.encode_special_tokens = ignore_special_tokens
            ends = [[t.token_to_id(x) for x in side] for side in (made.special.prefix, made.special.suffix)]
            for (column,) in K.slices(batches):
                texts = column.to_pylist()
                found = t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)
                yield pa.array([None if x is None else [*ends[0], *e.ids, *ends[1]] for x, e in zip(texts, found)], pa.list_(pa.int32()))

        return run

    def decode(self, ignore_special_tokens: bool = True) -> Callable[[Column], Column]:
        made = self

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            t = made.load()
            for ids in batches:
                found = t.decode_batch([[] if x is None else list(x) for x in ids], skip_special_tokens=ignore_special_tokens)
                yield pd.Series([None if x is None else s for x, s in zip(ids, found)])

        return run

    def continuations(self) -> list[bytes]:
        """The bytes that each id stands for: byte-level stand-ins and byte fallbacks undone, word marks as spaces."""
        t, stand_in = self.load(), _stand_ins()
        vocab = t.get_vocab(with_added_tokens=True)
        added = {x.content for x in t.get_added_tokens_decoder().values()}
        byte_level = "ByteLevel" in str(json.loads(t.to_str()).get("decoder"))
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if token in added:
                out[i] = token.encode()
            elif byte_level and all(c in stand_in for c in token):
                out[i] = bytes(stand_in[c] for c in token)
            elif m := re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", token):
                out[i] = bytes.fromhex(m[1])
            else:
                out[i] = token.replace("\u2581", " ").removeprefix("##").encode()
        return out


def _stand_ins() -> dict[str, int]:
    """The bytes behind the printable characters of byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _from_merges(table: MergeTable | None = None, path: str | None = None, max_vocab_size: int | None = None, special: Special | None = None) -> MergeTokenizer:
    """From a table, or from a folder of saved merges."""
    if table is None:
        spark = SparkSession.getActiveSession()
        table = MergeTable(read_merges(spark, path), special.tokens if special else (), max_vocab_size)
    return MergeTokenizer(table, special)


def make_tokenizer(config: dict):
    """A tokenizer from a dict with a ``type``: character, byte, bpe, huggingface or dummy."""
    kind, rest = config["type"], {k: v for k, v in config.items() if k != "type"}
    made = {"character": CharTokenizer, "byte": ByteTokenizer, "bpe": _from_merges, "huggingface": FileTokenizer, "dummy": lambda: dummy_tokenize}
    if kind not in made:
        raise ValueError(f"unknown tokenizer {kind}")
    return made[kind](**rest)
