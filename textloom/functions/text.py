"""Native string functions: Column in, Column out, all inside whole-stage code generation.

Characters are extended grapheme clusters where a name says ``clusters``.
Java's ``\\X`` agrees with the Unicode rules but for conjuncts of Indic
scripts; ``kernels.clusters`` is exact for those too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K
from .kernels import arrow_batch, lists

WS = r"(?U)\s"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def numbers(start, stop: Column) -> Column:
    """start .. stop-1 as an array, empty when there are none (``sequence`` alone would count down)."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.when(stop > start, F.sequence(start.cast("int"), (stop - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, not once for each mention or element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# predicates on whole strings

_CLASSES = {
    "is_whitespace": r"^\p{IsWhite_Space}*$",
    "is_alphabetic": r"^\p{IsAlphabetic}*$",
    "is_number": r"^\p{N}*$",
    "is_punctuation": r"^\p{P}+$",
    "is_dash_punctuation": r"^[\p{Pd}\p{Pc}]+$",
    "is_left_punctuation": r"^[\p{Pi}\p{Ps}]+$",
    "is_right_punctuation": r"^[\p{Pf}\p{Pe}]+$",
    "is_other_punctuation": r"^\p{Po}+$",
}


def has_class(s: Column | str, name: str) -> Column:
    """One of the eight class predicates; white space, alphabetic and number hold for the empty string."""
    return _c(s).rlike(_CLASSES[name])


def is_ascii(s: Column | str) -> Column:
    return F.octet_length(_c(s)) == F.char_length(_c(s))


def code_points(s: Column | str) -> Column:
    return F.when(_c(s) == "", F.array().cast("array<string>")).otherwise(F.split(_c(s), ""))


def clusters(s: Column | str) -> Column:
    return F.regexp_extract_all(_c(s), F.lit(r"\X"), F.lit(0))


def chars(s: Column | str, use_graphemes: bool = True) -> Column:
    return clusters(s) if use_graphemes else code_points(s)


def char_byte_lengths(cs: Column) -> Column:
    return F.transform(cs, F.octet_length)


def sub(cs: Column, start: int | Column, end: int | Column) -> Column:
    """Characters start .. end-1 joined; bounds are clamped."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    lo = F.least(F.greatest(start, F.lit(0)), F.size(cs))
    hi = F.least(F.greatest(end, lo), F.size(cs))
    return F.array_join(F.slice(cs, lo + 1, hi - lo), "")


# cleaning and words


def clean(s: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(s), WS + "+", " "))


def remove_whitespace(s: Column | str) -> Column:
    return F.regexp_replace(_c(s), WS, "")


def full_whitespace(s: Column | str, use_graphemes: bool = True) -> Column:
    """One space between all characters that aren't white space."""
    return F.array_join(F.filter(chars(s, use_graphemes), lambda c: ~c.rlike(r"^(?U)\s+$")), " ")


def whitespace_words(s: Column | str) -> Column:
    return F.regexp_extract_all(_c(s), F.lit(r"(?U)\S+"), F.lit(0))


def words_with_leading_whitespace(s: Column | str) -> Column:
    return F.regexp_extract_all(_c(s), F.lit(r"(?U)\s+\S+|^\S+"), F.lit(0))


def word_parts(s: Column | str) -> Column:
    """Maximal alphabetic parts of words; a run with digits has none."""
    return F.regexp_extract_all(_c(s), F.lit(r"(?U)\b[\p{IsAlphabetic}\p{M}\p{Pc}\p{IsJoin_Control}]+\b"), F.lit(0))


def split_words(s: Column | str) -> Column:
    """Each white-space word with its alphabetic parts."""
    return F.transform(whitespace_words(s), lambda w: F.struct(w.alias("word"), word_parts(w).alias("parts")))


def word_boundaries(s: Column | str) -> Column:
    """(start, end) of white-space words in code points, found over whole Arrow batches."""
    return arrow_batch(_boundaries, "array<struct<start:int,end:int>>")(_c(s))


def find_ignoring_whitespace(s: Column | str, part: Column | str) -> Column:
    """The first match of ``part`` in ``s`` with any white space in and around it, else null; the empty part is found in front."""
    quoted = F.transform(code_points(remove_whitespace(part)), lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|&\-#~])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?U)\s*"), F.array_join(quoted, r"\s*"), F.lit(r"\s*"))
    return F.when(F.regexp_like(_c(s), pattern), F.call_function("regexp_extract", _c(s), pattern, F.lit(0)))


def possible_char_substrings(s: Column | str, max_chars: int, use_graphemes: bool = True) -> Column:
    """(byte_start, byte_end, n) of all windows of min(max_chars, length) characters; (0, 0, 0) for the empty string."""

    def spans(texts: pa.Array) -> pa.Array:
        each = []
        for t in texts.to_pylist():
            if t is None:
                each.append(None)
                continue
            at = K.char_bytes(t, use_graphemes)
            k = min(max_chars, len(at) - 1)
            each.append((at[: len(at) - k], at[k:], k))
        sizes = [0 if x is None else len(x[0]) for x in each]
        parts = [np.concatenate([x[side] for x in each if x is not None] or [np.zeros(0)]).astype(np.int32) for side in (0, 1)]
        n = np.repeat([0 if x is None else x[2] for x in each], sizes).astype(np.int32)
        return lists(sizes, {"byte_start": parts[0], "byte_end": parts[1], "n": n}, texts.is_null())

    return arrow_batch(spans, "array<struct<byte_start:int,byte_end:int,n:int>>")(_c(s))


def _boundaries(texts: pa.Array) -> pa.Array:
    rows = ["" if t is None else t for t in texts.to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in rows])]).astype(np.int64)
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = ~np.isin(points, K._SPACES)
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    start = np.flatnonzero(word & (first[:-1] | ~np.concatenate([[False], word[:-1]])))
    end = np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    row = np.searchsorted(at, start, "right") - 1
    sizes = np.bincount(row, minlength=len(rows))
    return lists(sizes, {"start": (start - at[row]).astype(np.int32), "end": (end - at[row]).astype(np.int32)}, texts.is_null())


def repair_whitespace(cs: Column, ops: Column) -> Column:
    """Apply keep / insert / delete codes (0, 1, 2) to characters; sizes must agree."""
    blank = lambda c: c.rlike(r"^(?U)\s+$")

    def repaired(both: Column) -> Column:
        cs, ops = both["cs"], both["ops"]
        before = F.concat(F.array(F.lit(" ")), F.slice(cs, F.lit(1), F.greatest(F.size(cs) - 1, F.lit(0))))
        # each character with the one before it and its operation; the first counts as after white space
        one = lambda z: F.when((z["op"] == 1) & ~blank(z["c"]) & ((z["i"] == 0) | ~blank(z["b"])), F.concat(F.lit(" "), z["c"])).when((z["op"] == 2) & blank(z["c"]), F.lit("")).otherwise(z["c"])
        rows = F.arrays_zip(cs.alias("c"), before.alias("b"), ops.alias("op"), numbers(0, F.size(cs)).alias("i"))
        good = F.array_join(F.transform(rows, one), "")
        return F.when(F.size(cs) == F.size(ops), F.when(F.size(cs) == 0, F.lit("")).otherwise(good)).otherwise(F.raise_error(F.lit("one operation for each character is needed")).cast("string"))

    return let(F.struct(cs.alias("cs"), ops.alias("ops")), repaired)


def nfkc(s: Column | str) -> Column:
    """Compatibility composition within clusters; normal texts pass as they are."""
    return K.arrow(K.normalize, "string")(_c(s))


# text windows


def char_windows(s: Column | str, max_length: int, context: int, use_graphemes: bool = True) -> Column:
    """Windows of max_length characters with context on both sides, in closed form (no loop)."""
    if max_length <= 2 * context:
        raise ValueError("max_length must be more than twice the context")
    first, step = max_length - context, max_length - 2 * context

    def all_windows(n: Column) -> Column:
        count = F.when(n <= first, F.lit(1)).otherwise(1 + F.ceil((n - first) / step).cast("int"))

        def window(k):
            start = F.when(k == 0, 0).otherwise(first + (k - 1) * step)
            end = F.least(n, F.when(k == 0, first).otherwise(first + k * step))
            return F.struct(F.greatest(F.lit(0), start - context).cast("int").alias("ctx_start"), start.cast("int").alias("window_start"), end.cast("int").alias("window_end"), F.least(n, end + context).cast("int").alias("ctx_end"))

        return F.transform(numbers(0, count), window)

    return let(F.size(chars(s, use_graphemes)) if use_graphemes else F.char_length(_c(s)), all_windows)


def full_window(s: Column | str) -> Column:
    n = F.char_length(_c(s))
    return F.array(F.struct(F.lit(0).alias("ctx_start"), F.lit(0).alias("window_start"), n.alias("window_end"), n.alias("ctx_end")))


def windows(s: Column | str, kind: str = "full", max_length: int = 0, context: int = 0, use_graphemes: bool = True) -> Column:
    """Windows by ``kind``: full, character or byte; the empty string has one of nothing."""
    if kind == "full":
        return full_window(s)
    if kind == "character":
        return char_windows(s, max_length, context, use_graphemes)
    if kind != "byte":
        raise ValueError(f"unknown windows {kind}")
    names = ("ctx_start", "window_start", "window_end", "ctx_end")
    cut = lambda t: [dict(zip(names, w)) for w in K.byte_windows(t, max_length, context, use_graphemes)]
    return K.arrow(cut, "array<struct<" + ",".join(f"{n}:int" for n in names) + ">>")(_c(s))


def char_at(cs: Column, i: int | Column) -> Column:
    """The character at a place, null outside."""
    return F.get(cs, i if isinstance(i, Column) else F.lit(i))


def byte_range(cs: Column, start: int, end: int) -> Column:
    """(start, end) in bytes of characters start .. end-1."""
    upto = lambda n: F.coalesce(F.octet_length(sub(cs, 0, n)), F.lit(0))
    return F.struct(upto(start).alias("start"), upto(end).alias("end"))


# JSON and chat


def json_string(s: Column | str) -> Column:
    """The string that a JSON text holds; an error for any other JSON value."""
    v = F.parse_json(_c(s))
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).otherwise(F.raise_error(F.lit("a JSON string is needed")).cast("string"))


CHAT_TYPE = "array<struct<text:string,role:string,partial:boolean>>"


def format_chat(messages: Column, roles: dict[str, str] | None = None, start: str = "", end: str | None = "<|assistant|>\n") -> Column:
    """Render messages by role templates with one ``{text}`` each.

    Without ``roles`` every role is ``<|role|>\\n{text}\\n\\n``.  A role
    without a template is an error; only the last message may be partial: its
    template ends at the text and ``end`` is left out.
    """
    for t in (roles or {}).values():
        if t.count("{text}") != 1:
            raise ValueError("a template needs exactly one {text}")
    part = lambda m: F.coalesce(m["partial"], F.lit(False))
    if roles is None:
        before, after = (lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"))), (lambda m: F.lit("\n\n"))
    else:
        pick = lambda i: F.create_map(*[F.lit(x) for r, t in roles.items() for x in (r, t.split("{text}")[i])])
        unknown = F.raise_error(F.lit("a message has a role without a template")).cast("string")
        before, after = (lambda m: F.coalesce(F.element_at(pick(0), m["role"]), unknown)), (lambda m: F.coalesce(F.element_at(pick(1), m["role"]), unknown))
    body = F.array_join(F.transform(messages, lambda m: F.concat(before(m), m["text"], F.when(part(m), "").otherwise(after(m)))), "")
    early = F.exists(F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0))), part)
    last = F.coalesce(F.element_at(F.transform(messages, part), -1), F.lit(False))
    text = F.concat(F.lit(start), body, F.when(last, "").otherwise(end or ""))
    return F.when(early, F.raise_error(F.lit("only the last message may be partial")).cast("string")).otherwise(text)
