"""Golden values and properties of the string, edit, window and array functions."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays as A
from textloom.functions import kernels as K
from textloom.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_clean_and_whitespace(spark):
    s = F.lit("  this\t is \n a test sentence  ")
    assert one(spark, X.clean(s)) == "this is a test sentence" == K.clean("  this\t is \n a test sentence  ")
    assert one(spark, X.remove_whitespace(F.lit(" t   h is is \n\t a tes    t "))) == "thisisatest"
    assert one(spark, X.full_whitespace(F.lit(" t   h is is \n\t a tes    t "))) == "t h i s i s a t e s t"
    assert one(spark, X.clean(F.lit("")) ) == ""
    assert one(spark, X.clean(F.lit(None).cast("string"))) is None


def test_words(spark):
    assert [tuple(r) for r in one(spark, X.word_boundaries(F.lit("this is a test sentence")))] == [(0, 4), (5, 7), (8, 9), (10, 14), (15, 23)]
    parts = one(spark, X.split_words(F.lit("This is 123 a 'socalled' unit-test!")))
    assert [(r["word"], r["parts"]) for r in parts] == [("This", ["This"]), ("is", ["is"]), ("123", []), ("a", ["a"]), ("'socalled'", ["socalled"]), ("unit-test!", ["unit", "test"])]
    assert one(spark, X.words_with_leading_whitespace(F.lit("a  b c"))) == ["a", "  b", " c"]


def test_match_words():
    assert K.match_words("this is a test sentence", "This is not a test sentence") == ([(1, 1), (2, 3), (3, 4), (4, 5)], 5, 6)
    assert K.match_words("a b", "A B", True)[0] == [(0, 0), (1, 1)]
    assert K.match_words("", "a")[0] == []


def test_substrings(spark):
    assert [tuple(r) for r in one(spark, X.possible_char_substrings(F.lit("a täst"), 4))] == [(0, 5, 4), (1, 6, 4), (2, 7, 4)]
    assert [tuple(r) for r in one(spark, X.possible_char_substrings(F.lit(""), 4))] == [(0, 0, 0)]
    assert K.byte_substrings("a täst", 4) == [(0, 3, 3), (1, 5, 3), (2, 6, 3), (3, 7, 3)]
    assert len(K.clusters("नमस्ते")) == 3


def test_edit():
    a, b = "this is a test", "tihsi s a test"
    assert [K.edit_distance(a, b, True, swap, spaces) for swap, spaces in ((True, False), (False, False))] == [2, 4]
    assert K.edit_distance(a, b, True, True, True) == 3
    assert K.edit_distance("ca", "abc") == 3  # optimal string alignment
    assert math.isnan(K.edit_distance("", "", normalized=True))
    assert K.prefix_distance("abc", "abcdef") == 0
    rng = random.Random(1)
    for _ in range(200):
        x, y = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 8))) for _ in range(2))
        ops = K.edit_operations(x, y)
        assert len(ops) == K.edit_distance(x, y) and ops == sorted(ops, key=lambda o: (o[1], o[2]))
        assert K.edit_distance(x, y) == K.edit_distance(y, x)


def test_edited_words():
    assert K.edited_words("this is a test", "this is a test") == ([], [])
    assert K.edited_words("the quick fox", "the fast fox") == ([1], [1])


def test_whitespace_operations(spark):
    rng = random.Random(2)
    for _ in range(100):
        s = K.clean("".join(rng.choice("ab ") for _ in range(12)))
        for other in (s.replace(" ", ""), " ".join(s.replace(" ", ""))):
            assert K.whitespace_repair(s, K.whitespace_operations(s, other)) == other
            assert K.whitespace_repair(other, K.whitespace_operations(other, s)) == s
    with pytest.raises(ValueError):
        K.whitespace_operations("ab", "ac")
    cs = F.array(*map(F.lit, "ab c"))
    assert one(spark, X.repair_whitespace(cs, F.array(*map(F.lit, [0, 1, 2, 0])))) == "a bc"


def test_find(spark):
    assert one(spark, X.find_ignoring_whitespace(F.lit("this is a test sentence"), F.lit("atest"))) == " a test "
    assert one(spark, X.find_ignoring_whitespace(F.lit("this"), F.lit("xy"))) is None
    assert one(spark, X.find_ignoring_whitespace(F.lit("1 + (2) = 3."), F.lit("+(2)="))) == " + (2) = "


def test_classes(spark):
    for s, name, want in (("1234", "is_number", True), ("test", "is_alphabetic", True), (" \n", "is_whitespace", True), ("[({", "is_left_punctuation", True), (")}]", "is_right_punctuation", True), ("-_", "is_dash_punctuation", True), ("{", "is_dash_punctuation", False), ("!?", "is_other_punctuation", True), ("a!", "is_punctuation", False)):
        assert one(spark, X.has_class(F.lit(s), name)) is want, (s, name)


def test_windows(spark):
    for n in range(0, 60):
        for size, context in ((5, 0), (7, 2), (20, 4)):
            got = [tuple(r) for r in one(spark, X.char_windows(F.lit("x" * n), size, context))] if n % 13 == 0 else None
            want = K.byte_windows("x" * n, size, context)
            if got:
                assert got == want
            assert [w[1] for w in want[1:]] == [w[2] for w in want[:-1]] and want[-1][2] == n
    with pytest.raises(ValueError):
        K.byte_windows("äää", 3, 1)


def test_normalize():
    assert K.normalize("ﬁ") == "fi" and K.normalize("á", "nfc") == "á"
    with pytest.raises(ValueError):
        K.normalize("ä", "x")


def test_arrays(spark):
    ints = F.array(*map(F.lit, [2, 2, 1, 1, 1, 2]))
    runs = A.run_length_encode(ints, "int")
    assert [tuple(r) for r in one(spark, runs)] == [(2, 2), (1, 3), (2, 1)]
    assert one(spark, A.run_length_decode(runs)) == [2, 2, 1, 1, 1, 2]
    assert one(spark, A.run_length_encode(F.array().cast("array<int>"), "int")) == []
    assert one(spark, A.accumulate(ints)) == [2, 4, 5, 6, 7, 9]
    assert K.subsequences([1, 2, 3, 4], 4) == [(0, 2), (2, 3), (3, 4)]
    assert one(spark, A.eta(F.lit(10.0), F.lit(2.0), F.lit(10.0))) == 40
    assert one(spark, A.square_subsequent_mask(3)) == [[False, True, True], [False, False, True], [False, False, False]]
    assert one(spark, A.group_weights(F.array(F.lit(2), F.lit(1)))) == [0.5, 0.5, 1.0]


def test_decoding(spark):
    a = F.array(*map(F.lit, [0.0, 2.0, 1.0, -1.0]))
    p = one(spark, A.softmax(a))
    assert abs(sum(p) - 1) < 1e-12 and p.index(max(p)) == 1
    ninf = float("-inf")
    assert one(spark, A.top_k_mask(a, 2)) == [ninf, 2.0, 1.0, ninf]
    assert one(spark, A.nucleus_mask(a, 0.5)) == [ninf, 2.0, ninf, ninf]
    assert one(spark, A.min_p_mask(a, 0.3)) == [ninf, 2.0, 1.0, ninf]
    assert one(spark, A.repeat_penalty(a, F.array(F.lit(1), F.lit(3)), 2.0)) == [0.0, 1.0, 1.0, -2.0]


def test_chat(spark):
    m = lambda *rows: F.from_json(F.lit("[" + ",".join(rows) + "]"), X.CHAT_TYPE)
    hello, hi = '{"text":"Hello","role":"user"}', '{"text":"Hi","role":"assistant"}'
    roles = {"user": "{text}\n", "assistant": "{text}\n"}
    assert one(spark, X.format_chat(m(hello, hi), roles, end=None)) == "Hello\nHi\n"
    part = '{"text":"Hi","role":"assistant","partial":true}'
    assert one(spark, X.format_chat(m(hello, part), roles, "<s>", "</s>")) == "<s>Hello\nHi"
    with pytest.raises(Exception):
        one(spark, X.format_chat(m(part, hello), roles))
    with pytest.raises(Exception):
        one(spark, X.format_chat(m('{"text":"x","role":"other"}'), roles))
    assert one(spark, X.json_string(F.lit('"a\\n"'))) == "a\n"
    with pytest.raises(Exception):
        one(spark, X.json_string(F.lit("5")))


def test_kernels_run_in_slices(spark):
    rows = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    most = K.arrow_batch(lambda t: pa.array([len(t)] * len(t), pa.int32()), "int")
    assert max(r["n"] for r in rows.select(most("t").alias("n")).collect()) <= 11


def test_pairs_at_once_equal_single_pairs():
    rng = random.Random(4)
    a, b = ([rng.choice([None, "éé", "".join(rng.choice("ab é") for _ in range(rng.randint(0, 9)))]) for _ in range(300)] for _ in range(2))
    each = lambda f: [None if None in p else f(*p) for p in zip(a, b)]
    x, y = pa.array(a, pa.string()), pa.array(b, pa.string())
    assert K.pair_distances(x, y).to_pylist() == each(K.edit_distance)
    assert K.pair_distances(x, y, True).to_pylist() == each(K.prefix_distance)
    assert K.pair_operations(x, y).to_pylist() == each(lambda s, t: " ".join(f"{o}{i},{j}" for o, i, j in K.edit_operations(s, t)))


def test_byte_spans_are_texts():
    texts = ["", "a täst", None, "é\r\nx"]
    assert K.byte_spans(pa.array(texts), 4).to_pylist() == ["0-0", "0-3,1-5,2-6,3-7", None, "0-3,3-6"]
    assert K.byte_spans(pa.array(texts)[1:], 4).to_pylist() == ["0-3,1-5,2-6,3-7", None, "0-3,3-6"]
    assert K.byte_values(pa.array(texts)[1:]).to_pylist() == [None if t is None else [*t.encode()] for t in texts[1:]]


def test_white_space_operations_of_code_points_and_clusters():
    rng = random.Random(2)
    for _ in range(500):
        s = "".join(rng.choice("ab  \té") for _ in range(rng.randint(0, 12)))
        a, b = K.clean(s), K._SPACE.sub("", s)
        spaced, tail = K.whitespace_operations(a, b), K.whitespace_operations(a + "é", b + "é")  # the mark forces clusters
        assert list(spaced) == tail[:-1] and K.whitespace_repair(a, spaced) == b
        back = K.whitespace_operations(b, a)
        assert K.whitespace_repair(b, back) == a
