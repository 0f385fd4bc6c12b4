"""Dictionaries, merges, tokenizers, metrics, the row pipeline, sources, streaming, configuration."""

import random

import pytest
from pyspark.sql import functions as F

from textloom import config, report
from textloom.functions import beam
from textloom.functions import text as X
from textloom.operators import dictionary as D
from textloom.operators import merges as M
from textloom.operators import metrics as G
from textloom.operators import rows as R
from textloom.operators import tokenizers as Z
from textloom.operators.loader import Loader
from textloom.sources import files as S
from textloom.streaming import inference as I


def test_dictionary(spark, tmp_path):
    d = spark.createDataFrame([("this", 7), ("is", 4), ("good", 8)], "term string, freq bigint")
    keys = spark.createDataFrame([("god",), ("his",), ("this",)], "w string")
    got = {r["w"]: (r["term"], r["distance"]) for r in D.closest(keys, "w", d).collect()}
    assert got == {"god": ("good", 1.0), "his": ("this", 1.0), "this": ("this", 0.0)}
    found = {r["w"]: r["freq"] for r in D.lookup(keys, "w", d).collect()}
    assert found == {"god": None, "his": None, "this": 7}
    S.write_dictionary(d, str(tmp_path / "d"))
    back = S.read_dictionary(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, back.collect())) == [("good", 8), ("is", 4), ("this", 7)]
    (tmp_path / "bad.txt").write_text("one\ntwo 3\n")
    with pytest.raises(Exception):
        S.read_dictionary(spark, str(tmp_path / "bad.txt")).collect()
    lines = spark.createDataFrame([("a b a1 b_c",), ("",)], "text string")
    assert sorted(map(tuple, D.word_dictionary(lines).collect())) == [("a", 1), ("b", 1), ("b_c", 1)]
    assert sorted(map(tuple, D.char_dictionary(spark.createDataFrame([("ab",)], "text string"), grams=3).collect())) == [("<bow> a b", 1), ("a b <eow>", 1)]
    assert [r["term"] for r in D.top_terms(d, 2).collect()] == ["good", "this"]


def test_bpe(spark):
    lines = spark.createDataFrame([("low lower lowest " * 5,), ("new newer",)], "text string")
    merges = M.train_bpe(lines, 320, 4)
    assert merges[0] in ((b"l", b"o"), (b"o", b"w")) and len(merges) <= 60
    t = M.MergeTable(merges)
    rng = random.Random(3)
    for _ in range(100):
        s = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FFF)])) for _ in range(20))
        assert t.decode(t.encode_word(s)) == s
    tok = Z.MergeTokenizer(t)
    got = lines.select(tok.decode()(tok.encode()("text")).alias("t"), "text").collect()
    assert all(r["t"] == r["text"] for r in got)
    with pytest.raises(ValueError):
        M.train_bpe(lines, 300)


def test_bpe_training_counts_every_word(spark, monkeypatch):
    lines = spark.createDataFrame([("ab ab ab",), ("qw",)], "text string")
    with monkeypatch.context() as m:
        m.setattr(type(lines), "limit", lambda self, n: self.where("false"))  # no cut of the words
        merges = M.train_bpe(lines, 320)
    assert merges == [(b"a", b"b"), (b" ", b"ab"), (b"q", b"w")]


def test_bpe_rounds_make_the_same_merges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join("".join(rng.choice("aaabcdé") for _ in range(rng.randint(1, 12))) for _ in range(200)),) for _ in range(20)]
    lines = spark.createDataFrame(rows, "text string").repartition(3)
    whole = M.train_bpe(lines, 512)
    held, merge = [], M.merge_words
    monkeypatch.setattr(M, "merge_words", lambda data, *more: held.append(len(data)) or merge(data, *more))
    monkeypatch.setattr(M, "HELD_SYMBOLS", 20_000)
    monkeypatch.setattr(M, "ROUND_PAIRS", 64)
    assert M.train_bpe(lines, 512) == whole and len(whole) == 256
    assert len(held) > 1 and max(held) <= 20_000  # the driver never holds all words


def test_bpe_queries_train_on_documents(spark, tmp_path):
    from textloom.plans import catalogue

    spark.createDataFrame([(1, "zq zq zq zq")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "ab ab ab ab ab")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [(bytes(r["first"]), bytes(r["second"])) for r in catalogue.bpe_train(spark, str(tmp_path)).orderBy("merge_id").collect()] == [(b"z", b"q"), (b" ", b"zq")]
    assert len(catalogue.bpe_encode(spark, str(tmp_path)).first()["ids"]) == 4


def test_text_operators_over_documents(spark, tmp_path):
    from textloom.plans import catalogue

    rows = [(1, "täst  a\nlong " * 3000), (2, ""), (3, "!!")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["item_id"]: r["ids"] for r in catalogue.QUERIES["byte_tokenize"](spark, str(tmp_path)).collect()}
    assert got == {i: ",".join(map(str, t.encode())) for i, t in rows}
    got = {r["idx"]: r["input"] for r in catalogue.QUERIES["ws_corrupt_p1"](spark, str(tmp_path)).collect()}
    assert got == {i: "".join(t.split()) for i, t in rows}


def test_tokenizers(spark):
    s = spark.createDataFrame([("a täst",), ("a <pad>t",), ("",)], "s string")
    char = Z.CharTokenizer()
    ids = [r["x"] for r in s.select(char.tokenize(F.col("s"), True).alias("x")).collect()]
    assert len(ids[0]) == 6 and ids[0][3] == 95 and len(ids[1]) == 8 and ids[2] == []
    assert [len(r["x"]) for r in s.select(char.tokenize(F.col("s")).alias("x")).collect()] == [6, 4, 0]
    byte = Z.ByteTokenizer(Z.Special(prefix=("<bos>",), suffix=("<eos>",)), 128)
    assert byte.vocab_size == 384
    back = s.select(byte.de_tokenize(byte.tokenize(F.col("s"), True)).alias("x"), "s").collect()
    assert all(r["x"] == r["s"] for r in back)
    assert s.select(byte.groups(F.col("s")).alias("x")).first()["x"] == [1, 1, 1, 1, 2, 1, 1, 1]
    assert s.select(Z.ByteTokenizer().groups(F.col("s"), True).alias("x")).first()["x"] == [[1], [1], [1], [2], [1], [1]]
    with pytest.raises(ValueError):
        Z.Special(tokens=("a",), pad="b")
    with pytest.raises(ValueError):
        Z.make_tokenizer({"type": "other"})


def test_metrics(spark):
    b = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, t boolean")
    assert tuple(G.binary_f1(b, "p", "t").first()) == (0.5, 0.5, 0.5)
    rows = spark.createDataFrame([("thisis a test", "this is a test", "this is a test"), ("a b", "a b", "a b")], "s string, p string, t string")
    assert tuple(G.whitespace_f1(rows, "s", "p", "t").first()) == (1.0, 1.0, 1.0)
    assert tuple(G.spelling_f1(rows, "s", "p", "t").first()) == (1.0, 1.0, 1.0)
    wrong = spark.createDataFrame([("teh cat satt", "the cat sat on", "the cat sat"), ("ab cd", "ab ce", "ab cd")], "s string, p string, t string")
    f, p, r = G.spelling_f1(wrong, "s", "p", "t", averaged=False).first()
    assert r == 1.0 and p < 1
    assert G.accuracy(rows, "p", "t").first()[0] == 1.0
    assert G.mean_edit_distance(rows.where("false"), "s", "t").first()[0] == 0.0


def _rows(spark, texts):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "idx bigint, input string, target string")
    return R.seeded(df, 5)


def test_order(spark):
    rows = spark.createDataFrame([(f, n) for f, m in ((0, 3), (1, 1), (2, 2)) for n in range(m)], "file_idx int, line_no bigint")
    order = lambda how: [(r["file_idx"], r["line_no"]) for r in R.merge_sources(rows, how).orderBy("idx").collect()]
    assert order("sequential") == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1)]
    assert order("interleaved") == [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2)]
    assert sorted(order("weighted")) == order("sequential")
    idx = R.merge_sources(rows)
    assert [r["idx"] for r in R.shard(idx, 1, 2, skip=1, limit=5).orderBy("idx").collect()] == [2, 4]


def test_index_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "INDEX_ROWS", 10)
    df = spark.range(95).select(((F.col("id") * 37) % 95).alias("k"))
    assert [r["idx"] for r in R.with_index(df, "k").orderBy("k").collect()] == list(range(95))


def test_steps(spark):
    rows = _rows(spark, ["a test", "G i n", "ab"])
    get = lambda df: [r["input"] for r in df.orderBy("idx").collect()]
    assert get(R.whitespace_corruption(0, 1)(rows)) == ["atest", "Gin", "ab"]
    assert get(R.whitespace_corruption(1, 0)(rows)) == ["a t e s t", "G i n", "a b"]
    marked = R.mark("k", "v")(rows)
    assert get(R.on_mark("k", "v", R.prefix("input", "x"))(marked)) == ["xa test", "xG i n", "xab"]
    assert get(R.on_mark("k", "w", R.prefix("input", "x"))(marked)) == ["a test", "G i n", "ab"]
    assert set(get(R.switch([R.prefix("input", "x"), R.suffix("input", "y")], [0.5, 0.5])(rows))) <= {"xa test", "a testy", "xG i n", "G i ny", "xab", "aby"}
    a = R.spelling_corruption(1.0)(rows)
    assert get(a) == get(a) and get(a) != get(rows)
    with pytest.raises(ValueError):
        R.switch([R.prefix("input", "x")], [0.5])


def test_edit_word():
    for seed in range(50):
        word, done = R.edit_word("täst", R._rng(seed))
        assert word != "täst" and abs(len(word) - 4) <= 1
        same, _ = R.edit_word("täst", R._rng(seed), ops=("delete", "replace", "swap"), exclude={0, 1, 2, 3})
        assert same == "täst"


def test_batches(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, rng.randint(1, 64)) for i in range(300)], "idx bigint, size int")
    for sort in (False, True):
        for shuffle in (False, True):
            got = R.padded_batches(rows, 256, 100, sort, shuffle, 1)
            stats = R.batch_statistics(got, "shard", "batch_id").collect()
            assert sum(s["n_items"] for s in stats) == 300
            assert all(s["n_items"] * s["max_size"] <= 256 or s["n_items"] == 1 for s in stats)
    padded = R.tensorize(spark.createDataFrame([(0, [1, 2]), (0, [1])], "batch_id int, token_ids array<int>"), "token_ids", -1).collect()
    assert sorted(r["token_ids"] for r in padded) == [[1, -1], [1, 2]]


def test_sources(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b'{"input":"a"}\r\n{"input":"b","target":"c"}\n{"input":5}\n[1]\nnope\n{"input":"z"}')
    got = S.read_jsonl(spark, [str(f)]).orderBy("line_no").collect()
    assert [(r["input"], r["target"]) for r in got] == [("a", "a"), ("b", "c"), ("z", "z")]
    assert S.count_lines(spark, str(f)) == 6
    size = S.file_size(spark, str(f)).first()
    assert (size["num_lines"], size["num_bytes"]) == (6, f.stat().st_size)
    assert len(S.expand(spark, [{"type": "file_glob", "glob": str(tmp_path / "*.jsonl")}])) == 1
    with pytest.raises(FileNotFoundError):
        S.expand(spark, [{"type": "file", "path": str(tmp_path / "none")}])
    lines = spark.createDataFrame([("<doc id=1>",), ("",), ("short",), ("two words",), ("</doc>",)], "value string")
    assert [r["valid"] for r in S.filter_dump_lines(lines).collect()] == [False, False, False, True, False]
    (tmp_path / "m.json").write_text('{"teh": ["the"]}')
    assert S.read_misspellings(spark, str(tmp_path / "m.json")).first()["replacements"] == ["the"]


def test_regroup(spark):
    items = spark.createDataFrame([(0, "x" * 100), (1, ""), (2, "ab")], "item_idx bigint, text string")
    got = {r["item_idx"]: r["output"] for r in I.regroup(I.windowed(items, 16, 4).withColumn("output", F.col("window"))).collect()}
    assert got == {0: "x" * 100, 1: "", 2: "ab"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, "x" * 100), (1, ""), (2, "ab")], "item_idx bigint, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("item_idx bigint, text string").parquet(str(tmp_path / "in"))
    out = I.regroup_stream(I.windowed(source, 16, 4).withColumn("output", F.col("window")))
    q = out.writeStream.format("memory").queryName("regrouped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["item_idx"]: r["output"] for r in spark.sql("SELECT * FROM regrouped").collect()} == {0: "x" * 100, 1: "", 2: "ab"}


def test_beam():
    table = {(): [0.1, 0.6, 0.3], (1,): [0.5, 0.2, 0.3], (2,): [0.9, 0.05, 0.05]}
    import math

    f = lambda seqs: [[math.log(p) for p in table.get(tuple(s[1:]), [0.98, 0.01, 0.01])] for s in seqs]
    ids, score = beam.beam_search([9], f, 0, beams=3, alpha=0.0)[0]
    assert ids == [1, 0] and abs(score - math.log(0.3)) < 1e-9


def test_config(tmp_path, monkeypatch):
    (tmp_path / "b.yaml").write_text("x: 1\n")
    (tmp_path / "a.yaml").write_text("a: eval(10 * 50)\nb: file(b.yaml)\nc: env(NOPE:7)\nd: pad(x;2;1;-)\n")
    assert config.load(tmp_path / "a.yaml") == {"a": 500, "b": {"x": 1}, "c": 7, "d": "--x-"}
    with pytest.raises(ValueError):
        config.arithmetic("__import__('os')")
    assert report.table([["a", "1"]], ["k", "v"]).splitlines()[0].startswith("| k")
    assert "2.0" in report.throughput("t", "m", 10, 1000, 5.0)


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "dict_words_topk" in e.queries()
    assert X.WS


def test_switch_branches_keep_their_columns(spark):
    rows = R.seeded(spark.createDataFrame([(i, "abc def", "abc def", list(range(10)), "z") for i in range(200)], "idx bigint, input string, target string, token_ids array<int>, branch string"))
    out = R.switch([R.clip_length(3), R.chain(R.clip_length(7), lambda df: df.withColumn("row", F.lit(1)))], [0.5, 0.5])(rows)
    assert out.columns == [*rows.columns, "row"]
    got = out.collect()
    assert {(len(r["token_ids"]), r["row"]) for r in got} == {(3, None), (7, 1)} and all(r["branch"] == "z" for r in got)
    two = R.chain(R.switch([R.prefix("input", "a"), R.none], [0.5, 0.5]), R.switch([R.prefix("input", "b"), R.none], [0.5, 0.5]))(rows)
    kinds = {r["input"].removesuffix("abc def") for r in two.collect()}
    assert kinds == {"", "a", "b", "ba"}  # both draws are their own
    assert two.collect() == two.collect()


def test_steps_for_each_source(spark):
    rows = R.seeded(spark.createDataFrame([(0, 0, "x", "x"), (1, 1, "x", "x")], "idx bigint, file_idx int, input string, target string"))
    got = {r["file_idx"]: r["input"] for r in R.per_source([R.prefix("input", "a"), R.prefix("input", "b")])(rows).collect()}
    assert got == {0: "ax", 1: "bx"}
    with pytest.raises(Exception):
        R.per_source([R.prefix("input", "a")])(rows).collect()
    said = rows.withColumn("input", F.lit('[{"text": "hi", "role": "user"}]')).withColumn("target", F.lit('"q"'))
    r = R.chain(R.chat_decode("input"), R.json_decode("target"))(said).first()
    assert r["input"].startswith("<|user|>") and r["target"] == "q"


def test_lines_of_split_files(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 1200)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"input": "{name}{i}"}}\n' if i % 7 else "bad\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        paths = [str(tmp_path / f"{x}.jsonl") for x in "ab"]
        rows = S.read_jsonl(spark, paths)
        assert rows.rdd.getNumPartitions() > 5
        got = rows.collect()
        assert len(got) == sum(1 for n in (3000, 1200) for i in range(n) if i % 7)
        assert all(r["input"] == "ab"[r["file_idx"]] + str(r["line_no"]) for r in got)
        mixed = [r["input"] for r in R.merge_sources(rows, "interleaved").orderBy("idx").limit(6).collect()]
        assert mixed == ["a1", "b1", "a2", "b2", "a3", "b3"]
        assert S.read_jsonl(spark, paths, max_lines=10).count() == 16
        assert S.read_jsonl(spark, paths, keep_errors=True).where("error IS NOT NULL").count() == 429 + 172
        (tmp_path / "dict.txt").write_text("".join(f"term{i % 500}\t{i}\n" for i in range(4000)))
        assert all(r["freq"] == 3500 + int(r["term"][4:]) for r in S.read_dictionary(spark, str(tmp_path / "dict.txt")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "any.jsonl").write_text('[1, 2]\n"x"\n3\n')
    assert S.read_json_values(spark, str(tmp_path / "any.jsonl")).count() == 3
    assert [r["text"] for r in S.from_iterator(spark, iter(["a", "b", None, "c"])).orderBy("item_idx").collect()] == ["a", "b"]


def test_index_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(R, "INDEX_ROWS", 50)
    rows = spark.createDataFrame([((i * 37) % 400, i) for i in range(400)] + [(7, 900), (7, 901)], "k bigint, range int")
    got = R.with_index(rows, "k", "range").orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(402)) and [(r["k"], r["range"]) for r in got] == sorted((r["k"], r["range"]) for r in got)


def test_compatibility_characters(spark):
    lines = spark.createDataFrame([("ﬁne ｆｕｌｌ cafe\u0301",), ("fine full caf\u00e9",)], "text string")
    assert sorted(map(tuple, D.word_dictionary(lines).collect())) == [("café", 2), ("fine", 2), ("full", 2)]
    assert dict(map(tuple, D.char_dictionary(lines).collect()))["f"] == 6
    assert D.word_dictionary(lines, max_sequences=1).count() == 3
    keys = spark.createDataFrame([("ﬁne",), ("ｆｕｌｋ",)], "w string")
    d = D.word_dictionary(lines)
    assert {r["w"]: r["freq"] for r in D.lookup(keys, "w", d).collect()} == {"ﬁne": 2, "ｆｕｌｋ": None}
    assert {r["w"]: (r["term"], r["distance"]) for r in D.closest(keys, "w", d).collect()} == {"ﬁne": ("fine", 0.0), "ｆｕｌｋ": ("full", 1.0)}
    pairs = spark.createDataFrame([("ﬁne", "fine"), ("cafe\u0301", "café"), ("नमस्ते", "नम")], "a string, b string")
    assert G.mean_edit_distance(pairs, "a", "b").first()[0] == pytest.approx(1 / 3)
    assert M.train_bpe(lines.where("text LIKE 'ﬁ%'"), 320) == M.train_bpe(spark.createDataFrame([("fine full café",)], "text string"), 320)


def test_closest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_KEYS", 7)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    terms = {word(): rng.randint(1, 4) for _ in range(150)}
    keys = sorted({word() for _ in range(30)})
    d = spark.createDataFrame(list(terms.items()), "term string, freq bigint")
    from textloom.functions import kernels as K

    for normalized in (False, True):
        got = {r["w"]: (r["term"], r["distance"]) for r in D.closest(spark.createDataFrame([(k,) for k in keys], "w string"), "w", d, normalized).collect()}
        for k in keys:
            far = {t: K.edit_distance(k, t, False, False) / (max(len(k), len(t)) if normalized else 1) for t in terms}
            best = max(terms, key=lambda t: (-far[t], terms[t], t))
            assert got[k] == (best, pytest.approx(far[best]))
    assert D.closest(spark.createDataFrame([], "w string"), "w", d).count() == 0


def _slow_merges(words, most):
    words = [[[bytes([b]) for b in w.encode()], f] for w, f in words.items()]
    merges = []
    while len(merges) < most:
        stats = {}
        for w, f in words:
            for p in zip(w, w[1:]):
                stats[p] = stats.get(p, 0) + f
        if not stats:
            break
        best = min(stats, key=lambda p: (-stats[p], p))
        merges.append(best)
        for row in words:
            old, new, k = row[0], [], 0
            while k < len(old):
                step = 2 if k + 1 < len(old) and (old[k], old[k + 1]) == best else 1
                new.append(b"".join(old[k : k + step]))
                k += step
            row[0] = new
    return merges


def test_merges_equal_brute_force(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("aab é") for _ in range(rng.randint(1, 9))).strip() or "a": rng.randint(1, 20) for _ in range(60)}
    words = {"".join(w.split()): f for w, f in words.items()}
    lines = spark.createDataFrame([((" " + w) * f,) for w, f in words.items()], "text string")
    want = _slow_merges({" " + w: f for w, f in words.items()}, 100)
    assert M.train_bpe(lines, 384, 28) == want[:100]
    t = M.MergeTable(want)
    for _ in range(50):
        s = "".join(rng.choice("aab é") for _ in range(30))
        parts = [bytes([b]) for b in s.encode()]
        while (found := [(t.rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in t.rank]):
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert t.encode_word(s) == [t.ids[p] for p in parts]


def test_merge_tokenizer_contract(spark, tmp_path):
    merges = M.train_bpe(spark.createDataFrame([("low lower lowest " * 5,)], "text string"), 320, 3)
    S.write_merges(spark, merges, str(tmp_path / "merges"))
    assert S.read_merges(spark, str(tmp_path / "merges")) == merges
    tok = Z.make_tokenizer({"type": "bpe", "path": str(tmp_path / "merges"), "special": Z.Special(("<pad>", "<bos>", "<eos>"), "<pad>", ("<bos>",), ("<eos>",))})
    df = spark.createDataFrame([("low<pad>lower",), (None,), ("",)], "t string")
    ids = [r[0] for r in df.select(tok.encode()("t")).collect()]
    t = tok.table
    bos, eos, pad = (t.token_to_id(x) for x in ("<bos>", "<eos>", "<pad>"))
    assert ids[0][0] == bos and ids[0][-1] == eos and pad in ids[0] and ids[1] is None and ids[2] == [bos, eos]
    assert pad not in df.select(tok.encode(True)("t")).first()[0]
    back = df.select(tok.decode()(tok.encode()("t")), tok.decode(False)(tok.encode()("t"))).first()
    assert tuple(back) == ("lowlower", "<bos>low<pad>lower<eos>")
    assert tok.vocab_size == len(tok.continuations()) == 256 + len(merges) + 3 and t.id_to_token(pad) == b"<pad>" and t.id_to_token(10**6) is None


def test_file_tokenizer_round_trip(spark):
    tok = Z.FileTokenizer("/opt/tokenizers/byte_bpe_50k.json")
    df = spark.createDataFrame([("Hello wörld, 漢字!",), (None,)], "t string")
    assert [r[0] for r in df.select(tok.decode()(tok.encode()("t"))).collect()] == ["Hello wörld, 漢字!", None]
    every = tok.continuations()
    ids = df.select(tok.encode()("t")).first()[0]
    assert b"".join(every[i] for i in ids).decode() == "Hello wörld, 漢字!" and len(every) == tok.vocab_size
    assert tok.id_to_token(tok.token_to_id("<pad>")) == "<pad>"
    assert Z.ByteTokenizer().continuations()[65] == b"A" and Z.CharTokenizer().continuations()[0] == b"a"


@pytest.mark.parametrize(("sort", "shuffle", "kind"), [(s, f, k) for s in (False, True) for f in (False, True) for k in ("padded", "count")])
def test_buffered_batches(spark, sort, shuffle, kind):
    rng = random.Random(1)
    sizes = {i: rng.randint(1, 60) for i in range(500)}
    rows = spark.createDataFrame(list(sizes.items()), "idx bigint, size int")
    limit = 128 if kind == "padded" else 8
    got = {}
    for r in R.padded_batches(rows, limit, 200, sort, shuffle, 3, kind, 4).collect():
        got.setdefault((r["shard"], r["batch_id"]), []).append(r["idx"])
    assert sorted(i for ids in got.values() for i in ids) == list(range(500))
    for ids in got.values():
        assert len(ids) == 1 or (len(ids) * max(sizes[i] for i in ids) if kind == "padded" else len(ids)) <= limit
    first = [sizes[i] for i in got[0, 0]]
    if sort and not shuffle:
        assert max(first) >= 40
    if not sort and not shuffle:
        assert sorted(got[0, 0]) == list(range(len(first)))


def test_loader(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.jsonl").write_text("".join(f'{{"input": "s{k} {i}"}}\n' for i in range(30)))
    paths = [str(tmp_path / f"{k}.jsonl") for k in range(2)]
    made = Loader(preprocessing=[R.prefix("input", "x "), R.none], task=lambda df: df.withColumn("token_ids", F.split("input", " ")), strategy="interleaved", batch_limit=4, skip=2, limit=22, max_length=2, world=2, rank=1)
    got = made.from_files(spark, paths).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(3, 22, 2)) and all(r["size"] == 2 and r["file_idx"] == 1 for r in got)
    assert made.set_epoch(1).build(S.read_jsonl(spark, paths)).first()["seed"] == got[0]["seed"] + 1
    assert made.set_fast_forward(4).items(S.read_jsonl(spark, paths)).count() == 8 and made.min_items(S.read_jsonl(spark, paths)) == 20
    (b,) = R.inference_batches(made.build(S.read_jsonl(spark, paths)).where("batch_id = 0"), "shard", "batch_id").collect()
    assert b["n_items"] == 4 and b["indices"] == [3, 5, 7, 9] and b["sizes"] == [2] * 4
    with pytest.raises(ValueError):
        Loader(shuffle=True)
    with pytest.raises(ValueError):
        Loader().from_files(spark, [])
    a, b = R.split_validation(spark.range(10).withColumnRenamed("id", "idx"), 3)
    assert a.count() == 3 and b.count() == 7


def test_micro_batches(spark, tmp_path):
    spark.createDataFrame([(i, "w " * (i % 9)) for i in range(100)], "item_idx bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_idx bigint, text string").parquet(str(tmp_path / "in")).withColumn("size", F.length("text"))
    sizes = []
    handle = lambda df, n: sizes.extend(r[0] for r in df.groupBy("shard", "batch_id").agg(F.count("*") * F.max("size")).collect())
    I.micro_batches(stream, 40, handle).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert len(sizes) > 5 and max(sizes) <= 40


def test_run_time_metrics(spark):
    df, seen = G.average_tracker(spark.range(5), "track", v=F.col("id"))
    df.collect()
    assert seen.get == {"v_mean": 2.0, "v_sum": 10}
    df, seen = G.progress(spark.createDataFrame([("é",), (None,)], "text string"), "p")
    df.collect()
    assert seen.get == {"items": 2, "bytes": 2}


def test_byte_groups_are_those_of_code_points(spark, tmp_path):
    from textloom.plans import catalogue

    rows = [(1, ""), (2, "a\r\nb"), (3, "éx"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["groups"] for r in catalogue.byte_groups(spark, str(tmp_path)).collect()}
    assert got == {1: "0", 2: "1,1,1,1", 3: "1,2,1", 4: None}  # as its SQL has it


def test_words_are_counted_where_a_document_lies(spark, tmp_path):
    from textloom.plans import catalogue

    rows = [(1, "a b a"), (1, "b　c"), (2, "a\x1fb"), (3, None), (4, " ")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    df = catalogue.count_words_whitespace(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, "a", 2), (1, "b", 2), (1, "c", 1), (2, "a\x1fb", 1)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "word" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_ranks_hold_few_whole_rows():
    assert R.INDEX_ROWS <= 100_000


def test_closest_measures_few_terms(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(3000)})
    measured, distances = [], D._distances
    monkeypatch.setattr(D, "_distances", lambda q, table: measured.append(len(table)) or distances(q, table))
    best = {}
    D._nearest([("x", terms[7][:-1] + "z")], pa.table({"term": terms, "freq": [1] * len(terms)}), False, best)
    assert best["x"][0] == 1.0 and sum(measured) < 300


def test_draws_of_misspelling_are_those_of_choice():
    import numpy as np

    contexts = {("a", "c"): [("x", 1.0), ("b", 2.5), ("y", 0.3)]}
    for seed in range(200):
        a, b = np.random.default_rng(seed), np.random.default_rng(seed)
        got, _ = R.edit_word("abc", a, contexts, ("replace",))
        i = int((b.integers(1), b.integers(3))[1])
        w = np.array([1.0, 0.3])
        assert got == ("abc" if i != 1 else "a" + "xy"[int(b.choice(2, p=w / w.sum()))] + "c")


def test_regroup_stream_keeps_open_items_of_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "BUCKETS", 1)
    schema = "item_idx bigint, n_windows int, window_idx int, output string"
    for rows in ([(1, 2, 1, "b"), (2, 1, 0, "x"), (3, 2, 0, "p")], [(1, 2, 0, "a")], [(3, 2, 0, "p"), (3, 2, 1, "q"), (4, 2, 0, "-")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    I.regroup_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "ab"), (2, "x"), (3, "pq")]


def test_draws_are_those_of_the_generator():
    import numpy as np

    for seed in range(50):
        a, b, choose = np.random.default_rng([seed, 13]), R.Draws(np.random.default_rng([seed, 13])), random.Random(seed)
        for _ in range(2000):
            kind, n = choose.randrange(3), choose.choice([1, 2, 3, 4, 7, 40, 150])
            if kind == 0:
                assert a.random() == b.random()
            elif kind == 1:
                assert int(a.integers(n)) == b.integers(n)
            else:
                assert int(a.binomial(n, 0.2)) == b.binomial(n, 0.2)
        p = choose.choice([0.4, 0.5, 0.9])
        u = np.random.default_rng(seed).random(100).tolist()
        c = np.random.default_rng(seed)
        assert [R._geometric(x, p) for x in u] == [int(c.geometric(p)) for _ in u]
