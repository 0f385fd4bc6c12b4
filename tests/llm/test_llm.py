"""The ten operators and the pipeline: brute force, round trips, held-out accuracy and awkward tables."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import _text, ann, bpe, chat, decontaminate, html, jaccard, langid, lm, setstore, tokenstore, toxicity

DOC = "doc_id bigint, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load()


AWKWARD = [(None, "null id text here"), (1, None), (2, ""), (3, "   \n"), (4, "!!! ???"), (5, "word " * 20000), (6, "same row"), (6, "same row"), (7, "ünï çödé 漢字 😀")]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns that clash with working names."""
    return spark.createDataFrame([(*r, "x", 1, "k") for r in AWKWARD], DOC + ", sid string, jaccard int, `group key` string")


def test_word_hashes_match_python():
    texts = pa.array(["Hello, World hello", None, "", "a b c d", "b c"])
    w, at = _text.word_hashes(_text.normalise(texts))
    assert np.diff(at).tolist() == [3, 0, 0, 4, 2] and w[0] == w[2] and w[0] != w[1] and (w[4:6] == w[7:9]).all()
    g, of = _text.gram_hashes(w, at, 3)
    assert of.tolist() == [0, 3, 3, 4]


# --- 1


def _recall(got, ids, x):
    hits = 0
    for q, found in got.items():
        d = ((x.astype(float) - x[ids.index(q)]) ** 2).sum(1)
        d[ids.index(q)] = np.inf
        hits += len({ids[j] for j in np.argsort(d, kind="stable")[:10]} & set(found))
    return hits / (10 * len(got))


@pytest.mark.parametrize("spread", [4, 0])  # with and without clusters
def test_neighbours_reach_recall(spark, spread, tmp_path):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(40, 16))[rng.integers(40, size=6000)] * spread + rng.normal(size=(6000, 16))).astype(np.float32)
    ids = [int(i) for i in rng.permutation(12_000)[:6000]]
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "leaf": pa.array(["x"] * 6000)}))
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["neighbour_ids"] for r in ann.op1_nearest_neighbours(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i in ids if i % 100 == 0} and all(len(n) == 10 for n in got.values())
    assert _recall(got, ids, x) >= 0.95
    got = {r["vec_id"]: r["neighbour_ids"] for r in ann.nearest_neighbours(df, every=3).collect()}
    assert set(got) == {i for i in ids if i % 3 == 0} and _recall(got, ids, x) >= 0.93


def test_tree_opens_children_only():
    rng = np.random.default_rng(3)
    tree = ann.Tree(np.concatenate([np.zeros((1, 2)), rng.normal(size=(12, 2))]).astype(np.float32), [[1, 2, 3], [4, 5, 6], [7, 8, 9], [10, 11, 12], *[[] for _ in range(9)]])
    q = np.array([[0.3, -0.2]], np.float32)
    (every,) = tree.visits(q, 9)
    assert sorted(every) == tree.leaves() and tree.visits(q, 2)[0] == every[:2]


def test_neighbours_of_awkward_rows(spark):
    rows = [(1, [0.0, 0.0], 1), (1, [5.0, 5.0], 2), (2, [0.0, 1.0], 3), (3, [5.0, 6.0], 4), (4, None, 5), (None, [1.0, 1.0], 6), (5, [1.0], 7), (6, [float("nan"), 1.0], 8), (7, [None, 1.0], 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, distances int")
    got = {r["vec_id"]: (r["neighbour_ids"], r["distances"]) for r in ann.nearest_neighbours(df, k=2, every=1).collect()}
    assert got[1] == ([2, 3], [1.0, 1.0]) and got[2][0] == [1, 3] and set(got) == {1, 2, 3}
    assert ann.nearest_neighbours(df).count() == 0
    assert ann.nearest_neighbours(df.where("false"), every=1).count() == 0
    assert ann.nearest_neighbours(df.where("vec_id = 2"), every=2).collect()[0]["neighbour_ids"] == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "vec_id bigint, embedding array<float>")
    assert all(r["neighbour_ids"] == [i for i in range(11) if i != r["vec_id"]][:10] for r in ann.nearest_neighbours(same, every=7).collect())


# --- 2


def test_bpe_equals_reference_tokenizer(vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", "'s", "it's we'll '' 'd", "aaaaaaaa", "<|endoftext|>"] + ["".join(rng.choice("abct'sdrevelm  \n\t12é漢😀.,!- ") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    ((ids, at),) = bpe.Encoder(vocabulary).encode([pa.array(texts)])
    for i, s in enumerate(texts):
        mine = ids[at[i] : at[i + 1]].tolist()
        assert mine == t.encode(s, add_special_tokens=False).ids and bpe.decode_ids(mine, vocabulary) == s


def test_bpe_rows(spark, awkward, vocabulary):
    out = bpe.encode_documents(awkward, vocabulary, check=True)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) and all(r["round_trip"] for r in rows)
    assert next(r for r in rows if r["doc_id"] == 1)["token_ids"] is None and next(r for r in rows if r["doc_id"] == 2)["token_ids"] == []
    back = collections.Counter((r["doc_id"], r["text"]) for r in bpe.decode_documents(out, vocabulary).collect())
    assert back == collections.Counter(AWKWARD)
    assert bpe.encode_documents(awkward.where("false"), vocabulary).count() == 0


# --- 3


def _kneser_ney(texts):
    """log10 probability of a text by an independent reckoning on strings."""
    seqs = [["<s>", "<s>", *t.lower().split(), "</s>"] for t in texts]
    tri = collections.Counter(tuple(q[i - 2 : i + 1]) for q in seqs for i in range(2, len(q)))
    front = collections.defaultdict(set)
    for a, b, c in tri:
        front[b, c].add(a)
    two = {g: len(a) if g[0] != "<s>" else tri["<s>", "<s>", g[1]] for g, a in front.items()}
    one = collections.Counter(g[1] for g in two)
    count = {3: {g: n for g, n in tri.items() if g[1] != "<s>"}, 2: two, 1: {(w,): n for w, n in one.items()}}
    cut = {}
    for k, c in count.items():
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        cut[k] = [min(max(x, 0.05), j - 0.05) for x, j in zip(d, (1, 2, 3))]

    def p(g):
        if not g:
            return 1 / (len(count[1]) + 1)
        k = len(g)
        same = [v for h, v in count[k].items() if h[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        take = lambda v: cut[k][min(v, 3) - 1] if v else 0
        c = count[k].get(g, 0)
        return (c - take(c)) / sum(same) + sum(map(take, same)) / sum(same) * p(g[1:])

    return lambda t: sum(math.log10(p(tuple(q[i - 2 : i + 1]))) for q in [["<s>", "<s>", *t.lower().split(), "</s>"]] for i in range(2, len(q)))


@pytest.mark.parametrize(("bucket", "flush"), [(lm.BUCKET_WORDS, lm.FLUSH_WORDS), (40, 12)])
def test_language_model_equals_brute_force(spark, monkeypatch, bucket, flush):
    monkeypatch.setattr(lm, "BUCKET_WORDS", bucket)  # many buckets, and words that are split over them
    monkeypatch.setattr(lm, "FLUSH_WORDS", flush)
    monkeypatch.setattr(lm, "LAYOUT_SHARE", 1)
    rng = random.Random(2)
    texts = ["the cat sat on the mat", "A cat, the cat!", "", "on the  mat\nthe dog sat", "the the the", *[" ".join(rng.choice("the a of cat dog sat mat on in by".split()) for _ in range(rng.randint(1, 40))) for _ in range(30)]]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], DOC)
    model = lm.train(docs)
    assert bucket > 1000 or (model.layout.buckets > 5 and len(model.layout.hot) > 2)
    want = _kneser_ney(texts)
    got = {r["doc_id"]: r for r in lm.perplexity(docs, model).collect()}
    assert got[99]["perplexity"] is None
    for i, t in enumerate(texts):
        assert abs(got[i]["log10_prob"] - want(t)) < 1e-9 and got[i]["n_words"] == len(t.split()) + 1
        assert abs(got[i]["perplexity"] - 10 ** (-want(t) / (len(t.split()) + 1))) < 1e-6
    new = ["zebra on the mat", "mat the on cat the zebra dog"]
    for r in lm.perplexity(spark.createDataFrame([*enumerate(new)], DOC), model).collect():
        assert abs(r["log10_prob"] - want(new[r["doc_id"]])) < 1e-9


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b b a", "c a b c"]
    docs = spark.createDataFrame([*enumerate(texts)], DOC)
    model = lm.train(docs)
    score = {t: 10 ** model.score(pa.array([t]))[0][0] for t in ("a b", "a b a", "a b b", "a b c")}
    want = _kneser_ney(texts)
    ends = sum(10 ** (want(f"a b {w}") - want("a b")) for w in "abc")
    assert ends > 0 and all(0 < p < 1 for p in score.values())


def test_arrays_of_many_values(tmp_path):
    rng = np.random.default_rng(1)
    prints = rng.choice(1 << 40, 30_000, replace=False).astype(np.uint64)
    values = np.stack([rng.integers(1, 2000, 30_000), rng.integers(0, 3, 30_000) << 40], 1)
    lm._write(str(tmp_path), "x", 0, prints, values)
    f = lm._File(f"{tmp_path}/x-0")
    got, found = f.find(np.concatenate([prints, prints ^ np.uint64(1)]))
    assert found[:30_000].all() and (got[:30_000] == values).all() and found[30_000:].sum() < 10
    lm._write(str(tmp_path), "y", 0, prints[:0], values[:0])
    assert not lm._File(f"{tmp_path}/y-0").find(prints)[1].any()


def test_language_model_of_awkward_rows(spark, awkward):
    rows = lm.perplexity(awkward, lm.train(awkward)).collect()
    want = _kneser_ney([t for _, t in AWKWARD if t is not None])
    assert len(rows) == len(AWKWARD)
    for r in rows:
        texts = [t for i, t in AWKWARD if i == r["doc_id"]]
        assert r["perplexity"] is None if texts[0] is None else abs(r["log10_prob"] - want(texts[0])) < 1e-6 * abs(want(texts[0]))
    empty = awkward.where("false")
    assert [r["log10_prob"] for r in lm.perplexity(awkward, lm.train(empty)).collect() if r["doc_id"] == 2] == [0.0]
    assert lm.perplexity(empty, lm.train(empty)).count() == 0


def test_op3_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat on the mat by the old red door"), (2, "mat on sat cat the the by door red old the")], DOC)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["log10_prob"] for r in lm.op3_lm_perplexity(spark, str(tmp_path)).collect()}
    want = _kneser_ney([r["text"] for r in docs.collect()])
    assert all(abs(got[r["doc_id"]] - want(r["text"])) < 1e-9 for r in docs.collect())
    scored = {r["doc_id"]: r["perplexity"] for r in lm.perplexity(docs, lm.train(docs.where("doc_id = 1"))).collect()}
    assert scored[2] > 1.5 * scored[1]  # scrambled order


# --- 4


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    bad = ["grumlo", "fneep", "zorkish"]
    rows = []
    for i in range(400):
        words = prose(rng, 60).split()
        toxic = i % 5 == 0
        for _ in range(rng.choice([2, 5, 12]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], DOC)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 300] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in rows if i >= 300) >= 99
    assert not any(got[i]["toxic"] for i, _, t in rows if not t)
    assert (np.diff(model.thresholds) > 0).all() and all(0 <= r["severity"] <= 3 for r in got.values())
    heavy = [got[i]["severity"] for i, t, y in rows if y and sum(t.count(b) for b in bad) >= 12]
    light = [got[i]["severity"] for i, t, y in rows if y and sum(t.count(b) for b in bad) <= 2]
    assert np.mean(heavy) > np.mean(light) + 0.5
    assert toxicity.drop_toxic(docs, model).count() == 320


def test_toxicity_from_few_labelled_rows(spark):
    root = "/root/testdata/sf0.001"
    bad = set("trash worthless pathetic idiot disgusting stupid clown scum loser moron".split())
    abusive = {r["doc_id"] for r in spark.read.parquet(f"{root}/documents.parquet").where("text IS NOT NULL").collect() if bad & set(_text.normalise(pa.array([r["text"]]))[0].as_py().split())}
    assert len(abusive) == 9
    assert {r["doc_id"] for r in toxicity.op4_toxicity(spark, root).collect() if r["toxic"]} == abusive


def test_op4_equals_a_sum_over_terms(spark, tmp_path):
    """The distributed scores against a plain reckoning of the fitted model."""
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))
    weight = dict(zip(model.terms.tolist(), model.weights.tolist()))
    got = {r["doc_id"]: r["severity"] for r in toxicity.op4_toxicity(spark, root).collect()}
    for r in docs.collect():
        hashes, _, _ = toxicity._terms(pa.array([r["text"]]))
        n = collections.Counter(h for h in hashes.tolist() if h in weight)
        score = sum(weight[h] * math.log1p(k) for h, k in n.items())
        assert abs(got[r["doc_id"]] - sum(1 / (1 + math.exp(min(30, max(-30, th - score)))) for th in model.thresholds)) < 1e-9


def test_toxicity_keeps_clashing_columns(spark, awkward):
    clash = awkward.withColumn("toxic", F.lit("t")).withColumn("severity", F.lit("s")).withColumn("grade", F.lit("g"))
    labels = spark.createDataFrame([(6, 1, "a"), (2, 0, "b")], "doc_id bigint, toxic int, text string")
    model = toxicity.fit(clash, labels)
    assert toxicity.drop_toxic(clash, model).columns == clash.columns
    assert toxicity.score_toxicity(clash, model).columns == ["doc_id", "severity", "grade", "toxic"]


def test_toxicity_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(6, 1), (2, 0), (None, 1)], "doc_id bigint, toxic int")
    for given in (labels, labels.where("false")):
        model = toxicity.fit(awkward, given)
        assert not any(r["toxic"] for r in toxicity.score_toxicity(awkward, model).collect())
        assert toxicity.drop_toxic(awkward, model).columns == awkward.columns
    assert toxicity.score_toxicity(awkward.where("false"), model).count() == 0


def test_ordinal_gradient():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 200)
    row, term = np.arange(200), np.zeros(200, np.int64)
    w, theta = toxicity._fit((row, term, y + rng.normal(0, 0.7, 200)), y, 1)
    assert w[0] > 1 and (np.diff(theta) > 0).all()


# --- 5


def test_perfect_hash():
    keys = np.random.default_rng(3).choice(1 << 60, 5000, replace=False).astype(np.uint64)
    h = tokenstore.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(5000))
    with pytest.raises(ValueError):
        tokenstore.PerfectHash.build(np.array([1, 1], np.uint64))


def test_store_of_repeated_ids(spark, vocabulary):
    rows = [(1, "one two three four"), (1, "one"), (2, "red fox"), (2, "blue sky"), (3, ""), (3, None), (4, "word " * 30_000)]
    store = tokenstore.write_store(spark.createDataFrame([(*r, "k") for r in rows], DOC + ", found string"), vocabulary)
    asked = spark.createDataFrame([(i, "x") for i in range(1, 6)], "doc_id bigint, shard string")
    got = {r["doc_id"]: r for r in tokenstore.lookup(asked, store, with_ids=True).collect()}
    assert bpe.decode_ids(got[1]["token_ids"], vocabulary) == rows[0][1] and got[3]["n_tokens"] == 0 and not got[5]["found"]
    assert bpe.decode_ids(got[4]["token_ids"], vocabulary) == rows[6][1]
    # of payloads as long the one of the least checksum
    import xxhash

    raw = {t: np.array(bpe.Encoder(vocabulary).encode([pa.array([t])])[0][0]).astype(np.uint16).tobytes() for t in ("red fox", "blue sky")}
    assert len({len(x) for x in raw.values()}) == 1
    best = min(raw, key=lambda t: xxhash.xxh64_intdigest(raw[t]) >> 1)
    assert bpe.decode_ids(got[2]["token_ids"], vocabulary) == best


def test_op5_and_op2_queries(spark, awkward, vocabulary, tmp_path):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    got = tokenstore.op5_token_store(spark, str(tmp_path)).collect()
    assert len(got) == len(AWKWARD) and all(r["found"] == (r["doc_id"] is not None) for r in got)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    want = collections.Counter((i, None if x is None else tuple(t.encode(x, add_special_tokens=False).ids)) for i, x in AWKWARD)
    rows = bpe.op2_bpe(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], None if r["token_ids"] is None else tuple(r["token_ids"])) for r in rows) == want and all(r["round_trip"] for r in rows)


def test_store_round_trip(spark, awkward, vocabulary, monkeypatch):
    monkeypatch.setattr(tokenstore, "SHARD_KEYS", 3)
    store = tokenstore.write_store(awkward, vocabulary)
    assert store.shards == 3
    asked = spark.createDataFrame([(i,) for i in (None, 1, 2, 5, 6, 6, 7, 99, -1)], "doc_id bigint")
    got = tokenstore.lookup(asked, store, with_ids=True).collect()
    assert len(got) == 9
    for r in got:
        texts = [t or "" for i, t in AWKWARD if i is not None and i == r["doc_id"]]
        assert r["found"] == bool(texts)
        if texts:
            assert bpe.decode_ids(r["token_ids"], vocabulary) == texts[0] and r["n_tokens"] == len(r["token_ids"])
    nothing = tokenstore.write_store(awkward.where("false"), vocabulary)
    assert not any(r["found"] for r in tokenstore.lookup(asked, nothing).collect())


# --- 6


def _brute_pairs(rows, n=3, t=0.6):
    import regex

    sets = []
    for _, text in rows:
        w = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and len(a & b) >= t * len(a | b) - 1e-9}


def near_rows(seed=8):
    rng = random.Random(seed)
    shared = prose(rng, 60)
    rows = []
    for c in range(30):
        base = prose(rng, rng.choice([1, 2, 3, 20, 100])).split()
        if c % 3 == 0:
            base += shared.split()
        for v in range(rng.choice([1, 1, 2, 8])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                words[rng.randrange(len(words))] = prose(rng, 1)
            rows.append((len(rows), " ".join(words)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "?!")]


def _brute_classes(rows, t=0.6):
    """(class, links) of every row."""
    pairs = _brute_pairs(rows, t=t)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
        links[a], links[b] = links[a] + 1, links[b] + 1
    return [(rows[find(i)][0], links[i]) for i in range(len(rows))]


def group_rows():
    """Texts with a rare part of their cluster and a frequent ending, so that sets of a cluster agree in size and prefix; copies among them."""
    rng = random.Random(21)
    endings = ["and so on " + prose(rng, 30) for _ in range(8)]
    rows = []
    for _ in range(12):
        rare = prose(rng, 60)
        for e in rng.sample(endings, 5):
            rows.append((len(rows), f"{rare} {e}"))
    return rows + [(len(rows), rows[5][1]), (len(rows) + 1, rows[5][1]), (len(rows) + 2, prose(rng, 90))]


@pytest.mark.parametrize(("make", "t"), [(near_rows, 0.6), (group_rows, 0.6), (group_rows, 0.5), (near_rows, 0.2)])
def test_join_equals_brute_force(spark, monkeypatch, make, t):
    monkeypatch.setattr(jaccard, "BUCKET_GRAMS", 500)
    monkeypatch.setattr(jaccard, "_PAIR_CHUNK", 50)
    monkeypatch.setattr(jaccard, "TASK_PAIRS", 1000)
    rows = make()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOC).coalesce(1), t=t).collect()}
    assert got == {r[0]: c for r, c in zip(rows, _brute_classes(rows, t))}


def test_sets_of_one_group_are_met(spark):
    found = jaccard.NearPairs(spark.createDataFrame(group_rows(), DOC).coalesce(1), t=0.6)
    groups = found.sets.groupBy("group_a", "group_b").count().where("count > 1").collect()
    assert len(groups) > 8 and max(r["count"] for r in groups) > 2
    assert found.pairs.count() == found.pairs.select("a", "b").distinct().count()


def test_one_of_each_group_stays(spark):
    rows = near_rows(9)
    kept = sorted(r["doc_id"] for r in jaccard.drop_near_duplicates(spark.createDataFrame(rows, DOC)).collect())
    assert kept == sorted({c for c, _ in _brute_classes(rows)})


def test_join_of_awkward_rows(spark, awkward):
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(awkward).collect()), key=repr)
    assert got == sorted([(i, i, 1 if i == 6 else 0) for i, _ in AWKWARD], key=repr)
    clash = awkward.withColumn("key", F.lit(1)).withColumn("__KEY", F.lit(2)).withColumn("sid", F.lit("z"))
    kept = jaccard.drop_near_duplicates(clash)
    assert kept.columns == clash.columns and kept.count() == len(AWKWARD) - 1
    empty = awkward.where("false")
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.drop_near_duplicates(empty).count() == 0


def test_op6_query(spark, tmp_path):
    rows = near_rows(3)
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.op6_jaccard_join(spark, str(tmp_path)).collect()}
    assert got == {r[0]: c for r, c in zip(rows, _brute_classes(rows))}


def cluster_rows(m):
    """One cluster of m near copies, some twice, others at the edge of it, and unlike texts."""
    rng = random.Random(31)
    base = prose(rng, 120).split()
    changed = lambda share: " ".join(f"x{rng.randrange(60)}" if rng.random() < share else w for w in base)
    texts = [changed(0.03) for _ in range(m)] + [changed(0.12) for _ in range(m // 10)] + [prose(rng, 60) for _ in range(20)]
    return list(enumerate(texts + texts[:5]))


@pytest.fixture
def verified(monkeypatch):
    """The number of pairs of each verification."""
    counts, verify = [], jaccard.NearPairs._verify
    monkeypatch.setattr(jaccard.NearPairs, "_verify", lambda self, pairs: counts.append(pairs.count()) or verify(self, pairs))
    return counts


def test_large_cluster_is_not_verified_pair_by_pair(spark, monkeypatch, verified):
    rows = cluster_rows(300)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 64)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOC).coalesce(1)).collect()}
    want = _brute_classes(rows)
    assert got == {r[0]: c for r, c in zip(rows, want)}
    # about 45,000 links between different texts
    assert sum(n for _, n in want) > 80_000 and sum(verified) < 20 * len(rows)


def test_link_counts_by_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    base, more = rng.integers(0, 1 << 40, 60, np.uint64), rng.integers(0, 1 << 40, 60, np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.9], rng.choice(more, 25)])) for _ in range(70)]
    rows = rng.integers(1, 5, len(sets)).tolist()

    class Sets:
        def grams(self, sid):
            return sets[sid]

    def brute(a, b):
        alike = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.6
        return [sum(rows[j] for j in b if i != j and alike(sets[i], sets[j])) for i in a]

    monkeypatch.setattr(jaccard, "_CELLS", 300)
    for a, b in ((range(40), range(40, 70)), (range(2), range(2, 5)), (range(1), range(1, 60))):
        x, y = jaccard._linked(Sets(), list(a), [rows[i] for i in a], list(b), [rows[i] for i in b], 0.6)
        assert x.tolist() == brute(a, b) and y.tolist() == brute(b, a)
        assert jaccard._linked(Sets(), list(b), [rows[i] for i in b], None, None, 0.6)[0].tolist() == brute(b, b)


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 41)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30, 40: 40, 41: 40}


# --- 7


def leak_rows():
    rng = random.Random(10)
    bench = [(i, prose(rng, 20)) for i in range(5)] + [(9, "too short"), (10, None)]
    clean = prose(rng, 80)
    return bench, [(0, clean), (1, clean + " -- " + bench[0][1].upper() + "! " + clean), (2, bench[1][1]), (3, None), (4, ""), (None, "a " + bench[2][1] + " " + clean), (5, clean), (5, clean)]


def test_decontamination(spark, monkeypatch):
    bench, rows = leak_rows()
    b, d = spark.createDataFrame(bench, "item_id bigint, text string"), spark.createDataFrame(rows, DOC).withColumn("n_chars", F.length("text").cast("bigint"))
    report = {r["doc_id"]: r for r in decontaminate.contamination_report(d, b).collect()}
    assert set(report) == {1, 2, None} and report[2]["action"] == "drop" and report[1]["action"] == "cut"
    assert report[1]["spans"] == "80-100" and report[1]["hit_windows"] == 13
    out = decontaminate.decontaminate(d, b)
    kept = {r["doc_id"]: r for r in out.collect()}
    assert set(kept) == {0, 1, 3, 4, 5, None} and out.count() == 7
    assert bench[0][1].upper() not in kept[1]["text"] and kept[1]["text"].count(rows[0][1]) == 2 and kept[1]["n_chars"] == len(kept[1]["text"])
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    key = lambda r: repr(r)
    assert sorted(map(key, decontaminate.contamination_report(d, b).collect())) == sorted(map(key, report.values()))
    assert sorted(map(key, decontaminate.decontaminate(d, b).collect())) == sorted(map(key, out.collect()))


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_of_awkward_rows(spark, awkward, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(decontaminate, "SHARD_GRAMS", 2)
    b = spark.createDataFrame([(1, "word " * 12), (2, prose(random.Random(3), 40)), (3, None), (4, ""), (5, "too short")], "item_id bigint, text string")
    clash = awkward.withColumn("__starts", F.lit(1)).withColumn("starts", F.lit(2)).withColumn("n_chars", F.lit("many")).withColumn("key", F.lit(0))
    out = decontaminate.decontaminate(clash, b)
    assert out.columns == clash.columns and out.count() == len(AWKWARD) - 1
    leak = spark.createDataFrame([(1, prose(random.Random(4), 20000) + " " + prose(random.Random(3), 40), "x")], DOC + ", n_chars string")
    (r,) = decontaminate.decontaminate(leak, b).collect()
    assert r["text"].strip() == prose(random.Random(4), 20000) and r["n_chars"] == "x"
    assert decontaminate.decontaminate(awkward, b.where("false")).count() == len(AWKWARD)
    assert decontaminate.decontaminate(awkward.where("false"), b).count() == 0
    assert decontaminate.contamination_report(awkward.where("false"), b.where("false")).count() == 0


def test_equal_hashes_are_told_apart():
    grams = [f"a{i} b c d e f g h" for i in range(5)]
    part = decontaminate._Part.of(grams, 8)
    part.hashes = np.full(5, 7, np.uint64)
    assert part.has(0, np.uint64(7), grams[3].encode()) and not part.has(0, np.uint64(7), b"z b c d e f g h")


# --- 8


def test_language_on_held_out_rows(spark):
    rng = random.Random(11)
    sound = {"aa": ["ka", "lo", "mi"], "bb": ["str", "ung", "sch"], "cc": ["eau", "ou", "ille"]}
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, text(s), n) for i, (n, s) in enumerate(list(sound.items()) * 60)]
    docs = spark.createDataFrame(rows, DOC + ", lang string")
    model = langid.fit(docs.where("doc_id < 120"))
    got = {r["doc_id"]: r for r in langid.identify_language(docs, model).collect()}
    held = [r for r in rows if r[0] >= 120]
    assert sum(got[i]["predicted"] == n for i, _, n in held) / len(held) > 0.97 and sum(got[i]["rejected"] for i, _, _ in held) <= 1
    odd = spark.createDataFrame([(0, "1234 5678 9012"), (1, None), (2, ""), (3, "???")], DOC)
    assert all(r["rejected"] for r in langid.identify_language(odd, model).collect())
    assert langid.keep_identified(docs, model).columns == docs.columns


def test_language_of_awkward_rows(spark, awkward):
    clash = awkward.withColumn("confidence", F.lit("z")).withColumn("predicted", F.lit(1))
    none = langid.fit(awkward.withColumn("lang", F.lit(None).cast("string")))
    one = langid.fit(clash.withColumn("lang", F.lit("xx")))
    assert langid.keep_identified(clash, one).columns == clash.columns
    got = langid.identify_language(clash, one).collect()
    assert len(got) == len(AWKWARD) and [r["rejected"] for r in got if r["doc_id"] in (1, 2, 3, 4)] == [True] * 4
    assert all(r["rejected"] for r in langid.identify_language(awkward, none).collect())
    assert langid.identify_language(awkward.where("false"), none).count() == 0


def test_language_rejects_texts_in_no_language(spark):
    root = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(4)
    odd = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.randint(2, 9))) for _ in range(40))) for i in range(200)]
    assert sum(r["rejected"] for r in langid.identify_language(spark.createDataFrame(odd, DOC), model).collect()) >= 190
    found = langid.identify_language(docs.where("lang IS NOT NULL AND text IS NOT NULL"), model).agg(F.mean(F.col("rejected").cast("double"))).first()[0]
    assert found < 0.01


# --- 9


def test_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|>"), (1, 3, "ann", None), (2, None, None, "x"), (2, None, None, "x"), (None, 1, "ann", "lost"), (3, 0, "system", "alone")]
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotate_perspectives(spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, said int")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown")}
    for r in got.values():
        assert sum(map(abs, r["mask_runs"])) == len(r["text"])
    r, at, seen = got[1, "ann"], 0, []
    for n in r["mask_runs"]:
        if n > 0:
            seen.append(r["text"][at : at + n])
        at += abs(n)
    assert seen == ["hi<|im_end|>\n", "<|im_end|>\n"] and "user name=bob\n< |im_end|>" in r["text"]
    assert got[2, "unknown"]["n_turns"] == 2


def test_perspectives_of_awkward_tables(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, speaker int, said string"
    assert chat.rotate_perspectives(spark.createDataFrame([], kind)).count() == 0
    long = "word " * 100_000
    rows = [(1, 1, "ann", long, 5, "q"), (1, 1, "ann", long, 5, "q"), (1, 1, "bob", "", 5, "q"), (1, 1, " \n ", "who", 5, "q")]
    got = {r["speaker"]: r for r in chat.rotate_perspectives(spark.createDataFrame(rows, kind)).collect()}
    assert set(got) == {"ann", "bob", "unknown"} and all(r["n_turns"] == 4 for r in got.values()) and got["ann"]["n_trained"] == 2
    # ties in turn go by role, then text
    assert got["bob"]["text"].index("name=ann") < got["bob"]["text"].index("assistant") < got["bob"]["text"].index("name=unknown")
    for r in got.values():
        assert sum(map(abs, r["mask_runs"])) == len(r["text"])


# --- 10


def test_head_and_body_tags_left_out():
    prose_text = "a long paragraph of text that is the content of the page " * 5
    for page in (f"<head><title>x</title><p>{prose_text}", f"<html><head><meta charset=utf-8><title>x</title><div>{prose_text}</div></html>"):
        text, _, _ = html.extract(page)
        assert text.split() == prose_text.split()


def test_html(spark):
    para = "Here is a long paragraph of real content that goes on for quite a while, sentence after sentence. " * 3
    nav = "<nav><ul>" + "".join(f'<li><a href="/{i}">Link{i}</a></li>' for i in range(30)) + "</ul></nav>"
    page = f"<html><head><title>T</title><script>var x='<p>no</p>';</script></head><body>{nav}<article><h1>Head</h1><p>{para}<p>{para}</p></article><footer>{nav}</footer></body></html>"
    text, regions, lines = html.extract(page)
    assert text.count("real content") == 6 and "Link15" not in text and "var x" not in text and regions == 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "plain words"), (None, "<p>unclosed <b>bold"), (4, "<" * 500), (4, "<" * 500)], "page_id bigint, html string")
    got = {r["page_id"]: r for r in html.extract_pages(odd).collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and got[3]["text"] == "plain words" and got[None]["text"] == "unclosed bold"
    ratio = html.smooth(np.array([0.0, 0, 9, 0, 0]))
    assert ratio.argmax() == 2 and ratio[1] > 0


def test_pages_that_do_not_parse(spark):
    for page in ("<![foo[ x ]]>", "<![^x", "<!DOCTYPE", "<!", "<![CDATA[", "<!--", "&#xZZ;", "<p" * 50, "<![if x]>a<![endif]>"):
        html.extract(page)
    assert html.extract("<p>one two three</p><![foo[ x ]]><p>four</p>")[0].split() == ["one", "two", "three", "four"]
    long = "<div>" + "<p>some words of a long page</p>" * 60_000
    pages = spark.createDataFrame([(1, "<![foo[ x ]]>", "k"), (2, long, "k")], "page_id bigint, html string, text string")
    got = {r["page_id"]: r for r in html.extract_pages(pages).collect()}
    assert got[1]["text"] == "" and got[2]["n_lines"] == 60_000 and got[2]["text"].count("words") == 60_000
    assert html.extract_pages(pages.where("false")).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    bench, leaks = leak_rows()
    rows = [(i, prose(rng, 60), "en", "s", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " extra", "en", "s", 0), (102, prose(rng, 50) + " " + bench[0][1], "en", "s", 0), (103, bench[1][1], "en", "s", 0), (104, "?!", "en", "s", 0)]
    spark.createDataFrame(rows, DOC + ", lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "near_duplicates", "decontamination", "bpe_encoding"]
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [*range(60), 102] and all(r["round_trip"] for r in out)
    assert bench[0][1] not in bpe.decode_ids(next(r for r in out if r["doc_id"] == 102)["token_ids"], bpe.Vocabulary.load())


def test_near_duplicate_stage_does_not_verify_a_cluster_pair_by_pair(spark, verified):
    import corpus_pipeline as P

    rows = cluster_rows(250)
    kept = P.near_duplicate_stage(spark, spark.createDataFrame(rows, DOC), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in _brute_classes(rows)})
    # about 31,000 links between different texts
    assert sum(verified) < 20 * len(rows)


def test_near_duplicate_stage_makes_each_text_a_set_once(spark, monkeypatch, tmp_path):
    import corpus_pipeline as P

    made, sets = tmp_path / "made", jaccard._sets

    def counted(texts, n):
        with open(made, "a") as f:
            f.write(f"{len(texts)}\n")
        return sets(texts, n)

    monkeypatch.setattr(jaccard, "_sets", counted)
    monkeypatch.setattr(jaccard, "RAW_GRAMS", 300)
    # wordless texts among the others
    rows = [row for i, t in near_rows(9) for row in ((i, t), (1000 + i, "?!"))]
    kept = P.near_duplicate_stage(spark, spark.createDataFrame(rows, DOC).coalesce(2), "").collect()
    want = sorted({c for c, _ in _brute_classes(near_rows(9))} | {i for i, t in rows if t == "?!"})
    assert sorted(r["doc_id"] for r in kept) == want
    assert sum(map(int, made.read_text().split())) == len(rows)
    # an id repeated with one gram set
    rows += [(-1, "One Text In Two Spellings"), (-1, "one text in two spellings")]
    kept = P.near_duplicate_stage(spark, spark.createDataFrame(rows, DOC).coalesce(2), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [-1, *want]


def test_bitmaps_read_at_once_are_those_of_each_set(tmp_path):
    rng = np.random.default_rng(8)
    sets = [rng.integers(0, 1 << 48, n, np.uint64) for n in (1, 3, 200, 200, 700, 5, 130, 9000)]
    sids = []
    for number in (0, 5):
        raw = b""
        for grams in sets:
            sids.append(number << setstore.OFFSET_BITS | len(raw))
            raw += setstore.record(grams)
        (tmp_path / f"sets-{number}").write_bytes(raw)
    got = setstore.Reader(str(tmp_path)).bitmaps(np.array(sids), np.array([len(g) for g in sets * 2]), 512)
    for grams, row in zip(sets * 2, got):
        bits = np.bincount((grams & np.uint64(511)).astype(int), minlength=512) & 1
        assert np.unpackbits(row.view(np.uint8), bitorder="little").tolist() == bits.tolist()


def test_pipeline_of_awkward_tables(spark, awkward, tmp_path):
    import corpus_pipeline as P

    table = awkward.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("bigint"), "toxic": F.lit("x"), "key": F.lit(1)})
    labels = spark.createDataFrame([(6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string")
    for name, docs in (("full", table), ("empty", table.where("false"))):
        root = str(tmp_path / name)
        docs.write.parquet(f"{root}/documents.parquet")
        labels.write.parquet(f"{root}/labels.parquet")
        bench.write.parquet(f"{root}/benchmark.parquet")
        kept = docs
        for k, (_, stage) in enumerate(P.STAGES[:-1]):
            kept = stage(spark, kept, root)
            assert kept.columns == docs.columns
            kept.write.parquet(f"{root}/{k}")
            kept = spark.read.parquet(f"{root}/{k}")
        out = P.STAGES[-1][1](spark, kept, root).collect()
        ids = [r["doc_id"] for r in out]
        # null and wordless texts are in no language; one of the repeated rows stays
        assert sorted(ids, key=repr) == (sorted([None, 5, 6, 7], key=repr) if name == "full" else [])
        assert sorted(map(repr, P.run(spark, root).collect())) == sorted(map(repr, out))


def test_pipeline_equals_brute_force(spark):
    """All stages at sf0.001 against plain Python on the models that they fit."""
    import corpus_pipeline as P

    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))
    rows = {i: t for i, t in rows.items() if model.exceed(pa.array([t]))[0, 0] < model.cut}
    left = docs.where(F.col("doc_id").isin(list(rows)))
    known = langid.fit(left)
    rows = {i: t for i, t in rows.items() if not known.predict(pa.array([t]))[2][0]}
    ordered = sorted(rows.items())
    rows = {i: rows[i] for i in {c for c, _ in _brute_classes(ordered)}}
    tests = set()
    for r in spark.read.parquet(f"{root}/benchmark.parquet").collect():
        w = _text.normalise(pa.array([r["text"]]))[0].as_py().split(" ")
        tests |= {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    want = {}
    for i, t in rows.items():
        words = [m.group() for m in decontaminate._WORD.finditer(t.lower())]
        hit = set()
        for k in range(len(words) - 7):
            if tuple(words[k : k + 8]) in tests:
                hit |= set(range(k, k + 8))
        if len(hit) < 0.5 * len(words) or not hit:
            want[i] = " ".join(w for k, w in enumerate(words) if k not in hit)
    vocabulary = bpe.Vocabulary.load()
    got = {r["doc_id"]: " ".join(m.group() for m in decontaminate._WORD.finditer(bpe.decode_ids(r["token_ids"], vocabulary).lower())) for r in P.run(spark, root).collect()}
    assert got == want
