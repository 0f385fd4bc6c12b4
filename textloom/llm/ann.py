"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is built level by level over all vectors (Lloyd steps as distributed
sums).  A query goes through it best bin first: a priority queue holds nodes
by the distance of their centroid, the nearest is opened (only then are its
children's distances taken), leaves are visited as they come up.  The number
of visits is widened until the recall measured on a calibration sample of the
queries (against brute force over all vectors) reaches the target.  Queries
are the vectors whose id is divisible by ``QUERY_EVERY``, candidates are all;
leaf members and the queries that visit them meet in one shuffle keyed by leaf.

The number of leaves grows with the square root of the number of vectors, so
the tree that is broadcast stays small, and members of a large leaf (equal
vectors, say) are spread over parts that all its queries visit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _memory, _store

K = 10
RECALL = 0.96
QUERY_EVERY = 100
BRANCH = 16
#: Queries whose true neighbours are computed for calibration, about.  All vectors are candidates.
CALIBRATION_QUERIES = 400
LLOYD_STEPS = 4
#: Least leaf size worth splitting.
LEAF_ROWS = 256
#: Vectors of a leaf that are held together; larger leaves are searched in parts.
PART_ROWS = 50_000
_SEEDS = 64


@dataclass
class Tree:
    """Centroids of all nodes but the root (number 0); leaves have no children."""

    centroids: np.ndarray  # row 0 unused
    children: list[list[int]] = field(default_factory=lambda: [[]])

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if not c]

    def assign(self, x: np.ndarray, depth: int | None = None) -> np.ndarray:
        """The leaf of each vector: at every node the nearest child."""
        node = np.zeros(len(x), np.int64)
        for _ in range(depth if depth is not None else len(self.children)):
            moved = False
            for n in np.unique(node).tolist():
                if kids := self.children[n]:
                    own = np.flatnonzero(node == n)
                    node[own] = np.array(kids)[_sq(x[own], self.centroids[kids]).argmin(1)]
                    moved = True
            if not moved:
                break
        return node

    def visits(self, x: np.ndarray, most: int) -> list[list[int]]:
        """For each vector its first ``most`` leaves, best bin first."""
        out = []
        for q in x:
            queue, found = [(0.0, 0)], []
            while queue and len(found) < most:
                _, node = heapq.heappop(queue)
                kids = self.children[node]
                if not kids:
                    found.append(node)
                    continue
                for d, c in zip(_sq(q[None, :], self.centroids[kids])[0].tolist(), kids):
                    heapq.heappush(queue, (d, c))
            out.append(found)
        return out


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def clean_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, embedding`` of usable rows and their dimension.

    Unusable: a null id, a null embedding, one with null, NaN or infinite
    numbers, or one whose length isn't the most frequent (ties: the longer).
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.where(F.expr("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf'))") & (F.size("embedding") > 0))
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = top["d"] if top else 1
    return rows.where(F.size("embedding") == dim), dim


def build(rows: DataFrame, dim: int, branch: int = BRANCH) -> Tree:
    """Split nodes larger than the leaf size into ``branch`` children until none is left that k-means can split."""
    spark = rows.sparkSession
    n = rows.count()
    leaf = max(LEAF_ROWS, int(8 * np.sqrt(n)))
    tree = Tree(np.zeros((1, dim), np.float32))
    open_nodes = {0: n}
    level = 0
    while open_nodes := {k: v for k, v in open_nodes.items() if v > leaf}:
        level += 1
        shared = spark.sparkContext.broadcast(tree)
        held = sum(open_nodes.values())
        wanted = np.array(sorted(open_nodes))
        share = min(1.0, 4.0 * _SEEDS * len(wanted) / held)

        def seeds(batches: Iterator[pa.RecordBatch], shared=shared, wanted=wanted) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node = shared.value.assign(_matrix(b.column("embedding"), dim))
                yield pa.RecordBatch.from_arrays([pa.array(node), b.column("embedding")], ["node", "embedding"]).filter(pa.array(np.isin(node, wanted)))

        picked = rows.where(F.pmod(F.xxhash64(F.lit(level), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).mapInArrow(seeds, "node bigint, embedding array<float>").toArrow()
        node_of, vec = picked.column("node").to_numpy(), _matrix(picked.column("embedding").combine_chunks(), dim)
        fresh: dict[int, np.ndarray] = {}
        for k in wanted.tolist():
            found = np.unique(vec[node_of == k], axis=0)
            if len(found) > 1:
                fresh[k] = _spread(found, min(branch, -(-2 * open_nodes[k] // leaf), len(found)), np.random.default_rng(k))
        if not fresh:
            break  # what is left are equal vectors
        sizes: dict[int, np.ndarray] = {}
        for _ in range(LLOYD_STEPS):
            given = spark.sparkContext.broadcast(fresh)

            def sums(batches: Iterator[pa.RecordBatch], shared=shared, given=given) -> Iterator[pa.RecordBatch]:
                acc: dict[tuple[int, int], np.ndarray] = {}
                for b in batches:
                    x = _matrix(b.column("embedding"), dim)
                    node = shared.value.assign(x)
                    for k in np.unique(node).tolist():
                        if k in given.value:
                            own = x[node == k]
                            at = _sq(own, given.value[k]).argmin(1)
                            for c in np.unique(at).tolist():
                                part = own[at == c]
                                acc[k, c] = acc.get((k, c), 0) + np.concatenate([[len(part)], part.sum(0, dtype=np.float64)])
                if acc:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in acc], pa.int64()), pa.array([c for _, c in acc], pa.int32()), pa.array([v.tobytes() for v in acc.values()], pa.binary())], ["node", "child", "sums"])

            def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                acc: dict[tuple[int, int], np.ndarray] = {}
                for b in batches:
                    for k, c, v in zip(*(b.column(i).to_pylist() for i in range(3))):
                        acc[k, c] = acc.get((k, c), 0) + np.frombuffer(v, np.float64)
                if acc:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in acc], pa.int64()), pa.array([c for _, c in acc], pa.int32()), pa.array([v.tobytes() for v in acc.values()], pa.binary())], ["node", "child", "sums"])

            kind = "node bigint, child int, sums binary"
            added = [(r["node"], r["child"], np.frombuffer(r["sums"], np.float64)) for r in rows.mapInArrow(sums, kind).repartition("node").mapInArrow(total, kind).collect()]
            fresh, sizes = {}, {}
            for k in {k for k, _, _ in added}:
                parts = sorted(((c, v) for n, c, v in added if n == k), key=lambda x: x[0])
                fresh[k] = np.stack([v[1:] / v[0] for _, v in parts]).astype(np.float32)
                sizes[k] = np.array([v[0] for _, v in parts])
        open_nodes = {}
        for k in sorted(fresh):
            if len(fresh[k]) < 2:
                continue
            start = len(tree.children)
            tree.children[k] = list(range(start, start + len(fresh[k])))
            tree.children += [[] for _ in fresh[k]]
            tree.centroids = np.concatenate([tree.centroids, fresh[k]])
            # sizes of the last step but one's centroids: near enough to decide on splitting
            open_nodes |= {start + i: int(s) for i, s in enumerate(sizes[k])}
        if level > 30:
            break
    return tree


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeding."""
    out = [x[rng.integers(len(x))]]
    d = _sq(x, out[0][None, :])[:, 0]
    while len(out) < k and d.sum() > 0:
        out.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, _sq(x, out[-1][None, :])[:, 0])
    return np.stack(out)


def _top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """For each query its k nearest ids other than its own, ties by id; an id with several vectors counts by the nearest."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order].astype(np.float64)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    names = ids[first]
    for i in range(0, len(queries), 256):
        q, own = queries[i : i + 256].astype(np.float64), query_ids[i : i + 256]
        d = _sq(q, vectors)
        if len(names) < len(ids):
            d = np.minimum.reduceat(d, first, axis=1)
        d[names[None, :] == own[:, None]] = np.inf
        m = min(k + 4, len(names))  # a few more, as rounding may swap the last ones
        near = np.argpartition(d, m - 1, axis=1)[:, :m] if m < len(names) else np.tile(np.arange(len(names)), (len(q), 1))
        if m < len(names):  # where more than m are as near, those of the least ids count
            edge = np.take_along_axis(d, near, 1).max(1)
            slack = 1e-9 * (1 + (q * q).sum(1))
            for j in np.flatnonzero(np.isfinite(edge) & ((d <= (edge + slack)[:, None]).sum(1) > m)).tolist():
                nearer, tied = np.flatnonzero(d[j] < edge[j] - slack[j]), np.flatnonzero(np.abs(d[j] - edge[j]) <= slack[j])
                near[j] = np.concatenate([nearer, tied[:m]])[:m]
        exact = np.take_along_axis(d, near, 1)
        gone = np.isinf(exact)
        if len(names) == len(ids):
            exact = ((vectors[near] - q[:, None, :]) ** 2).sum(2)
        else:
            exact = np.where(exact < 1e-9 * ((q * q).sum(1)[:, None] + 1), 0, exact)
        exact[gone] = np.inf
        pick = np.lexsort((names[near], exact), axis=1)[:, :k]
        exact, near = np.take_along_axis(exact, pick, 1), names[np.take_along_axis(near, pick, 1)]
        good = np.isfinite(exact)
        at = pa.array(np.concatenate([[0], np.cumsum(good.sum(1))]).astype(np.int32), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.ListArray.from_arrays(at, pa.array(near[good])), pa.ListArray.from_arrays(at, pa.array(np.sqrt(exact[good])))], ["vec_id", "ids", "distances"])


_FOUND = "vec_id bigint, ids array<bigint>, distances array<double>"


def _found(rows: list[tuple[int, list[int], list[float]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["vec_id", "ids", "distances"])


def brute_force(rows: DataFrame, dim: int, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Exact neighbours of a few broadcast queries among all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _top(*shared.value, b.column("vec_id").to_numpy(), _matrix(b.column("embedding"), dim), k)

    return _merge(rows.mapInArrow(_memory.lean(run), _FOUND), k)


def _merge(partial: DataFrame, k: int) -> DataFrame:
    """``vec_id, neighbour_ids, distances`` from partial lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for q, ids, dist in zip(b.column("vec_id").to_pylist(), b.column("ids").to_pylist(), b.column("distances").to_pylist()):
                best: dict[int, float] = {}
                for d, i in sorted(zip(dist, ids)):
                    if i not in best:
                        best[i] = d
                        if len(best) == k:
                            break
                out.append((q, list(best), list(best.values())))
            yield _found(out)

    grouped = partial.groupBy("vec_id").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("distances")).alias("distances"))
    return grouped.mapInArrow(_memory.lean(run), _FOUND).withColumnRenamed("ids", "neighbour_ids")


def calibrate(rows: DataFrame, asking: DataFrame, dim: int, tree: Tree, k: int, recall: float) -> int:
    """The fewest leaf visits, widening from one, that reach the recall on a sample of ``asking``."""
    n = asking.count()
    bound = int((1 << 30) * min(1.0, CALIBRATION_QUERIES / max(1, n)))
    sample = asking.where(F.pmod(F.xxhash64(F.lit("calibration"), "vec_id"), F.lit(1 << 30)) < bound).toArrow()
    if not sample.num_rows:
        sample = asking.toArrow()  # so few that none was picked
    if not sample.num_rows:
        return len(tree.leaves())
    ids, queries = sample.column("vec_id").to_numpy(), _matrix(sample.column("embedding").combine_chunks(), dim)
    truth = {r["vec_id"]: r["neighbour_ids"] for r in brute_force(rows, dim, ids, queries, k).collect()}
    wanted = sorted({i for found in truth.values() for i in found})
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(tree)

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(shared.value.assign(_matrix(b.column("embedding"), dim)))], ["vec_id", "leaf"])

    at: dict[int, set[int]] = {}
    names = spark.createDataFrame(pa.table({"vec_id": pa.array(wanted, pa.int64())}))
    for r in rows.join(F.broadcast(names), "vec_id", "left_semi").mapInArrow(leaf_of, "vec_id bigint, leaf bigint").collect():
        at.setdefault(r["vec_id"], set()).add(r["leaf"])
    order = tree.visits(queries, len(tree.leaves()))
    # at which visit each true neighbour comes up
    rank = np.array([min(seq.index(leaf) for leaf in at[i]) for q, seq in zip(ids.tolist(), order) for i in truth.get(q, [])])
    visits = 1
    while len(rank) and (rank < visits).mean() < recall:
        visits += 1
    return visits


def nearest_neighbours(vectors: DataFrame, k: int = K, recall: float = RECALL, branch: int = BRANCH, every: int = QUERY_EVERY) -> DataFrame:
    """``vec_id, neighbour_ids, distances``: for every vec_id divisible by ``every`` its k nearest others among all, by Euclidean distance, nearest first.

    Approximate: recall on a sample of the queries is at least ``recall``.
    Unusable rows (see ``clean_vectors``) neither ask nor answer.  An id on
    several rows is one point with several vectors: its distance to another is
    the least of their rows.  Ties in distance go by id.  With k or fewer other
    ids all of them are listed; a single vector has empty lists.  Other
    columns are not read.  An empty table gives an empty table, and so does one
    without an id to ask for.
    """
    spark = vectors.sparkSession
    rows, dim = clean_vectors(vectors)
    rows = _store.settle(rows, "vectors")
    tree = build(rows, dim, branch)
    visits = calibrate(rows, rows.where(F.pmod("vec_id", F.lit(every)) == 0), dim, tree, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, n = np.unique(shared.value.assign(_matrix(b.column("embedding"), dim)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(n)], ["leaf", "n"])

    sizes = {r["leaf"]: r["n"] for r in rows.mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    parts = spark.sparkContext.broadcast({leaf: -(-n // PART_ROWS) for leaf, n in sizes.items()})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                ids, x = b.column("vec_id").to_numpy(), _matrix(b.column("embedding"), dim)
                out: list[tuple[int, int, int, bytes, bytes]] = []
                leaf = shared.value.assign(x)
                for n in np.unique(leaf).tolist():
                    own = np.flatnonzero(leaf == n)
                    part = np.mod(ids[own], parts.value[n])
                    for p in np.unique(part).tolist():
                        mine = own[part == p]
                        out.append((n, p, 0, ids[mine].tobytes(), x[mine].tobytes()))
                asking = np.flatnonzero(ids % every == 0)
                asked = shared.value.visits(x[asking], visits)
                to = np.array([n for seq in asked for n in seq], np.int64)
                who = np.repeat(asking, [len(seq) for seq in asked])
                for n in np.unique(to).tolist():
                    mine = who[to == n]
                    for p in range(parts.value.get(n, 0)):
                        out.append((n, p, 1, ids[mine].tobytes(), x[mine].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["leaf", "part", "kind", "ids", "vectors"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, vectors, closed = None, [], [], True
        for b in batches:
            for leaf, part, kind, i, v in zip(*(b.column(c).to_pylist() for c in range(5))):
                if (leaf, part) != here:
                    here, ids, vectors, closed = (leaf, part), [], [], False
                i, v = np.frombuffer(i, np.int64), np.frombuffer(v, np.float32).reshape(-1, dim)
                if kind == 0:
                    ids.append(i)
                    vectors.append(v)
                    continue
                if not closed:
                    ids, vectors, closed = [np.concatenate(ids)] if ids else [], [np.concatenate(vectors)] if vectors else [], True
                if ids:
                    yield from _top(i, v, ids[0], vectors[0], k)

    met = rows.mapInArrow(_memory.lean(send), "leaf bigint, part int, kind int, ids binary, vectors binary").repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind")
    return _merge(met.mapInArrow(_memory.lean(search), _FOUND), k)


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
