"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

Fit: k-means splits a bounded sample (``SAMPLE`` rows at most, chosen by a hash of the id) again
and again, ``BRANCH`` ways, until leaves would hold about ``LEAF`` rows of the whole table.  Index:
every row is sent down the tree to one leaf.  Inner products become distances by one more
coordinate, sqrt(M^2 - |x|^2) for rows and 0 for queries.

Search: a priority queue holds tree nodes by the query's distance to their centre; the nearest node
is opened first, and a leaf that is taken from the queue is visited.  How many leaves to visit is
calibrated: up to ``CALIBRATE`` of the queries are answered by brute force over all rows, each true
neighbour's leaf is looked up in its query's visiting order, and visits are widened until the mean
recall is ``RECALL``.  ``search(..., audit=True)`` also returns that recall.

Scale: a leaf's rows are dealt to cells of ``CELL`` rows, so a leaf that holds a third of all rows
is many cells; a query is sent to each cell of the leaves it visits.  Cells meet their queries
in one exchange, partial results (at most k for a query and a task) in a second one.

Defined cases: vectors that are null, zero, of another length than the commonest, or hold null or
non-finite components take no part, neither as query nor as candidate; ties go to the smaller id;
a query with fewer than k candidates gets them all; an empty table gives an empty result; repeated
ids are candidates of their own, but are asked once, and a query never returns rows of its own id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_bucket, deal, lean, mix64, partitions, range_bucket
from .vectors import dimension, matrix, usable

SAMPLE, BRANCH, LEAF, CELL = 16_384, 16, 400, 2_048
CALIBRATE, RECALL = 128, 0.97


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centres of k-means (fewer than k if there are fewer different rows)."""
    centres = np.unique(x[rng.permutation(len(x))[: 4 * k]], axis=0)
    centres = centres[rng.permutation(len(centres))[:k]]
    for _ in range(rounds):
        own = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


class Tree:
    """Nodes in one list: centre, and children (positions) or the number of a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, norm: float, seed: int = 7) -> None:
        self.norm, self.centres, self.children, self.leaf = norm, [np.zeros(sample.shape[1])], [[]], [-1]
        rng = np.random.default_rng(seed)
        parts = {0: sample}
        queue = [(-len(sample), 0)]
        count = 1
        while queue and count < leaves:  # the fullest node is split first
            _, node = heapq.heappop(queue)
            x = parts.pop(node)
            if len(x) < 2:
                continue
            centres = kmeans(x, min(BRANCH, leaves - count + 1), rng)
            if len(centres) < 2:
                continue
            own = nearest(x, centres)
            for c in range(len(centres)):
                self.children[node].append(len(self.centres))
                self.centres.append(centres[c])
                self.children.append([])
                self.leaf.append(-1)
                parts[len(self.centres) - 1] = x[own == c]
                heapq.heappush(queue, (-int((own == c).sum()), len(self.centres) - 1))
            count += len(centres) - 1
        self.n = 0
        for i, kids in enumerate(self.children):
            if not kids:
                self.leaf[i], self.n = self.n, self.n + 1
        self.stack = [np.array([self.centres[k] for k in kids]) for kids in self.children]

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        return np.column_stack([x, more])

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        x, out = self.lifted(x), np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                own = nearest(x[rows], self.stack[node])
                todo += [(k, rows[own == c]) for c, k in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order for one query."""
        q, out, queue = self.lifted(q[None, :], True)[0], [], [(0.0, 0)]
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                continue
            d = ((self.stack[node] - q) ** 2).sum(1)
            for k, x in zip(self.children[node], d.tolist(), strict=True):
                heapq.heappush(queue, (x, k))
        return out


def _best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, exact scores) of each query's k best rows, ties to smaller ids."""
    rough = q @ x.T
    rough[qid[:, None] == ids[None, :]] = -np.inf
    m = min(k, len(ids))
    kth = -np.partition(-rough, m - 1, axis=1)[:, m - 1]
    for i in range(len(q)):
        at = np.flatnonzero(rough[i] >= kth[i] - 1e-9 * max(1.0, abs(kth[i]))) if np.isfinite(kth[i]) else np.flatnonzero(np.isfinite(rough[i]))
        exact = (x[at] * q[i]).sum(axis=1)
        top = np.lexsort((ids[at], -exact))[:k]
        yield i, ids[at][top], exact[top]


_HITS = np.dtype([("q", "<i8"), ("id", "<i8"), ("s", "<f8")])


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from blobs of partial hits dealt by the query's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in b.column("hits").to_pylist()]
        if not blobs:
            return
        h = np.frombuffer(b"".join(blobs), dtype=_HITS)
        h = h[np.lexsort((h["id"], -h["s"], h["q"]))]
        first = np.flatnonzero(np.r_[True, h["q"][1:] != h["q"][:-1]])
        rank = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)])) + 1
        h, rank = h[rank <= k], rank[rank <= k]
        for at in range(0, len(h), 20_000):
            s = slice(at, at + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(h["q"][s]), pa.array(rank[s].astype(np.int32)), pa.array(h["id"][s]), pa.array(h["s"][s])], names=["query_id", "rank", "vec_id", "score"])

    return deal(parts).mapInArrow(lean(run), "query_id long, rank int, vec_id long, score double")


def brute_force(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int, dim: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries (ids, vectors) among all ``rows`` (id, vec)."""
    qid, q = queries
    n = partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = matrix(b.column("vec"), dim), b.column("id").to_numpy()
            if len(ids):
                hits = np.concatenate([np.array(list(zip([qid[i]] * len(a), a, s, strict=True)), dtype=_HITS) for i, a, s in _best(q, qid, x, ids, k)])
                for bucket, at in by_bucket(range_bucket(mix64(hits["q"]), n), n):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([hits[at].tobytes()], pa.binary())], names=["bucket", "hits"])

    return _merged(rows.mapInArrow(lean(run), "bucket int, hits binary"), k)


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, audit: bool = False):
    """Each query's k rows of largest inner product: query_id long, rank int, vec_id long, score
    double.  ``is_query``: a column over ``df``.  With ``audit``: (result, calibrated recall, leaves
    visited, leaves)."""
    spark = df.sparkSession
    n_parts = partitions(spark)
    dim = dimension(df, vec_col)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = df.where(usable(df, vec_col, dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    stats = rows.agg(F.count("*").alias("n"), F.count_if("is_query").alias("m"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm")).first()
    if not stats.n or not stats.m:
        return (empty, 1.0, 0, 0) if audit else empty
    most = max(256, min(SAMPLE, (64 << 20) // (8 * dim)))

    def picked(part: DataFrame, bound: int, total: int) -> list:
        share = min(1.0, bound / max(1, total))
        return part.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("id", "vec").limit(2 * bound).collect()

    sample = np.array([r.vec for r in picked(rows, most, stats.n)], dtype=np.float64).reshape(-1, dim)
    norm = float(np.sqrt(stats.norm)) * (1 + 1e-9)
    seeds = picked(rows.where("is_query"), CALIBRATE, stats.m) or rows.where("is_query").select("id", "vec").limit(CALIBRATE).collect()
    tree = Tree(np.column_stack([sample, np.sqrt(np.maximum(norm**2 - (sample**2).sum(1), 0))]), max(1, min(len(sample) // 4, stats.n // LEAF)), norm)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.leaves_of(matrix(b.column("vec"), dim)), pa.int32())], names=[*b.schema.names, "leaf"])

    placed = rows.mapInArrow(lean(place), f"id long, vec {rows.schema['vec'].dataType.simpleString()}, is_query boolean, leaf int")
    counts = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one number a leaf
    qid, q = np.array([r.id for r in seeds], dtype=np.int64), np.array([r.vec for r in seeds], dtype=np.float64)
    _, first = np.unique(qid, return_index=True)
    qid, q = qid[first], q[first]
    truth = brute_force(rows.select("id", "vec"), (qid, q), k, dim).join(placed.select(F.col("id").alias("vec_id"), "leaf").dropDuplicates(["vec_id"]), "vec_id").select("query_id", "leaf").collect()
    order = {int(i): {leaf: at for at, leaf in enumerate(tree.visits(v, tree.n))} for i, v in zip(qid, q, strict=True)}
    needed = np.sort([order[r.query_id][r.leaf] for r in truth]) if truth else np.zeros(1)
    visited, reached = 1, 0.0
    while True:  # widen until the calibrated recall is reached
        reached = float((needed < visited).mean())
        if reached >= recall or visited >= tree.n:
            break
        visited = min(tree.n, visited + max(1, visited // 8))
    parts = {leaf: -(-c // CELL) for leaf, c in counts.items()}
    base, at = {}, 0
    for leaf in sorted(parts):
        base[leaf], at = at, at + parts[leaf]
    cells = spark.sparkContext.broadcast((base, parts))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, parts = cells.value
        own = np.dtype([("id", "<i8"), ("cell", "<i4"), ("x", "<f4" if single else "<f8", (dim,))])
        for b in batches:
            ids, x, leaf = b.column("id").to_numpy(), matrix(b.column("vec"), dim), b.column("leaf").to_numpy()
            part = mix64(ids) % np.array([parts[v] for v in leaf.tolist()], dtype=np.uint64)
            rec = np.zeros(len(ids), dtype=own)
            rec["id"], rec["x"], rec["cell"] = ids, x, np.array([base[v] for v in leaf.tolist()]) + part.astype(np.int64)
            out = [(bucket, 0, rec[at].tobytes()) for bucket, at in by_bucket(rec["cell"] % n_parts, n_parts)]
            asks = []
            for i in np.flatnonzero(b.column("is_query").to_numpy(zero_copy_only=False)):
                to = [c for v in shared.value.visits(x[i], visited) if v in base for c in range(base[v], base[v] + parts[v])]
                ask = np.zeros(len(to), dtype=own)
                ask["id"], ask["x"], ask["cell"] = ids[i], x[i], to
                asks.append(ask)
            if asks:
                ask = np.concatenate(asks)
                out += [(bucket, 1, ask[at].tobytes()) for bucket, at in by_bucket(ask["cell"] % n_parts, n_parts)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int8(), pa.binary()), strict=True)], names=["bucket", "kind", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.dtype([("id", "<i8"), ("cell", "<i4"), ("x", "<f4" if single else "<f8", (dim,))])
        got: tuple[list, list] = ([], [])
        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
                got[kind].append(blob)
        if not got[0] or not got[1]:
            return
        x, q = (np.frombuffer(b"".join(g), dtype=own) for g in got)
        x, q = x[np.argsort(x["cell"], kind="stable")], q[np.lexsort((q["id"], q["cell"]))]
        q = q[np.r_[True, (q["cell"][1:] != q["cell"][:-1]) | (q["id"][1:] != q["id"][:-1])]]
        hits = []
        for c in np.unique(q["cell"]):
            a, z = np.searchsorted(x["cell"], [c, c + 1])
            u, w = np.searchsorted(q["cell"], [c, c + 1])
            if a == z:
                continue
            for s in range(u, w, 512):
                e = min(w, s + 512)
                for i, ids, scores in _best(q["x"][s:e].astype(np.float64), q["id"][s:e], x["x"][a:z].astype(np.float64), x["id"][a:z], k):
                    h = np.zeros(len(ids), dtype=_HITS)
                    h["q"], h["id"], h["s"] = q["id"][s + i], ids, scores
                    hits.append(h)
        if hits:
            h = np.concatenate(hits)
            h = h[np.lexsort((h["id"], -h["s"], h["q"]))]
            first = np.flatnonzero(np.r_[True, h["q"][1:] != h["q"][:-1]])
            h = h[np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)])) < k]
            for bucket, at in by_bucket(range_bucket(mix64(h["q"]), n_parts), n_parts):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([h[at].tobytes()], pa.binary())], names=["bucket", "hits"])

    single = "array<float>" in rows.schema.simpleString()
    result = _merged(deal(placed.mapInArrow(lean(emit), "bucket int, kind byte, blob binary")).mapInArrow(lean(meet), "bucket int, hits binary"), k)
    return (result, reached, visited, tree.n) if audit else result
