"""Near-duplicate vectors by NN-descent: a neighbour graph refined through joins of neighbours'
neighbours, whose edges at or above the threshold are the links.

1. Equal vectors become one vertex with a weight (a grouped count, combined before the shuffle).
2. First lists: ``TREES`` forests of random hyperplanes (cut at medians of a bounded sample) part
   the vertices into leaves of about ``LEAF``; each vertex takes its ``K`` best of its leaves.
3. A round: every vertex is sent to its neighbours and to those that have it as one (the pivots);
   each pivot compares its members with one another, and pairs better than a member's worst
   neighbour go to that member.  Pivots with many members compare them in groups of ``GROUP``.
   A list whose worst entry reaches the threshold is saturated and doubles its length.
4. Rounds go on until an audit is met: sampled vertices are compared with all vectors, and the share
   of a vertex's true links whose two ends are in one component has to be ``RECALL`` on average; the
   sample grows until ``SEEN`` of its vertices have links.  Each time it is missed, further trees
   join the lists.  After ``MOST_ROUNDS`` the operator fails with the figure; it gives no
   incomplete result.
5. Links within each component are counted exactly, block against block, and only counts leave a
   task: a group of g vectors costs g * ceil(g / BLOCK) rows sent and g counted, and g * g products.

State (id, weight, vector, list) is packed by hash range of the id, and one exchange moves a
partition as few large rows.  Each round's state is a written table.

Defined cases: vectors that are null, zero, of another length than the commonest, or hold null or
non-finite components link with nothing and keep themselves; repeated rows count as vectors of
their own, except that a row's own class counts it once less; a null id comes back null; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_bucket, deal, dropped, lean, mix64, partitions, range_bucket, stored
from .components import components
from .vectors import dimension, matrix, usable

TREES, LEAF, K, GROUP = 8, 384, 8, 96
#: Rows of a block that is sent whole, and of a square of it that is compared at once.
BLOCK, SQUARE = 8_192, 1_024
SAMPLE, AUDIT, SEEN, MOST_AUDITED, RECALL, MOST_ROUNDS = 4_096, 256, 32, 16_384, 0.999, 24
_EDGE = np.dtype([("a", "<i8"), ("b", "<i8"), ("s", "<f8")])
_ROW = "bucket int, kind byte, blob binary"


def _rows(kind: int, rec: np.ndarray, buckets: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    for bucket, at in by_bucket(buckets, n):
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int8()), pa.array([rec[at].tobytes()], pa.binary())], names=["bucket", "kind", "blob"])


def _home(ids: np.ndarray, n: int) -> np.ndarray:
    return range_bucket(mix64(ids), n)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _taken(batches: Iterator[pa.RecordBatch], types: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    blobs: dict[int, list[bytes]] = {k: [] for k in types}
    for b in batches:
        for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
            blobs[kind].append(blob)
    return {k: np.frombuffer(b"".join(v), dtype=types[k]) for k, v in blobs.items()}


def _top(edges: np.ndarray, room: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The best edges of each vertex, one for each neighbour, ``room`` of them at most."""
    e = edges[np.lexsort((edges["b"], edges["a"]))]
    if len(e):
        e = e[np.r_[True, (e["a"][1:] != e["a"][:-1]) | (e["b"][1:] != e["b"][:-1])]]
        e = e[np.lexsort((e["b"], -e["s"], e["a"]))]
        first = np.flatnonzero(np.r_[True, e["a"][1:] != e["a"][:-1]])
        rank = np.arange(len(e)) - np.repeat(first, np.diff(np.r_[first, len(e)]))
        e = e[rank < room[np.searchsorted(ids, e["a"])]]
    return e


def _pairs(ids: np.ndarray, unit: np.ndarray, worst: np.ndarray, k: int) -> np.ndarray:
    """Edges (a, b, s) among the rows that are better than a's worst neighbour, k for each a."""
    s = unit @ unit.T
    s[ids[:, None] == ids[None, :]] = -2.0
    m = min(k, len(ids) - 1)
    if m < 1:
        return np.empty(0, dtype=_EDGE)
    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
    got = np.take_along_axis(s, best, axis=1)
    i, j = np.nonzero((got > worst[:, None]) & (got > -1.5))
    out = np.zeros(len(i), dtype=_EDGE)
    out["a"], out["b"], out["s"] = ids[i], ids[best[i, j]], got[i, j]
    return out


class _Graph:
    """The packed neighbour graph of one table; ``table`` holds kind 0 (vertices), 1 (lists)."""

    def __init__(self, reps: DataFrame, dim: int, n: int, threshold: float) -> None:
        self.spark, self.dim, self.n, self.threshold = reps.sparkSession, dim, n, threshold
        self.parts = partitions(self.spark)
        single = reps.schema["vec"].dataType.simpleString() == "array<float>"
        self.vertex = np.dtype([("id", "<i8"), ("w", "<i8"), ("room", "<i4"), ("x", "<f4" if single else "<f8", (dim,))])
        self.member = np.dtype([("pivot", "<i8"), ("id", "<i8"), ("room", "<i4"), ("worst", "<f8"), ("x", "<f4" if single else "<f8", (dim,))])
        self.reps = reps
        self.table = self._first()

    def _first(self) -> DataFrame:
        dim, vertex, parts = self.dim, self.vertex, self.parts

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rec = np.zeros(b.num_rows, dtype=vertex)
                rec["id"], rec["w"], rec["room"], rec["x"] = b.column("id").to_numpy(), b.column("w").to_numpy(), K, matrix(b.column("vec"), dim)
                yield from _rows(0, rec, _home(rec["id"], parts), parts)

        return self._leaves(self.reps.mapInArrow(lean(emit), _ROW), 11)

    def more_trees(self, seed: int) -> None:
        """Further forests, whose leaves' best pairs join the lists."""
        old = self.table
        self.table = self._leaves(old, seed)
        dropped(old)

    def _leaves(self, table: DataFrame, seed: int) -> DataFrame:
        parts, dim, vertex = self.parts, self.dim, self.vertex
        depth = max(0, int(np.ceil(np.log2(max(1, self.n) / LEAF))))
        share = min(1.0, SAMPLE / max(1, self.n))
        sample = self.reps.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("vec").limit(2 * SAMPLE).collect()
        planes = np.random.default_rng(seed).standard_normal((dim, TREES * depth))
        unit = _unit(np.array([r.vec for r in sample], dtype=np.float64).reshape(-1, dim))
        cuts = np.median(unit @ planes, axis=0) if depth else np.zeros(0)
        shared = self.spark.sparkContext.broadcast((planes, cuts))
        leafed = np.dtype([("leaf", "<u8"), *[(k, vertex[k]) for k in vertex.names]])

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes, cuts = shared.value
            for b in batches:
                yield b
                for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
                    if kind:
                        continue
                    rec = np.frombuffer(blob, dtype=vertex)
                    codes = (_unit(rec["x"]) @ planes > cuts).reshape(len(rec), TREES, depth)
                    keys = mix64((codes.astype(np.uint64) << np.arange(depth, dtype=np.uint64)).sum(axis=2, dtype=np.uint64) * np.uint64(TREES) + np.arange(TREES, dtype=np.uint64))
                    for t in range(TREES):
                        out = np.zeros(len(rec), dtype=leafed)
                        for k in vertex.names:
                            out[k] = rec[k]
                        # a leaf may hold any number of vertices: those of a leaf are spread by their
                        # second hash, and leaves far above the usual size are compared in parts
                        out["leaf"] = keys[:, t]
                        yield from _rows(2, out, range_bucket(keys[:, t], parts), parts)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _taken(batches, {0: vertex, 1: _EDGE, 2: leafed})
            yield from _rows(0, got[0], _home(got[0]["id"], parts), parts)
            yield from _rows(1, got[1], _home(got[1]["a"], parts), parts)
            rec = got[2][np.lexsort((mix64(got[2]["id"]), got[2]["leaf"]))]
            ends = np.flatnonzero(np.r_[True, rec["leaf"][1:] != rec["leaf"][:-1], True]) if len(rec) else []
            found = []
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                pieces = -(-(z - a) // (4 * LEAF))
                for p in range(pieces):
                    r = rec[a + (z - a) * p // pieces : a + (z - a) * (p + 1) // pieces]
                    found.append(_pairs(r["id"], _unit(r["x"]), np.full(len(r), -2.0), K))
            if found:
                e = _once(np.concatenate(found))
                yield from _rows(1, e, _home(e["a"], parts), parts)

        return self._merged(deal(table.mapInArrow(lean(emit), _ROW)).mapInArrow(lean(compare), _ROW))

    def _merged(self, edges: DataFrame) -> DataFrame:
        """Lists of kind 1 edges joined with the vertices of kind 0; saturated lists get more room."""
        parts, vertex, threshold = self.parts, self.vertex, self.threshold

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _taken(batches, {0: vertex, 1: _EDGE})
            v = np.sort(got[0], order="id")
            e = _top(got[1], v["room"], v["id"])
            if len(e):
                at = np.searchsorted(v["id"], e["a"])
                count, least = np.bincount(at, minlength=len(v)), np.full(len(v), 2.0)
                np.minimum.at(least, at, e["s"])
                v["room"] = np.where((count >= v["room"]) & (least >= threshold), v["room"] * 2, v["room"])
            yield from _rows(0, v, _home(v["id"], parts), parts)
            yield from _rows(1, e, _home(e["a"], parts), parts)

        return stored(deal(edges).mapInArrow(lean(merge), _ROW))

    def refine(self) -> None:
        parts, vertex, member = self.parts, self.vertex, self.member

        def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each list also goes to the neighbours' homes."""
            for b in batches:
                yield b
                for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
                    if kind == 1:
                        e = np.frombuffer(blob, dtype=_EDGE)
                        yield from _rows(2, e, _home(e["b"], parts), parts)

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Every vertex goes to its pivots: its neighbours, those that list it, itself."""
            got = _taken(batches, {0: vertex, 1: _EDGE, 2: _EDGE})
            v, e = np.sort(got[0], order="id"), got[1]
            yield from _rows(0, v, _home(v["id"], parts), parts)
            yield from _rows(1, e, _home(e["a"], parts), parts)
            worst, count = np.full(len(v), 2.0), np.zeros(len(v), dtype=np.int64)
            at = np.searchsorted(v["id"], e["a"])
            np.minimum.at(worst, at, e["s"])
            np.add.at(count, at, 1)
            worst = np.where(count < v["room"], -2.0, worst)
            to = np.unique(np.concatenate([np.stack([e["a"], e["b"]], 1), np.stack([got[2]["b"], got[2]["a"]], 1), np.stack([v["id"], v["id"]], 1)]), axis=0)
            for s in range(0, len(to), 50_000):
                own = np.searchsorted(v["id"], to[s : s + 50_000, 0])
                m = np.zeros(len(own), dtype=member)
                m["pivot"], m["id"], m["room"], m["worst"], m["x"] = to[s : s + 50_000, 1], v["id"][own], v["room"][own], worst[own], v["x"][own]
                yield from _rows(2, m, _home(m["pivot"], parts), parts)

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = _taken(batches, {0: vertex, 1: _EDGE, 2: member})
            yield from _rows(0, got[0], _home(got[0]["id"], parts), parts)
            yield from _rows(1, got[1], _home(got[1]["a"], parts), parts)
            m = got[2][np.lexsort((mix64(got[2]["id"] ^ got[2]["pivot"]), got[2]["pivot"]))]
            ends = np.flatnonzero(np.r_[True, m["pivot"][1:] != m["pivot"][:-1], True]) if len(m) else []
            found, held = [], 0
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                pieces = -(-(z - a) // GROUP)
                for p in range(pieces):
                    r = m[a + (z - a) * p // pieces : a + (z - a) * (p + 1) // pieces]
                    found.append(_pairs(r["id"], _unit(r["x"]), r["worst"], int(r["room"].max())))
                    held += len(found[-1])
                if held > 200_000:
                    e = _once(np.concatenate(found))
                    yield from _rows(1, e, _home(e["a"], parts), parts)
                    found, held = [], 0
            if found:
                e = _once(np.concatenate(found))
                yield from _rows(1, e, _home(e["a"], parts), parts)

        old = self.table
        self.table = self._merged(deal(deal(old.mapInArrow(lean(back), _ROW)).mapInArrow(lean(send), _ROW)).mapInArrow(lean(join), _ROW))
        dropped(old)

    def links(self) -> DataFrame:
        """(a, b) of the listed edges at or above the threshold."""
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for blob in b.column("blob").to_pylist():
                    e = np.frombuffer(blob, dtype=_EDGE)
                    e = e[e["s"] >= threshold]
                    yield pa.RecordBatch.from_arrays([pa.array(e["a"]), pa.array(e["b"])], names=["a", "b"])

        return self.table.where("kind = 1").select("blob").mapInArrow(lean(run), "a long, b long")


def _once(e: np.ndarray) -> np.ndarray:
    return np.unique(e)


def _audit(reps: DataFrame, labels: DataFrame, dim: int, n: int, threshold: float) -> tuple[float | None, int]:
    """(recall, vertices it rests on): the mean, over sampled vertices that have true links, of the
    share of these links that lie within one component, each vertex with equal weight, so that a
    large group can't hide what small ones lost.  The sample grows until ``SEEN`` of its vertices
    have links, or to ``MOST_AUDITED`` vertices; None if none of them has a link."""
    spark, size = reps.sparkSession, AUDIT
    l = labels.select(F.col("v"), F.col("component"))
    while True:
        share = min(1.0, size / max(1, n))
        picked = reps.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("id", "vec").limit(2 * size).collect()
        ids, q = np.array([r.id for r in picked], dtype=np.int64), _unit(np.array([r.vec for r in picked], dtype=np.float64).reshape(-1, dim))
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                own = b.column("id").to_numpy()
                i, j = np.nonzero(_unit(matrix(b.column("vec"), dim)) @ q.T >= threshold)
                keep = own[i] != ids[j]
                yield pa.RecordBatch.from_arrays([pa.array(own[i][keep]), pa.array(ids[j][keep])], names=["a", "b"])

        true = reps.select("id", "vec").mapInArrow(lean(run), "a long, b long")
        both = true.join(l.select(F.col("v").alias("a"), F.col("component").alias("ca")), "a", "left").join(l.select(F.col("v").alias("b"), F.col("component").alias("cb")), "b", "left")
        got = both.groupBy("b").agg(F.avg(F.when(F.col("ca") == F.col("cb"), 1.0).otherwise(0.0)).alias("hit")).agg(F.avg("hit").alias("recall"), F.count("*").alias("n")).first()
        if got.n >= SEEN or size >= min(n, MOST_AUDITED):
            return got.recall, got.n
        size *= 8


def _counted(reps: DataFrame, labels: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(id, links): weights of the other vertices at or above the threshold, within components."""
    n = partitions(reps.sparkSession)
    single = reps.schema["vec"].dataType.simpleString() == "array<float>"
    sizes = labels.groupBy("component").agg(F.count("*").alias("g"))
    rows = reps.join(labels.withColumnRenamed("v", "id").join(sizes, "component"), "id").withColumn("blocks", F.ceil(F.col("g") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cell = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("id", "w", "vec", "own", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).withColumn("bucket", F.pmod(F.xxhash64("component", "i", "j"), F.lit(n)).cast("int"))
    rec_type = np.dtype([("c", "<i8"), ("i", "<i4"), ("j", "<i4"), ("own", "<i4"), ("id", "<i8"), ("w", "<i8"), ("x", "<f4" if single else "<f8", (dim,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            r = np.zeros(b.num_rows, dtype=rec_type)
            for k, name in (("c", "component"), ("i", "i"), ("j", "j"), ("own", "own"), ("id", "id"), ("w", "w")):
                r[k] = b.column(name).to_numpy()
            r["x"] = matrix(b.column("vec"), dim)
            got.append(r)
        if not got:
            return
        r = np.concatenate(got)
        r = r[np.lexsort((r["j"], r["i"], r["c"]))]
        ends = np.flatnonzero(np.r_[True, (r["c"][1:] != r["c"][:-1]) | (r["i"][1:] != r["i"][:-1]) | (r["j"][1:] != r["j"][:-1]), True])
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            g = r[a:z]
            same = g["i"][0] == g["j"][0]
            first, second = (g, g) if same else (g[g["own"] == g["i"]], g[g["own"] == g["j"]])
            counts = np.zeros(len(first), dtype=np.int64), np.zeros(len(second), dtype=np.int64)
            u, v = _unit(first["x"]), _unit(second["x"])
            for x in range(0, len(u), SQUARE):
                for y in range(0, len(v), SQUARE):
                    p, q = slice(x, x + SQUARE), slice(y, y + SQUARE)
                    near = (u[p] @ v[q].T >= threshold) & (first["id"][p][:, None] != second["id"][q][None, :])
                    counts[0][p] += near @ second["w"][q]
                    if not same:
                        counts[1][q] += first["w"][p] @ near
            out = [(first["id"], counts[0])] + ([] if same else [(second["id"], counts[1])])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]))], names=["id", "links"])

    return deal(cell).mapInArrow(lean(run), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None) -> DataFrame:
    """One row a vector: vec_id long, n_links long, component_id long, kept boolean.  ``report`` takes
    the rounds, the audited recall and the number of vertices it rests on."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    dim = dimension(rows, "vec")
    valid = usable(rows, "vec", dim) & F.col("vec_id").isNotNull() if dim else F.lit(False)
    reps = stored(rows.where(valid).groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")).select("id", "w", "vec"))
    n = reps.count()
    alone = rows.where(~F.coalesce(valid, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    graph = _Graph(reps, dim, n, threshold)
    for round_no in range(1, MOST_ROUNDS + 1):
        graph.refine()
        if round_no == 1:
            continue
        labels = components(graph.links())
        recall, seen = _audit(reps, labels, dim, n, threshold)
        if report is not None:
            report.update(rounds=round_no, recall=recall, audited=seen)
        if recall is None or recall >= RECALL:
            break
        graph.more_trees(100 + round_no)
    else:
        raise RuntimeError(f"links are incomplete after {MOST_ROUNDS} rounds: audited recall {recall} over {seen} vertices")
    per_rep = reps.select("id", "w", "vec").join(labels.select(F.col("v").alias("id"), "component"), "id", "left").join(_counted(reps, labels, dim, threshold), "id", "left")
    per_rep = per_rep.select("vec", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    linked = rows.where(valid).join(per_rep, "vec").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
