"""Toxicity by nearest labelled examples under TF-IDF cosine.

Terms: words without the punctuation around them, and word beginnings of 4 and 5 characters.  The
examples are a bounded sample of labelled rows (``EXAMPLES`` of each label at most, chosen by a hash
of the id) with their whole TF-IDF vectors: no term is left out.  A term's weight is multiplied by
1 + its chi-square against the label, so that terms that tell labels apart count most.

Search is exact, by a block-max inverted index for batches of texts: the examples lie in blocks, a
block has the largest weight of each common term, and blocks whose bound (with the rare terms'
postings, which are added exactly) doesn't reach the k-th cosine found are passed over.
A text's vote is the weighted mean of its neighbours' labels (weights cosine / (1.05 - cosine)).
Votes become probabilities by logistic calibration on the examples' own leave-one-out votes,
weighted back to the labels' true shares; texts without a term get the rate of such examples.
``evidence`` holds the ids of the nearest examples.

Defined cases: null and empty texts have no term (they get that base rate); with no labelled row
the score is 0; a document labelled twice counts with its larger label, and of several texts under
one labelled doc_id the one with the smallest hash is the example; documents without a label are
scored like the others; ties between examples go to the smaller id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_bucket, lean, release, small_batches, widened, word_bytes

EXAMPLES, K, DENSE, BATCH, REMEMBERED = 2_000, 15, 1_024, 256, 150_000
#: Examples of a block; blocks of a text that are evaluated before bounds are compared.
BLOCK, FIRST = 32, 6
_EDGE = b".,;:!?\"'()[]{}<>|*-_"


def terms_of(word: bytes) -> tuple[bytes, ...]:
    """The terms of a word: without the punctuation around it, and the beginnings of long ones."""
    w = word.strip(_EDGE)
    return (w, b"^" + w[:4], b"^" + w[:5]) if len(w) > 5 else (w,) if w else ()


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a text's terms, ascending, and how often each occurs."""
    import xxhash

    found: Counter = Counter()
    for w, n in Counter(word_bytes(text)).items():
        for t in terms_of(w):
            found[xxhash.xxh3_64_intdigest(t)] += n
    at = np.array(sorted(found), dtype=np.uint64)
    return at, np.array([found[t] for t in at.tolist()], dtype=np.int64)


class Index:
    """Inverted index of the examples' vectors, cut into blocks of ``BLOCK`` examples that share their
    heaviest terms.  Postings of rare terms are added to a text's cosines directly; of the ``DENSE``
    commonest terms a block holds a matrix, and the block maxima tell what it can add at most."""

    def __init__(self, terms, idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], share: tuple[float, float]) -> None:
        """terms: ascending hashes; examples: (id, label, term numbers, counts), in any order; share: how
        many real rows an example of label 0 or 1 stands for."""
        self.terms, self.idf = terms, idf
        heaviest = [int(e[2][np.argmax(self.weights(e[2], e[3]))]) if len(e[2]) else -1 for e in examples]
        self.ids = np.array([e[0] for e in examples], dtype=np.int64)
        self.labels = np.array([e[1] for e in examples], dtype=np.float64)
        #: The example at each place of the blocks, and the place of each example.
        self.example = np.array(sorted(range(len(examples)), key=lambda i: (examples[i][1], heaviest[i], examples[i][0])), dtype=np.int64)
        self.place = np.argsort(self.example)
        vectors = [self.weights(at, n) for _, _, at, n in examples]
        at = np.concatenate([np.asarray(e[2], dtype=np.int64) for e in examples] or [np.empty(0, np.int64)])
        row = np.repeat(self.place, [len(v) for v in vectors])
        order = np.argsort(at, kind="stable")
        self.at = np.searchsorted(at[order], np.arange(len(terms) + 1))
        self.row, self.weight = row[order].astype(np.int32), np.concatenate([*vectors, np.empty(0)])[order]
        common = np.argsort(-np.diff(self.at), kind="stable")[:DENSE]
        self.slot = np.full(len(terms), -1, dtype=np.int32)
        self.slot[common] = np.arange(len(common))
        self.blocks = max(1, -(-len(examples) // BLOCK))
        self.matrix: np.ndarray | None = None
        self._calibrate(examples, vectors, share)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "matrix": None, "most": None}  # made again where it is used

    def weights(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.idf[at]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def _postings(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the terms' postings, and how many each has."""
        n = self.at[t + 1] - self.at[t]
        return np.repeat(self.at[t] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()), n

    def search(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = K, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (term numbers, weights) the (examples, cosines) of the k nearest examples with a
        positive cosine, exactly; ties go to the smaller id.  ``without``: an example of each text
        that is left out.  A text's best blocks are evaluated first; then those whose bound reaches
        the k-th cosine found, the only ones that can hold a nearer example."""
        if self.matrix is None:
            common = np.flatnonzero(self.slot >= 0)
            p, n = self._postings(common)
            self.matrix = np.zeros((self.blocks, len(common), BLOCK))
            self.matrix[self.row[p] // BLOCK, np.repeat(self.slot[common], n), self.row[p] % BLOCK] = self.weight[p]
            self.most = self.matrix.max(axis=2, initial=0).T.copy()
        b, size = len(texts), self.blocks * BLOCK
        q, cos = np.zeros((b, self.matrix.shape[1])), np.zeros((b, size))
        for i, (at, w) in enumerate(texts):
            s = self.slot[at]
            own = s >= 0
            q[i, s[own]] = w[own]
            p, n = self._postings(at[~own])
            cos[i] = np.bincount(self.row[p], np.repeat(w[~own], n) * self.weight[p], size)
        cos[:, len(self.ids) :] = -1
        if without is not None:
            cos[np.arange(b), self.place[without]] = -1
        bound = q @ self.most + cos.reshape(b, self.blocks, BLOCK).max(axis=2)
        done = np.zeros((b, self.blocks), dtype=bool)

        def evaluate(wanted: np.ndarray) -> None:
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows = np.flatnonzero(wanted[:, block])
                cos[rows, block * BLOCK : (block + 1) * BLOCK] += q[rows] @ self.matrix[block]
            done[wanted] = True

        first = np.zeros_like(done)
        np.put_along_axis(first, np.argpartition(-bound, min(FIRST, self.blocks) - 1, axis=1)[:, :FIRST], True, axis=1)
        evaluate(first)
        grid = cos.reshape(b, self.blocks, BLOCK)
        least = np.zeros(b)
        for i in range(b):
            own = grid[i, done[i]].ravel()
            least[i] = max(0.0, np.partition(own, -k)[-k]) if len(own) >= k else 0.0
        evaluate(~done & (bound > 0) & (bound >= least[:, None] - 1e-9))
        out = []
        for i in range(b):
            place = np.flatnonzero(done[i])
            near, best = self._top((place[:, None] * BLOCK + np.arange(BLOCK)).ravel(), np.round(grid[i, place].ravel(), 12), k)  # equal examples get equal cosines
            out.append((near, best))
        return out

    def _top(self, place: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(cos, -k)[-k] if len(cos) > k else 0.0
        hit = np.flatnonzero((cos >= least) & (cos > 0))
        example = self.example[place[hit]]
        best = np.lexsort((self.ids[example], -cos[hit]))[:k]
        return example[best], cos[hit[best]]

    def nearest(self, at: np.ndarray, q: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest examples with a positive cosine, exactly."""
        return self.search([(at, q)], k)[0]

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        w = cos / (1.05 - np.minimum(cos, 1.0))
        return float((w * self.labels[near]).sum() / w.sum())

    def _calibrate(self, examples: list, vectors: list, share: tuple[float, float]) -> None:
        weight = np.where(self.labels == 1, share[1], share[0])
        votes = np.full(len(examples), np.nan)
        for s in range(0, len(examples), BATCH):
            part = [(e[2], v) for e, v in zip(examples[s : s + BATCH], vectors[s : s + BATCH], strict=True)]
            for i, (near, best) in enumerate(self.search(part, without=np.arange(s, s + len(part))), s):
                if len(near):
                    votes[i] = self.vote(near, best)
        bare = np.isnan(votes)
        total = weight.sum()
        rate = float((weight * self.labels).sum() / total) if total else 0.0
        self.base = float(((weight * self.labels)[bare].sum() + rate) / (weight[bare].sum() + 1)) if bare.any() else rate
        x, y, w = votes[~bare] - 0.5, self.labels[~bare], weight[~bare]
        a, b = 4.0, 0.0
        if len(x) and 0 < y.sum() < len(y):
            w = w / w.sum()
            for _ in range(50):  # Newton steps with a small ridge
                p = 1 / (1 + np.exp(-(a * x + b)))
                h = w * p * (1 - p)
                g = np.array([(w * (y - p) * x).sum() - 1e-4 * a, (w * (y - p)).sum() - 1e-4 * b])
                m = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-4]])
                d = np.linalg.solve(m, g)
                a, b = a + float(np.clip(d[0], -3, 3)), b + float(np.clip(d[1], -3, 3))
        self.a, self.b = a, b
        self.matrix = self.most = None

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """(probability, ids of the nearest examples) for each text's (term numbers, weights)."""
        out = []
        for s in range(0, len(texts), BATCH):
            for near, best in self.search(texts[s : s + BATCH]):
                if len(near):
                    out.append((float(1 / (1 + np.exp(-(self.a * (self.vote(near, best) - 0.5) + self.b)))), self.ids[near[:3]].tolist()))
                else:
                    out.append((self.base, []))
        return out


class Reader:
    """Vectors of texts: a word is looked up once for the numbers of its terms, remembered to a bound."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.table = np.empty((0, 3), dtype=np.int32)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the terms of each word, -1 for those that no example has."""
        import xxhash

        own = [terms_of(w) for w in words]
        h = np.array([xxhash.xxh3_64_intdigest(t) for x in own for t in x], dtype=np.uint64)
        known = self.index.terms
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        out, size = np.full((len(words), 3), -1, dtype=np.int32), np.array([len(x) for x in own])
        row = np.repeat(np.arange(len(words)), size)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.where(known[at] == h, at, -1)
        return out

    def vectors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        words = [word_bytes(t) for t in texts]
        new = set().union(*words).difference(self.slot)
        if len(self.slot) + len(new) > REMEMBERED:
            self._clear()
            new = set().union(*words)
        if new and len(self.index.terms):
            self.table = np.concatenate([self.table, self._numbers(list(new))])
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
        out = []
        for w in words:
            at = self.table[np.fromiter(map(self.slot.__getitem__, w), np.int64, len(w))].ravel() if len(self.slot) else np.empty(0, np.int32)
            at, n = np.unique(at[at >= 0], return_counts=True)
            out.append((at.astype(np.int64), self.index.weights(at, n)))
        return out


def fit(docs: DataFrame, labels: DataFrame, allowed, examples: int = EXAMPLES) -> Index | None:
    """Index over a bounded sample of ``labels`` (doc_id, toxic) where ``allowed`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.where(F.col("text").isNotNull()).select("doc_id").distinct(), "doc_id")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    part = {t: min(1 << 20, int(examples / n * (1 << 20)) + 1) for t, n in counts.items()}
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("toxic") == 1, part.get(1, 0)).otherwise(part.get(0, 0))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * examples)
    rows = [(r.doc_id, r.toxic) for r in picked.collect()]  # bounded ids and labels
    ids = spark.createDataFrame(rows, "doc_id long, toxic int")
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *(pa.array([f[k].astype(t).tobytes() for f in found], pa.binary()) for k, t in ((0, "<u8"), (1, "<u4")))], names=["doc_id", "toxic", "terms", "n"])

    got = sample.select("doc_id", "toxic", "text").mapInArrow(lean(vectors), "doc_id long, toxic int, terms binary, n binary").collect()
    rows = [(r.doc_id, r.toxic, bytes(r.terms), bytes(r.n)) for r in sorted(got, key=lambda r: r.doc_id)]
    del got
    index = index_of(rows, counts)
    del rows
    release()
    return index


def index_of(rows: list[tuple[int, int, bytes, bytes]], counts: dict[int, int]) -> Index:
    """Index of examples (id, label, ascending term hashes, their counts) in ascending id order;
    ``counts``: all labelled rows."""
    known = np.unique(np.frombuffer(b"".join(r[2] for r in rows), dtype="<u8"))
    examples = [(key, label, np.searchsorted(known, np.frombuffer(t, dtype="<u8")).astype(np.int32), np.frombuffer(n, dtype="<u4")) for key, label, t, n in rows]
    none = np.empty(0, np.int64)
    a, b = (np.bincount(np.concatenate([*(e[2] for e in examples if e[1] == v), none]), minlength=len(known)).astype(np.float64) for v in (1, 0))
    n0, n1 = (sum(e[1] == v for e in examples) for v in (0, 1))
    n = len(examples)
    chi = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(1.0, (a + b) * (n - a - b) * n0 * n1)
    return Index(known, np.log(1 + n / (a + b)) * (1 + chi), examples, (counts.get(0, 0) / max(1, n0), counts.get(1, 0) / max(1, n1)))


def score(docs: DataFrame, index: Index | None) -> DataFrame:
    """``docs`` with score double, predicted int, evidence array<long>."""
    small_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted", "evidence")
    schema = widened(kept, score="double", predicted="int", evidence="array<long>")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        reader = Reader(index) if index else None
        for b in batches:
            texts = b.column("text").to_pylist()
            found = index.score(reader.vectors(texts)) if reader else [(0.0, [])] * len(texts)
            p = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=[*b.schema.names, "score", "predicted", "evidence"])

    return kept.mapInArrow(lean(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int, evidence of every document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    index = fit(own, labels, crc_bucket("doc_id", held_out_of) != held_out)
    return score(own.select("doc_id", (crc_bucket("doc_id", held_out_of) == held_out).alias("held_out"), "text"), index).drop("text")
