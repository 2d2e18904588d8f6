"""Operator 10, toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, cut, forget, hand_back, keep, table, tidy

DIMS = 1 << 18
#: At most so many labelled training documents of each class.
SAMPLE = 3000
CUT = 0.7
#: Standard errors by which the share of a term alone, or of a pair, must differ, and the share of rows from which terms are paired.
Z_SINGLE, Z_PAIR, SHARE = 4.0, 6.0, 0.01
#: Learning rates of the weights and the factors, and the weight of their squares.
RATE, L2 = (0.1, 0.05), 1e-4


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Terms(dict):
    """word -> hashed terms: the bare word and, if it is longer, its first five letters; only those in `known` if given."""

    def __init__(self, dims: int, known: dict[int, int] | None = None, most: int = 300_000):
        super().__init__()
        self.dims, self.known, self.most = dims, known, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        bare = word.strip(".,;:!?\"'()[]{}<>*#$%&|-_")
        names = (f"w {bare}", f"p {bare[:5]}") if len(bare) > 5 else (f"w {bare}",) if bare else ()
        ids = tuple(xxhash.xxh32_intdigest(x) % self.dims for x in names)
        if self.known is not None:
            ids = tuple(self.known[i] for i in ids if i in self.known)
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids


def terms(text: str | None, cache: Terms) -> list[int]:
    found: set[int] = set()
    for w in set((text or "").lower().split()):
        if ids := cache[w]:
            found.update(ids)
    return sorted(found)


@dataclass
class FactorizationMachine:
    """sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a text."""

    ids: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[int]) -> float:
        return float(self.scores([rows])[0])

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Scores of many texts: their terms' weights and factors summed text by text, no pair is formed."""
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), np.int64, int(n.sum()))
        ends = np.concatenate([[0], np.cumsum(n)])
        table = np.hstack([self.w[:, None], (self.v**2).sum(axis=1)[:, None], self.v])
        total = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[flat], axis=0)]) if len(flat) else np.zeros((1, table.shape[1]))
        own = total[ends[1:]] - total[ends[:-1]]
        z = self.bias + own[:, 0] + 0.5 * ((own[:, 2:] ** 2).sum(axis=1) - own[:, 1])
        return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))

    @staticmethod
    def fit(docs: list[list[int]], y: np.ndarray, factors: int = 8, epochs: int = 60, seed: int = 7) -> "FactorizationMachine":
        """AdaGrad over the terms that tell the classes apart alone or together with another (see `informative`)."""
        pos, neg = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
        if not docs or not (y == 1).any() or not (y == 0).any():
            p = (float((y == 1).sum()) + 0.5) / (len(docs) + 1) if len(docs) else 0.0
            return FactorizationMachine(np.zeros(0, np.int64), float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))), np.zeros(0), np.zeros((0, factors)))
        flat = np.concatenate([np.asarray(d, np.int64) for d in docs])
        of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        ids, index = np.unique(flat, return_inverse=True)
        chosen = informative(of, index, y, len(ids))
        at = np.full(len(ids), -1)
        at[chosen] = np.arange(len(chosen))
        good = at[index] >= 0
        col, row = at[index][good], of[good]
        rng = np.random.default_rng(seed)
        n, bias = len(chosen), float(np.log(pos / neg))
        w, v = np.zeros(n), rng.normal(0, 0.05, (n, factors))
        gw, gv, gb = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
        start = np.searchsorted(row, np.arange(len(docs) + 1))
        weight = np.where(y == 1, 0.5 * len(docs) / pos, 0.5 * len(docs) / neg)
        for epoch in range(epochs):
            for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 256)):
                spans = [np.arange(start[i], start[i + 1]) for i in batch]
                c = col[np.concatenate(spans)]
                r = np.repeat(np.arange(len(batch)), [len(s) for s in spans])
                x = np.zeros((len(batch), n), np.float32)
                x[r, c] = 1.0
                s = x @ v
                zed = bias + x @ w + 0.5 * (s**2 - x @ v**2).sum(axis=1)
                g = (1 / (1 + np.exp(-np.clip(zed, -30, 30))) - y[batch]) * weight[batch] / len(batch)
                db, dw = g.sum(), x.T @ g + L2 * w
                dv = x.T @ (g[:, None] * s) - (x.T @ g)[:, None] * v + L2 * v
                gb, gw, gv = gb + db**2, gw + dw**2, gv + dv**2
                bias -= RATE[0] * db / np.sqrt(gb)
                w -= RATE[0] * dw / np.sqrt(gw)
                v -= RATE[1] * dv / np.sqrt(gv)
        return FactorizationMachine(ids[chosen], float(bias), w, v)


def difference(a: np.ndarray, b: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """By how many standard errors the shares a / pos and b / neg differ."""
    share = (a + b) / (pos + neg)
    return (a / pos - b / neg) / np.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)


def informative(of: np.ndarray, index: np.ndarray, y: np.ndarray, n: int, z_single: float = Z_SINGLE, z_pair: float = Z_PAIR, share: float = SHARE, block: int = 1024) -> np.ndarray:
    """The terms, of n, whose share differs between the classes by z_single standard errors, and both terms
    of each pair whose joint share differs by z_pair and by half of that more than either alone.

    Row i of the sample `of` holds term `index`, once. Pairs are counted among the terms in at least
    `share` of the rows, by products of matrices of two blocks of terms at a time.
    """
    rows, up = len(y), y == 1
    pos, neg = int(up.sum()), int((~up).sum())
    a, b = np.bincount(index, up[of], n), np.bincount(index, ~up[of], n)
    z = difference(a, b, pos, neg)
    chosen = np.abs(z) >= z_single
    often = np.flatnonzero(a + b >= max(2, share * rows))
    place = np.full(n, -1)
    place[often] = np.arange(len(often))
    held = place[index] >= 0
    col, row = place[index][held], of[held]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]

    def matrix(k: int) -> np.ndarray:
        i, j = np.searchsorted(col, (k, k + block))
        m = np.zeros((rows, min(block, len(often) - k)), np.float32)
        m[row[i:j], col[i:j] - k] = 1
        return m

    for k in range(0, len(often), block):
        left = matrix(k)
        for j in range(k, len(often), block):
            right = left if j == k else matrix(j)
            both = difference(left[up].T @ right[up], left[~up].T @ right[~up], pos, neg)
            alone = np.maximum(np.abs(z[often[k : k + block]])[:, None], np.abs(z[often[j : j + block]])[None, :])
            p, q = np.nonzero((np.abs(both) >= z_pair) & (np.abs(both) >= alone + z_pair / 2))
            different = often[k + p] != often[j + q]
            chosen[often[k + p[different]]] = chosen[often[j + q[different]]] = True
    return np.flatnonzero(chosen)


def screened(hashes: DataFrame) -> np.ndarray:
    """The terms of hashes (y, terms) that `informative` may choose, counted by Spark: those that tell the classes
    apart alone and those frequent enough for pairs. There are at most 1 / SHARE times as many of the latter as a row has terms."""
    size = hashes.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
    pos, neg = max(1, size[1]), max(1, size[0] - size[1])
    counts = hashes.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    share = F.col("n") / (pos + neg)
    z = (F.col("a") / pos - (F.col("n") - F.col("a")) / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)
    # a hair under the bound: `informative` decides
    rows = counts.where((F.abs(z) >= Z_SINGLE - 1e-6) | (F.col("n") >= max(2, SHARE * size[0]))).select("term").toArrow()
    return np.sort(rows["term"].to_numpy())


def train(docs: DataFrame, labels: DataFrame, dims: int = DIMS, limit: int = SAMPLE) -> FactorizationMachine:
    """Fits on a bounded sample: `limit` doc_ids a class by hash of the id, never held-out ones. Of repeated labels the higher holds.

    What reaches the driver of a text, however long, are its terms among those that a count over the sample lets through.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    pick = lambda y: one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = docs.select("doc_id", "text").join(F.broadcast(pick(1).union(pick(0))), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Terms(dims)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t, cache) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "y", "terms"])

    hashes = cut(chosen.select("doc_id", F.col("y").cast("int"), "text").mapInArrow(tidy(hashed), "doc_id long, y int, terms array<int>"))
    known = screened(hashes)

    def restricted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [x.values.to_numpy()[np.isin(x.values.to_numpy(), known)] for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.list_(pa.int32()))], ["doc_id", "y", "terms"])

    rows = hashes.mapInArrow(tidy(restricted), hashes.schema).toArrow().combine_chunks()
    ids, y = rows["doc_id"].to_pylist(), rows["y"].to_numpy()
    found = [x.values.to_numpy() for x in rows["terms"]]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], found[i].tolist()))
    # what Spark held for the sample goes before the fit takes its room
    forget(docs.sparkSession)
    return FactorizationMachine.fit([found[i] for i in order], y[order].astype(np.int64))


def score_toxicity(docs: DataFrame, model: FactorizationMachine, dims: int = DIMS) -> DataFrame:
    """docs with toxic_score (0 to 1): whole texts, empty or null ones have no terms and get the bias alone.

    Extra columns stay (one named toxic_score is replaced); repeated rows get equal scores.
    """
    return docs.withColumn("toxic_score", F.pandas_udf(_scorer(model, dims), "double")("text"))


def _scorer(model: FactorizationMachine, dims: int):
    import pandas as pd

    known = {int(i): k for k, i in enumerate(model.ids)}
    kind = ("terms", dims, xxhash.xxh64_hexdigest(model.ids.tobytes()))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = keep(kind, lambda: Terms(dims, known))
        for texts in batches:
            yield pd.Series(model.scores([terms(t, cache) for t in texts]), dtype="float64")

    score = tidy(score)
    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains and scores: docs with toxic_score and toxic_predicted (1 from CUT on)."""
    model = train(docs, labels)
    # the sample's matrices would else stay with the driver, whatever it does next
    hand_back()
    scored = score_toxicity(docs, model)
    return scored.withColumn("toxic_predicted", (F.col("toxic_score") >= CUT).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, from labels outside the held-out third."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
