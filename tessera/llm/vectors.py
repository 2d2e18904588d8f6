"""Operator 7, embedding near-duplicates with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import connected_components, cut, forget, table

THRESHOLD = 0.93
#: Vectors that fit the codebooks and set how many cells a traversal visits, at most.
SAMPLE = 8192
#: Vectors of a label in a cell, about; codewords for each half, at most.
PER_CELL, CODES = 64, 512
#: Vectors that one block of a group of cells holds, about.
PER_BLOCK = 4096
#: Copies of the whole table that one pass of the comparison sends, and MB that one of its tasks sorts, about.
PER_PASS, TASK_MB = 4, 32
RECALL = 0.98


def raw_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, dim, raw) of rows (vec_id, embedding, label), raw the components as floats of 4 bytes, or of 8 if 4 would change one.

    Rows without a label and vectors that are null, empty, zero or hold a null or non-finite
    component are left out: they link with nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, label, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if label is None or i is None or not v or None in v:
                    continue
                x = np.array(v, dtype=np.float64)
                most = np.abs(x).max()
                if not np.isfinite(most) or most == 0:
                    continue
                with np.errstate(over="ignore"):
                    short = x.astype("<f4")
                out.append((i, label, len(x), (short if (short == x).all() else x.astype("<f8")).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.binary()))], ["vec_id", "label", "dim", "raw"])

    cols = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding")
    return cols.mapInArrow(run, "vec_id long, label string, dim int, raw binary")


def units_of(raw: list[bytes], dim: int) -> np.ndarray:
    """The vectors of length 1, in double precision."""
    x = np.empty((len(raw), dim))
    for kind in ("<f4", "<f8"):
        at = [i for i, v in enumerate(raw) if len(v) == dim * int(kind[2])]
        if at:
            x[at] = np.frombuffer(b"".join(raw[i] for i in at), dtype=kind).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        at = nearest(x, c)
        for j in range(len(c)):
            if (own := at == j).any():
                c[j] = x[own].mean(axis=0)
    return c


def in_line(c: np.ndarray) -> np.ndarray:
    """Codewords along the direction in which they differ most: those with neighbouring numbers are near."""
    return c[np.argsort((c - c.mean(axis=0)) @ np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0], kind="stable")]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


@dataclass
class MultiIndex:
    """Two codebooks, one a half; cell (i, j) of their product grid is i * len(second) + j."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return nearest(x[:, :h], self.first) * len(self.second) + nearest(x[:, h:], self.second)

    def orders(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the codewords by distance from each codeword, and those distances."""
        out = []
        for c in (self.first, self.second):
            d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
            o = np.argsort(d, axis=1, kind="stable")
            out.append((o, np.take_along_axis(d, o, axis=1)))
        return out

    @staticmethod
    def fit(x: np.ndarray, codes: int, threshold: float, recall: float) -> "MultiIndex":
        """Codebooks of a sample, and the visits that find `recall` of neighbours at the threshold itself:
        the sample's vectors are turned by that angle in random directions and looked for."""
        h = max(1, x.shape[1] // 2)
        index = MultiIndex(*(in_line(k_means(half, min(codes, len(x)))) if half.shape[1] else k_means(half, min(codes, len(x))) for half in (x[:, :h], x[:, h:])), 1)
        rng = np.random.default_rng(5)
        y = rng.normal(size=x.shape)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y *= np.sqrt(1 - threshold**2) / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        a, b = index.cells(x), index.cells(threshold * x + y)
        orders, ranks = index.orders(), []
        most = len(index.first) * len(index.second)
        for i in rng.permutation(len(x))[:1000]:
            ranks.append(next((r for r, c in enumerate(index.traverse(int(a[i]), orders, most)) if c == b[i]), most) + 1)
        index.visits = int(np.quantile(ranks, recall, method="higher")) if ranks else 1
        return index

    def traverse(self, cell: int, orders: list, visits: int) -> Iterator[int]:
        """Multi-sequence traversal: cells by the sum of their halves' distances from a cell, nearest first."""
        (o1, d1), (o2, d2) = orders
        i, j = divmod(cell, len(self.second))
        heap, seen = [(0.0, 0, 0)], {(0, 0)}
        while heap and visits:
            _, a, b = heapq.heappop(heap)
            visits -= 1
            yield int(o1[i, a]) * len(self.second) + int(o2[j, b])
            for p, q in ((a + 1, b), (a, b + 1)):
                if p < o1.shape[1] and q < o2.shape[1] and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (float(d1[i, p] + d2[j, q]), p, q))


def forest(i: np.ndarray, j: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest row that each row and each column is connected with through links (i, j); `rows` for none."""
    r, c = np.full(rows, rows), np.full(cols, rows)
    r[i] = i
    while True:
        before = r.copy()
        np.minimum.at(c, j, r[i])
        np.minimum.at(r, i, c[j])
        if (before == r).all():
            return r, c


def compare(units: DataFrame, threshold: float, parts: int | None = None) -> DataFrame:
    """(a, b, n) of units (unit, side, vec_id, copies, dim, vec): b is null and n the links of a found here, or a and b are connected.

    A unit is a block of vectors (side 0), compared with itself and with each that follows (side 1),
    streamed in batches: a product of matrices for each, no pair is written down.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        ids = copies = found = x = width = None
        pend: list[tuple] = []
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def link(m: np.ndarray, jd: np.ndarray, jc: np.ndarray) -> None:
            i, j = np.nonzero(m)
            if len(i):
                np.add.at(found, i, jc[j])
                got = np.bincount(j, copies[i], len(jd)).astype(np.int64)
                out.append((jd[got > 0], np.full((got > 0).sum(), -1), got[got > 0]))
                r, c = forest(i, j, len(ids), len(jd))
                for lab, who in ((r, ids), (c, jd)):
                    ok = lab < len(ids)
                    out.append((ids[lab[ok]], who[ok], np.full(ok.sum(), -1)))

        def start() -> None:
            nonlocal ids, copies, found, x
            ids, copies = np.array([p[0] for p in pend]), np.array([p[1] for p in pend])
            x = units_of([p[2] for p in pend], width)
            found = np.zeros(len(ids), dtype=np.int64)
            for k in range(0, len(ids), 1024):
                m = np.triu(x @ x[k : k + 1024].T >= threshold, 1 - k)
                link(m, ids[k : k + 1024], copies[k : k + 1024])
            pend.clear()

        def other() -> None:
            if pend and x is not None:
                y = units_of([p[2] for p in pend], width)
                link(x @ y.T >= threshold, np.array([p[0] for p in pend]), np.array([p[1] for p in pend]))
            pend.clear()

        def end() -> None:
            nonlocal x
            if x is not None:
                other()
                out.append((ids[found > 0], np.full((found > 0).sum(), -1), found[found > 0]))
            x = None

        def batch_out() -> pa.RecordBatch:
            a, b, n = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
            out.clear()
            keep = (n >= 0) | (a != b)
            a, b, n = a[keep], b[keep], n[keep]
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64), mask=n >= 0), pa.array(n.astype(np.int64), mask=n < 0)], ["a", "b", "n"])

        opened = False
        for b in batches:
            for unit, side, i, c, d, v in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if unit != now:
                    if opened:
                        start()
                        opened = False
                    end()
                    now, width = unit, d
                    pend.clear()
                if side == 0:
                    opened = True
                elif opened:
                    start()
                    opened = False
                pend.append((i, c, v))
                if side == 1 and len(pend) >= 1024:
                    other()
            if sum(len(o[0]) for o in out) > 20_000:
                yield batch_out()
        if opened:
            start()
        end()
        yield batch_out()

    dealt = units.select("unit", "side", "vec_id", "copies", "dim", "vec")
    dealt = (dealt.repartition(parts, "unit") if parts else dealt.repartition("unit")).sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(run, "a long, b long, n long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one for each of rows (vec_id, embedding, label, others).

    Equal vectors of a label are one, with a count. Every vector is indexed. The multi-sequence
    order of a cell says which cells are nearest to it; two cells are compared if either is among
    the other's first `visits`, so a pair is found once and both ends count it. Only vectors of equal
    dimension and label meet. Cells of neighbouring numbers are a group, of as many as a traversal
    visits, within PER_BLOCK vectors, which is compared with itself; of two groups one gets those cells of the other that are to be compared with
    any of its own, once, and compares them with all. Large groups are split in blocks, compared two by two. Where cells are visited by many groups, the
    groups are dealt over passes, so what is on disk at a time stays within PER_PASS copies of the table. Rows that cannot
    link (no label, no valid vector) have no links and are their own component, as in an empty or
    single-row table; a null vec_id has a null component; repeated rows link with each other.
    """
    spark = rows.sparkSession
    valid = raw_vectors(rows)
    same = cut(valid.groupBy("label", "dim", "raw").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")))
    n, labels, width = same.agg(F.count("*"), F.approx_count_distinct("label"), F.avg(F.length("raw"))).first()
    base = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), "embedding")
    if n == 0:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    codes = int(np.clip(round((n / max(labels, 1) / PER_CELL) ** 0.5), 2, CODES))
    indexes: dict[int, MultiIndex] = {}
    picked = same.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).select("dim", "raw").collect()
    for d in {r.dim for r in picked}:
        indexes[d] = MultiIndex.fit(units_of([bytes(r.raw) for r in picked if r.dim == d], d), codes if d > 1 else 1, threshold, recall)
    orders = {d: i.orders() for d, i in indexes.items()}
    # cells of a group: more would send no fewer copies, but compare more
    wide = {d: max(1, min(i.visits, PER_BLOCK // PER_CELL)) for d, i in indexes.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vecs = b.column(1).to_pylist(), b.column(4).to_pylist()
            cells = np.zeros(len(dims), dtype=np.int64)
            for d in set(dims) & set(indexes):
                at = np.array([i for i, e in enumerate(dims) if e == d])
                cells[at] = indexes[d].cells(units_of([vecs[i] for i in at], d))
            groups = cells // np.array([wide.get(d, 1) for d in dims], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells), pa.array(groups)], ["label", "dim", "vec_id", "copies", "vec", "cell", "grp"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(label, dim, grp, cell): a cell that is to be compared with one of another group, which of two groups is the one that gets the other's."""
        for b in batches:
            out = set()
            for label, d, cell in zip(*(c.to_pylist() for c in b.columns), strict=True):
                size = wide.get(d, 1)
                for c in indexes[d].traverse(cell, orders[d], indexes[d].visits) if d in indexes else ():
                    g, h = cell // size, c // size
                    if g != h:
                        out.add((label, d, g, c) if (g < h) == ((g + h) % 2 == 0) else (label, d, h, cell))
            out = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["label", "dim", "grp", "cell"])

    key = ["label", "dim"]
    placed = cut(same.select("label", "dim", "vec_id", "copies", F.col("raw").alias("vec")).mapInArrow(place, "label string, dim int, vec_id long, copies long, vec binary, cell long, grp long"))
    del same
    forget(spark)
    cells = cut(placed.groupBy(*key, "grp", "cell").agg(F.count("*").alias("n")))
    groups = cells.groupBy(*key, "grp").agg(F.ceil(F.sum("n") / PER_BLOCK).alias("blocks"))
    met = cells.repartition(*key, "grp").sortWithinPartitions(*key, "cell").select(*key, "cell").mapInArrow(visit, "label string, dim int, grp long, cell long").distinct()
    # a cell for each block of a group that gets it, and a group's own blocks for those before
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    unit = lambda: F.xxhash64(*key, "grp", "block")
    met = cut(met.join(groups, [*key, "grp"]).select(*key, "cell", "grp", every).join(cells.select(*key, "cell", "n"), [*key, "cell"]).select(*key, "cell", unit().alias("unit"), "n"))
    sent = met.agg(F.sum("n")).first()[0] or 0
    blocked = groups.where("blocks > 1")
    passes = max(1, -(-sent // (PER_PASS * n)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((sent / passes + n) * (width + 40) / (TASK_MB << 20)) + 1)
    found = None
    for turn in range(passes):
        now = F.pmod(F.xxhash64("unit"), F.lit(passes)) == turn
        dealt = placed.join(groups, [*key, "grp"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), "blocks"))
        own = dealt.withColumn("block", F.col("own")).select(unit().alias("unit"), F.lit(0).alias("side"), "vec_id", "copies", "dim", "vec").where(now)
        before = placed.join(blocked, [*key, "grp"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), "blocks")).select("*", every).where("block < own").select(unit().alias("unit"), F.lit(1).alias("side"), "vec_id", "copies", "dim", "vec").where(now)
        theirs = placed.join(met.where(now).select(*key, "cell", "unit"), [*key, "cell"]).select("unit", F.lit(1).alias("side"), "vec_id", "copies", "dim", "vec")
        some = cut(compare(own.unionByName(theirs).unionByName(before), threshold, parts))
        found = some if found is None else found.unionByName(some)
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    links = connected_components(found.where("n is null").select("a", "b"))
    known = placed.join(counts, placed.vec_id == counts.a, "left").join(links, placed.vec_id == links.node, "left")
    known = known.select("label", "dim", F.col("vec").alias("raw"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", placed.vec_id).alias("component"))
    each = valid.join(known, ["label", "dim", "raw"]).select("vec_id", "n_links", "component").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = base.select("vec_id").join(each, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
