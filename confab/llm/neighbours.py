"""Approximate nearest neighbours by a permutation index."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, lean, stored

#: Pivots: about PIVOTS_ROOT times the square root of the number of vectors, at least and at most so many, so that the
#: inverted files grow more slowly than the table. A vector is posted under its PREFIX nearest pivots, and a query
#: opens the files of its own.
PIVOTS_ROOT, LEAST_PIVOTS, MOST_PIVOTS, PREFIX = 2.0, 256, 2048, 64
#: The pivots, and what is measured before the search, come from a sample of at most SAMPLE vectors. At first no two
#: pivots are nearer in direction than APART, so that many near copies of one vector do not become many equal pivots.
#: While fewer than wanted are taken, the least distance from 1 is halved, HALVINGS times, and at last any different
#: vectors are taken. Every vector is indexed.
SAMPLE, APART, HALVINGS = 8192, 0.9, 12
#: Vectors and queries of the sample on which the search is fitted, and the share of true neighbours that has to lie in
#: the opened cells, and within the reranked ranks.
FIT_ROWS, FIT_QUERIES, IN_CELLS, IN_RANKS = 4096, 256, 0.995, 0.99
#: Vectors of a bucket of cells, queries that meet it in one task, and queries whose agreements are held at once.
BUCKET, QUERIES, BATCH = 4096, 2048, 256


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def chosen_pivots(sample: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Different vectors of the sample, in random order, that are APART from those before them; while those are fewer
    than ``most``, also nearer ones, the bar coming down step by step."""
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(seed).permutation(len(sample))]
    ways = sample / np.linalg.norm(sample, axis=1)[:, None]
    taken: list[int] = []
    nearest = np.full(len(sample), -np.inf)
    for apart in [*(1 - (1 - APART) / 2**k for k in range(HALVINGS + 1)), np.inf]:
        for k in range(len(sample)):
            if len(taken) < most and nearest[k] < apart:
                taken.append(k)
                np.maximum(nearest, ways @ ways[k], out=nearest)
                nearest[k] = np.inf
    return sample[taken]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, summed component by component, so equal vectors have equal scores
    wherever they stand."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


@dataclass
class Pivots:
    """``lift`` is one more coordinate that brings all vectors to one norm, the largest, so that the largest inner
    product becomes the least distance; a query's is 0."""

    vectors: np.ndarray
    top: float

    def __post_init__(self):
        self.prefix = min(PREFIX, len(self.vectors))
        self.lift = self.raised(self.vectors)

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))

    def orders(self, x: np.ndarray, asks: bool) -> np.ndarray:
        """The pivots of each vector, nearest first."""
        near = x @ self.vectors.T
        if not asks:
            near += self.raised(x)[:, None] * self.lift[None, :]
        return np.argsort(-near, axis=1, kind="stable").astype(np.int16)


class Files:
    """Inverted files: for each pivot the rows that have it in their prefix, with the weight prefix - place."""

    def __init__(self, prefixes: np.ndarray, pivots: int):
        self.n, width = prefixes.shape
        flat = prefixes.ravel()
        by = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[by], np.arange(pivots + 1))
        self.rows = by // width
        self.weights = (width - by % width).astype(np.int16)

    def file(self, pivot: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[pivot], self.starts[pivot + 1])
        return self.rows[at], self.weights[at]


def agreements(asked: Files, held: Files) -> np.ndarray:
    """For each query and vector the sum over the pivots in both prefixes of the lesser weight. Spearman's footrule of
    two prefixes of w pivots, places beyond them counting as w, is w (w + 1) less twice this sum; so the greatest
    agreement is the least footrule, and only the files of a query's own prefix are opened."""
    out = np.zeros((asked.n, held.n), np.int16)
    for pivot in range(len(held.starts) - 1):
        q, a = asked.file(pivot)
        x, b = held.file(pivot)
        if len(q) and len(x):
            out[q[:, None], x[None, :]] += np.minimum(a[:, None], b[None, :])
    return out


@dataclass
class Fit:
    """``opened``: of how many of its nearest pivots a query visits the cells (a cell: the vectors whose nearest pivot
    it is). ``share``: of the vectors, by footrule, that are ranked exactly. ``files``: of the sample."""

    opened: int
    share: float
    files: Files


def fitted(pivots: Pivots, sample: np.ndarray, rows: int, k: int, seed: int) -> Fit:
    """The least cells and ranks that hold the wanted shares of the k nearest within the sample. Its neighbours are
    farther than those in the whole table, so the cells hold more there; the share of ranks is taken to fall with the
    square root of the number of vectors, as it does on vectors without structure."""
    sample = sample[np.random.default_rng(seed).permutation(len(sample))[:FIT_ROWS]]
    orders = pivots.orders(sample, False)
    files = Files(orders[:, : pivots.prefix], len(pivots.vectors))
    q = sample[:FIT_QUERIES]
    asks = pivots.orders(q, True)
    if len(sample) <= k + 1:
        return Fit(len(pivots.vectors), 1.0, files)
    near = q @ sample.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argpartition(-near, k - 1, axis=1)[:, :k]
    place = np.empty_like(asks)
    np.put_along_axis(place, asks, np.arange(asks.shape[1], dtype=np.int16)[None, :], axis=1)
    cells = np.take_along_axis(place, orders[true, 0], axis=1)
    agree = agreements(Files(asks[:, : pivots.prefix], len(pivots.vectors)), files)
    # Ties count against a neighbour.
    ranked = np.sort(-agree, axis=1)
    rank = np.concatenate([np.searchsorted(r, -a[t], side="right") for r, a, t in zip(ranked, agree, true, strict=True)])
    share = np.quantile(rank, IN_RANKS) / len(sample) * min(1.0, (len(sample) / rows) ** 0.5)
    return Fit(int(np.quantile(cells, IN_CELLS)) + 1, float(share), files)


def least_agreements(asked: Files, fit: Fit) -> np.ndarray:
    """For each query the agreement that the share of the sample reaches; at least 1, which all in an opened file have."""
    agree = agreements(asked, fit.files)
    at = min(max(int(np.ceil(fit.share * fit.files.n)), 1), fit.files.n) - 1
    return np.maximum(-np.partition(-agree, at, axis=1)[:, at], 1)


def packed(counts: dict[int, int], pivots: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and number of buckets of each cell: small cells share one, large ones are split."""
    first, parts, at, room = np.zeros(pivots, np.int64), np.ones(pivots, np.int64), 0, most
    for cell in range(pivots):
        n = counts.get(cell, 0)
        if n > room:
            at, room = at + (room < most), most
            parts[cell] = max(1, -(-n // most))
        first[cell] = at
        if parts[cell] > 1:
            at, room = at + parts[cell], most
        else:
            room -= n
    return first, parts


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _prefixes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), -1)


def _best(x: np.ndarray, ids: list[list[int]], q: np.ndarray, own: list[int], near: list[np.ndarray], k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of the k nearest of each query among its candidates."""
    kept, which = [], []
    for r, rows in enumerate(near):
        if len(rows) > k + 1:
            # Of different vectors k + 1 are enough, as the query's own is one; those within rounding of the last stay.
            s = x[rows] @ q[r]
            last = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
            rows = rows[s >= last - 1e-9 * (1 + abs(last))]
        kept.append(rows)
        which.append(np.full(len(rows), r))
    rows, which = np.concatenate(kept), np.concatenate(which)
    scores = inner(x[rows], q[which])
    out: list[tuple[int, int, float]] = []
    start = 0
    for r, some in enumerate(kept):
        s = scores[start : start + len(some)]
        start += len(some)
        found: list[tuple[float, int]] = []
        for at in np.argsort(-s, kind="stable").tolist():
            if len(found) >= k and -s[at] > found[-1][0]:
                break
            found += [(-float(s[at]), i) for i in ids[some[at]] if i != own[r]]
            found.sort()
            del found[k:]
        out += [(own[r], i, -s_) for s_, i in found]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of largest inner product among those found, nearest
    first, ties to the smaller id; its own row does not count. Fewer than k others: all of them.

    Equal vectors are indexed as one, with their k + 1 least ids. Each vector's order of pivots is made once and kept;
    the vector goes to the cell of its nearest pivot. Small cells share a bucket, large ones are split by a hash, so
    buckets are of bounded size. A query goes to the buckets of the cells of its first pivots only. A bucket holds its
    inverted files; a query opens those of its prefix, which adds up the footrules of what stands in them, and all whose
    footrule is among the least of the sample's ranked share have exact products. How many cells are visited and ranks
    reranked follows from the sample: few where vectors have structure, most where they have none. Buckets that very
    many queries visit are met by blocks of them. Buckets send at most k rows a query.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id or with
    a length other than the most frequent one (the longer of two as frequent). Rows that share an id count as one, the
    one with the greatest vector. ``is_query`` is an expression over the id column. An empty table, or no query, gives
    an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.groupBy(id_col).agg(F.max("v").alias("v")).select(F.col(id_col).alias("i"), "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stored(rows.withColumn("h", F.xxhash64("v")))
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    most = widths.orderBy(F.desc("n"), F.desc("width")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if most is None or not most.q:
        return spark.createDataFrame([], schema)
    width = most.width
    rows = rows.where(F.size("v") == width)
    sample = bounded_sample(rows, F.concat_ws(" ", F.lit(seed), F.col("i")), F.lit(1), SAMPLE).select("i", "v").collect()
    sample = np.unique(np.array([r.v for r in sorted(sample, key=lambda r: r.i)], np.float64), axis=0)
    wanted = int(min(max(PIVOTS_ROOT * most.n**0.5, LEAST_PIVOTS), MOST_PIVOTS))
    pivots = Pivots(chosen_pivots(sample, wanted, seed), most.norm)
    fit = fitted(pivots, sample, most.n, k, seed)
    n_pivots, prefix = len(pivots.vectors), pivots.prefix
    known = spark.sparkContext.broadcast((pivots, fit))

    # Of equal vectors the k + 1 least ids; the limit works before rows are exchanged, so copies are never gathered.
    place = F.row_number().over(Window.partitionBy("h", "v").orderBy("i"))
    same = rows.select("h", "v", "i").withColumn("place", place).where(F.col("place") <= k + 1)
    same = same.groupBy("h", "v").agg(F.sort_array(F.collect_list("i")).alias("ids")).select("ids", "v")

    @lean
    def posted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, _ = known.value
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                order = p.orders(_matrix(part.column(1), width), False)
                marks = pa.array([o.tobytes() for o in np.ascontiguousarray(order[:, : p.prefix])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(order[:, 0].astype(np.int32)), marks], ["ids", "v", "cell", "prefix"])

    index = stored(same.mapInArrow(posted, "ids array<long>, v array<double>, cell int, prefix binary"))
    first, parts = packed({r.cell: r["count"] for r in index.groupBy("cell").count().collect()}, n_pivots, BUCKET)
    cells = spark.sparkContext.broadcast((first, parts))

    @lean
    def visits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, f = known.value
        start, number = cells.value
        for batch in it:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                order = p.orders(_matrix(part.column(1), width), True)
                head = np.ascontiguousarray(order[:, : p.prefix])
                least = least_agreements(Files(head, n_pivots), f)
                seen = [np.unique(np.concatenate([np.arange(start[c], start[c] + number[c]) for c in o[: f.opened]])) for o in order]
                which = pa.array(np.repeat(np.arange(len(seen)), [len(s) for s in seen]))
                marks = pa.array([o.tobytes() for o in head], pa.binary())
                columns = [part.column(0), part.column(1), marks, pa.array(least.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seen)), *[c.take(which) for c in columns]], ["bucket", "i", "v", "prefix", "least"])

    asked = stored(rows.where("asks").select("i", "v").mapInArrow(visits, "bucket long, i long, v array<double>, prefix binary, least int"))
    blocks = asked.groupBy("bucket").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    asked = asked.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("i"), "blocks").cast("int")).drop("blocks")
    start, number = (F.split(F.lit(",".join(map(str, xs.tolist()))), ",").cast("array<bigint>") for xs in (first, parts))
    at = F.get(start, F.col("cell")) + F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.get(number, F.col("cell")))
    index = index.select(at.alias("bucket"), "ids", "v", "prefix").join(blocks, "bucket")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left.column("v"), width), left.column("ids").to_pylist()
            held = Files(_prefixes(left.column("prefix")), n_pivots)
            for at in range(0, right.num_rows, BATCH):
                part = right.slice(at, BATCH)
                agree = agreements(Files(_prefixes(part.column("prefix")), n_pivots), held)
                least = part.column("least").to_numpy()
                near = [np.flatnonzero(a >= m) for a, m in zip(agree, least, strict=True)]
                out += _best(x, ids, _matrix(part.column("v"), width), part.column("i").to_pylist(), near, k)
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    found = index.groupBy("bucket", "block").cogroup(asked.groupBy("bucket", "block")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
