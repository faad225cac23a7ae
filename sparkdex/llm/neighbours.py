"""Approximate nearest neighbours: cross-polytope hashing, multiprobe tables, exact reranking.

Each table rotates a unit vector by three rounds of random signs and a fast Hadamard transform and assigns it to
the nearest signed axis; it holds, for a block of vectors, a bucket for each axis. A query probes the PROBES axes of
each table where its own coordinate is largest, which is the probe's worth, and collects what is in their buckets. A
vector's worth is that of all the probes that met it. The vectors with the most worth are reranked exactly. Largest
inner products become nearest unit vectors by one more coordinate, which fills every vector up to the largest norm;
queries have none of it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

TABLES, PROBES = 16, 48
SHARE, LEAST = 0.12, 300
#: Vectors whose estimated cosine is as high are candidates whatever their number.
NEAR = 0.45
BLOCK_ROWS = 8192
STRIPE = 1024
QUERY_BYTES = 16 << 20
SCHEMA = "query_id long, rank int, vec_id long, score double"


def hadamard(x: np.ndarray) -> None:
    """The fast Walsh-Hadamard transform of every column, in place, scaled to a rotation."""
    d, n = x.shape
    h = 1
    while h < d:
        y = x.reshape(d // (2 * h), 2, h, n)
        low = y[:, 0] - y[:, 1]
        y[:, 0] += y[:, 1]
        y[:, 1] = low
        h *= 2
    x *= np.float32(1 / np.sqrt(d))


def rotations(dim: int, seed: int = 1) -> np.ndarray:
    """Signs of the three rounds of each table."""
    width = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (TABLES, 3, width))


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """One table's pseudo-rotation of float32 columns, padded with zeros to a power of two."""
    y = np.zeros((signs.shape[1], x.shape[1]), np.float32)
    y[: len(x)] = x
    for s in signs:
        y *= s[:, None]
        hadamard(y)
    return y


def unit(x: np.ndarray, largest: float | None) -> np.ndarray:
    """Rows of norm 1: with ``largest``, filled up to it by one more coordinate; else scaled, and 0 there."""
    norms = np.linalg.norm(x, axis=1)
    if largest is None:
        return np.c_[x / norms[:, None], np.zeros(len(x))].astype(np.float32)
    return np.c_[x / largest, np.sqrt(np.maximum(0, 1 - (norms / largest) ** 2))].astype(np.float32)


def usable(column: str):
    """Rows that take part: a vector of finite components, not all zero."""
    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return c.isNotNull() & finite & F.exists(c, lambda v: v != 0)


def assigned(filled: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Each table's axis of every vector (twice its number, plus one for the negative side), and the mean over all
    of the sum of their coordinates there."""
    n = len(filled)
    axes, level = np.empty((TABLES, n), np.int64), 0.0
    for first in range(0, n, STRIPE):
        part = np.ascontiguousarray(filled[first : first + STRIPE].T)
        for t in range(TABLES):
            y = rotated(part, signs[t])
            best = np.abs(y).argmax(axis=0)
            at = y[best, np.arange(y.shape[1])]
            axes[t, first : first + STRIPE] = best * 2 + (at < 0)
            level += float(np.abs(at).sum())
    return axes, level / n


class Tables:
    """The buckets of a block of vectors, of all tables one after the other."""

    def __init__(self, axes: np.ndarray, width: int):
        n = axes.shape[1]
        keys = (axes + np.arange(TABLES)[:, None] * 2 * width).ravel()
        self.members = np.argsort(keys, kind="stable") % n
        self.starts = np.searchsorted(np.sort(keys), np.arange(TABLES * 2 * width + 1))

    def meetings(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of the buckets, and the place in ``buckets`` that each was met by."""
        sizes = self.starts[buckets + 1] - self.starts[buckets]
        probe = np.repeat(np.arange(len(buckets)), sizes)
        within = np.arange(len(probe)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.members[self.starts[buckets][probe] + within], probe


def probed(queries: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query: the buckets of its probes in all tables, and the probes' worths."""
    directions = np.ascontiguousarray(unit(queries, None).T)
    width = signs.shape[2]
    count = min(PROBES, width)
    buckets, worths = [], []
    for t in range(TABLES):
        y = rotated(directions, signs[t]).T
        best = np.argpartition(-np.abs(y), count - 1, axis=1)[:, :count]
        at = np.take_along_axis(y, best, axis=1)
        buckets.append(best * 2 + (at < 0) + t * 2 * width)
        worths.append(np.abs(at))
    return np.concatenate(buckets, axis=1), np.concatenate(worths, axis=1)


def search_block(queries: np.ndarray, probes, vectors: np.ndarray, largest: float, signs: np.ndarray, k: int, query_ids: np.ndarray, ids: np.ndarray):
    """Places of queries, of vectors and the exact scores of each query's k best candidates of the block."""
    n = len(vectors)
    axes, level = assigned(unit(vectors, largest), signs)
    tables = Tables(axes, signs.shape[2])
    budget = min(n, max(LEAST, int(SHARE * n)))
    out = []
    for q, (buckets, worths) in enumerate(zip(*probes, strict=True)):
        met, probe = tables.meetings(buckets)
        worth = np.bincount(met, worths[probe], n)
        bar = min(np.partition(worth, n - budget)[n - budget], NEAR * level)
        found = np.flatnonzero(worth >= bar)
        found = found[ids[found] != query_ids[q]]
        score = vectors[found] @ queries[q]
        if len(found) > k:
            bar = np.partition(score, len(score) - k)[len(score) - k]
            found = found[score >= bar - 1e-9 * max(1.0, abs(bar))]
        # row by row, so that equal vectors have equal scores and ties go by id
        score = (vectors[found] * queries[q]).sum(axis=1)
        order = np.lexsort((ids[found], -score))[:k]
        out.append((np.full(len(order), q), found[order], score[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest found, by inner product, of every row whose vec_id is divisible by ``every``.

    Columns: query_id, rank (from 1), vec_id, score (the inner product of the original vectors in double
    precision); nearest first, ties to the smaller vec_id; all candidates if there are fewer. Vectors that are
    null, zero or hold a null or non-finite component, or have a null vec_id or another length than most, take
    no part. Rows that repeat a vec_id are candidates each, but never of a query of that id; as a query, a vec_id
    counts once, with the smallest of its vectors (component by component). Of every block of about BLOCK_ROWS
    vectors, the SHARE with the most probe worth (LEAST at least) and all whose worth speaks for a cosine over NEAR
    are reranked, so that groups of near-equal vectors stay whole. Queries go to the executors in blocks of about
    QUERY_BYTES, one after the other: only one block is on the driver and broadcast at a time, and what it found is
    stored. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], SCHEMA)
    dim, is_query = sizes.d, F.pmod(F.col("vec_id"), F.lit(every)) == 0
    rows = rows.where(F.size("v") == dim)
    largest, n_queries = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), F.sum(is_query.cast("long"))).first()
    blocks = max(1, -(-(n_queries or 0) * dim * 8 // QUERY_BYTES))
    signs, parts = rotations(dim + 1), []
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    for b in range(blocks):
        own = (asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else asked).toArrow()
        if not own.num_rows:
            continue
        queries = np.stack(own.column("v").to_pylist())
        shared = spark.sparkContext.broadcast((own.column("vec_id").to_numpy(), queries, probed(queries, signs)))
        part = ranked(rows.mapInArrow(searcher(shared, largest, signs, k), "query_id long, vec_id long, score double"), k)
        if blocks == 1:
            return part
        parts.append(stored(part, "neighbours")[0])
        shared.destroy()
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def searcher(shared, largest: float, signs: np.ndarray, k: int):
    def search(batches):
        query_ids, queries, probes = shared.value

        def run(ids, vectors):
            q, v, score = search_block(queries, probes, vectors, largest, signs, k, query_ids, ids)
            return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[v]), pa.array(score)], names=["query_id", "vec_id", "score"])

        ids, parts, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column("vec_id").to_numpy())
            parts.append(batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1))
            held += batch.num_rows
            if held >= BLOCK_ROWS:
                yield run(np.concatenate(ids), np.concatenate(parts))
                ids, parts, held = [], [], 0
        if held:
            yield run(np.concatenate(ids), np.concatenate(parts))

    return search
