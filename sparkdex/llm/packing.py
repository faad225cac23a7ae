"""Packing: length combinations with repeat counts by non-negative least squares, and a greedy rest.

Every document is cut into full windows and one tail. The histogram of all tails (at most window - 1 lengths)
decides the recipe: shallow combinations of lengths that fill a window, whose repeat counts are the solution of
a non-negative least squares problem against the histogram. Each block of documents applies its share of the
recipe to its own tails. A share is rounded up or down by a number that depends on the block and the combination,
so that over all blocks the rounded counts add up to the recipe's, however small the blocks are. The residual is
packed greedily: by the recipe's combinations as long as their lengths are there, then longest first, cutting a
tail where a window is full. The end of that rest is cut into powers of two, which take no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, scratch
from .tokens import encoder

BLOCK_IDS = 1 << 22
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
STORE_SCHEMA = "doc_id long, ids binary, tail int"
STORE_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("tail", pa.int32())])


def combinations(histogram: np.ndarray, window: int, most: int = 3000) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths that sum to the window: all pairs, and for each of the commonest
    lengths the triples with the commonest partners. Their number is bounded by the window and ``most``."""
    there = [k for k in range(1, window) if histogram[k] > 0]
    found = [(k, window - k) for k in there if k <= window - k and histogram[window - k] > 0]
    common = sorted(there, key=lambda k: (-histogram[k], k))[:120]
    triples = {}
    for i, a in enumerate(common):
        for b in common[i:]:
            c = window - a - b
            if c >= 1 and histogram[c] > 0:
                triples[tuple(sorted((a, b, c)))] = min(histogram[a], histogram[b], histogram[c])
    found += [t for t, _ in sorted(triples.items(), key=lambda x: (-x[1], x[0]))[:most]]
    return found


def nnls(columns: list[dict[int, int]], target: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """min ||A x - target||, x >= 0, by coordinate descent over sparse columns."""
    x, left = np.zeros(len(columns)), target.astype(float).copy()
    norms = [sum(v * v for v in c.values()) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            new = max(0.0, x[j] + sum(v * left[k] for k, v in c.items()) / norms[j])
            step = new - x[j]
            if step:
                for k, v in c.items():
                    left[k] -= step * v
                x[j] = new
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def recipe_of(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], float]]:
    """Combinations and their repeat counts against the histogram of the whole corpus."""
    found = combinations(histogram, window)
    columns = []
    for combo in found:
        c: dict[int, int] = defaultdict(int)
        for k in combo:
            c[k] += 1
        columns.append(dict(c))
    x = nnls(columns, histogram)
    return [(combo, float(v)) for combo, v in zip(found, x, strict=True) if v > 1e-6]


def pack_block(lengths: np.ndarray, recipe, share: float, window: int, seed: int = 0) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of a block's documents, sequences from 0; and how many
    sequences follow a combination of the recipe."""
    out, sequence = [], 0
    have: dict[int, list[int]] = defaultdict(list)
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - window + 1, window):
            out.append((d, start, window, sequence, 0))
            sequence += 1
        if n % window:
            have[n % window].append(d)
    full = sequence
    rounding = np.random.default_rng(seed).random(len(recipe)).tolist()
    order = sorted(range(len(recipe)), key=lambda i: -recipe[i][1])
    planned = [(recipe[i][0], int(recipe[i][1] * share + rounding[i])) for i in order]
    for combo, most in planned + [(recipe[i][0], len(lengths)) for i in order]:
        if not most or not all(have.get(k) for k in combo):
            continue
        repeat = min([most, *(len(have[k]) // combo.count(k) for k in set(combo))])
        for _ in range(repeat):
            offset = 0
            for k in combo:
                d = have[k].pop()
                out.append((d, int(lengths[d]) - k, k, sequence, offset))
                offset += k
            sequence += 1
    combined = sequence - full
    # longest first: a whole tail where one fills what is left, else the next, cut
    have = {k: ds for k, ds in have.items() if ds}
    order = sorted(have)
    total = sum(k * len(ds) for k, ds in have.items())
    rest, cuts = total % window, []
    while rest:  # the end, in powers of two
        cuts.append(1 << (rest.bit_length() - 1))
        rest -= cuts[-1]
    sizes = iter([window] * (total // window) + cuts)
    room, offset = next(sizes, 0), 0
    while order:
        k = room - offset if offset and have.get(room - offset) else order[-1]
        if not have[k]:
            order.pop()
            continue
        d = have[k].pop()
        start = int(lengths[d]) - k
        while k:
            take = min(k, room - offset)
            out.append((d, start, take, sequence, offset))
            start, k, offset = start + take, k - take, offset + take
            if offset == room:
                sequence, offset, room = sequence + 1, 0, next(sizes, 0)
    return out, combined


def store_ids(docs: DataFrame, tokenizer: str, window: int, end: int, path: str) -> None:
    def encode(batches):
        ids_of = encoder(tokenizer).ids
        for batch in batches:
            ids = [ids_of(t, end) for t in batch.column("text").to_pylist()]
            tails = pa.array([len(x) % window for x in ids], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), tails], schema=STORE_ARROW)

    documents(docs).mapInArrow(encode, STORE_SCHEMA).write.option("compression", "zstd").parquet(path)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    One row per piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens (with the end
    id), sequence_id, offset. Null and empty texts have the end id alone; null ids and repeated rows are
    documents of their own; other columns are ignored. Sequence ids are unique, not gapless: the block's number
    stands above 32 bits. Only a histogram of tails (window - 1 rows) comes to the driver, no row is shuffled,
    and a block of at most about BLOCK_IDS ids, or one document, is in memory at a time.
    """
    spark = docs.sparkSession
    path = scratch(spark, "packing-ids")
    store_ids(docs, tokenizer, window, end, path)
    ids = spark.read.schema(STORE_SCHEMA).parquet(path)
    histogram = np.zeros(window, np.int64)
    for r in ids.where("tail > 0").groupBy("tail").count().collect():
        histogram[r["tail"]] = r["count"]
    recipe, tails = recipe_of(histogram, window), max(1, int(histogram.sum()))

    def pack(batches):
        task, block = TaskContext.get().partitionId(), 0

        def flush():
            lengths = np.array([len(x) for x in held])
            pieces, _ = pack_block(lengths, recipe, int((lengths % window > 0).sum()) / tails, window, (task << 20) + block)
            d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            crc = [zlib.crc32(held[i][a : a + n].astype("<u4").tobytes()) for i, a, n in zip(d, start, length, strict=True)]
            doc_ids = pa.array(names, pa.int64()).take(pa.array(d))
            above = (np.int64(task) << 44) | (np.int64(block) << 32)
            return pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, (start, length, np.array(crc, np.int64), lengths[d], sequence + above, offset))], schema=ARROW)

        names, held, size = [], [], 0
        for batch in batches:
            for doc, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                names.append(doc)
                held.append(np.frombuffer(x, "<u2"))
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield flush()
                    names, held, size, block = [], [], 0, block + 1
        if names:
            yield flush()

    return ids.select("doc_id", "ids").mapInArrow(pack, SCHEMA)
