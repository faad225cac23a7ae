"""Token-id files: Simple-8b words in blocks, decoded by whole arrays.

A 64-bit word's top four bits select how many ids of which width the other 60 hold. Ids are first replaced by
their rank of frequency within the block, so that frequent ids are narrow; the block keeps the ids in that
order. A rank that is wider than ESCAPE_FROM bits is written as the escape rank 0 in the words, and in full in
the block's list of escapes; other ranks are written plus one.

A file is a Parquet part with a row for each block (what a block is cut to is below), so that any of Spark's
file systems holds it, a lost task leaves nothing behind, and readers take any block alone:

    shard long, block long           place in the file set
    doc_ids binary, n_tokens binary  int64 and uint32, little-endian: the documents, in order
    words binary                     uint64 Simple-8b words
    dictionary binary                uint32 ids by rank
    escapes binary                   uint32 ranks
    offsets binary                   uint32: number of ids before every FRAME-th word
    null_ids binary                  1 for a document whose doc_id is null
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch
from .tokens import encoder

#: Ids in a word and the width of each, by selector.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([n for n, _ in SELECTORS])
#: Bits of each number below 2**13.
WIDTHS = np.array([k.bit_length() for k in range(1 << 13)], np.uint8)
ESCAPE_FROM = 12
FRAME = 64
BLOCK_IDS = 1 << 16
FILE_SCHEMA = "shard long, block long, first long, doc_ids binary, null_ids binary, n_tokens binary, total long, words binary, dictionary binary, escapes binary, offsets binary"
FILE_ARROW = pa.schema(
    [("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.binary()), ("null_ids", pa.binary()), ("n_tokens", pa.binary()), ("total", pa.int64())]
    + [(c, pa.binary()) for c in ("words", "dictionary", "escapes", "offsets")]
)
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of values below 2**60, each with as many values as fit, of zeros above all.

    The greedy choice at a position depends on what follows only, so it is made for all positions at once;
    the words are then the positions that are reached from the first.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    v = values.astype(np.uint64)
    if v.max() < len(WIDTHS):
        widths = WIDTHS[v.astype(np.int64)]
    else:
        widths, left = np.zeros(n, np.uint8), v.copy()
        while left.any():
            widths += left > 0
            left >>= np.uint64(1)
    # widest[p][i]: the largest width from i on, of p (a power of two) values
    widest, p = {1: widths}, 1
    while 2 * p <= min(n, COUNTS[0]):
        widest[2 * p] = np.maximum(widest[p][: n - 2 * p + 1], widest[p][p:])
        p *= 2
    choice = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):
        count, width = SELECTORS[s]
        if count > n:
            continue
        p = 1 << (count.bit_length() - 1)
        wide = np.maximum(widest[p][: n - count + 1], widest[p][count - p : n - p + 1])
        np.copyto(choice[: n - count + 1], np.uint8(s), where=wide <= width)
    steps, at, starts = COUNTS[choice].tolist(), 0, []
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s)
        if width and len(own):
            at, made = starts[own], words[own]
            for k in range(count):
                made |= v[at + k] << np.uint64(k * width)
            words[own] = made
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """All values of the words: for each selector, its words at once."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    sizes = COUNTS[selector]
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(selector == s)
        if width and len(own):
            mask = np.uint64((1 << width) - 1)
            for k in range(count):
                out[starts[own] + k] = (words[own] >> np.uint64(k * width)) & mask
    return out


def encode_block(ids: np.ndarray) -> dict[str, bytes]:
    n = np.bincount(ids, minlength=1)  # as long as the vocabulary
    seen = np.flatnonzero(n)
    order = np.argsort(-n[seen], kind="stable")
    rank = np.zeros(len(n), np.int64)
    rank[seen[order]] = np.arange(len(order))
    ranks = rank[ids]
    escaped = ranks + 1 >= 1 << ESCAPE_FROM
    words = pack(np.where(escaped, 0, ranks + 1))
    sizes = COUNTS[(words >> np.uint64(60)).astype(np.int64)]
    return {
        "words": words.astype("<u8").tobytes(),
        "dictionary": seen[order].astype("<u4").tobytes(),
        "escapes": ranks[escaped].astype("<u4").tobytes(),
        "offsets": (np.cumsum(sizes) - sizes)[::FRAME].astype("<u4").tobytes(),
    }


def decode_block(words: bytes, dictionary: bytes, escapes: bytes, n: int) -> np.ndarray:
    """The block's ids as uint32."""
    values = unpack(np.frombuffer(words, "<u8"))[:n].astype(np.int64) - 1
    escaped = values < 0
    values[escaped] = np.frombuffer(escapes, "<u4")
    return np.frombuffer(dictionary, "<u4")[values]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end: int = 2, shard_bytes: int = 32 << 20) -> None:
    """Encode every text and write the token files in ascending doc_id order (null ids first, then by text)."""
    texts = documents(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    ordered = texts.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def encode(batches):
        ids_of = encoder(tokenizer).ids
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs_, parts, held = [], [], 0

        def flush():
            ids = np.concatenate(parts)
            made = encode_block(ids)
            null = np.array([d is None for d in docs_], np.uint8)
            row = {"shard": shard, "block": block, "first": first, "null_ids": null.tobytes(), "total": len(ids)}
            row["doc_ids"] = np.array([d or 0 for d in docs_], "<i8").tobytes()
            row["n_tokens"] = np.array([len(p) for p in parts], "<u4").tobytes()
            return pa.RecordBatch.from_pylist([row | made], schema=FILE_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                docs_.append(doc)
                parts.append(ids_of(text, end))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    docs_, parts, first, block, held = [], [], first + held, block + 1, 0
        if docs_:
            yield flush()

    ordered.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard. A row for each shard comes to the driver: their number is the size over shard_bytes."""
    rows = sorted(spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("shard").agg(F.sum("total").alias("n")).collect())
    starts, at = {}, 0
    for r in rows:
        starts[r.shard] = at
        at += r.n
    return starts


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """From the files, per document: doc_id, start (ids of all documents before it), n_tokens (with the end id),
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    starts = shard_starts(spark, path)

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n_tokens"], "<u4").astype(np.int64)
                ids = decode_block(row["words"], row["dictionary"], row["escapes"], int(n.sum()))
                before = np.cumsum(n) - n
                crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(before, n, strict=True)]
                null = np.frombuffer(row["null_ids"], np.uint8).astype(bool)
                doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(before + row["first"] + starts[row["shard"]]), pa.array(n), pa.array(np.array(crc, np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(decode, ROW_SCHEMA)


def encode_tokens(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write token files of all documents to the shared folder, and read them back.

    One row per row of ``docs``, as ``read_token_files`` gives them. Null and empty texts have the end id alone.
    Null ids come first; equal ids follow the hash of their text, then the text. Other columns are ignored.
    Blocks are cut between documents, at BLOCK_IDS ids or more, so memory is bounded by these and the longest text.
    """
    spark = docs.sparkSession
    path = scratch(spark, "token-files")
    write_token_files(docs, tokenizer, path, end)
    return read_token_files(spark, path)
