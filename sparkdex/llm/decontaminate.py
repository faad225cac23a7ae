"""Benchmark decontamination: an FM-index per training shard, searched backwards for test phrases.

A window of a benchmark item consists of words of the benchmark only. So a shard's sequence keeps the
maximal runs of such words that are as long as the shortest window, each run ended by a separator; every
occurrence lies within a run. Over that sequence a suffix array gives the Burrows-Wheeler transform, a
wavelet matrix its ranks, and every SAMPLE-th text position its row, by which occurrences are located.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, documents, map_arrow, stored, texts_of

SAMPLE = 16
SHARD_WORDS = 1 << 20
ITEM_BLOCK_BYTES = 8 << 20
SCHEMA = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "spans array<struct<first:long,last:long>>"
)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By prefix doubling; only rows whose rank isn't settled are sorted again."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(rank[order]) > 0])
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    step = 1
    while step < n:
        head = np.flatnonzero(np.r_[True, np.diff(rank[order]) > 0])
        sizes = np.diff(np.r_[head, n])
        if (sizes == 1).all():
            break
        at = np.flatnonzero(np.repeat(sizes > 1, sizes))
        rows = order[at]
        second = np.full(len(rows), -1, np.int64)
        inside = rows + step < n
        second[inside] = rank[rows[inside] + step]
        first = rank[rows]
        by = np.lexsort((second, first))
        rows, first, second = rows[by], first[by], second[by]
        order[at] = rows
        new = np.r_[True, (np.diff(first) != 0) | (np.diff(second) != 0)]
        rank[rows] = at[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        step *= 2
    return order


class Bits:
    """Bits with constant-time ranks over packed words."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class Wavelet:
    """A wavelet matrix: rank of a symbol in a prefix, for whole arrays of questions."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = []
        for b in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((seq >> b) & 1).astype(np.uint8)
            zeros = int(len(bits) - bits.sum())
            self.levels.append((b, Bits(bits), zeros))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.start[c]


class FmIndex:
    def __init__(self, seq: np.ndarray, symbols: int):
        """seq: symbols from 1; 0 ends the text."""
        text = np.r_[seq, 0].astype(np.int64)
        rows = suffix_array(text)
        self.n = len(text)
        self.bwt = text[rows - 1]
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))][:-1]
        self.wavelet = Wavelet(self.bwt, symbols)
        sampled = rows % SAMPLE == 0
        self.marks, self.sampled, self.places = Bits(sampled.astype(np.uint8)), sampled, rows[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            low[live] = self.less[c] + self.wavelet.rank(c, low[live])
            high[live] = self.less[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions, by stepping back to a sampled one."""
        found, steps, open_ = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self.sampled[rows[open_]]
            hit = open_[done]
            found[hit] = self.places[self.marks.rank(rows[hit])] + steps
            open_ = open_[~done]
            c = self.bwt[rows[open_]]
            rows[open_] = self.less[c] + self.wavelet.rank(c, rows[open_])
            steps += 1
        return found


def compile_items(items: list[tuple[str, bytes]], n: int) -> dict:
    """Vocabulary (symbols from 2), distinct windows by length, and the items of each window."""
    vocab: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, text in items:
        ids = [vocab.setdefault(w, len(vocab) + 2) for w in ascii_words(text)]
        for i in range(max(1, len(ids) - n + 1) if ids else 0):
            owners[tuple(ids[i : i + n])].add(item)
    by: dict[int, list] = defaultdict(list)
    for w in owners:
        by[len(w)].append(w)
    return {
        "vocab": vocab,
        "shortest": min(by, default=0),
        "windows": [(k, np.array(w, np.int64), [sorted(owners[x]) for x in w]) for k, w in sorted(by.items())],
    }


def search_shard(words: list[np.ndarray], block: dict) -> dict[int, tuple[list, set]]:
    """words: each document's symbols, 0 for words that no item has. Document -> spans (first, end), items."""
    kept, docs, places = [], [], []
    for d, ids in enumerate(words):
        edge = np.diff(np.r_[0, (ids > 0).astype(np.int8), 0])
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if b - a >= block["shortest"]:
                kept += [ids[a:b], [1]]
                docs.append(np.full(b - a + 1, d))
                places.append(np.arange(a, b + 1))
    if not kept:
        return {}
    index, doc, place = FmIndex(np.concatenate(kept), len(block["vocab"]) + 2), np.concatenate(docs), np.concatenate(places)
    found: dict[int, tuple[list, set]] = defaultdict(lambda: ([], set()))
    for k, phrases, owners in block["windows"]:
        low, high = index.search(phrases)
        hit = np.flatnonzero(high > low)
        sizes = (high - low)[hit]
        rows = np.repeat(low[hit] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        at = index.locate(rows)
        for w, p in zip(np.repeat(hit, sizes).tolist(), at.tolist(), strict=True):
            spans, items = found[int(doc[p])]
            spans.append((int(place[p]), int(place[p]) + k))
            items.update(owners[w])
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2) -> DataFrame:
    """Mark the words of documents that lie in windows of n words of benchmark items.

    A window: n consecutive words of an item, all of them if it has fewer. One row per row of ``docs``:
    doc_id, n_words, n_hit, n_items (items with occurring windows), items_sha256 (their ids as strings,
    sorted, comma-joined), contaminated (n_items >= min_items), spans (merged removal spans, in words,
    end exclusive). Null and empty texts have no words and no hits; items without words or without an id
    match nothing; repeated item ids count once; repeated documents each get a row; other columns are
    ignored. The benchmark reaches the executors in blocks of about ITEM_BLOCK_BYTES, one after the other: only one
    is on the driver and broadcast at a time, and what it finds is stored. A shard's index covers about SHARD_WORDS
    words, so memory is bounded by these and by the longest document.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id is not null and text is not null"
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BLOCK_BYTES) or 1
    rows = documents(docs).withColumn("row", F.monotonically_increasing_id() if blocks > 1 else F.lit(0).cast("long"))
    if blocks > 1:
        rows, _ = stored(rows, "numbered-texts")

    def summary(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spans, own = merged([(x["first"], x["last"]) for x in r["spans"]]), sorted(set(r["items"]))
                digest = hashlib.sha256(",".join(own).encode()).hexdigest()
                spans_ = [{"first": a, "last": b} for a, b in spans]
                out.append({"doc_id": r["doc_id"], "n_words": r["n_words"], "n_hit": sum(b - a for a, b in spans), "n_items": len(own), "items_sha256": digest, "contaminated": len(own) >= min_items, "spans": spans_})
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    parts = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in own])
        search = searcher(shared, n)
        if blocks == 1:  # in one pass: a second one would take a second Python worker for each core
            return map_arrow(rows, lambda batches: summary(search(batches)), SCHEMA)
        part, _ = stored(map_arrow(rows, search, FOUND_SCHEMA), "benchmark-hits")
        shared.destroy()
        parts.append(part)
    found = reduce(DataFrame.unionByName, parts)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]
    found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists)
    return map_arrow(found.select("doc_id", "n_words", "spans", "items"), summary, SCHEMA)


FOUND_SCHEMA = "row long, doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
FOUND_ARROW = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))]
)


def searcher(shared, n: int):
    """Shards of documents, searched for one block of the benchmark."""

    def run(batches):
        block = compile_items(shared.value, n)
        get = block["vocab"].get

        def shard(keys, texts):
            hits = search_shard([np.array([get(w, 0) for w in words], np.int64) for words in texts], block) if block["shortest"] else {}
            out = []
            for d, ((row, doc), words) in enumerate(zip(keys, texts, strict=True)):
                spans, items = hits.get(d, ((), ()))
                out.append({"row": row, "doc_id": doc, "n_words": len(words), "spans": [{"first": a, "last": b} for a, b in spans], "items": list(items)})
            return pa.RecordBatch.from_pylist(out, schema=FOUND_ARROW)

        keys, texts, held = [], [], 0
        for batch in batches:
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                keys.append((row, doc))
                texts.append(ascii_words(text))
                held += len(texts[-1]) + 1
                if held >= SHARD_WORDS:
                    yield shard(keys, texts)
                    keys, texts, held = [], [], 0
        if keys:
            yield shard(keys, texts)

    return run


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ]
)
