"""Suffix dedup: remove what repeats a string of 50 bytes of an earlier document, one bucket of suffixes at a time.

Only the first ``width`` bytes of a suffix (a window) matter, so ties are never longer than that.

Cover sample. Every window contains one sampled position, chosen by its content: of the hashes of its TMER-byte
strings the least is taken, and its place modulo STEP gives the sample (a mod-minimiser). Equal windows so have
equal samples at equal places, and the sample (about one position in 13) covers all windows, as a difference
cover covers all pairs of suffixes.

Buckets. The ANCHOR bytes at a sample name its suffix bucket. Buckets are dealt to ranges; records travel as arrays,
and a task sorts one range of buckets after the other, so its memory is that of one range. A bucket within a single
document ends there.

Ranks instead of long ties. Samples whose whole surroundings (all bytes that a window through them can have) are
equal form a class, whose rank is its smallest doc_id: in every later document, all windows through the sample
repeat. Only the first members of classes in buckets of several classes compare windows one by one, and these are
sorted in ranges of their hashes in the same way.

Many copies. Before records travel, those of one class (or one window) are put together: the ones of later documents
are decided at once, so each batch sends a class once, however many documents share it. A bucket with many classes in
a batch sends their windows to be compared, and a mark that makes the other batches do so as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, drop, free_shuffles, mix, stored, texts_of

WIDTH, ANCHOR = 50, 32
STEP = WIDTH - ANCHOR + 1
TMER = 13
TMERS = WIDTH - TMER + 1
CHUNK = 1 << 15
SIDE = WIDTH - ANCHOR
#: Records that are put together before they travel; records that a range is meant to hold, at most.
BATCH, RANGE = 1 << 20, 1 << 21
#: Classes of a bucket in a batch from which on they go on as windows.
MANY = 64
HIGH = np.uint64((1 << 64) - (1 << 24))
BASE = 0x9E3779B97F4A7C15 | 1
VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
FIRST, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
OUT_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    + [("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


class Powers:
    """Powers of BASE modulo 2**64 and of its inverse, as far as they were needed."""

    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int):
        if len(cls.up) <= n:
            size = max(n + 1, CHUNK + 4 * WIDTH)
            up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up, cls.down


class Hashes:
    """Of some bytes: sums of powers modulo 2**64, which choose samples, and every eight bytes as a number."""

    def __init__(self, data: np.ndarray):
        up, self.down = Powers.to(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUES[data] * up[: len(data)], out=self.sums[1:])


def eights(data) -> np.ndarray:
    """The eight bytes from each place on (zeros after the end) as unsigned numbers."""
    padded = bytes(data) + bytes(8)
    return np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))


def hashed(words: np.ndarray, start: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """64-bit hashes of the bytes from start + first to start + last: each word is mixed in by a product and a shift."""
    h = np.full(len(start), np.uint64(seed * BASE & 0xFFFFFFFFFFFFFFFF))
    for at in [*range(first, last - 8, 8), last - 8]:
        h ^= words[start + at]
        h *= np.uint64(BASE)
        h ^= h >> np.uint64(32)
    return mix(h)


def samples(h: Hashes) -> np.ndarray:
    """Of every window, where its sample is."""
    n = len(h.sums) - TMER
    t = h.sums[TMER:] - h.sums[:n]
    t *= h.down[:n]
    t &= HIGH  # the high bits of such a sum depend on all its bytes
    places = np.arange(n, dtype=np.uint64)
    t |= places
    width = 1
    while width * 2 <= TMERS:
        np.minimum(t[: n - width], t[width:n], out=t[: n - width])
        n -= width
        width *= 2
    rest = TMERS - width
    at = np.minimum(t[: n - rest], t[rest:n])
    at &= ~HIGH
    at = at.view(np.int64)
    i = places[: len(at)].view(np.int64)
    at -= i
    at %= STEP
    at += i
    return at


def segments(texts: list[bytes | None]):
    """(document, first byte, bytes, first window, end of windows), of at most about CHUNK windows each."""
    for d, text in enumerate(texts):
        windows = len(text or b"") - WIDTH + 1
        for a in range(0, windows, CHUNK):
            b = min(windows, a + CHUNK)
            low = max(0, a - SIDE)
            yield d, low, text[low : b + WIDTH + STEP + SIDE], a, b


def chunks(texts: list[bytes | None]):
    held, size = [], 0
    for s in segments(texts):
        held.append(s)
        size += len(s[2])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def sampled(texts: list[bytes | None]):
    """Per chunk: document, place, mask of windows (bit j: the window j bytes before), bucket and class of each sample."""
    for held in chunks(texts):
        joined = b"".join(s[2] for s in held)
        data = np.frombuffer(joined, np.uint8)
        at, words = samples(Hashes(data)), eights(joined)
        own = np.full(len(at), -1, np.int64)
        base, bounds = 0, []
        for d, low, part, a, b in held:
            own[base + a - low : base + b - low] = at[base + a - low : base + b - low]
            bounds.append((base, d, low - base, base - low, base - low + len(texts[d])))
            base += len(part)
        starts, docs, shifts, firsts, lasts = np.array(bounds).T
        marked = np.zeros(len(data), bool)
        marked[own[own >= 0]] = True
        p = np.flatnonzero(marked)
        part = np.searchsorted(starts, p, "right") - 1
        mask = np.zeros(len(p), np.int64)
        for j in range(STEP):
            i = p - j
            ok = (i >= 0) & (i < len(own))
            mask[ok] |= (own[i[ok]] == p[ok]).astype(np.int64) << j
        low, high = np.maximum(p - SIDE, firsts[part]), np.minimum(p + WIDTH, lasts[part])
        around = np.empty(len(p), np.uint64)
        inner = (low == p - SIDE) & (high == p + WIDTH)
        around[inner] = hashed(words, p[inner], -SIDE, WIDTH, 1)
        for i in np.flatnonzero(~inner).tolist():  # at an end of a text
            around[i] = xxhash.xxh3_64_intdigest(joined[low[i] : high[i]], seed=int(p[i] - low[i]) * 64 + int(high[i] - p[i]))
        yield docs[part], p + shifts[part], mask, hashed(words, p, 0, ANCHOR, 2), around


def windows_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of samples, and which sample each comes from."""
    bits = ((place[:, None] >> np.arange(STEP)) & 1).astype(bool)
    row, j = np.nonzero(bits)
    return (place >> STEP)[row] - j, row


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A value of each run, for all its members."""
    return np.repeat(values, np.diff(np.r_[starts, n]))


#: The first key keeps so many bits; the columns of a packed record.
KEY_BITS = 48
PACKED = (("k1", "<u4"), ("k1", "<u2"), ("k2", "<u8"), ("doc", "<i8"), ("h", "<i8"), ("place", "<i4"), ("place", "<i4"))
PACKED_SIZE = sum(np.dtype(t).itemsize for _, t in PACKED)


class Records:
    """Arrays of one length: two keys (unsigned, the first of KEY_BITS), doc and h of a row, and a place."""

    def __init__(self, k1, k2, doc, h, place):
        self.columns = [k1.astype(np.uint64), k2.astype(np.uint64), *(np.asarray(x, np.int64) for x in (doc, h, place))]
        self.k1, self.k2, self.doc, self.h, self.place = self.columns

    def __len__(self) -> int:
        return len(self.k1)

    def at(self, rows) -> Records:
        return Records(*(c[rows] for c in self.columns))

    @classmethod
    def joined(cls, parts: list[Records]) -> Records:
        return cls(*(np.concatenate(c) for c in zip(*(p.columns for p in parts), strict=True)))

    def to_bytes(self) -> bytes:
        """Column by column, compressed; ids and places as differences, since records come in the order of texts."""
        less = lambda x: np.diff(x, prepend=x.dtype.type(0))
        parts = (self.k1 >> np.uint64(16), self.k1 & np.uint64(0xFFFF), self.k2, less(self.doc), less(self.h), less(self.place >> STEP), self.place & ((1 << STEP) - 1))
        return zstandard.compress(b"".join(x.astype(t).tobytes() for x, (_, t) in zip(parts, PACKED, strict=True)), 1)

    @classmethod
    def from_bytes(cls, packed) -> Records:
        data = zstandard.decompress(packed)
        n, at, x = len(data) // PACKED_SIZE, 0, []
        for _, t in PACKED:
            x.append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
        high, low, k2, doc, h, place, mask = x
        return cls((high.astype(np.uint64) << np.uint64(16)) | low, k2, np.cumsum(doc), np.cumsum(h), (np.cumsum(place.astype(np.int64)) << STEP) | mask)

    def by_class(self) -> tuple[np.ndarray, Records, np.ndarray]:
        """An order by class (k1, k2); the records in it; and the smallest doc of each one's class."""
        order = np.argsort(self.k1 ^ mix(self.k2), kind="stable")
        own = self.at(order)
        starts = runs(own.k1, own.k2)
        least = np.minimum.reduceat(own.doc, starts) if len(own) else own.doc
        return order, own, spread(least, starts, len(own))


MOVED = "range int, data binary, doc long, h long, places array<long>, compare boolean"
MOVED_ARROW = pa.schema([("range", pa.int32()), ("data", pa.binary()), ("doc", pa.int64()), ("h", pa.int64()), ("places", pa.list_(pa.int64())), ("compare", pa.bool_())])


def sent(r: Records, ranges: int) -> pa.RecordBatch:
    """A row for each range of first keys that there are records of."""
    part = (r.k1 >> np.uint64(KEY_BITS - 32)).astype(np.int64) % ranges
    order = np.argsort(part, kind="stable")
    starts = runs(part[order])
    rows = [order[a:b] for a, b in zip(starts, np.r_[starts[1:], len(r)], strict=True)]
    data = pa.array([r.at(x).to_bytes() for x in rows], pa.binary())
    none = [pa.nulls(len(rows), f.type) for f in list(MOVED_ARROW)[2:]]
    return pa.RecordBatch.from_arrays([pa.array(part[[x[0] for x in rows]].astype(np.int32) if rows else [], pa.int32()), data, *none], schema=MOVED_ARROW)


def decided(r: Records, compare: bool, ranges: int) -> pa.RecordBatch:
    """A row for each document: places whose windows repeat, or are to be compared."""
    own = r.at(np.lexsort((r.h, r.doc)))
    starts = runs(own.doc, own.h)
    places = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(own)].astype(np.int32)), pa.array(own.place))
    doc = own.doc[starts]
    part = (mix(doc.view(np.uint64)) % np.uint64(ranges)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(doc), pa.binary()), pa.array(doc), pa.array(own.h[starts]), places, pa.array(np.full(len(doc), compare))], schema=MOVED_ARROW)


def combined_samples(r: Records, ranges: int):
    """Rows for a batch of samples: one document of each class travels."""
    order, own, least = r.by_class()
    yield decided(own.at(own.doc > least), False, ranges)
    kept = own.doc == least
    one = own.k1[kept][runs(own.k1[kept], own.k2[kept])]
    buckets, classes = np.unique(one, return_counts=True)
    many = buckets[classes > MANY]
    if len(many):
        apart = kept & np.isin(own.k1, many)
        yield decided(own.at(apart), True, ranges)
        kept &= ~apart
        n = len(many)
        yield sent(Records(np.repeat(many, 2), np.tile(np.array([0, 1], np.uint64), n), np.tile([FIRST, LAST], n), np.zeros(2 * n), np.full(2 * n, -1)), ranges)
    yield sent(r.at(np.sort(order[kept])), ranges)


def sorted_samples(r: Records, ranges: int):
    """Rows for all samples of a range of buckets."""
    own = r.at(np.argsort(r.k1, kind="stable"))
    starts = runs(own.k1)
    low, high = np.minimum.reduceat(own.doc, starts), np.maximum.reduceat(own.doc, starts)
    mixed = np.minimum.reduceat(own.k2, starts) != np.maximum.reduceat(own.k2, starts)
    shared, mixed, low = (spread(x, starts, len(own)) for x in (low < high, mixed, low))
    real = own.place >= 0
    yield decided(own.at(shared & ~mixed & (own.doc > low)), False, ranges)
    _, own, least = own.at(shared & mixed & real).by_class()
    yield decided(own.at(own.doc > least), False, ranges)
    yield decided(own.at(own.doc == least), True, ranges)


def combined_windows(r: Records, ranges: int):
    """Rows for a batch of windows: each travels by its first document there."""
    order, own, least = r.by_class()
    yield decided(own.at(own.doc > least), False, ranges)
    yield sent(r.at(np.sort(order[own.doc == least])), ranges)


def sorted_windows(r: Records, ranges: int):
    _, own, least = r.by_class()
    yield decided(own.at(own.doc > least), False, ranges)


def moved(rows: DataFrame, records, combine, sort, ranges: int, name: str) -> tuple[DataFrame, str]:
    """The records of rows, put together in batches, dealt by range, each range sorted alone; and the table's path."""

    def first(batches):
        held, size = [], 0
        for batch in batches:
            for r in records(batch):
                held.append(r)
                size += len(r)
                if size >= BATCH:
                    yield from combine(Records.joined(held), ranges)
                    held, size = [], 0
        if size:
            yield from combine(Records.joined(held), ranges)

    def second(batches):
        held, now = [], None
        for batch in batches:
            there = batch.column("data").is_valid()
            done = batch.filter(pa.array(np.logical_not(there.to_numpy(zero_copy_only=False))))
            if done.num_rows:
                yield done
            own = batch.filter(there)
            for k, data in zip(own.column("range").to_pylist(), own.column("data"), strict=True):
                if k != now:
                    if held:
                        yield from sort(Records.joined(held), ranges)
                    held, now = [], k
                held.append(Records.from_bytes(data.as_buffer().to_pybytes()))
        if held:
            yield from sort(Records.joined(held), ranges)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(first, MOVED).repartition(parts, "range").sortWithinPartitions("range")
    out = stored(dealt.mapInArrow(second, MOVED).select("doc", "h", "places", "compare"), name)
    del dealt, rows
    free_shuffles(out[0].sparkSession)
    return out


def sample_records(batch: pa.RecordBatch):
    ids, hs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "h"))
    for doc, p, mask, bucket, around in sampled(texts_of(batch)):
        yield Records(bucket >> np.uint64(64 - KEY_BITS), around, ids[doc], hs[doc], (p << STEP) | mask)


def window_records(batch: pa.RecordBatch):
    """The windows of the places of each text, by two hashes."""
    for doc, h, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), texts_of(batch), batch.column("places"), strict=True):
        start = np.unique(windows_of(places.values.to_numpy())[0])
        for a in range(0, len(text), 8 * CHUNK):  # a long text stretch by stretch
            own = start[slice(*np.searchsorted(start, (a, a + 8 * CHUNK)))]
            if len(own):
                words = eights(text[a : a + 8 * CHUNK + WIDTH])
                yield Records(hashed(words, own - a, 0, WIDTH, 3) >> np.uint64(64 - KEY_BITS), hashed(words, own - a, 0, WIDTH, 4), np.full(len(own), doc), np.full(len(own), h), (own << STEP) | 1)


def removal_spans(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows at the starts cover."""
    if not len(starts):
        return starts, starts
    s = np.unique(starts)
    new = np.r_[True, s[1:] > s[:-1] + WIDTH]
    return s[new], s[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]] + WIDTH


def dedup_substrings(docs: DataFrame, ranges: int = 1) -> DataFrame:
    """Bytes of every document that a string of WIDTH bytes covers which also starts in a document of smaller id.

    One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    remaining bytes), spans (start, end in bytes). Strings are judged on the input. Null and empty texts have 0
    bytes and the hash of nothing; texts under WIDTH bytes lose nothing. Rows with a null doc_id neither lose nor
    cause anything; rows of one doc_id don't act on each other. Other columns are ignored.

    Windows are told apart by 112 bits of two hashes, and so are surroundings (48 of them over their ANCHOR bytes).
    There are at least ``ranges`` ranges of buckets, and as many as the tasks or the size ask for. Memory of a task:
    BATCH records, those of a range, and the longest text.
    """
    spark = docs.sparkSession
    texts = documents(docs)
    facts = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    most, size = facts.where("doc_id is not null").agg(F.max("n"), F.sum("bytes")).first()
    texts = texts.withColumn("h", F.xxhash64("text") if (most or 0) > 1 else F.lit(0).cast("long"))
    known = texts.where("doc_id is not null and text is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(ranges, 8 * parts, (size or 0) // (10 * RANGE))

    found, found_path = moved(known, sample_records, combined_samples, sorted_samples, ranges, "samples")
    own = found.where("compare").groupBy(F.col("doc").alias("doc_id"), "h").agg(F.flatten(F.collect_list("places")).alias("places"))
    free_shuffles(spark)
    hits, hits_path = moved(known.join(own, ["doc_id", "h"]).select("doc_id", "h", "text", "places"), window_records, combined_windows, sorted_windows, ranges, "windows")
    free_shuffles(spark)
    covered = found.where("not compare").unionByName(hits.where("not compare")).groupBy(F.col("doc").alias("doc_id"), "h").agg(F.flatten(F.collect_list("places")).alias("places"))

    def remove(batches):
        for batch in batches:
            rows = []
            for doc, text, places in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("places"), strict=True):
                text = text or b""
                start, end = removal_spans(windows_of(places.values.to_numpy())[0] if places.is_valid else np.zeros(0, np.int64))
                digest, at = hashlib.sha256(), 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                spans = [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                rows.append({"doc_id": doc, "n_bytes": len(text), "n_removed": int((end - start).sum()), "n_spans": len(start), "kept_sha256": digest.hexdigest(), "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, schema=OUT_ARROW)

    out, _ = stored(texts.join(covered, ["doc_id", "h"], "left").select("doc_id", "text", "places").mapInArrow(remove, OUT), "kept")
    drop(spark, found_path, hits_path)
    return out
