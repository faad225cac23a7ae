"""N-gram Jaccard join: several global orders filter the pairs, and only what passes all of them is compared.

1. Every document's shingles are hashed to 64 bits, and sets are told apart by 128 bits. Equal sets form a class,
   which its smallest id stands for.
2. The zone is the share of the hash space that holds somewhat more of a set than a prefix does. Each order places
   the zone first, by how many sets hold a shingle (the first order by the number itself, the others by coarser
   ranks, each with ties by a hash of its own), then the rest by hash. For a similarity t, a set of n shares one of
   its first n - ceil(t n) + 1 shingles with every set it links to, under each order. A shingle of one set alone is
   shared with none: it fills a place and makes no pair, so most sets end here without a pair.
3. Candidates share a prefix shingle under the first order, meet in the signatures of their prefixes under every
   other, and pass length, position and sketch filters, all of it as the condition of one join. The sketch is the
   parity of a set's members in each of BITS cells: where two sketches differ, the sets do.
4. Leaders first: the sets of a shingle are compared with the smallest of them, which joins most of a group of near
   copies. What is in one component then isn't paired again. Components of all links follow.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, documents, drop, free_shuffles, map_arrow, mix, space_words, stored, texts_of
from .components import components

#: The zone holds this many times a prefix, on average.
ZONE = 1.5
#: Parity cells of a sketch; bits of a prefix's signature; orders beside the first.
BITS, SIGNATURE, MORE_ORDERS = 1024, 128, 2
WORDS_AT_ONCE = 200_000
#: A leader of many sets meets them in so many tasks.
SALTS = 16
FOLD = np.uint64(0xC2B2AE3D27D4EB4F)
SEEDS = np.array([0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64) for k in range(MORE_ORDERS)], np.uint64)


def folded(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words whose hashes are given."""
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * FOLD + h[i : len(h) - k + 1 + i])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def shingles(hashes: WordHashes, words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of the whole sequence if it has fewer words."""
    return distinct(folded(hashes.of(words), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def shingle_sets(hashes: WordHashes, texts: list[bytes | None], n: int, words_of: Callable):
    """The shingles of each text, many texts at a time."""

    def of(held):
        flat = hashes.of(list(chain.from_iterable(held)))
        runs, at = folded(flat, n) if len(flat) >= n else flat[:0], 0
        for words in held:
            yield distinct(runs[at : at + len(words) - n + 1]) if len(words) >= n else shingles(hashes, words, n)
            at += len(words)

    held, size = [], 0
    for text in texts:
        held.append(words_of(text))
        size += len(held[-1])
        if size >= WORDS_AT_ONCE:
            yield from of(held)
            held, size = [], 0
    yield from of(held)


def need(n, percent: int):
    """The least size of an intersection that a set of n needs with anything it links to."""
    return -(-percent * n // 100)


def zone_end(percent: int) -> int:
    """Hashes below it are in the zone; as signed numbers they aren't negative."""
    return int(min(0.49, ZONE * (100 - percent) / 100 + 0.005) * 2**64)


def sketch(s: np.ndarray) -> np.ndarray:
    cells = np.bincount((mix(s) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64), minlength=BITS) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.Array:
    """A column of lists of 64-bit numbers."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))


def profiles(docs: DataFrame, n: int, percent: int, words_of: Callable) -> DataFrame:
    """Of each document: a number of its own (row), the size and key of its set, its shingles in the zone (as many
    more as a prefix needs), how many of them are in it, and its sketch."""
    names = ["doc_id", "row", "size", "k1", "k2", "zone", "low", "sketch"]
    end = np.uint64(zone_end(percent))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, keys, zones, low, sketches = [], [], [], [], []
            for s in shingle_sets(hashes, texts_of(batch), n, words_of):
                zone = int(np.searchsorted(s, end))
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                zones.append(zone)
                low.append(s[: max(zone, len(s) - need(len(s), percent) + 1)])
                sketches.append(sketch(s))
            k1, k2 = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T
            own = [batch.column("doc_id"), batch.column("row"), *(pa.array(np.ascontiguousarray(x, np.int64)) for x in (sizes, k1, k2, zones)), lists(low), lists(sketches)]
            yield pa.RecordBatch.from_arrays(own, names=names)

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return map_arrow(rows, run, ", ".join([*(f"{c} long" for c in names[:6]), "low array<long>", "sketch array<long>"]))


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Of (doc, size, zone, tokens, counts, sketch), tokens being the shingles that several sets hold: the set's prefix
    under the first order without shingles of its own alone, their number, and the signatures of the other prefixes."""
    names = ["doc", "size", "alone", "tokens", *(f"order{k}" for k in range(MORE_ORDERS)), "sketch"]
    end = np.uint64(zone_end(percent))

    def signature(tokens):
        bits = np.zeros(SIGNATURE, np.uint8)
        bits[(mix(tokens) >> np.uint64(64 - (SIGNATURE - 1).bit_length())).astype(np.int64)] = 1
        return np.packbits(bits).view(np.int64)

    def run(batches):
        for batch in batches:
            kept, columns = [], [[] for _ in range(2 + MORE_ORDERS)]
            sizes, zones = batch.column("size").to_numpy(), batch.column("zone").to_numpy()
            for i, (t, c) in enumerate(zip(batch.column("tokens"), batch.column("counts"), strict=True)):
                t, c = t.values.to_numpy().view(np.uint64), c.values.to_numpy()
                outside = t >= end
                alone = int(zones[i]) - int((~outside).sum())
                places = int(sizes[i]) - need(int(sizes[i]), percent) + 1 - alone
                if places <= 0:
                    continue
                kept.append(i)
                # outside the zone only the hash counts
                first = np.lexsort((t, np.where(outside, 0, c), outside))[:places]
                columns[0].append(alone)
                columns[1].append(t[first])
                for k in range(MORE_ORDERS):
                    rank = np.where(outside, 0, np.log2(c).astype(np.int64) >> k)
                    order = np.lexsort((np.where(outside, t, mix(t ^ SEEDS[k])), rank, outside))[:places]
                    columns[2 + k].append(signature(t[order]))
            if kept:
                own = batch.take(pa.array(kept))
                arrays = [own.column("doc"), own.column("size"), pa.array(columns[0], pa.int64()), *map(lists, columns[1:]), own.column("sketch")]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return map_arrow(sets, run, ", ".join(["doc long", "size long", "alone long", *(f"{c} array<long>" for c in names[3:])]))


def shared_prefixes(rows: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """The prefixes of the classes' first members, and the table's path."""
    spark = rows.sparkSession
    sets = rows.join(classes.select("row", F.col("rep").alias("doc")), "row")
    tokens = sets.select("row", F.explode("low").alias("token"))
    several, path = stored(tokens.groupBy("token").agg(F.count("*").alias("count")).where("count > 1"), "shared-shingles")
    held = tokens.join(several.hint("shuffle_hash"), "token").groupBy("row").agg(F.collect_list(F.struct("token", "count")).alias("x"))
    own = sets.select("row", "doc", "size", "zone", "sketch").join(held, "row")
    out = prefixes(own.select("doc", "size", "zone", F.col("x.token").alias("tokens"), F.col("x.count").alias("counts"), "sketch"), percent)
    out = stored(out, "prefixes")
    drop(spark, path)
    free_shuffles(spark)
    return out


def room(a: str, b: str, percent: int):
    """Whether sketches and sizes leave room for a link: where cells differ, so do the sets."""
    apart = sum((F.bit_count(F.col(f"sketch_{a}")[k].bitwiseXOR(F.col(f"sketch_{b}")[k])) for k in range(BITS // 64)), F.lit(0))
    sizes = F.col(f"size_{a}") + F.col(f"size_{b}")
    lengths = 100 * F.least(f"size_{a}", f"size_{b}") >= percent * F.greatest(f"size_{a}", f"size_{b}")
    return lengths & ((100 + percent) * (sizes - apart) >= 2 * percent * sizes)


def meet(a: str, b: str):
    """Whether the prefixes can share a shingle under every order but the first."""
    out = F.lit(True)
    for k in range(MORE_ORDERS):
        out = out & (sum((F.bit_count(F.col(f"order{k}_{a}")[i].bitwiseAND(F.col(f"order{k}_{b}")[i])) for i in range(SIGNATURE // 64)), F.lit(0)) > 0)
    return out


def sided(df: DataFrame, side: str, but: tuple = ()) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in but else f"{c}_{side}") for c in df.columns))


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int, words_of: Callable) -> tuple[DataFrame, str]:
    """Those of the pairs (a, b) whose sets link, and the table's path. Only texts of documents in pairs are read for it."""
    spark = docs.sparkSession
    pairs, pairs_path = stored(pairs, "pairs")
    there = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts, texts_path = stored(docs.join(there, "doc_id", "left_semi"), "pair-texts")
    free_shuffles(spark)

    def run(batches):
        hashes, last, s = WordHashes(), None, None
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column("b").to_pylist(), texts_of(batch, "x"), texts_of(batch, "y"), strict=True):
                if (b, y) != last:
                    last, s = (b, y), shingles(hashes, words_of(y), n)
                t = shingles(hashes, words_of(x), n)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    links, links_path = stored(map_arrow(joined.select("a", "b", "x", "y"), run, "a long, b long"), "links")
    drop(spark, pairs_path, texts_path)
    free_shuffles(spark)
    return links, links_path


def leader_links(sets: DataFrame, known: DataFrame, n: int, percent: int, words_of: Callable) -> tuple[DataFrame, str]:
    """Links of sets with the smallest set that shares their rarest, middle or commonest prefix shingle, and the path."""
    leaders = sets.select("doc", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("doc").alias("doc_b"))
    some = F.array_distinct(F.array(F.element_at("tokens", 1), F.element_at("tokens", -1), F.element_at("tokens", (F.size("tokens") / 2 + 1).cast("int"))))
    stars = sets.select("doc", F.explode(some).alias("token")).join(leaders, "token").where("doc != doc_b").select(F.col("doc").alias("doc_a"), "doc_b").distinct()
    stars = stars.withColumn("salt", F.pmod(F.xxhash64("doc_a"), F.lit(SALTS)).cast("int"))
    facts = sets.select("doc", "size", "sketch")
    own = sided(facts, "b").join(leaders.select("doc_b").distinct(), "doc_b", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = stars.join(sided(facts, "a"), "doc_a").join(own, ["doc_b", "salt"]).where(room("a", "b", percent))
    return verified(near.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct(), known, n, percent, words_of)


def links_between(sets: DataFrame, roots: DataFrame, known: DataFrame, n: int, percent: int, words_of: Callable) -> tuple[DataFrame, str]:
    """All links (a, b) of sets whose roots (node, root; its own where none is given) differ, and the table's path.

    Of the sets of a shingle, those of its most frequent root meet the others alone.
    """
    spark = known.sparkSession
    rooted = sets.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    rooted, rooted_path = stored(rooted, "rooted")
    by_root = rooted.select("root", F.explode("tokens").alias("token")).groupBy("token", "root").count()
    open_ = by_root.groupBy("token").agg(F.max(F.struct("count", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("token", F.col("most.root").alias("most"))
    open_, open_path = stored(open_, "open-shingles")
    facts = rooted.select("doc", "root", "size", "alone", *(f"order{k}" for k in range(MORE_ORDERS)), "sketch", F.posexplode("tokens").alias("pos", "token"))
    facts = facts.join(open_, "token")
    left, right = sided(facts.where("root != most"), "a", ("token",)), sided(facts, "b", ("token",))
    ahead = F.least("pos_a", "pos_b")
    behind = F.least(F.col("size_a") - F.col("alone_a") - F.col("pos_a"), F.col("size_b") - F.col("alone_b") - F.col("pos_b"))
    inside = (F.col("token") >= 0) & (F.col("token") < zone_end(percent))
    enough = ~inside | ((100 + percent) * (ahead + behind) >= percent * (F.col("size_a") + F.col("size_b")))
    once = (F.col("root_b") == F.col("most_b")) | (F.col("doc_a") < F.col("doc_b"))
    pairs = left.join(right, "token").where((F.col("root_a") != F.col("root_b")) & once & enough & room("a", "b", percent) & meet("a", "b"))
    links, links_path = verified(pairs.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct(), known, n, percent, words_of)
    drop(spark, rooted_path, open_path)
    return links, links_path


def jaccard_groups(docs: DataFrame, n: int = 3, percent: int = 90, words_of: Callable = space_words) -> DataFrame:
    """Groups of documents whose sets of n-word shingles link: 100 * intersection >= percent * union.

    One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links). A
    document of fewer than n words has its whole sequence as its one shingle; without words or text it has none
    and links with nothing. A null doc_id links with nothing and has a null component_id. Rows that repeat a
    doc_id are one document with the links of all their texts. Other columns are ignored. The components are exact,
    but not every link is looked for: candidates within a component that earlier links made aren't compared.
    ``jaccard_links`` finds and counts all links. Shingles are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = documents(docs)
    rows, rows_path = stored(profiles(texts, n, percent, words_of), "sets")
    keys = ["k1", "k2", "size"]
    classes, classes_path = stored(first_members(rows), "classes")
    sets, sets_path = shared_prefixes(rows, classes, percent)
    known = texts.where("doc_id is not null")
    links, links_path = leader_links(sets, known, n, percent, words_of)
    # a doc_id with several texts joins their classes
    linked = rows.where("size > 0 and doc_id is not null").select("doc_id", *keys).distinct()
    twice = linked.groupBy("doc_id").count().where("count > 1").select("doc_id")
    same = linked.join(twice, "doc_id", "left_semi").join(classes, keys).where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found, found_path = components(links.unionByName(same))
    rest, rest_path = links_between(sets, found, known, n, percent, words_of)
    final, _ = components(rest.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    drop(spark, sets_path, links_path, found_path, rest_path)
    free_shuffles(spark)

    groups = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*keys, F.coalesce("root", "rep").alias("root"))
    return rows.select("doc_id", *keys).join(groups, keys, "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def first_members(rows: DataFrame) -> DataFrame:
    """(k1, k2, size, rep, row): of each set, the smallest doc_id that has it and that document's row."""
    known = rows.where("size > 0 and doc_id is not null")
    return known.groupBy("k1", "k2", "size").agg(F.min("doc_id").alias("rep"), F.min_by("row", F.struct("doc_id", "row")).alias("row"))


def class_links(texts: DataFrame, n: int, percent: int, words_of: Callable = space_words) -> tuple[DataFrame, DataFrame]:
    """Of texts with distinct doc_ids that aren't null: (doc_id, rep), rep standing for the documents of an equal set,
    and every link (a, b), a < b, between different sets, by what stands for them."""
    spark = texts.sparkSession
    rows, _ = stored(profiles(texts, n, percent, words_of), "sets")
    classes, _ = stored(first_members(rows), "classes")
    sets, sets_path = shared_prefixes(rows, classes, percent)
    links, _ = links_between(sets, spark.createDataFrame([], "node long, root long"), texts, n, percent, words_of)
    drop(spark, sets_path)
    free_shuffles(spark)
    return rows.join(classes.drop("row"), ["k1", "k2", "size"]).select("doc_id", "rep"), links


def jaccard_links(docs: DataFrame, n: int = 3, percent: int = 90, words_of: Callable = space_words) -> DataFrame:
    """The number of links of every document: all pairs that link as in ``jaccard_groups``, copies included.

    One row per distinct doc_id that isn't null: doc_id, n_links (other doc_ids with a text that links with one of
    its own). Sets are compared once each, so copies weigh in the count and not in the work; links between
    different sets are all found, and grow with the square of a group of them.
    """
    texts = documents(docs).where("doc_id is not null").dropDuplicates().withColumn("key", F.monotonically_increasing_id())
    texts, _ = stored(texts, "keyed-texts")
    of, links = class_links(texts.select(F.col("key").alias("doc_id"), "text"), n, percent, words_of)
    held, _ = stored(of.withColumnRenamed("doc_id", "key").join(texts.select("key", "doc_id"), "key").select("doc_id", "rep").distinct(), "classes-of")
    # documents of one set are counted by set; those of several are few and are named
    several = held.groupBy("doc_id").count().where("count > 1").select("doc_id")
    one = held.join(several, "doc_id", "left_anti")
    named = held.join(several, "doc_id", "left_semi")
    near = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near, _ = stored(near.unionByName(held.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()), "near-sets")
    weights = one.groupBy(F.col("rep").alias("b")).agg(F.count("*").alias("copies"))
    by_set = near.join(weights, "b").groupBy("a").agg(F.sum("copies").alias("copies"))
    named_by_set = near.join(named.select(F.col("rep").alias("b"), "doc_id"), "b").groupBy("a").agg(F.countDistinct("doc_id").alias("named"))
    sets = by_set.join(named_by_set, "a", "full").select(F.col("a").alias("rep"), (F.coalesce("copies", F.lit(0)) + F.coalesce("named", F.lit(0)) - 1).alias("n_links"))
    counts = one.join(sets, "rep").select("doc_id", "n_links")
    around = named.join(near.withColumnRenamed("a", "rep"), "rep").select("doc_id", "b").distinct()
    single = around.join(weights, "b", "left").groupBy("doc_id").agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"))
    others = around.join(named.select(F.col("rep").alias("b"), F.col("doc_id").alias("other")), "b").groupBy("doc_id").agg(F.countDistinct("other").alias("named"))
    counts = counts.unionByName(single.join(others, "doc_id").select("doc_id", (F.col("copies") + F.col("named") - 1).alias("n_links")))
    return texts.select("doc_id").distinct().join(counts, "doc_id", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
