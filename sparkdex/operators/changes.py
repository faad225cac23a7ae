"""Differences of two scans, and the cache of extracted documents."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import last_wins


def plan(before: DataFrame, now: DataFrame) -> DataFrame:
    """(rel, kind): added, modified (size or mtime_ns differs) or removed. Of repeated paths the last counts, by
    ``seq`` where there is one, else by mtime_ns and size."""

    def once(rows: DataFrame) -> DataFrame:
        order = F.col("seq") if "seq" in rows.columns else F.struct("mtime_ns", "size")
        return last_wins(rows, order, "rel").select("rel", "size", "mtime_ns", F.lit(True).alias("there"))

    a, b = once(before).alias("a"), once(now).alias("b")
    moved = ~F.col("a.size").eqNullSafe(F.col("b.size")) | ~F.col("a.mtime_ns").eqNullSafe(F.col("b.mtime_ns"))
    kind = F.when(F.col("a.there").isNull(), "added").when(F.col("b.there").isNull(), "removed").when(moved, "modified")
    rows = a.join(b, F.col("a.rel") == F.col("b.rel"), "full_outer")
    return rows.select(F.coalesce("a.rel", "b.rel").alias("rel"), kind.alias("kind")).where("kind is not null")


def cache_hits(read: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached rows whose id and content hash are those of files read now."""
    return cache.join(read.select("doc_id", "content_hash").distinct(), ["doc_id", "content_hash"], "left_semi")


def cache_misses(read: DataFrame, cache: DataFrame) -> DataFrame:
    return read.join(cache.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace those of the same id."""
    return cache.join(entries.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(entries)


def cache_prune(cache: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of ids that are kept, and the ones that go."""
    ids = keep.select("doc_id").distinct()
    return cache.join(ids, "doc_id", "left_semi"), cache.join(ids, "doc_id", "left_anti")


def load_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored cache; a missing, damaged or unfit one is empty, never an error."""
    try:
        rows = spark.read.parquet(path)
        wanted = spark.createDataFrame([], schema).columns
        if set(wanted) <= set(rows.columns):
            rows = rows.select(*wanted)
            rows.count()
            return rows
    except (PySparkException, Py4JJavaError):  # what a missing or damaged file raises
        pass
    return spark.createDataFrame([], schema)
