"""What the command line and the server call: index, search, statistics, validation, watching."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from . import config
from .config import Config
from .errors import EngineError
from .operators import changes, stats
from .operators.index import build, tokenized
from .plans.search import Options, Report, search
from .sources import files, store


class App:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def config(self, root: str) -> Config:
        return config.load(root)

    def cached(self, cfg: Config) -> DataFrame:
        """The cache, if the last generation was made under the same settings; else an empty one."""
        path = "/nowhere"
        try:
            m = store.load_manifest(cfg.output_path)
            if m.config_hash == config.digest(cfg) and m.cache:
                path = f"{cfg.output_path}/{m.cache[0].path.split('/')[0]}"
        except EngineError:
            pass
        return changes.load_cache(self.spark, path, store.CACHED)

    def index(self, root: str) -> store.Manifest:
        """Scan, reuse what the cache holds by content hash, extract and tokenize the rest, publish."""
        cfg = config.load(root)
        read = files.contents(files.files(self.spark, cfg))
        known = self.cached(cfg)
        columns = ["doc_id", "content_hash", "title", "fields", "tokens"]
        documents = files.extract(read).persist(StorageLevel.DISK_ONLY)  # each file is read once
        try:
            hits = changes.cache_hits(documents, known).select(columns)
            fresh = tokenized(changes.cache_misses(documents, known), cfg).select(columns)
            entries = changes.cache_put(hits, fresh).persist(StorageLevel.DISK_ONLY)
            try:
                return store.publish(cfg, build(entries, cfg), entries)
            finally:
                entries.unpersist()
        finally:
            documents.unpersist()

    def search(self, root: str, options: Options) -> Report:
        return search(store.load(self.spark, config.load(root))[0], options)

    def stats(self, root: str) -> stats.Corpus:
        return stats.compute(store.load(self.spark, config.load(root))[0])

    def validate(self, root: str) -> store.Findings:
        return store.inspect(self.spark, config.load(root))

    def watch(self, root: str, before: list[tuple]) -> tuple[list[tuple], list[tuple[str, str]]]:
        """The files now, and (rel, kind) of what changed since a former scan."""
        now = files.walk(config.load(root))
        a = self.spark.createDataFrame([(*r, i) for i, r in enumerate(before)], files.FILES + ", seq long")
        b = self.spark.createDataFrame([(*r, i) for i, r in enumerate(now)], files.FILES + ", seq long")
        return now, sorted((r.rel, r.kind) for r in changes.plan(a, b).collect())
