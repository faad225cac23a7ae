"""The file source: a walk of a corpus, its path predicate, and documents from contents."""

from __future__ import annotations

import os
import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, canonical, check
from ..errors import ConfigError, NotFound
from ..functions import text as T
from ..functions.globs import any_match

FILES = "rel string, abs string, size bigint, mtime_ns bigint, ext string"
DOCUMENTS = "doc_id string, path string, title string, kind string, language string, body string, fields map<string,string>, size bigint, content_hash string"


def matches(cfg: Config, rel: str, size: int) -> bool:
    """Whether a path (with slashes, relative to the root) belongs to the corpus."""
    clean = posixpath.normpath(rel) if rel else ""
    if not rel or clean in (".", "..") or clean.startswith(("../", "/")) or ".git" in clean.split("/"):
        return False
    out = canonical(cfg.output_dir)
    if clean == out or clean.startswith(out + "/"):
        return False
    if cfg.max_file_bytes > 0 and size > cfg.max_file_bytes:
        return False
    if cfg.include and not any_match(cfg.include, clean):
        return False
    return not any_match(cfg.exclude, clean)


def walk(cfg: Config) -> list[tuple[str, str, int, int, str]]:
    """(rel, abs, size, mtime_ns, ext) of every readable regular file, by rel. Links, .git and the output are left out."""
    check(cfg)
    if not os.path.exists(cfg.root):
        raise NotFound(f"not found: {cfg.root}")
    if not os.path.isdir(cfg.root):
        raise ConfigError("Root", f"not a directory: {cfg.root}")
    out, found = os.path.abspath(cfg.output_path), []
    for top, dirs, names in os.walk(cfg.root, onerror=lambda e: None):
        dirs[:] = [d for d in dirs if d != ".git" and not os.path.islink(os.path.join(top, d)) and os.path.abspath(os.path.join(top, d)) != out]
        for name in names:
            path = os.path.join(top, name)
            rel = os.path.relpath(path, cfg.root).replace(os.sep, "/")
            try:
                info = os.lstat(path)
            except OSError:
                continue
            if os.path.islink(path) or not os.path.isfile(path) or not os.access(path, os.R_OK):
                continue
            if matches(cfg, rel, info.st_size):
                dot = name.rfind(".")
                found.append((rel, os.path.abspath(path), info.st_size, info.st_mtime_ns, name[dot:].lower() if dot >= 0 else ""))
    return sorted(found, key=lambda r: r[0].encode("utf-8", "surrogateescape"))


def files(spark: SparkSession, cfg: Config) -> DataFrame:
    return spark.createDataFrame(walk(cfg), FILES)


def contents(refs: DataFrame) -> DataFrame:
    """Files with their bytes, read on the executors once; those that have gone or can't be read are left out."""

    def read(frames):
        for pdf in frames:
            rows, data = [], []
            for i, path in enumerate(pdf["abs"]):
                try:
                    with open(path, "rb") as f:
                        data.append(f.read())
                    rows.append(i)
                except OSError:
                    pass
            yield pd.DataFrame(pdf.iloc[rows]).assign(content=data)

    return refs.mapInPandas(read, FILES + ", content binary")


def extract(read: DataFrame) -> DataFrame:
    """Documents of files with contents; binary ones are left out."""
    rel, kind = F.col("rel"), F.col("kind")
    text = read.where(~T.is_binary("content")).withColumns({"ext": T.extension(rel), "body": T.normalized(F.col("content").cast("string"))})
    text = text.withColumns({"kind": T.kind_of(F.col("ext")), "language": T.language_of(F.col("ext"))})
    fields = {"kind": kind, "language": F.col("language"), "dir": T.directory(rel), "ext": F.col("ext")}
    fields = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    return text.select(
        rel.alias("doc_id"),
        rel.alias("path"),
        T.title_of(F.col("body"), rel, kind).alias("title"),
        "kind",
        "language",
        "body",
        fields.alias("fields"),
        F.when(F.col("size") > 0, F.col("size")).otherwise(F.octet_length("content").cast("long")).alias("size"),
        T.content_hash(F.col("content")).alias("content_hash"),
    )
