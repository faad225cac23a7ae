"""Corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.search import field_value
from .index import Index

LARGEST = 10


@dataclass
class Corpus:
    documents: int = 0
    terms: int = 0
    tokens: int = 0
    by_kind: dict[str, int] = field(default_factory=dict)
    by_language: dict[str, int] = field(default_factory=dict)
    largest: list[tuple[str, int]] = field(default_factory=list)


def headline(index: Index) -> DataFrame:
    """One row: documents, terms, tokens."""
    docs = index.docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("tokens"))
    return docs.crossJoin(index.vocabulary().agg(F.count("*").alias("terms"))).select("documents", "terms", "tokens")


def by_field(index: Index, name: str) -> DataFrame:
    return index.docs.groupBy(field_value(name).alias("value")).agg(F.count("*").alias("count"))


def largest(index: Index, n: int = LARGEST) -> DataFrame:
    return index.docs.select("doc_id", "length").orderBy(F.desc("length"), "doc_id").limit(n)


def compute(index: Index) -> Corpus:
    h = headline(index).first()
    counts = [{r.value: r["count"] for r in by_field(index, f).collect()} for f in ("kind", "language")]
    return Corpus(h.documents, h.terms, h.tokens, *counts, [(r.doc_id, r.length) for r in largest(index).collect()])
