"""Queries over an index: which documents match, how they rank, their facets and a page of them.

Every term and phrase clause is an expression over the positions of the query's words in a document. Where the
documents' tokens are at hand, these are found in each row, and nothing is shuffled; else the postings of all the
query's words are read once and gathered by document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.index import Index, once
from .query import Clause, Query, parse

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Options:
    query: str = ""
    filters: dict[str, str] = field(default_factory=dict)
    limit: int = 0
    facets: tuple[str, ...] = ()


@dataclass
class Report:
    """results: dictionaries in order; facets: field -> value -> count."""

    options: Options
    total: int
    results: list[dict]
    facets: dict[str, dict[str, int]]


def field_value(name: str) -> Column:
    """A document's field; a missing one is the empty string."""
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))


def _positions(word: str) -> Column:
    return F.try_element_at("__words", F.lit(word))


def _moved(positions: Column, k: int) -> Column:
    return F.transform(positions, lambda x: x - k)


def _places(word: str) -> Column:
    """Where a document's tokens are the word."""
    return F.array_compact(F.transform("tokens", lambda x, i: F.when(x == word, i)))


def phrase_frequency(words: tuple[str, ...]) -> Column:
    """Number of positions where the words stand one after another, overlaps included; 0 for none."""
    first = _positions(words[0])
    if len(words) == 1:
        return F.coalesce(F.size(first), F.lit(0))
    starts = first
    for k, w in enumerate(words):
        if k:
            starts = F.array_intersect(starts, _moved(F.coalesce(_positions(w), F.array().cast("array<int>")), k))
    return F.coalesce(F.size(starts), F.lit(0))


def matches_clause(c: Clause) -> tuple[Column, Column]:
    """Whether a document matches a clause, and how often."""
    if c.field:
        return field_value(c.field) == c.value, F.lit(0)
    n = phrase_frequency(c.words)
    return n > 0, n


def selected(index: Index, query: Query, filters: dict[str, str] | None = None) -> DataFrame:
    """Matching documents with ``freq`` (summed over positive clauses) and ``__words`` (word -> positions)."""
    clauses = [c for c in query.clauses if not c.empty]
    words = sorted({w for c in clauses if not c.field for w in c.words})
    docs = index.texts if words and index.texts is not None else index.docs
    for name, value in (filters or {}).items():
        docs = docs.where(field_value(name) == value)
    for c in clauses:
        if c.field:
            held = matches_clause(c)[0]
            docs = docs.where(~held if c.negate else held)
    needed = {w for c in clauses if not c.negate and not c.field for w in c.words}
    if not words:
        rows = docs.withColumn("__words", F.lit(None).cast("map<string,array<int>>"))
    elif index.texts is not None:
        for w in sorted(needed):
            docs = docs.where(F.array_contains("tokens", w))
        rows = docs.withColumn("__words", once(F.map_from_arrays(F.array(*map(F.lit, words)), F.array(*map(_places, words)))))
    else:
        own = index.postings.where(F.col("term").isin(words)).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("__words"))
        rows = docs.join(own, "doc_id", "inner" if needed else "left")
    rows = rows.drop("tokens")
    freq = F.lit(0)
    for c in clauses:
        if c.field:
            continue
        held, n = matches_clause(c)
        rows = rows.where(~held if c.negate else held)
        if not c.negate:
            freq = freq + n
    return rows.withColumn("freq", freq.cast("int"))


def weighed_words(query: Query) -> list[str]:
    """Words that score, in order; repeated ones weigh again."""
    return [w for c in query.clauses if not c.negate and not c.field for w in c.words]


def statistics(index: Index, words: list[str]) -> tuple[int, float, dict[str, int]]:
    """Documents, their mean length, and in how many of them each word is."""
    if index.texts is not None:
        counts = [F.count_if(F.array_contains("tokens", w)) for w in words]
        n, mean, *df = index.texts.agg(F.count("*"), F.avg("length"), *counts).first()
        return n, float(mean or 0.0), dict(zip(words, df, strict=True))
    found = index.postings.where(F.col("term").isin(words)).groupBy("term").count().collect()
    return *index.totals(), {r["term"]: r["count"] for r in found}


def scored(index: Index, query: Query, rows: DataFrame) -> DataFrame:
    """With ``score``: BM25 over corpus-wide statistics (before filters), added up in clause-then-word order."""
    words = weighed_words(query)
    score = F.lit(0.0)
    if words:
        n, mean, df = statistics(index, sorted(set(words)))
        mean = mean if mean > 0 else 1.0
        length = F.when(F.col("length") > 0, F.col("length").cast("double")).otherwise(F.lit(mean))
        for w in words:
            if not df.get(w):
                continue
            tf = F.coalesce(F.size(_positions(w)), F.lit(0)).cast("double")
            idf = F.log(1 + (F.lit(float(n)) - F.lit(float(df[w])) + 0.5) / (F.lit(float(df[w])) + 0.5))
            share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))
            score = score + F.when(tf > 0, idf * share).otherwise(0.0)
    return rows.withColumn("score", score)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), F.desc("freq"), "doc_id")


def page(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows in the total order, all if limit is below 1."""
    return ordered(rows).limit(limit) if limit > 0 else ordered(rows)


def facet_counts(rows: DataFrame, fields) -> DataFrame:
    """(field, value, count) over all rows, for every field in one pass."""
    names = sorted(set(fields))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), field_value(f).alias("value")) for f in names])).alias("p")
    return rows.select(pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("count"))


def search(index: Index, options: Options) -> Report:
    """Parse, select, score, order, count facets over every match, cut the page."""
    query = parse(options.query)
    rows = scored(index, query, selected(index, query, options.filters)).persist()
    try:
        total = rows.count()
        facets: dict[str, dict[str, int]] = {f: {} for f in sorted(set(options.facets))}
        if facets:
            for r in facet_counts(rows, facets).collect():
                facets[r["field"]][r["value"]] = r["count"]
        results = [
            {"doc_id": r.doc_id, "path": r.doc_id, "title": r.title, "score": r.score, "freq": r.freq, "fields": dict(r.fields or {}), "snippet": ""}
            for r in page(rows.select("doc_id", "title", "score", "freq", "fields"), options.limit).toLocalIterator()
        ]
    finally:
        rows.unpersist()
    return Report(options, total, results, facets)
