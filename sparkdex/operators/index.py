"""The inverted index as DataFrames: documents, postings and, derived from them, term statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import tokens

DOCS = "doc_id string, length int, fields map<string,string>, title string, content_hash string"
POSTINGS = "term string, doc_id string, tf int, positions array<int>"


@dataclass(frozen=True)
class Index:
    """docs: DOCS, one row for each document. postings: POSTINGS, one row for each term of a document.
    texts: where the documents are at hand, DOCS with their tokens; queries are then answered row by row."""

    docs: DataFrame
    postings: DataFrame
    texts: DataFrame | None = None

    def terms(self) -> DataFrame:
        """(term, doc_freq, total_freq): always recomputed from postings, never summed from parts."""
        if self.texts is not None:
            # a document's tokens, and each of its terms once
            both = F.explode(F.array(F.struct(F.col("tokens").alias("t"), F.lit(0).alias("docs")), F.struct(F.array_distinct("tokens").alias("t"), F.lit(1).alias("docs"))))
            rows = self.texts.select(both.alias("x")).select("x.docs", F.explode("x.t").alias("term"))
            return rows.groupBy("term").agg(F.sum("docs").cast("int").alias("doc_freq"), F.sum(1 - F.col("docs")).alias("total_freq"))
        return frequencies(self.postings, ["term"])

    def of_term(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term)

    def of_doc(self, doc_id: str) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id)

    def totals(self) -> tuple[int, float]:
        """Documents and their mean length (0 without any); empty documents count."""
        n, mean = self.docs.agg(F.count("*"), F.avg("length")).first()
        return n, float(mean or 0.0)

    def vocabulary(self) -> DataFrame:
        """Every term once."""
        rows = self.postings.select("term") if self.texts is None else self.texts.select(F.explode(F.array_distinct("tokens")).alias("term"))
        return rows.distinct()

    def term_count(self) -> int:
        return self.vocabulary().count()


def frequencies(postings: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(keys, doc_freq, total_freq) of postings, and more sums over them."""
    return postings.groupBy(*keys).agg(F.count("*").cast("int").alias("doc_freq"), F.sum("tf").alias("total_freq"), *more)


def beside(postings: DataFrame, docs: DataFrame, how: str = "inner") -> DataFrame:
    """Postings (or texts) with columns of their documents. Documents are looked up in a hash table of each task's own, so that
    neither is sorted, and postings that ``build`` has dealt by id aren't shuffled again."""
    return postings.join(docs.hint("shuffle_hash"), "doc_id", how)


def empty(spark: SparkSession) -> Index:
    return Index(spark.createDataFrame([], DOCS), spark.createDataFrame([], POSTINGS))


def last_wins(rows: DataFrame, order: Column, key: str = "doc_id") -> DataFrame:
    """Of rows of one key, the last by ``order``."""
    w = Window.partitionBy(key).orderBy(order.desc())
    return rows.withColumn("__last", F.row_number().over(w)).where("__last = 1").drop("__last")


def tokenized(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    return documents.withColumn("tokens", tokens(F.col("body"), cfg))


def once(column: Column) -> Column:
    """A column that later filters and projections can't copy, so that it is computed once for each row."""
    return F.explode(F.array(column))


def grouped(dealt: DataFrame, tokens_of: Callable[[Column], Column]) -> DataFrame:
    """POSTINGS from rows of (doc_id, texts), grouped within each row: its occurrences are sorted by term and position
    and cut where the term changes. Nothing is sorted or aggregated over rows, so nothing spills."""
    occurrences = F.flatten(F.transform("texts", lambda x: F.transform(tokens_of(x), lambda t, n: F.struct(t.alias("term"), n.alias("pos")))))
    rows = dealt.select("doc_id", once(F.sort_array(occurrences)).alias("at"))
    firsts = F.transform("at", lambda x, n: F.when((n == 0) | (x["term"] != F.get("at", n - 1)["term"]), n))
    rows = rows.select("doc_id", "at", once(F.array_compact(firsts)).alias("firsts"))

    def posting(first: Column, n: Column) -> Column:
        tf = F.coalesce(F.get("firsts", n + 1), F.size("at")) - first
        positions = F.transform(F.slice("at", first + 1, tf), lambda x: x["pos"])
        return F.struct(F.get("at", first)["term"].alias("term"), tf.alias("tf"), positions.alias("positions"))

    return rows.select("doc_id", F.explode(F.transform("firsts", posting)).alias("p")).select("p.term", "doc_id", "p.tf", "p.positions")


def build(documents: DataFrame, cfg: Config = Config()) -> Index:
    """From documents of distinct ids, with a body or, already, tokens.

    Documents are dealt by id before they are tokenized: what is shuffled is texts, and a document's postings are
    then grouped where it is, within its row.
    """

    def token_rows(rows: DataFrame) -> DataFrame:
        return rows if "tokens" in rows.columns else tokenized(rows, cfg)

    def with_tokens(rows: DataFrame) -> DataFrame:
        return token_rows(rows).select("doc_id", "fields", "title", "content_hash", once(F.col("tokens")).alias("tokens"))

    texts = with_tokens(documents).withColumn("length", F.size("tokens"))
    own = "tokens" if "tokens" in documents.columns else "body"
    dealt = documents.select("doc_id", own).repartition("doc_id").groupBy("doc_id").agg(F.collect_list(own).alias("texts"))
    postings = grouped(dealt, lambda x: x if own == "tokens" else tokens(x, cfg))
    # not from ``texts``: where no length is asked for, nothing is tokenized
    docs = token_rows(documents).select("doc_id", F.size("tokens").alias("length"), "fields", "title", "content_hash")
    return Index(docs, postings, texts.select("doc_id", "length", "fields", "title", "content_hash", "tokens"))


def upsert(index: Index, documents: DataFrame, cfg: Config = Config()) -> Index:
    """Documents replace those of the same id whole."""
    return merge(index, build(documents, cfg))


def add_postings(index: Index, docs: DataFrame, postings: DataFrame) -> Index:
    """Imported postings: entries without positions are left out, and a length below 1 is their sum of positions."""
    kept = postings.where(F.size("positions") > 0).select("term", "doc_id", F.size("positions").alias("tf"), F.sort_array("positions").alias("positions"))
    sums = kept.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("__sum"))
    length = F.when(F.col("length") >= 1, F.col("length")).otherwise(F.coalesce("__sum", F.lit(0)))
    filled = docs.join(sums, "doc_id", "left").withColumn("length", length).drop("__sum")
    return merge(index, Index(filled.select(*index.docs.columns), kept))


def rebuild(docs: DataFrame, postings: DataFrame) -> Index:
    """An index from the rows of segments. Occurrences that came without positions stand after the document's last
    located one, term by term; a document's length is the number of all its occurrences."""
    placed = postings.where(F.size("positions") > 0).select("term", "doc_id", F.sort_array("positions").alias("positions"))
    loose = postings.where((F.coalesce(F.size("positions"), F.lit(0)) <= 0) & (F.col("tf") > 0)).select("term", "doc_id", "tf")
    ends = placed.groupBy("doc_id").agg((F.max(F.element_at("positions", -1)) + 1).alias("__end"))
    earlier = F.sum("tf").over(Window.partitionBy("doc_id").orderBy("term").rowsBetween(Window.unboundedPreceding, -1))
    first = (F.coalesce("__end", F.lit(0)) + F.coalesce(earlier, F.lit(0))).cast("int")
    following = loose.join(ends, "doc_id", "left").withColumn("__first", first)
    following = following.select("term", "doc_id", F.sequence(F.col("__first"), F.col("__first") + F.col("tf") - 1).alias("positions"))
    found = placed.unionByName(following).select("term", "doc_id", F.size("positions").alias("tf"), "positions")
    lengths = found.groupBy("doc_id").agg(F.sum("tf").cast("int").alias("__length"))
    whole = docs.join(lengths, "doc_id", "left").withColumn("length", F.coalesce("__length", F.lit(0))).select(*docs.columns)
    return Index(whole, found)


def merge(*indexes: Index) -> Index:
    """The union of indexes; of documents of one id, the last index's, with its postings alone.

    Each index's postings are held to its own remaining documents by id alone, before the union, so they stay where
    ``build`` has dealt them. Where all indexes have their texts, so has the union.
    """
    docs = postings = texts = None
    for k, i in enumerate(indexes):
        d = i.docs.withColumn("__from", F.lit(k))
        docs = d if docs is None else docs.unionByName(d)
    docs = last_wins(docs, F.col("__from"))
    for k, i in enumerate(indexes):
        own = docs.where(F.col("__from") == k).select("doc_id")
        p = beside(i.postings.select("term", "doc_id", "tf", "positions"), own, "left_semi")
        postings = p if postings is None else postings.unionByName(p)
        if all(j.texts is not None for j in indexes):
            t = beside(i.texts, own, "left_semi")
            texts = t if texts is None else texts.unionByName(t)
    return Index(docs.drop("__from"), postings.select("term", "doc_id", "tf", "positions"), texts)


def bounds_of(rows: DataFrame, key: str, parts: int, each: int = 100) -> list:
    """At most parts - 1 ascending keys that split rows into ranges of about one size; from ``each`` keys a part, those
    of the least hashes, so that what comes to the driver doesn't grow with the rows."""
    keys = rows.select(key).where(F.col(key).isNotNull())
    found = sorted(r[0] for r in keys.orderBy(F.xxhash64(key)).limit(parts * each).collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}) if found else []


def range_of(key: Column, bounds: list) -> Column:
    """The place of a key among ranges that begin at ascending bounds; null is before all."""

    def within(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(bounds[mid]), within(mid + 1, hi)).otherwise(within(lo, mid))

    return within(0, len(bounds))


def numbered(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows with ``ordinal``, their place from 0 by key. Two passes, so that no window spans all rows: the rows of
    ranges of keys are counted, and each range numbers its own from its predecessors' sum. The ranges are set once,
    as values: repartitionByRange would sample other ones in the second pass than those counted in the first."""
    spark = docs.sparkSession
    bounds = bounds_of(docs, key, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.withColumn("__part", range_of(F.col(key), bounds))
    counts = sorted(ranged.groupBy("__part").count().collect())
    before, at = {}, 0
    for r in counts:
        before[r["__part"]] = at
        at += r["count"]
    starts = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)]) if before else None
    w = Window.partitionBy("__part").orderBy(key)
    base = starts[F.col("__part")] if before else F.lit(0)
    return ranged.withColumn("ordinal", (F.row_number().over(w) - 1 + base).cast("long")).drop("__part")


def segmented(docs: DataFrame, max_docs: int) -> DataFrame:
    """Documents with their segment: in ascending id, at most max_docs in each (below 1: one segment)."""
    rows = numbered(docs)
    part = F.floor(F.col("ordinal") / max_docs) if max_docs >= 1 else F.lit(0).cast("long")
    digits = part.cast("string")
    return rows.withColumn("segment", F.concat(F.lit("seg-"), F.when(part < 9999, F.lpad((part + 1).cast("string"), 4, "0")).otherwise((digits.cast("long") + 1).cast("string")))).drop("ordinal")


def segment_terms(index: Index, segments: DataFrame) -> DataFrame:
    """(segment, term, doc_freq, total_freq) within each segment."""
    return frequencies(beside(index.postings, segments.select("doc_id", "segment")), ["segment", "term"])
