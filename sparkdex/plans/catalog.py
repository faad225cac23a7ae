"""Registered queries of the engine over the given tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..operators import changes, stats
from ..operators.index import Index, add_postings, beside, build, frequencies, merge, segment_terms, segmented
from ..sources.tables import documents, table
from . import cases, lifecycle
from . import search as S
from .query import parse

ONE, TWO, PHRASE, THREE = "que", "que la", '"que la"', '"la que la"'
SEGMENT_DOCS = 256


def index(spark: SparkSession, sf_dir: str) -> Index:
    return build(documents(spark, sf_dir))


def _hits(query: str, filters: dict[str, str] | None = None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.selected(index(spark, sf_dir), parse(query), filters).select("doc_id", "freq")

    return run


def _ranked(query: str, limit: int = 0):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        i, q = index(spark, sf_dir), parse(query)
        rows = S.scored(i, q, S.selected(i, q)).select("doc_id", "freq", F.round("score", 6).alias("score"))
        return S.page(rows, limit) if limit else rows

    return run


def tokens(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", F.posexplode(T.tokens(F.col("body"))).alias("pos", "term"))


def token_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("body"))).alias("n_tokens"))


def stopword_filter(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.explode(T.tokens(F.col("body"), Config(stopwords=("zzzz",), min_term_length=1))).alias("term"))
    return rows.where(F.col("term").isin(*sorted(T.STOPWORDS))).groupBy("term").agg(F.count("*").alias("n"))


def _joined(rows: DataFrame) -> DataFrame:
    return rows.withColumn("positions", F.array_join("positions", ","))


def postings(spark, sf_dir):
    return _joined(index(spark, sf_dir).postings)


def term_stats(spark, sf_dir):
    return index(spark, sf_dir).terms()


def doc_lengths(spark, sf_dir):
    return index(spark, sf_dir).docs.select("doc_id", "length")


def corpus_totals(spark, sf_dir):
    return index(spark, sf_dir).docs.agg(F.count("*").alias("n_docs"), F.sum("length").alias("n_tokens"), F.round(F.avg("length"), 6).alias("mean_length"))


def doc_lookup(spark, sf_dir):
    i = index(spark, sf_dir)
    first = i.docs.agg(F.min("doc_id")).first()[0]
    return i.of_doc(first).select("doc_id", "length", "content_hash")


def docs_sorted(spark, sf_dir):
    return index(spark, sf_dir).docs.orderBy("doc_id").select("doc_id", "length", "content_hash")


def _parts(spark, sf_dir):
    """The corpus, and a second index in which documents of source src1 have changed to their ids' text."""
    rows = documents(spark, sf_dir)
    changed = rows.where(F.col("fields")["source"] == "src1").withColumn("body", F.concat_ws(" ", F.lit("changed"), "doc_id"))
    return build(rows), build(changed)


def merge_last_wins(spark, sf_dir):
    return merge(*_parts(spark, sf_dir)).terms()


def add_postings_terms(spark, sf_dir):
    i = index(spark, sf_dir)
    again = add_postings(Index(i.docs.limit(0), i.postings.limit(0)), i.docs.withColumn("length", F.lit(0)), i.postings)
    rows = beside(again.postings, again.docs.select("doc_id", "length"))
    return frequencies(rows, ["term"], F.sum("length").alias("lengths"))


def segment_assignment(spark, sf_dir):
    return segmented(index(spark, sf_dir).docs, SEGMENT_DOCS).select("doc_id", "segment")


def segment_term_stats(spark, sf_dir):
    i = index(spark, sf_dir)
    return segment_terms(i, segmented(i.docs, SEGMENT_DOCS))


def term_postings(spark, sf_dir):
    return _joined(index(spark, sf_dir).of_term(ONE))


def facet_one(spark, sf_dir):
    return S.facet_counts(S.selected(index(spark, sf_dir), parse(ONE)), ["lang"])


def facet_many(spark, sf_dir):
    return S.facet_counts(S.selected(index(spark, sf_dir), parse("")), ["lang", "source", "absent"])


def total_vs_page(spark, sf_dir):
    i, q = index(spark, sf_dir), parse(ONE)
    rows = S.scored(i, q, S.selected(i, q)).select("doc_id", "freq", "score")
    return rows.agg(F.count("*").alias("total")).crossJoin(S.page(rows, 5).agg(F.count("*").alias("shown")))


def stats_headline(spark, sf_dir):
    return stats.headline(index(spark, sf_dir))


def stats_by_kind(spark, sf_dir):
    return stats.by_field(index(spark, sf_dir), "kind")


def stats_by_language(spark, sf_dir):
    return stats.by_field(index(spark, sf_dir), "lang")


def largest_docs(spark, sf_dir):
    return stats.largest(index(spark, sf_dir))


def body_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.normalized(F.coalesce("html", F.lit(""))), 256).alias("body_sha256"))


def title_first_line(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", T.title_of(T.normalized(F.col("body")), F.col("path"), F.lit("text")).alias("title"))


def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "content_hash")


def kind_language(spark, sf_dir):
    exts = F.array(*[F.lit(x) for x in (".md", ".rst", ".go", ".py", ".sql", ".html", ".bin", "")])
    ext = F.element_at(exts, (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.kind_of(ext).alias("kind"), T.language_of(ext).alias("language"))


def path_parts(spark, sf_dir):
    path = F.col("path")
    return documents(spark, sf_dir).select("doc_id", T.directory(path).alias("dir"), T.extension(path).alias("ext"), T.base_name(path).alias("base"))


def _scans(spark, sf_dir):
    """Two scans made from the documents: ids of remainder 1 went, 2 grew, 3 came."""
    rows, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    ref = [F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("rel"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns")]
    before = rows.where(k != 3).select(*ref)
    now = rows.where(k != 1).withColumn("n_chars", F.when(k == 2, F.col("n_chars") + 1).otherwise(F.col("n_chars"))).select(*ref)
    return before, now


def watch_plan(spark, sf_dir):
    return changes.plan(*_scans(spark, sf_dir))


def _cache(spark, sf_dir):
    rows, k = documents(spark, sf_dir), F.substring("doc_id", -5, 1).cast("int") % 3
    cache = rows.select("doc_id", F.when(k == 0, F.lit("stale")).otherwise(F.col("content_hash")).alias("content_hash"))
    return rows.select("doc_id", "content_hash"), cache


def cache_hits(spark, sf_dir):
    return changes.cache_hits(*_cache(spark, sf_dir)).select("doc_id", "content_hash")


def cache_misses(spark, sf_dir):
    return changes.cache_misses(*_cache(spark, sf_dir)).select("doc_id", "content_hash")


def cache_prune(spark, sf_dir):
    read, cache = _cache(spark, sf_dir)
    return changes.cache_prune(cache, read.where("doc_id like 'en/%'"))[0].select("doc_id", "content_hash")


def top_per_source(spark, sf_dir):
    docs = index(spark, sf_dir).docs.select(F.col("fields")["source"].alias("source"), "doc_id", "length")
    w = Window.partitionBy("source").orderBy(F.desc("length"), "doc_id")
    return docs.withColumn("place", F.row_number().over(w)).where("place <= 3")


#: query, filters; and, for the SQL, its clauses as they are meant: negated, field, words.
HITS = {
    "term_match": (ONE, None, [(False, "", ["que"])]),
    "and_match": (TWO, None, [(False, "", ["que"]), (False, "", ["la"])]),
    "repeated_term": ("la la", None, [(False, "", ["la"]), (False, "", ["la"])]),
    "negation": ("la -que", None, [(False, "", ["la"]), (True, "", ["que"])]),
    "negation_only": ("-la", None, [(True, "", ["la"])]),
    "match_all": ("", None, []),
    "phrase_two": (PHRASE, None, [(False, "", ["que", "la"])]),
    "phrase_three": (THREE, None, [(False, "", ["la", "que", "la"])]),
    "phrase_overlap": ('"la la"', None, [(False, "", ["la", "la"])]),
    "field_clause": ("lang:fr la", None, [(False, "lang", ["fr"]), (False, "", ["la"])]),
    "filter_exact": ("la", {"lang": "es"}, [(False, "", ["la"])]),
    "filter_missing": ("la", {"language": ""}, [(False, "", ["la"])]),
}
RANKED = {"bm25_term": (ONE, 0, "term_match"), "bm25_and": (TWO, 0, "and_match"), "bm25_phrase": (PHRASE, 0, "phrase_two"), "ranked_top10": (TWO, 10, "and_match")}


def queries():
    plain = [tokens, token_counts, stopword_filter, postings, term_stats, doc_lengths, corpus_totals, doc_lookup, docs_sorted, merge_last_wins, add_postings_terms]
    plain += [segment_assignment, segment_term_stats, term_postings, facet_one, facet_many, total_vs_page, stats_headline, stats_by_kind, stats_by_language]
    plain += [largest_docs, body_normalize, title_first_line, content_hash, kind_language, path_parts, watch_plan, cache_hits, cache_misses, cache_prune, top_per_source]
    found = {f.__name__: f for f in plain}
    found |= {k: _hits(*v[:2]) for k, v in HITS.items()}
    return found | {k: _ranked(*v[:2]) for k, v in RANKED.items()} | cases.queries() | lifecycle.queries()


def _with() -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return f"""WITH docs AS (
  SELECT concat(lang, '/', source, '/', lpad(CAST(doc_id AS VARCHAR), 12, '0'), '.txt') AS doc_id, doc_id AS n,
         coalesce(text, '') AS body, lang, source FROM documents),
kept AS (SELECT doc_id, n, body, lang, source,
  list_filter(list_transform(regexp_extract_all(body, '[\\p{{L}}\\p{{Nd}}]+'), lambda x: lower(translate(x, 'İΣ', 'iσ'))),
              lambda x: length(x) >= 2 AND x NOT IN ({stop})) AS t FROM docs),
lengths AS (SELECT doc_id, n, lang, source, CAST(len(t) AS INTEGER) AS length, t FROM kept),
toks AS (SELECT doc_id, unnest(t) AS term, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos FROM kept),
posts AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
  FROM toks GROUP BY term, doc_id)
"""


def _hits_sql(name: str) -> str:
    """Clause by clause as sets: intersections of positive ones, differences of negative ones."""
    _, filters, clauses = HITS[name]
    fields = {"lang": "lang", "source": "source", "kind": "'text'"}
    tables, parts, conditions, freq = [], [], [], ["0"]
    for k, (negated, field, words) in enumerate(clauses):
        if field:
            conditions.append(f"{'NOT ' * negated}({fields.get(field, chr(39) * 2)} = '{words[0]}')")
            continue
        joins = "".join(f" JOIN toks b{j} ON b{j}.doc_id = a.doc_id AND b{j}.pos = a.pos + {j} AND b{j}.term = '{w}'" for j, w in enumerate(words) if j)
        tables.append(f"c{k} AS (SELECT a.doc_id, count(*) AS f FROM toks a{joins} WHERE a.term = '{words[0]}' GROUP BY a.doc_id)")
        if negated:
            conditions.append(f"doc_id NOT IN (SELECT doc_id FROM c{k})")
        else:
            parts.append(f" JOIN c{k} USING (doc_id)")
            freq.append(f"c{k}.f")
    for field, value in (filters or {}).items():
        conditions.append(f"{fields.get(field, chr(39) * 2)} = '{value}'")
    where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
    hits = f"hits AS (SELECT doc_id, lang, source, length, CAST({' + '.join(freq)} AS INTEGER) AS freq FROM lengths{''.join(parts)}{where})"
    return _with() + "".join(f", {t}" for t in tables) + f", {hits}\n"


def _ranked_sql(limit: int, name: str) -> str:
    terms = []
    for w in (w for negated, field, words in HITS[name][2] if not negated and not field for w in words):
        df = f"(SELECT count(*) FROM posts WHERE term = '{w}')"
        tf = f"(SELECT coalesce(max(tf), 0) FROM posts p WHERE p.term = '{w}' AND p.doc_id = hits.doc_id)"
        n, mean = "(SELECT count(*) FROM lengths)", "(SELECT avg(length) FROM lengths)"
        terms.append(f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)) * ({tf} * 2.2) / ({tf} + 1.2 * (0.25 + 0.75 * length / {mean}))")
    select = f"SELECT doc_id, freq, round(CAST({' + '.join(terms)} AS DOUBLE), 6) AS score FROM hits"
    return _hits_sql(name) + select + (f" ORDER BY score DESC, freq DESC, doc_id LIMIT {limit}" if limit else "")


def oracle_sql() -> dict[str, str]:
    w = _with()
    ext = "list_extract(['.md', '.rst', '.go', '.py', '.sql', '.html', '.bin', ''], page_id % 8 + 1)"
    normal = "coalesce(html, '')"
    for pattern, to in ((r"\A\x{FEFF}", ""), (r"\r\n?", r"\n"), (r"\t", " "), (r" +(\n|\z)", r"\1"), (r"\A\n+", ""), (r"\n+\z", ""), (r"\n{3,}", r"\n\n")):
        to = to.replace(r"\n", "\n")
        normal = f"regexp_replace({normal}, '{pattern}', '{to}', 'g')"
    title = "regexp_extract(body, '[^\\s\\x{85}\\x{A0}][^\\n\\r]*')"
    title = "trim(" + title + ", chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160))"
    segments = f"numbered AS (SELECT *, concat('seg-', lpad(CAST((row_number() OVER (ORDER BY doc_id) - 1) // {SEGMENT_DOCS} + 1 AS VARCHAR), 4, '0')) AS segment FROM lengths)"
    merged = (
        "both_t AS (SELECT doc_id, term FROM toks JOIN lengths USING (doc_id) WHERE source IS DISTINCT FROM 'src1' UNION ALL "
        "SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(concat('changed ', doc_id), '[\\p{L}\\p{Nd}]+'), lambda x: lower(x)), "
        f"lambda x: length(x) >= 2 AND x NOT IN ({', '.join(repr(x) for x in T.STOPWORDS)}))) AS term FROM lengths WHERE source = 'src1')"
    )
    scan = "SELECT concat('f', doc_id) AS rel, n_chars + {grow} AS size, doc_id * 1000 AS mtime FROM documents WHERE doc_id % 10 <> {gone}"
    cache = "cache AS (SELECT doc_id, n, sha256(body) AS content_hash FROM docs)"
    found = {
        "tokens": w + "SELECT doc_id, pos, term FROM toks",
        "token_counts": w + "SELECT doc_id, length AS n_tokens FROM lengths",
        "stopword_filter": "WITH t AS (SELECT unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{Nd}]+'), lambda x: lower(x))) AS term FROM documents) "
        f"SELECT term, count(*) AS n FROM t WHERE term IN ({', '.join(repr(x) for x in T.STOPWORDS)}) GROUP BY term",
        "postings": w + "SELECT term, doc_id, tf, positions FROM posts",
        "term_stats": w + "SELECT term, CAST(count(*) AS INTEGER) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_freq FROM posts GROUP BY term",
        "doc_lengths": w + "SELECT doc_id, length FROM lengths",
        "corpus_totals": w + "SELECT count(*) AS n_docs, CAST(sum(length) AS BIGINT) AS n_tokens, round(avg(length), 6) AS mean_length FROM lengths",
        "doc_lookup": w + "SELECT doc_id, length, sha256(body) AS content_hash FROM lengths JOIN docs USING (doc_id) WHERE doc_id = (SELECT min(doc_id) FROM docs)",
        "docs_sorted": w + "SELECT doc_id, length, sha256(body) AS content_hash FROM lengths JOIN docs USING (doc_id) ORDER BY doc_id",
        "merge_last_wins": w + f", {merged}, c AS (SELECT doc_id, term, count(*) AS tf FROM both_t GROUP BY doc_id, term) SELECT term, CAST(count(*) AS INTEGER) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_freq FROM c GROUP BY term",
        "add_postings_terms": w + "SELECT term, CAST(count(*) AS INTEGER) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_freq, CAST(sum(length) AS BIGINT) AS lengths FROM posts JOIN lengths USING (doc_id) GROUP BY term",
        "segment_assignment": w + f", {segments} SELECT doc_id, segment FROM numbered",
        "segment_term_stats": w + f", {segments} SELECT segment, term, CAST(count(*) AS INTEGER) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_freq FROM posts JOIN numbered USING (doc_id) GROUP BY segment, term",
        "term_postings": w + f"SELECT term, doc_id, tf, positions FROM posts WHERE term = '{ONE}'",
        "facet_one": _hits_sql("term_match") + "SELECT 'lang' AS field, coalesce(lang, '') AS value, count(*) AS count FROM hits GROUP BY lang",
        "facet_many": w
        + "SELECT 'lang' AS field, coalesce(lang, '') AS value, count(*) AS count FROM docs GROUP BY lang UNION ALL SELECT 'source', coalesce(source, ''), count(*) FROM docs GROUP BY source UNION ALL SELECT 'absent', '', count(*) FROM docs",
        "total_vs_page": _hits_sql("term_match") + "SELECT count(*) AS total, least(count(*), 5) AS shown FROM hits",
        "stats_headline": w + "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(DISTINCT term) FROM posts) AS terms, (SELECT CAST(sum(length) AS BIGINT) FROM lengths) AS tokens",
        "stats_by_kind": "SELECT 'text' AS value, count(*) AS count FROM documents",
        "stats_by_language": "SELECT coalesce(lang, '') AS value, count(*) AS count FROM documents GROUP BY lang",
        "largest_docs": w + "SELECT doc_id, length FROM lengths ORDER BY length DESC, doc_id LIMIT 10",
        "body_normalize": f"SELECT page_id, sha256({normal}) AS body_sha256 FROM pages",
        "title_first_line": w
        + f", t AS (SELECT doc_id, {title} AS t FROM docs) SELECT doc_id, CASE WHEN t = '' THEN regexp_extract(doc_id, '[^/]*$') WHEN length(t) > 120 THEN rtrim(substring(t, 1, 120), ' ') ELSE t END AS title FROM t",
        "content_hash": w + "SELECT doc_id, sha256(body) AS content_hash FROM docs",
        "kind_language": f"SELECT page_id, CASE WHEN {ext} = '.md' THEN 'markdown' WHEN {ext} = '.rst' THEN 'text' WHEN {ext} IN ('.bin', '') THEN 'other' ELSE 'source' END AS kind, CASE {ext} WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.sql' THEN 'sql' WHEN '.html' THEN 'html' ELSE '' END AS language FROM pages",
        "path_parts": w + "SELECT doc_id, concat(lang, '/', source) AS dir, '.txt' AS ext, concat(lpad(CAST(n AS VARCHAR), 12, '0'), '.txt') AS base FROM docs",
        "watch_plan": f"WITH a AS ({scan.format(grow=0, gone=3)}), b AS ({scan.format(grow='CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END', gone=1)}) SELECT coalesce(a.rel, b.rel) AS rel, CASE WHEN a.rel IS NULL THEN 'added' WHEN b.rel IS NULL THEN 'removed' ELSE 'modified' END AS kind FROM a FULL JOIN b ON a.rel = b.rel WHERE a.rel IS NULL OR b.rel IS NULL OR a.size IS DISTINCT FROM b.size OR a.mtime IS DISTINCT FROM b.mtime",
        "cache_hits": w + f", {cache} SELECT doc_id, content_hash FROM cache WHERE n % 10 % 3 <> 0",
        "cache_misses": w + f", {cache} SELECT doc_id, content_hash FROM cache WHERE n % 10 % 3 = 0",
        "cache_prune": w + f", {cache} SELECT doc_id, CASE WHEN n % 10 % 3 = 0 THEN 'stale' ELSE content_hash END AS content_hash FROM cache WHERE doc_id LIKE 'en/%'",
        "top_per_source": w + "SELECT source, doc_id, length, place FROM (SELECT source, doc_id, length, CAST(row_number() OVER (PARTITION BY source ORDER BY length DESC, doc_id) AS INTEGER) AS place FROM lengths) WHERE place <= 3",
    }
    found |= {k: _hits_sql(k) + "SELECT doc_id, freq FROM hits" for k in HITS}
    return found | {k: _ranked_sql(*v[1:]) for k, v in RANKED.items()} | cases.oracle_sql() | lifecycle.oracle_sql()
