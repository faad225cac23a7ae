"""Registered queries over small tables of the engine's own cases, whose SQL lists the results as literals.

Each query puts inputs through the engine; each oracle is a table of what must come out, written down by hand. They
cover what the given tables have no rows for: the parser, files and settings, bodies and titles by kind, guards of the
ranking, imported postings, reports.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, report, server
from ..config import Config
from ..errors import ConfigError, QueryError, UsageError
from ..functions import globs
from ..functions import text as T
from ..operators import changes, stats
from ..operators.index import DOCS, POSTINGS, Index, add_postings, build, numbered, rebuild, upsert
from ..sources import files
from . import search as S
from .query import parse

TOKENED = "doc_id string, tokens array<string>, fields map<string,string>, title string, content_hash string"


def sql_value(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        out = "'" + x.replace("'", "''") + "'"
        for c in "\n\r\t":  # by code, so that the text is the same for every reader
            out = out.replace(c, f"' || chr({ord(c)}) || '")
        return f"({out})"
    return f"CAST({x!r} AS BIGINT)"


def literal(columns: str, rows: list[tuple]) -> str:
    """SQL of a table of literals."""
    values = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows)
    return f"SELECT {columns} FROM (VALUES {values}) AS t({columns})"


def listed(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# --- query language ---------------------------------------------------------------------------------------------

#: text -> canonical text, clauses, -1, ''; or '', -1, offset in bytes and reason (fixed values: the reasons).
PARSED = [
    ("", "", 0, -1, ""),
    (" \t\n", "", 0, -1, ""),
    ("Alpha  BETA", "alpha beta", 2, -1, ""),
    ('"The Quick  fox"', '"the quick fox"', 1, -1, ""),
    ("KIND:Markdown", "kind:Markdown", 1, -1, ""),
    ("url:http://X:80", "url:http://X:80", 1, -1, ""),
    ('Dir:"My Docs"', 'dir:"My Docs"', 1, -1, ""),
    ("-draft", "-draft", 1, -1, ""),
    ("--x", "--x", 1, -1, ""),
    ('-lang:"go" a', '-lang:"go" a', 2, -1, ""),
    ("search-engine", "search-engine", 1, -1, ""),
    ("naïve ÀÉ", "naïve àé", 2, -1, ""),
    ('"solo"', '"solo"', 1, -1, ""),
    ("a b　c", "a b c", 3, -1, ""),
    ('x "y', "", -1, 2, "unterminated quote"),
    ('""', "", -1, 0, "empty phrase"),
    ('ab "  "', "", -1, 3, "empty phrase"),
    ("ab -", "", -1, 3, "missing term after '-'"),
    ("- ab", "", -1, 0, "missing term after '-'"),
    (":x", "", -1, 0, "missing field name before ':'"),
    ("-:x", "", -1, 1, "missing field name before ':'"),
    ("f:", "", -1, 1, "missing value after ':'"),
    ("f: x", "", -1, 1, "missing value after ':'"),
    ('ab"c', "", -1, 2, "unexpected quote"),
    ('"ab"c', "", -1, 4, "unexpected text after quote"),
    ('éé"x', "", -1, 4, "unexpected quote"),
    ('f:""', "", -1, 2, "empty phrase"),
]

#: query text, place, negated, field, words joined by a bar.
CLAUSES = [
    ('Alpha -beta', 0, False, "", "alpha"),
    ('Alpha -beta', 1, True, "", "beta"),
    ('Kind:Go "One Two"', 0, False, "kind", "Go"),
    ('Kind:Go "One Two"', 1, False, "", "one|two"),
    ('-dir:"A b" İX', 0, True, "dir", "A|b"),
    ('-dir:"A b" İX', 1, False, "", "ix"),
]


def parse_cases(spark, sf_dir):
    rows = []
    for text, *_ in PARSED:
        try:
            q = parse(text)
            rows.append((text, str(q), len(q.clauses), -1, ""))
        except QueryError as e:
            rows.append((text, "", -1, e.position, e.reason))
    return listed(spark, "query string, canonical string, clauses long, byte long, reason string", rows)


def parse_round_trip(spark, sf_dir):
    """The canonical text of a canonical text is itself."""
    rows = [(text, str(parse(str(parse(text))))) for text, _, clauses, *_ in PARSED if clauses >= 0]
    return listed(spark, "query string, again string", rows)


def clause_cases(spark, sf_dir):
    rows = [(text, k, c.negate, c.field, "|".join(c.words)) for text in dict.fromkeys(r[0] for r in CLAUSES) for k, c in enumerate(parse(text).clauses)]
    return listed(spark, "query string, place long, negated boolean, field string, words string", rows)


# --- files, settings --------------------------------------------------------------------------------------------

#: path, size, belongs (under 100 bytes, *.md or src/*.go, nothing named draft*).
PATHS = [
    ("a.md", 1, True), ("docs/a.md", 100, True), ("docs/a.md", 101, False), ("src/x.go", 5, True), ("lib/x.go", 5, False),
    ("draft.md", 5, False), ("docs/draft-2.md", 5, False), ("../a.md", 5, False), ("/a.md", 5, False), ("", 5, False), (".", 5, False),
    (".git/a.md", 5, False), ("x/.git/y/a.md", 5, False), (".github/a.md", 5, True), ("out/a.md", 5, False), ("outer/a.md", 5, True), ("x/../a.md", 5, True),
]
#: pattern, path, matches; a malformed pattern never does.
GLOBS = [
    ("*.md", "a.md", True), ("*.md", "docs/deep/a.md", True), ("docs/*.md", "docs/a.md", True), ("docs/*.md", "docs/x/a.md", False),
    ("docs/?.md", "docs/a.md", True), ("docs?a.md", "docs/a.md", False), ("[a-c].md", "x/b.md", True), ("[^a-c].md", "b.md", False),
    ("[^a-c].md", "d.md", True), ("\\*.md", "*.md", True), ("\\*.md", "a.md", False), ("[", "[", False), ("a[", "a[", False), ("", "", True), ("A.md", "a.md", False),
]
SYNTAX = [("*", True), ("[a-z]", True), ("[", False), ("[]", False), ("[a-]", False), ("[^x]", True), ("\\", False), ("a\\b", True), ("[a", False), ("**", True)]
#: setting, value, the field that is refused.
SETTINGS = [
    ("output_dir", "x", ""), ("output_dir", "", "OutputDir"), ("output_dir", "/x", "OutputDir"), ("output_dir", "../x", "OutputDir"), ("output_dir", ".", "OutputDir"),
    ("output_dir", "a/../..", "OutputDir"), ("output_dir", "a/..", "OutputDir"), ("output_dir", "a/b", ""), ("min_term_length", 0, "MinTermLength"), ("min_term_length", 1, ""),
    ("segment_docs", 0, "SegmentDocs"), ("max_file_bytes", -1, "MaxFileBytes"), ("max_file_bytes", 0, ""), ("include", ("*.md", "["), "Include[1]"), ("exclude", ("",), "Exclude[0]"), ("exclude", ("x",), ""),
]
#: changes of settings, whether the hash stays that of include a, b.
HASHES = [("other root", True), ("include b, a", True), ("include a", False), ("exclude a", False), ("output x/../sparkdex-out", True), ("stopwords a", False)]
EXTENSIONS = [("md", True), (".MD", True), (" go ", True), (".markdown", True), ("bin", False), ("", False), (".", False), ("yaml", True), ("tar.gz", False)]


def path_predicate(spark, sf_dir):
    cfg = Config(output_dir="out", include=("*.md", "src/*.go"), exclude=("draft*",), max_file_bytes=100)
    return listed(spark, "path string, size long, belongs boolean", [(p, n, files.matches(cfg, p, n)) for p, n, _ in PATHS])


def glob_cases(spark, sf_dir):
    return listed(spark, "pattern string, path string, held boolean", [(p, x, globs.any_match([p], x)) for p, x, _ in GLOBS])


def glob_syntax(spark, sf_dir):
    return listed(spark, "pattern string, valid boolean", [(p, globs.valid_glob(p)) for p, _ in SYNTAX])


def setting_checks(spark, sf_dir):
    rows = []
    for name, value, _ in SETTINGS:
        try:
            config.check(replace(Config(), **{name: value}))
            rows.append((name, str(value), ""))
        except ConfigError as e:
            rows.append((name, str(value), e.field))
    return listed(spark, "setting string, value string, refused string", rows)


def setting_hashes(spark, sf_dir):
    made = [Config(root="/other", include=("a", "b")), Config(include=("b", "a")), Config(include=("a",)), Config(exclude=("a",)), Config(output_dir="x/../sparkdex-out", include=("a", "b")), Config(include=("a", "b"), stopwords=("a",))]
    one = config.digest(Config(include=("a", "b")))
    return listed(spark, "change string, same boolean", [(what, config.digest(c) == one) for (what, _), c in zip(HASHES, made, strict=True)])


def supported_extensions(spark, sf_dir):
    return listed(spark, "ext string, supported boolean", [(e, T.supported_extension(e)) for e, _ in EXTENSIONS])


# --- bodies -----------------------------------------------------------------------------------------------------

#: bytes in hex (times a count) and what follows; whether binary.
BINARY = [
    ("", 0, "", False), ("61", 3, "", False), ("61", 3, "00", True), ("61", 9, "fffe", True), ("01", 31, "61" * 69, True), ("01", 30, "61" * 70, False), ("7f", 31, "61" * 69, True),
    ("090a0b0c0d", 5, "", False), ("61", 7999, "c3a962", False), ("61", 7998, "e697a562", False), ("61", 7997, "f09f988061", False), ("61", 7999, "c3", True), ("61", 7996, "9898989862", True), ("61", 8000, "00", False),
]
#: body, kind, path, title.
TITLES = [
    ("# Guide\n\ntext", "markdown", "d/n.md", "Guide"), ("intro\n## Two ##\n", "markdown", "n.md", "Two"), ("####### seven\nnext", "markdown", "n.md", "####### seven"),
    ("#\n# \n# x#", "markdown", "n.md", "x"), ("#tight\n", "markdown", "n.md", "#tight"), ("   # three\n", "markdown", "n.md", "three"), ("\n\n", "markdown", "d/n.md", "n.md"),
    ("\n first \nsecond", "text", "n.txt", "first"), ("# not a heading", "text", "n.txt", "# not a heading"), ("", "other", "a/b/c", "c"),
    ("// package x\ncode", "source", "n.go", "package x"), ("/* */\n#!/bin/sh", "source", "n.sh", "*/"), ("---\n;; x", "source", "n.el", "x"), ("x" * 121, "text", "n", "x" * 120), ("y" * 119 + " z", "text", "n", "y" * 119),
]
NORMAL = [
    ("﻿a\r\nb\rc", "a\nb\nc"), ("a\tb  \n c ", "a b\n c"), ("\n\n a\n\n\n\nb\n\n", " a\n\nb"), ("a\n \n\t\nb", "a\n\nb"), ("", ""), ("\n \n", ""), ("a \n", "a "),
]
#: file name, content; kind, language, folder, extension, title, body.
EXTRACTED = [
    ("docs/Guide.MD", "# Top\r\n\r\ntext\t.\n", "markdown", "", "docs", ".md", "Top", "# Top\n\ntext ."),
    ("a.go", "// Package a\n\npackage a\n", "source", "go", ".", ".go", "Package a", "// Package a\n\npackage a"),
    ("LICENSE", "\n\nfree  \n", "other", "", ".", "", "free", "free"),
    ("x/y/notes.rst", "", "text", "", "x/y", ".rst", "notes.rst", ""),
]


def binary_cases(spark, sf_dir):
    rows = [(i, bytearray(bytes.fromhex(a) * n + bytes.fromhex(b))) for i, (a, n, b, _) in enumerate(BINARY)]
    return listed(spark, "k long, content binary", rows).select("k", T.is_binary("content").alias("is_binary"))


def title_cases(spark, sf_dir):
    rows = listed(spark, "k long, body string, kind string, path string", [(i, b, k, p) for i, (b, k, p, _) in enumerate(TITLES)])
    return rows.select("k", T.title_of(F.col("body"), F.col("path"), F.col("kind")).alias("title"))


def normal_cases(spark, sf_dir):
    rows = listed(spark, "k long, body string", [(i, b) for i, (b, _) in enumerate(NORMAL)])
    return rows.select("k", T.normalized(F.col("body")).alias("body"))


def extract_cases(spark, sf_dir):
    rows = [(r, f"/c/{r}", 0, 0, "", bytearray(c.encode())) for r, c, *_ in EXTRACTED] + [("pic.bin", "/c/pic.bin", 0, 0, "", bytearray(b"\0"))]
    found = files.extract(listed(spark, files.FILES + ", content binary", rows))
    return found.select("doc_id", "kind", "language", F.col("fields")["dir"].alias("dir"), F.col("fields")["ext"].alias("ext"), "title", "body", "size", "content_hash")


# --- tokens -----------------------------------------------------------------------------------------------------

#: text, least length, stop words; the kept terms.
TOKENIZED = [
    ("The quick-brown FOX_2", 2, "", "quick brown fox"), ("a bb ccc", 0, "", "bb ccc"), ("a bb ccc", 3, "", "ccc"), ("a I b", 1, "", "b"),
    ("alpha Beta the", 2, " BETA ", "alpha the"), ("them themes", 2, "them", "themes"), ("İI ΣΑΣ Ⅷ 1٢", 2, "zz", "ii σασ 1٢"), ("x", 2, "", ""), ("re-use it's", 2, "use", "re it"),
]
STOPPED = [(" The ", True), ("fox", False), ("", False), ("  ", False), ("YOU", True)]


def token_cases(spark, sf_dir):
    found = None
    for k, (text, n, stop, _) in enumerate(TOKENIZED):
        cfg = Config(min_term_length=n, stopwords=tuple(stop.split(",")) if stop else ())
        row = listed(spark, "k long, body string", [(k, text)]).select("k", F.array_join(T.tokens(F.col("body"), cfg), " ").alias("terms"))
        found = row if found is None else found.unionByName(row)
    return found


def stopword_cases(spark, sf_dir):
    return listed(spark, "word string, stops boolean", [(w, T.is_stopword(Config(), w)) for w, _ in STOPPED])


# --- index ------------------------------------------------------------------------------------------------------

CORPUS = [
    ("docs/a.md", "alpha beta alpha gamma", {"kind": "markdown", "dir": "docs"}, "A"),
    ("docs/b.md", "beta gamma beta", {"kind": "markdown", "dir": "docs"}, "B"),
    ("n.txt", "beta alpha", {"kind": "text", "dir": "."}, "N"),
    ("src/c.go", "alpha beta", {"kind": "source", "language": "go", "dir": "src"}, ""),
    ("src/d.go", "gamma gamma gamma", {"kind": "source", "language": "go", "dir": "src"}, "D | x"),
    ("void", "", {}, ""),
]
#: query; id and frequency.
FOUND = {
    "": [("docs/a.md", 0), ("docs/b.md", 0), ("n.txt", 0), ("src/c.go", 0), ("src/d.go", 0), ("void", 0)],
    "alpha beta": [("docs/a.md", 3), ("n.txt", 2), ("src/c.go", 2)],
    "alpha alpha": [("docs/a.md", 4), ("n.txt", 2), ("src/c.go", 2)],
    "beta -gamma": [("n.txt", 1), ("src/c.go", 1)],
    "-alpha": [("docs/b.md", 0), ("src/d.go", 0), ("void", 0)],
    '"gamma gamma"': [("src/d.go", 2)],
    '"alpha beta"': [("docs/a.md", 1), ("src/c.go", 1)],
    "kind:markdown alpha": [("docs/a.md", 2)],
    "KIND:Markdown": [],
    '-"beta alpha" beta': [("docs/b.md", 2), ("src/c.go", 1)],
    "the": [],
    "--alpha": [("docs/a.md", 0), ("docs/b.md", 0), ("n.txt", 0), ("src/c.go", 0), ("src/d.go", 0), ("void", 0)],
}
#: documents and occurrences of each query's words, with the frequency of each word in each document; what is scored.
SCORED = {
    "alpha": [("docs/a.md", [("alpha", 2)], 4, 2), ("n.txt", [("alpha", 1)], 2, 1), ("src/c.go", [("alpha", 1)], 2, 1)],
    '"beta alpha" alpha': [("docs/a.md", [("beta", 1), ("alpha", 2), ("alpha", 2)], 4, 3), ("n.txt", [("beta", 1), ("alpha", 1), ("alpha", 1)], 2, 2)],
    "-alpha beta": [("docs/b.md", [("beta", 2)], 3, 2)],
    "-gamma kind:text": [("n.txt", [], 2, 0)],
}
DOCUMENT_FREQUENCIES, DOCUMENTS, OCCURRENCES = {"alpha": 3, "beta": 4, "gamma": 3}, 6, 14
#: imported docs (id, length) and postings (term, id, tf, positions); the lengths and rows that come of them.
IMPORTED = [("p", 0), ("q", 7), ("r", 0)]
IMPORTED_POSTINGS = [("x", "p", 9, [4, 1]), ("y", "p", 5, []), ("x", "q", 1, [0]), ("z", "s", 1, [2])]
#: of a segment: postings without positions stand last.
SEGMENT_POSTINGS = [("pair", "x.md", 1, [0]), ("solo", "x.md", 2, []), ("last", "x.md", 1, [3]), ("more", "x.md", 1, []), ("only", "y.md", 2, []), ("none", "y.md", 0, [])]


def corpus(spark) -> Index:
    return build(listed(spark, TOKENED, [(d, t.split(), f, title, d) for d, t, f, title in CORPUS]))


def stored_corpus(spark) -> Index:
    """The same as an index of postings alone, as it is read from a generation."""
    i = corpus(spark)
    return Index(i.docs, i.postings)


def _selections(index_of):
    def run(spark, sf_dir):
        i, found = index_of(spark), None
        for q in FOUND:
            rows = S.selected(i, parse(q)).select(F.lit(q).alias("query"), "doc_id", F.col("freq").cast("long").alias("freq"))
            found = rows if found is None else found.unionByName(rows)
        return found

    return run


def _scores(index_of):
    def run(spark, sf_dir):
        i, found = index_of(spark), None
        for text in SCORED:
            q = parse(text)
            rows = S.scored(i, q, S.selected(i, q)).select(F.lit(text).alias("query"), "doc_id", F.col("freq").cast("long").alias("freq"), F.round("score", 12).alias("score"))
            found = rows if found is None else found.unionByName(rows)
        return found

    return run


def score_guards(spark, sf_dir):
    """Without a length, a document counts as one of mean length; without any, the mean is 1; unknown words add nothing."""
    docs = [("a", 0, {}, "", ""), ("b", 0, {}, "", "")]
    i = Index(listed(spark, DOCS, docs), listed(spark, POSTINGS, [("w", "a", 2, [0, 1]), ("v", "b", 1, [0])]))
    found = None
    for text in ("w", "-v", "w w", "nope"):
        q = parse(text)
        rows = S.scored(i, q, S.selected(i, q)).select(F.lit(text).alias("query"), "doc_id", F.round("score", 12).alias("score"))
        found = rows if found is None else found.unionByName(rows)
    return found


def total_order(spark, sf_dir):
    """Score, then frequency, then id; a limit of 3 of 5 rows, and 0 for all."""
    rows = listed(spark, "doc_id string, score double, freq int", [("b", 1.0, 1), ("a", 1.0, 1), ("c", 1.0, 2), ("d", 2.0, 0), ("e", 0.0, 9)])
    some = S.page(rows, 3).select(F.lit("first 3").alias("page"), "doc_id")
    return some.unionByName(S.page(rows, 0).select(F.lit("all").alias("page"), "doc_id")).unionByName(numbered(rows).where("ordinal = 4").select(F.lit("last id").alias("page"), "doc_id"))


def imported_postings(spark, sf_dir):
    docs = listed(spark, DOCS, [(d, n, {}, "", "") for d, n in IMPORTED])
    empty = Index(docs.limit(0), listed(spark, POSTINGS, []))
    i = add_postings(empty, docs, listed(spark, POSTINGS, IMPORTED_POSTINGS))
    rows = i.docs.join(i.postings, "doc_id", "left")
    return rows.select("doc_id", F.col("length").cast("long").alias("length"), "term", F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions")).na.fill(-1).na.fill("")


def rebuilt_segment(spark, sf_dir):
    docs = listed(spark, DOCS, [("x.md", 0, {}, "X", ""), ("y.md", 0, {}, "", ""), ("z.md", 5, {}, "", "")])
    i = rebuild(docs, listed(spark, POSTINGS, SEGMENT_POSTINGS))
    rows = i.docs.join(i.postings, "doc_id", "left")
    return rows.select("doc_id", F.col("length").cast("long").alias("length"), "term", F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions")).na.fill(-1).na.fill("")


def replaced_document(spark, sf_dir):
    new = listed(spark, TOKENED, [("n.txt", ["delta", "beta"], {}, "new", "h"), ("z", ["delta"], {}, "", "")])
    terms = upsert(corpus(spark), new).terms()
    return terms.select("term", F.col("doc_freq").cast("long").alias("doc_freq"), F.col("total_freq").cast("long").alias("total_freq"))


def field_facets(spark, sf_dir):
    """Documents without a field count under the empty value."""
    i = corpus(spark)
    return S.facet_counts(S.selected(i, parse("beta")), ["language", "kind", "nothing", "kind"])


def kind_counts(spark, sf_dir):
    return stats.by_field(corpus(spark), "kind")


def titles_in_order(spark, sf_dir):
    return corpus(spark).docs.orderBy("doc_id").select("doc_id", "title", F.col("length").cast("long").alias("length"))


# --- change, cache ----------------------------------------------------------------------------------------------


def repeated_paths(spark, sf_dir):
    """Of a path that a scan has twice, the last row counts."""
    ddl = "rel string, size long, mtime_ns long, seq long"
    before = listed(spark, ddl, [("a", 1, 1, 0), ("a", 2, 1, 1), ("b", 1, 1, 2), ("c", 1, 1, 3), ("n", None, 1, 4)])
    now = listed(spark, ddl, [("a", 2, 1, 0), ("b", 1, 2, 1), ("d", 1, 1, 2), ("n", None, 1, 3)])
    return changes.plan(before, now)


def cache_replaced(spark, sf_dir):
    ddl = "doc_id string, content_hash string"
    cache = listed(spark, ddl, [("a", "1"), ("b", "1"), ("c", "1")])
    return changes.cache_put(cache, listed(spark, ddl, [("b", "2"), ("d", "2")]))


def cache_unreadable(spark, sf_dir):
    """A cache that isn't there is empty."""
    return changes.load_cache(spark, f"{sf_dir}/no-such-cache", "doc_id string, content_hash string")


# --- reports ----------------------------------------------------------------------------------------------------

REPORT = S.Report(
    S.Options("alpha | x", {"lang": "go", "dir": "a\nb"}, 2, ("kind", "lang")),
    7,
    [
        {"doc_id": "d/1", "path": "d/1", "title": "One | two\nlines", "score": 0.46535, "freq": 3, "fields": {"kind": "text", "dir": "d"}, "snippet": ""},
        {"doc_id": "id2", "path": "", "title": "", "score": 12.0, "freq": 0, "fields": {}, "snippet": "tick ` <b>"},
    ],
    {"lang": {"go": 2, "": 5}, "kind": {}},
)
NOTHING = S.Report(S.Options(" ", {}, 0, ()), 0, [], {})
TEXT_LINES = """query: alpha | x
filters: dir=a b, lang=go
total: 7
shown: 2

1. d/1
   title: One | two lines
   score: 0.4653
   freq: 3
   fields: dir=d, kind=text

2. id2
   title: 
   score: 12.0000
   freq: 0
   snippet: tick ` <b>

facets:
  kind:
  lang:
    (none): 5
    go: 2"""
MARKDOWN_LINES = r"""# Search report

- Query: `alpha \| x`
- Filters: `dir=a b, lang=go`
- Total: 7
- Shown: 2

| # | Score | Freq | Document | Title | Snippet |
| --- | --- | --- | --- | --- | --- |
| 1 | 0.4653 | 3 | `d/1` | One \| two lines |  |
| 2 | 12.0000 | 0 | `id2` |  | tick ` <b> |

## Facet: kind

| Value | Count |
| --- | --- |

## Facet: lang

| Value | Count |
| --- | --- |
| (none) | 5 |
| `go` | 2 |"""
CSV_LINES = """rank,doc_id,path,title,score,freq,fields,snippet
1,d/1,d/1,One | two lines,0.4653,3,dir=d;kind=text,
2,id2,id2,,12.0000,0,,tick ` <b>"""
JSON_LINES = r"""{
  "query": "alpha | x",
  "filters": {
    "dir": "a\nb",
    "lang": "go"
  },
  "limit": 2,
  "requested_facets": [
    "kind",
    "lang"
  ],
  "total": 7,
  "shown": 2,
  "results": [
    {
      "rank": 1,
      "doc_id": "d/1",
      "path": "d/1",
      "title": "One | two\nlines",
      "score": 0.46535,
      "freq": 3,
      "fields": {
        "dir": "d",
        "kind": "text"
      },
      "snippet": ""
    },
    {
      "rank": 2,
      "doc_id": "id2",
      "path": "id2",
      "title": "",
      "score": 12,
      "freq": 0,
      "fields": {},
      "snippet": "tick ` \u003cb\u003e"
    }
  ],
  "facets": [
    {
      "field": "kind",
      "counts": {}
    },
    {
      "field": "lang",
      "counts": {
        "": 5,
        "go": 2
      }
    }
  ]
}"""
EMPTY_TEXT = "query: (all documents)\ntotal: 0\nshown: 0\n\nno matching documents"
EMPTY_MARKDOWN = "# Search report\n\n- Query: _(all documents)_\n- Total: 0\n- Shown: 0\n\n_No matching documents._"
STATS_LINES = """documents: 3
terms: 12
tokens: 40

by kind:
  markdown: 1
  text: 2

by language:
  (none): 2
  go: 1

largest documents:
  1. a b: 30
  2. c: 10"""
CELLS = [("one_line", "a\r\nb\tc", "a b c"), ("cell", "a|b\n", "a\\|b "), ("code", "x`y|", "`x'y\\|`"), ("code", "", ""), ("score", "0.00005", "0.0001"), ("score", "2.5", "2.5000")]
#: filter or facet arguments; what they say.
ARGUMENTS = [("filter", "kind:go", "kind=go"), ("filter", " kind :a:b", "kind=a:b"), ("filter", "kind:", "kind="), ("filter", "kind", "refused"), ("filter", ":x", "refused"), ("facet", "kind, lang,,kind", "kind,lang"), ("facet", "", ""), ("limit", "7", "7"), ("limit", " ", "0"), ("limit", "x", "refused")]


def _lines(*texts: str) -> list[tuple]:
    return [(k, i, line) for k, text in enumerate(texts) for i, line in enumerate(text.split("\n"))]


def _report(render, *reports):
    def run(spark, sf_dir):
        return listed(spark, "report long, line long, text string", _lines(*(render(r).removesuffix("\n") for r in reports)))

    return run


def report_stats(spark, sf_dir):
    c = report.Corpus(3, 12, 40, {"text": 2, "markdown": 1}, {"go": 1, "": 2}, [("a\nb", 30), ("c", 10)])
    return listed(spark, "report long, line long, text string", _lines(report.stats(c).removesuffix("\n")))


def report_cells(spark, sf_dir):
    makers = {"one_line": report.one_line, "cell": report.cell, "code": report.code, "score": lambda x: report.score(float(x))}
    return listed(spark, "what string, value string, cell string", [(k, v, makers[k](v)) for k, v, _ in CELLS])


def argument_cases(spark, sf_dir):
    rows = []
    for what, text, _ in ARGUMENTS:
        try:
            if what == "filter":
                said = ",".join(f"{k}={v}" for k, v in server.parse_filters([text]).items())
            else:
                said = ",".join(server.parse_facets([text])) if what == "facet" else str(server.parse_limit(text))
        except UsageError:
            said = "refused"
        rows.append((what, text, said))
    return listed(spark, "what string, argument string, said string", rows)


# --- registered -------------------------------------------------------------------------------------------------


def queries():
    plain = [parse_cases, parse_round_trip, clause_cases, path_predicate, glob_cases, glob_syntax, setting_checks, setting_hashes, supported_extensions]
    plain += [binary_cases, title_cases, normal_cases, extract_cases, token_cases, stopword_cases, score_guards, total_order, imported_postings, rebuilt_segment, replaced_document]
    plain += [field_facets, kind_counts, titles_in_order, repeated_paths, cache_replaced, cache_unreadable, report_stats, report_cells, argument_cases]
    found = {f.__name__: f for f in plain}
    found |= {"selection_cases": _selections(corpus), "selection_stored": _selections(stored_corpus), "score_cases": _scores(corpus), "score_stored": _scores(stored_corpus)}
    found |= {"report_text": _report(report.text, REPORT, NOTHING), "report_markdown": _report(report.markdown, REPORT, NOTHING)}
    return found | {"report_csv": _report(report.as_csv, REPORT), "report_json": _report(report.as_json, REPORT)}


def _bm25(tf: int, df: int, length: str, mean: str, n: int = DOCUMENTS) -> str:
    return f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5)) * ({tf} * 2.2) / ({tf} + 1.2 * (0.25 + 0.75 * {length} / {mean}))"


def oracle_sql() -> dict[str, str]:
    mean = f"({OCCURRENCES}.0 / {DOCUMENTS})"
    scored = []
    for q, rows in SCORED.items():
        for d, words, length, freq in rows:
            score = " + ".join(f"CAST({_bm25(tf, DOCUMENT_FREQUENCIES[w], str(length), mean)} AS DOUBLE)" for w, tf in words) or "0"
            scored.append(f"SELECT {sql_value(q)} AS query, '{d}' AS doc_id, CAST({freq} AS BIGINT) AS freq, round(CAST({score} AS DOUBLE), 12) AS score")
    guard = f"round(CAST({_bm25(2, 1, '1', '1', 2)} AS DOUBLE), 12)"
    selection = literal("query, doc_id, freq", [(q, d, n) for q, rows in FOUND.items() for d, n in rows])
    lines = "report, line, text"
    found = {
        "parse_cases": literal("query, canonical, clauses, byte, reason", PARSED),
        "parse_round_trip": literal("query, again", [(t, c) for t, c, n, *_ in PARSED if n >= 0]),
        "clause_cases": literal("query, place, negated, field, words", CLAUSES),
        "path_predicate": literal("path, size, belongs", PATHS),
        "glob_cases": literal("pattern, path, held", GLOBS),
        "glob_syntax": literal("pattern, valid", SYNTAX),
        "setting_checks": literal("setting, value, refused", [(n, str(v), r) for n, v, r in SETTINGS]),
        "setting_hashes": literal("change, same", HASHES),
        "supported_extensions": literal("ext, supported", EXTENSIONS),
        "binary_cases": literal("k, is_binary", [(i, x[-1]) for i, x in enumerate(BINARY)]),
        "title_cases": literal("k, title", [(i, x[-1]) for i, x in enumerate(TITLES)]),
        "normal_cases": literal("k, body", [(i, x[-1]) for i, x in enumerate(NORMAL)]),
        "extract_cases": f"SELECT doc_id, kind, language, dir, ext, title, body, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS content_hash FROM ({literal('doc_id, content, kind, language, dir, ext, title, body', EXTRACTED)})",
        "token_cases": literal("k, terms", [(i, x[-1]) for i, x in enumerate(TOKENIZED)]),
        "stopword_cases": literal("word, stops", STOPPED),
        "selection_cases": selection,
        "selection_stored": selection,
        "score_cases": " UNION ALL ".join(scored),
        "score_stored": " UNION ALL ".join(scored),
        "score_guards": f"SELECT 'w' AS query, 'a' AS doc_id, {guard} AS score UNION ALL SELECT '-v', 'a', 0.0 UNION ALL SELECT 'w w', 'a', round(2 * {guard.replace('round(', '(').replace(', 12)', ')')}, 12)",
        "total_order": literal("page, doc_id", [("first 3", x) for x in "dca"] + [("all", x) for x in "dcabe"] + [("last id", "e")]),
        "imported_postings": literal("doc_id, length, term, tf, positions", [("p", 2, "x", 2, "1,4"), ("q", 7, "x", 1, "0"), ("r", 0, "", -1, "")]),
        "rebuilt_segment": literal("doc_id, length, term, tf, positions", [("x.md", 5, "pair", 1, "0"), ("x.md", 5, "last", 1, "3"), ("x.md", 5, "more", 1, "4"), ("x.md", 5, "solo", 2, "5,6"), ("y.md", 2, "only", 2, "0,1"), ("z.md", 0, "", -1, "")]),
        "replaced_document": literal("term, doc_freq, total_freq", [("alpha", 2, 3), ("beta", 4, 5), ("gamma", 3, 5), ("delta", 2, 2)]),
        "field_facets": literal("field, value, count", [("kind", "markdown", 2), ("kind", "text", 1), ("kind", "source", 1), ("language", "", 3), ("language", "go", 1), ("nothing", "", 4)]),
        "kind_counts": literal("value, count", [("markdown", 2), ("text", 1), ("source", 2), ("", 1)]),
        "titles_in_order": literal("doc_id, title, length", [("docs/a.md", "A", 4), ("docs/b.md", "B", 3), ("n.txt", "N", 2), ("src/c.go", "", 2), ("src/d.go", "D | x", 3), ("void", "", 0)]),
        "repeated_paths": literal("rel, kind", [("b", "modified"), ("c", "removed"), ("d", "added")]),
        "cache_replaced": literal("doc_id, content_hash", [("a", "1"), ("b", "2"), ("c", "1"), ("d", "2")]),
        "cache_unreadable": literal("doc_id, content_hash", [("x", "y")]) + " WHERE false",
        "report_text": literal(lines, _lines(TEXT_LINES, EMPTY_TEXT)),
        "report_markdown": literal(lines, _lines(MARKDOWN_LINES, EMPTY_MARKDOWN)),
        "report_csv": literal(lines, _lines(CSV_LINES)),
        "report_json": literal(lines, _lines(JSON_LINES)),
        "report_stats": literal(lines, _lines(STATS_LINES)),
        "report_cells": literal("what, value, cell", CELLS),
        "argument_cases": literal("what, argument, said", ARGUMENTS),
    }
    return found
