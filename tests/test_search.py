import math

import pytest

from sparkdex.errors import QueryError
from sparkdex.operators import changes, stats
from sparkdex.operators.index import Index, add_postings, beside, build, empty, frequencies, merge, numbered, segment_terms, segmented, upsert
from sparkdex.plans import search as S
from sparkdex.plans.query import Clause, Query, parse

TOKENS = "doc_id string, tokens array<string>, fields map<string,string>, title string, content_hash string"
CORPUS = [
    ("docs/alpha.md", "alpha beta alpha gamma", {"kind": "markdown", "dir": "docs"}),
    ("docs/beta.md", "beta gamma beta", {"kind": "markdown", "dir": "docs"}),
    ("notes.txt", "beta alpha", {"kind": "text", "dir": "."}),
    ("src/alpha.go", "alpha beta", {"kind": "source", "language": "go", "dir": "src"}),
    ("src/gamma.go", "gamma gamma gamma", {"kind": "source", "language": "go", "dir": "src"}),
]


def made(spark, rows):
    return build(spark.createDataFrame([(d, t.split(), f, d, d) for d, t, f in rows], TOKENS))


@pytest.fixture(scope="module", params=["stored", "texts"])
def index(spark, request):
    """An index of postings alone, as it is read from a generation, and one with its documents at hand."""
    i = made(spark, CORPUS)
    return Index(i.docs.cache(), i.postings.cache()) if request.param == "stored" else i


QUERIES = {
    "": {d: 0 for d, _, _ in CORPUS},
    "alpha beta": {"docs/alpha.md": 3, "notes.txt": 2, "src/alpha.go": 2},
    "beta -gamma": {"notes.txt": 1, "src/alpha.go": 1},
    "-alpha": {"docs/beta.md": 0, "src/gamma.go": 0},
    "kind:markdown alpha": {"docs/alpha.md": 2},
    '"alpha beta"': {"docs/alpha.md": 1, "src/alpha.go": 1},
    '"beta alpha"': {"docs/alpha.md": 1, "notes.txt": 1},
    '"gamma alpha"': {},
    '"gamma gamma"': {"src/gamma.go": 2},
    "alpha alpha": {"docs/alpha.md": 4, "notes.txt": 2, "src/alpha.go": 2},
    "the": {},
    "-kind:markdown -gamma": {"notes.txt": 0, "src/alpha.go": 0},
    '-"beta alpha" beta': {"docs/beta.md": 2, "src/alpha.go": 1},
}


@pytest.mark.parametrize("query", QUERIES)
def test_selection(index, query):
    assert {r.doc_id: r.freq for r in S.selected(index, parse(query)).collect()} == QUERIES[query]


def test_filters_facets_and_page(index):
    got = {r.doc_id for r in S.selected(index, parse(""), {"language": ""}).collect()}
    assert got == {"docs/alpha.md", "docs/beta.md", "notes.txt"}
    r = S.search(index, S.Options("", facets=("kind", "language", "absent"), limit=2))
    assert r.total == 5 and len(r.results) == 2
    assert r.facets == {"kind": {"markdown": 2, "source": 2, "text": 1}, "language": {"": 3, "go": 2}, "absent": {"": 5}}
    assert [x["doc_id"] for x in S.search(index, S.Options("")).results] == sorted(d for d, _, _ in CORPUS)
    assert S.search(index, S.Options("nothing", facets=("kind",))).facets == {"kind": {}}


def test_empty_index(spark):
    i = empty(spark)
    assert i.totals() == (0, 0.0) and S.search(i, S.Options("x", facets=("k",))).total == 0
    assert stats.compute(i) == stats.Corpus()
    assert segmented(i.docs, 2).count() == 0


def test_scores(spark):
    rows = [("d1", "alpha alpha alpha beta", 10), ("d2", "alpha", 20), ("d3", "beta beta", 30), ("d4", "gamma", 40)]
    i = made(spark, [(d, " ".join(t.split() + ["fill"] * (n - len(t.split()))), {}) for d, t, n in rows])

    def scores(q):
        q = parse(q)
        return {r.doc_id: r.score for r in S.scored(i, q, S.selected(i, q)).collect()}

    want = {"alpha": {"d1": 1.2499375387146556, "d2": 0.75491277090687114}, "beta": {"d1": 0.91862879351318039, "d3": 0.90232177350998799}, "gamma": {"d4": 0.96669349252447423}}
    for q, found in want.items():
        got = scores(q)
        assert got.keys() == found.keys() and all(math.isclose(got[d], found[d], abs_tol=1e-12) for d in found)
    assert math.isclose(scores("alpha alpha")["d1"], 2 * want["alpha"]["d1"], abs_tol=1e-12)
    assert math.isclose(scores('"alpha beta"')["d1"], want["alpha"]["d1"] + want["beta"]["d1"], abs_tol=1e-12)
    assert scores("-alpha")["d4"] == 0.0


def test_index_maintenance(spark, index):
    assert {(r.term, r.doc_freq, r.total_freq) for r in index.terms().collect()} == {("alpha", 3, 4), ("beta", 4, 5), ("gamma", 3, 5)}
    other = made(spark, [("notes.txt", "delta", {"kind": "new"}), ("z", "alpha", {})])
    m = merge(index, other)
    assert {(r.term, r.doc_freq, r.total_freq) for r in m.terms().collect()} == {("alpha", 3, 4), ("beta", 3, 4), ("gamma", 3, 5), ("delta", 1, 1)}
    assert m.of_doc("notes.txt").first().fields == {"kind": "new"} and m.docs.count() == 6
    up = upsert(index, spark.createDataFrame([("notes.txt", ["delta"], {}, "", "")], TOKENS))
    assert up.of_term("delta").count() == 1 and up.docs.count() == 5
    imported = add_postings(empty(spark), index.docs.selectExpr("doc_id", "0 as length", "fields", "title", "content_hash"), index.postings)
    assert {r.doc_id: r.length for r in imported.docs.collect()} == {d: len(t.split()) for d, t, _ in CORPUS}


def test_segments(spark):
    i = made(spark, [("a.md", "alpha beta alpha", {}), ("b.md", "beta gamma", {}), ("c.md", "alpha delta", {}), ("d.md", "gamma", {}), ("e.md", "epsilon epsilon beta", {})])
    parts = segmented(i.docs, 2)
    assert {r.doc_id: r.segment for r in parts.collect()} == {"a.md": "seg-0001", "b.md": "seg-0001", "c.md": "seg-0002", "d.md": "seg-0002", "e.md": "seg-0003"}
    counts = {r.segment: r["count"] for r in segment_terms(i, parts).groupBy("segment").count().collect()}
    assert counts == {"seg-0001": 3, "seg-0002": 3, "seg-0003": 2}
    assert {r.segment for r in segmented(i.docs, 0).collect()} == {"seg-0001"}


def test_numbers_of_many_rows(spark):
    """More rows than a range partitioning samples whole: its bounds, and so the numbers, differed between two passes."""
    from pyspark.sql import functions as F

    ids = spark.range(0, 30000, 1, 3).select(F.format_string("d/%06d", F.col("id") * 7919 % 30000).alias("doc_id"))
    assert numbered(ids).where("ordinal <> cast(substr(doc_id, 3) as long)").count() == 0
    assert numbered(ids).select("ordinal").distinct().count() == 30000
    few = numbered(spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "doc_id string"))
    assert sorted(((r.doc_id or "", r.ordinal) for r in few.collect())) == [("", 0), ("a", 1), ("b", 2), ("b", 3)]


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_postings_are_grouped_within_rows(spark):
    """Nothing is sorted or aggregated by term, over however many rows; texts of one id are one document."""
    import re

    rows = [("x", ["b", "a", "b"]), ("y", []), ("x", ["a", "c"]), ("z", ["\U0001d7d8", "\uff5a", "\uff5a"])]
    i = build(spark.createDataFrame([(d, t, {}, d, d) for d, t in rows], TOKENS))
    got = {(r.doc_id, r.term): (r.tf, list(r.positions)) for r in i.postings.collect()}
    assert got == {("x", "a"): (2, [0, 1]), ("x", "b"): (2, [0, 2]), ("x", "c"): (1, [1]), ("z", "\U0001d7d8"): (1, [0]), ("z", "\uff5a"): (2, [1, 2])}
    assert i.postings.count() == 5
    plan = plan_of(i.postings)
    assert not re.search(r"(keys|key)=\[[^\]]*term", plan) and not re.search(r"\bSort \[", plan)


def exchanges(plan, what):
    """Lines of a plan that shuffle or sort, of the side that carries ``what``."""
    return [x for x in plan.splitlines() if what in x and ("Sort [" in x or "SortMergeJoin" in x or "ENSURE_REQUIREMENTS" in x)]


def test_segment_terms_of_many_documents(spark):
    """Against a plain count, for more documents than a range partitioning samples whole; postings aren't sorted."""
    rows = [(f"d/{k * 7919 % 6000:06d}", ["a", f"w{k % 7}", "a"], {}, "", "") for k in range(6000)]
    i = build(spark.createDataFrame(rows, TOKENS))
    got = segment_terms(i, segmented(i.docs, 50))
    want = {}
    for d, words, *_ in rows:
        segment = f"seg-{int(d[2:]) // 50 + 1:04d}"
        for w in set(words):
            df, tf = want.get((segment, w), (0, 0))
            want[segment, w] = df + 1, tf + words.count(w)
    assert {(r.segment, r.term): (r.doc_freq, r.total_freq) for r in got.collect()} == want
    assert "SortMergeJoin" not in plan_of(got)


def large(spark, rows):
    """An index of rows whose size isn't known to be small, as over a table."""
    return build(spark.createDataFrame([(d, t.split(), f, d, d) for d, t, f in rows], TOKENS).repartition(3))


def test_imported_postings_are_not_shuffled_again(spark):
    i = large(spark, CORPUS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = add_postings(Index(i.docs.limit(0), i.postings.limit(0)), i.docs.selectExpr("doc_id", "0 as length", "fields", "title", "content_hash"), i.postings)
        lengths = frequencies(beside(again.postings, again.docs.select("doc_id", "length")), ["term"])
        assert "SortMergeJoin" not in plan_of(again.postings) and "SortMergeJoin" not in plan_of(lengths)
        assert not exchanges(plan_of(again.postings), "term#")
        assert {(r.term, r.doc_freq, r.total_freq) for r in lengths.collect()} == {("alpha", 3, 4), ("beta", 4, 5), ("gamma", 3, 5)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merged_postings_are_not_sorted(spark):
    """The last index's documents, an emptied one among them; no task holds its postings to sort or join them."""
    i = large(spark, CORPUS)
    new = large(spark, [("notes.txt", "delta delta", {}), ("src/gamma.go", "", {}), ("z", "alpha", {})])
    newest = large(spark, [("z", "omega", {})])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = merge(i, new, newest)
        want = {("alpha", 2, 3), ("beta", 3, 4), ("gamma", 2, 2), ("delta", 1, 2), ("omega", 1, 1)}
        for x in (m, Index(m.docs, m.postings)):
            assert {(r.term, r.doc_freq, r.total_freq) for r in x.terms().collect()} == want
            assert "SortMergeJoin" not in plan_of(x.terms())
        assert m.docs.count() == 6
        assert {r.doc_id: r.freq for r in S.selected(m, parse("alpha")).collect()} == {"docs/alpha.md": 2, "src/alpha.go": 1}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stats(index):
    c = stats.compute(index)
    assert (c.documents, c.terms, c.tokens) == (5, 3, 14)
    assert c.by_kind == {"markdown": 2, "source": 2, "text": 1} and c.by_language == {"": 3, "go": 2}
    assert c.largest[:2] == [("docs/alpha.md", 4), ("docs/beta.md", 3)]


def test_changes(spark):
    ddl = "rel string, size long, mtime_ns long, seq long"
    a = spark.createDataFrame([("x", 1, 1, 0), ("y", 1, 1, 1), ("z", 1, 1, 2), ("x", 2, 1, 3)], ddl)
    b = spark.createDataFrame([("x", 2, 1, 0), ("y", 1, 5, 1), ("w", 1, 1, 2)], ddl)
    assert {tuple(r) for r in changes.plan(a, b).collect()} == {("y", "modified"), ("z", "removed"), ("w", "added")}
    cache = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, content_hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "doc_id string, content_hash string")
    assert [r.doc_id for r in changes.cache_hits(now, cache).collect()] == ["a"]
    assert sorted(r.doc_id for r in changes.cache_misses(now, cache).collect()) == ["b", "c"]
    assert {tuple(r) for r in changes.cache_put(cache, now.where("doc_id = 'b'")).collect()} == {("a", "1"), ("b", "3")}
    kept, gone = changes.cache_prune(cache, now.where("doc_id = 'a'"))
    assert kept.count() == 1 and gone.count() == 1
    assert changes.load_cache(spark, "/nowhere/at/all", "doc_id string").count() == 0


@pytest.mark.parametrize(
    "text,at,reason",
    [
        ("-", 0, "missing term after '-'"),
        ("a - b", 2, "missing term after '-'"),
        (":x", 0, "missing field name before ':'"),
        ("é :x", 3, "missing field name before ':'"),
        ("kind:", 4, "missing value after ':'"),
        ("kind: x", 4, "missing value after ':'"),
        ('ab"c', 2, "unexpected quote"),
        ('"abc', 0, "unterminated quote"),
        ('""', 0, "empty phrase"),
        ('"a"b', 3, "unexpected text after quote"),
        ('f:"a', 2, "unterminated quote"),
    ],
)
def test_query_errors(text, at, reason):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert (e.value.position, e.value.reason) == (at, reason)


def test_query_parsing():
    assert parse("  ") == Query() and parse("").match_all
    assert parse('Foo -KIND:Go "A  b" path:a:b').clauses == (Clause("foo"), Clause("Go", field="kind", negate=True), Clause(phrase=("a", "b")), Clause("a:b", field="path"))
    assert parse("--x").clauses == (Clause("-x", negate=True),)
    for q in ("foo", '-"a b" c', 'kind:"A b" -lang:Go x', "a:b:c"):
        assert parse(str(parse(q))) == parse(q)
