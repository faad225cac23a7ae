from pyspark.sql import functions as F

from sparkdex.config import Config
from sparkdex.functions import text as T
from sparkdex.functions.globs import any_match, valid_glob


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_tokens(spark):
    cases = [
        ("The quick-brown FOX", Config(), ["quick", "brown", "fox"]),
        ("a b cc", Config(), ["cc"]),
        ("İstanbul ΟΔΟΣ", Config(), ["istanbul", "οδοσ"]),
        ("x1 v2 é", Config(min_term_length=1), ["x1", "v2", "é"]),
        ("alpha Beta the", Config(stopwords=(" BETA ",)), ["alpha", "the"]),
        ("them the then themes he her", Config(), ["themes"]),
        ("a I you yo", Config(min_term_length=3, stopwords=("yo", "b-c")), ["you"]),
        ("ǅ Ⅷ x² ١٢ 日本 ÅΣΑΣ", Config(stopwords=("zz",)), ["١٢", "日本", "åσασ"]),
        ("", Config(), []),
        (None, Config(), []),
    ]
    for text, cfg, want in cases:
        assert one(spark, lambda c, cfg=cfg: T.tokens(c, cfg), text) == want, text


def test_stopwords():
    assert T.is_stopword(Config(), " The ") and not T.is_stopword(Config(), "") and not T.is_stopword(Config(), "fox")
    assert len(T.STOPWORDS) == 86


def test_normalized(spark):
    cases = {
        "﻿abc": "abc",
        "a\r\nb\rc": "a\nb\nc",
        "a\tb": "a b",
        "a  \nb ": "a\nb",
        "\n\na\n\n\n\nb\n\n": "a\n\nb",
        "": "",
        "a\n \n \nb": "a\n\nb",
    }
    for text, want in cases.items():
        assert one(spark, T.normalized, text) == want, repr(text)


def test_title(spark):
    cases = [
        ("# Alpha Guide\n\ntext", "markdown", "Alpha Guide"),
        ("intro\n## Two ##\n", "markdown", "Two"),
        ("#\n#no\n", "markdown", "#"),
        ("\nfirst line\n", "text", "first line"),
        ("// package x\ncode", "source", "package x"),
        ("", "text", "n.txt"),
        ("x" * 130, "text", "x" * 120),
    ]
    for body, kind, want in cases:
        got = one(spark, lambda c, kind=kind: T.title_of(c, F.lit("d/n.txt"), F.lit(kind)), body)
        assert got == want, (body, got)


def test_kinds(spark):
    rows = spark.createDataFrame([("a/b.md",), ("x.Go",), ("noext",), ("a.b/c",), ("d/x.tar.gz",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in rows.select(T.kind_of(T.extension(p)), T.language_of(T.extension(p)), T.directory(p), T.extension(p)).collect()]
    assert got == [("markdown", "", "a", ".md"), ("source", "go", ".", ".go"), ("other", "", ".", ""), ("other", "", "a.b", ""), ("other", "", "d", ".gz")]
    assert T.supported_extension("PY") and T.supported_extension(".md") and not T.supported_extension("bin")


def test_binary(spark):
    e = "é".encode()
    cases = {
        b"": False,
        b"text\n\t\f": False,
        b"a\0b": True,
        b"\xff\xfe": True,
        b"\x01" * 31 + b"a" * 69: True,
        b"\x01" * 30 + b"a" * 70: False,
        b"\x7f" * 31 + b"a" * 69: True,
        b"a" * 7999 + e + b"b": False,
        b"a" * 7998 + e + b"b": False,
        b"a" * 7998 + "日".encode() + b"b": False,
        b"a" * 7997 + "😀".encode() + b"b": False,
        b"a" * 7997 + b"\xf0\x9f\x98": True,
        b"a" * 7997 + b"\x98\x98\x98": True,
        b"a" * 7996 + b"\x98\x98\x98\x98b": True,
        b"a" * 7999 + b"\xc3": True,
        b"a" * 100 + b"\xc3": True,
        b"a" * 8000 + b"\0": False,
        b"\x01" * 2400 + b"a" * 5600 + b"\x01" * 99: False,
        b"\x01" * 2401 + b"a" * 5599 + b"a" * 999: True,
    }
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(cases)] + [(99, None)], "i int, content binary")
    got = {r.i: r.b for r in rows.select("i", T.is_binary("content").alias("b")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] is False


def test_globs():
    assert any_match(["*.md"], "docs/deep/x.md") and not any_match(["docs/*.md"], "docs/deep/x.md") and any_match(["docs/*/x.md"], "docs/deep/x.md")
    assert any_match(["[a-c]?.txt"], "b1.txt") and not any_match(["[^a-c]?.txt"], "b1.txt") and any_match(["\\*"], "*")
    for bad in ("[", "[]", "[a", "[a-]", "\\"):
        assert not valid_glob(bad) and not any_match([bad], bad), bad
