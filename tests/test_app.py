import io
import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from sparkdex import cli, config, report
from sparkdex.app import App
from sparkdex.config import Config
from sparkdex.errors import ConfigError, IntegrityError, NotFound
from sparkdex.plans.search import Options
from sparkdex.server import serve
from sparkdex.sources import files, store
from sparkdex.workspace import Workspace

FILES = {
    "docs/alpha.md": b"# Alpha Guide\n\nalpha beta gamma alpha indexing\n",
    "docs/beta.md": b"# Beta Notes\n\nbeta gamma searching\n",
    "src/main.go": b'package main\n\nfunc main() { println("alpha") }\n',
    "readme.txt": b"plain text alpha\n",
    "assets/pic.bin": b"\x00\x01\x02",
}


def write(root, found):
    for name, data in found.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)


@pytest.fixture(scope="module")
def app(spark):
    return App(spark)


@pytest.fixture(scope="module")
def corpus(app, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    write(root, FILES)
    app.index(root)
    return root


def test_walk_and_predicate(tmp_path):
    root = str(tmp_path)
    write(root, {n: b"x" for n in ("README.md", "Makefile", "docs/guide.md", "docs/deep/inner.md", "src/main.go", ".git/config", "sparkdex-out/seg.json", ".hidden")})
    os.symlink(os.path.join(root, "README.md"), os.path.join(root, "link.md"))
    assert [r[0] for r in files.walk(Config(root=root))] == [".hidden", "Makefile", "README.md", "docs/deep/inner.md", "docs/guide.md", "src/main.go"]
    assert [r[0] for r in files.walk(Config(root=root, include=("*.md",), exclude=("docs/deep/*",)))] == ["README.md", "docs/guide.md"]
    c = Config(root=root, max_file_bytes=10)
    assert files.matches(c, "a", 10) and not files.matches(c, "a", 11) and not files.matches(c, "../a", 1) and not files.matches(c, "/a", 1) and not files.matches(c, "x/.git/y", 1)
    with pytest.raises(NotFound):
        files.walk(Config(root=os.path.join(root, "none")))
    with pytest.raises(ConfigError):
        files.walk(Config(root=os.path.join(root, "README.md")))


def test_config(tmp_path):
    root = str(tmp_path)
    assert config.load(root) == Config(root=root)
    write(root, {config.FILE: b'{"Max File-bytes": 5, "min_term_length": 3, "include": ["*.md"], "exclude": null}'})
    c = config.load(root)
    assert (c.max_file_bytes, c.min_term_length, c.include, c.exclude) == (5, 3, ("*.md",), ())
    assert config.digest(Config(include=("a", "b"))) == config.digest(Config(root="/x", include=("b", "a"))) != config.digest(Config())
    for bad in (b"{", b"[]", b'{"x": 1}', b'{"include": [1]}', b'{"segment_docs": 0}', b'{"output_dir": "../x"}', b'{"output_dir": "/x"}', b'{"include": ["["]}', b'{"max_file_bytes": -1}', b'{"min_term_length": 1.5}'):
        write(root, {config.FILE: bad})
        with pytest.raises(ConfigError):
            config.load(root)


def test_search_end_to_end(app, corpus):
    r = app.search(corpus, Options("alpha"))
    assert r.total == 3 and r.results[0]["doc_id"] == "docs/alpha.md" and r.results[0]["freq"] == 3 and r.results[0]["title"] == "Alpha Guide"
    assert app.search(corpus, Options('"beta gamma"')).total == 2
    assert [x["doc_id"] for x in app.search(corpus, Options("gamma -alpha")).results] == ["docs/beta.md"]
    s = app.stats(corpus)
    assert s.documents == 4 and s.by_kind == {"markdown": 2, "source": 1, "text": 1} and s.by_language == {"": 3, "go": 1}


def test_reindex_reuses_and_replaces(app, tmp_path):
    root = str(tmp_path)
    write(root, FILES)
    first = app.index(root)
    assert (first.generation, first.doc_count, len(first.segments)) == (1, 4, 1)
    second = app.index(root)
    assert second.generation == 2 and second.logical_digest == first.logical_digest
    assert sorted(d for d in os.listdir(root + "/sparkdex-out") if d.startswith("gen-")) == ["gen-0002"]
    write(root, {"readme.txt": b"omega"})
    os.remove(root + "/docs/beta.md")
    third = app.index(root)
    assert third.doc_count == 3 and third.logical_digest != first.logical_digest
    assert app.search(root, Options("omega")).total == 1 and app.search(root, Options("searching")).total == 0
    assert app.validate(root).problems == []


def test_damage_is_found(app, tmp_path):
    root = str(tmp_path)
    write(root, FILES)
    m = app.index(root)
    with pytest.raises(NotFound):
        app.search(str(tmp_path / "docs"), Options("x"))
    name = m.files[0].path
    path = os.path.join(root, "sparkdex-out", name)
    whole = open(path, "rb").read()
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(IntegrityError):
        app.search(root, Options("x"))
    assert app.validate(root).problems == [f"{name}: content differs from its digest"]
    with open(path, "wb") as f:
        f.write(whole)
    os.makedirs(os.path.join(root, "sparkdex-out", store.STAGING))
    write(root, {config.FILE: b'{"min_term_length": 4}'})
    problems = app.validate(root).problems
    assert any("settings have changed" in p for p in problems) and any("cut off" in p for p in problems)
    bad = store.load_manifest(os.path.join(root, "sparkdex-out"))
    bad.segments.append(bad.segments[0])
    with pytest.raises(IntegrityError):
        store.ensure(store.manifest_problems(bad))
    wrong = [str(p) for p in store.file_problems(app.spark, root, [store.File(x, "d") for x in ("../x", "", "none", "docs", "readme.txt")] + [store.File("readme.txt", "")])]
    assert [w.split(": ", 1)[1] for w in wrong] == ["a path that isn't below the output folder"] * 2 + ["there is no such file", "not a file", "content differs from its digest", "has no digest"]


def test_one_segment(app, tmp_path):
    root = str(tmp_path)
    write(root, {f"d{k}.txt": f"word{k} shared".encode() for k in range(7)} | {config.FILE: b'{"segment_docs": 2}'})
    m = app.index(root)
    assert [(s.id, s.doc_count) for s in m.segments] == [(f"seg-000{k}", 2) for k in (1, 2, 3, 4)]  # the settings' file is a document
    assert [s.term_count for s in m.segments[1:]] == [3, 3, 3]
    i = store.read_segment(app.spark, config.load(root), "seg-0002")
    assert sorted(r.doc_id for r in i.docs.collect()) == ["d1.txt", "d2.txt"] and i.term_count() == 3
    with pytest.raises(NotFound):
        store.read_segment(app.spark, config.load(root), "seg-9999")


def test_publish_undone_on_failure(app, tmp_path, monkeypatch):
    root = str(tmp_path)
    write(root, FILES)
    app.index(root)
    monkeypatch.setattr(store, "logical_digest", lambda index: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        app.index(root)
    assert store.current_generation(root + "/sparkdex-out") == 1 and not os.path.exists(root + "/sparkdex-out/gen-0002")
    assert app.search(root, Options("alpha")).total == 3


def test_reports(app, corpus):
    r = app.search(corpus, Options("alpha", {"kind": "markdown"}, 1, ("kind", "language")))
    text = report.text(r)
    assert text.startswith("query: alpha\nfilters: kind=markdown\ntotal: 1\nshown: 1\n\n1. docs/alpha.md\n   title: Alpha Guide\n   score: ")
    assert text.endswith("facets:\n  kind:\n    markdown: 1\n  language:\n    (none): 1\n")
    assert "| 1 | " in report.markdown(r) and "## Facet: kind" in report.markdown(r)
    assert report.as_csv(r).splitlines()[0] == "rank,doc_id,path,title,score,freq,fields,snippet"
    j = json.loads(report.as_json(r))
    assert j["requested_facets"] == ["kind", "language"] and j["results"][0]["fields"]["dir"] == "docs" and j["facets"][1] == {"field": "language", "counts": {"": 1}}
    assert report.score(0.46535) == "0.4653" and report.encoded({"a": "<&>", "b": 2.0}) == '{\n  "a": "\\u003c\\u0026\\u003e",\n  "b": 2\n}\n'
    none = app.search(corpus, Options("absent"))
    assert "no matching documents" in report.text(none) and "_No matching documents._" in report.markdown(none)


def run(app, *args):
    out, err = io.StringIO(), io.StringIO()
    code = cli.Runner(lambda: app, out, err, forever=lambda s: None).run(list(args))
    return code, out.getvalue(), err.getvalue()


def test_cli(app, corpus, tmp_path):
    assert run(app, "stats", "-root", corpus)[0] == 0
    code, out, _ = run(app, "search", "-root", corpus, "-format", "csv", "-limit=1", "-facet", "kind", "alpha", "-gamma")
    assert code == 0 and out.splitlines()[1].startswith("1,")
    assert run(app, "search", "-root", corpus, "kind:")[0] == 2 and run(app, "search", "-format", "x")[0] == 2 and run(app, "search", "-filter", "x")[0] == 2
    assert run(app)[0] == 2 and run(app, "nope")[0] == 2 and run(app, "stats", "extra")[0] == 2 and run(app, "index", "-bad")[0] == 2
    assert run(app, "help")[0] == 0 and run(app, "search", "-h")[1].startswith("usage: sparkdex search") and run(app, "version")[1].startswith("sparkdex ")
    assert run(app, "stats", "-root", str(tmp_path))[0] == 1
    assert "problems: none" in run(app, "validate", "-root", corpus)[1] and "min_term_length: 2" in run(app, "config", "-root", corpus)[1]
    assert "listening on" in run(app, "serve", "-root", corpus, "-addr", "127.0.0.1:0")[1]
    root = str(tmp_path)
    assert run(app, "workspace", "list", "-root", root)[1] == "no corpora registered\n"
    assert run(app, "workspace", "add", "-root", root, "one", "/c/x/")[0] == 0 and run(app, "workspace", "add", "-root", root, "one", "/c")[0] == 1
    assert run(app, "workspace", "list", "-root", root)[1] == "* one\troot=/c/x\toutput=/c/x/sparkdex-out\n"
    assert run(app, "workspace", "remove", "-root", root, "one")[0] == 0 and run(app, "workspace", "remove", "-root", root, "one")[0] == 1
    assert run(app, "workspace")[0] == 2 and run(app, "workspace", "x")[0] == 2 and run(app, "workspace", "add", "a")[0] == 2


def test_watch(app, tmp_path):
    root, state = str(tmp_path / "c"), str(tmp_path / "state.json")
    write(root, {"a.txt": b"1", "b.txt": b"2"})
    assert run(app, "watch", "-root", root, "-state", state)[1] == "files: 2\nchanges: 2\n  added     a.txt\n  added     b.txt\n"
    write(root, {"a.txt": b"111"})
    os.remove(root + "/b.txt")
    assert run(app, "watch", "-root", root, "-state", state)[1] == "files: 1\nchanges: 2\n  modified  a.txt\n  removed   b.txt\n"
    assert run(app, "watch", "-root", root, "-state", state)[1] == "files: 1\nchanges: 0\n"


def test_workspace(tmp_path):
    w = Workspace()
    w.add("b", "/r")
    w.add("a", "r/../q", "out")
    assert w.active == "b" and [c.name for c in w.list()] == ["a", "b"] and w.get("a").output_path == "q/out"
    for args in (("", "/r"), ("x/y", "/r"), ("..", "/r"), ("n", " "), ("a", "/r")):
        with pytest.raises(ConfigError):
            w.add(*args)
    w.set_active("a")
    assert w.remove("a") and w.active == "b" and not w.remove("a")
    with pytest.raises(ConfigError):
        w.set_active("none")
    w.save(str(tmp_path))
    assert Workspace.load(str(tmp_path)) == w
    with pytest.raises(NotFound):
        Workspace.load(str(tmp_path / "none"), missing_ok=False)


def test_server(app, corpus):
    with serve(app, corpus, "127.0.0.1", 0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        base = "http://127.0.0.1:%d" % server.server_address[1]

        def get(path, method="GET"):
            try:
                with urllib.request.urlopen(urllib.request.Request(base + path, method=method)) as r:
                    return r.status, r.read().decode()
            except urllib.error.HTTPError as e:
                return e.code, e.read().decode()

        assert get("/healthz") == (200, "ok")
        status, body = get("/search?q=alpha&facet=kind,kind&limit=1&filter=kind:markdown")
        r = json.loads(body)
        assert status == 200 and r["Total"] == 1 and r["Results"][0]["DocID"] == "docs/alpha.md" and r["Facets"]["kind"]["Counts"] == {"markdown": 1}
        for path, want in (("/x", 404), ("/search?q=kind:", 400), ("/search?limit=x", 400), ("/search?filter=x", 400), ("/search?root=/nowhere", 404)):
            status, body = get(path)
            assert status == want and json.loads(body)["Status"] == want
        assert get("/search", "POST")[0] == 405
        server.shutdown()
