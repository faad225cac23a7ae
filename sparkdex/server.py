"""GET /search and /healthz over one session."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .errors import EngineError, UsageError
from .plans.search import Options, Report
from .report import encoded


def parse_limit(text: str) -> int:
    try:
        return int(text) if text.strip() else 0
    except ValueError:
        raise UsageError("", f"limit must be an integer, got {text!r}") from None


def parse_filters(values: list[str], command: str = "") -> dict[str, str]:
    """field:value; the last of a field counts."""
    out = {}
    for raw in values:
        name, colon, value = raw.partition(":")
        if not colon or not name.strip():
            raise UsageError(command, f"filter must be field:value: {raw}")
        out[name.strip()] = value
    return out


def parse_facets(values: list[str]) -> tuple[str, ...]:
    names = [f.strip() for v in values for f in v.split(",")]
    return tuple(dict.fromkeys(f for f in names if f))


def body(r: Report) -> dict:
    """A report as the server shows it: names as in the data model, absent collections as null."""
    o = r.options
    results = [{"DocID": x["doc_id"], "Path": x["path"], "Title": x["title"], "Score": x["score"], "Freq": x["freq"], "Fields": dict(sorted(x["fields"].items())), "Snippet": x["snippet"]} for x in r.results]
    facets = {f: {"Field": f, "Counts": dict(sorted(c.items()))} for f, c in sorted(r.facets.items())}
    options = {"Query": o.query, "Filters": dict(sorted(o.filters.items())) or None, "Limit": o.limit, "Facets": list(o.facets) or None}
    return {"Options": options, "Total": r.total, "Results": results, "Facets": facets}


class Handler(BaseHTTPRequestHandler):
    app = root = None

    def log_message(self, *args) -> None:
        pass

    def reply(self, status: int, data: bytes, kind: str, **headers: str) -> None:
        self.send_response(status)
        for name, value in {"Content-Type": f"{kind}; charset=utf-8", "Content-Length": str(len(data)), **headers}.items():
            self.send_header(name, value)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(data)

    def fail(self, status: int, message: str, **headers: str) -> None:
        self.reply(status, encoded({"Error": message, "Status": status}).encode(), "application/json", **headers)

    def do_GET(self) -> None:
        url = urlsplit(self.path)
        if url.path == "/healthz":
            self.reply(200, b"ok", "text/plain")
        elif url.path != "/search":
            self.fail(404, f"no such endpoint: {url.path}")
        elif self.app is None:
            self.fail(500, "this server has no application to search with")
        else:
            asked = parse_qs(url.query, keep_blank_values=True)
            first = lambda k: asked.get(k, [""])[0]
            try:
                options = Options(first("q"), parse_filters(asked.get("filter", [])), parse_limit(first("limit")), parse_facets(asked.get("facet", [])))
                self.reply(200, encoded(body(self.app.search(first("root").strip() or self.root, options))).encode(), "application/json")
            except EngineError as e:
                self.fail(e.status, str(e))

    do_HEAD = do_GET

    def refused(self) -> None:
        if urlsplit(self.path).path in ("/search", "/healthz"):
            self.fail(405, f"method not allowed: {self.command}", Allow="GET, HEAD")
        else:
            self.fail(404, f"no such endpoint: {urlsplit(self.path).path}")

    do_POST = do_PUT = do_DELETE = do_PATCH = do_OPTIONS = refused


def serve(app, root: str, host: str, port: int) -> ThreadingHTTPServer:
    """A bound server; its serve_forever() answers."""
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"app": app, "root": root}))
