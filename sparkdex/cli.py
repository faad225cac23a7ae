"""The command line: index, search, stats, validate, config, workspace, serve, watch, version, help."""

from __future__ import annotations

import sys
from typing import TextIO

from . import __version__, config, report
from .errors import EngineError, NotFound, QueryError, UsageError
from .functions.text import stop_list
from .plans.query import parse as parse_query
from .plans.search import Options
from .server import parse_facets, parse_filters, serve
from .sources.store import read_json, write_json
from .workspace import Workspace

OK, ERROR, USAGE = 0, 1, 2
ROOT = ("root", ".", "corpus root directory")
#: Of each command: what it does, its flags (name, default, help; a list default repeats), and its arguments.
COMMANDS = {
    "index": ("index a corpus and publish a generation", [ROOT], ""),
    "search": (
        "search the published index",
        [
            ROOT,
            ("limit", 0, "maximum number of results, 0 for every result"),
            ("format", "text", "output format: text, md, csv or json"),
            ("filter", [], "keep only documents whose field:value matches"),
            ("facet", [], "count the values of a field over every match"),
        ],
        "[query ...]",
    ),
    "stats": ("print corpus statistics", [ROOT], ""),
    "validate": ("check the published index", [ROOT], ""),
    "config": ("print the settings in force", [ROOT], ""),
    "workspace list": ("list registered corpora", [ROOT], ""),
    "workspace add": ("register a corpus", [ROOT], "name root [output]"),
    "workspace remove": ("forget a corpus", [ROOT], "name"),
    "serve": ("answer searches over HTTP", [ROOT, ("addr", "127.0.0.1:8080", "listen address")], ""),
    "watch": ("report what changed since a former scan", [ROOT, ("state", "", "file holding the previous scan")], ""),
    "version": ("print the version", [], ""),
    "help": ("print help", [], "[command]"),
}


class HelpAsked(Exception):
    pass


def usage(command: str = "") -> str:
    if command not in COMMANDS:
        own = {k: v for k, v in COMMANDS.items() if k.startswith(f"{command} ")} if command else COMMANDS
        lines = [f"  {name:<18}{what}" for name, (what, _, _) in (own or COMMANDS).items()]
        return "usage: sparkdex <command> [flags] [arguments]\n\ncommands:\n" + "\n".join(lines) + "\n"
    what, flags, arguments = COMMANDS[command]
    head = f"usage: sparkdex {command}{' [flags]' * bool(flags)}{' ' + arguments if arguments else ''}\n  {what}\n"
    return head + "".join(f"  -{name}  {text}" + (f" (default {default!r})" if default not in ("", 0, []) else "") + "\n" for name, default, text in flags)


def parse(command: str, args: list[str]) -> tuple[dict, list[str]]:
    """Flags up to the first argument that isn't one, or "--"; what follows is arguments, dashes or not."""
    known = {name: default for name, default, _ in COMMANDS[command][1]}
    values = {k: list(v) if isinstance(v, list) else v for k, v in known.items()}
    rest = list(args)
    while rest and len(rest[0]) > 1 and rest[0].startswith("-"):
        flag = rest.pop(0)
        if flag == "--":
            break
        name, equals, value = flag.lstrip("-").partition("=")
        if name in ("h", "help"):
            raise HelpAsked(command)
        if name not in known:
            raise UsageError(command, f"flag provided but not defined: -{name}")
        if not equals:
            if not rest:
                raise UsageError(command, f"flag needs an argument: -{name}")
            value = rest.pop(0)
        if isinstance(known[name], list):
            values[name].append(value)
        elif isinstance(known[name], int):
            try:
                values[name] = int(value)
            except ValueError:
                raise UsageError(command, f"invalid value {value!r} for flag -{name}") from None
        else:
            values[name] = value
    return values, rest


def listed(values) -> str:
    return ", ".join(values) if values else "(none)"


class Runner:
    def __init__(self, make_app, out: TextIO, err: TextIO, forever=lambda server: server.serve_forever()):
        self.make_app, self.out, self.err, self.forever = make_app, out, err, forever

    def say(self, text: str) -> None:
        self.out.write(text)

    def run(self, args: list[str]) -> int:
        try:
            self.dispatch(args)
        except HelpAsked as e:
            self.say(usage(str(e)))
        except UsageError as e:
            self.err.write(f"{e}\n{usage(e.command)}")
            return USAGE
        except EngineError as e:
            self.err.write(f"{args[0]}: {e}\n")
            return e.exit_code
        except OSError as e:
            self.err.write(f"{args[0]}: {e}\n")
            return ERROR
        return OK

    def dispatch(self, args: list[str]) -> None:
        if not args:
            raise UsageError("", "no command given")
        name, rest = args[0], args[1:]
        if name in ("-h", "-help", "--help", "help"):
            raise HelpAsked(rest[0] if rest else "")
        if name in ("version", "-version", "--version"):
            return self.say(f"sparkdex {__version__}\n")
        if name == "workspace":
            if not rest:
                raise UsageError(name, "one of list, add and remove is needed")
            if rest[0] in ("-h", "-help", "--help"):
                raise HelpAsked(name)
            name, rest = f"workspace {rest[0]}", rest[1:]
            if name not in COMMANDS:
                raise UsageError("workspace", f"unknown subcommand: {args[1]}")
        if name not in COMMANDS:
            raise UsageError(name, "unknown command")
        flags, rest = parse(name, rest)
        if rest and not COMMANDS[name][2]:
            raise UsageError(name, f"unexpected argument: {rest[0]}")
        getattr(self, name.replace(" ", "_"))(flags, rest)

    def index(self, flags, rest) -> None:
        m = self.make_app().index(flags["root"])
        self.say(f"generation: {m.generation}\nsegments: {len(m.segments)}\ndocuments: {m.doc_count}\nterms: {m.term_count}\nconfig: {m.config_hash}\n")

    def search(self, flags, rest) -> None:
        if flags["format"] not in report.RENDERERS:
            raise UsageError("search", f"unknown format: {flags['format']}")
        facets = tuple(f.strip() for v in flags["facet"] for f in v.split(",") if f.strip())
        options = Options(" ".join(rest), parse_filters(flags["filter"], "search"), flags["limit"], facets)
        try:
            parse_query(options.query)
        except QueryError as e:
            raise UsageError("search", f"bad query at {e.position}: {e.reason}") from None
        self.say(report.RENDERERS[flags["format"]](self.make_app().search(flags["root"], options)))

    def stats(self, flags, rest) -> None:
        self.say(report.stats(self.make_app().stats(flags["root"])))

    def validate(self, flags, rest) -> None:
        f = self.make_app().validate(flags["root"])
        self.say(f"generation: {f.generation}\nsegments: {f.segments}\ndocuments: {f.documents}\nterms: {f.terms}\n")
        self.say("problems:\n" + "".join(f"  {p}\n" for p in f.problems) if f.problems else "problems: none\n")
        if f.problems:
            raise EngineError(f"index has {len(f.problems)} problem{'s' * (len(f.problems) != 1)}")

    def config(self, flags, rest) -> None:
        c = config.load(flags["root"])
        stop = f"{len(c.stopwords)} (configured)" if c.stopwords else f"{len(stop_list(c))} (default list)"
        rows = {"root": c.root, "output": c.output_path, "include": listed(c.include), "exclude": listed(c.exclude), "max_file_bytes": c.max_file_bytes}
        rows |= {"min_term_length": c.min_term_length, "segment_docs": c.segment_docs, "stopwords": stop, "hash": config.digest(c)}
        self.say("".join(f"{k}: {v}\n" for k, v in rows.items()))

    def workspace_list(self, flags, rest) -> None:
        w = Workspace.load(flags["root"])
        for c in w.list():
            self.say(f"{'* ' if c.name == w.active else '  '}{c.name}\troot={c.root}\toutput={c.output_path}\n")
        if not w.corpora:
            self.say("no corpora registered\n")

    def workspace_add(self, flags, rest) -> None:
        if len(rest) not in (2, 3):
            raise UsageError("workspace add", "takes NAME ROOT [OUTPUT]")
        w = Workspace.load(flags["root"])
        w.add(*rest)
        w.save(flags["root"])
        self.say(f"registered {rest[0]}\n")

    def workspace_remove(self, flags, rest) -> None:
        if len(rest) != 1:
            raise UsageError("workspace remove", "takes NAME")
        w = Workspace.load(flags["root"])
        if not w.remove(rest[0]):
            raise NotFound(f"not registered: {rest[0]}")
        w.save(flags["root"])
        self.say(f"removed {rest[0]}\n")

    def serve(self, flags, rest) -> None:
        config.load(flags["root"])
        host, _, port = flags["addr"].rpartition(":")
        if not port.isdigit():
            raise EngineError(f"bad listen address: {flags['addr']}")
        with serve(self.make_app(), flags["root"], host, int(port)) as server:
            self.say("listening on {}:{}\n".format(*server.server_address[:2]))
            self.forever(server)

    def watch(self, flags, rest) -> None:
        before = []
        if flags["state"]:
            try:
                before = [(r["rel"], r["abs"], r["size"], r["mtime_ns"], r["ext"]) for r in read_json(flags["state"]) or []]
            except NotFound:
                pass
            except (TypeError, KeyError):
                raise EngineError(f"{flags['state']}: not a scan") from None
        now, changed = self.make_app().watch(flags["root"], before)
        self.say(f"files: {len(now)}\nchanges: {len(changed)}\n" + "".join(f"  {kind:<8}  {rel}\n" for rel, kind in changed))
        if flags["state"]:
            write_json(flags["state"], [dict(zip(("rel", "abs", "size", "mtime_ns", "ext"), r, strict=True)) for r in now])


def session_app():
    from pyspark.sql import SparkSession

    from .app import App

    spark = SparkSession.builder.appName("sparkdex").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    return App(spark)


def main(args: list[str] | None = None) -> int:
    return Runner(session_app, sys.stdout, sys.stderr).run(sys.argv[1:] if args is None else args)


if __name__ == "__main__":
    sys.exit(main())
