"""Settings of a corpus: defaults, the overlay file in its root, checks and a hash."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
from dataclasses import dataclass, replace

from .errors import ConfigError
from .functions.globs import valid_glob

FILE = ".sparkdex.json"
OUTPUT = "sparkdex-out"


@dataclass(frozen=True)
class Config:
    root: str = "."
    output_dir: str = OUTPUT
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    max_file_bytes: int = 1 << 20
    stopwords: tuple[str, ...] = ()
    min_term_length: int = 2
    segment_docs: int = 256

    @property
    def output_path(self) -> str:
        return os.path.join(self.root, self.output_dir)


#: Keys of the overlay without case, spaces, '-' and '_'; their attribute and type.
SETTINGS = {
    "outputdir": ("output_dir", str),
    "include": ("include", tuple),
    "exclude": ("exclude", tuple),
    "maxfilebytes": ("max_file_bytes", int),
    "stopwords": ("stopwords", tuple),
    "mintermlength": ("min_term_length", int),
    "segmentdocs": ("segment_docs", int),
}


def _value(key: str, kind: type, value):
    if kind is str and isinstance(value, str):
        return value
    if kind is int and isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63:
        return value
    if kind is tuple and isinstance(value, list) and all(isinstance(x, str) for x in value):
        return tuple(value)
    wanted = {str: "a string", int: "a whole number", tuple: "a list of strings"}[kind]
    raise ConfigError(key, f"expected {wanted}")


def load(root: str) -> Config:
    """Defaults under the overlay of ``root``, checked. No or an empty file: defaults."""
    try:
        with open(os.path.join(root, FILE), encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError:
        text = ""
    cfg, found = Config(root=root), {}
    if text.strip():
        try:
            raw = json.loads(text)
        except ValueError as e:
            raise ConfigError(FILE, f"invalid JSON: {e}") from None
        if raw is not None and not isinstance(raw, dict):
            raise ConfigError(FILE, "invalid JSON: an object is needed")
        for key in sorted(raw or {}):
            name = "".join(c for c in key if c not in "_- ").translate({c: c + 32 for c in range(65, 91)})
            if name not in SETTINGS:
                raise ConfigError(key, "unknown setting")
            attribute, kind = SETTINGS[name]
            if raw[key] is not None:
                found[attribute] = _value(key, kind, raw[key])
    cfg = replace(cfg, **found)
    check(cfg)
    return cfg


def canonical(path: str) -> str:
    return posixpath.normpath(path) if path else ""


def check(cfg: Config) -> None:
    out = cfg.output_dir
    if not out.strip():
        raise ConfigError("OutputDir", "is blank")
    if out.startswith("/") or len(out) > 1 and out[1] == ":" and out[0].isascii() and out[0].isalpha():
        raise ConfigError("OutputDir", "is an absolute path")
    clean = canonical(out)
    if clean == ".." or clean.startswith("../"):
        raise ConfigError("OutputDir", "leads out of the corpus root")
    if clean == ".":
        raise ConfigError("OutputDir", "is the corpus root itself")
    for field, value, least, reason in (
        ("MinTermLength", cfg.min_term_length, 1, "must be at least 1"),
        ("SegmentDocs", cfg.segment_docs, 1, "must be at least 1"),
        ("MaxFileBytes", cfg.max_file_bytes, 0, "must not be negative"),
    ):
        if value < least:
            raise ConfigError(field, reason)
    for field, patterns in (("Include", cfg.include), ("Exclude", cfg.exclude)):
        for i, p in enumerate(patterns):
            if not p:
                raise ConfigError(f"{field}[{i}]", "must not be empty")
            if not valid_glob(p):
                raise ConfigError(f"{field}[{i}]", f"invalid pattern {json.dumps(p)}")


def digest(cfg: Config) -> str:
    """A hash of everything but the root; the order of lists doesn't matter."""
    parts = {
        "output_dir": canonical(cfg.output_dir),
        "include": sorted(cfg.include),
        "exclude": sorted(cfg.exclude),
        "max_file_bytes": cfg.max_file_bytes,
        "stopwords": sorted(cfg.stopwords),
        "min_term_length": cfg.min_term_length,
        "segment_docs": cfg.segment_docs,
    }
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()
