"""Text functions as Column expressions: tokens, normalised bodies, titles, kinds; and the binary test."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config

# The default stop words, kinds and languages by extension, comment marks and limits.
STOPWORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as",
    "at", "be", "because", "been", "but", "by", "can", "did", "do", "does",
    "for", "from", "had", "has", "have", "he", "her", "here", "his", "how",
    "i", "if", "in", "into", "is", "it", "its", "may", "more", "most", "no",
    "not", "of", "on", "one", "only", "or", "other", "our", "out", "over",
    "said", "she", "so", "some", "such", "than", "that", "the", "their",
    "them", "then", "there", "these", "they", "this", "those", "through",
    "to", "too", "up", "use", "very", "was", "we", "were", "what", "when",
    "where", "which", "who", "will", "with", "would", "you", "your",
)
KINDS = {".md": "markdown", ".markdown": "markdown", ".txt": "text", ".rst": "text"}
LANGUAGES = {
    ".bash": "shell", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".css": "css", ".ex": "elixir",
    ".exs": "elixir", ".go": "go", ".h": "c", ".hpp": "cpp", ".hs": "haskell", ".html": "html", ".java": "java",
    ".js": "javascript", ".json": "json", ".jsx": "javascript", ".kt": "kotlin", ".lua": "lua", ".m": "objective-c",
    ".php": "php", ".pl": "perl", ".ps1": "powershell", ".py": "python", ".r": "r", ".rb": "ruby", ".rs": "rust",
    ".scala": "scala", ".sh": "shell", ".sql": "sql", ".swift": "swift", ".toml": "toml", ".ts": "typescript",
    ".tsx": "typescript", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml",
}
COMMENT_MARKS = r"/#*\-;%"
TITLE_CHARS = 120
SNIFFED_BYTES = 8000


def stop_list(cfg: Config) -> frozenset[str]:
    """The configured stop words, trimmed and lower-cased; the default list where none is configured."""
    own = {fold(w.strip()) for w in cfg.stopwords}
    return frozenset(own - {""}) if cfg.stopwords else frozenset(STOPWORDS)


def fold(text: str) -> str:
    """Lower case, character by character."""
    return text.replace("İ", "i").replace("Σ", "σ").lower()


def is_stopword(cfg: Config, term: str) -> bool:
    return bool(term.strip()) and fold(term.strip()) in stop_list(cfg)


def min_length(cfg: Config) -> int:
    return cfg.min_term_length if cfg.min_term_length >= 1 else 2


def _tree(words: list[str]) -> str:
    """A regular expression of the words, by their first characters."""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[:1], []).append(w[1:])
    branches = [c if tails == [""] else c + _tree(tails) for c, tails in sorted(rest.items()) if c]
    return f"(?:{'|'.join(branches)}){'?' * ('' in rest)}" if branches else ""


def tokens(text: Column, cfg: Config = Config()) -> Column:
    """Kept terms in order: their place in the array is their position. Null for a null text is an empty array.

    One regular expression over the lower-cased text: a run of letters and digits that is long enough and isn't a
    stop word. No lower case changes what is a letter or digit, so the runs are those of the text itself.
    """
    n = min_length(cfg)
    stop = sorted({w for w in stop_list(cfg) if len(w) >= n and all(c.isalpha() or unicodedata.category(c) == "Nd" for c in w)})
    other = f"(?!{_tree(stop)}(?![\\p{{L}}\\p{{Nd}}]))" if stop else ""
    folded = F.lower(F.translate(F.coalesce(text, F.lit("")), "İΣ", "iσ"))
    return F.regexp_extract_all(folded, F.lit(rf"(?<![\p{{L}}\p{{Nd}}]){other}[\p{{L}}\p{{Nd}}]{{{n},}}"), F.lit(0))


def normalized(body: Column) -> Column:
    """Without a byte-order mark; line feeds only; tabs as spaces; no trailing spaces, and no runs of blank lines."""
    for pattern, to in (
        (r"\A\uFEFF", ""),
        (r"\r\n?", "\n"),
        (r"\t", " "),
        (r" +(\n|\z)", "$1"),
        (r"\A\n+", ""),
        (r"\n+\z", ""),
        (r"\n{3,}", "\n\n"),
    ):
        body = F.regexp_replace(body, pattern, to)
    return body


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def directory(path: Column) -> Column:
    """The part before the last slash; a dot for none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1), F.lit("")), F.lit("."))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)\z", 1))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def kind_of(ext: Column) -> Column:
    """markdown, text, source or other."""
    return F.coalesce(_lookup(KINDS, ext), F.when(ext.isin(*LANGUAGES), "source"), F.lit("other"))


def language_of(ext: Column) -> Column:
    return F.coalesce(_lookup(LANGUAGES, ext), F.lit(""))


def supported_extension(ext: str) -> bool:
    """Whether an extension, with or without its dot and in any case, has a kind of its own."""
    e = ext.strip().lower()
    e = e if e.startswith(".") or not e else f".{e}"
    return e in KINDS or e in LANGUAGES


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def title_of(body: Column, path: Column, kind: Column) -> Column:
    """First heading (markdown), else first line that isn't blank (source: without comment marks), else the base
    name; at most TITLE_CHARS characters."""
    lines = F.split(body, "\n", -1)

    def heading(x: Column) -> Column:
        x = _trim(F.regexp_replace(x, r"\A *#{1,6}", ""))
        return _trim(F.regexp_replace(x, r"#+\z", ""))

    marked = F.filter(lines, lambda x: x.rlike(r"\A *#{1,6}(?: |\z)"))
    headings = F.filter(F.transform(marked, heading), lambda x: x != "")
    plain = F.transform(lines, _trim)
    code = F.transform(plain, lambda x: _trim(F.regexp_replace(x, rf"\A[{COMMENT_MARKS}]+", "")))
    candidates = F.filter(F.when(kind == "source", code).otherwise(plain), lambda x: x != "")
    first = F.coalesce(F.when(kind == "markdown", F.get(headings, 0)), F.get(candidates, 0), base_name(path))
    return F.when(F.char_length(first) > TITLE_CHARS, F.rtrim(F.substring(first, 1, TITLE_CHARS))).otherwise(first)


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def is_binary(data: str) -> Column:
    """A NUL, invalid UTF-8, or over 30 in 100 control bytes, in the first SNIFFED_BYTES. Null isn't binary.

    A character that the end of those bytes splits is left out of them.
    """
    whole = F.col(data)
    head = F.substring(whole, 1, SNIFFED_BYTES)

    def split(k: int) -> Column:
        """Bytes to leave out if the k-th from the end begins a character, or ends one."""
        if k > 3:
            return F.lit(0)
        byte = F.conv(F.hex(F.substring(whole, SNIFFED_BYTES + 1 - k, 1)), 16, 10).cast("int")
        width = F.when(byte < 0xE0, 2).when(byte < 0xF0, 3).otherwise(4)
        return F.when(byte >= 0xC0, F.when(width > k, k).otherwise(0)).when(byte < 0x80, 0).otherwise(split(k + 1))

    kept = F.when(F.length(whole) > SNIFFED_BYTES, F.substring(whole, F.lit(1), F.lit(SNIFFED_BYTES) - split(1))).otherwise(head)
    text = kept.cast("string")
    control = F.length(text) - F.length(F.regexp_replace(text, r"[\x01-\x08\x0E-\x1F\x7F]", ""))
    odd = (F.position(F.lit("\0"), text) > 0) | ~F.is_valid_utf8(text) | (control * 100 > F.length(kept) * 30)
    return F.coalesce(odd, F.lit(False))
