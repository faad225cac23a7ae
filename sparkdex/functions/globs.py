"""Path globs: ``*`` and ``?`` stop at a slash, ``[...]`` are classes, ``\\`` takes the next character as it is."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a whole match, None for a malformed pattern."""
    out, i, n = [], 0, len(pattern)

    def literal(i: int) -> tuple[str, int] | None:
        if i < n and pattern[i] == "\\":
            i += 1
        return (pattern[i], i + 1) if i < n else None

    while i < n:
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[":
            i += 1
            negated = i < n and pattern[i] == "^"
            i += negated
            ranges: list[str] = []
            while True:
                if i < n and pattern[i] == "]" and ranges:
                    i += 1
                    break
                if i < n and pattern[i] in "-]" or (low := literal(i)) is None:
                    return None
                low, i = low
                high = low
                if i < n and pattern[i] == "-":
                    if i + 1 < n and pattern[i + 1] in "-]" or (found := literal(i + 1)) is None:
                        return None
                    high, i = found
                if low <= high:
                    ranges.append(f"{re.escape(low)}-{re.escape(high)}")
                else:
                    ranges.append("")
            body = "".join(ranges)
            # an empty class matches nothing; its negation anything but a slash
            out.append((f"[^/{body}]" if negated else f"(?!/)[{body}]") if body else ("[^/]" if negated else r"(?!)"))
        else:
            found = literal(i)
            if found is None:
                return None
            out.append(re.escape(found[0]))
            i = found[1]
    return "".join(out)


def valid_glob(pattern: str) -> bool:
    return glob_regex(pattern) is not None


def any_match(patterns, path: str) -> bool:
    """Whether a pattern matches the whole path or its last part; malformed ones never do."""
    base = path.rsplit("/", 1)[-1]
    for p in patterns:
        r = glob_regex(p)
        if r is not None and (re.fullmatch(r, path, re.DOTALL) or re.fullmatch(r, base, re.DOTALL)):
            return True
    return False
