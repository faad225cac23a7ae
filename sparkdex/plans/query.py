"""The query language: terms, "phrases", field:values and -negations, all of which must hold."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import QueryError
from ..functions.text import fold

#: What separates clauses (white space of Unicode, without U+001C to U+001F).
SPACE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | frozenset(map(chr, range(0x2000, 0x200B)))


@dataclass(frozen=True)
class Clause:
    term: str = ""
    phrase: tuple[str, ...] = ()
    field: str = ""
    negate: bool = False

    @property
    def empty(self) -> bool:
        return not self.term and not self.phrase

    @property
    def words(self) -> tuple[str, ...]:
        return self.phrase or ((self.term,) if self.term else ())

    @property
    def value(self) -> str:
        return " ".join(self.phrase) if self.phrase else self.term

    def __str__(self) -> str:
        text = f'"{self.value}"' if self.phrase else self.term
        return f"{'-' * self.negate}{self.field + ':' if self.field else ''}{text}"


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...] = ()

    @property
    def match_all(self) -> bool:
        return not self.clauses

    def __str__(self) -> str:
        return " ".join(str(c) for c in self.clauses if not c.empty)


class _Scanner:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, at: int, reason: str):
        raise QueryError(len(self.text[:at].encode("utf-8", "surrogatepass")), reason)

    def over(self) -> bool:
        """Whether a space, or the end, comes next."""
        return self.at >= len(self.text) or self.text[self.at] in SPACE

    def take(self, stops: str = "") -> str:
        start = self.at
        while not self.over() and self.text[self.at] not in stops:
            self.at += 1
        return self.text[start : self.at]

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def phrase(self) -> tuple[str, ...]:
        opened = self.at
        closed = self.text.find('"', opened + 1)
        if closed < 0:
            self.fail(opened, "unterminated quote")
        inside = "".join(" " if c in SPACE else c for c in self.text[opened + 1 : closed])
        words = tuple(w for w in inside.split(" ") if w)
        if not words:
            self.fail(opened, "empty phrase")
        self.at = closed + 1
        if not self.over():
            self.fail(self.at, "unexpected text after quote")
        return words

    def clause(self) -> Clause:
        start, negate, field = self.at, self.peek() == "-", ""
        if negate:
            self.at += 1
            if self.over():
                self.fail(start, "missing term after '-'")
        mark = self.at
        name = self.take(':"')
        if self.peek() == ":":
            if not name:
                self.fail(self.at, "missing field name before ':'")
            field, colon = fold(name), self.at
            self.at += 1
            if self.over():
                self.fail(colon, "missing value after ':'")
        else:
            self.at = mark
        case = (lambda w: w) if field else fold
        if self.peek() == '"':
            return Clause(phrase=tuple(map(case, self.phrase())), field=field, negate=negate)
        term = self.take('"')
        if self.peek() == '"':
            self.fail(self.at, "unexpected quote")
        return Clause(term=case(term), field=field, negate=negate)


def parse(text: str) -> Query:
    """A query; QueryError names a byte offset. Without clauses it matches every document."""
    s, clauses = _Scanner(text), []
    while s.at < len(text):
        if s.over():
            s.at += 1
        else:
            clauses.append(s.clause())
    return Query(tuple(clauses))
