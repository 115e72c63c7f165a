"""Line predicates stated once and compiled twice: to Spark columns for the plan, to Python tests inside a per-file pass.

Patterns may use two marks: `\\i` for an identifier character and `\\j` for the absence of one on the left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

JAVA_IDENTIFIER = r"[\p{IsAlphabetic}\p{N}_]"
PYTHON_IDENTIFIER = r"\w"
QUOTES = "'\"`#"


def java(pattern: str) -> str:
    return pattern.replace(r"\j", rf"(?<!{JAVA_IDENTIFIER})").replace(r"\k", rf"(?!{JAVA_IDENTIFIER})").replace(r"\i", JAVA_IDENTIFIER)


def python(pattern: str) -> str:
    return pattern.replace(r"\j", rf"(?<!{PYTHON_IDENTIFIER})").replace(r"\k", rf"(?!{PYTHON_IDENTIFIER})").replace(r"\i", PYTHON_IDENTIFIER)


def quoted(text: str) -> str:
    """A literal text as a pattern that Java and Python read alike."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def any_of(texts: Iterable[str]) -> str:
    return "(?:" + "|".join(quoted(t) for t in sorted(texts, key=lambda t: (-len(t), t))) + ")"


def token_pattern(texts: Iterable[str]) -> str:
    """One of the texts, bounded by no identifier character."""
    return rf"\j{any_of(texts)}\k"


def call_pattern(names: Iterable[str]) -> str:
    """A call of one of the names."""
    return rf"\j{any_of(names)}\k\s*\("


def command_pattern(names: Iterable[str]) -> str:
    """A call without need of brackets: name( or name argument, not a definition and not after a colon."""
    return rf"^(?:.*;)?(?!\s*def )[^;]*?(?<!:)(?<!: )\j{any_of(names)}\k(?:\(|\s+[^\s=:;,)\]}}])"


def flag_pattern(name: str, value: str) -> str:
    """name, then = or : or a comma, then the value."""
    return rf"\j{quoted(name)}\s*[=:,]\s*{quoted(value)}\k"


class Predicate:
    def column(self) -> Column:
        raise NotImplementedError

    def test(self, line) -> bool:
        raise NotImplementedError

    def words(self) -> set[tuple[str, str]] | None:
        """(view, word) pairs, one of which every matching line has; None if none are known. The view flag names a flag."""
        return None

    def __and__(self, other: Predicate) -> Predicate:
        return Both(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Either(self, other)

    def __invert__(self) -> Predicate:
        return Without(self)


@dataclass(frozen=True)
class Both(Predicate):
    a: Predicate
    b: Predicate

    def column(self) -> Column:
        return self.a.column() & self.b.column()

    def test(self, line) -> bool:
        return self.a.test(line) and self.b.test(line)

    def words(self) -> set[tuple[str, str]] | None:
        # either side's will do: words rather than credentials, a few rather than many
        known = [x for x in (self.a.words(), self.b.words()) if x is not None]
        return min(known, key=lambda x: (("flag", "may_assign") in x, len(x))) if known else None


@dataclass(frozen=True)
class Either(Predicate):
    a: Predicate
    b: Predicate

    def column(self) -> Column:
        return self.a.column() | self.b.column()

    def test(self, line) -> bool:
        return self.a.test(line) or self.b.test(line)

    def words(self) -> set[tuple[str, str]] | None:
        a, b = self.a.words(), self.b.words()
        return None if a is None or b is None else a | b


@dataclass(frozen=True)
class Without(Predicate):
    a: Predicate

    def column(self) -> Column:
        return ~self.a.column()

    def test(self, line) -> bool:
        return not self.a.test(line)


@dataclass(frozen=True)
class Match(Predicate):
    """A view of the line (code, visible, masked, comments, compact) holds the pattern."""

    view: str
    pattern: str
    texts: tuple[str, ...] = ()  # every match holds one of these

    def words(self) -> set[tuple[str, str]] | None:
        return {("compact" if self.view == "compact" else "text", x) for x in self.texts} or None

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(python(self.pattern))

    def column(self) -> Column:
        return F.col(self.view).rlike(java(self.pattern))

    def test(self, line) -> bool:
        return self.compiled.search(getattr(line, self.view)) is not None


@dataclass(frozen=True)
class Literal(Predicate):
    """A string literal of the line, without its quotes, holds the pattern."""

    pattern: str

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(python(self.pattern))

    def column(self) -> Column:
        return F.exists("literals", lambda x: F.btrim(x, F.lit(QUOTES)).rlike(java(self.pattern)))

    def test(self, line) -> bool:
        return any(self.compiled.search(x.strip(QUOTES)) for x in line.literals)


@dataclass(frozen=True)
class In(Predicate):
    """The line's language is one of these."""

    languages: tuple[str, ...] = field(default=())

    def column(self) -> Column:
        return F.col("language").isin(*self.languages)

    def test(self, line) -> bool:
        return line.language in self.languages


@dataclass(frozen=True)
class Flag(Predicate):
    """A boolean column of the line."""

    name: str

    def column(self) -> Column:
        return F.coalesce(F.col(self.name), F.lit(False))

    def test(self, line) -> bool:
        return bool(getattr(line, self.name))

    def words(self) -> set[tuple[str, str]]:
        return {("flag", self.name)}


def calls(*names: str) -> Predicate:
    return Match("code", call_pattern(names), names)


def tokens(*texts: str) -> Predicate:
    return Match("code", token_pattern(texts), texts)


def flag(name: str, value: str) -> Predicate:
    return Match("code", flag_pattern(name, value), (name,))


def holds(view: str, *texts: str) -> Predicate:
    return Match(view, any_of(texts), texts)


def commands(*names: str) -> Predicate:
    return Match("code", command_pattern(names), names)
