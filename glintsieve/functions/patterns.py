"""Many path patterns at once: globs and ignore rules as one automaton over the components of a path.

Patterns share their first components in a tree; components are literal texts, globs, or `**` for any number of them. A path runs
through sets of its nodes, and each set with a component leads to one next set, which is looked up after the first time. So the cost of
a path is its number of components, however many patterns there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glintsieve.functions.globs import to_regex
from glintsieve.sources.gitignore import Rule

#: Transitions that are kept; more start anew.
CACHED = 200_000


@dataclass
class Node:
    literal: dict[str, Node] = field(default_factory=dict)
    globs: dict[str, tuple[re.Pattern, Node]] = field(default_factory=dict)
    deep: Node | None = None  # any number of components and on
    rest: Node | None = None  # one component or more, to the end
    loops: bool = False
    accepts: list[int] = field(default_factory=list)


class PatternSet:
    """Patterns by number; `hits` gives the numbers of those that match a path."""

    def __init__(self, patterns: Iterable[str] = ()) -> None:
        self.root = Node()
        self._sets: dict[tuple[int, ...], int] = {}
        self._nodes: list[list[Node]] = []
        self._next: dict[tuple[int, str], int] = {}
        self._hits: list[tuple[int, ...]] = []
        for number, pattern in enumerate(patterns):
            self.add(pattern, number)

    def add(self, pattern: str, number: int, literal_base: str = "") -> None:
        """literal_base: a folder, read as plain text, that the pattern is relative to."""
        node = self.root
        for part in literal_base.split("/") if literal_base else ():
            node = node.literal.setdefault(part, Node())
        parts = pattern.split("/")
        for k, part in enumerate(parts):
            if part == "**" and k == len(parts) - 1:
                node.rest = node.rest or Node(loops=True)
                node = node.rest
            elif re.fullmatch(r"\*\*+", part):
                node.deep = node.deep or Node(loops=True)
                node = node.deep
            elif re.search(r"[*?\[]", part):
                node = node.globs.setdefault(part, (re.compile(to_regex(part).replace(r"\z", r"\Z")), Node()))[1]
            else:
                node = node.literal.setdefault(part, Node())
        node.accepts.append(number)

    def _state(self, nodes: list[Node]) -> int:
        found: dict[int, Node] = {}
        for node in nodes:
            while node is not None and id(node) not in found:
                found[id(node)] = node
                node = node.deep
        key = tuple(sorted(found))
        if key not in self._sets:
            self._sets[key] = len(self._nodes)
            self._nodes.append(list(found.values()))
            self._hits.append(tuple(sorted(n for x in found.values() for n in x.accepts)))
        return self._sets[key]

    def _step(self, state: int, part: str) -> int:
        out: list[Node] = []
        for node in self._nodes[state]:
            if node.loops:
                out.append(node)
            if part in node.literal:
                out.append(node.literal[part])
            out += [child for pattern, child in node.globs.values() if pattern.match(part)]
            if node.rest:
                out.append(node.rest)
        return self._state(out)

    def hits(self, path: str) -> tuple[int, ...]:
        if len(self._next) > CACHED:
            self._sets, self._nodes, self._next, self._hits = {}, [], {}, []
        state = self._state([self.root])
        for part in path.split("/"):
            following = self._next.get((state, part))
            if following is None:
                following = self._next[state, part] = self._step(state, part)
            state = following
        # a pattern that ends in a run of ** further in has accepted on its way
        return self._hits[state]


def hits(path: Column, patterns: list[str]) -> Column:
    """Numbers (from 0) of the patterns that match a path, ascending; null for a null path. The patterns are bounded: they travel with the tasks."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = PatternSet(patterns)
        for paths in batches:
            yield paths.map(lambda p: None if p is None else list(known.hits(p)))

    return run(path)


def excluded(path: Column, patterns: list[str]) -> Column:
    """A pattern with a slash matches the path or a folder above it, another one the name."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = PatternSet()
        for number, p in enumerate(patterns):
            known.add(p if "/" in p else f"**/{p}", number)
            if "/" in p:
                known.add("**", number, literal_base=p.rstrip("/"))
        for paths in batches:
            yield paths.map(lambda p: None if p is None else bool(known.hits(p)))

    return run(path)


def ignore_set(rules: list[Rule]) -> PatternSet:
    """The patterns of ignore rules: relative to their folders, and by name anywhere below unless they are anchored or have a slash."""
    known = PatternSet()
    for number, rule in enumerate(rules):
        known.add(rule.pattern if rule.anchored or "/" in rule.pattern else f"**/{rule.pattern}", number, rule.base)
    return known


def ignored(path: Column, directory: Column, rules: list[Rule]) -> Column:
    """Whether a path is ignored: the last rule that matches it says so; rules for folders match folders only."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = ignore_set(rules)
        for paths, folders in batches:
            out = []
            for p, folder in zip(paths, folders):
                last = next((k for k in reversed(known.hits(p)) if folder or not rules[k].directory), None) if p is not None else None
                out.append(None if p is None else last is not None and not rules[last].negate)
            yield pd.Series(out, dtype=object)

    return run(path, directory)
