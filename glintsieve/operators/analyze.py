"""The per-file pass: source files in, one row a line out, with views, syntax facts and flow evidence.

State never crosses files, so this is a map over partitions of whole files; Arrow batches go in and out.
"""

from __future__ import annotations

import gc
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from glintsieve.functions.credentials import may_assign
from glintsieve.functions.predicates import call_pattern, python
from glintsieve.operators import facts as syntax
from glintsieve.operators import lexer, taint
from glintsieve.operators.lexer import Line
from glintsieve.operators.rules import BY_ID, CSHARP_FORMATTERS, CSHARP_REACH, PATH_APIS, RULES, SQL_QUALIFIED, Rule
from glintsieve.sources.components import script_source

_PATH_CALL = re.compile(python(call_pattern(PATH_APIS)))

#: Rules by the words, one of which every line that they match has: in the text, in the code without white space, or a flag.
_WORDS: dict[tuple[str, str], int] = {}
for _k, _rule in enumerate(RULES):
    for _pair in _rule.predicate.words():
        _WORDS[_pair] = _WORDS.get(_pair, 0) | 1 << _k
_FORMATTER, _ASSIGNS, _OPENS = (_WORDS.get(("flag", name), 0) for name in ("formatter_near", "may_assign", "path_call"))
#: A line of calls that flows reach beside the rules' own words: no rule by itself.
_FLOW_ONLY = 1 << len(RULES)
_COMMAND_MODULE = "child_process"


@lru_cache
def automaton(view: str) -> ahocorasick.Automaton:
    """All words of the rules over one view, each with the set of rules (a bit each) that it may lead to."""
    out = ahocorasick.Automaton()
    words = {word: mask for (kind, word), mask in _WORDS.items() if kind == view}
    for word in SQL_QUALIFIED if view == "text" else ():
        words[word] = words.get(word, 0) | _FLOW_ONLY
    for word, mask in words.items():
        out.add_word(word, mask)
    out.make_automaton()
    return out


STEP = pa.struct([("line", pa.int32()), ("kind", pa.string())])
FLOW = pa.struct([("rule_id", pa.string()), ("steps", pa.list_(STEP)), ("depth", pa.int32()), ("remote", pa.bool_())])
SCHEMA = pa.schema([
    ("path", pa.string()), ("language", pa.string()), ("line", pa.int32()), ("text", pa.string()), ("code", pa.string()), ("visible", pa.string()), ("masked", pa.string()), ("compact", pa.string()),
    ("literals", pa.list_(pa.string())), ("comments", pa.string()), ("path_call", pa.bool_()), ("formatter_near", pa.bool_()), ("classes", pa.list_(pa.string())), ("reliable", pa.bool_()),
    ("scope_start", pa.int32()), ("scope_end", pa.int32()), ("shell", pa.bool_()), ("shadowed", pa.bool_()), ("flows", pa.list_(FLOW)), ("parsed", pa.bool_()), ("complete", pa.bool_()), ("error_nodes", pa.int32()),
])
KINDS = {
    "path": "string", "language": "string", "line": "int", "text": "string", "code": "string", "visible": "string", "masked": "string", "compact": "string",
    "literals": "array<string>", "comments": "string", "path_call": "boolean", "formatter_near": "boolean", "classes": "array<string>", "reliable": "boolean",
    "scope_start": "int", "scope_end": "int", "shell": "boolean", "shadowed": "boolean", "flows": "array<struct<rule_id:string,steps:array<struct<line:int,kind:string>>,depth:int,remote:boolean>>",
    "parsed": "boolean", "complete": "boolean", "error_nodes": "int",
}
#: What the lexer tells of a line, and what takes flows; the other columns take the syntax facts.
LEXED = {"path", "language", "line", "text", "code", "visible", "masked", "compact", "literals", "comments", "formatter_near", "complete"}
FLOWING = {"flows"}
MATCHES = pa.schema([
    ("path", pa.string()), ("language", pa.string()), ("line", pa.int32()), ("text", pa.string()), ("compact", pa.string()), ("comments", pa.string()), ("reliable", pa.bool_()), ("shell", pa.bool_()),
    ("emit_ord", pa.int32()), ("rule_id", pa.string()), ("evidence", pa.struct([("steps", pa.list_(STEP)), ("depth", pa.int32()), ("remote", pa.bool_())])),
])
MATCHES_SQL = "path string, language string, line int, text string, compact string, comments string, reliable boolean, shell boolean, emit_ord int, rule_id string, evidence struct<steps:array<struct<line:int,kind:string>>,depth:int,remote:boolean>"
FACTS_SCHEMA = "path string, kind string, name string, qualified string, items array<string>, text string, line int, start int, end int"


def reads_variable_path(call: syntax.Call) -> bool:
    """Whether a call opens a path that is more than a literal; other objects than File have open methods of their own."""
    of, dot, name = call.qualified.rpartition(".")
    known = call.qualified in PATH_APIS or name in PATH_APIS or call.name in PATH_APIS
    return call.variable and known and not (name == "open" and dot and of.rpartition(".")[2] != "File")


def prepared(text: str, language: str) -> tuple[list[Line], bool]:
    """Lexed lines with the flags that rules ask for."""
    lines, complete = lexer.lex(text, language)
    seen = None
    for number, line in enumerate(lines):
        if language == "csharp":
            if any(x in line.code for x in CSHARP_FORMATTERS):
                seen = number
            line.formatter_near = seen is not None and number - seen <= CSHARP_REACH
    return lines, complete


def telling(lines: list[Line]) -> dict[int, int]:
    """By number the lines that a rule may match, with the set of those rules; of the other lines none does.

    Each view of the whole file runs through its automaton once."""
    found: dict[int, int] = {}
    for view in ("text", "compact"):
        parts = [getattr(x, view) for x in lines]
        starts = [0, *accumulate(len(x) + 1 for x in parts)]
        for end, mask in automaton(view).iter("\n".join(parts)):
            number = bisect_right(starts, end)
            found[number] = found.get(number, 0) | mask
    for number, x in enumerate(lines, 1):
        more = (_FORMATTER if x.formatter_near else 0) | (_ASSIGNS if may_assign(x.visible, x.literals) else 0) | (_OPENS if _PATH_CALL.search(x.code) else 0)
        if more:
            found[number] = found.get(number, 0) | more
    return found


@lru_cache
def _wanted(only: frozenset[str] | None) -> int:
    """The set of the rules (a bit each) that are looked for; flows alone lead to SR011."""
    if only is None:
        return -1
    return sum(1 << k for k, rule in enumerate(RULES) if rule.rule_id in only) | (_FLOW_ONLY if "SR011" in only else 0)


def lexed_file(path: str, language: str, content: str) -> tuple[str, list[Line], bool]:
    """What of a file is read (its script, if it is a page), its lines, and whether it ends outside of strings and comments."""
    script = script_source(path, content)
    content = content if script is None else script
    return content, *prepared(content, language)


def read_facts(path: str, language: str, content: str, lines: list[Line], complete: bool) -> syntax.Facts:
    return syntax.read(path, content, language, lines, complete) if language != "config" else syntax.Facts(parsed=False)


def mark_paths(lines: list[Line], facts: syntax.Facts) -> None:
    """Marks the lines with a call that opens a path which is more than a literal."""
    for call in facts.calls:
        if call.line <= len(lines) and reads_variable_path(call):
            lines[call.line - 1].path_call = True


def analyse_file(path: str, language: str, content: str, between_functions: bool, matching: bool = False, only: frozenset[str] | None = None) -> tuple[list[Line], bool, syntax.Facts, dict, dict[int, list[Rule]]]:
    """Lines, whether the file ends outside of strings and comments, facts, evidence by line and rule, and by telling line the rules that match it.

    matching: a file without a telling line is not parsed, as nothing can be found in it. only: the rules that are looked for, all by default.
    """
    content, lines, complete = lexed_file(path, language, content)
    some = telling(lines)
    if only is not None:
        some = {number: mask for number, m in some.items() if (mask := m & _wanted(only))}
    if matching and not some and not (_COMMAND_MODULE in content and (only is None or "SR005" in only)):
        return lines, complete, syntax.Facts(parsed=False), {}, {}
    facts = read_facts(path, language, content, lines, complete)
    mark_paths(lines, facts)
    fired = {number: [rule for k, rule in enumerate(RULES) if mask >> k & 1 and rule.predicate.test(lines[number - 1])] for number, mask in some.items()}
    found = taint.flows(lines, facts, language, fired, between_functions) if facts.parsed else {}
    return lines, complete, facts, found, fired


@contextmanager
def _without_collector() -> Iterator[None]:
    """A syntax tree is many objects without cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _steps(e: taint.Evidence) -> dict:
    return {"steps": [{"line": s.line, "kind": s.kind} for s in e.steps], "depth": e.depth, "remote": e.remote}


def matches(facts: syntax.Facts, found: dict, fired: dict[int, list[Rule]], language: str, only: frozenset[str] | None = None) -> Iterator[tuple[int, int, Rule]]:
    """(line, place in the order of emission, rule) of what fires: rules by their words, then flows and command bindings; gates applied."""
    flowing: dict[int, list[str]] = {}
    for number, rule_id in sorted(found):
        if only is None or rule_id in only:
            flowing.setdefault(number, []).append(rule_id)
    commands = facts.command_calls if only is None or "SR005" in only else {}
    for number in sorted(fired.keys() | flowing.keys() | commands.keys()):
        rules = fired.get(number, [])
        known = {rule.rule_id for rule in rules}
        more = [*flowing.get(number, ()), *(["SR005"] if number in commands else [])]
        rules = [*rules, *(BY_ID[r] for r in dict.fromkeys(more) if r not in known)]
        reliable = facts.parsed and facts.reliable(number)
        classes = facts.classes.get(number, set())
        for place, rule in enumerate(rules):
            if language == "config" and not rule.config or rule.flow_only and (number, rule.rule_id) not in found:
                continue
            if reliable and classes.isdisjoint(rule.gate) or rule.rule_id == "SR005" and number in facts.shadowed:
                continue
            yield number, place, rule


def match_rows(files: DataFrame, between_functions: bool = False, parse_all: bool = False, only: Iterable[str] | None = None) -> DataFrame:
    """A row for each line and rule that fires on it, of files (path, language, content): nothing else leaves the workers.

    only: the rules that are looked for, all by default; rules fire by themselves, but places in the order of emission count these only."""
    asked = None if only is None else frozenset(only)
    kinds = {f.name: f.type for f in MATCHES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*held) if held else [[] for _ in MATCHES]
            out = pa.RecordBatch.from_arrays([pa.array(v, kinds[f.name]) for v, f in zip(columns, MATCHES)], schema=MATCHES)
            held.clear()
            return out

        for rows in batches:
            for k in range(rows.num_rows):  # one file's text at a time
                path, language, content = (rows.column(c)[k].as_py() for c in ("path", "language", "content"))
                with _without_collector():
                    held += matches_of(path, language, content, between_functions, parse_all, asked)
                if len(held) > 20_000:
                    yield batch()
        if held:
            yield batch()

    return files.select("path", "language", "content").mapInArrow(run, MATCHES_SQL)


def matches_of(path: str, language: str | None, content: str | None, between_functions: bool = False, parse_all: bool = False, only: frozenset[str] | None = None) -> list[tuple]:
    """The rows of match_rows for one file."""
    if language is None:
        return []
    lines, _, facts, found, fired = analyse_file(path, language, content or "", between_functions, not parse_all, only)
    out = []
    for number, place, rule in matches(facts, found, fired, language, only):
        x, evidence = lines[number - 1], found.get((number, rule.rule_id))
        reliable = facts.parsed and facts.reliable(number)
        out.append((path, language, number, x.text, x.compact, x.comments, reliable, facts.command_calls.get(number), place, rule.rule_id, _steps(evidence) if evidence else None))
    return out


class Columns:
    """Line rows, gathered by column; what no column asks for is not worked out."""

    def __init__(self, names: Sequence[str] = tuple(KINDS)) -> None:
        self.schema = pa.schema([SCHEMA.field(n) for n in names])
        self.values: dict[str, list] = {n: [] for n in names}
        self.flowing = not FLOWING.isdisjoint(names)
        self.reading = not LEXED.issuperset(names)

    def __len__(self) -> int:
        return len(next(iter(self.values.values())))

    def add(self, path: str, language: str, content: str, between_functions: bool, matching: bool) -> None:
        """The rows of a file; matching: only those of lines that a rule may match."""
        facts, found = syntax.Facts(parsed=False), {}
        if matching or self.flowing:
            lines, complete, facts, found, some = analyse_file(path, language, content, between_functions, matching)
        else:
            content, lines, complete = lexed_file(path, language, content)
            if self.reading:
                facts = read_facts(path, language, content, lines, complete)
            if "path_call" in self.values:
                mark_paths(lines, facts)
        evidence: dict[int, list[dict]] = {}
        for (number, rule), e in sorted(found.items()):
            evidence.setdefault(number, []).append({"rule_id": rule, **_steps(e)})
        wanted = sorted(some.keys() | evidence.keys() | facts.command_calls.keys()) if matching else range(1, len(lines) + 1)
        rows = [lines[number - 1] for number in wanted] if matching else lines
        scope = facts.scope if facts.parsed else lambda _: syntax.MODULE
        for name, values in self.values.items():
            match name:
                case "path" | "language" | "parsed" | "complete" | "error_nodes":
                    values += [{"path": path, "language": language, "parsed": facts.parsed, "complete": complete, "error_nodes": facts.error_nodes}[name]] * len(rows)
                case "line":
                    values += wanted
                case "classes":
                    values += [sorted(facts.classes.get(k, ())) for k in wanted]
                case "reliable":
                    values += [facts.parsed and facts.reliable(k) for k in wanted]
                case "scope_start" | "scope_end":
                    values += [scope(k)[name == "scope_end"] for k in wanted]
                case "shell":
                    values += [facts.command_calls.get(k) for k in wanted]
                case "shadowed":
                    values += [k in facts.shadowed for k in wanted]
                case "flows":
                    values += [evidence.get(k, []) for k in wanted]
                case _:
                    values += [getattr(x, name) for x in rows]

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(self.values.values(), self.schema)], schema=self.schema)
        self.values = {n: [] for n in self.values}
        return out


def line_rows(files: DataFrame, between_functions: bool = False, matching: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a line of the files (path, language, content); matching: only the lines that a rule may match, which leaves the findings as they are.

    columns: those that are asked for, all by default. Files are parsed, and flows looked for, only if one of them takes it."""
    names = tuple(columns or KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Columns(names)
        for batch in batches:
            for k in range(batch.num_rows):  # one file's text at a time
                path, language, content = (batch.column(c)[k].as_py() for c in ("path", "language", "content"))
                if language is not None:
                    with _without_collector():
                        held.add(path, language, content or "", between_functions, matching)
                if len(held) > 20_000:
                    yield held.batch()
        if len(held):
            yield held.batch()

    return files.select("path", "language", "content").mapInArrow(run, ", ".join(f"{n} {KINDS[n]}" for n in names))


def fact_rows(files: DataFrame) -> DataFrame:
    """The syntax facts of files as rows: kind function (items are parameters), call (items are arguments), interpolation, repair (byte range), uncertain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "kind", "name", "qualified", "items", "text", "line", "start", "end"]
        kinds = [pa.list_(pa.string()) if n == "items" else pa.int32() if n in ("line", "start", "end") else pa.string() for n in names]
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in names]
            out = pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for k in range(batch.num_rows):  # one file's text at a time
                path, language, content = (batch.column(c)[k].as_py() for c in ("path", "language", "content"))
                if language in (None, "config"):
                    continue
                with _without_collector():
                    facts = read_facts(path, language, *lexed_file(path, language, content or ""))
                rows += [(path, "function", f.name, f.name, f.params, None, f.start, f.start, f.end) for f in facts.functions]
                rows += [(path, "call", c.name, c.qualified, c.args, c.first, c.line, min(c.scope[0], 1 << 30), min(c.scope[1], 1 << 30)) for c in facts.calls]
                rows += [(path, "interpolation", None, None, [], t, k, k, k) for k, texts in sorted(facts.interpolations.items()) for t in texts]
                rows += [(path, "repair", None, None, [], None, None, a, b) for a, b in facts.repairs]
                rows += [(path, "uncertain", None, None, [], None, a, a, b) for a, b in facts.uncertain]
                if len(rows) > 20_000:
                    yield made()
        if rows:
            yield made()

    return files.select("path", "language", "content").mapInArrow(run, FACTS_SCHEMA)
