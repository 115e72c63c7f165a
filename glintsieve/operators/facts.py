"""Syntax facts of a file: functions, calls, node classes by line, scopes, interpolations, command bindings, repair ranges.

Python is parsed by the standard library, other languages by readers over the lexer's masked text (see structure). All of them go on behind
what they cannot read: such lines are uncertain, and rules judge them by their text. A file of which nothing can be read is lexical.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field

from glintsieve.operators.lexer import Line

#: extension -> reader (fixed values)
READERS = {
    **dict.fromkeys(["py", "pyw"], "python"),
    **dict.fromkeys(["rb", "rake"], "ruby"),
    **dict.fromkeys(["c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx", "cs", "go", "java", "kt", "kts", "js", "jsx", "mjs", "cjs", "ts", "tsx", "php", "phtml", "rs", "swift", "vue", "svelte", "astro"], "structure"),
}
MAX_NODES = 1_000_000
REQUEST_CALLS = {f"requests.{x}" for x in ("get", "post", "put", "patch", "delete", "head", "options", "request")}
#: Child-process functions: whether they use a shell (fixed values).
COMMAND_API = {"exec": True, "execSync": True, "spawn": False, "spawnSync": False, "execFile": False, "execFileSync": False, "fork": False}
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "fn", "func", "fun", "sizeof", "match", "elseif", "foreach", "using", "lock", "synchronized", "typeof", "await", "new", "guard", "when", "else", "do", "in", "not", "and", "or"}


@dataclass
class Function:
    name: str
    params: list[str]
    start: int
    end: int


MODULE = (1, 1 << 30)


@dataclass
class Call:
    """variable: the first argument is more than literals."""

    name: str
    qualified: str
    args: list[str]
    first: str
    line: int
    variable: bool = False
    scope: tuple[int, int] = MODULE


@dataclass
class Assignment:
    """A name gets a value; right is the masked text of the right side, with what its strings interpolate."""

    name: str
    right: str
    line: int
    scope: tuple[int, int] = MODULE


@dataclass
class Guard:
    """A line that returns unless (or if) a value is in a list; the names in it are checked from there on."""

    names: list[str]
    line: int
    scope: tuple[int, int] = MODULE


@dataclass
class Facts:
    parsed: bool = True
    error_nodes: int = 0
    functions: list[Function] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
    classes: dict[int, set[str]] = field(default_factory=dict)
    uncertain: list[tuple[int, int]] = field(default_factory=list)
    interpolations: dict[int, list[str]] = field(default_factory=dict)
    command_calls: dict[int, bool] = field(default_factory=dict)
    shadowed: set[int] = field(default_factory=set)
    repairs: list[tuple[int, int]] = field(default_factory=list)
    scopes: list[tuple[int, int]] = field(default_factory=list)
    assignments: list[Assignment] = field(default_factory=list)
    guards: list[Guard] = field(default_factory=list)

    def text(self, lines: list[Line], number: int, masked) -> str:
        """The masked text of a line, and of the code that its strings interpolate."""
        return " ".join([lines[number - 1].masked, *map(masked, self.interpolations.get(number, ()))])

    def mark(self, line: int, kind: str) -> None:
        found = self.classes.get(line)
        if found is None:
            self.classes[line] = {kind}
        else:
            found.add(kind)

    inner: list[tuple[int, int]] = field(default_factory=list)

    def scope(self, line: int) -> tuple[int, int]:
        """The innermost function around a line."""
        if self.scopes and not self.inner:
            # smaller scopes are put over larger ones, line by line
            self.inner = [MODULE] * (max(s[1] for s in self.scopes) + 1)
            for s in sorted(self.scopes, key=lambda s: (s[1] - s[0], s[0]), reverse=True):
                self.inner[s[0] : s[1] + 1] = [s] * (s[1] + 1 - s[0])
        return self.inner[line] if 0 <= line < len(self.inner) else MODULE

    def reliable(self, line: int) -> bool:
        """Whether a line is in no uncertain range; they are sorted and apart."""
        if not self.uncertain:
            return True
        k = bisect_right(self.uncertain, (line, 1 << 30)) - 1
        return k < 0 or self.uncertain[k][1] < line


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def read(path: str, text: str, language: str, lines: list[Line], complete: bool) -> Facts:
    """The facts of a file, or facts that say it was not parsed."""
    from glintsieve.operators import structure

    reader = READERS.get(extension(path))
    try:
        if reader == "python":
            facts = _python(text, lines)
        elif reader == "ruby":
            facts = structure.ruby(text, lines, complete)
        else:
            facts = structure.read(text, language, lines, complete) if reader else Facts(parsed=False)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        facts = Facts(parsed=False)
    if facts.parsed:
        facts.scopes = sorted({(f.start, f.end) for f in facts.functions})
        for x in (*facts.calls, *facts.assignments, *facts.guards):
            x.scope = facts.scope(x.line)
        facts.calls.sort(key=lambda c: c.line)
    return facts


# --- Python --------------------------------------------------------------------------------------


def _first_name(node: ast.AST) -> str:
    """The first identifier in a node, '' if there is none."""
    while isinstance(node, (ast.Attribute, ast.Subscript, ast.Starred, ast.Await)):
        node = node.value
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Constant):
        return ""
    found = [(n.lineno, n.col_offset, n.id) for n in ast.walk(node) if isinstance(n, ast.Name)]
    return min(found)[2] if found else ""


def _targets(node: ast.AST) -> list[str]:
    """The names that an assignment to a node defines."""
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.Attribute):
        return [node.attr]
    if isinstance(node, (ast.Subscript, ast.Starred)):
        return _targets(node.value)
    return [x for e in node.elts for x in _targets(e)] if isinstance(node, (ast.Tuple, ast.List)) else []


#: Nodes without anything below that tells.
_LEAVES = {ast.Load, ast.Store, ast.Del, ast.Constant, *ast.operator.__subclasses__(), *ast.unaryop.__subclasses__(), *ast.cmpop.__subclasses__(), *ast.boolop.__subclasses__()}


def _kinds(kind: type) -> set[type]:
    return {kind}.union(*map(_kinds, kind.__subclasses__()))


#: Nodes that the walk goes on to.
_INNER = _kinds(ast.AST) - _LEAVES


class _Python:
    """Reads the facts of a Python file in one walk over its tree."""

    def __init__(self, text: str, lines: list[Line]) -> None:
        self.facts, self.lines = Facts(), lines
        # lines as the parser counts them; columns are in bytes
        self.data = text.encode()
        self.starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", self.data))]
        self.masked_rows: dict[int, bytes] = {}
        self.values: list[tuple[Assignment, int, int]] = []  # with the lines of the right side
        self.handlers = {
            ast.FunctionDef: self.function, ast.AsyncFunctionDef: self.function, ast.Call: self.call, ast.Assign: self.assign, ast.AugAssign: self.assign, ast.AnnAssign: self.assign,
            ast.NamedExpr: self.assign, ast.If: self.branch, ast.Dict: self.pairs, ast.Name: self.identifier, ast.Attribute: self.identifier, ast.arg: self.identifier, ast.FormattedValue: self.interpolation,
        }

    def read(self, tree: ast.AST) -> Facts:
        stack, count, handlers = [tree], 0, self.handlers
        while stack:
            node = stack.pop()
            count += 1
            handler = handlers.get(node.__class__)
            if handler:
                handler(node)
            below = []
            for value in node.__dict__.values():
                kind = value.__class__
                if kind in _INNER:
                    below.append(value)
                elif kind is list and value:
                    below += [x for x in value if x.__class__ in _INNER]
            below.reverse()
            stack += below
            if count > MAX_NODES:
                raise ValueError("too many nodes")
        for a, first, last in self.values:
            inner = [x for k in range(first, last + 1) for x in self.facts.interpolations.get(k, ())]
            a.right = " ".join([a.right, *inner]) if inner else a.right
        return self.facts

    def segment(self, node: ast.AST) -> str:
        return self.data[self.starts[node.lineno - 1] + node.col_offset : self.starts[node.end_lineno - 1] + node.end_col_offset].decode()

    def masked(self, node: ast.AST) -> str:
        out = []
        for k in range(node.lineno, min(node.end_lineno, len(self.lines)) + 1):
            row = self.masked_rows.get(k)
            if row is None:
                row = self.masked_rows[k] = self.lines[k - 1].masked.encode()
            out.append(row[node.col_offset if k == node.lineno else 0 : node.end_col_offset if k == node.end_lineno else len(row)].decode(errors="replace"))
        return " ".join(out)

    def qualified(self, node: ast.AST) -> str:
        parts, at = [], node
        while isinstance(at, ast.Attribute):
            parts.append(at.attr)
            at = at.value
        return ".".join([at.id, *reversed(parts)]) if isinstance(at, ast.Name) else "".join(self.segment(node).split())

    def function(self, node) -> None:
        a = node.args
        params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
        self.facts.functions.append(Function(node.name, params, node.lineno, node.end_lineno))

    def call(self, node: ast.Call) -> None:
        facts, line = self.facts, node.lineno
        facts.mark(line, "C")
        qualified = self.qualified(node.func)
        given = [*node.args, *[k.value for k in node.keywords]]
        first = given[0] if given else None
        variable = first is not None and not isinstance(first, ast.Constant) and (isinstance(first, ast.Name) or any(isinstance(x, ast.Name) for x in ast.walk(first)))
        facts.calls.append(Call(qualified.rsplit(".", 1)[-1], qualified, [_first_name(x) for x in given], self.segment(first) if given else "", line, variable))
        for k in node.keywords:
            facts.mark(k.lineno, "S")
            if k.arg == "verify" and isinstance(k.value, ast.Constant) and k.value.value is False and qualified in REQUEST_CALLS:
                v = k.value
                facts.repairs.append((self.starts[v.lineno - 1] + v.col_offset, self.starts[v.end_lineno - 1] + v.end_col_offset))

    def assign(self, node) -> None:
        self.facts.mark(node.lineno, "S")
        if node.value is None:
            return
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        right = self.masked(node.value) + (" " + self.masked(node.target) if isinstance(node, ast.AugAssign) else "")
        for name in (x for target in targets for x in _targets(target)):
            a = Assignment(name, right, node.lineno)
            self.facts.assignments.append(a)
            self.values.append((a, node.value.lineno, node.value.end_lineno))

    def branch(self, node: ast.If) -> None:
        """A line that returns unless something is in a list checks the names of its test."""
        if isinstance(node.body[0], ast.Return) and node.body[0].lineno == node.lineno:
            if any(isinstance(x, ast.Compare) and any(isinstance(op, ast.NotIn) for op in x.ops) for x in ast.walk(node.test)):
                self.facts.guards.append(Guard([x.id for x in ast.walk(node.test) if isinstance(x, ast.Name)], node.lineno))

    def pairs(self, node: ast.Dict) -> None:
        for k in node.keys:
            if k is not None:
                self.facts.mark(k.lineno, "S")

    def identifier(self, node) -> None:
        self.facts.mark(node.end_lineno, "I")

    def interpolation(self, node: ast.FormattedValue) -> None:
        inner = self.segment(node.value)
        if inner:
            self.facts.interpolations.setdefault(node.value.lineno, []).append("{" + inner + "}")


#: Lines that go on with the statement before them.
_GOES_ON = re.compile(r"(?:else|elif|except|finally|case)\b|[)\]}@]")


def _blocks(lines: list[Line]) -> list[tuple[int, int]]:
    """First and last lines of the statements of a module, by what begins at the left edge outside of strings; decorators belong to what follows."""
    begins = [k for k, x in enumerate(lines, 1) if x.masked[:1].strip() and not _GOES_ON.match(x.masked)]
    for k in range(len(begins)):
        while begins[k] > 1 and lines[begins[k] - 2].masked.startswith("@"):
            begins[k] -= 1
    return [(a, b - 1) for a, b in zip(begins, [*begins[1:], len(lines) + 1])]


def _python(text: str, lines: list[Line]) -> Facts:
    """The facts of a Python file. Where it does not parse as a whole, its statements are parsed one by one, and those that fail are uncertain."""
    try:
        return _Python(text, lines).read(ast.parse(text))
    except SyntaxError:
        pass
    rows, body, wrong = [x.text for x in lines], [], []
    for first, last in _blocks(lines):
        try:
            found = ast.parse("\n".join(rows[first - 1 : last]))
        except SyntaxError:
            wrong.append((first, last))
            continue
        body += [ast.increment_lineno(node, first - 1) for node in found.body]
    if not body:
        raise ValueError("no statement can be read")
    facts = _Python("\n".join(rows), lines).read(ast.Module(body, []))
    facts.uncertain, facts.error_nodes = wrong, len(wrong)
    return facts
