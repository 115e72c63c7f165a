"""Readers for languages other than Python: a table of grammars over brackets, calls, declarations and assignments, and one for Ruby's blocks.

Both go on behind errors. Brackets that do not match, blocks that stay open and tokens without an end give uncertain line ranges, as
small as the structure around them allows; everything else is read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from glintsieve.operators import lexer
from glintsieve.operators.facts import COMMAND_API, MODULE, Assignment, Call, Facts, Function, Guard
from glintsieve.operators.lexer import Line

_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "fn", "func", "fun", "sizeof", "match", "elseif", "foreach", "using", "lock", "synchronized", "typeof", "await", "async", "new", "guard", "when", "else", "do", "in", "not", "and", "or"}


@dataclass(frozen=True)
class Grammar:
    """How a language declares functions: by words before the name, or by a name with parameters and a body; and what begins a declaration at the left edge."""

    words: tuple[str, ...] = ()
    bare: bool = True
    typed: bool = False  # parameters end with their names
    edge: str = r"(?!)"


_TYPED_EDGE = r"(?:(?:public|private|protected|internal|static|final|abstract|class|interface|enum|struct|namespace|extern|void|int|char|long|double|float|bool|unsigned|size_t)\b)"
GRAMMARS = {
    "c": Grammar(typed=True, edge=_TYPED_EDGE),
    "csharp": Grammar(typed=True, edge=_TYPED_EDGE),
    "go": Grammar(("func",), bare=False, edge=r"func\b|type\b"),
    "jvm": Grammar(("fun",), typed=True, edge=_TYPED_EDGE + r"|fun\b"),
    "javascript": Grammar(("function", "function*"), edge=r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class)\b"),
    "php": Grammar(("function", "fn"), bare=False, edge=r"(?:abstract\s+|final\s+)?(?:function|class)\b"),
    "rust": Grammar(("fn",), bare=False, edge=r"(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+|unsafe\s+)*(?:fn|impl|mod|struct|enum|trait)\b"),
    "swift": Grammar(("func",), edge=r"(?:public\s+|private\s+)?(?:func|class|struct|extension)\b"),
}

_CALL = re.compile(r"(?<![\w$])(new\s+)?([A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*|\(\)\.[A-Za-z_$][\w$]*)*)(?:<[\w\s,&'*:?.]*>)?!?\s*\(")
_ASSIGN = re.compile(r"(?<![=!<>+\-*/%&|^:])(?::|[+\-*/%&|^]|<<|>>)?=(?![=>])|=>")
_PAIR = re.compile(r"(?:[\w$\])]|^\s*|[,{(]\s*)\s*:\s*(?!:)\S")
_WORD = re.compile(r"[^\W\d][\w$]*|\$[\w$]+")
_RETURN = re.compile(r"\breturn\b")
#: A value is looked up in a list, or a lookup fails.
_LISTED = re.compile(r"\.\s*includes\s*\(|!\s*[\w$.]+\s*\[")
_BODY = re.compile(r"\s*(?:(?:throws|where|->|:|const|noexcept|override)[^;{}()]*)?\{")
_DECLARED_BODY = re.compile(r"[^{};]*\{")
_QUOTED_KEY = re.compile(r"\s*[\"'][^\"']+[\"']\s*:")
_INTERPOLATED = re.compile(r"\$\{([^{}]*)\}")
_UNSAFE = re.compile(r"\bunsafe\b")
_PHP_CALL = re.compile(r"\b(?:eval|include|require)\b")
_PARTS = re.compile(r"\.|::|->")
_PREFIXED = re.compile(r"^[rb@]?$", re.IGNORECASE)
_ARROW = re.compile(r"([A-Za-z_$][\w$]*)\s*[=:]\s*(?:async\s*)?\(([^()]*)\)\s*(?::[^={]*)?=>\s*\{")


_PARTNER = {")": "(", "]": "[", "}": "{"}


def brackets(text: str, line_of: Callable[[int], int], edge: re.Pattern | None = None) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Position of each opening bracket's partner, and line ranges of brackets without one.

    A closing bracket ends what was opened last of its kind; what stands open inside is an error up to there. Where something is open at
    the end, declarations at the left edge are taken to begin anew, if an edge is known."""
    pairs: dict[int, int] = {}
    errors: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    last = line_of(max(len(text) - 1, 0))
    tokens = re.compile(r"[()\[\]{}]" + (rf"|^(?:{edge.pattern})" if edge else ""), re.MULTILINE)
    for m in tokens.finditer(text):
        c, at = m.group(), m.start()
        if len(c) > 1 or c not in "()[]{}":
            if stack:
                errors.append((line_of(stack[0][1]), line_of(at) - 1))
                stack.clear()
        elif c in "([{":
            stack.append((c, at))
        else:
            k = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 65), -1) if stack[k][0] == _PARTNER[c]), None)
            if k is None:
                errors.append((line_of(at), line_of(at)))
                continue
            if k < len(stack) - 1:
                errors.append((line_of(stack[k + 1][1]), line_of(at)))
            pairs[stack[k][1]] = at
            del stack[k:]
    if stack:
        errors.append((line_of(stack[0][1]), last))
    return pairs, errors


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that overlap or touch as one, sorted."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(r for r in ranges if r[0] <= r[1]):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def open_token(text: str, language: str) -> int:
    """The line on which the token begins that a file ends in."""
    text = text.replace("\r\n", "\n")
    found = lexer.spans(text, language)[0]
    return text.count("\n", 0, found[-1][0]) + 1 if found else 1


@lru_cache
def _declares(words: tuple[str, ...]) -> re.Pattern:
    """What stands before a name that is declared."""
    return re.compile(r"(?:" + "|".join(rf"\b{re.escape(w)}" for w in words) + r")\s+$|\bfunc\s*\([^)]*\)\s*$") if words else re.compile(r"(?!)")


def _split_args(masked: str, start: int, end: int) -> list[tuple[int, int]]:
    out, depth, at = [], 0, start
    for k in range(start, end):
        c = masked[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append((at, k))
            at = k + 1
    return [*out, (at, end)] if masked[start:end].strip() or out or end > start else []


def read(text: str, language: str, lines: list[Line], complete: bool) -> Facts:
    """The facts of a file by its language's grammar."""
    facts, grammar = Facts(), GRAMMARS.get(language, Grammar())
    # same length as the source in characters, so that positions agree
    source = "\n".join(x.text for x in lines)
    masked = "\n".join(_aligned(x) for x in lines)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x.text) + 1)
    line_of = lambda at: min(bisect_right(starts, at), max(len(lines), 1))
    pairs, errors = brackets(masked, line_of)
    if errors:
        again = brackets(masked, line_of, re.compile(grammar.edge))
        size = lambda found: sum(b - a + 1 for a, b in joined(found[1]))
        pairs, errors = min((pairs, errors), again, key=size)
    if not complete:
        errors.append((open_token(text, language), len(lines)))
    facts.uncertain, facts.error_nodes = joined(errors), len(errors)
    if errors and sum(b - a + 1 for a, b in facts.uncertain) >= len(lines):
        raise ValueError("nothing can be read")
    declares = _declares(grammar.words)
    for m in _CALL.finditer(masked):
        new, qualified = m.group(1), "".join(m.group(2).split())
        name = _PARTS.split(qualified)[-1]
        opening = m.end() - 1
        closing = pairs.get(opening)
        if closing is None or name in _KEYWORDS:
            continue
        line = line_of(m.start())
        after = masked[closing + 1 : closing + 200]
        before = masked[max(0, m.start() - 24) : m.start()]
        declared = declares.search(before) if before[-1:].isspace() or before[-1:] == ")" else None  # what it finds ends so
        body = (_DECLARED_BODY if declared else _BODY).match(after)
        inner = _split_args(masked, opening + 1, closing)
        if declared or (grammar.bare and body and not new and "." not in qualified):
            params = [w for a, b in inner if (w := _parameter(masked[a:b], grammar.typed))]
            end = pairs.get(closing + body.end()) if body else closing
            facts.functions.append(Function(name, params, line, line_of(end or closing)))
            continue
        facts.mark(line, "C")
        args = [w.group().lstrip("$") if (w := _WORD.search(masked[a:b])) else "" for a, b in inner]
        first = inner[0] if inner else (0, 0)
        facts.calls.append(Call(name, qualified, args, source[first[0] : first[1]].strip(), line, _varies(masked[first[0] : first[1]], source[first[0] : first[1]])))
    for m in _ARROW.finditer(masked):
        opening = m.end() - 1
        if opening not in pairs:
            continue
        params = [w for x in m.group(2).split(",") if (w := _parameter(x, grammar.typed))]
        facts.functions.append(Function(m.group(1), params, line_of(m.start()), line_of(pairs[opening])))
    for k, x in enumerate(lines, 1):
        plain = _aligned(x)
        if _WORD.search(plain):
            facts.mark(k, "I")
        if _ASSIGN.search(plain) or _PAIR.search(plain) or _QUOTED_KEY.match(x.visible):
            facts.mark(k, "S")
        if language == "rust" and _UNSAFE.search(plain):
            facts.mark(k, "U")
        if language == "php" and _PHP_CALL.search(plain):
            facts.mark(k, "C")
        for m in _INTERPOLATED.finditer(x.visible) if "${" in x.visible else ():
            if any("`" in lit or "$" in lit for lit in x.literals):
                facts.interpolations.setdefault(k, []).append("${" + m.group(1) + "}")
        sign = next((m for m in _ASSIGN.finditer(plain) if not m.group().endswith(">")), None)
        left = _WORD.findall(plain[: sign.start()]) if sign else []
        if left:
            facts.assignments.append(Assignment(left[-1].lstrip("$"), " ".join([plain[sign.end() :], *facts.interpolations.get(k, ())]), k))
        if _RETURN.search(plain) and _LISTED.search(plain):
            facts.guards.append(Guard([w.lstrip("$") for w in _WORD.findall(plain)], k))
    if language == "javascript":
        _bindings(facts, lines)
    return facts


def _varies(masked: str, text: str) -> bool:
    """Whether an argument has more than literals: words outside of strings that are no prefix of one, or interpolated ones."""
    left = masked.strip()
    if "${" in text or not left:
        return "${" in text
    return bool(_WORD.search(left)) and not (_PREFIXED.match(left) and text.strip()[len(left) :][:1] in "'\"`")


def _aligned(line: Line) -> str:
    """The masked view with one character for each of the text's."""
    if line.masked is line.text or len(line.masked) == len(line.text):
        return line.masked
    kept, at = [], 0
    for c in line.text:
        wide = len(c.encode(errors="surrogatepass"))
        if line.masked[at : at + 1] == c:
            kept.append(c)
            at += 1
        else:
            kept.append(" ")
            at += wide
    return "".join(kept)


def _parameter(text: str, typed: bool) -> str:
    text = text.split("=", 1)[0]
    if typed and ":" not in text.replace("::", "."):
        found = _WORD.findall(text)
        return found[-1] if found else ""
    m = _WORD.search(text.split(":", 1)[0])
    return m.group().lstrip("$") if m else ""


_MODULE = r"['\"](?:node:)?child_process['\"]"
_NAMED = re.compile(rf"(?:const|let|var)\s*\{{([^}}]*)\}}\s*=\s*require\(\s*{_MODULE}\s*\)|import\s*\{{([^}}]*)\}}\s*from\s*{_MODULE}")
_WHOLE = re.compile(rf"(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*{_MODULE}\s*\)|import\s+(?:\*\s*as\s+)?([\w$]+)\s+from\s*{_MODULE}")
_DECLARED = re.compile(r"(?:\b(?:const|let|var)\s+|^\s*|;\s*)([A-Za-z_$][\w$]*)\s*=(?![=>])")


def _bindings(facts: Facts, lines: list[Line]) -> None:
    """Calls of child-process functions by their imported names, unless the name is shadowed where it is called."""
    bound: dict[str, str] = {}
    declared: list[tuple[str, int, bool]] = []
    for k, x in enumerate(lines, 1):
        imported: set[str] = set()
        for m in _NAMED.finditer(x.visible):
            for entry in (m.group(1) or m.group(2)).split(","):
                names = [w for w in re.split(r"\s*:\s*|\s+as\s+|\s+", entry.strip()) if w]
                if names and names[0] in COMMAND_API:
                    bound[names[-1]] = names[0]
        for m in _WHOLE.finditer(x.visible):
            bound[m.group(1) or m.group(2)] = "*"
            imported.add(m.group(1) or m.group(2))
        for m in _DECLARED.finditer(_aligned(x)):
            declared.append((m.group(1), k, m.group(1) in imported))
    for call in facts.calls:
        head, _, tail = call.qualified.partition(".")
        api = bound.get(head)
        name = tail if api == "*" else api if api and not tail else None
        if name not in COMMAND_API:
            continue
        scope = call.scope = facts.scope(call.line) if facts.scopes else _innermost(facts, call.line)
        inner = next((f for f in facts.functions if (f.start, f.end) == scope), None)
        again = [d for d in declared if d[0] == head and d[1] <= call.line and (_innermost(facts, d[1]) in (scope, MODULE))]
        if (inner and head in inner.params) or (again and not again[-1][2] and api != head and not _is_import(lines[again[-1][1] - 1])):
            facts.shadowed.add(call.line)
        else:
            facts.command_calls[call.line] = COMMAND_API[name]


def _is_import(line: Line) -> bool:
    return bool(_NAMED.search(line.visible) or _WHOLE.search(line.visible))


def _innermost(facts: Facts, line: int) -> tuple[int, int]:
    if not facts.scopes:
        facts.scopes = sorted({(f.start, f.end) for f in facts.functions})
    return facts.scope(line)


# --- Ruby ------------------------------------------------------------------------------------------

_OPENS = re.compile(r"^\s*(?:def|class|module|if|unless|while|until|case|for|begin)\b|(?:[=(,]|<<)\s*(?:if|unless|case|begin|while|until)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
_DEF = re.compile(r"^(\s*)def\s+(?:self\.|[A-Z]\w*\.)?([A-Za-z_]\w*[?!=]?)\s*(?:\(([^()]*)\)|([^=;]*))?(\s*=[^=])?")
#: The do of a loop opens nothing by itself.
_LOOP_DO = re.compile(r"^(\s*(?:while|until|for)\b.*)\bdo\b")
_END = re.compile(r"(?:^|;|\s)end\b(?!\s*[:?])")
_RUBY_CALL = re.compile(r"(?<![\w$@:])((?:[A-Za-z_@$][\w@]*(?:\.|::|&\.))*[A-Za-z_]\w*[?!]?)(?:\(|[ \t]+(?!(?:do|if|unless|while|until|and|or|then|in|rescue)\b)(?=[\w@$\"':\[{*&-][^=]?)(?![=<>+*/%|&-]\s))")
_RUBY_WORDS = {"if", "unless", "while", "until", "case", "when", "then", "else", "elsif", "def", "class", "module", "end", "do", "return", "and", "or", "not", "in", "rescue", "ensure", "begin", "yield", "self", "nil", "true", "false", "for", "super", "alias", "undef", "next", "break"}
_RUBY_ASSIGN = re.compile(r"([A-Za-z_@$][\w@]*)\s*(?:[+\-*/|&]|\|\||&&|<<)?=(?![=~>])")


def ruby(text: str, lines: list[Line], complete: bool) -> Facts:
    """The facts of a Ruby file. Blocks end by end; a def that is still open where another one stands as far left is an error of the lines that it indents."""
    facts = Facts()
    stack: list[tuple[int, int, Function | None]] = []  # line, indentation, the function of a def
    errors: list[tuple[int, int]] = []
    indents = [len(x.masked) - len(x.masked.lstrip()) if x.masked.strip() else None for x in lines]

    def given_up(line: int, indent: int) -> None:
        last = line
        while last < len(lines) and (indents[last] is None or indents[last] > indent):
            last += 1
        errors.append((line, last))

    for k, x in enumerate(lines, 1):
        plain = _aligned(x)
        if not plain.strip():
            continue
        facts.mark(k, "I")
        for m in re.finditer(r"#\{([^{}]*)\}", x.visible):
            if any("#{" in lit for lit in x.literals):
                facts.interpolations.setdefault(k, []).append("#{" + m.group(1) + "}")
        indent = indents[k - 1] or 0
        declared = _DEF.match(plain)
        if declared:
            while stack and stack[-1][2] is not None and stack[-1][1] >= indent:
                at, left, _ = stack.pop()
                given_up(at, left)
            names = re.findall(r"[A-Za-z_]\w*", declared.group(3) or declared.group(4) or "")
            f = Function(declared.group(2), names, k, k)
            if declared.group(5) or _END.search(plain[declared.end(2) :]):
                facts.functions.append(f)
            else:
                stack.append((k, indent, f))
        else:
            opened = len(_OPENS.findall(_LOOP_DO.sub(r"\1", plain)))
            closed = len(_END.findall(plain))
            stack += [(k, indent, None)] * max(opened - closed, 0)
            for _ in range(max(closed - opened, 0)):
                if not stack:
                    errors.append((k, k))
                    break
                _, _, f = stack.pop()
                if f is not None:
                    f.end = k
                    facts.functions.append(f)
        _ruby_line(facts, x, plain, k, declared is not None)
    for line, indent, _ in stack:
        given_up(line, indent)
    if not complete:
        errors.append((open_token(text, "ruby"), len(lines)))
    facts.uncertain, facts.error_nodes = joined(errors), len(errors)
    if errors and sum(b - a + 1 for a, b in facts.uncertain) >= len(lines):
        raise ValueError("nothing can be read")
    return facts


def _ruby_line(facts: Facts, x: Line, plain: str, k: int, declared: bool) -> None:
    """Calls, with and without brackets, assignments and pairs of a line."""
    sign = _RUBY_ASSIGN.search(plain) if not declared else None
    if sign or re.search(r"=>|\b\w+:\s", plain):
        facts.mark(k, "S")
    if sign:
        facts.assignments.append(Assignment(sign.group(1), " ".join([plain[sign.end() :], *facts.interpolations.get(k, ())]), k))
    if declared:
        return
    if re.search(r"[\w)\]}]\.[a-z_]\w*", plain):
        facts.mark(k, "C")  # a method without arguments is called, too
    for m in _RUBY_CALL.finditer(x.visible if len(x.visible) == len(plain) else plain):
        qualified = m.group(1)
        name = re.split(r"\.|::|&\.", qualified)[-1]
        if name in _RUBY_WORDS or not plain[m.start() : m.start() + 1].strip():  # inside a string
            continue
        end, depth = m.end(), 0
        while end < len(plain) and not (depth == 0 and plain[end] in ");"):
            depth += (plain[end] in "([{") - (plain[end] in ")]}")
            end += 1
        inner = _split_args(plain, m.end(), end)
        args = [w.group() if (w := _WORD.search(plain[a:b])) else "" for a, b in inner]
        first = inner[0] if inner else (0, 0)
        facts.mark(k, "C")
        facts.calls.append(Call(name, qualified, args, x.text[first[0] : first[1]].strip(), k, _varies(plain[first[0] : first[1]], x.text[first[0] : first[1]])))
