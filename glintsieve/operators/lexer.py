"""Views of source lines: what is code, what is a string, a comment or a regular-expression literal.

A file is read once by one scanner pattern per language that jumps from token to token; text between tokens is code. The
state that crosses lines (open comments, strings, raw strings) is simply the token that is being read, so a part of a file
that begins with a line is read alone, given the token that is open before it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import NamedTuple

CODE, STRING, COMMENT, REGEX = range(4)

SLASH_COMMENTS = {"c", "csharp", "go", "javascript", "jvm", "php", "rust", "swift"}
HASH_COMMENTS = {"php", "python", "ruby", "config"}
NESTED_COMMENTS = {"rust", "swift"}
BACKTICKS = {"go", "javascript"}
TRIPLE_QUOTES = {"csharp", "jvm", "python", "swift"}
REGEX_LITERALS = {"javascript", "ruby"}
#: Words after which a slash begins a regular expression (fixed values).
_REGEX_WORDS = "await|case|delete|in|instanceof|new|of|return|throw|typeof|void|yield"
_REGEX_START = re.compile(rf"(?:^|[(\[{{:,;=!?&|+\-*%^~<>]|(?<!\w)(?:{_REGEX_WORDS}))\s*\Z")
_REGEX_LITERAL = re.compile(r"/(?:\\[^\n]?|\[(?:\\[^\n]?|[^\]\\\n])*+\]|[^/\\\[\n])*+/[^\W\d_]*")


@dataclass
class Line:
    text: str
    language: str
    code: str
    visible: str
    masked: str
    literals: list[str] = field(default_factory=list)
    comments: str = ""
    path_call: bool = False
    formatter_near: bool = False

    @cached_property
    def compact(self) -> str:
        return "".join(self.code.split())


class Open(NamedTuple):
    """A token that is being read: how it is closed, by what mark, and how deep it is nested."""

    how: str
    mark: str
    depth: int = 1


@lru_cache
def _scanner(language: str) -> re.Pattern:
    """Where the next token other than code begins; the group's name is its kind."""
    parts = []
    if language in HASH_COMMENTS:
        parts.append(r"(?P<line>#[^\n]*)")
    if language == "javascript":
        parts.append(r"(?P<bang>^\#![^\n]*)")
    if language in SLASH_COMMENTS:
        parts += [r"(?P<line2>//[^\n]*)", r"(?P<block>/\*)"]
    if language in REGEX_LITERALS:
        parts.append(r"(?P<slash>/(?!=))")
    if language == "rust":
        parts += [r"(?P<raw>b?r(?P<hashes>\#*)\")", r"(?P<life>'(?=[^\W\d]\w*(?!['\w])))"]
    if language in TRIPLE_QUOTES:
        parts.append(r"(?P<triple>\"\"\"" + (r"|'''" if language == "python" else "") + ")")
    if language == "csharp":
        parts.append(r"(?P<verbatim>(?<=@)\"|(?<=@\$)\")")
    parts.append(r"(?P<quote>[\"'" + ("`" if language in BACKTICKS else "") + "])")
    return re.compile("|".join(parts), re.MULTILINE)


@lru_cache
def _closing(how: str, mark: str) -> re.Pattern:
    """The rest of a token up to its end, a group; where that does not come, the rest of the text and no group."""
    end = re.escape(mark)
    if how == "plain":  # no escapes
        return re.compile(rf"[^{end}]*+(?:({end})|\Z)")
    if how == "verbatim":
        return re.compile(r'(?:[^"]|"")*+(?:(")|\Z)')
    if how == "triple":
        return re.compile(rf"(?:\\[^\n]?|(?!{end})[^\\])*+(?:({end})|\Z)", re.DOTALL)
    return re.compile(rf"(?:\\[^\n]?|[^{end}\\])*+(?:({end})|\Z)", re.DOTALL)


def _closed(text: str, at: int, token: Open, language: str) -> tuple[int, Open | None]:
    """Where a token that is being read ends, and what is still open at the text's end."""
    if token.how == "block":
        depth = token.depth
        for m in re.compile(r"/\*|\*/" if language in NESTED_COMMENTS else r"\*/").finditer(text, at):
            depth += 1 if m.group() == "/*" else -1
            if depth == 0:
                return m.end(), None
        return len(text), Open("block", token.mark, depth)
    if token.how == "raw":
        end = text.find(token.mark, at)
        return (end + len(token.mark), None) if end >= 0 else (len(text), token)
    m = _closing(token.how, token.mark).match(text, at)
    return m.end(), None if m.group(1) else token


_STEPS = {STRING: re.compile(r"\\[^\n]|[^\n]"), COMMENT: re.compile(r"\*/|[^\n]")}


def split_lines(text: str) -> list[str]:
    """Lines by line feed, without one carriage return before it; no line after the last line feed."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def spans(text: str, language: str, before: Open | None = None) -> tuple[list[tuple[int, int, int, int]], bool, Open | None]:
    """(start, end, kind, length of the opening mark) of what is not code, whether all expressions are closed in their lines, and the token open at the end.

    before: the token that is open where the text begins; its start is -1."""
    out: list[tuple[int, int, int, int]] = []
    find, at, closed, after = _scanner(language).search, 0, True, None
    if before and text:
        at, after = _closed(text, 0, before, language)
        out.append((-1, at, COMMENT if before.how == "block" else STRING, 0))
    while m := find(text, at):
        start, kind = m.start(), m.lastgroup
        if m.groupdict().get("raw") is not None:
            kind = "raw"
        if kind in ("line", "line2", "bang"):
            at = m.end()
            out.append((start, at, COMMENT, at - start))
        elif kind == "block":
            at, after = _closed(text, m.end(), Open("block", "*/"), language)
            out.append((start, at, COMMENT, 2))
        elif kind == "slash":
            line = text.rfind("\n", 0, start) + 1
            if not _REGEX_START.search(_before(text, line, start, out)):
                at = start + 1
                continue
            literal = _REGEX_LITERAL.match(text, start)
            if literal:
                at = literal.end()
            else:
                end = text.find("\n", start)
                at, closed = len(text) if end < 0 else end, False
            out.append((start, at, REGEX, at - start))
        elif kind == "life":
            at = start + 1
        else:
            mark = m.group()
            if kind == "raw":
                token = Open("raw", '"' + m.group("hashes"))
            elif kind in ("triple", "verbatim"):
                token = Open(kind, mark)
            else:
                token = Open("plain" if language == "go" and mark == "`" else "escaped", mark)
            at, after = _closed(text, m.end(), token, language)
            out.append((start, at, STRING, m.end() - start))
    return out, closed, after


def plain(text: str, language: str) -> bool:
    """Whether a text is code without a token: every view of it is the text."""
    return _scanner(language).search(text) is None


def _before(text: str, line: int, start: int, found: list[tuple[int, int, int, int]]) -> str:
    """The line's code before a position, tokens as spaces."""
    parts, at = [], line
    for a, b, _, _ in reversed(found):
        if b <= line:
            break
        parts.append(text[b:start] if not parts else text[b:at])
        parts.append(" ")
        at = a
    if not parts:
        return text[line:start]
    parts.append(text[line:at] if at > line else "")
    return "".join(reversed(parts))


def _blank(text: str) -> str:
    """Spaces of the text's width in UTF-8."""
    return " " * (len(text) if text.isascii() else len(text.encode(errors="surrogatepass")))


def _steps(piece: str, kind: int, opening: int) -> str:
    """One space a step of reading."""
    if kind == REGEX or (kind == COMMENT and opening == len(piece)):
        return " "
    rest = piece[opening:]
    return (" " if opening else "") + " " * len(_STEPS[kind].findall(rest))


def lex(text: str, language: str) -> tuple[list[Line], bool]:
    """The lines of a file, and whether it ends outside of comments and strings."""
    lines, closed, after = lex_part(text, language)
    return lines, closed and after is None


def ends(text: str, language: str, before: Open | None = None) -> tuple[bool, Open | None]:
    """Whether all expressions of a part are closed, and the token open at its end."""
    return (True, None) if language == "config" else spans(text.replace("\r\n", "\n"), language, before)[1:]


def lex_part(text: str, language: str, before: Open | None = None) -> tuple[list[Line], bool, Open | None]:
    """The lines of a part of a file that begins with a line, given the token open before it; then as spans()."""
    text = text.replace("\r\n", "\n")
    lines = split_lines(text)
    if language == "config":
        return [config_line(x) for x in lines], True, None
    found, closed, after = spans(text, language, before)
    out, at, k = [], 0, 0
    for raw in lines:
        end = at + len(raw)
        if k >= len(found) or found[k][0] >= end:
            out.append(Line(raw, language, raw, raw, raw))
        else:
            code, visible, masked, literals, comments, pos = [], [], [], [], [], at
            last_kind, last_end = CODE, -1
            while k < len(found) and found[k][0] < end:
                a, b, kind, opening = found[k]
                if a > pos:
                    plain = text[pos:a]
                    code.append(plain)
                    visible.append(plain)
                    masked.append(plain)
                from_, to = max(a, at), min(b, end)
                piece = text[from_:to]
                code.append(_steps(piece, kind, opening if from_ == a else 0))
                visible.append(piece if kind == STRING else _blank(piece))
                masked.append(_blank(piece))
                if piece and kind == STRING:
                    if last_kind == STRING and last_end == from_:
                        literals[-1] += piece
                    else:
                        literals.append(piece)
                if piece and kind == COMMENT:
                    if last_kind == COMMENT and last_end == from_:
                        comments[-1] += piece
                    else:
                        comments.append(piece)
                last_kind, last_end, pos = kind, to, to
                if b > end:
                    break
                k += 1
            if pos < end:
                plain = text[pos:end]
                code.append(plain)
                visible.append(plain)
                masked.append(plain)
            out.append(Line(raw, language, "".join(code), "".join(visible), "".join(masked), literals, "".join(c + " " for c in comments)))
        at = end + 1
        while k < len(found) and found[k][1] <= at - 1 and found[k][1] < at:
            k += 1
    return out, closed, after


def config_line(raw: str) -> Line:
    """A line of configuration, read on its own: a bare value after = is a literal, a leading export is dropped."""
    found = spans(raw, "config")[0]
    code, visible, masked, literals, comments, pos = [], [], [], [], [], 0
    for a, b, kind, opening in found:
        plain, piece = raw[pos:a], raw[a:b]
        code += [plain, _steps(piece, kind, opening)]
        visible += [plain, piece if kind == STRING else _blank(piece)]
        masked += [plain, _blank(piece)]
        (literals if kind == STRING else comments).append(piece)
        pos = b
    rest = raw[pos:]
    line = Line(raw, "config", "".join([*code, rest]), "".join([*visible, rest]), "".join([*masked, rest]), literals, "".join(c + " " for c in comments))
    left, equals, right = line.visible.partition("=")
    if equals:
        value = right.strip()
        if not line.literals and value and not re.search(r"\s", value):
            line.literals.append(value)
        if left.strip().startswith("export "):
            line.visible = re.sub(r"^(?:export )+", "", line.visible)
    return line
