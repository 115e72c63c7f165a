"""Globs as regular expressions: `*` and `?` stay inside a path component, `**` crosses components at component borders."""

from __future__ import annotations

import re

from glintsieve.functions.predicates import quoted

_PART = re.compile(r"\*+|\[[^\]]*\]|\?|[^*\[?]+|\[")


def _body(pattern: str) -> str:
    out = []
    for m in _PART.finditer(pattern):
        part, end = m.group(), m.end()
        if part[0] == "*":
            crosses = len(part) >= 2 and (m.start() == 0 or pattern[m.start() - 1] == "/") and (end == len(pattern) or pattern[end] == "/")
            if crosses and end < len(pattern):  # any number of whole components, their slash included
                return "".join(out) + "(?:.*/)?" + _body(pattern[end + 1 :])
            out.append(".*" if crosses else "[^/]*")
        elif part == "?":
            out.append("[^/]")
        elif part[0] == "[" and len(part) > 1:
            negated = part[1:2] in ("!", "^")
            inner = re.sub(r"[\\\[\]^&]", lambda c: "\\" + c.group(), part[2 if negated else 1 : -1])
            out.append(f"[^/{inner}]" if negated else f"[{inner}]" if inner else "[^\\s\\S]")
        else:
            out.append(quoted(part))
    return "".join(out)


def to_regex(pattern: str) -> str:
    """An anchored pattern that Java, Python and RE2 read alike."""
    return rf"(?s)^{_body(pattern)}\z"


def matches(pattern: str, value: str) -> bool:
    return re.match(to_regex(pattern).replace(r"\z", r"\Z"), value) is not None
