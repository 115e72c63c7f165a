"""Line differences by shortest edit script, as unified patches, and their application.

The script is found greedily, round by round of one edit more, over the furthest line that each diagonal reaches; equal ends are left
out before. Memory is that of the rounds, the square of the number of edits, so it suits repairs, which change few lines.

Defined results: equal texts have an empty patch; a text without a line feed at its end keeps that; a patch that does not fit is an error.
"""

from __future__ import annotations

import re

CONTEXT = 3
_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_NO_END = "\\ No newline at end of file"


def script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Shortest list of (kind, line of a, line of b): ' ' both, '-' only a, '+' only b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x_end, y_end = len(a) - tail, len(b) - tail
    rounds: list[dict[int, int]] = []
    reach = {1: head}
    done = None
    for edits in range(x_end + y_end - 2 * head + 1):
        rounds.append(dict(reach))
        for k in range(-edits, edits + 1, 2):
            down = k == -edits or (k != edits and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < x_end and x - k < y_end and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= x_end and x - k >= y_end:
                done = k
                break
        if done is not None:
            break
    out: list[tuple[str, int, int]] = []
    x, y = x_end, y_end
    for edits in range(len(rounds) - 1, -1, -1):
        before, k = rounds[edits], x - y
        down = k == -edits or (k != edits and before.get(k - 1, -1) < before.get(k + 1, -1))
        from_x = before[k + 1] if down else before[k - 1]
        from_y = from_x - (k + 1 if down else k - 1)
        while x > max(from_x, head) and y > max(from_y, head) and (edits == 0 or x > (from_x if down else from_x + 1)):
            x, y = x - 1, y - 1
            out.append((" ", x, y))
        if edits:
            if down:
                y -= 1
                out.append(("+", x, y))
            else:
                x -= 1
                out.append(("-", x, y))
    out.reverse()
    return [*((" ", k, k) for k in range(head)), *out, *((" ", x_end + k, y_end + k) for k in range(tail))]


def _lines(text: str) -> list[str]:
    return text.splitlines(True) if "\r" not in text and not re.search(r"[\x0b\x0c\x1c-\x1e\x85  ]", text) else [x for x in re.split(r"(?<=\n)", text) if x]


def unified(before: str, after: str, path: str, context: int = CONTEXT) -> str:
    """The patch from one text to the other."""
    a, b = _lines(before), _lines(after)
    steps = script(a, b)
    changed = [k for k, (kind, _, _) in enumerate(steps) if kind != " "]
    if not changed:
        return ""
    out = [f"--- {path}\n", f"+++ {path}\n"]
    groups: list[list[int]] = []
    for k in changed:
        if groups and k - groups[-1][1] <= 2 * context + 1:
            groups[-1][1] = k
        else:
            groups.append([k, k])
    for first, last in groups:
        part = steps[max(0, first - context) : last + context + 1]
        n_a, n_b = sum(kind != "+" for kind, _, _ in part), sum(kind != "-" for kind, _, _ in part)
        at_a, at_b = part[0][1] + (n_a > 0), part[0][2] + (n_b > 0)
        span = lambda at, n: f"{at}" if n == 1 else f"{at},{n}"
        out.append(f"@@ -{span(at_a, n_a)} +{span(at_b, n_b)} @@\n")
        for kind, x, y in part:
            line = b[y] if kind == "+" else a[x]
            out.append(kind + line if line.endswith("\n") else f"{kind}{line}\n{_NO_END}\n")
    return "".join(out)


def applied(before: str, patch: str) -> str:
    """The text that a patch makes of another."""
    a, out, at = _lines(before), [], 0
    rows = _lines(patch)[2:]
    for k, row in enumerate(rows):
        hunk = _HUNK.match(row)
        if hunk:
            start = int(hunk.group(1)) - (hunk.group(2) != "0")
            out += a[at:start]
            at = start
            continue
        if row.startswith("\\"):
            continue
        kind, line = row[0], row[1:]
        if k + 1 < len(rows) and rows[k + 1].startswith(_NO_END):
            line = line[:-1]
        if kind in " -":
            if at >= len(a) or a[at] != line:
                raise ValueError("the patch does not fit")
            at += 1
        if kind in " +":
            out.append(line)
    return "".join([*out, *a[at:]])
