"""Component files: only their scripts are source; all other characters are blanked, so that lines and bytes stay in place."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.I | re.S)
_FRONTMATTER = re.compile(r"\A---[ \t]*\r?\n(.*?)^---[ \t]*\r?$", re.S | re.M)
SCRIPT_PATTERN = r"(?is)<script\b[^>]*>(.*?)</script\s*>"


def _blank(text: str) -> str:
    return re.sub(r"[^\n\r]", lambda m: " " * len(m.group().encode()), text)


def script_source(path: str, content: str) -> str | None:
    """The blanked source of a component file, None for other files."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("vue", "svelte", "astro"):
        return None
    kept = [m.span(1) for m in _SCRIPT.finditer(content)]
    if kind == "astro":
        kept = [m.span(1) for m in [_FRONTMATTER.match(content)] if m] + kept
    out, at = [], 0
    for a, b in sorted(kept):
        if a >= at:
            out += [_blank(content[at:a]), content[a:b]]
            at = b
    return "".join([*out, _blank(content[at:])])


def scripts(content: Column) -> Column:
    """The script bodies of a page, extracted only."""
    return F.regexp_extract_all(content, F.lit(SCRIPT_PATTERN), F.lit(1))
