"""Text functions as Spark columns: fingerprints, snippets, escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 180
#: Characters that a terminal must not get: controls, zero-width and bidirectional marks, byte-order mark.
_UNSAFE = r"[\p{Cc}​-‏ -‮⁠-⁩﻿]"


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def fingerprint(rule_id: Column, path: Column, line: Column, ordinal: Column) -> Column:
    """SHA-256 of rule, path and the line's digest; repeated lines add their ordinal."""
    base = F.sha2(F.concat_ws("\u0000", rule_id, path, F.sha2(line, 256)), 256)
    return F.when(ordinal == 0, base).otherwise(F.sha2(F.concat_ws("\u0000", base, ordinal.cast("string")), 256))


def snippet(line: Column) -> Column:
    """The trimmed line, cut at SNIPPET characters with an ellipsis, unsafe characters escaped."""
    trimmed = F.regexp_replace(line, r"^[\s ]+|[\s ]+$", "")
    cut = F.when(F.length(trimmed) > SNIPPET, F.concat(F.left(trimmed, F.lit(SNIPPET)), F.lit("…"))).otherwise(trimmed)
    return terminal_safe(cut)


def terminal_safe(text: Column) -> Column:
    """Unsafe characters as \\uXXXX."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){_UNSAFE}|[^\p{{Cc}}\u200B-\u200F\u2028-\u202E\u2060-\u2069\uFEFF]+"), F.lit(0))
    shown = F.transform(parts, lambda x: F.when(x.rlike(rf"^{_UNSAFE}$"), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(x))), 4, "0"))).otherwise(x))
    return F.when(text.rlike(_UNSAFE), F.array_join(shown, "")).otherwise(text)


def markdown(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for plain, entity in (("<", "&lt;"), (">", "&gt;"), ("|", "&#124;"), ("`", "&#96;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return F.regexp_replace(out, r"[\r\n]", " ")


def annotation(text: Column) -> Column:
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for plain, code in (("\r", "%0D"), ("\n", "%0A"), (":", "%3A"), (",", "%2C")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def uri(path: Column) -> Column:
    """Percent-encoding that keeps letters, digits and -._~/ ."""
    out = F.url_encode(path)
    for coded, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def case_id(finger: Column) -> Column:
    return F.concat(F.lit("CASE-"), F.upper(F.left(finger, F.lit(16))))


def suppressed(comments: Column, rule_id: Column, keyword: str) -> Column:
    """Whether a comment holds the keyword alone or with this rule in brackets."""
    found = F.regexp_extract_all(comments, F.lit(rf"(?<![\p{{IsAlphabetic}}\p{{N}}_]){keyword}(\[[^\]]*\])?(?=\s|\*/|$)"), F.lit(1))
    return F.exists(found, lambda x: (x == "") | (x == F.concat(F.lit("["), rule_id, F.lit("]"))))


def split_once(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first mark, and what behind it; null where there is none."""
    parts = F.split(text, re.escape(mark), 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def relative_path(path: Column) -> Column:
    """A path below the root with forward slashes; null for any other."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    bad = p.startswith("/") | p.contains(":") | F.array_contains(F.split(p, "/"), "..") | (p == "")
    return F.when(~bad, p)
