"""Credential predicates as Spark columns: names, placeholders, provider shapes with checksums, assignments."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from glintsieve.functions.predicates import QUOTES, Predicate

#: Name segments of credentials (fixed values).
SECRET_NAMES = ["password", "passwd", "api_key", "apikey", "secret", "token"]
#: Values that are no credentials (fixed values).
PLACEHOLDERS = ["changeme", "password", "your-key-here", "example", "test", "test key", "secret_key", "dummy", "redacted"]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def snake_case(name: Column) -> Column:
    """camelCase as snake_case in lower case."""
    return F.lower(F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", "_"))


def secret_name(name: Column) -> Column:
    """Whether a name has a credential's segment."""
    snake = snake_case(name)
    segments = F.split(snake, r"[^\p{IsAlphabetic}\p{N}]")
    # names with an underscore of their own cannot be one segment, but the whole name may end with api_key
    return F.coalesce(F.arrays_overlap(segments, F.array(*[F.lit(n) for n in SECRET_NAMES])) | snake.endswith("api_key") | (snake == "service_role"), F.lit(False))


def placeholder(value: Column) -> Column:
    """Whether a value only stands for a credential."""
    low = F.lower(value)
    one = F.length(F.replace(value, F.left(value, F.lit(1)), F.lit(""))) == 0
    return low.isin(*PLACEHOLDERS) | low.startswith("<") | low.contains("${") | low.contains("{{") | one


def base62_value(digits: Column) -> Column:
    """The number that six base-62 digits state."""
    total = F.lit(0).cast("long")
    for k in range(1, 7):
        total = total * 62 + F.call_function("locate", F.substring(digits, k, 1), F.lit(BASE62)) - 1
    return total


def checksum_valid(value: Column) -> Column:
    """Tokens of a prefix, 30 characters and their CRC-32 in 6 base-62 digits."""
    body = F.regexp_extract(value, r"^(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})$", 1)
    last = F.regexp_extract(value, r"^(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})$", 2)
    return (body != "") & (F.crc32(body) == base62_value(last))


def provider(value: Column) -> Column:
    """Credentials that providers issue: cloud keys, payment keys, checksummed tokens, URLs with a password."""
    return value.rlike(r"^AKIA[0-9A-Z]{16}$") | value.rlike(r"^sk_live_[0-9A-Za-z]{24,}$") | value.rlike(r"^xox[abprs]-[0-9A-Za-z-]{20,}$") | value.rlike(r"^AIza[0-9A-Za-z_-]{35}$") | value.rlike(r"^[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@$<{]+@") | checksum_valid(value)


#: What provider shapes and private keys begin with or hold.
_SHAPES = re.compile(r"AKIA|sk_live_|xox|AIza|://|gh[pousr]_|npm_|-----BEGIN ")
LEAST_VALUE = 8


def may_assign(visible: str, literals: list[str]) -> bool:
    """Whether a line can assign a credential: a literal long enough, and a target for it or a shape of its own."""
    long = [x for x in literals if len(x) >= LEAST_VALUE or not x.isascii()]
    return bool(long) and ("=" in visible or ":" in visible or any(map(_SHAPES.search, long)))


def secret_assignment(visible: Column, literals: Column) -> Column:
    """Whether a line assigns a credential: a provider's shape, a named target with a literal of its own, or a private key header."""
    by_equals = F.instr(visible, "=") > 0
    left = F.when(by_equals, F.regexp_extract(visible, r"^([^=]*)=", 1)).otherwise(F.regexp_extract(visible, r"^([^:]*):", 1))
    right = F.when(by_equals, F.regexp_extract(visible, r"^[^=]*=\s*(.*)$", 1)).otherwise(F.regexp_extract(visible, r"^[^:]*:\s*(.*)$", 1))
    target = F.regexp_extract(left, r"(\S+)\s*$", 1)

    def one(raw: Column) -> Column:
        value = F.btrim(raw, F.lit(QUOTES))
        tail = F.substring(right, F.length(raw) + 1, F.length(right))
        named = secret_name(target) & right.startswith(raw) & tail.rlike(r"^\s*(?:$|[;,}])") & (F.octet_length(value) >= LEAST_VALUE) & ~placeholder(value)
        return provider(value) | named | (value.contains("-----BEGIN ") & value.contains("PRIVATE KEY-----"))

    return F.exists(literals, one)


@dataclass(frozen=True)
class SecretAssignment(Predicate):
    def column(self) -> Column:
        return secret_assignment(F.col("visible"), F.col("literals"))

    def words(self) -> set[tuple[str, str]]:
        return {("flag", "may_assign")}

    def test(self, line) -> bool:
        return assigns_secret(line.visible, line.literals)


# --- the same on Python strings, for the per-file pass ---------------------------------------------

_HUMP = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_SEGMENT = regex.compile(r"[^\p{Alphabetic}\p{N}]")
_PROVIDERS = re.compile(r"^(?:AKIA[0-9A-Z]{16}$|sk_live_[0-9A-Za-z]{24,}$|xox[abprs]-[0-9A-Za-z-]{20,}$|AIza[0-9A-Za-z_-]{35}$|[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@$<{]+@)", re.ASCII)
_CHECKSUMMED = re.compile(r"^(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})$")
_TARGET = re.compile(r"(\S+)\s*$", re.ASCII)
_ENDS = re.compile(r"\s*(?:$|[;,}])", re.ASCII)


def is_secret_name(name: str) -> bool:
    snake = _HUMP.sub("_", name).lower()
    return not set(SECRET_NAMES).isdisjoint(_SEGMENT.split(snake)) or snake.endswith("api_key") or snake == "service_role"


def is_placeholder(value: str) -> bool:
    low = value.lower()
    return low in PLACEHOLDERS or low.startswith("<") or "${" in low or "{{" in low or value.replace(value[:1], "") == "" if value else True


def is_provider(value: str) -> bool:
    m = _CHECKSUMMED.match(value)
    if m and zlib.crc32(m.group(1).encode()) == sum(BASE62.index(c) * 62 ** (5 - k) for k, c in enumerate(m.group(2))):
        return True
    return _PROVIDERS.match(value) is not None


def assigns_secret(visible: str, literals: list[str]) -> bool:
    """secret_assignment of a line."""
    sign = "=" if "=" in visible else ":"
    left, found, right = visible.partition(sign)
    right = right.lstrip(" \t\n\x0b\f\r")
    target = _TARGET.search(left) if found else None
    named = target is not None and is_secret_name(target.group(1))
    for raw in literals:
        value = raw.strip(QUOTES)
        if is_provider(value) or ("-----BEGIN " in value and "PRIVATE KEY-----" in value):
            return True
        if named and right.startswith(raw) and _ENDS.match(right, len(raw)) and len(value.encode()) >= LEAST_VALUE and not is_placeholder(value):
            return True
    return False
