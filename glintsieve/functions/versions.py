"""Versions as arrays of three numbers, and advisory ranges as a fold over their events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(version: Column) -> Column:
    """Up to three numbers, filled with zeros; null for any other syntax. Arrays compare number by number."""
    plain = F.regexp_replace(F.regexp_replace(version, "^v+", ""), r"(?s)\+.*$", "")
    parts = F.transform(F.split(plain, r"\.", -1), lambda p: F.when(p.rlike("^[0-9]{1,18}$"), p.try_cast("bigint")))
    ok = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(ok, F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), 3)), 1, 3))


#: Bits of each number in a version's key.
BITS = 20
#: The key of an end that is open.
OPEN = (1 << 62) - 1


def key(version: Column) -> Column:
    """A long that orders versions as their numbers do; null for other syntax and for numbers of more than BITS bits."""
    p = parsed(version)
    small = F.forall(p, lambda x: x < (1 << BITS))
    return F.when(small, F.shiftleft(p[0], 2 * BITS) + F.shiftleft(p[1], BITS) + p[2])


def intervals(events: Column) -> Column:
    """Inclusive (lo, hi) of version keys that the events of a range hold, in their order; null if an event has no key.

    An introduced event opens an interval (and replaces an open one), the next fixed, limit or last_affected event closes it; one
    that stays open has no end. Empty intervals have lo > hi."""
    end = lambda e: F.coalesce(e["fixed"], e["limit"])
    known = lambda e: F.when(e["introduced"].isNotNull(), (e["introduced"] == "0") | key(e["introduced"]).isNotNull()).when(end(e).isNotNull(), key(end(e)).isNotNull()).otherwise(key(e["last_affected"]).isNotNull())
    none = F.lit(None).cast("long")
    start = F.struct(none.alias("lo"), F.expr("cast(array() as array<struct<lo:long,hi:long>>)").alias("done"))

    def step(state: Column, e: Column) -> Column:
        opens = e["introduced"].isNotNull()
        hi = F.when(end(e).isNotNull(), key(end(e)) - 1).otherwise(key(e["last_affected"]))
        closed = F.concat(state["done"], F.array(F.struct(state["lo"].alias("lo"), hi.alias("hi"))))
        lo = F.when(opens, F.when(e["introduced"] == "0", F.lit(0).cast("long")).otherwise(key(e["introduced"]))).otherwise(none)
        return F.struct(lo.alias("lo"), F.when(~opens & state["lo"].isNotNull(), closed).otherwise(state["done"]).alias("done"))

    folded = F.aggregate(events, start, step, lambda s: F.when(s["lo"].isNotNull(), F.concat(s["done"], F.array(F.struct(s["lo"].alias("lo"), F.lit(OPEN).cast("long").alias("hi"))))).otherwise(s["done"]))
    return F.when(F.forall(events, lambda e: F.coalesce(known(e), F.lit(False))), folded)


def readable(events: Column) -> Column:
    """Whether the versions of all events can be read."""
    value = lambda e: F.coalesce(e["introduced"], e["fixed"], e["limit"], e["last_affected"])
    return F.forall(events, lambda e: F.coalesce((value(e) == "0") | parsed(value(e)).isNotNull(), F.lit(False)))


def in_ranges(version: Column, events: Column) -> Column:
    """Whether a version is in a range of events (introduced, fixed, limit, last_affected) in their order; null for unknown syntax."""
    current = parsed(version)
    start = F.struct(F.lit(False).alias("active"), F.lit(False).alias("hit"), F.lit(True).alias("known"))

    def step(state: Column, e: Column) -> Column:
        end = F.coalesce(e["fixed"], e["limit"])
        begun = (e["introduced"] == "0") | (current >= parsed(e["introduced"]))
        before, until = current < parsed(end), current <= parsed(e["last_affected"])
        active = F.when(e["introduced"].isNotNull(), F.coalesce(begun, F.lit(False))).otherwise(F.lit(False))
        hit = state["hit"] | F.when(e["introduced"].isNotNull(), F.lit(False)).when(end.isNotNull(), state["active"] & F.coalesce(before, F.lit(False))).otherwise(state["active"] & F.coalesce(until, F.lit(False)))
        known = state["known"] & F.when(e["introduced"].isNotNull(), begun.isNotNull()).when(end.isNotNull(), before.isNotNull()).otherwise(until.isNotNull())
        return F.struct(active.alias("active"), hit.alias("hit"), known.alias("known"))

    done = F.aggregate(events, start, step)
    return F.when(current.isNotNull() & done["known"], done["hit"] | done["active"])
