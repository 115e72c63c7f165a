"""Operator 4: benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space runs become one space. An item of n characters has an error
budget of floor(RATE * n) edits and is split into budget + 1 pieces: a passage within the budget holds one piece
unchanged at least. An automaton finds all pieces in every whole text in one pass; around each hit Myers' bit-parallel
distance verifies that the item occurs within its budget (insertions, deletions and replacements of characters).

Items are handled in blocks of at most BLOCK_CHARS characters, each block a pass over the documents, so the patterns
that a worker holds are bounded however many items there are.

Defined results: null and empty texts hold no passage; empty items are ignored; equal items are separate items; rows with equal doc_id
are separate documents; a null id stays null; other columns are ignored by the search and kept by clean(). A row is an item's best occurrence in
a document: the least distance, then the first end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm.common import by_size, only, table

RATE = 0.08
BLOCK_CHARS = 4_000_000
_SPACES = re.compile(r"\s+")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return int(rate * len(item))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item in k + 1 pieces of nearly equal lengths, each with its offset."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    """For each character the bits of its positions in the item."""
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], length: int, text: str, most: int) -> tuple[int, int] | None:
    """Least distance of the pattern to a substring of text and the first end where it occurs, if at most `most`."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    pv, mv, score, best = full, 0, length, (most + 1, -1)
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[1] >= 0 else None


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if text:
                k = budget(text, rate)
                for offset, piece in pieces(text, k):
                    places.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, text, k, masks(text), masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), tuple(found)))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """item_id, start, end and distance of each item that occurs in a normalised text."""
        if not self.items:
            return []
        spots: dict[int, set[int]] = {}
        for end, (length, found) in self.automaton.iter(text):
            for number, offset in found:
                spots.setdefault(number, set()).add(end + 1 - length - offset)
        out = []
        for number, starts in spots.items():
            item_id, item, k, peq, back = self.items[number]
            best, reach = None, None
            for first in sorted(starts):
                a, b = max(0, first - k), first + len(item) + k
                if reach and a <= reach[1] - len(item) - k + 1 and b <= reach[1]:
                    continue  # inside the window before
                reach = (a, b)
                got = myers(peq, len(item), text[a:b], k)
                if got and (best is None or (got[0], a + got[1]) < best):
                    best = (got[0], a + got[1])
            if best:
                distance, end = best
                left = max(0, end - len(item) - k)
                length = myers(back, len(item), text[left:end][::-1], k)[1]
                out.append((item_id, end - length, end, distance))
        return out


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items that hold text, normalised, in blocks of about BLOCK_CHARS characters; one block is on the driver at a time."""
    items = only(benchmark, "item_id", "text").filter("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [(r["item_id"], normal(r["text"])) for r in part.toLocalIterator()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start_char, end_char (in the normalised text) and distance of every passage found."""
    out = None
    for block in blocks_of(benchmark):
        own = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(own.value, rate)
            for whole in batches:
                for batch in by_size(whole, "text"):
                    rows = [
                        (doc, *found)
                        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                        if text
                        for found in matcher.find(normal(text))
                    ]
                    if rows:
                        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(_FOUND.names)}, schema=_FOUND)

        found = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, start_char long, end_char long, distance int")
        out = found if out is None else out.unionByName(found)
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("distance", pa.int32())])


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows in whose text no item occurs, each judged for itself: a filter in the workers, block after block, without a join."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    at = docs.columns.index("text")
    for block in blocks_of(benchmark):
        own = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(own.value, rate)
            for whole in batches:
                for batch in by_size(whole, "text"):
                    yield batch.filter(pa.array([not (text and matcher.find(normal(text))) for text in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark in every whole text of documents."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
