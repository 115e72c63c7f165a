"""Lexing of large files by parts: one file is the work of many tasks.

Files are cut behind line ends. A token may be open where a part begins, so a part is a function from the token open before it to the one
open behind it. These functions are told for code first, and then for each token that an earlier part of the file leaves open, until no
new one comes; composing them in file order, a pass over rows of a few bytes, gives what is open before each part. Then all parts are lexed at once.

Defined results: the views of a file in parts are those of the whole file; a line is never cut, so a part is as long as its longest line at least; null
contents are empty files, which have no lines and are complete (a content is one row, so of 2 GB at most); files without a path or a language are left out; a path
names one file; other columns are ignored. Scripts of component files are taken out before the cut. Rounds are as many as tokens open one behind the other: one or two
in most files, up to the depth of comments left open in languages that nest them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintsieve.operators import lexer
from glintsieve.sinks.shared import written
from glintsieve.sources.components import script_source

#: Characters of a part, up to the next line end.
SIZE = 1 << 20

_PARTS = pa.schema([("path", pa.string()), ("language", pa.string()), ("part", pa.int32()), ("last", pa.bool_()), ("n_lines", pa.int32()), ("text", pa.string())])
_PARTS_SQL = "path string, language string, part int, last boolean, n_lines int, text string"
_OPEN = pa.struct([("how", pa.string()), ("mark", pa.string()), ("depth", pa.int32())])
_OPEN_SQL = "struct<how:string,mark:string,depth:int>"
_STEPS = pa.schema([("path", pa.string()), ("part", pa.int32()), ("last", pa.bool_()), ("n_lines", pa.int32()), ("before", _OPEN), ("after", _OPEN), ("closed", pa.bool_())])
_STEPS_SQL = f"path string, part int, last boolean, n_lines int, before {_OPEN_SQL}, after {_OPEN_SQL}, closed boolean"
_STARTS = pa.schema([("path", pa.string()), ("part", pa.int32()), ("first_line", pa.int64()), ("before", _OPEN), ("complete", pa.bool_())])
_STARTS_SQL = f"path string, part int, first_line long, before {_OPEN_SQL}, complete boolean"
_VIEWS = pa.schema([
    ("path", pa.string()), ("language", pa.string()), ("line", pa.int64()), ("text", pa.string()), ("code", pa.string()), ("visible", pa.string()), ("masked", pa.string()),
    ("literals", pa.list_(pa.string())), ("comments", pa.string()),
])
_VIEWS_SQL = "path string, language string, line long, text string, code string, visible string, masked string, literals array<string>, comments string"
#: Views of lines in one Arrow batch.
_ROWS = 20_000


def cut(text: str, size: int) -> Iterator[str]:
    """The text in parts of at least size characters, each up to a line end."""
    at = 0
    while at < len(text):
        end = text.find("\n", at + size - 1) + 1 or len(text)
        yield text[at:end]
        at = end


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)


def parts_of(files: DataFrame, size: int = SIZE) -> DataFrame:
    """The parts of files (path, language, content), an empty file as one empty part; written, as all later steps read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file's text at a time
                path, language, content = (batch.column(c)[k].as_py() for c in ("path", "language", "content"))
                content = content or ""
                script = script_source(path, content)
                own = list(cut(content if script is None else script, size)) or [""]
                for number, text in enumerate(own):
                    n_lines = text.count("\n") + (text != "" and not text.endswith("\n"))
                    yield _batch([(path, language, number, number == len(own) - 1, n_lines, text)], _PARTS)

    known = files.filter("path is not null and language is not null").select("path", "language", "content")
    return written(known.mapInArrow(run, _PARTS_SQL), "parts")


def _told(parts: DataFrame) -> DataFrame:
    """What each part leaves open, given what is open before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                path, language, part, last, n_lines, text, before = (batch.column(c)[k].as_py() for c in ("path", "language", "part", "last", "n_lines", "text", "before"))
                closed, after = lexer.ends(text, language, lexer.Open(**before) if before else None)
                rows.append((path, part, last, n_lines, before, after._asdict() if after else None, closed))
            yield _batch(rows, _STEPS)

    return parts.select("path", "language", "part", "last", "n_lines", "text", "before").mapInArrow(run, _STEPS_SQL)


def steps(parts: DataFrame) -> DataFrame:
    """path, part, last, n_lines, before, after and closed: the functions of all parts, for every token that may be open before them."""
    found = written(_told(parts.withColumn("before", F.lit(None).cast(_OPEN_SQL))), "steps")
    ends = found.filter("last").select("path", F.col("part").alias("end"))
    new = found
    while True:
        # a token is news to the parts behind the first one that leaves it open
        left = new.filter("after is not null and not last").groupBy("path", F.col("after").alias("before")).agg(F.min("part").alias("from"))
        known = found.filter("before is not null").groupBy("path", "before").agg(F.min("part").alias("known"))
        news = left.join(known, ["path", "before"], "left").join(ends, "path").withColumn("to", F.coalesce(F.col("known") - 1, F.col("end"))).filter("from < to")
        # a row a part, so that the parts of a file stay apart
        news = written(news.select("path", "before", F.explode(F.sequence(F.col("from") + 1, F.col("to"))).alias("part")), "open")
        if news.isEmpty():
            return found
        new = written(_told(parts.join(news, ["path", "part"])), "steps")
        found = found.unionByName(new)


def starts_of(told: DataFrame) -> DataFrame:
    """path, part, first_line, before and complete (null but for a file's last part) of each part: the steps of a file, taken one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, line, before, closed = None, -1, 1, None, True
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["path"] != at:
                    at, part, line, before, closed = x["path"], -1, 1, None, True
                if x["part"] == part + 1 and x["before"] == before:
                    closed = closed and x["closed"]
                    rows.append((at, x["part"], line, before, closed and x["after"] is None if x["last"] else None))
                    part, line, before = x["part"], line + x["n_lines"], x["after"]
            yield _batch(rows, _STARTS)

    # of a part the rows come together, one of them with the token that is open: it moves on to the next part
    dealt = told.repartition("path").sortWithinPartitions("path", "part")
    return written(dealt.mapInArrow(run, _STARTS_SQL), "starts")


def lexed(files: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """The views of all lines of files (path, language, content), and path and complete of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                path, language, text, first, before = (batch.column(c)[k].as_py() for c in ("path", "language", "text", "first_line", "before"))
                for number, x in enumerate(lexer.lex_part(text, language, lexer.Open(**before) if before else None)[0], first):
                    rows.append((path, language, number, x.text, x.code, x.visible, x.masked, x.literals, x.comments))
                    if len(rows) >= _ROWS:
                        yield _batch(rows, _VIEWS)
                        rows = []
        if rows:
            yield _batch(rows, _VIEWS)

    parts = parts_of(files, size)
    starts = starts_of(steps(parts))
    views = parts.join(starts, ["path", "part"]).select("path", "language", "text", "first_line", "before").mapInArrow(run, _VIEWS_SQL)
    return views, starts.filter("complete is not null").select("path", "complete")
