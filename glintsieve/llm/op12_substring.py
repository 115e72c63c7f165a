"""Operator 12: substring dedup by super-k-mers.

A window is WINDOW consecutive words (`[^\\x20\\x09-\\x0D]+`, unchanged) of one text. A word goes if a window that covers it also starts
earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on the input.

1. The minimiser of a window is the (leftmost) smallest hash of MINIMISER words in it. Consecutive windows with one minimiser at one
   place are a super-k-mer. Equal windows have equal minimisers.
2. Minimisers are counted over all texts, by their upper halves. Super-k-mers of minimisers that occur once stay where they are: no window
   of theirs can be anywhere else.
3. The others travel, each as one packed string, every word followed by a space, to the bucket of the minimiser. Equal
   strings of a slice of texts travel once, for their earliest place; the later ones are repeats already.
4. A bucket sorts its windows by hash and place and compares the words of those that stand together: counts are exact, hashes only order.
   All windows of a run but the earliest are repeats, given as (key, at, mask): bit j is the window that starts at word at + j.
5. Repeats meet their texts by key, and covered words are taken out.

Hot minimisers: what recurs within a batch is known to recur, so it goes to the count as one number a batch. Windows of a minimiser
of more than `bucket` strings travel one by one, to a bucket of their own, and equal ones are combined over a whole task first: the rows of one
bucket are then at most those of its tasks. At most MOST_HOT minimisers can be hot (4 bytes each in the workers), as the bound grows with the strings / MOST_HOT.

Defined results: null and empty texts have no words, texts under WINDOW words lose none; kept words are joined by one space; rows with
equal doc_id are one document, whose texts come in the order of their hash; equal rows are one, each with the same result; a null doc_id comes before all others;
other columns stay as they are in `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm.common import by_size, fresh_name, only, table, text_buffer, wide, windows_of, words_of, written

WINDOW = 20
MINIMISER = 8
#: Packed strings of a minimiser that one task sorts.
BUCKET = 20_000
MOST_HOT = 1_000_000
SLICE = 1 << 20
_ROWS = "bucket long, packed binary, doc long, key long, at int, mask long"
_NAMES = ["bucket", "packed", "doc", "key", "at", "mask"]
_COUNTED = ["to", "slot", "key", "own", "n"]


def ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... of lengths[i] each, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one space, and where each begins (and the last ends)."""
    lengths = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(at[-1], 0x20, np.uint8)
    out[ragged(at[:-1], lengths - 1)] = data[ragged(starts, lengths - 1)]
    return out, at


def slices_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given (overlapping) parts of a buffer as a binary column."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ragged(starts, lengths)]))])


def cut(words: np.ndarray, first: np.ndarray, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every super-k-mer its text, the minimiser, its first word in the text, the number of its windows, and whether it holds the minimiser again."""
    rows, values, at, counts, again = [], [], [], [], []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a < window:
            continue
        hashes = windows_of(words[a:b], minimiser)
        places = np.lib.stride_tricks.sliding_window_view(hashes, window - minimiser + 1).argmin(axis=1)
        places += np.arange(len(places))
        begins = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        ends = np.append(begins[1:], len(places))
        order = np.argsort(hashes, kind="stable")
        following = np.full(len(hashes), len(hashes))  # the next place of the same hash
        same = hashes[order[1:]] == hashes[order[:-1]]
        following[order[:-1][same]] = order[1:][same]
        rows.append(np.full(len(begins), k))
        values.append(hashes[places[begins]])
        at.append(begins)
        counts.append(ends - begins)
        again.append(following[places[begins]] + minimiser <= ends - 1 + window)
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    return tuple(map(np.concatenate, (rows, values, at, counts, again)))


def slot(values: np.ndarray) -> np.ndarray:
    """The upper half of a minimiser, by which strings are counted."""
    return (values >> np.uint64(32)).astype(np.uint32).view(np.int32)


def minimisers(docs: DataFrame, window: int, minimiser: int) -> DataFrame:
    """The minimisers of each text: slot and key where it occurs once in its batch; for the others own and key, and slot and their number n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            found = []
            for batch in by_size(whole, "text", SLICE):
                words, _, _, first = words_of(*text_buffer(batch.column("text")), lower=False)
                row, value, _, _, again = cut(words, first, window, minimiser)
                found.append((slot(value), batch.column("key").to_numpy()[row], again))
            slots, keys, again = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool))
            kinds, place, number = np.unique(slots, return_inverse=True, return_counts=True)
            once = (number[place] == 1) & ~again
            n = int(once.sum())
            yield pa.RecordBatch.from_arrays([pa.array(slots[once].astype(np.int64)), pa.array(slots[once]), pa.array(keys[once]), pa.nulls(n, pa.int32()), pa.array(np.ones(n, np.int64))], _COUNTED)
            pairs = np.unique(np.stack([keys[~once], slots[~once].astype(np.int64)], axis=1), axis=0)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.nulls(n, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1].astype(np.int32)), pa.nulls(n, pa.int64())], _COUNTED)
            many = np.unique(place[~once])
            n = len(many)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[many].astype(np.int64)), pa.array(kinds[many]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(number[many])], _COUNTED)

    return docs.select("key", "text").mapInArrow(run, "to long, slot int, key long, own int, n long")


def recurring(docs: DataFrame, window: int, minimiser: int, bucket: int) -> DataFrame:
    """key and slot of the minimisers that occur more than once, and without key those of more than `bucket` strings with their number n; a written table."""
    names = ["key", "slot", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # slot, number and, while it is one, the key of the run that may go on

        def large(slots: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            some = total > bucket
            return pa.RecordBatch.from_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(slots[some]), pa.array(total[some])], names)

        for batch in batches:
            settled = batch.filter(batch.column("slot").is_null())
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([settled.column("key"), settled.column("own"), pa.nulls(settled.num_rows, pa.int64())], names)
            batch = batch.filter(batch.column("slot").is_valid())
            if not batch.num_rows:
                continue
            slots, n, keys = batch.column("slot").to_numpy(), batch.column("n").to_numpy(), batch.column("key")
            if held:
                slots, n = np.append(np.int32(held[0]), slots), np.append(held[1], n)
                keys = pa.concat_arrays([pa.array([held[2]], pa.int64()), keys])
            begins = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
            total = np.add.reduceat(n, begins)
            some = np.repeat(total > 1, np.diff(np.append(begins, len(slots)))) & keys.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(some)), pa.array(slots[some]), pa.nulls(int(some.sum()), pa.int64())], names)
            yield large(slots[begins[:-1]], total[:-1])
            held = (slots[-1], total[-1], keys[-1].as_py() if total[-1] == 1 else None)
        if held:
            yield large(np.array([held[0]], np.int32), np.array([held[1]]))

    dealt = minimisers(docs, window, minimiser).repartition(wide(docs.sparkSession), "to").sortWithinPartitions("slot")
    return _settled(dealt.select("slot", "key", "own", "n").mapInArrow(run, "key long, slot int, n long"), "recurring-minimisers")


def hot_slots(found: DataFrame, bucket: int) -> np.ndarray:
    """Sorted slots with more strings than a bucket holds; MOST_HOT at most."""
    counts = found.filter("key is null")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.sort(counts.filter(F.col("n") > max(bucket, total // MOST_HOT)).select("slot").toPandas()["slot"].to_numpy(np.int32))


class Strings:
    """Packed strings with their places; equal ones are combined."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, bucket: np.ndarray, packed: pa.Array, doc: np.ndarray, key: np.ndarray, at: np.ndarray, mask: np.ndarray) -> None:
        self.parts.append((bucket, packed, doc, key, at, mask))
        self.rows += len(doc)

    def combined(self) -> pa.RecordBatch | None:
        """Keeps the earliest place of each string; returns rows for the later ones, of which every window is a repeat."""
        if not self.rows:
            return None
        bucket, doc, key, at, mask = (np.concatenate([p[k] for p in self.parts]) for k in (0, 2, 3, 4, 5))
        packed = pa.concat_arrays([p[1] for p in self.parts])
        kind = packed.dictionary_encode().indices.to_numpy()
        order = np.lexsort((at, key, doc, kind))
        begins = np.concatenate([[True], kind[order][1:] != kind[order][:-1]])
        lead = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
        other = (doc[order] != doc[lead]) | (key[order] != key[lead]) | (at[order] != at[lead])
        one, later = np.sort(order[begins]), order[other]
        self.parts = [(bucket[one], packed.take(pa.array(one)), doc[one], key[one], at[one], mask[one])]
        self.rows = len(one)
        n = len(later)
        return pa.RecordBatch.from_arrays([pa.array(key[later]), pa.nulls(n, pa.binary()), *(pa.array(x[later]) for x in (doc, key, at, mask))], _NAMES) if n else None

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What is held, given away."""
        parts, self.parts, self.rows = self.parts, [], 0
        for bucket, packed, *rest in parts:
            yield pa.RecordBatch.from_arrays([pa.array(bucket), packed, *map(pa.array, rest)], _NAMES)


def super_kmers(docs: DataFrame, window: int, minimiser: int, hot: np.ndarray) -> DataFrame:
    """bucket, packed, doc, key, at and mask (of its windows) of the strings whose slots a row lists; packed is null where all windows are repeats."""
    context = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, single = context.value, Strings()

        def emitted(strings: Strings) -> Iterator[pa.RecordBatch]:
            repeats = strings.combined()
            if repeats is not None:
                yield repeats

        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                offsets, data = text_buffer(batch.column("text"))
                words, starts, ends, first = words_of(offsets, data, lower=False)
                row, value, at, count, _ = cut(words, first, window, minimiser)
                lists = batch.column("slots")
                wanted = (np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())) << 32) + lists.flatten().to_numpy()
                some = np.isin((row << 32) + slot(value), wanted)
                row, value, at, count = row[some], value[some], at[some], count[some]
                if not len(row):
                    continue
                data, places = spaced(data, starts, ends)
                doc, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
                split = np.isin(slot(value), slots)
                for strings, some in ((Strings(), ~split), (single, split)):
                    r, b, a, n = row[some], value[some].view(np.int64), at[some], count[some]
                    if strings is single:  # a window each, in a bucket of its own
                        r, a, n = np.repeat(r, n), ragged(a, n), np.ones(int(n.sum()), np.int64)
                        b = windows_of(words, window)[first[r] + a].view(np.int64) if len(r) else b
                    if not len(r):
                        continue
                    packed = slices_of(data, places[first[r] + a], places[first[r] + a + n + window - 1])
                    strings.add(b, packed, doc[r], key[r], a.astype(np.int32), (np.int64(1) << n) - 1)
                    if strings is not single:
                        yield from emitted(strings)
                        yield from strings.taken()
                    elif strings.rows > BUCKET:
                        yield from emitted(strings)
                        if strings.rows > BUCKET:
                            yield from strings.taken()
        yield from emitted(single)
        yield from single.taken()

    return docs.mapInArrow(run, _ROWS)


def judged(packed: pa.Array, doc: np.ndarray, key: np.ndarray, at: np.ndarray, window: int, hashes=windows_of) -> np.ndarray:
    """Of each string a mask of the windows that start earlier elsewhere, in other strings or in itself."""
    offsets, data = text_buffer(packed)
    words, starts, _, first = words_of(offsets, data, lower=False)
    counts = np.diff(first) - window + 1
    row, place = np.repeat(np.arange(len(counts)), counts), ragged(first[:-1], counts)
    offset = place - first[row]
    start = at[row] + offset
    by = hashes(words, window)[place]
    doc, key = doc[row], key[row]
    ids = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode().indices.to_numpy()

    def ordered(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((start, key, doc, by))
        begins = np.concatenate([[True], by[order][1:] != by[order][:-1]])
        return order, order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]

    order, lead = ordered(by)
    rest = np.flatnonzero(order != lead)
    same = np.ones(len(rest), bool)
    for j in range(window):
        same &= ids[place[order[rest]] + j] == ids[place[lead[rest]] + j]
    if not same.all():  # other words of one hash: those windows are told apart by their words
        mixed_up = np.flatnonzero(np.isin(by, by[order[rest[~same]]]))
        kinds = np.unique(ids[place[mixed_up][:, None] + np.arange(window)], axis=0, return_inverse=True)[1].ravel()
        by = np.unique(by, return_inverse=True)[1].astype(np.int64)
        by[mixed_up] = len(by) + kinds
        order, lead = ordered(by)
    other = (doc[order] != doc[lead]) | (key[order] != key[lead]) | (start[order] != start[lead])
    out = np.zeros(len(counts), np.int64)
    np.bitwise_or.at(out, row[order[other]], np.int64(1) << offset[order[other]])
    return out


def counted(strings: DataFrame, window: int, bucket: int) -> DataFrame:
    """key, at and mask of the repeated windows of every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Strings()

        def rows(key, at, mask) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), pa.array(mask)], ["key", "at", "mask"])

        def solved(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            packed = pa.concat_arrays([p[1] for p in parts])
            doc, key, at = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
            if len(packed):
                mask = judged(packed, doc, key, at, window)
                some = mask != 0
                yield rows(key[some], at[some], mask[some])

        for batch in batches:
            whole = batch.column("packed").is_null().to_numpy(zero_copy_only=False)
            done = batch.filter(pa.array(whole))
            if done.num_rows:
                yield rows(*(done.column(c).to_numpy() for c in ("key", "at", "mask")))
            batch = batch.filter(pa.array(~whole))
            if not batch.num_rows:
                continue
            number = batch.column("bucket").to_numpy()
            last = int(np.searchsorted(number, number[-1]))  # the bucket from here on may go on
            parts = lambda b: (b.column("bucket").to_numpy(), b.column("packed"), *(b.column(c).to_numpy() for c in _NAMES[2:]))
            if last or (held.rows and held.parts[-1][0][-1] != number[0]):
                yield from solved([*held.parts, parts(batch.slice(0, last))])
                held = Strings()
            held.add(*parts(batch.slice(last)))
            if held.rows > 2 * bucket:
                repeats = held.combined()
                if repeats is not None:
                    yield rows(*(repeats.column(c).to_numpy() for c in ("key", "at", "mask")))
        if held.rows:
            yield from solved(held.parts)

    dealt = strings.repartition(4 * wide(strings.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "key long, at int, mask long")


def _settled(df: DataFrame, label: str) -> DataFrame:
    """df written; shuffle files of the write, the largest of this operator, go when it is done."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return written(df, label)
    finally:
        conf.set(name, before)


def repeats(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket: int = BUCKET) -> DataFrame:
    """key, at and mask of the windows of doc, key and text that also start earlier; a written table."""
    if not 0 <= window - minimiser < 62:
        raise ValueError("a window holds a minimiser and at most 61 more words")
    found = recurring(docs, window, minimiser, bucket)
    slots = found.filter("key is not null").groupBy("key").agg(F.collect_set("slot").alias("slots"))
    strings = super_kmers(docs.join(slots, "key"), window, minimiser, hot_slots(found, bucket))
    return _settled(counted(strings, window, bucket), "repeated-windows")


def deduplicated(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, bucket: int = BUCKET, n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """All rows and columns, the kept words as the text, and the numbers of all and of removed words (replacing columns of these names)."""
    key, at, mask = (fresh_name(docs, x) for x in ("key", "at", "mask"))
    keyed = docs.withColumn(key, F.xxhash64(docs["doc_id"], docs["text"]))
    least = F.lit(-(1 << 63)).cast("long")
    narrow = keyed.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc"), F.col(key).alias("key"), "text").filter("text is not null")
    found = repeats(narrow, window, minimiser, bucket).groupBy("key").agg(F.collect_list("at").alias(at), F.collect_list("mask").alias(mask)).withColumnRenamed("key", key)
    joined = keyed.join(found, key, "left").drop(key)
    kept = [f for f in docs.schema.fields if f.name.lower() not in (n_words.lower(), n_removed.lower(), "text")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                offsets, data = text_buffer(batch.column("text"))
                _, starts, ends, first = words_of(offsets, data, lower=False)
                edge = np.zeros(len(starts) + 1, np.int64)
                lists = batch.column(at)
                lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
                lengths = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lengths)
                begin = first[np.repeat(np.arange(batch.num_rows), lengths)] + lists.flatten().to_numpy()
                bits = batch.column(mask).flatten().to_numpy()
                for j in range(window - minimiser + 1):
                    some = begin[bits >> j & 1 == 1] + j
                    np.add.at(edge, some, 1)
                    np.add.at(edge, some + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = np.concatenate([[0], np.cumsum(~gone)])[first]
                out, places = spaced(data, starts[~gone], ends[~gone])
                begins, stops = places[left[:-1]], places[left[1:]]
                text = slices_of(out, begins, np.maximum(stops - 1, begins)).cast(pa.string())
                total = np.diff(first)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), text, pa.array(total), pa.array(total - np.diff(left))], [*names, "text", n_words, n_removed])

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string", f"`{n_words}` long", f"`{n_removed}` long"])
    return joined.select(*names, "text", at, mask).mapInArrow(run, columns)


def op12_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and the digest of what is left of every document."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS s, words FROM d),
h AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS span FROM w),
r AS (SELECT doc_id, s FROM h QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM r),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM d),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.k) AS text FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
