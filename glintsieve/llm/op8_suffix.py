"""Operator 8: repeated passages by sparse suffix arrays.

Of each text's word sequence (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) only the suffixes at content-selected
positions are kept: where the hash of the HEAD words that follow is the smallest of a window of MIN_WORDS - HEAD + 1
positions. Any MIN_WORDS words that two texts share select the same position in both.

1. Suffixes whose head another document has are seeds. Heads are dealt by head and a salt of the document first, so that most of a
   common head's rows are settled in many tasks; one row of each salt and the rest meet by head.
2. Each seed gets its context: the words after the head and, backwards, those before it, MIN_WORDS - HEAD of each. Equal contexts of a
   task are one row with its smallest and largest document, so a passage that many documents hold costs one row a task.
3. The contexts of a head are sorted by the words that follow (its part of the suffix array) and by those before. Lengths of the common
   prefixes of neighbours extend the match right and left: contexts whose neighbours agree in b words to the right and in a words to the
   left, with a + HEAD + b = MIN_WORDS, share a run of MIN_WORDS words. Every such a is tried, so no run is lost.
4. Runs that another document shares and that overlap or touch are joined into passages of maximal length.

A head with more than GROUP contexts is not sorted in one task: its runs are keyed by hash and counted by an aggregation instead.

Defined results: null, empty and short texts (under MIN_WORDS words) hold no passage; repetition inside one document is no repeat, unless
`within` is set, when it is one; rows with equal doc_id are one document, but passages are given for each of its texts (for equal ones once); a null doc_id
takes no part; other columns are ignored. Equality is that of 64-bit hashes of the words and of heads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintsieve.llm.common import by_size, mixed, only, table, text_buffer, wide, windows_of, words_of, written

MIN_WORDS = 50
HEAD = 25
SALTS = 16
#: Contexts of a head (400 bytes each) that one task sorts.
GROUP = 100_000


def selected(heads: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the (leftmost) smallest head of some `span` neighbouring ones; all are covered for shorter inputs."""
    n = len(heads)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= span:
        return np.array([int(np.argmin(heads))])
    windows = np.lib.stride_tricks.sliding_window_view(heads, span)
    return np.unique(np.argmin(windows, axis=1) + np.arange(len(windows)))


def suffixes(docs: DataFrame, min_words: int, head: int) -> DataFrame:
    """head, doc_id, key and word position of the kept suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text"):
                words, _, _, first = words_of(*text_buffer(batch.column("text")))
                row, heads, at = [], [], []
                for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    if b - a >= min_words:
                        own = windows_of(words[a:b], head)
                        places = selected(own, min_words - head + 1)
                        row.append(np.full(len(places), k))
                        heads.append(own[places].view(np.int64))
                        at.append(places.astype(np.int32))
                if row:
                    row = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), batch.column("doc_id").take(row), batch.column("key").take(row), pa.array(np.concatenate(at))], ["head", "doc_id", "key", "at"])

    return docs.mapInArrow(run, "head long, doc_id long, key long, at int")


def owner(within: bool) -> Column:
    """What has to differ for a repeat: the document, or the place too."""
    return F.xxhash64("doc_id", "key", "at") if within else F.col("doc_id")


def seeds_of(rows: DataFrame, within: bool) -> DataFrame:
    """key and at of the suffixes whose head a suffix of another owner has."""
    rows = rows.withColumn("owner", owner(within)).withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(SALTS)).cast("int"))
    by = Window.partitionBy("head", "salt")
    first = written(rows.withColumn("lo", F.min("owner").over(by)).withColumn("hi", F.max("owner").over(by)).select("head", "key", "at", "owner", (F.col("lo") != F.col("hi")).alias("settled")), "heads")
    settled = first.filter("settled").select("key", "at")
    # of a settled salt one row, for the others of its head
    marks = first.filter("settled").groupBy("head").agg(F.min("owner").alias("owner")).select("head", F.lit(None).cast("long").alias("key"), F.lit(None).cast("int").alias("at"), "owner")
    by = Window.partitionBy("head")
    rest = first.filter("not settled").select("head", "key", "at", "owner").unionByName(marks)
    rest = rest.withColumn("lo", F.min("owner").over(by)).withColumn("hi", F.max("owner").over(by)).withColumn("many", F.max(F.col("key").isNull()).over(by))
    # a mark stands for two owners, so its head is repeated whatever the others are
    return settled.unionByName(rest.filter("key is not null and (lo <> hi or many)").select("key", "at"))


def contexts_of(near: DataFrame, min_words: int, head: int, within: bool) -> DataFrame:
    """Of every seed ctx, doc_id, key and at, and of every context (once a slice) ctx, head, the words around it and the smallest and largest owner."""
    reach = min_words - head
    names = ["ctx", "doc_id", "key", "at", "head", "left", "right", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text"):
                words, _, _, first = words_of(*text_buffer(batch.column("text")))
                seeds = batch.column("seeds")
                lengths = np.diff(seeds.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), lengths)
                at = seeds.flatten().to_numpy().astype(np.int64)
                places, ends = first[row] + at, first[row + 1]
                span = np.arange(reach)
                n_left, n_right = np.minimum(at, reach), np.minimum(ends - places - head, reach)
                padded = np.concatenate([words, np.zeros(1, np.uint64)])
                left = np.where(span < n_left[:, None], padded[np.maximum(places[:, None] - 1 - span, 0)], 0)
                right = np.where(span < n_right[:, None], padded[np.minimum(places[:, None] + head + span, len(words))], 0)
                power = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, 2 * reach + 1, dtype=np.uint64)
                heads = windows_of(words, head)[places] if len(places) else np.zeros(0, np.uint64)
                ctx = mixed((np.concatenate([left, right], axis=1) * power).sum(axis=1, dtype=np.uint64) + mixed(heads + n_left.astype(np.uint64) * np.uint64(reach + 1) + n_right.astype(np.uint64))).view(np.int64)
                doc, key = (batch.column(c).take(pa.array(row)) for c in ("doc_id", "key"))
                n = len(ctx)
                yield pa.RecordBatch.from_arrays([pa.array(ctx), doc, key, pa.array(at.astype(np.int32)), *[pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())]], names)
                own = batch.column("owners").flatten().to_numpy() if within else doc.to_numpy()
                order = np.argsort(ctx, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(ctx[order]) != 0])) if n else np.zeros(0, np.int64)
                one = order[starts]
                if len(one):
                    lo, hi = (f.reduceat(own[order], starts) for f in (np.minimum, np.maximum))
                    around = [pa.array([x[: 8 * m] for x, m in zip(map(bytes, side[one]), number[one].tolist())], pa.binary()) for side, number in ((left, n_left), (right, n_right))]
                    m = len(one)
                    yield pa.RecordBatch.from_arrays([pa.array(ctx[one]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(heads[one].view(np.int64)), *around, pa.array(lo), pa.array(hi)], names)

    return near.mapInArrow(run, "ctx long, doc_id long, key long, at int, head long, left binary, right binary, lo long, hi long")


def prefix_runs(group: np.ndarray, sides: list[bytes], reach: int) -> np.ndarray:
    """For every length 0 to reach and each sequence of words, a number that those of its group with the same first words share (-1 if it is shorter).

    The sequences of all groups are sorted; neighbours of a group that agree in so many words are in one run.
    """
    keys = [k + x for k, x in zip(map(bytes, group.astype(">u8")[:, None].view("V8").ravel().tolist()), sides)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    lengths = np.fromiter(map(len, sides), np.int64, len(sides)) // 8
    words = np.zeros((len(sides), reach), np.uint64)
    words[np.arange(reach) < lengths[:, None]] = np.frombuffer(b"".join(sides), np.uint64)
    words, lengths, group = words[order], lengths[order], group[order]
    agree = (words[1:] == words[:-1]) & (np.arange(reach) < np.minimum(lengths[1:], lengths[:-1])[:, None])
    common = np.where(agree.all(axis=1), reach, np.argmin(agree, axis=1)) if reach else np.zeros(len(sides) - 1, np.int64)
    common = np.concatenate([[-1], np.where(group[1:] == group[:-1], common, -1)])  # the longest prefix shared with the one before
    out = np.zeros((reach + 1, len(sides)), np.int64)
    for length in range(reach + 1):
        out[length, order] = np.where(lengths >= length, np.cumsum(common < length), -1)
    return out


def shared_runs(group: np.ndarray, left: list[bytes], right: list[bytes], lo: np.ndarray, hi: np.ndarray, reach: int) -> np.ndarray:
    """Of each context of some heads a bit for every a: the run from a words before the head on is one of another owner, too."""
    before, after = prefix_runs(group, left, reach), prefix_runs(group, right, reach)
    out = np.zeros(len(left), np.int64)
    for a in range(reach + 1):
        x, y = before[a], after[reach - a]
        some = np.flatnonzero((x >= 0) & (y >= 0))
        if not len(some):
            continue
        both = x[some] * np.int64(len(left) + 2) + y[some]
        place = np.argsort(both)
        order, both = some[place], both[place]
        starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        repeated = np.minimum.reduceat(lo[order], starts) != np.maximum.reduceat(hi[order], starts)
        out[order[np.repeat(repeated, np.diff(np.append(starts, len(order))))]] |= 1 << a
    return out


def matched(contexts: DataFrame, reach: int, group: int) -> DataFrame:
    """ctx and mask of the contexts that share runs with other owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(data: pa.RecordBatch) -> pa.RecordBatch:
            head, ctx, lo, hi = (data.column(c).to_numpy() for c in ("head", "ctx", "lo", "hi"))
            group = np.cumsum(np.concatenate([[False], head[1:] != head[:-1]]))
            mask = shared_runs(group, data.column("left").to_pylist(), data.column("right").to_pylist(), lo, hi, reach)
            some = mask != 0
            return pa.RecordBatch.from_arrays([pa.array(ctx[some]), pa.array(mask[some])], ["ctx", "mask"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                head = batch.column("head").to_numpy()
                last = int(np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))[-1])  # the head from here may go on
                if last or head[0] != held[0].column("head")[0].as_py():
                    data = pa.concat_batches(held)
                    end = data.num_rows - (len(head) - last)
                    if end:
                        yield solved(data.slice(0, end))
                    held = [data.slice(end)]
        if held:
            yield solved(pa.concat_batches(held))

    spark = contexts.sparkSession
    sizes = written(contexts.groupBy("head").count().filter(F.col("count") > group).select("head"), "common-heads")
    plain = contexts
    if not sizes.isEmpty():
        plain = contexts.join(sizes, "head", "left_anti")
    dealt = plain.repartition(4 * wide(spark), "head").sortWithinPartitions("head", "right", "left")
    found = dealt.select("head", "ctx", "left", "right", "lo", "hi").mapInArrow(run, "ctx long, mask long").distinct()
    if sizes.isEmpty():
        return found
    large = contexts.join(sizes, "head").select("*", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("a"))
    large = large.filter((F.length("left") >= 8 * F.col("a")) & (F.length("right") >= 8 * (reach - F.col("a"))))
    around = F.xxhash64("head", "a", F.expr("substring(left, 1, 8 * a)"), F.expr(f"substring(right, 1, 8 * ({reach} - a))"))
    large = written(large.select("ctx", "a", "lo", "hi", around.alias("run")), "runs")
    repeated = large.groupBy("run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("run")
    return found.unionByName(large.join(repeated, "run", "left_semi").groupBy("ctx").agg(F.bit_or(F.expr("shiftleft(1L, a)")).alias("mask")))


def passages(docs: DataFrame, min_words: int = MIN_WORDS, head: int = HEAD, within: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, first_word and n_words of every maximal passage of at least min_words words that other documents hold run by run."""
    docs = only(docs, "doc_id", "text").filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    seeds = seeds_of(suffixes(docs, min_words, head), within).groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("seeds"))
    near = docs.join(written(seeds, "seeds"), "key")
    if within:
        near = near.withColumn("owners", F.transform("seeds", lambda at: F.xxhash64(F.col("doc_id"), F.col("key"), at)))
    found = written(contexts_of(near, min_words, head, within), "contexts")
    contexts = found.filter("head is not null").select("ctx", "head", "left", "right", "lo", "hi")
    masks = matched(contexts, min_words - head, group)
    members = found.filter("head is null").select("ctx", "doc_id", "key", "at").join(masks, "ctx").groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "mask")).alias("runs"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs that overlap or touch in a document make one passage."""
        shifts = np.arange(min_words - head + 1)
        for batch in batches:
            out = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), batch.column("runs")):
                at, mask = (own.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                starts = np.unique((at[:, None] - shifts)[(mask[:, None] >> shifts & 1) > 0])
                cut = np.flatnonzero(np.diff(starts) > min_words) + 1
                first, last = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])]
                out.append((np.full(len(first), doc), first, last - first + min_words))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["doc_id", "first_word", "n_words"])

    return members.select("doc_id", "runs").mapInArrow(join, "doc_id long, first_word long, n_words long")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that documents share."""
    return passages(table(spark, sf_dir, "documents"))
