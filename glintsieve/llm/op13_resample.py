"""Operator 13: importance resampling towards a target distribution, on hashed n-grams of chunks that overlap.

Texts are lower-cased (A-Z only) and cut into words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Features are all runs of 1 to 3 words, joined
by one space, in BUCKETS buckets by the crc32 of their bytes.

1. Chunks: a text of over CHUNK bytes is split at word boundaries. A chunk owns the starting positions of its own words and carries the
   next 2 words, so each feature is counted in the one chunk that owns its first word. Chunks of long texts are dealt anew, so one
   very long text is many tasks' work; short texts are one chunk each and stay where they are.
2. Bucket counts are summed in the task, then over all chunks of all texts, of source and target. The table of gains has BUCKETS numbers.
3. Weights and feature counts of chunks are summed by document; score is the weight plus Gumbel noise from a hash of the id.
4. The best are drawn by rank: rows are dealt by range of score, sorted, and counted by range, so no task sees all of them.

The crc32 of a run comes from those of its words: crc(a + b) = shift(crc(a), bytes of b) ^ crc(b), where shift is linear and looked up.

Defined results: null, empty and wordless texts have no features and weight 0; rows with equal doc_id are documents of their own, each with its own texts' weight
and the same noise; full ties (equal score and doc_id) get successive ranks in any order; a null doc_id has a null score and is never drawn, though its
features and, from MIN_WORDS words on, itself count; an empty target has T = 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm.common import by_size, only, table, text_buffer, wide, written
from glintsieve.operators import prefix

BUCKETS = 10_000
LONGEST = 3
CHUNK = 1 << 16
SLICE = 1 << 20
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: Words of up to so many bytes are shifted by table.
SHORT = 64

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _shifts() -> np.ndarray:
    """[n, k, v]: the remainder of byte k of value v of a crc32 when n zero bytes follow."""
    one = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)  # linear part of one step
    x = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [x]
    for _ in range(SHORT):
        x = one[x & np.uint32(255)] ^ (x >> np.uint32(8))
        out.append(x)
    return np.stack(out)


_SHIFT = _shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The linear part of crc32 after n (up to SHORT) more bytes."""
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= _SHIFT[n, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def shifted_far(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """shifted for any n: in steps of SHORT bytes."""
    out, left = crc.copy(), n.copy()
    while True:
        step = np.minimum(left, SHORT)
        out = shifted(out, step)
        left -= step
        some = np.flatnonzero(left)
        if not len(some):
            return out
        if len(some) < len(left):
            out[some] = shifted_far(out[some], left[some])
            return out


def word_places(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the first word of each text (n + 1)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    if n:
        first[1:] &= ~word[:-1] | edge[1:n]
        last[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def features(column: pa.Array, owned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature whose first word is among the first owned[row] words of the row's text (-1: all), and the words of each row."""
    offsets, data = text_buffer(column)
    data = _LOWER[data]
    starts, ends, first = word_places(offsets, data)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths)])
    flat = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)]
    kinds = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    each = [zlib.crc32(w) for w in kinds.dictionary.to_pylist()]
    index = kinds.indices.to_numpy()
    crc = np.array(each, np.uint32)[index] if len(each) else np.zeros(0, np.uint32)
    spaced = np.array([zlib.crc32(b" ", c) for c in each], np.uint32)[index] if len(each) else crc
    mine = np.arange(len(row)) - first[row] < np.where(owned < 0, n, owned)[row]
    rows, buckets = [row[mine]], [crc[mine] % BUCKETS]
    before = spaced  # the crc32 of the run so far and a space
    for k in range(1, LONGEST):
        m = len(row) - k
        if m <= 0:
            break
        inside = (row[:m] == row[k:]) & mine[:m]
        tail, size = crc[k:], lengths[k:]
        run = shifted_far(before[:m], size) ^ tail
        rows.append(row[:m][inside])
        buckets.append(run[inside] % BUCKETS)
        before = shifted_far(before[:m], size + 1) ^ spaced[k:]
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64), n


def pieces(text: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """Chunks of a text of about `most` bytes of words of their own, with the 2 next words, and the number of own words."""
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = word_places(np.array([0, len(data)]), data)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + most)))
        yield text[starts[at] : ends[min(to + LONGEST - 1, len(starts)) - 1]], to - at
        at = to


def chunks(docs: DataFrame, most: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and owned (-1) of the short texts, and doc_id, key, chunk, text and owned of the chunks of long ones, dealt anew."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "key", "chunk", "text", "owned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(doc, key, first: int, held: list) -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([t.decode() for t, _ in held]), pa.array([k for _, k in held], pa.int64())], names)

        for batch in batches:
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text")):
                held, number = [], 0
                for piece in pieces(text.as_py().encode(), most):
                    held.append(piece)
                    if len(held) * most >= SLICE:
                        yield rows(doc, key, number, held)
                        held, number = [], number + len(held)
                if held or not number:  # a long text without words is one chunk, too
                    yield rows(doc, key, number, held or [(b"", 0)])

    is_long = F.coalesce(F.octet_length("text") > most, F.lit(False))
    whole = docs.filter(~is_long).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(-1).cast("long").alias("owned"))
    split = docs.filter(is_long).select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, chunk long, text string, owned long")
    return whole, split.repartition(wide(docs.sparkSession), "doc_id", "key", "chunk")


def counts(docs: DataFrame, most: int = CHUNK) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for all_rows in batches:
            for batch in by_size(all_rows, "text", SLICE):
                _, bucket, _ = features(batch.column("text"), batch.column("owned").to_numpy())
                total += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    whole, split = chunks(docs, most)
    parts = whole.unionByName(split.select("doc_id", "text", "owned")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, most: int = CHUNK) -> DataFrame:
    """doc_id, n_features, n_words and weight of every row; those of a long text are the sums over its chunks."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # BUCKETS numbers

    def summed(texts: DataFrame, keep: list[str]) -> DataFrame:
        names = [*keep, "n_features", "n_words", "weight"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for all_rows in batches:
                for batch in by_size(all_rows, "text", SLICE):
                    owned, k = batch.column("owned").to_numpy(), batch.num_rows
                    row, bucket, n = features(batch.column("text"), owned)
                    weight = np.zeros(k, np.int64)
                    np.add.at(weight, row, shared.value[bucket])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, (np.bincount(row, minlength=k), np.where(owned < 0, n, owned), weight))], names)

        return texts.mapInArrow(run, ", ".join(f"{n} long" for n in names))

    whole, split = chunks(docs, most)
    # equal rows have equal chunks: their sums are those of one, as often as there are rows
    sums = [F.sum(c).alias(c) for c in ("n_features", "n_words", "weight")]
    by_text = summed(split, ["doc_id", "key", "chunk"]).groupBy("doc_id", "key").agg(*sums, F.count_if(F.col("chunk") == 0).alias("m"))
    each = by_text.select("doc_id", *[F.expr(f"{c} div m").alias(c) for c in ("n_features", "n_words", "weight")], F.explode(F.expr("sequence(1L, m)")))
    return summed(whole, ["doc_id"]).unionByName(each.drop("col"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, most: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; the drawn ones, percent of those with min_words words, have a rank."""
    gain = gains(counts(docs, most), counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most))
    rows = written(weighed(docs, gain, most).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    enough = F.col("n_words") >= min_words
    drawn = percent * rows.filter(enough).count() // 100
    eligible = enough & F.col("score").isNotNull()
    ranked = prefix.numbered(rows.filter(eligible), [F.col("score").desc(), F.col("doc_id").asc()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, with the benchmark's texts as target."""
    return resampled(only(table(spark, sf_dir, "documents"), "doc_id", "text"), only(table(spark, sf_dir, "benchmark"), "text"))
