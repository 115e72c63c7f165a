"""Operator 10: quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text, each group as shares of its own sum: words (WORDS hash buckets), sequences of three characters (BYTES buckets, over
UTF-8 bytes), pairs of adjacent character classes, and marks of repetition (a word equal to one of the last two
before it). Weighted term vectors (square roots of shares times inverse document frequency) of a bounded sample of
labelled rows give, by singular value decomposition, a latent space. The labelled vectors are broadcast; every
document is projected, its cosines with all labelled vectors come from exact blocked products, and its NEIGHBOURS
nearest ones vote for their labels with their similarity as weight.

The sample: TRAIN_ROWS labelled rows at most, those with the smallest hash of doc_id, never a held-out row (crc32 of
doc_id as text modulo 5 is 0). The broadcast is bounded by TRAIN_ROWS * DIMENSIONS numbers. Only the text is an input.

Defined results: null and empty texts, and texts without latent direction, score the share of label 1 in the sample (or 0.5 without any
labelled row); cosines count to five decimals, and labelled rows that tie with the last neighbour all vote; rows with equal doc_id score alike
for equal texts; texts of any length are counted whole; of several labels of one id the smallest counts, null labels and
labels of unknown ids are ignored; null doc_ids are not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm.common import by_size, only, table, text_buffer, words_of

TRAIN_ROWS = 4000
DIMENSIONS = 32
#: Chosen by four-fold cross-validation on the training rows alone.
NEIGHBOURS = 3
THRESHOLD = 0.3
FOLDS = 5

#: Characters by class; bytes of other alphabets count as lower-case letters.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\v\f", ".", ",", "!", "|", "*", "#", "$", "%", "&", "-_", "\"'`", "()[]{}<>", "?", ":;", "=+/\\@^~"]
_OTHER = len(_CLASSES)
N_CLASSES = _OTHER + 1
_CLASS = np.full(256, _OTHER, np.int32)
_CLASS[128:] = 0
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k
WORDS = BYTES = 512
N_PAIRS = N_CLASSES * N_CLASSES
N_TERMS = N_PAIRS + 2 + WORDS + BYTES
#: Weights of the groups of terms, chosen with NEIGHBOURS.
WEIGHTS = np.concatenate([np.full(N_PAIRS + 2, 1.0), np.full(WORDS, 0.6), np.full(BYTES, 0.6)]).astype(np.float32)


def counted(column: pa.Array) -> np.ndarray:
    """Weighted square roots of the shares of the terms, a row a text; zeros for an empty one."""
    offsets, data = text_buffer(column)
    n, lengths = len(offsets) - 1, np.diff(offsets)
    counts = np.zeros((n, N_TERMS), np.float32)

    def put(first: int, kinds: int, row: np.ndarray, kind: np.ndarray, total: np.ndarray) -> None:
        flat = np.bincount(row * np.int32(kinds) + kind, minlength=n * kinds)
        counts[:, first : first + kinds] = flat.reshape(n, kinds) / np.maximum(total, 1)[:, None]

    if len(data) > 1:
        kind = _CLASS[data]
        row = np.repeat(np.arange(n, dtype=np.int32), lengths)
        same = row[:-1] == row[1:]
        put(0, N_PAIRS, row[:-1][same], (kind[:-1] * N_CLASSES + kind[1:])[same], lengths - 1)
        words, _, _, first = words_of(offsets, data)
        per = np.diff(first)
        owner = np.repeat(np.arange(n, dtype=np.int32), per)
        for back in (1, 2):
            again = np.zeros(len(words), bool)
            again[back:] = (words[back:] == words[:-back]) & (owner[back:] == owner[:-back])
            counts[:, N_PAIRS - 1 + back] = np.bincount(owner[again], minlength=n) / np.maximum(per, 1)
        put(N_PAIRS + 2, WORDS, owner, ((words >> np.uint64(16)) % np.uint64(WORDS)).astype(np.int32), per)
        if len(data) > 2:
            x = data.astype(np.int32)
            three = (x[:-2] * 0x9E37 + x[1:-1] * 0x79B9 + x[2:] * 0x85EB) >> 5  # under 2**31
            same = row[:-2] == row[2:]
            put(N_PAIRS + 2 + WORDS, BYTES, row[:-2][same], three[same] % BYTES, lengths - 2)
    return np.sqrt(counts) * WEIGHTS


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray) -> None:
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = (terms > 0).sum(axis=0)
        self.idf = np.log((1 + len(terms)) / (1 + seen)).astype(np.float32) + 1
        weighted = terms * self.idf
        # right singular vectors, as eigenvectors of the terms' products
        self.axes = np.linalg.eigh(weighted.T.astype(np.float64) @ weighted)[1][:, ::-1][:, : min(DIMENSIONS, len(terms))].astype(np.float32)
        self.vectors, self.labels = self.latent(terms), labels.astype(np.float32)

    def latent(self, terms: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space, zeros where there is no direction."""
        x = (terms * self.idf) @ self.axes
        size = np.linalg.norm(x, axis=1, keepdims=True) if x.shape[1] else np.zeros((len(x), 1))
        return np.where(size > 1e-9, x / np.maximum(size, 1e-9), 0).astype(np.float32)

    def score(self, terms: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.full(len(terms), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(terms), block):
            x = self.latent(terms[at : at + block])
            cosine = x @ self.vectors.T
            cosine = np.round(cosine.astype(np.float64), 5)
            last = np.partition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            weight = np.where(cosine >= last, np.maximum(cosine, 0), 0)
            total = weight.sum(axis=1)
            vote = weight @ self.labels
            out[at : at + block] = np.where(total > 1e-9, np.minimum(vote / np.maximum(total, 1e-9), 1), self.prior)
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of at most `rows` labelled rows that are not held out; docs must not carry their labels."""
    known = only(labels, "doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # one text an id, so that the sample stays bounded where ids repeat
    texts = only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text"):
                terms = pa.array([x.tobytes() for x in counted(batch.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), terms], ["doc_id", "quality", "terms"])

    found = texts.mapInArrow(run, "doc_id long, quality int, terms binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("terms").alias("terms"))
    got = sorted(found.collect(), key=lambda r: r["doc_id"])
    terms = np.array([np.frombuffer(r["terms"], np.float32) for r in got], np.float32).reshape(len(got), N_TERMS)
    return Model(terms, np.array([r["quality"] for r in got], np.float32))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score in a column of its own; all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text"):
                for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(counted(part.column(at))))], [*names, name])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, `{name}` double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text of documents for quality, as labels.quality marks it."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    # the texts come back from the workers with the scores, but go no further
    out = scored(docs, model).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
