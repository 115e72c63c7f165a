"""Operator 7: token ids in binary files of directly addressable codes.

A file holds the ids of a run of documents in ascending doc_id order. Each id is split into chunks of 8 bits. Level 0
holds the low chunk of every id; level k + 1 holds the next chunk of those ids that need it, which a continuation bitmap
at level k marks. A rank directory (number of set bits before every 512th bit) leads from a position at a level to
its position at the next, so any id is read with one step a level and no block is decoded.

File (little-endian): magic `DAC1`, uint32 number of documents, uint64 number of ids, uint32 number of levels; doc_ids
(int64; null: the smallest int64), ends of the documents (uint64); then for each level uint64 length, its bytes, its bitmap
(uint64 words, one spare) and its rank directory (uint64 each). The last level has no bitmap.

Defined results: a null or empty text has only the end id; the string of a special token is that token, as the library has it; rows with
equal doc_id are separate documents in the order of their texts' hashes and texts, those with a null doc_id come first; other columns are ignored. An empty table gives no file and no row. Spark sorts the
documents into ranges, each task writes files of at most FILE_IDS ids (a document is never cut) under names of its
own, and the table of files that it returns names only what a successful task has written.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm.common import by_size, fresh_path, lean, local_file, only, table, text_buffer, wide, written
from glintsieve.llm.pretoken import cuts, strung
from glintsieve.operators import prefix

MAGIC = b"DAC1"
FILE_IDS = 4_000_000
BLOCK = 512
CACHE_ENTRIES = 600_000
#: Pieces that are encoded in one string, and bytes of the longest that is kept.
STRUNG = 400
LONGEST = 64
_NULL_ID = -(1 << 63)


# --- the format ----------------------------------------------------------------------------------


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes."""
    ends = np.cumsum(counts, dtype=np.uint64)
    parts, rest = [], ids.astype(np.uint32)
    levels = 0
    while levels == 0 or len(rest):
        more = rest > 255
        last = not more.any()
        parts.append(np.array([len(rest)], "<u8").tobytes())
        parts.append((rest & 255).astype(np.uint8).tobytes())
        if last:
            levels += 1
            break
        words = np.zeros((len(rest) + 63) // 64 * 8 + 8, np.uint8)
        bits = np.packbits(more, bitorder="little")
        words[: len(bits)] = bits
        words = words.view("<u8")
        ranks = np.zeros(len(rest) // BLOCK + 1, "<u8")
        np.cumsum(np.bitwise_count(words[: len(ranks) * 8 - 8]).reshape(-1, 8).sum(axis=1), out=ranks[1:])
        parts += [words.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
        levels += 1
    head = MAGIC + np.array([len(doc_ids)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes() + np.array([levels], "<u4").tobytes()
    return b"".join([head, doc_ids.astype("<i8").tobytes(), ends.astype("<u8").tobytes(), *parts])


class Reader:
    """Reads a file's bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_ids, levels = int(np.frombuffer(data, "<u4", 1, 4)[0]), int(np.frombuffer(data, "<u8", 1, 8)[0]), int(np.frombuffer(data, "<u4", 1, 16)[0])
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.ends = take("<i8", docs), take("<u8", docs)
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        for k in range(levels):
            n = int(take("<u8", 1)[0])
            low = take("u1", n)
            self.levels.append((low, None, None) if k == levels - 1 else (low, take("<u8", (n + 63) // 64 + 1), take("<u8", n // BLOCK + 1)))

    def __getitem__(self, position: int) -> int:
        """One id, by rank steps through the levels."""
        if not 0 <= position < self.n_ids:
            raise IndexError(position)
        value, shift = 0, 0
        for low, words, ranks in self.levels:
            value |= int(low[position]) << shift
            if words is None or not int(words[position >> 6]) >> (position & 63) & 1:
                break
            block = position // BLOCK
            first = block * (BLOCK // 64)
            rank = int(ranks[block]) + int(np.bitwise_count(words[first : position >> 6]).sum())
            position = rank + (int(words[position >> 6]) & (1 << (position & 63)) - 1).bit_count()
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n_ids, np.uint32)
        at, shift = None, 0
        for low, words, _ in self.levels:
            if at is None:
                out[:] = low
            else:
                out[at] |= low.astype(np.uint32) << np.uint32(shift)
            if words is not None:
                more = np.unpackbits(words.view(np.uint8), count=len(low), bitorder="little").astype(bool)
                at = np.flatnonzero(more) if at is None else at[more]
            shift += 8
        return out


# --- encoding ------------------------------------------------------------------------------------


class Encoder:
    """Ids of texts as the tokenizers library gives them; pieces of texts are encoded once and kept.

    Texts are cut into pieces by numpy where a pre-token always begins, equal pieces are found by dictionary encoding, and
    the ids of all pieces of a batch are gathered from one pool. Texts with a special token's string are one piece.
    """

    def __init__(self, path: str, most: int = CACHE_ENTRIES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a token's string has one character a byte
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)
        self.known, self.again = pa.array([], pa.string()), np.zeros(0, bool)
        self.pool, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces that came again since the last time, no more than half of what may be kept."""
        kept = np.flatnonzero(self.again)[: self.most // 2]
        self.known = self.known.take(pa.array(kept))
        self.again = np.zeros(len(kept), bool)
        self.pool = self._gathered(kept)
        self.lengths = self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _gathered(self, place: np.ndarray) -> np.ndarray:
        """The ids at some places of the pool, one after the other."""
        lengths = self.lengths[place]
        ends = np.cumsum(lengths)
        small = np.int32 if max(len(self.pool), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
        from_pool = np.repeat((self.starts[place] - (ends - lengths)).astype(small), lengths)
        from_pool += np.arange(len(from_pool), dtype=small)
        return self.pool[from_pool]

    def _put(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, ids])

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and their numbers."""
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, pieces: pa.Array, between: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and their numbers, with those of `between` (a byte or none), which follows each.

        Pieces strung together are cut just there, so that many are encoded in one call; the bytes of the tokens tell where.
        """
        offsets, data = text_buffer(pieces)
        if between:
            data = np.insert(data, offsets[1:], between[0])
            offsets = offsets + np.arange(len(offsets))
        bounds = [*offsets[:-1:STRUNG].tolist(), len(data)]
        ids, _ = self._encoded([data[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])])
        last = np.searchsorted(np.cumsum(self.sizes[ids]), offsets[1:]) + 1
        return ids, np.diff(last, prepend=0)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, int]:
        """Puts distinct pieces into the pool; their order there, and how many of the first are to be kept."""
        offsets, data = text_buffer(pieces)
        spaced, bare = strung(offsets, data)
        for special in self.special:
            plain = ~pc.match_substring(pieces, special).to_numpy(zero_copy_only=False)
            spaced, bare = spaced & plain, bare & plain
        short = np.diff(offsets) <= LONGEST
        order = []
        for few in (short, ~short):
            groups = [np.flatnonzero(few & x) for x in (spaced, bare, ~spaced & ~bare)]
            spaced_few, bare_few, other_few = (pieces.take(pa.array(x)) for x in groups)
            if len(spaced_few):
                self._put(*self._joined(spaced_few, b""))
            if len(bare_few):
                ids, numbers = self._joined(bare_few, b"\n")
                breaks = np.zeros(len(ids), bool)
                breaks[np.cumsum(numbers) - 1] = True
                self._put(ids[~breaks], numbers - 1)
            if len(other_few):
                self._put(*self._encoded(other_few.to_pylist()))
            order += groups
        return np.concatenate(order), int(short.sum())

    def encode(self, column: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column (null: empty), with those of `end` after each, and their numbers by text."""
        offsets, data = text_buffer(column)
        begins = cuts(offsets, data)
        for special in self.special:
            for row in pc.indices_nonzero(pc.match_substring(column, special).fill_null(False)).to_pylist():
                begins[offsets[row] + 1 : offsets[row + 1]] = False
        at = np.flatnonzero(begins)
        first = np.searchsorted(at, offsets)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        if len(self.known) + len(pieces.dictionary) > self.most:
            self._forget()
        entry = pc.index_in(pieces.dictionary, value_set=self.known)
        new = pieces.dictionary.filter(pc.is_null(entry))
        entry = entry.fill_null(-1).to_numpy().astype(np.int64)
        self.again[entry[entry >= 0]] = True
        before = len(self.starts)
        order, keep = self._learn(new)
        absent = np.flatnonzero(entry < 0)
        entry[absent[order]] = before + np.arange(len(order))
        self._put(np.array(end, np.uint32), np.array([len(end)]))
        place = np.insert(entry[pieces.indices.to_numpy()], first[1:], len(self.starts) - 1)
        ids = self._gathered(place)
        ends = np.concatenate([[0], np.cumsum(self.lengths[place])])
        counts = np.diff(ends[np.concatenate([[0], first[1:] + np.arange(1, len(first))])])
        # long pieces and the end leave the pool
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order[:keep]))])
        self.again = np.concatenate([self.again, np.zeros(keep, bool)])
        self.starts, self.lengths = self.starts[: len(self.known)], self.lengths[: len(self.known)]
        self.pool = self.pool[: int(self.lengths.sum())]
        return ids, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- the jobs ------------------------------------------------------------------------------------


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the token files into a folder and returns the table of files: file, first_doc, first_key, task, seq, n_docs, n_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        filesystem, root = local_file(folder)
        task, seq, first_key = uuid.uuid4().hex, 0, 0
        held: list[np.ndarray] = []
        docs_held: list[int] = []
        counts: list[int] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, total
            name = f"{root}/{task}-{seq:05d}.dac"
            ids = np.concatenate(held)
            data = pack(np.array(docs_held, np.int64), np.array(counts, np.int64), ids)
            with filesystem.open_output_stream(name + ".tmp") as out:
                out.write(data)
            filesystem.move(name + ".tmp", name)
            row = {"file": [f"{folder}/{task}-{seq:05d}.dac"], "first_doc": [docs_held[0]], "first_key": [first_key], "task": [task], "seq": [seq], "n_docs": [len(docs_held)], "n_ids": [len(ids)]}
            seq, total = seq + 1, 0
            for x in (held, docs_held, counts):
                x.clear()
            return pa.RecordBatch.from_pydict(row, schema=_FILES)

        with lean():
            for whole in batches:
                for batch in by_size(whole, "text", 4 << 20):
                    ids, numbers = encode(batch.column("text"), [end_id])
                    at = 0
                    for doc, key, n in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), numbers.tolist()):
                        first_key = key if not docs_held else first_key
                        held.append(ids[at : at + n])
                        docs_held.append(_NULL_ID if doc is None else doc)
                        counts.append(n)
                        at, total = at + n, total + n
                        if total >= FILE_IDS:
                            yield flush()
        if docs_held:
            yield flush()

    filesystem, root = local_file(folder)
    filesystem.create_dir(root, recursive=True)
    keyed = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    ordered = keyed.repartitionByRange(4 * wide(docs.sparkSession), *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return ordered.mapInArrow(run, "file string, first_doc long, first_key long, task string, seq int, n_docs long, n_ids long")


_FILES = pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("first_key", pa.int64()), ("task", pa.string()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, out of the files.

    Files are ordered by first document, its key, task and number; what stands before each is a running total over ranges of files.
    """
    order = [F.col(x).asc() for x in ("first_doc", "first_key", "task", "seq")]
    placed = prefix.running(files, order, "n_ids", "upto").withColumn("base", F.col("upto") - F.col("n_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                filesystem, path = local_file(name)
                with filesystem.open_input_file(path) as file:
                    reader = Reader(file.read())
                ids = reader.all().astype("<u4")
                ends = reader.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                docs = pa.array(reader.doc_ids, pa.int64(), mask=reader.doc_ids == _NULL_ID)
                yield pa.RecordBatch.from_arrays([docs, pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("file", "base").repartition(2 * wide(files.sparkSession), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of every text of documents and reads them back."""
    files = write_files(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), default_tokenizer())
    return read_files(written(files, "token-files"))
