"""Operator 2: byte-level BPE encoding and decoding with a segment tree.

Each pre-token is merged by a segment tree over its byte positions. A leaf holds the rank of the pair that begins
at a live position (position added, so that the leftmost of equal ranks is the minimum); an inner node holds the
minimum of its children. A merge changes the leaves of the merged position, of its live left neighbour and of the
absorbed position: three updates of O(log n), so a pre-token of n bytes takes O(n log n) however long it is.

Defined results: a null or empty text has 0 tokens and decodes to the empty string; repeated rows and ids give a row
each; a null doc_id stays null; other columns of the input are ignored. Pre-tokens recur, so their results are kept
in a bounded cache per worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm.common import by_size, lean, only, table
from glintsieve.llm.pretoken import chunks

#: Entries of the cache of a worker; beyond it is emptied. Bounds memory, changes no result.
CACHE_ENTRIES = 400_000
_NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    bits = n.bit_length()
    low = (1 << bits) - 1
    size = 1 << max(1, (n - 1).bit_length())
    tree = [_NONE] * (2 * size)
    part: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    while tree[1] != _NONE:
        i = tree[1] & low
        j = after[i]
        part[i] += part[j]
        part[j] = b""
        k = after[j]
        after[i] = k
        put(j, _NONE)
        if k < n:
            before[k] = i
            rank = get(part[i] + part[k])
            put(i, _NONE if rank is None else rank << bits | i)
        else:
            put(i, _NONE)
        h = before[i]
        if h >= 0:
            rank = get(part[h] + part[i])
            put(h, _NONE if rank is None else rank << bits | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i]])
        i = after[i]
    return out


class PairTable:
    """Ranks of pairs of ids, for looking up many at once."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.double = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none; an id of -1 pairs with nothing."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], -1)


def merge_many(pieces: list[bytes], pairs: PairTable, size: int) -> list[list[int]]:
    """merge() of many pre-tokens of 2 to `size` bytes at once, size a power of two: one segment tree a row, in step."""
    count = len(pieces)
    bits = size.bit_length()
    low = (1 << bits) - 1
    raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(count, size)
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    column = np.arange(size)
    ids = np.where(column < lengths[:, None], pairs.single[raw], -1)
    ids = np.concatenate([ids, np.full((count, 2), -1)], axis=1)  # past the end and before the start: no token
    after = np.tile(np.minimum(np.arange(1, size + 3), size), (count, 1))
    before = np.tile(np.arange(-1, size + 1), (count, 1))
    before[:, 0] = size + 1
    tree = np.full((count, 2 * size), _NONE, np.int64)
    row, at = np.nonzero(column + 1 < lengths[:, None])
    rank = pairs.double[raw[row, at].astype(np.int64) << 8 | raw[row, at + 1]]
    tree[row, size + at] = np.where(rank >= 0, rank << bits | at, _NONE)
    level = size
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        k = at + size
        tree[rows, k] = value
        for _ in range(bits - 1):
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        top = tree[rows, 1]
        i = top & low
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i] = top >> bits
        ids[rows, j] = -1
        after[rows, i] = k
        before[rows, k] = i
        put(rows, j, _NONE)
        rank = pairs.look(ids[rows, i], ids[rows, k])
        put(rows, i, np.where(rank >= 0, rank << bits | i, _NONE))
        h = before[rows, i]
        some = h < size
        rank = pairs.look(ids[rows[some], h[some]], ids[rows[some], i[some]])
        put(rows[some], h[some], np.where(rank >= 0, rank << bits | h[some], _NONE))
        rows = rows[tree[rows, 1] != _NONE]
    live = ids[:, :size] >= 0
    flat, ends = ids[:, :size][live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes texts with a rank file and a pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pairs = PairTable(self.ranks)
        #: Of pieces (pre-tokens, and chunks of some): ids in decimals joined by one space, and the bytes these decode to.
        self.written: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encodes and decodes pre-tokens that are not in the cache."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        done: list[tuple[str, list[int]]] = []
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                done.append((piece, [whole]))
            elif len(raw) > 64:
                done.append((piece, merge(raw, self.ranks)))
            else:
                classes.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for size, found in classes.items():
            for at in range(0, len(found), 1 << 11):
                part = found[at : at + (1 << 11)]
                done += zip([p for p, _ in part], merge_many([raw for _, raw in part], self.pairs, size))
        tokens, written, decoded = self.tokens, self.written, self.decoded
        for piece, ids in done:
            written[piece] = " ".join(map(str, ids))
            decoded[piece] = b"".join([tokens[i] for i in ids])

    def prepare(self, cut: list[list[str]], single: bool) -> None:
        """Brings all the pieces of some texts into the cache; single: each is one pre-token."""
        wanted = set().union(*cut) if cut else set()
        if len(self.written) + len(wanted.difference(self.written)) > CACHE_ENTRIES:
            self.forget()
        new = wanted.difference(self.written)
        if single:
            return self.learn(new)
        find, split = self.find, {c: None for c in new}
        for c in split:
            split[c] = find(c)
        self.learn({p for x in split.values() for p in x}.difference(self.written))
        written, decoded = self.written, self.decoded
        for c, x in split.items():
            if len(x) != 1:
                written[c] = " ".join([written[p] for p in x])
                decoded[c] = b"".join([decoded[p] for p in x])
        return None

    def forget(self) -> None:
        self.written.clear()
        self.decoded.clear()

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        cut = [self.find(t) for t in texts]
        self.prepare(cut, True)
        return [[int(i) for p in pieces for i in self.written[p].split(" ")] for pieces in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids in decimals and of the bytes that the ids decode to."""
        cut = [chunks(t) or self.find(t) if t else [] for t in texts]
        self.prepare(cut, False)
        out, written, decoded = [], self.written.__getitem__, self.decoded.__getitem__
        for x in cut:
            ids = " ".join(map(written, x))
            out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(map(decoded, x))).hexdigest()))
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        return self.digests([text])[0]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of this process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and tokens (array of ids) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        with lean():
            for whole in batches:
                for batch in by_size(whole, "text"):
                    ids = c.encode_many([t or "" for t in batch.column("text").to_pylist()])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, tokens array<int>")


def decode_table(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of every row of tokens; bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            texts = [c.decode(x or []).decode(errors="replace") for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return only(tokens, "doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def digest_table(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = (), release: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; keep: further columns to carry along; release: workers empty their caches after each task."""
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        with lean(c.forget if release else None):
            for whole in batches:
                for batch in by_size(whole, "text", 2 << 20):
                    got = c.digests([t or "" for t in batch.column("text").to_pylist()])
                    columns = [pa.array([x[k] for x in got], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    return only(docs, *dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern, of the vocabulary package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text of documents."""
    return digest_table(table(spark, sf_dir, "documents"), *default_vocabulary()).withColumn("doc_id", F.col("doc_id").cast("long"))
