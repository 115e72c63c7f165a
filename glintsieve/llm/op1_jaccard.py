"""Operator 1: n-gram Jaccard join with signature trees.

A text's set holds the hashes of its distinct shingles (5 words). Equal sets are one class. Two sets x and y link when
100 |x & y| >= 80 |x | y|. Signature trees find the links, in two rounds over groups of sets:

1. Classes and frequent shingles: one pass over the texts gives each document's set hash, size and token bitmap, and the counts
   of shingles that recur within a task. Shingles with a sum of FREQUENT or more (a bounded list: the bound doubles until it
   holds at most FREQUENT_MOST) are put last in the global order of shingles, the more frequent the later.
2. Groups of the first round: linked sets share one of their first |x| - ceil(0.8 |x|) + 1 shingles in any fixed global order. Sets are
   sorted by prefix shingle and size; a list is cut where sizes are too far apart, and lists of equal sets are one.
3. First round: of each list a tree is built in order of size and signature. Nodes hold the OR of their sets' token bitmaps, their size
   range and their least number of bits. A dual traversal of the tree with itself prunes node pairs with sizes apart, or whose
   greatest possible overlap is too small: each bit that a set has and the other node lacks is a shingle that is not shared.
   Sets of leaves that are left and may link by their own bitmaps are united; at most size - 1 unions of a group leave the task.
4. Groups of the second round: the components of those unions, each set in one of them, with its text.
5. Second round: the same trees over wider bitmaps; pairs that are left are verified on the full sets, but for those
   that are united already. Again at most size - 1 links leave the task. Components come from alternating stars.

Groups of more than BLOCK sets are cut into blocks by hash, each solved alone. What the blocks did not unite is
compared block by block afterwards, without pairs of blocks of one component; so a group of copies costs in
proportion to its size however large it is. No pair is dropped: only pairs known to be connected are skipped, which changes no component.

Defined results: null texts and texts without words have size 0 and link with nothing; rows with equal doc_id are each returned with
the smallest component_id of their sets; a null doc_id is returned with the smallest id linked with it (null if there is none); other columns
are ignored. Sets are compared by 64-bit hashes of shingles; a class is told by a 64-bit hash of its set and its size.
first_of_each keeps one row of each component: the one with the smallest doc_id (null is the largest), then the smallest hash of its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm import components
from glintsieve.llm.common import by_size, fresh_name, grams_of, mixed, only, table, text_buffer, wide, words_of, written

SHINGLE = 5
PERCENT = 80
#: Bits of a bitmap: twice the size at least, between these.
LEAST_BITS, MOST_BITS = 128, 32768
FREQUENT = 16
FREQUENT_MOST = 2_000_000
BLOCK = 8192
#: Bytes of texts that the second round holds of a group at most, before it counts as large.
BLOCK_BYTES = 32 << 20
#: Shingles of more sets than this are not sorted as one list.
HOT = 4 * BLOCK
#: Rows of keys that are broadcast at most: 24 MB.
BROADCAST_ROWS = 1_000_000
LEAF = 8
_U = np.uint64


def sets_of(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    words, _, _, first = words_of(*text_buffer(column))
    grams = grams_of(words, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            x = np.sort(grams[a : b - shingle + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:  # the whole sequence as one: hashed with its own words only
            out.append(grams_of(words[a:b], shingle)[:1] ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(x: np.ndarray) -> int:
    """A hash of a set, as a signed long."""
    total = mixed(np.array([mixed(x).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64))
    return int(total.view(np.int64)[0])


def width_of(n: int, spread: int = 2, most: int = MOST_BITS) -> int:
    """Bits of a set's bitmap, a power of two: spread bits a shingle at least, as long as that is no more than `most`."""
    return min(most, max(LEAST_BITS, 1 << (spread * n - 1).bit_length()))


def bitmap(x: np.ndarray, spread: int = 2, most: int = MOST_BITS) -> np.ndarray:
    """The set's bitmap as 64-bit words. A bit's place in a narrow map is that in a wide one modulo the width."""
    width = width_of(len(x), spread, most)
    bits = np.zeros(width, np.uint8)
    bits[(x >> _U(20)) & _U(width - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def linked(a: int, b: int, both: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The smallest overlap with which sets of these sizes link."""
    return -(-(percent * (a + b)) // (100 + percent))


# --- signature trees -----------------------------------------------------------------------------


class SignatureTree:
    """A tree over sets in a given order; a node of level 0 covers LEAF sets, one of a higher level two nodes.

    A node has the OR of its sets' bitmaps, the least and greatest size, and the least number of set bits.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray) -> None:
        self.maps, self.sizes = maps, sizes
        level = (maps, sizes, sizes, np.bitwise_count(maps).sum(axis=1, dtype=np.int64))
        self.levels = []
        step = LEAF
        while not self.levels or len(level[1]) > 1:
            starts = np.arange(0, len(level[1]), step)
            level = tuple(f.reduceat(x, starts) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.minimum), level))
            self.levels.append(level)
            step = 2

    def at(self, level: int) -> tuple:
        return self.levels[min(level, len(self.levels) - 1)]


def _prunable(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether node pairs hold no pair to look at: sizes are apart, or the greatest possible overlap is too small.

    A set of a has at least its least number of bits; those not in both ORs are shingles that no set of b has.
    """
    out = (a[2][i] * 100 < percent * b[1][j]) | (b[2][j] * 100 < percent * a[1][i])
    rest = np.flatnonzero(~out)
    step = max(1, (1 << 21) // a[0].shape[1])
    for at in range(0, len(rest), step):
        k = rest[at : at + step]
        common = np.bitwise_count(a[0][i[k]] & b[0][j[k]]).sum(axis=1, dtype=np.int64)
        for x, y, u, v in ((a, b, i[k], j[k]), (b, a, j[k], i[k])):
            missing = np.maximum(x[3][u] - common, 0)
            out[k] |= 100 * x[2][u] - percent * y[1][v] < (100 + percent) * missing
    return out


def leaf_pairs(tree: SignatureTree, other: SignatureTree | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold a link: of one tree with itself (each pair once), or of two trees, by dual traversal."""
    own = other is None
    other = tree if own else other
    i = j = np.zeros(1, np.int64)
    for level in range(max(len(tree.levels), len(other.levels)) - 1, -1, -1):
        a, b = tree.at(level), other.at(level)
        keep = ~_prunable(a, i, b, j, percent)
        i, j = i[keep], j[keep]
        if level:
            for_a, for_b = ((0, 1) if level < len(t.levels) else (None,) for t in (tree, other))
            i, j = (np.concatenate(x) for x in zip(*[(i if p is None else 2 * i + p, j if q is None else 2 * j + q) for p in for_a for q in for_b]))
            real = (i < len(tree.at(level - 1)[1])) & (j < len(other.at(level - 1)[1]))
            if own:
                real &= i <= j
            i, j = i[real], j[real]
    return i, j


def possible(maps_a: np.ndarray, sizes_a: np.ndarray, maps_b: np.ndarray, sizes_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of sets can link by their sizes and bitmaps."""
    only_a = np.bitwise_count(maps_a & ~maps_b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(maps_b & ~maps_a).sum(axis=-1, dtype=np.int64)
    return np.minimum(sizes_a - only_a, sizes_b - only_b) >= least_overlap(sizes_a, sizes_b, percent)


class Unions:
    """Components of the sets of a group, and the unions that made them."""

    def __init__(self, parts: np.ndarray) -> None:
        _, self.root = np.unique(parts, return_inverse=True)
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, x: int, y: int) -> None:
        p, q = self.root[x], self.root[y]
        if p != q:
            self.root[self.root == max(p, q)] = min(p, q)
            self.a.append(x)
            self.b.append(y)


def connect(maps: list[np.ndarray], sizes: np.ndarray, parts: np.ndarray, sides: np.ndarray | None = None, verify: Callable[[int, int], bool] | None = None, percent: int = PERCENT) -> tuple[list[int], list[int]]:
    """Unions that connect all sets of a group that link (with verify) or may link (without), but for those of one part already.

    sides: with 0 and 1, only pairs of a 0 and a 1 are compared. Sets are taken by the width of their bitmaps; those of
    one width are compared by one tree with itself, those of neighbouring widths by two trees. Sets of widths
    further apart do not link, unless the width is bounded.
    """
    found = Unions(parts)
    widths = np.array([len(m) for m in maps])
    trees: dict[tuple[int, int, int], tuple[np.ndarray, SignatureTree]] = {}

    def tree(width: int, to: int, side: int) -> tuple[np.ndarray, SignatureTree]:
        """The tree of the sets of a width, their bitmaps folded to another one."""
        if (width, to, side) not in trees:
            at = np.flatnonzero((widths == width) & ((sides == side) if sides is not None else True))
            m = np.stack([maps[k] for k in at.tolist()]) if len(at) else np.zeros((0, to), np.uint64)
            if to < width and len(at):
                m = np.bitwise_or.reduce(m.reshape(len(at), -1, to), axis=1)
            order = np.lexsort((m[:, 0], sizes[at])) if len(at) else at
            trees[width, to, side] = (at[order], SignatureTree(m[order], sizes[at][order]) if len(at) else None)
        return trees[width, to, side]

    def walk(first: tuple[np.ndarray, SignatureTree], second: tuple[np.ndarray, SignatureTree] | None) -> None:
        (p, x), (q, y) = first, second or first
        if x is None or y is None:
            return
        i, j = leaf_pairs(x, y if second else None, percent)
        order = np.argsort(np.abs(i - j), kind="stable")
        i, j = i[order], j[order]
        for at in range(0, len(i), 2048):
            k, m = i[at : at + 2048], j[at : at + 2048]
            ends = [(np.minimum.reduceat(r, s), np.maximum.reduceat(r, s)) for r, s in ((found.root[o], np.arange(0, len(o), LEAF)) for o in (p, q))]
            one = (ends[0][0][k] == ends[0][1][k]) & (ends[1][0][m] == ends[1][1][m]) & (ends[0][0][k] == ends[1][0][m])
            for u, v in zip(k[~one].tolist(), m[~one].tolist()):
                a, b = slice(u * LEAF, (u + 1) * LEAF), slice(v * LEAF, (v + 1) * LEAF)
                differ = found.root[p[a]][:, None] != found.root[q[b]][None, :]
                if second is None and u == v:
                    differ = np.triu(differ, 1)
                if differ.any():
                    differ &= possible(x.maps[a][:, None], x.sizes[a][:, None], y.maps[b][None], y.sizes[b][None], percent)
                for r, s in np.argwhere(differ).tolist():
                    r, s = int(p[u * LEAF + r]), int(q[v * LEAF + s])
                    if found.root[r] != found.root[s] and (verify is None or verify(r, s)):
                        found.add(r, s)

    present = np.unique(widths).tolist()
    for width in present:
        for to in (width, 2 * width):
            if to not in present:
                continue
            for side in (0,) if sides is None or to == width else (0, 1):
                if sides is None and to == width:
                    walk(tree(width, width, 0), None)
                else:
                    walk(tree(width, width, side), tree(to, width, side if sides is None else 1 - side))
    return found.a, found.b


def small_unions(starts: np.ndarray, maps: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may link, in groups of at most LEAF sets (trees of one leaf), for many groups at once."""
    lengths = np.diff(starts)
    a, b = [], []
    for m in range(2, LEAF + 1):
        at = starts[:-1][lengths == m]
        if len(at):
            x, y = np.triu_indices(m, 1)
            a.append((at[:, None] + x).ravel())
            b.append((at[:, None] + y).ravel())
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    near = (sizes[a] * 100 >= percent * sizes[b]) & (sizes[b] * 100 >= percent * sizes[a])
    a, b = a[near], b[near]
    widths = np.array([len(m) for m in maps])
    row = np.zeros(len(maps), np.int64)
    tables = {}
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        row[at] = np.arange(len(at))
        tables[width] = np.stack([maps[k] for k in at.tolist()])
    keep = np.zeros(len(a), bool)
    pair = widths[a] * (1 << 20) + widths[b]
    for kind in np.unique(pair).tolist():
        at = np.flatnonzero(pair == kind)
        wa, wb = kind >> 20, kind & (1 << 20) - 1
        to = min(wa, wb)
        for part in np.array_split(at, max(1, len(at) * to // (1 << 20))):
            x, y = (np.bitwise_or.reduce(tables[w][row[k[part]]].reshape(len(part), -1, to), axis=1) for w, k in ((wa, a), (wb, b)))
            keep[part] = possible(x, sizes[a[part]], y, sizes[b[part]], percent)
    return a[keep], b[keep]


# --- the passes ----------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, a hash of the text: rows with equal doc_id and key are repeats of each other."""
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))


def _first_pass(keyed: DataFrame) -> DataFrame:
    """doc_id, key, h, n and (once a set and task) sig of every document, and (with n null) the shingles that recur within a task as h with their count as c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        size = 0

        def recurring() -> pa.RecordBatch:
            nonlocal size
            x = np.sort(np.concatenate(held))
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            counts = np.diff(np.append(starts, len(x)))
            some = counts > 1
            held.clear()
            size = 0
            k = int(some.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(x[starts][some].view(np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(counts[some].astype(np.int64))], ["doc_id", "key", "h", "n", "sig", "c"])

        for whole in batches:
            for batch in by_size(whole, "text"):
                sets = sets_of(batch.column("text"))
                hashes = [set_hash(x) for x in sets]
                sigs: list[bytes | None] = []
                for h, x in zip(hashes, sets):
                    new = len(x) and (h, len(x)) not in seen
                    if new:
                        if len(seen) < 100_000:
                            seen.add((h, len(x)))
                        held.append(x)
                        size += len(x)
                    sigs.append(bitmap(x).tobytes() if new else None)
                n = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(hashes, pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(sigs, pa.binary()), pa.nulls(n, pa.int64())], ["doc_id", "key", "h", "n", "sig", "c"])
                if size > 3_000_000:
                    yield recurring()
        if held:
            yield recurring()

    return keyed.mapInArrow(run, "doc_id long, key long, h long, n int, sig binary, c long")


def _prefixes(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray, hot: bool = False) -> DataFrame:
    """token, h and n: each distinct set of a task with its prefix shingles, frequent ones last. Shingles of over HOT sets only with hot, the others only without."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, counts))
    most = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, how_often = shared.value
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in by_size(whole, "text"):
                tokens, hashes, sizes, lengths = [], [], [], []
                sets = sets_of(batch.column("text"))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                count = np.zeros(len(flat), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                    count = np.where(common[at] == flat, how_often[at], 0)
                end = 0
                for x in sets:
                    start, end = end, end + len(x)
                    if not len(x):
                        continue
                    h = set_hash(x)
                    if (h, len(x)) in seen:
                        continue
                    if len(seen) < 100_000:
                        seen.add((h, len(x)))
                    p, c = prefix_length(len(x)), count[start:end]
                    order = x[:p]
                    if c.any():
                        first = np.argsort(c, kind="stable")[:p]
                        order, c = x[first], c[first]
                        order = order[(c > most) == hot]
                    elif hot:
                        continue
                    tokens.append(order)
                    hashes.append(h)
                    sizes.append(len(x))
                    lengths.append(len(order))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(hashes, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int32), lengths))], ["token", "h", "n"])

    return only(docs, "text").mapInArrow(run, "token long, h long, n int")


def _lists(prefixes: DataFrame) -> DataFrame:
    """g, h and n: the sets of each shingle, cut where sizes are too far apart to link, without lists of one set.

    Rows come sorted by shingle, size and set and are read as a stream; a list is named by a hash of its sets, so that
    equal lists of several shingles become one. Lists of more than BLOCK sets are named by their shingle and first set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32))
        given: set[int] = set()
        going: tuple[int, int, int, int] | None = None  # shingle, last size and set, and name of a long list that was given in part

        def rows(names: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (names, h, n)], ["g", "h", "n"])

        def cuts(token: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (n[:-1] * np.int64(100) < PERCENT * n[1:].astype(np.int64))]))

        def whole_lists(token: np.ndarray, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(token):
                return
            starts = cuts(token, n)
            lengths = np.diff(np.append(starts, len(token)))
            names = mixed(np.add.reduceat(mixed(h.view(np.uint64)), starts) + lengths.astype(np.uint64)).view(np.int64)
            keep = lengths > 1
            for k in np.flatnonzero(keep).tolist():
                name = int(names[k])
                if name in given:
                    keep[k] = False
                elif len(given) < 100_000:
                    given.add(name)
            some = np.repeat(keep, lengths)
            if some.any():
                yield rows(np.repeat(names, lengths)[some], h[some], n[some])

        for batch in batches:
            token, h, n = (np.concatenate([t, batch.column(c).to_numpy()]) for t, c in zip(held, ("token", "h", "n")))
            if len(token):
                again = np.concatenate([[bool(going) and (token[0], h[0]) == (going[0], going[2])], (token[1:] == token[:-1]) & (h[1:] == h[:-1])])
                token, h, n = token[~again], h[~again], n[~again]
            if going and len(token):
                starts = cuts(token, n)
                end = int(starts[1]) if len(starts) > 1 else len(token)
                if token[0] == going[0] and going[1] * 100 >= PERCENT * int(n[0]):
                    yield rows(np.full(end, going[3]), h[:end], n[:end])
                    going = (going[0], int(n[end - 1]), int(h[end - 1]), going[3]) if end == len(token) else None
                    token, h, n = token[end:], h[end:], n[end:]
                else:
                    going = None
            if not len(token):
                held = (token, h, n)
                continue
            last = int(cuts(token, n)[-1])  # the list from here may go on
            yield from whole_lists(token[:last], h[:last], n[:last])
            token, h, n = token[last:], h[last:], n[last:]
            if len(token) > BLOCK:
                name = int(mixed(np.array([token[0], h[0]]).view(np.uint64).sum(keepdims=True)).view(np.int64)[0])
                yield rows(np.full(len(token), name), h, n)
                going = (int(token[0]), int(n[-1]), int(h[-1]), name)
                token, h, n = token[:0], h[:0], n[:0]
            held = (token, h, n)
        yield from whole_lists(*held)

    ordered = prefixes.repartition(4 * wide(prefixes.sparkSession), "token").sortWithinPartitions("token", "n", "h")
    return ordered.mapInArrow(run, "g long, h long, n int").dropDuplicates(["g", "h"])


def _solved(rows: DataFrame, texts: bool) -> DataFrame:
    """Unions a, b of the groups (g, i, j) of rows h, n, part, side (null: all with all) and data, which comes as bitmaps or as texts."""

    def of_texts(column: pa.Array, hashes: np.ndarray) -> list[np.ndarray]:
        sets = sets_of(column)
        return [x if set_hash(x) == h else x[:0] for x, h in zip(sets, hashes.tolist())]

    def of_maps(column: pa.Array) -> list[np.ndarray]:
        offsets, data = text_buffer(column)
        words, ends = np.ascontiguousarray(data).view(np.uint64), (offsets // 8).tolist()
        return [words[a:b] for a, b in zip(ends, ends[1:])]

    def one(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        h, n, part = (group.column(c).to_numpy() for c in ("h", "n", "part"))
        side = None if group.column("side").null_count else group.column("side").to_numpy()
        if texts:
            sets = [x for piece in by_size(group, "data") for x in of_texts(piece.column("data"), piece.column("h").to_numpy())]
            maps = [bitmap(x, 8, 8 * MOST_BITS) for x in sets]

            def verify(x: int, y: int) -> bool:
                p, q = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                return len(p) > 0 and linked(len(p), len(q), int((q[at] == p).sum()))

            a, b = connect(maps, np.array([len(x) for x in sets], np.int64), part, side, verify)
        else:
            a, b = connect(of_maps(group.column("data")), n.astype(np.int64), part, side)
        return h[np.array(a, np.int64)], h[np.array(b, np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(data: pa.RecordBatch, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            out = []
            lengths = np.diff(cuts)
            if not texts and (lengths <= LEAF).any():
                plain = data.column("side").null_count == data.num_rows
                small = np.flatnonzero(lengths <= LEAF) if plain else np.zeros(0, int)
                at = np.flatnonzero(np.repeat(lengths <= LEAF, lengths)) if plain else np.zeros(0, int)
                if len(at):
                    part = data.take(pa.array(at))
                    a, b = small_unions(np.concatenate([[0], np.cumsum(lengths[small])]), of_maps(part.column("data")), part.column("n").to_numpy().astype(np.int64))
                    h = part.column("h").to_numpy()
                    out.append((h[a], h[b]))
                    lengths = np.where(lengths <= LEAF, 0, lengths)
            out += [one(data.slice(cuts[k], int(lengths[k]))) for k in np.flatnonzero(lengths > 1).tolist()]
            if out and sum(len(x[0]) for x in out):
                a, b = components.forest_of(*(np.concatenate(x) for x in zip(*out)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def ends(data: pa.RecordBatch) -> list[int]:
            keys = [data.column(c).to_numpy() for c in ("g", "i", "j")]
            new = np.zeros(data.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            return [0, *np.flatnonzero(new).tolist(), data.num_rows]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if len(held) > 1 and all(batch.column(c)[-1] == held[0].column(c)[0] for c in ("g", "i", "j")):
                    continue  # still the same group
                data = pa.concat_batches(held)
                cuts = ends(data)
                yield from solved(data, cuts[:-1])
                held = [data.slice(cuts[-2])]
        if held:
            data = pa.concat_batches(held)
            yield from solved(data, ends(data))

    dealt = rows.repartition(4 * wide(rows.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.select("g", "i", "j", "h", "n", "part", "side", "data").mapInArrow(run, "a long, b long")


def _connected(groups: DataFrame, payload: DataFrame, texts: bool, block: int = BLOCK) -> DataFrame:
    """Unions a, b that connect the sets of groups (g, h, n) by the payload (h, data): bitmaps, or texts to be verified."""
    weight = F.lit(1.0) if not texts else F.greatest(F.lit(1.0), F.col("n") * (8.0 * block / BLOCK_BYTES))
    sizes = groups.groupBy("g").agg(F.sum(weight).alias("m")).filter(F.col("m") > block).select("g", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    sizes = written(sizes, "large")
    none = F.lit(None).cast("int")
    if sizes.isEmpty():
        plain = groups.select("g", "h", "n", F.lit(0).alias("i"), F.lit(0).alias("j"))
        return _solved(plain.join(payload, "h").select("*", F.col("h").alias("part"), none.alias("side")), texts)
    slot = F.pmod(F.xxhash64("h"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = groups.join(sizes, "g", "left").select("g", "h", "n", slot.alias("i"), slot.alias("j"))
    first = written(_solved(dealt.join(payload, "h").select("*", F.col("h").alias("part"), none.alias("side")), texts), "in-blocks")
    # large groups again: blocks of one part, or of small parts, against all others of other parts
    known = components.labels(first).select(F.col("node").alias("h"), F.col("label").alias("part"))
    rest = groups.join(sizes, "g").join(known, "h", "left").select("g", "h", "n", F.coalesce("part", "h").alias("part"))
    parts = rest.groupBy("g", "part").agg(F.sum(weight).alias("m"))
    alone = parts.filter(F.col("m") > block / 2).select("g", "part", F.ceil(2 * F.col("m") / block).cast("int").alias("own"))
    few = parts.join(alone, ["g", "part"], "left_anti").groupBy("g").agg(F.ceil(2 * F.sum("m") / block).cast("int").alias("shared"))
    rest = rest.join(alone, ["g", "part"], "left").join(few, "g", "left")
    name = F.when(F.col("own").isNotNull(), F.xxhash64("part", F.pmod(F.xxhash64("h"), F.col("own")))).otherwise(F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("part"), F.col("shared"))))
    rest = written(rest.select("g", "h", "n", "part", name.alias("block")), "rest")
    about = rest.groupBy("g", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("part").alias("p"), F.max("part").alias("q"))
    x, y = (about.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi", "p", "q")]) for s in "xy")
    differ = ~((F.col("p_x") == F.col("q_x")) & (F.col("p_y") == F.col("q_y")) & (F.col("p_x") == F.col("p_y")))
    near = (F.col("hi_x") * 100 >= F.col("lo_y") * PERCENT) & (F.col("hi_y") * 100 >= F.col("lo_x") * PERCENT)
    pairs = x.join(y, "g").filter((F.col("block_x") <= F.col("block_y")) & differ & near).select("g", F.col("block_x").alias("i"), F.col("block_y").alias("j"))
    sides = F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), none.alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))))
    wanted = pairs.select("g", "i", "j", sides.alias("s")).select("g", "i", "j", "s.block", "s.side")
    return first.unionByName(_solved(rest.join(wanted, ["g", "block"]).join(payload, "h").drop("block"), texts))


def components_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key, h, n) of documents, and each set's h, n and part, the name of its component."""
    keyed = _keyed(docs)
    first = written(_first_pass(keyed), "sets")
    rows = first.filter("n is not null").select("doc_id", "key", "h", "n")
    counts = first.filter("n is null").groupBy("h").agg(F.sum("c").alias("c"))
    bound = FREQUENT
    while (n_frequent := counts.filter(F.col("c") >= bound).limit(FREQUENT_MOST + 1).count()) > FREQUENT_MOST:
        bound *= 2
    found = sorted((r["h"] & (1 << 64) - 1, r["c"]) for r in counts.filter(F.col("c") >= bound).select("h", "c").toLocalIterator()) if n_frequent else []
    frequent, how_often = np.array([h for h, _ in found], np.uint64), np.array([c for _, c in found], np.int64)
    sets = first.filter("n > 0").groupBy("h", "n").agg(F.max("sig").alias("sig"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one"))
    sets = written(sets.select("h", "n", "sig", "one.doc_id", "one.key"), "classes")
    lists = _lists(_prefixes(docs, frequent, how_often))
    if (how_often > HOT).any():
        lists = lists.unionByName(_prefixes(docs, frequent, how_often, hot=True).dropDuplicates(["token", "h"]).withColumnRenamed("token", "g"))
    may = _connected(written(lists, "lists"), sets.select("h", F.col("sig").alias("data")), texts=False)
    near = written(components.labels(may).select(F.col("label").alias("g"), F.col("node").alias("h")).join(sets.select("h", "n", "doc_id", "key"), "h"), "near")
    wanted = near.select("h", "doc_id", "key")
    if near.count() <= BROADCAST_ROWS:  # three longs a row; beyond it both sides are shuffled
        wanted = F.broadcast(wanted)
    same = (keyed["key"] == wanted["key"]) & keyed["doc_id"].eqNullSafe(wanted["doc_id"])
    texts = keyed.join(wanted, same).select("h", "text").groupBy("h").agg(F.first("text").alias("data"))
    links = _connected(near.select("g", "h", "n"), texts, texts=True)
    label = components.labels(links).select(F.col("node").alias("h"), F.col("label").alias("part"))
    parts = sets.select("h", "n", "doc_id", "key").join(label, "h", "left").withColumn("part", F.coalesce("part", "h"))
    return rows, written(parts, "parts")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, parts = components_of(docs)
    least = parts.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    label = parts.join(least, "part").select("h", "n", "component_id")
    out = rows.join(label, ["h", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, and every row without words; all columns stay as they are."""
    rows, parts = components_of(docs)
    names = docs.columns
    own, key, keep = (fresh_name(docs, n) for n in ("id", "key", "keep"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")
    kept = parts.groupBy("part").agg(best).select("one.doc_id", "one.key")
    copies = written(rows.filter("n > 0").groupBy("doc_id", "key").count(), "copies")
    marked = copies.join(kept.withColumn("keep", F.lit(True)), (copies["doc_id"].eqNullSafe(kept["doc_id"])) & (copies["key"] == kept["key"]), "left").select(copies["doc_id"], copies["key"], "count", F.coalesce("keep", F.lit(False)).alias("keep"))
    marked = written(marked.filter("not keep or count > 1"), "marked")
    # the rows that go, and those of which one stays: three values a row, broadcast if they are few
    marked = marked.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("keep").alias(keep))
    few = marked.count() <= BROADCAST_ROWS
    on = lambda side: docs["doc_id"].cast("long").eqNullSafe(side[own]) & (F.xxhash64(docs["text"]) == side[key])
    side = F.broadcast(marked) if few else marked
    stay = docs.join(side, on(side), "left_anti")
    repeats = marked.filter(F.col(keep))
    if repeats.isEmpty():
        return stay
    side = F.broadcast(repeats) if few else repeats
    again = docs.join(side, on(side), "left_semi").withColumns({own: F.col("doc_id").cast("long"), key: F.xxhash64("text")}).dropDuplicates([own, key])
    return stay.unionByName(again.select(*[f"`{n}`" for n in names]))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by the similarity of their shingle sets."""
    return joined(table(spark, sf_dir, "documents"))


#: Pairs of documents by their shared shingles, then reachability: for the sizes that the oracle runs at.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x)
SELECT n.doc_id, n.n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n
"""
