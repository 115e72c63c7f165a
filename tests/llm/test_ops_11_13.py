"""Whitening, substring dedup and resampling against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from glintsieve.llm import op11_whiten, op12_substring, op13_resample

# --- whitening -----------------------------------------------------------------------------------


def brute_whitened(rows, components=16):
    """(vec_id, component) to (n, deviation, |whitened|, explained), by the full eigenproblem."""
    rows = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in rows), default=0)
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    values, vectors, trace = values[order], vectors[:, order], (z * z).sum() / n
    out = []
    for (k, _), v in zip(rows, x):
        off = [n * a - s for a, s in zip(v, sums)]
        for j in range(len(values)):
            if values[j] > 1e-10 * values[0]:
                out.append((k, j + 1, n, sum(o * o for o in off), abs(np.array(off) / n @ vectors[:, j]) / math.sqrt(values[j]), values[j] / trace))
    return out


def compared(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(r[4], 6))
    found = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found), key=key)
    wanted = sorted(wanted, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    assert np.allclose([r[4] for r in found], [r[4] for r in wanted], rtol=1e-7, atol=1e-9)
    assert np.allclose([r[5] for r in found], [r[5] for r in wanted], rtol=1e-9)


def vectors(d=24, n=150, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(k, (rng.standard_normal(d) * np.linspace(3, 0.2, d)).tolist()) for k in range(n)]
    rows += [(900 + k, rows[0][1]) for k in range(40)] + [(3, rows[3][1]), (None, rows[4][1]), (901, rows[5][1])]
    return rows + [(1000, None), (1001, [None] * d), (1002, [float("nan")] * d), (1003, [float("inf")] * d), (1004, rows[9][1][: d - 3]), (1005, [])]


@pytest.mark.parametrize("options", [{}, {"components": 4, "oversample": 2, "power": 40}, {"components": 4, "oversample": 1, "power": 1}, {"components": 40}])
def test_op11_brute(spark, options):
    rows = [(k, v, 1, 0.5, "x", 7) for k, v in vectors()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened double, x string, v int").repartition(3)
    found = op11_whiten.whitened(df, **options).collect()
    compared(found, brute_whitened(vectors(), options.get("components", 16)))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_op11_expands_where_residuals_fail(spark, monkeypatch):
    widths = []
    real = op11_whiten.multiplied
    monkeypatch.setattr(op11_whiten, "multiplied", lambda fit, n, sums, right, left=None: (widths.append(right.shape[1]), real(fit, n, sums, right, left))[1])
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    op11_whiten.whitened(df, components=3, oversample=1, power=2).count()
    assert widths == [4, 4, 4, 8, 16, 24, 3]
    widths.clear()
    flat = [(k, [float(k % 7), float(k % 5), 0.0, float(k % 3) / 4, 0.0, 0.0]) for k in range(105)]  # rank 3: found in a small basis
    found = op11_whiten.whitened(spark.createDataFrame(flat, "vec_id long, embedding array<double>"), components=2, oversample=2).collect()
    assert max(widths) == 4
    compared(found, brute_whitened(flat, 2))


def test_op11_degenerate(spark):
    schema = "vec_id long, embedding array<double>"
    assert op11_whiten.whitened(spark.createDataFrame([], schema)).count() == 0
    assert op11_whiten.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    assert op11_whiten.whitened(spark.createDataFrame([(1, []), (2, [])], schema)).count() == 0
    large = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])]
    found = op11_whiten.whitened(spark.createDataFrame(large, schema)).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in found)
    assert {r.deviation for r in found if r.vec_id == 1} == {None}  # beyond a long


def test_op11_table(spark):
    found = op11_whiten.op11_whiten(spark, SMALL).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    compared(found, brute_whitened(rows))


# --- substring dedup -----------------------------------------------------------------------------


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_kept(rows, window):
    """(id, words, removed, kept) of every row; rows is (id, text), ids not repeated."""
    first = {}
    for k, text in sorted(rows):
        w = words(text)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (k, s))
    out = set()
    for k, text in rows:
        w = words(text)
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] != (k, s) for p in range(s, s + window)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.add((k, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def passages():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["Größe", "日本", "W1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common, line = text(70), text(25)
    out = [None, "", " \t\n", "one two", text(19), text(20)]
    for k in range(40):
        parts = [text(rng.randrange(0, 60)), common if k % 2 else common[: 3 * k], text(rng.randrange(0, 9)), line, line if k % 5 == 0 else ""]
        out.append(rng.choice([" ", "\n", "  \t"]).join(parts))
    out += [out[7], out[7], out[8].upper(), "same " * 90, "same " * 50, "a b c " * 40, text(4000), out[10] + " " + out[10]]
    return out


def found_kept(df, **options):
    from pyspark.sql import functions as F

    out = op12_substring.deduplicated(df, **options).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
    return [tuple(r) for r in out.collect()]


@pytest.mark.parametrize("options", [{}, {"window": 7, "minimiser": 3}, {"window": 5, "minimiser": 5}, {"window": 20, "minimiser": 6, "bucket": 2}, {"window": 8, "minimiser": 1, "bucket": 1}])
def test_op12_brute(spark, options, monkeypatch):
    monkeypatch.setattr(op12_substring, "SLICE", 2000)  # many slices
    rows = list(enumerate(passages()))
    df = spark.createDataFrame([(k, t, 1, "y", 2, 3, 4, 5.0) for k, t in rows], "doc_id long, text string, key int, at string, mask int, n_words int, bucket int, _at double").repartition(3)
    found = found_kept(df, **options)
    assert len(found) == len(rows) and set(found) == brute_kept(rows, options.get("window", 20))


def test_op12_hot_bucket_of_one_window(spark, monkeypatch):
    monkeypatch.setattr(op12_substring, "BUCKET", 3)
    text = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"u{k} " * 3 + text + f" v{k}" * 25) for k in range(60)]
    found = found_kept(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), bucket=5)
    assert set(found) == brute_kept(rows, 20) and len(found) == 60


def test_op12_ids_and_columns(spark):
    text = " ".join(f"p{k}" for k in range(30))
    rows = [(5, text, "a"), (5, text, "a"), (None, text, "b"), (7, text + " q", "c"), (8, None, "d"), (9, "", "e")]
    out = op12_substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert out.columns == ["doc_id", "lang", "text", "n_words", "n_removed"]
    found = collections.Counter((r.doc_id, r.lang, r.text, r.n_words, r.n_removed) for r in out.collect())
    assert found == collections.Counter([(5, "a", "", 30, 30), (5, "a", "", 30, 30), (None, "b", text, 30, 0), (7, "c", "q", 31, 30), (8, "d", "", 0, 0), (9, "e", "", 0, 0)])
    assert op12_substring.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op12_words_of_one_hash_are_told_apart():
    """With a hash that is the same for all windows, counts stay exact."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) + " " for n in (9, 12, 30, 8)]
    doc, at = np.arange(4), np.zeros(4, np.int64)
    real = op12_substring.judged(pa.array([t.encode() for t in texts]), doc, doc, at, 4)
    same = op12_substring.judged(pa.array([t.encode() for t in texts]), doc, doc, at, 4, hashes=lambda w, n: np.zeros(len(w) - n + 1, np.uint64))
    assert real.tolist() == same.tolist() and real.any()


# --- resampling ----------------------------------------------------------------------------------

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resampled(rows, target):
    source, aim = collections.Counter(), collections.Counter()
    for _, t in rows:
        source.update(features(t)[1])
    for t in target:
        aim.update(features(t)[1])
    s, t = sum(source.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000)))) for b in source}
    out, eligible, n = [], [], 0
    for k, text in rows:
        w, f = features(text)
        weight = sum(gain[b] for b in f)
        score = None
        if k is not None:
            h = int(hashlib.sha256(f"42:{k}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        n += len(w) >= 20
        if len(w) >= 20 and k is not None:
            eligible.append((-score, k, len(out)))
        out.append([k, len(f), weight, score, None])
    for rank, (_, _, place) in enumerate(sorted(eligible)[: 5 * n // 100], 1):
        out[place][4] = rank
    return sorted(map(tuple, out), key=lambda r: (r[0] is None, r[0] or 0, r[1:4], r[4] or 0))


def mixed_texts(n=120):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(90)] + ["Alpha", "BETA", "Straße", "日本語", "x" * 70, "y" * 300, "9"]
    gap = [" ", ", ", "\n", "-", "_", "."]
    return [None, "", "?!", "one"] + ["".join(rng.choice(vocabulary) + rng.choice(gap) for _ in range(rng.choice([3, 19, 20, 40, 200, 900]))) for _ in range(n)]


@pytest.mark.parametrize("most", [op13_resample.CHUNK, 500, 1])
def test_op13_brute(spark, most):
    rows = list(enumerate(mixed_texts(40 if most == 1 else 120)))
    rows += [(None, rows[8][1]), rows[9], rows[9], (10, rows[11][1])]
    target = [*mixed_texts(9)[4:], None, ""]
    docs = spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in rows], "doc_id long, text string, score int, rank int, chunk int, key int").repartition(3)
    found = op13_resample.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), most=most)
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:4], r[4] or 0))
    assert got == brute_resampled(rows, target)


def test_op13_many_drawn_and_none(spark):
    rows = [(k, f"w{k % 13} " * 25) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    none = spark.createDataFrame([], "text string")
    found = op13_resample.resampled(docs, none)
    assert sorted((r.doc_id, r.score, r.rank) for r in found.collect() if r.rank) == sorted((r[0], r[3], r[4]) for r in brute_resampled(rows, []) if r[4])
    assert op13_resample.resampled(docs.limit(0), none).count() == 0


def test_op13_table(spark):
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet").collect()
    found = sorted((tuple(r) for r in op13_resample.op13_resample(spark, SMALL).collect()), key=lambda r: r[0])
    assert found == brute_resampled([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])
