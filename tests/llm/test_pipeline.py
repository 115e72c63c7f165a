"""The pipeline's stages, each against its operator's brute force, on the smallest tables."""

import corpus_pipeline
from conftest import SMALL

from pyspark.sql import functions as F
from test_ops import brute_components

from glintsieve.llm import op2_bpe, op4_decontaminate, op10_quality
from glintsieve.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.fresh_path(spark, f"test-{name}")
        stage(spark, docs, SMALL).write.parquet(path)
        before, docs = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        kept[name] = (before, after)
    bench = [op4_decontaminate.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = kept["decontaminate"]
    exact = {k for k, r in before.items() if any(b in op4_decontaminate.normal(r.text or "") for b in bench)}
    assert exact and not exact & set(after)
    before, after = kept["secrets"]
    assert set(before) == set(after) and all(r.text == before[k].text or "[SECRET]" in r.text for k, r in after.items())
    before, after = kept["near_duplicates"]
    assert set(after) == {k for k, (_, least) in brute_components({k: r.text for k, r in before.items()}).items() if least == k} and len(after) < len(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before, after = kept["quality"]
    judged = [(labels[k] == 1) == (k in after) for k in before if k in labels]
    assert sum(judged) >= 0.9 * len(judged) and op10_quality.THRESHOLD == 0.3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    c = op2_bpe.codec(*op2_bpe.default_vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last.collect()} == {k: c.digest(t or "") for k, t in texts.items()}


def test_stages_with_odd_rows(spark):
    """Nulls in every column, repeated rows, empty and long texts, ties, clashing names, an empty table: a stage crashes on none and keeps its columns."""
    text = " ".join(f"The word{k} is here." for k in range(60))
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, text, "en", "a", 9), (2, text, "en", "a", 9), (None, text + " end", None, None, None), (3, long, "fr", "b", 1), (4, 'token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0" ' + text[: 600], "en", "c", 2), (5, text, "de", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {n: F.lit(1) for n in ("score", "leak", "later", "h", "key", "n", "sig", "quality", "_hits", "_pieces", "_found", "_text", "_score", "_id", "_key", "_keep", "item_id", "label", "part")}
    docs = docs.withColumns(clash)
    expected = {"near_duplicates": [(None, None), (1, ""), (2, text), (3, long), (4, rows[6][1])]}
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SMALL)
            assert out.columns == frame.columns and dict(out.dtypes) == dict(frame.dtypes)
            got = out.collect()
            assert len(got) <= len(rows) and all(r.score == r.leak == r.later == 1 for r in got)
            if name in expected and got:
                assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(expected[name], key=str)
            if name == "secrets" and got:
                assert len(got) == len(rows) and sum("[SECRET]" in (r.text or "") for r in got) == 1
            if name == "decontaminate" and got:
                assert len(got) == len(rows)
        last = corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).collect()
        assert len(last) in (0, len(rows))


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
