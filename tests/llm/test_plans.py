"""Hot payloads, templates, nesting, many query files, and votes and pages against plain versions."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glintsieve.llm import op5_warc, op6_html, op9_topk, op10_quality

SITE = "http://h.example/{}"
TEMPLATE = "".join(f"<div>line {k} of the template with many words in it</div>" for k in range(6))


def texts(spark, pages, group=4):
    df = spark.createDataFrame([(k, SITE.format(f"{k:03d}"), html) for k, html in enumerate(pages)], "page_id long, url string, html string")
    parsed = op6_html.parsed(df)
    return [r.text for r in op6_html.differenced(parsed, group).orderBy("page_id").collect()]


def test_op6_a_short_article_under_a_long_template(spark):
    pages = [f"<body>{TEMPLATE}<p>news {k} only here</p>{TEMPLATE.replace('line', 'row')}</body>" for k in range(9)]
    assert texts(spark, pages) == [f"news {k} only here" for k in range(9)]


def test_op6_mirrored_articles_stay(spark):
    article = "".join(f"<p>sentence {k} of the mirrored article, word for word</p>" for k in range(9))
    pages = [f"<body>{TEMPLATE}{article}</body>" if k in (2, 3) else f"<body>{TEMPLATE}<p>other text {k}</p></body>" for k in range(7)]
    found = texts(spark, pages)
    assert found[2] == found[3] == "\n".join(f"sentence {k} of the mirrored article, word for word" for k in range(9))
    assert found[0] == "other text 0" and found[6] == "other text 6"
    assert all(x for x in texts(spark, [f"<body>{TEMPLATE}{article}</body>"] * 9))  # nothing tells the template: all stays


def test_op6_differencing_decides(spark, monkeypatch):
    pages = [f"<body>{TEMPLATE}<p>news {k} only here</p></body>" for k in range(5)]
    monkeypatch.setattr(op6_html, "shared", lambda own, other: set())
    df = [op6_html.lines(p) for p in pages]
    kept = [op6_html.unshared([[t for _, t in x] for x in df], k, ["h"] * 5, [m for m, _ in df[k]]) for k in range(5)]
    assert all("template" in x for x in kept)


def test_op6_nesting_is_linear():
    for page in (lambda n: "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<h1>x</h1>" * n, lambda n: "<b>" * n + "</b>" * n, lambda n: "<p>" * n, lambda n: "<div>" * n + "x"):
        took = []
        for n in (4_000, 32_000):
            start = time.time()
            op6_html.lines(page(n))
            took.append(time.time() - start)
        assert took[1] < 24 * max(took[0], 0.01), took


def test_op6_unclosed_elements_end_with_their_block():
    html = "<div><b>one <i>two</div><p>three<p>four <b>five</u></b></p></b><h1>six</h1><nav><b>menu</nav>seven"
    assert [t for _, t in op6_html.lines(html)] == ["one two", "three", "four five", "six", "seven"]


def test_op5_pages_of_one_payload_and_of_small_ones(spark, tmp_path):
    large = "x" * 2000
    rows = [(k, f"u{k}", large if k % 3 == 0 else "" if k % 3 == 1 else None if k % 2 else f"small {k}") for k in range(300)] + [(297, "u297", large), (400, "u", large + "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    found = sorted((r.page_id, r.html, r.refers_to) for r in op5_warc.with_responses(df).collect())
    assert found == sorted((k, h or "", 297 if h == large and k != 297 else None) for k, _, h in rows)
    plan = op5_warc.with_responses(df)._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan


def test_op9_many_files_of_queries_and_blocks_of_candidates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(-3, 4, 6).astype(float).tolist()) for k in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    whole = sorted(map(tuple, op9_topk.top_k(df, every=7, k=4).collect()))
    monkeypatch.setattr(op9_topk, "QUERIES", 5)
    monkeypatch.setattr(op9_topk, "CANDIDATES", 16)
    assert sorted(map(tuple, op9_topk.top_k(df, every=7, k=4).collect())) == whole
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    for q in range(0, 500, 7):
        scores = sorted(((-int(x[q] @ x[c]), c) for c in range(500) if c != q))[:4]
        assert [r[2:] for r in whole if r[0] == q] == [(c, -s) for s, c in scores]


def test_op10_equals_a_plain_vote(spark):
    """Scores of all documents, odd ones included, against cosines in double precision, one document at a time."""
    rng = np.random.default_rng(9)
    good, bad = [f"word{k}" for k in range(40)], ["BUY", "!!!", "now", "###", "click", "$$$"]
    docs = [(k, " ".join(rng.choice(good if k % 2 else bad, rng.integers(5, 60)))) for k in range(160)]
    docs += [(200, None), (201, ""), (202, " \n "), (203, docs[3][1]), (204, "x" * 50_000), (205, docs[2][1] + " " + docs[3][1]), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(5, 0), (7, None), (999, 1)], "doc_id long, quality int")
    model = op10_quality.fit(df, labels)
    found = sorted((r.doc_id, r.text or "", r.s) for r in op10_quality.scored(df, model, "s").collect())
    counts = op10_quality.counted(pa.array([t or "" for _, t in docs], pa.string()))
    wanted = sorted((k, t or "", plain_vote(model, counts[n].astype(np.float64))) for n, (k, t) in enumerate(docs))
    assert [r[:2] for r in found] == [r[:2] for r in wanted]
    assert np.allclose([r[2] for r in found], [r[2] for r in wanted], atol=2e-3)
    assert op10_quality.scored(df.filter(F.lit(False)), model, "s").count() == 0


def plain_vote(model, terms):
    point = (terms * model.idf.astype(np.float64)) @ model.axes.astype(np.float64)
    size = np.linalg.norm(point)
    if size < 1e-9:
        return model.prior
    cosines = np.round(model.vectors.astype(np.float64) @ (point / size), 5)
    least = np.sort(cosines)[-min(op10_quality.NEIGHBOURS, len(cosines))]
    near = cosines >= least
    weights = np.maximum(cosines[near], 0)
    return float((weights * model.labels[near]).sum() / weights.sum()) if weights.sum() else model.prior
