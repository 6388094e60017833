"""Searches and links in blocks: pairs are made inside of tasks, with the results of a plain loop."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parents[1]))
from docquarry.operators import keyword_index, knowledge, retrieval, vector_index

DRAW = np.random.default_rng(2)
TEXTS = [(i, " ".join(f"w{int(x)}" for x in DRAW.zipf(1.5, 12) % 40)) for i in range(60)]


def test_overlaps_in_blocks(spark):
    docs, asked = spark.createDataFrame([*TEXTS, (None, TEXTS[3][1])], "doc_id long, text string"), spark.createDataFrame(TEXTS[:9], "qid long, text string")
    got = {(r.qid, r.rank): (r.doc_id, round(r.score, 6)) for r in retrieval.jaccard(docs, asked, 4, most=2, held=7).collect()}
    want = {}
    for q, text in TEXTS[:9]:
        sets = [(d, set(t.split())) for d, t in [(None, TEXTS[3][1]), *TEXTS]]
        scores = [(d, round(len(s & set(text.split())) / len(s | set(text.split())), 6)) for d, s in sets if s & set(text.split())]
        for n, x in enumerate(sorted(scores, key=lambda x: (-x[1], -1 if x[0] is None else x[0]))[:4]):
            want[q, n + 1] = x
    assert got == want


def test_index_in_blocks_equals_the_scan(spark, monkeypatch):
    monkeypatch.setattr(keyword_index, "TILE", 5)
    docs, asked = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(TEXTS[:9], "qid long, text string")
    index = keyword_index.build(docs.where("doc_id % 3 > 0"))
    assert keyword_index.add(index, docs) == 20
    rows = lambda f: sorted((r.qid, r.rank, r.doc_id, round(r.score, 5)) for r in f.collect())
    assert rows(keyword_index.search(index, asked, 4, most=2)) == rows(retrieval.bm25(docs, asked, 4))


def test_name_links_in_blocks(spark):
    rows = [(i, f" n{i % 2}", "d", None if i % 5 == 0 else i % 3) for i in range(40)] + [(99, None, "d", 1)]
    got = sorted((r.source_id, r.target_id) for r in knowledge.name_links(spark.createDataFrame(rows, "id long, name string, doc string, chapter int"), block=6).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] and a[1] == b[1] and a[0] < b[0] and (a[3] is None or a[3] != b[3]))


def test_links_compare_names_in_the_task(spark):
    x = DRAW.normal(size=(40, 4))
    index = vector_index.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), cells=3)
    about = spark.createDataFrame([(i, i % 3, i % 2) for i in range(38)], "vec_id long, name int, chapter int")
    got = sorted((r.a, r.b) for r in vector_index.similar_links(index, 0.5, about).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == [(a, b) for a in range(38) for b in range(a + 1, 38) if unit[a] @ unit[b] >= 0.5 and a % 3 != b % 3 and a % 2 != b % 2]
