"""The stored keyword index against full BM25, and modularity communities against exact sums on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import graph, keyword_index, modularity, retrieval

SF = "/root/testdata/sf0.001"


def ranks(rows):
    return {(r.qid, r.doc_id, r.rank): round(r.score, 4) for r in rows.collect()}


def same(got, want):
    return got.keys() == want.keys() and all(abs(got[x] - want[x]) <= 1.1e-4 for x in want)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")


def test_search_equals_a_full_scan_after_each_addition(spark, corpus, monkeypatch):
    monkeypatch.setattr(keyword_index, "TILE", 16)
    docs, queries = corpus
    first = docs.where("doc_id % 3 <> 0")
    index = keyword_index.build(first)
    assert same(ranks(keyword_index.search(index, queries, 5)), ranks(retrieval.bm25(first, queries, 5)))
    assert keyword_index.is_valid(index, first) and not keyword_index.is_valid(index, docs)
    assert keyword_index.add(index, docs) == docs.where("doc_id % 3 = 0").count() and keyword_index.add(index, docs) == 0
    assert index.segments() == 2 and keyword_index.is_valid(index, docs)
    assert same(ranks(keyword_index.search(index, queries, 5)), ranks(retrieval.bm25(docs, queries, 5)))


def test_only_buckets_of_the_terms_are_read(spark, corpus):
    index = keyword_index.build(corpus[0])
    asked = spark.createDataFrame([(1, "the"), (2, "zz"), (3, None)], "qid long, text string")
    got = keyword_index.search(index, asked, 3)
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan and " IN (" in plan
    assert same(ranks(got), ranks(retrieval.bm25(corpus[0], asked, 3)))


def test_ensure_builds_extends_and_rebuilds(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    rows = [(1, "red fox"), (2, "blue fox fox"), (None, "lost"), (3, None)]
    assert keyword_index.ensure(frame(rows), path).path == path
    index = keyword_index.ensure(frame([*rows, (4, "red bird")]), path)
    assert index.path == path and index.segments() == 2
    changed = keyword_index.ensure(frame([(1, "green fox"), (2, "blue fox fox"), (3, None), (4, "red bird")]), path)
    assert changed.path != path
    asked = spark.createDataFrame([(1, "green red fox fox")], "qid long, text string")
    assert same(ranks(keyword_index.search(changed, asked)), ranks(retrieval.bm25(frame([(1, "green fox"), (2, "blue fox fox"), (3, ""), (4, "red bird")]), asked)))


def test_empty_index_and_questions(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = keyword_index.build(docs)
    assert keyword_index.search(index, spark.createDataFrame([(1, "fox")], "qid long, text string")).count() == 0
    assert keyword_index.search(index, spark.createDataFrame([], "qid long, text string")).count() == 0


def plain_modularity(pairs, label):
    edges = {(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b}
    m2 = len(edges)
    degree = {}
    for a, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    return sum(((a, b) in edges) / m2 - degree[a] * degree[b] / m2**2 for a in degree for b in degree if label[a] == label[b])


def graphs():
    draw = random.Random(5)
    groups = [(10 * g + i, 10 * g + j) for g in range(6) for i in range(10) for j in range(i) if draw.random() < 0.6]
    return {"groups": groups + [(10 * g, 10 * ((g + 1) % 6) + 1) for g in range(6)], "ring": [(i, (i + 1) % 24) for i in range(24)], "random": [(draw.randrange(40), draw.randrange(40)) for _ in range(90)], "loops": [(1, 1), (1, 2), (2, 1), (1, 2), (3, 4)]}


@pytest.mark.parametrize("name", graphs())
def test_communities_gain_modularity(spark, name):
    pairs = graphs()[name]
    relations = spark.createDataFrame([*pairs, (None, 3)], "source_id long, target_id long")
    label = {r.id: r.community for r in modularity.communities(relations).collect()}
    assert label.keys() == {x for p in pairs for x in p if p[0] != p[1]}
    assert all(min(i for i in label if label[i] == c) == c for c in label.values())
    q = plain_modularity(pairs, label)
    edges = graph.undirected(relations.where("source_id is not null")).withColumn("w", F.lit(1.0))
    labels = spark.createDataFrame(list(label.items()), "id long, community long")
    assert abs(modularity.modularity(edges, labels) - q) < 1e-9
    spread = {r.id: r.community for r in graph.communities(relations.where("source_id is not null")).collect()}
    assert q >= plain_modularity(pairs, spread) - 1e-9
    if name == "groups":
        assert len(set(label.values())) == 6 and all(label[i] == 10 * (i // 10) for i in label)


def test_gains_are_exact(spark):
    draw = random.Random(8)
    pairs = [(draw.randrange(15), draw.randrange(15)) for _ in range(40)]
    relations = spark.createDataFrame(pairs, "source_id long, target_id long")
    edges = graph.undirected(relations).withColumn("w", F.lit(1.0))
    label = {i: i % 4 for p in pairs for i in p if p[0] != p[1]}
    labels = spark.createDataFrame(list(label.items()), "id long, community long")
    before = plain_modularity(pairs, label)
    moves = modularity.best_moves(edges, labels).collect()
    assert moves
    for r in moves:
        after = {c: plain_modularity(pairs, label | {r.id: c}) - before for c in set(label.values()) - {label[r.id]}}
        assert abs(after[r.target] - r.gain) < 1e-9 and r.gain >= max(after.values()) - 1e-9


def test_no_relations(spark):
    assert modularity.communities(spark.createDataFrame([], "source_id long, target_id long")).count() == 0


def test_a_pass_shuffles_edges_to_senders_and_receivers_only(spark):
    edges = spark.createDataFrame([(i, (i * 7 + j) % 40, 1.0) for i in range(40) for j in (1, 2, 3)], "a long, b long, w double")
    labels = spark.range(40).select("id", (F.col("id") % 5).alias("community"))
    plan = modularity.best_moves(edges, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
