"""Every core query with SQL equals it on the smallest test tables; rules without SQL have their own tests."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from docquarry.operators import chunks, graph, history, knowledge, retrieval
from docquarry.plans import answers
from docquarry.plans.catalog import QUERIES, SQL
from docquarry.streaming import windows

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(connect().execute(SQL[name]).df())


def reference_context(session: list) -> str:
    """The rule of the reference, one session at a time."""
    line = lambda m, n: f"- {'学生' if m[0] == 'user' else '答疑老师'}: {m[1][:n]}"
    total = len(session)
    if total <= 6:
        return "\n".join(["【对话历史】", *(line(m, 300) for m in session)])
    if total <= 12:
        return "\n".join([f"【对话历史（最近 10 轮，共 {total} 轮）】", *(line(m, 200) for m in session[-10:])])
    asked = [m[1][:60] for m in session[:-8] if m[0] == "user"][-5:]
    summary = "之前讨论过：" + "；".join(asked) if asked else "（之前的对话）"
    return "\n".join([f"【对话历史（共 {total} 轮，早期已摘要）】", f"【历史摘要】{summary}", *(line(m, 200) for m in session[-8:])])


def test_history_tiers_equal_the_reference(spark):
    sessions = {n: [("user" if i % 3 == 0 else "assistant", f"{i} " + "é文x" * 150) for i in range(n)] for n in (1, 6, 7, 10, 11, 12, 13, 14, 40)}
    sessions[100] = [("assistant", "a")] * 9 + [("user", "b")] * 8
    sessions[101] = [("user", "")] + [("assistant", "a")] * 12
    data = pd.DataFrame([(c, i, *m) for c, s in sessions.items() for i, m in enumerate(s)], columns=["conv_id", "turn", "role", "text"])
    want = {c: reference_context(s) for c, s in sessions.items()}
    got = history.build_context(spark.createDataFrame(data)).collect()
    assert {r.conv_id: r.history for r in got} == want and all(r.total == len(sessions[r.conv_id]) for r in got)
    con = duckdb.connect()
    con.register("conversations", data)
    assert dict(con.execute(f"SELECT conv_id, history FROM ({SQL['history_tier']})").fetchall()) == want


def test_chunks_lose_nothing(spark):
    text = "One sentence here. " * 200 + "x" * 2000
    docs = spark.createDataFrame([(1, text, "f", "Chapter 1"), (2, None, "f", "x"), (3, " \n ", "f", "x")], "doc_id long, text string, file string, chapter string")
    got = chunks.chunk(docs, 300, 0).orderBy("doc_id", "position").collect()
    assert {r.doc_id for r in got} == {1} and [r.position for r in got] == list(range(len(got)))
    assert "".join(r.text for r in got).replace(" ", "") == text.replace(" ", "")
    assert all(len(r.text) <= 360 or r.text.endswith("x" * 2000) for r in got)


def test_limiter_counts_accepted_calls_only(spark):
    calls = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "user_id long, event_id long, at double")
    got = windows.limit_calls(calls, 2, 3.0).toPandas().sort_values("event_id").accepted.tolist()
    assert got == [True, True, False, True, True, False]


def test_neighbors_are_those_of_all_concepts(spark):
    lines = connect().execute("SELECT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1").fetchall()
    assert {r.id for r in QUERIES["neighbors"](spark, SF).select("id").distinct().collect()} == {x for pair in lines for x in pair}


def test_two_hops_tell_seeds_apart(spark):
    relations = spark.createDataFrame([(20, 1), (1, 40), (40, 2), (2, 3), (20, 20)], "source_id long, target_id long")
    got = graph.two_hop_by_seed(relations, spark.createDataFrame([(20,), (40,), (60,)], "id long")).collect()
    assert sorted(map(tuple, got)) == [(20, 1, 1), (20, 40, 2), (40, 1, 1), (40, 2, 1), (40, 3, 2), (40, 20, 2)]


def test_suppliers_with_the_same_similarities_ask_once(spark, tmp_path, monkeypatch):
    for t in ("part", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    spark.range(1818).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    met, tiers = [], graph.tiers
    monkeypatch.setattr(graph, "tiers", lambda matches, *rest: met.append(matches.count()) or tiers(matches, *rest))
    got = QUERIES["graph_tiers"](spark, str(tmp_path)).toPandas()
    assert met == [101 * spark.read.parquet(f"{SF}/part.parquet").count()]
    con = connect()
    con.execute(f"create or replace view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(SQL["graph_tiers"]).df())


def test_keyword_search_in_blocks_shuffles_no_pairs(spark):
    docs = spark.createDataFrame([(i, "common " + " ".join(f"w{j}w" for j in range(12) if (i * (j + 2)) % 5 == 0)) for i in range(300)] + [(300, None)], "doc_id long, text string")
    asked = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("qid"), "text")
    rank = lambda got: sorted(map(tuple, got.select("qid", "doc_id", F.round("score", 6), "rank").collect()))
    got = retrieval.bm25(docs, asked, 7)
    assert rank(got) == rank(retrieval.bm25(docs, asked, 7, most=9, held=20)) != []
    assert len(rank(got)) == 700 and "(qid#" not in "".join(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x)
    assert retrieval.bm25(docs, asked.limit(0)).count() == retrieval.bm25(docs.limit(0), asked).count() == 0


@pytest.mark.parametrize(("kernel", "item"), [(retrieval._nearest(1, 6, False), "vec_id"), (graph._best_concepts(0.1, 1), "chunk_id")])
def test_a_task_holds_bounded_similarities(kernel, item):
    frame = pd.DataFrame({item: range(20_000), "embedding": [np.ones(2)] * 20_000})
    got = list(kernel(np.arange(300), np.ones((300, 2)), frame))
    assert max(map(len, got)) * len(frame) <= 1_000_000 and sum(map(len, got)) == 300


def test_similar_pairs_write_no_other_pairs_down(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "_alike", lambda *_: pytest.fail("all pairs were made"))
    vec = lambda i: [float((i * j) % 5 - 2) for j in (1, 3, 4)]
    data = [(i, i % 3, i % 7 if i % 11 else None, vec(i)) for i in range(60)] + [(60, 1, 1, None)]
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, *_, v in data if v}
    pairs = [(a, b, float(unit[a] @ unit[b])) for a, n, c, v in data if a % 5 == 0 and v for b, m, d, w in data if w and n != m and None not in (c, d) and c != d and a != b]
    want = sorted(((-round(s, 6), a, b) for a, b, s in pairs if s >= 0.2))[:20]
    frame = spark.createDataFrame(data, "id long, name int, chapter int, vec array<double>")
    got = knowledge.similar_pairs(frame, frame.where("id % 5 = 0"), 0.2).collect()
    assert [(-round(r.score, 6), r.a, r.b) for r in got] == want and len(want) == 20


def test_a_task_sorts_the_chapters_of_few_documents(spark, monkeypatch):
    monkeypatch.setattr(answers, "TASK_DOCS", 10)
    given = []
    monkeypatch.setattr(answers.answering, "chosen_or_first", lambda selected, parsed: given.append(parsed) or parsed)
    QUERIES["selected_chapters"](spark, SF)
    sizes = [r["count"] for r in given[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 5 and sum(sizes) == 25 * spark.read.parquet(f"{SF}/customer.parquet").count() and max(sizes) <= 25 * 30


def test_topological_rounds(spark):
    tasks = spark.createDataFrame([(1, 1, []), (1, 2, [1]), (1, 3, [99]), (2, 1, [2]), (2, 2, [1])], "plan int, id int, depends_on array<int>")
    assert {tuple(r) for r in graph.topological_rounds(tasks).collect()} == {(1, 1, 0), (1, 3, 0), (1, 2, 1), (2, 1, 0), (2, 2, 0)}


def test_questions_in_blocks_find_the_same(spark):
    vectors = [(i, i % 7, [float((i * j) % 5 - 2) for j in (1, 3, 4)]) for i in range(60)] + [(60, 1, None), (61, None, [1.0, 0.0, 0.0])]
    known = spark.createDataFrame(vectors, "vec_id long, chunk_id long, embedding array<double>")
    asked = known.where("vec_id % 3 = 0").selectExpr("vec_id as qid", "embedding as q")
    rank = lambda got: sorted(map(tuple, got.select("qid", got.columns[1], F.round("score", 6), "rank").collect()))
    for search in (retrieval.dense, retrieval.dense_last_of_ties):
        assert rank(search(known, asked, 4, most=6)) == rank(search(known, asked, 4)) != []
    scores = lambda most: rank(graph.direct_scores(known, asked, 3, most=most))
    assert scores(6) == scores(5_000) != []
    assert retrieval.dense(known, asked.limit(0), 4).count() == 0 and retrieval.dense(known.limit(0), asked, 4, 6).count() == 0
    tied = retrieval.dense_last_of_ties(known.where("vec_id < 60"), asked.where("qid = 3"), 60, 1).orderBy("rank").collect()
    assert all(a.score > b.score or a.score == b.score and a.vec_id > b.vec_id for a, b in zip(tied, tied[1:]))


def test_tasks_of_the_graph_hold_bounded_rows(spark, monkeypatch):
    relations = spark.range(400).selectExpr("id % 50 as source_id", "(id * 7) % 43 as target_id")
    want = {tuple(r) for r in graph.communities(relations, 3).collect()}
    monkeypatch.setattr("docquarry.functions.scratch.ROWS", 20)
    dealt = []
    saved = graph.save
    monkeypatch.setattr(graph, "save", lambda df, tag: dealt.append(df.rdd.getNumPartitions()) or saved(df, tag))
    assert {tuple(r) for r in graph.communities(relations, 3).collect()} == want
    assert min(dealt[1:]) > 8  # edges and labels, not merged into fewer tasks
