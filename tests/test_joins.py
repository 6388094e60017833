"""Joins by time and by contained terms against plain loops, with ties, nulls, hot keys and clashing names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import contains, strategies, temporal

T0 = dt.datetime(2024, 3, 30, 22)


def times(draw, n, hot=0.5):
    return [(draw.choice([None, 1, 2, 3]) if draw.random() > hot else 7, None if draw.random() < 0.05 else T0 + dt.timedelta(seconds=draw.randrange(0, 90_000, 600)), i) for i in range(n)]


@pytest.fixture(scope="module", params=["timestamp", "timestamp_ntz"])
def sides(spark, request):
    draw = random.Random(3)
    left, right = times(draw, 300), times(draw, 200)
    frame = lambda rows, names: spark.createDataFrame(rows, f"k int, {names[0]} {request.param}, {names[1]} int")
    return left, right, frame(left, ("at", "i")), frame(right, ("at", "j")), frame(right, ("other_at", "j"))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [700, 86_400])
def test_as_of(sides, strict, bucket):
    left, right, a, b, _ = sides
    got = {r.i: (r.j, r.seen) for r in temporal.as_of(a, b.withColumn("seen", F.col("at")), "k", "at", ["seen", "j"], bucket, strict).collect()}
    for k, at, i in left:
        before = [(t, j) for q, t, j in right if q == k and k is not None and None not in (t, at) and (t < at or t == at and not strict)]
        assert got[i] == (max(before)[::-1] if before else (None, None))
    assert len(got) == len(left)


def test_range_and_interval(sides):
    left, right, a, _, b = sides
    got = [(r.i, r.j) for r in temporal.near(a, b, "k", "at", "other_at", 1800).collect()]
    want = {(i, j) for k, t, i in left for q, u, j in right if k == q and None not in (k, t, u) and abs((t - u).total_seconds()) <= 1800}
    assert len(got) == len(set(got)) and set(got) == want
    spans = b.withColumn("until", F.col("other_at") + F.expr("make_dt_interval(0, 0, j % 90, 0)"))
    spans = spans.withColumn("until", F.col("until").cast(dict(b.dtypes)["other_at"]))
    got = [(r.i, r.j) for r in temporal.within(a, spans, "k", "at", "other_at", "until").collect()]
    want = {(i, j) for k, t, i in left for q, u, j in right if k == q and None not in (k, t, u) and u <= t < u + dt.timedelta(minutes=j % 90)}
    assert len(got) == len(set(got)) and set(got) == want


def test_contained_terms(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abc日é") for _ in range(n))
    texts = [(i, word(draw.randint(0, 30))) for i in range(200)] + [(500, None), (None, "abc"), (501, "x" * 60_000 + "abcabc")]
    texts += texts[:20]
    terms = [(i, word(draw.randint(0, 6))) for i in range(100)] + [(900, None), (901, "zzz"), (902, "x" * 50_000)]
    a, b = spark.createDataFrame(texts, "id long, text string").withColumn("term", F.lit("q")), spark.createDataFrame(terms, "term_id long, term string").withColumn("gram", F.lit(1))
    want = {(i, j) for i, t in texts if i is not None and t for j, u in terms if u and u in t}
    got = [tuple(r) for r in contains.contained(a, b).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    both = want | {(i, j) for i, t in texts if i is not None and t for j, u in terms if u and t in u}
    assert {tuple(r) for r in contains.either_way(a, b).collect()} == both
    assert contains.contained(a, b.limit(0)).count() == contains.contained(a.limit(0), b).count() == 0


def test_long_terms_are_not_carried(spark):
    texts = spark.createDataFrame([(1, "abcdef"), (2, "xyz")], "id long, text string")
    terms = spark.createDataFrame([(7, "bcd"), (8, "q" * 100_000), (9, "abcdefg"), (10, "")], "term_id long, term string")
    kept = contains.askable(texts, terms)
    assert [r.term for r in kept.collect()] == ["bcd"] and all(len(r.key) == 32 for r in kept.collect())
    assert {tuple(r) for r in contains.either_way(texts, terms).collect()} == {(1, 7), (1, 9)}


def test_escalated_questions(spark):
    asked = spark.createDataFrame([(1, "What is a FOX?"), (2, "fox"), (3, "bird"), (4, " "), (5, None)], "qid long, text string")
    old = spark.createDataFrame([(" a fox? ",), ("",), (None,)], "text string")
    assert sorted(r.qid for r in strategies.escalated(asked, old).collect()) == [1, 2, 4]
    assert strategies.escalated(asked, old.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
def test_contained_terms_are_found_by_either_path(spark, most):
    draw = random.Random(12)
    letters = "abcé中😀 "
    texts = [(i, "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 3, 20, 300])))) for i in range(80)]
    terms = [(i, "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 3, 4, 5])))) for i in range(60)] + [(60, texts[7][1]), (61, texts[7][1])]
    a, b = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term_id long, term string")
    want = sorted((i, j) for i, x in texts for j, y in terms if x and y and y in x)
    assert sorted(tuple(r) for r in contains.contained(a, b, most).collect()) == want


def test_rows_of_a_frequent_term_are_dealt_and_not_compared_again(spark, monkeypatch):
    monkeypatch.setattr(contains, "MADE", 50)
    texts = [(i, "hot pot" if i % 2 else "pot") for i in range(40)]
    terms = [(i, "pot" if i % 2 else "hot pot") for i in range(30)]
    a, b = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(terms, "term_id long, term string")
    got = contains.either_way(a, b)
    assert sorted(tuple(r) for r in got.collect()) == [(i, j) for i in range(40) for j in range(30)]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
    twice = contains.either_way(a.unionByName(spark.createDataFrame([(1, "pot"), (1, "hot")], "id long, text string")), b)
    assert sorted(tuple(r) for r in twice.collect()) == [(i, j) for i in range(40) for j in range(30)]
