"""Metrics where a label decides what is relevant, against metrics of the pairs written out."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import metrics


@pytest.mark.parametrize("slices", [1, 3])
def test_groups_give_what_their_pairs_give(spark, monkeypatch, slices):
    monkeypatch.setattr(metrics, "SLICES", slices)
    draw = random.Random(3)
    items = [(i, draw.choice([0, 0, 1, 2, None]), draw.choice([1, 2])) for i in range(60)] + [(60, 9, 1)]
    items = spark.createDataFrame(items, "vec_id long, label int, grade int")
    queries = items.where("vec_id % 4 = 0").select(F.col("vec_id").alias("qid"), "label").unionByName(spark.createDataFrame([(100, 1), (101, 7), (102, None)], "qid long, label int"))
    run = spark.createDataFrame([(q, v, n + 1) for q in [*range(0, 61, 4), 100, 101, 102] for n, v in enumerate(draw.sample(range(61), 20))], "qid long, vec_id long, rank int")
    qrels = items.join(queries, "label").where("vec_id <> qid").select("qid", "vec_id", "grade")
    rows = lambda f: {r.qid: tuple(round(x, 9) for x in r[1:]) for r in f.collect()}
    want, got = rows(metrics.per_query(queries, qrels, run, 5)), rows(metrics.per_query_of_groups(queries, items, run, 5))
    assert got == want and len(got) == 19
