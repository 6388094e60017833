"""The pipeline's decisions, stage by stage, against plain Python over a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docquarry.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n):
    return ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 9))) for _ in range(n)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(21)
    texts = {i: words(draw, 100) for i in range(160)}
    for i in range(100, 160):
        texts[i][50:50] = ["you", "scumbag", "idiot!"]
    item = words(draw, 30)
    texts[200] = [*texts[5][:60], "changed", *texts[5][61:]]
    texts[201] = texts[6]
    texts[202] = [*words(draw, 50), *texts[7][20:80], *words(draw, 50)]
    texts[203] = [*words(draw, 20), *item[3:20], *words(draw, 20)]
    texts[204] = [*words(draw, 300), *item[:13], *words(draw, 300)]
    rows = [(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in texts.items()] + [(205, "", "en", "s", 0), (206, None, None, None, None)]
    return rows, " ".join(item)


def tables(spark, rows, item, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(100 <= r[0] < 160)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_equal_plain_python(spark, corpus, tmp_path):
    rows, item = corpus
    tables(spark, rows, item, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    text = {r[0]: r[1] for r in rows}
    left = {i for i in text if not 100 <= i < 160}
    assert {r.doc_id for r in seen["toxicity"]} == left
    sets = {i: shingles(text[i] or "") for i in left}
    copies = {j for i in left for j in left if i < j and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert copies == {200, 201} and {r.doc_id for r in seen["ngram_jaccard_join"]} == left - copies
    cut = {r.doc_id: r for r in seen["substring_dedup"]}
    assert set(cut) == left - copies
    assert [i for i in cut if cut[i].text != text[i]] == [202] and abs(len(cut[202].text.split()) - 100) <= 2 and cut[202].n_chars == len(cut[202].text)
    clean = {r.doc_id for r in seen["benchmark_decontamination"]}
    assert clean == left - copies - {203}
    plain, spans = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), {}
    for r in seen["packing"]:
        spans.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert {i: sorted(p) for i, p in spans.items()} == {i: list(range(1 + len(plain.encode(cut[i].text or "", add_special_tokens=False).ids))) for i in clean}


def test_empty_tables_and_repeats(spark, corpus, tmp_path):
    rows, item = corpus
    tables(spark, [], item, tmp_path / "none")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    tables(spark, [rows[0], rows[0], (None, *rows[1][1:]), (1, *rows[1][1:])], item, tmp_path / "few")
    got = corpus_pipeline.run(spark, str(tmp_path / "few"))
    assert sorted(r.doc_id for r in got.where(F.col("start") == 0).collect() if r.doc_id is not None) == [0, 1]
