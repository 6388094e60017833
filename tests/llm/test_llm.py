"""The training-data operators against brute force, with nulls, empty and long texts, ties and clashing columns."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline
from docquarry.llm import decontaminate, embedding_dedup, ngram_join, packing, sharding, substring_dedup, token_store, toxicity, url_filters
from docquarry.llm.queries import QUERIES, SQL, tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, node long, key string, place long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    shared, base = prose(1, 60), prose(2, 400).split()
    texts = [prose(10 + i, 120) for i in range(12)]
    texts[3] = texts[3] + " " + shared
    texts[7] = prose(50, 40) + " " + shared + " " + prose(51, 40)
    texts += [" ".join(base), " ".join([*base[:399], "zz"]), " ".join(base), "", None, "one two", "one two", "x" * 200_000, prose(3, 30_000)]
    return spark.createDataFrame([(i, t, 1, "k", 2) for i, t in enumerate(texts)] + [(2, texts[2], 1, "k", 2), (None, texts[4], 1, "k", 2)], SCHEMA).cache()


def shingles(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(ids, linked):
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_ngram_join_equals_brute_force(docs):
    text = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    sets = {i: shingles(t, 3) for i, t in text.items()}
    want = groups(list(sets), lambda a, b: bool(sets[a]) and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]))
    got = ngram_join.join(docs, 3, 0.9).where("doc_id is not null").collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got)


def test_ngram_join_links_a_set_whose_first_row_has_no_id(spark):
    base = prose(2, 400).split()
    text, near = " ".join(base), " ".join([*base[:399], "zz"])
    rows = spark.createDataFrame([(None, text), (5, text), (6, near)], "doc_id long, text string").coalesce(1)
    for n, t in ((3, 0.9), (5, 0.8)):
        assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join.join(rows, n, t).collect()) == [(0, 5), (5, 5), (6, 5)]


def test_substring_dedup_finds_the_shared_passage_only(docs):
    got = {r.doc_id: r for r in substring_dedup.passages(docs).where("doc_id is not null").collect()}
    assert list(got[7].first_docs) == [3] and len(got[7].span_starts) == 1
    assert not got[3].span_starts and not got[0].span_starts and not got[15].span_starts
    kept = {r.doc_id: r.text for r in substring_dedup.cut(docs).where("doc_id is not null").collect()}
    assert len(kept[7]) < len({r.doc_id: r.text for r in docs.collect()}[7]) and 14 not in kept and kept[16] is None


def test_toxicity(spark):
    bad, rows = "scumbag", []
    for i in range(400):
        rows.append((i, prose(i, 30) + (f" you {bad} " if i % 3 == 0 else " ") + prose(i + 1000, 10)))
    docs = spark.createDataFrame([*rows, (1000, "you zcumbag"), (1001, ""), (1002, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(400))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert got[1000].fuzzy > 0 and 0 <= got[1001].score <= 1 and got[1002].score == got[1001].score


def test_url_filters(spark):
    pages = spark.createDataFrame([(1, "http://a.b.com/x/y", 5), (2, "http://a.b.com/x", 20), (3, None, 5), (4, "junk", 5), (5, "http://a.b.com", None)], "page_id long, url string, day int")
    entries = spark.createDataFrame([("l", "b.com", 3, "add"), ("l", "b.com", 10, "remove"), ("m", "a.b.com/x", 5, "add"), (None, "b.com", 1, "add")], "list string, key string, day int, action string")
    got = {r.page_id: (r.n_active, r.lists) for r in url_filters.apply(pages, entries).collect()}
    assert got == {1: (2, "l,m"), 2: (1, "m"), 3: (0, ""), 4: (0, ""), 5: (0, "")}


def test_embedding_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 16))
    x = np.vstack([c + 0.12 * rng.standard_normal((15, 16)) for c in centres]).astype(np.float32)
    x = np.vstack([x, x[:5]])
    label = [int(i % 2) for i in range(len(x))]
    rows = [(i, [float(v) for v in r], label[i]) for i, r in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float(v) for v in x[0]], None)]
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    d = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (d @ d.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    want = groups(range(len(x)), lambda a, b: near[a, b])
    assert all(got[i].n_links == near[i].sum() and got[i].component_id == want[i] for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903))


def test_embedding_dedup_finds_lone_pairs_beside_a_group_of_copies(spark):
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one = unit(rng.standard_normal((1000, 64)))
    side = rng.standard_normal((1000, 64))
    side = unit(side - (side * one).sum(axis=1, keepdims=True) * one)
    hot = unit(rng.standard_normal((1, 64))) + 0.01 * rng.standard_normal((40, 64))
    x = np.vstack([one, 0.932 * one + np.sqrt(1 - 0.932**2) * side, np.repeat(hot, 100, axis=0)])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), most=32).collect()}
    found = sum(got[i].n_links == 1 and got[1000 + i].component_id == i for i in range(1000))
    assert found >= 985 and all(got[i].n_links == 3999 for i in range(2000, 6000))


def test_audit_does_not_weigh_by_copies(spark):
    sample = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 39) for i in range(40)], "node long, true long")
    counts = spark.createDataFrame([(i, 1, 1) for i in range(30)] + [(100 + i, 10**6, 39) for i in range(40)], "node long, n long, m long")
    assert embedding_dedup.audit(sample, counts) == 0.75


def test_sharding(docs):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == docs.count()
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_token_store_round_trip(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got, start = token_store.read(token_store.write(docs, tokenizer("byte_bpe_50k.json"))).orderBy("start").collect(), 0
    text = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None:
            ids = np.array([*t.encode(text[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_decontaminate_equals_brute_force(spark, docs):
    text = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    items = [("a", " ".join(text[3].split()[20:40])), ("b", "one two"), ("c", ""), (None, "x y")]
    got = {r.doc_id: r for r in decontaminate.scan(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got[3].n_hit == 20 and got[3].n_items == 1 and got[3].contaminated
    assert got[17].n_hit == 2 and got[17].contaminated and not got[0].n_hit and got[16].n_words == 0


def test_packing(docs):
    got = packing.pack(docs.repartition(2), tokenizer("word_bpe_49k.json")).collect()
    fill, spans = {}, {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        spans.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    copies = {2: 2}
    for (doc, tokens), parts in spans.items():
        assert sum(n for _, n in parts) == tokens * copies.get(doc, 1)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, name, tmp_path):
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == packing.FIELDS and got.count() > 0
