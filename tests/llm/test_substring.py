"""Substring dedup against brute force over words: what repeats is found wherever it stands, and nothing else is."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import substring_dedup as sd


def words(draw, n):
    return ["".join(draw.choice("abcdefghijklmnopqrst") for _ in range(draw.randint(2, 9))) for _ in range(n)]


def copied(text, earlier, least):
    """Word places of ``text`` inside runs of ``least`` words or more that an earlier text has, too."""
    known = {tuple(e[i : i + least]) for e in earlier for i in range(len(e) - least + 1)}
    out = set()
    for i in range(len(text) - least + 1):
        if tuple(text[i : i + least]) in known:
            out.update(range(i, i + least))
    return out


def places(text, starts, ends):
    """Word places inside of byte spans."""
    out, at = set(), 0
    for i, w in enumerate(text):
        if any(a <= at and at + len(w) <= b for a, b in zip(starts, ends, strict=True)):
            out.add(i)
        at += len(w) + 1
    return out


def test_passages_over_fifty_words_are_found_at_any_place(spark):
    draw = random.Random(11)
    shared = [words(draw, n) for n in (51, 52, 55, 60, 80, 150)]
    short = [words(draw, n) for n in (8, 15, 25)]
    texts = []
    for i in range(400):
        part = draw.choice(shared) if i % 2 else draw.choice(short)
        texts.append([*words(draw, draw.randint(0, 60)), *part, *words(draw, draw.randint(0, 60))])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: places(texts[r.doc_id], r.span_starts, r.span_ends) for r in sd.passages(docs).collect()}
    missed = extra = true = lost = all_words = 0
    for i, t in enumerate(texts):
        want, some = copied(t, texts[:i], 50), copied(t, texts[:i], 46)
        assert bool(got[i]) <= bool(some), i
        true += bool(want)
        missed += bool(want) and not got[i]
        extra += len(got[i] - some)
        lost, all_words = lost + len(want - got[i]), all_words + len(want)
    assert true > 150 and missed <= 0.01 * true and not extra
    assert lost <= 0.01 * all_words


def test_text_of_many_owners_stays(spark):
    """Windows of 30 words, each from another document, are no passage of any of them."""
    draw = random.Random(17)
    texts = [words(draw, 120) for _ in range(40)]
    earlier = [[*words(draw, 20), *t[a : a + 30], *words(draw, 20)] for t in texts for a in range(0, 120, 15)]
    draw.shuffle(earlier)
    rows = [" ".join(x) for x in [*earlier, *texts]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert not sd.passages(docs).where("size(span_starts) > 0").count()
    assert {r.doc_id: r.text for r in sd.cut(docs).collect()} == dict(enumerate(rows))


def test_passage_whose_middle_an_earlier_document_holds(spark):
    draw = random.Random(19)
    rows, want = [], {}
    for k in range(60):
        passage, n = words(draw, draw.randint(60, 150)), len(rows)
        a = draw.randint(0, 20)
        rows += [" ".join([*words(draw, 5), *passage[a : a + draw.randint(24, 60)], *words(draw, 5)]), " ".join([*words(draw, 9), *passage, *words(draw, 7)]), " ".join([*words(draw, 7), *passage, *words(draw, 9)])]
        want[n + 2] = set(range(7, 7 + len(passage)))
    got = {r.doc_id: places(rows[r.doc_id].split(" "), r.span_starts, r.span_ends) for r in sd.passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i] <= w for i, w in want.items())
    assert sum(len(got[i]) for i in want) >= 0.98 * sum(map(len, want.values()))


def test_runs_keep_to_one_owner_and_line():
    hits = [(0, 7, 100, 1), (10, 7, 110, 2), (12, 8, 5, 3), (30, 7, 130, 4), (60, 7, 160, 5), (70, 7, 171, 6)]
    assert sorted(sd.runs_of(hits)) == [(7, 0, 54, 1, 4), (7, 60, 84, 5, 5), (7, 70, 94, 6, 6), (8, 12, 36, 3, 3)]


def test_units_beside_a_chunk():
    code = np.arange(1, 31, dtype=np.uint16)
    got = sd.beside(code, np.array([4, 12]), -1, np.array([2, 10]), np.array([20, 30]))
    assert got[0].tolist() == [5, 4, 3] + [0] * 17 and got[1].tolist() == [13, 12, 11] + [0] * 17
    assert sd.agreeing(got[0], code[:5][::-1]) == 3 and sd.agreeing(code[:0], code) == 0


def test_borders_do_not_depend_on_what_stands_before():
    draw = random.Random(23)
    tail = " ".join(words(draw, 300)).encode()
    found = []
    for head in (b"", b"one two ", "日本語 ".encode()):
        raw = head + tail
        starts, _, _, begins, digest = sd.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 4)
        found.append({(int(starts[b]) - len(head), int(d)) for b, d in zip(begins, digest, strict=True) if starts[b] >= len(head)})
    assert found[0] == found[1] == found[2] and 40 < len(found[0]) < 110


def test_nulls_ties_and_clashing_columns(spark):
    draw = random.Random(4)
    same, own = " ".join(words(draw, 90)), " ".join(words(draw, 40))
    rows = [(1, same, 5, "a"), (2, f"{own} {same}", 5, "b"), (2, f"{own} {same}", 5, "b"), (3, same, 5, "c"), (None, same, 5, "d"), (4, "", 5, "e"), (5, None, 5, "f"), (6, "日本" * 60 + same, 5, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dq_key int, dq_places string")
    kept = sorted((r.doc_id or 0, r.dq_places, r.text) for r in sd.cut(docs).collect())
    assert [k[:2] for k in kept] == [(1, "a"), (2, "b"), (2, "b"), (4, "e"), (5, "f"), (6, "g")]
    assert kept[0][2] == same and kept[1][2].strip() == own and kept[3][2] == "" and kept[4][2] is None and kept[5][2].startswith("日本")
    assert sd.cut(docs).columns == docs.columns and sd.cut(docs.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_long_text_beside_an_insertion(spark, n):
    draw = random.Random(8)
    base = words(draw, 20_000)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:10_000], *words(draw, n), *base[10_000:]]))]
    got = {r.doc_id: r for r in sd.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1].span_starts and sum(got[2].span_ends) - sum(got[2].span_starts) >= 0.999 * len(rows[0][1])
