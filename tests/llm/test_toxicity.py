"""Lexicon counts, features and the significance of entries against plain Python; labelled texts with passages in common."""

import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from docquarry.llm import toxicity

WORD = re.compile(r"\w+")


def invented(draw, n):
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(n)]


def segments(texts):
    return {x.strip(" ") for t in texts for x in re.split(r"[.!?\n]+", t.lower())} - {""}


def counts(texts):
    out = defaultdict(int)
    for s in segments(texts):
        for w in set(WORD.findall(s)):
            if 3 <= len(w) <= 60:
                out[0, w] += 1
            for k in range(4, 9):
                if len(w) > k:
                    out[1, w[:k]] += 1
    return out


def test_lexicon_equals_plain_counts(spark):
    draw = random.Random(1)
    base = invented(draw, 60)
    rows = []
    for i in range(400):
        toxic = int(i % 5 == 0)
        text = draw.choices(base, k=draw.randint(1, 30))
        if toxic:
            text[draw.randrange(len(text))] = draw.choice(["zozlot", "zozlets", "quargly", base[0]])
        rows.append((toxic, draw.choice([" ", " ", ". ", "!\n"]).join(text)))
    rows += rows[:50] * 3
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string").repartition(5))
    bad, fine = (counts([t for x, t in rows if x == k]) for k in (1, 0))
    n1, n0 = (sum(len(WORD.findall(t)) for t in segments([t for x, t in rows if x == k])) for k in (1, 0))
    p = n1 / (n0 + n1)
    exact = lambda t, f: sum(math.comb(t + f, k) * p**k * (1 - p) ** (t + f - k) for k in range(t, t + f + 1))
    want = {e for e, t in bad.items() if t >= 4 and (t + 0.5) / (fine.get(e, 0) + 0.5) * n0 / n1 >= 20 and exact(t, fine.get(e, 0)) <= 1e-4}
    assert got.words == {w for k, w in want if k == 0} and {"zozlot", "quargly"} <= got.words
    stems = {w for k, w in want if k == 1}
    assert set(got.stems) <= stems and all(any(s.startswith(x) for x in got.stems) or any(w.startswith(s) and len(w) - len(s) <= 1 for w in got.words) for s in stems)


def test_passage_that_all_texts_share_changes_nothing(spark):
    draw = random.Random(2)
    passage = " ".join(invented(draw, 400))
    rows = [(i % 2, " ".join([*invented(draw, 3), "Zozlot" if i % 2 else "house", *invented(draw, 3)])) for i in range(60)]
    lexicon = lambda rs: toxicity.learn_lexicon(spark.createDataFrame(rs, "toxic int, text string"))
    plain, shared = lexicon(rows), lexicon([(x, f"{passage} {t}") for x, t in rows])
    assert plain.words == shared.words == {"zozlot"}


def test_copies_count_once(spark):
    rows = [(1, f"one two harmless three four {i % 2}") for i in range(500)] + [(0, f"w{i} w{i + 1} other w{i + 2} w{i + 3}") for i in range(500)]
    assert "harmless" not in toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string")).words


@pytest.mark.parametrize(("t", "f", "p"), [(4, 0, 0.05), (30, 0, 0.5), (5, 40, 0.1), (1, 0, 0.3), (700, 900, 0.4)])
def test_chance(t, f, p):
    q = Fraction(p)
    want = float(sum(math.comb(t + f, k) * q**k * (1 - q) ** (t + f - k) for k in range(t, t + f + 1)))
    assert math.isclose(toxicity.unlikely(t, f, p), want, rel_tol=1e-8)


def plain_features(text, words, stems):
    low, out = text.lower(), [0] * 5
    found = [(m, m[0]) for m in WORD.finditer(low)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    n_hits = 0
    for m, w in found:
        kind = 1 if w in words else 2 if w.startswith(tuple(stems)) else 3 if len(w) >= 4 and any(len(x) >= 5 and edits(w, x) <= 1 for x in words) else 0
        if not kind:
            continue
        n_hits += 1
        before, after = low[max(0, m.start() - 40) : m.start()], low[m.end() : m.end() + 40]
        near = set(WORD.findall(before) + WORD.findall(after))
        out[kind - 1] += 1
        quoted = before.strip() and after.strip() and before.rstrip()[-1] in toxicity.QUOTES and after.lstrip()[0] in toxicity.QUOTES
        out[3] += bool(quoted) or bool(near & toxicity.REPORTS)
        out[4] += bool(near & toxicity.ADDRESS) or "!" in after[:20]
    return [*map(math.log1p, out), 10 * n_hits / len(found) if n_hits else 0.0]


def test_features_equal_a_plain_search():
    draw = random.Random(3)
    words, stems = ["zozlot", "quarg", "mix"], ["blarf"]
    lexicon = toxicity.Lexicon(words, stems)
    pool = ["zozlot", "zozlt", "zoozlot", "zzolot", "quarg", "quar", "quargs", "kuarg", "mix", "mi", "mixx", "blarfing", "blar", "you", "said", "the", "a", '"', "“", "!", ",", "ihr", "ZOZLOT", "x" * 200]
    for _ in range(2000):
        text = draw.choice(["", " "]).join(w + draw.choice([" ", " ", ""]) for w in draw.choices(pool, k=draw.randint(0, 25)))
        assert lexicon.features(text).tolist() == pytest.approx(plain_features(text, words, stems) if WORD.search(text) else [0] * 6)


def test_long_texts_repeats_nulls_and_clashing_columns(spark):
    draw = random.Random(4)
    rows = [(i, " ".join([*invented(draw, 5), "zozlot" if i % 3 == 0 else "fine", *invented(draw, 5)])) for i in range(300)]
    labels = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(300)] + [(5, 1, None), (None, 1, 1), (6, 1, 7)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))
    long = " ".join(invented(draw, 50_000))
    extra = [(1000, long), (1001, f"{long} zozlot"), (1002, None), (1003, ""), (None, "zozlot"), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumns({"score": F.lit("s"), "toxic": F.lit(9), "n": F.lit(None)})
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[1002].score == by[1003].score < 0.3 and by[1000].predicted == 0
    kept = toxicity.train(docs, labels).keep(docs, 0.3)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 0 and kept.where("doc_id = 1000").count() == 1
