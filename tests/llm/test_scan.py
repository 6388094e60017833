"""Decontamination against brute force, sharding by its law, URL rules with ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from docquarry.llm import decontaminate, sharding, url_filters

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def by_definition(text, items, window=13):
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t) if item is not None else []
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("most", [1 << 20, 300, 60])
def test_scan_equals_brute_force(spark, most):
    draw = random.Random(3)
    vocabulary = ["aa", "Bb", "c1", "dd", "é", "日本", "f"]
    line = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    long = " ".join(f"w{draw.randrange(10**6)}" for _ in range(200))
    items = [(str(i), line(draw.randint(0, 9)) if i % 3 else line(16)) for i in range(12)] + [("x", long), ("y", None), (None, "aa"), ("10", "zz zz")]
    texts = [line(draw.randint(0, 60)) for _ in range(40)] + ["", None, "zz, ZZ-zz", long, " ".join(long.split()[40:60]) + " " + line(50), "n " * 3000 + " ".join(long.split()[100:115])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1), (None, texts[1], 1)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.scan(docs, bench, most=most).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = by_definition(texts[1 if r.doc_id is None else r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want
    kept = decontaminate.drop_contaminated(docs, bench, most=most).collect()
    assert len(kept) == sum(not r.contaminated for r in got) and all(r.n_hit == 1 for r in kept)
    assert decontaminate.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_shards_have_near_equal_bytes_and_whole_groups(spark):
    draw = random.Random(9)
    texts = ["x" * draw.randint(0, 400) + f" {i}" for i in range(3000)]
    texts += [f"copy {i % 40} " * 8 for i in range(200)] + ["hot " * 20] * 900 + ["", None, "é" * 50]
    rows = [(i if i % 50 else None, t, 1) for i, t in enumerate(texts)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int"), 10, slot_rows=50).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in rows)
    weight, slots, where = Counter(), {}, {}
    for r in got:
        weight[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(r.text_crc32, set()).add(r.shard)
    mean = sum(weight.values()) / 10
    assert set(weight) == set(range(10)) and all(abs(w - mean) <= 0.05 * mean for w in weight.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r.law for r in got} == {"bytes"}
    split_groups = sum(len(where[zlib.crc32((f"copy {i} " * 8).encode())]) > 1 for i in range(40))
    assert split_groups <= 2 and len(where[zlib.crc32(("hot " * 20).encode())]) > 1


def test_url_rules_with_ties_repeats_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/" + "x/" * 500, 5, 7), (1, "http://a.com/" + "x/" * 500, 5, 7), (2, "HTTPS://u@WWW.B.a.com:80?q", 9, 7)], "page_id long, url string, day int, row int")
    entries = spark.createDataFrame([("l", "a.com", 5, "add"), ("l", "a.com", 5, "add"), ("l", "a.com", 9, "add"), ("l", "a.com", 9, "remove"), ("m", "b.a.com", 1, "add")], "list string, key string, day int, action string")
    got = sorted((r.page_id, r.n_active, r.lists) for r in url_filters.apply(pages, entries).collect())
    assert got == [(1, 1, "l"), (1, 1, "l"), (2, 1, "m")]
    assert url_filters.apply(pages.limit(0), entries).count() == 0 and not any(r.blocked for r in url_filters.apply(pages, entries.limit(0)).collect())
