"""Encoder, Elias-Fano files and packing against plain encodings and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docquarry.llm import packing, token_store
from docquarry.llm.packing import Packer
from docquarry.llm.queries import tokenizer
from docquarry.llm.token_store import EliasFano, TokenFile, write_file
from docquarry.llm.tokens import Encoder, Memo

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \n b", "é ü", "\n", " \ta", "x <s> </s> y", "don't  1234 ", "a b" * 3000, " 日本 語", "a b c", "a​ b", "' s a's", "a\r\n b"]
TEXTS += ["x <|endoftext|> y", "<|startoftext|>", "a<|endoftext|>b c <|startoftext|>", "<|endoftext| >", "a,b. c! (d) 'e' it's, f-g", "ABC,Σ. Σ", "x" * 50_000, "a\u00a0 b \u00a0c", "a \u2003b \u3000 c", "« oui » – ’tis", "e\u0301,e \u0301"]


def encoded(encoder: Encoder, texts: list[str], end: int | None) -> list[list[int]]:
    raw = [x.encode() for x in texts]
    offs = np.cumsum([0, *map(len, raw)])
    ids, begin = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offs, end)
    return [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("most", [4, 1 << 16])
def test_encoder_equals_the_library(name, most):
    encoder, plain = Encoder(tokenizer(name), most), Tokenizer.from_file(tokenizer(name))
    draw = random.Random(5)
    odd = ["".join(draw.choice(["a", "Bc", " ", "  ", ".", "'s", "\n", "é", "\u00a0", "日", "1", ",", "\u0301", "-", "<|endoftext|>"]) for _ in range(draw.randint(0, 30))) for _ in range(500)]
    for texts in (TEXTS, TEXTS * 2, odd):
        want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
        assert encoded(encoder, texts, 2) == [[*x, 2] for x in want]
        assert encoded(encoder, texts, None) == want


def test_memo_finds_what_it_holds():
    rng = np.random.default_rng(1)
    memo, one, two = Memo(1000), rng.integers(0, 50, 1000).astype(np.uint64), np.arange(1000, dtype=np.uint64)  # many equal first halves
    count = rng.integers(0, 5, 1000)
    memo.add(one[:600], two[:600], np.arange(count[:600].sum(), dtype=np.uint32), count[:600])
    memo.add(one[600:], two[600:], np.arange(count[600:].sum(), dtype=np.uint32), count[600:])
    assert memo.find(one, two).tolist() == list(range(1000)) and (memo.find(one, two + np.uint64(1000)) == -1).all()
    assert (memo.count[:1000] == count).all()


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9, 1000, 10**9], list(range(0, 3000, 3)), sorted(random.Random(3).choices(range(10**7), k=5000))])
def test_select(values):
    index = EliasFano.encode(np.array(values))
    assert [index.select(i) for i in range(len(values))] == values
    assert index.select_many(np.arange(len(values))).tolist() == values


def test_file_round_trip():
    docs = [[7, 8, 2], [2], [70_000, 1, 2]]
    data = write_file([np.array(docs[0] + docs[1], np.uint32), np.array(docs[2], np.uint32)], [3, 1, 3], [5, None, 9], 4, 100)
    f = TokenFile(data)
    assert [f.tokens(i).tolist() for i in range(3)] == docs and f.doc_ids == [5, None, 9] and [f.start(i) for i in range(3)] == [100, 103, 104]
    with pytest.raises(ValueError, match="70000"):
        write_file([np.array([70_000], np.uint32)], [1], [1], 2)
    assert TokenFile(write_file([], [], [], 2)).n == 0


def level_by_definition(count, size, length):
    """The highest level whose use leaves the least sum of squared counts of partly filled sequences."""
    best = None
    for h in range(size - length + 1):
        if h and not count[h]:
            continue
        after = count.copy()
        if h:
            after[h] -= 1
        if h + length < size:
            after[h + length] += 1
        key = int((after**2).sum())
        if best is None or key <= best[0]:
            best = (key, h)
    return best[1]


def test_packer_takes_the_least_sum_of_squares():
    draw = random.Random(2)
    for size in (16, 64):
        packer = Packer(size)
        for doc in range(3000):
            length = draw.randint(1, size - 1)
            want = level_by_definition(packer.count, size, length)
            assert packer.level(length) == want
            packer.place((doc, 0, length))
            if doc == 1500:
                packer.shrink(5)
                assert sum(packer.count) == sum(map(len, packer.open.values())) <= 5


def test_packing_is_whole(spark):
    plain = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = {i: f"word{i} " * (i * 13 % 700) + "Some <|endoftext|> more." for i in range(200)} | {500: "", 501: "x y " * 9000}
    rows = [(i, t, 1) for i, t in texts.items()] + [(502, None, 1), (7, texts[7], 1), (None, "lost", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(3)
    got = packing.pack(docs, tokenizer("word_bpe_49k.json"), window=8).collect()
    fill, spans = {}, {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            want = np.array([*plain.encode(texts.get(r.doc_id) or "", add_special_tokens=False).ids, 2], "<u4")
            assert (r.doc_tokens, r.ids_crc32) == (len(want), zlib.crc32(want[r.start : r.start + r.length].tobytes()))
            spans.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    for parts in fill.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == 4096 or int(ends[-1]).bit_count() == 1
    for doc, places in spans.items():
        n = 1 + len(plain.encode(texts.get(doc) or "", add_special_tokens=False).ids)
        assert sorted(places) == sorted([*range(n)] * (2 if doc == 7 else 1))


def test_token_store_ties_and_clashing_columns(spark):
    rows = [(1, "b", 1), (1, "a", 1), (None, "c", 1), (0, None, 1), (1, "a", 1)]
    files = token_store.write(spark.createDataFrame(rows, "doc_id long, text string, h int"), tokenizer("byte_bpe_50k.json"), most=2)
    got = token_store.read(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 1, 1] and [r.start for r in got] == [0, 2, 3, 5, 7]
    assert token_store.read(token_store.write(files.where(F.lit(False)).select(F.col("part").alias("doc_id"), F.lit("").alias("text")), tokenizer("byte_bpe_50k.json"))).count() == 0
