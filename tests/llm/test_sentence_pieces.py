"""The piece encoder against the library, on whole tables, odd texts and words that force steps back."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from docquarry.llm import sentence_pieces
from docquarry.llm.queries import QUERIES, tokenizer

MODEL = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(text):
    return np.frombuffer(sentence_pieces.codec(MODEL).encode(text), np.int32).tolist()


TEXTS = ["", " ", "  ", "a", " a", "a ", "\n", "\n\n a", "a\nb\n", "▁", "▁▁a", "<s> </s> <unk> <0x0A>", "日本語 テキスト", "ﬁ é é", "a\x00b", "\U0001f600\U0001f600", "x" * 5000, " " * 3000, "\t \t", "'s .. ... .a", "퟿￿", "a b", "ab" * 2000, "\r\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_odd_texts(library, text):
    assert ids(text) == library.encode(text)


def test_random_texts(library):
    draw = random.Random(2)
    letters = ["a", "b", "e", "t", "h", "in", "ing", " ", "  ", ".", "\n", "é", "ß", "日", "▁", "1", "-", "th", "er", "\U0001f600", "\x7f"]
    for _ in range(3000):
        text = "".join(draw.choices(letters, k=draw.randint(0, 40)))
        assert ids(text) == library.encode(text)


def test_texts_of_pieces_that_must_not_meet(library):
    draw = random.Random(3)
    pieces = [p for p in sentence_pieces.codec(MODEL).id if len(p) > 1]
    for _ in range(2000):
        text = "".join(draw.choice(pieces)[: draw.randint(1, 6)] for _ in range(draw.randint(1, 8)))
        assert ids(text) == library.encode(text)


def test_steps_back_are_taken():
    """A text whose longest first match does not belong to its encoding."""
    code = sentence_pieces.codec(MODEL)
    found = [w for w in ("▁" + p for p in code.id if p.isalpha()) if len(code.pieces(w)) > 1 and code.pieces(w)[0] != max((q for q in (w[:k] for k in range(1, len(w) + 1)) if q in code.id), key=len)]
    assert found and all(code.pieces(w) == code.merged(w) for w in found[:500])


def test_full_tables_of_words_and_pairs_are_emptied(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "WORDS", 3)
    monkeypatch.setattr(sentence_pieces, "PAIRS", 3)
    text = "the quick brown fox jumps over the lazy dog and thirteen others"
    assert np.frombuffer(sentence_pieces.Codec(MODEL).encode(text), np.int32).tolist() == library.encode(text)


def test_query_on_the_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op13_sentence_pieces"](spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = library.encode(text, add_eos=True)
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_null_rows_repeats_and_other_columns(spark, library):
    rows = [(1, None), (None, "a b"), (1, "a b"), (1, "a b"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "decoded": F.lit(1)})
    got = sentence_pieces.decode(sentence_pieces.encode(docs, MODEL), MODEL).collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in got] == [(i, library.encode(t or "", add_eos=True), t or "") for i, t in rows]
    assert sentence_pieces.encode(docs.limit(0), MODEL).count() == 0
    assert sentence_pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).first().decoded is None
