"""Kernels against brute force: the Levenshtein automaton and the cutting of texts before encoding; what workers hold in memory."""

import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from docquarry.llm import decontaminate, packing, textkit, tokens, toxicity
from docquarry.llm.queries import tokenizer
from docquarry.llm.toxicity import Lexicon


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    draw = random.Random(1)
    word = lambda low, high: "".join(draw.choice("abc") for _ in range(draw.randint(low, high)))
    entries = [word(3, 8) for _ in range(60)]
    lexicon = Lexicon(entries, [])
    for _ in range(1000):
        w = word(3, 10)
        near = min(distance(w, x) for x in entries if len(x) >= 5)
        assert [lexicon.within(w, e) for e in (1, 2)] == [near <= 1, near <= 2]
        assert near > 1 or lexicon.may_match(w)




def test_word_hashes_take_bounded_memory(monkeypatch):
    rng = np.random.default_rng(3)
    size = np.append(rng.integers(1, 12, 400_000), 300_000)  # the last word is longer than a block
    ends = np.cumsum(size)
    data = rng.integers(97, 123, int(ends[-1]), dtype=np.uint8)
    tracemalloc.start()
    got = textkit.word_hashes(data, ends - size, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data)  # before, some 50 bytes for each byte of the words
    monkeypatch.setattr(textkit, "BLOCK", 1 << 40)
    assert (textkit.word_hashes(data, ends - size, ends) == got).all()


def test_workers_keep_what_one_operator_needs():
    made = tokens.encoder(tokenizer("word_bpe_49k.json"))
    assert tokens.encoder(tokenizer("word_bpe_49k.json")) is made
    gone = weakref.ref(made)
    del made
    assert toxicity._lexicon(("bad",), ("wor",)) is toxicity._lexicon(("bad",), ("wor",))
    assert gone() is None
    shared = type("Shared", (), {"value": [("1", "a b c")]})()
    gone = weakref.ref(toxicity._lexicon(("bad",), ("wor",)))
    assert decontaminate._tables(shared, 13, True) is decontaminate._tables(shared, 13, True)
    assert gone() is None


def test_packing_keeps_the_ids_of_open_sequences_only(monkeypatch):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    texts = ["x y " * (25_000 + i) for i in range(100)]
    tokens.encoder(tokenizer("word_bpe_49k.json"))
    held, covered = 0, 0
    tracemalloc.start()
    for out in packing._pack(tokenizer("word_bpe_49k.json"), 2, 4096, 4096)(pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in enumerate(texts)):
        held = max(held, tracemalloc.get_traced_memory()[0])
        covered += sum(out.column("length").to_pylist())
    tracemalloc.stop()
    plain = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    n = len(plain.encode(texts[0], add_special_tokens=False).ids)
    assert covered >= 100 * (n + 1)
    assert held < 2 * n * 4 * len(texts) // 5  # before, all ids of all documents (4 n bytes each) stayed
