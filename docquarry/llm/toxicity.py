"""Toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learnt: words, and stems that begin many words, which stand far more often in toxic than in other
labelled documents. It is kept as a trie. Every distinct word is run
against the trie by a Levenshtein automaton (its state is the row of least edit counts, a branch dies when no
entry below it can be reached), so that misspelled terms are found too. Each occurrence gets a context window that tells
quotation from abuse. Logistic regression turns the counts into a score; it sees nothing but the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import drop, ints, kept, released, save, text_slices

WORD = re.compile(r"\w+")
QUOTES = "\"'“”„«»‘’"
#: Fixed cues of reported speech and of address.
REPORTS = {"said", "says", "called", "quoted", "wrote", "dit", "sagte", "dijo", "word", "term"}
ADDRESS = {"you", "your", "youre", "u", "tu", "vous", "du", "dich", "ihr", "tú", "usted"}
#: Words without a match that a worker keeps.
KNOWN_WORDS = 200_000
#: Letters of words that may be entries, and of stems.
WORD_SIZES, STEM_SIZES = (3, 60), range(4, 9)
FEATURES = ("exact", "stem", "fuzzy", "quoted", "addressed", "density")


def _by_length(parts) -> list[tuple[int, set[str]]]:
    out: dict[int, set[str]] = {}
    for x in parts:
        out.setdefault(len(x), set()).add(x)
    return sorted(out.items())


class Lexicon:
    """A trie of words and stems, searched with at most one edit for words of five letters or more."""

    def __init__(self, words: list[str], stems: list[str]):
        self.trie: dict = {}
        for w in words:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.words, self.stems = set(words), tuple(stems)
        self.starts = _by_length(stems)
        # of two halves of an entry one edit leaves one whole, at its end of a word one letter longer or shorter at most
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for w in words:
            if len(w) >= 5:
                self.heads.setdefault(len(w), set()).add(w[: len(w) // 2])
                self.tails.setdefault(len(w), set()).add(w[len(w) // 2 :])
        self.matched: dict[str, int] = {}
        self.hits: set[str] = set()
        self.clean: set[str] = set()

    def may_match(self, word: str) -> bool:
        for n in range(len(word) - 1, len(word) + 2):
            if n in self.heads and (word[: n // 2] in self.heads[n] or word[n // 2 - n :] in self.tails[n]):
                return True
        return False

    def within(self, word: str, edits: int) -> bool:
        """Whether the automaton of ``word`` accepts an entry of the trie.

        Its states are bits: bit i of ``reached[e]`` says that i letters of the word were read with at most e edits.
        """
        last = 1 << len(word)
        letters: dict[str, int] = {}
        for i, c in enumerate(word):
            letters[c] = letters.get(c, 0) | 1 << i

        def walk(node: dict, reached: list[int]) -> bool:
            if reached[-1] & last and len(node.get("", "")) >= 5:
                return True
            for c, below in node.items():
                if c:
                    same = letters.get(c, 0)
                    new = [(reached[0] & same) << 1]
                    for e in range(1, edits + 1):
                        new.append((reached[e] & same) << 1 | reached[e - 1] | reached[e - 1] << 1 | new[e - 1] << 1)
                    if new[-1] and walk(below, new):
                        return True
            return False

        return walk(self.trie, [(2 << e) - 1 for e in range(edits + 1)])

    def kind(self, word: str) -> int:
        """0 none, 1 exact, 2 stem, 3 within one edit."""
        if word in self.words:
            return 1
        if any(word[:n] in x for n, x in self.starts):
            return 2
        return 3 if 4 <= len(word) <= WORD_SIZES[1] + 1 and self.may_match(word) and self.within(word, 1) else 0

    def matches(self, words: set[str]) -> set[str]:
        """Those of ``words`` that match; each is looked up once, as long as it is kept."""
        if len(self.clean) > KNOWN_WORDS:
            self.clean = set()
        if len(self.matched) > KNOWN_WORDS:
            self.matched, self.hits = {}, set()
        new = words - self.clean
        for w in new - self.hits:
            if k := self.kind(w):
                self.matched[w] = k
                self.hits.add(w)
            else:
                self.clean.add(w)
        return new & self.hits

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        low = text.lower()
        hits = self.matches(set(WORD.findall(low)))
        if not hits:
            return out
        found = {w: self.matched[w] for w in hits}
        n = 0
        for m in WORD.finditer(low):
            n += 1
            k = found.get(m[0])
            if k:
                before, after = low[max(0, m.start() - 40) : m.start()], low[m.end() : m.end() + 40]
                near = set(WORD.findall(before)) | set(WORD.findall(after))
                quoted = before.rstrip()[-1:] in QUOTES and before.strip() != "" and after.lstrip()[:1] in QUOTES and after.strip() != ""
                out[k - 1] += 1
                out[3] += quoted or bool(near & REPORTS)
                out[4] += bool(near & ADDRESS) or "!" in after[:20]
        return np.append(np.log1p(out[:5]), 10 * out[:3].sum() / n)


def _lexicon(words: list[str], stems: list[str]) -> Lexicon:
    """One lexicon for all tasks of a worker, with the words it has looked up."""
    return kept(("lexicon", words, stems), lambda: Lexicon(words, stems))


def _in_fold(folds: int, held: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held


def _entries(word: str) -> list[tuple[int, str]]:
    """What a word counts for: itself (0, word) and its stems (1, stem)."""
    found = [(0, word)] if WORD_SIZES[0] <= len(word) <= WORD_SIZES[1] else []
    return found + [(1, word[:k]) for k in STEM_SIZES if len(word) > k]


#: Where a text is divided into segments, which count once however often they come.
SEGMENT = r"[.!?\n]+"


def _texts(batches, most: int = 1 << 20):
    """The words of the segments of each slice."""
    for batch in released(batches):
        for at, rows, _, _ in text_slices(batch, "segment", most):
            yield [WORD.findall(t) for t in batch.column(batch.schema.get_field_index("segment")).slice(at, rows).to_pylist()]


def _uses(shared):
    """In how many segments of each slice an entry is; with ``shared``, of its entries only. Entry (2, '') counts all words."""

    def run(batches):
        only = shared.value if shared else None
        for texts in _texts(batches):
            words = Counter(w for t in texts for w in set(t))
            of_stem: Counter = Counter({(2, ""): sum(map(len, texts))})
            for w, n in words.items():
                for e in _entries(w):
                    if only is None or e in only:
                        of_stem[e] += n
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in of_stem], pa.int32()), pa.array([w for _, w in of_stem]), pa.array(list(of_stem.values()), pa.int64())], ["kind", "w", "n"])

    return run


def unlikely(t: int, f: int, p: float) -> float:
    """Probability that of t + f occurrences, each toxic with probability p, t or more are."""
    n, term, total = t + f, math.exp(math.lgamma(t + f + 1) - math.lgamma(t + 1) - math.lgamma(f + 1) + t * math.log(p) + f * math.log1p(-p)), 0.0
    for k in range(t, n + 1):
        total += term
        if term <= total * 1e-12:
            break
        term *= (n - k) / (k + 1) * p / (1 - p)
    return total


def learn_lexicon(train: DataFrame, odds: float = 20.0, least: int = 4, chance: float = 1e-4) -> Lexicon:
    """Words and stems of ``train(text, toxic)`` which are ``odds`` times likelier in toxic texts.

    What is counted is not documents but distinct segments, between sentence ends and line ends: a text with many copies, or
    a passage that all texts share, counts once in the toxic and once in the other texts, and texts are never merged. (A stem
    counts once for each of its words in a segment.) An entry needs ``least`` toxic segments, and that they are toxic by chance
    must be no likelier than ``chance``. The driver gets counts of entries of the labelled sample, which ``train`` bounds.
    """
    segments = train.select("toxic", F.explode(F.split(F.lower("text"), SEGMENT)).alias("segment")).select("toxic", F.trim("segment").alias("segment")).where("segment <> ''").distinct()
    counted = lambda x, shared: segments.where(F.col("toxic") == x).select("segment").mapInArrow(_uses(shared), "kind int, w string, n long").groupBy("kind", "w").agg(F.sum("n").alias("n"))
    bad = {(r.kind, r.w): r.n for r in counted(1, None).where((F.col("n") >= least) | (F.col("kind") == 2)).collect()}
    fine = {(r.kind, r.w): r.n for r in counted(0, train.sparkSession.sparkContext.broadcast(set(bad))).collect()}
    n = {0: fine.pop((2, ""), 0), 1: bad.pop((2, ""), 0)}
    if not n[0] or not n[1]:
        return Lexicon([], [])
    ratio = lambda t, f: (t + 0.5) / (f + 0.5) * (n[0] / n[1])
    p = n[1] / (n[0] + n[1])
    kept = [e for e, t in bad.items() if ratio(t, fine.get(e, 0)) >= odds and unlikely(t, fine.get(e, 0), p) <= chance]
    found, stems = (sorted(w for k, w in kept if k == kind) for kind in (0, 1))
    shortest: list[str] = []
    for s in sorted(stems, key=lambda x: (len(x), x)):
        if not s.startswith(tuple(shortest)) and not any(w.startswith(s) for w in found if len(w) - len(s) <= 1):
            shortest.append(s)
    return Lexicon(found, shortest)


def _score(shared, first: str = "doc_id"):
    """The column ``first``, the score and the features of each row."""

    def run(batches):
        words, stems, weights = shared.value
        lexicon = _lexicon(words, stems)
        for batch in released(batches):
            ids, text = ints(batch, first), batch.column(batch.schema.get_field_index("text"))
            for at, rows, _, _ in text_slices(batch, "text"):
                x = np.stack([lexicon.features(t or "") for t in text.slice(at, rows).to_pylist()])
                z = x @ weights[1:] + weights[0]
                cols = [pa.array(x[:, i]) for i in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, rows), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), *cols], [first, "score", *FEATURES])

    return run


SCHEMA = "doc_id long, score double, " + ", ".join(f"{f} double" for f in FEATURES)


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression with a ridge by Newton's method; the first weight is the bias."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    keep = np.full(len(w), ridge)
    keep[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), a.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray):
        self.words, self.stems, self.weights = words, stems, weights

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score (0 to 1) and the features of each row of ``docs(doc_id, text)``; null texts count as empty."""
        shared = docs.sparkSession.sparkContext.broadcast((self.words, self.stems, self.weights))
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared), SCHEMA)

    def keep(self, docs: DataFrame, threshold: float) -> DataFrame:
        """The rows of ``docs`` whose score is below ``threshold``; all columns stay."""
        shared = docs.sparkSession.sparkContext.broadcast((self.words, self.stems, self.weights))

        def run(batches):
            inner = _score(shared)
            for batch in batches:
                scores = [s for out in inner(iter([batch])) for s in out.column("score").to_pylist()]
                if scores:
                    yield batch.filter(pa.array([s < threshold for s in scores]))

        return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most: int = 50_000) -> Model:
    """Learn from labelled rows outside of the held-out fold, crc32(doc_id as text) mod ``folds`` = ``held``.

    The lexicon and the regression take at most ``most`` labelled ids (least hashes first), which bounds what is
    broadcast (the ids), shuffled (their texts) and collected (their features), whatever the size of ``docs``.
    Labels that are null or not 0 or 1 are left out; of contradicting labels of one id the toxic one counts, of several
    rows of one id the least text. Without labels of both kinds the model scores
    all documents by the share of toxic labels, without any label as 0.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~_in_fold(folds, held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = save(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    lexicon = learn_lexicon(rows)
    words, stems = sorted(lexicon.words), list(lexicon.stems)
    shared = docs.sparkSession.sparkContext.broadcast((words, stems, np.zeros(len(FEATURES) + 1)))
    got = rows.select("toxic", "text").mapInArrow(_score(shared, "toxic"), SCHEMA.replace("doc_id", "toxic")).select("toxic", *FEATURES).collect()
    drop(rows)
    if not got:
        return Model(words, stems, np.array([-30.0] + [0.0] * len(FEATURES)))
    table = np.array([tuple(r) for r in got], float)
    return Model(words, stems, fit_weights(table[:, 1:], table[:, 0]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 where the score reaches ``threshold``), features.

    Null and empty texts get the score of a text without hits; repeated rows and null ids are scored as often as they come.
    """
    scored = train(docs, labels, folds, held).score(docs)
    return scored.select("doc_id", F.coalesce(_in_fold(folds, held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FEATURES)
