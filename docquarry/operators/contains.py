"""Which of many texts contain which of many terms: an index of three-character runs, each match checked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.scratch import save

SIZE = 3
#: Rows that a task hands on at a time.
ROWS = 200_000
#: Characters of all distinct terms up to which every task holds them, and of texts that it looks through together.
HELD, BLOCK = 1_000_000, 1 << 20
#: Rows that a term's block of texts makes with all ids of the term.
MADE = 10_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _runs(key: str, sizes: list[int] | None = None):
    """Distinct runs of characters of the second column: of each of ``sizes``, or of ``SIZE`` (of a shorter text, its whole)."""

    def run(frames):
        for f in frames:
            keys, grams = [], []
            for k, text in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True):
                found = {text[i : i + n] for n in sizes or [min(SIZE, len(text))] for i in range(len(text) - n + 1)}
                grams += found
                keys += [k] * len(found)
                if len(keys) >= ROWS:
                    yield pd.DataFrame({key: keys, "gram": grams})
                    keys, grams = [], []
            if keys:
                yield pd.DataFrame({key: keys, "gram": grams})

    return run


def askable(held: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term): the distinct terms that are no longer than the longest of the texts ``held``, as no other is in one of them."""
    longest = held.agg(F.max(F.length("text")).alias("longest"))
    short = terms.where("term <> ''").select("term").join(F.broadcast(longest), F.length("term") <= F.col("longest"))  # one row
    return short.select(F.md5("term").alias("key"), "term").distinct()


def _codes(chars: np.ndarray, n: int) -> np.ndarray:
    """The runs of ``n`` (1 to 3) characters of a text of code points, as numbers."""
    out = chars[: len(chars) - n + 1].astype(np.uint64)
    for i in range(1, n):
        out = out << np.uint64(21) | chars[i : len(chars) - n + 1 + i].astype(np.uint64)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _found_in(terms: list[str], proper: bool = False):
    """(id, term) of the rows (id, text) whose text contains one of ``terms``, or is longer, too, if ``proper``; texts are looked through once.

    Of a block of texts, each term is sought in those that have its run that is rarest there.
    """
    kinds = []
    for n in {min(SIZE, len(t)) for t in terms}:
        some = [t for t in terms if min(SIZE, len(t)) == n]
        runs = [np.unique(_codes(_points(t), n)) for t in some]
        wanted = np.unique(np.concatenate(runs))
        slots = np.full(1 << 16, -1, np.int32)
        slots[wanted * MIX >> np.uint64(48)] = np.arange(len(wanted))
        kinds.append((n, some, wanted, slots, np.searchsorted(wanted, np.concatenate(runs)), np.cumsum([0, *map(len, runs)])))

    def hits(texts: list[str]):
        """Texts and terms, by number, that are to be tried."""
        chars, start = _points("".join(texts)), np.cumsum([0, *map(len, texts)])
        for n, some, wanted, slots, runs, begin in kinds:
            codes = _codes(chars, n) if len(chars) >= n else np.zeros(0, np.uint64)
            gram = slots[codes * MIX >> np.uint64(48)]
            at = np.flatnonzero(gram >= 0)
            gram, codes = gram[at].astype(np.int64), codes[at]
            other = np.flatnonzero(wanted[gram] != codes)  # runs that share a slot
            gram[other] = np.minimum(np.searchsorted(wanted, codes[other]), len(wanted) - 1)
            real = wanted[gram] == codes
            at, gram = at[real], gram[real]
            count = np.bincount(gram, minlength=len(wanted))
            key = count[runs] * len(wanted) + runs
            rarest = np.minimum.reduceat(key, begin[:-1]) % len(wanted)
            chosen = np.zeros(len(wanted), bool)
            chosen[rarest] = True
            keep = chosen[gram]
            pair = np.unique(gram[keep] * len(texts) + np.searchsorted(start, at[keep], "right") - 1)
            ends = np.searchsorted(pair, np.arange(len(wanted) + 1) * len(texts))
            for term, g in zip(some, rarest, strict=True):
                yield term, (pair[ends[g] : ends[g + 1]] - g * len(texts)).tolist()

    def run(frames):
        for f in frames:
            length, at = f.iloc[:, 1].str.len().to_numpy().cumsum(), 0
            while at < len(f):
                end = max(at + 1, int(np.searchsorted(length, (length[at - 1] if at else 0) + BLOCK, "right")))
                ids, texts = f.iloc[at:end, 0].to_numpy(), f.iloc[at:end, 1].tolist()
                rows, named = [], []
                for term, near in hits(texts):
                    found = [i for i in near if term in texts[i] and not (proper and term == texts[i])]
                    rows += found
                    named += [term] * len(found)
                    if len(rows) >= ROWS:
                        yield pd.DataFrame({"id": ids[rows], "term": named})
                        rows, named = [], []
                if rows:
                    yield pd.DataFrame({"id": ids[rows], "term": named})
                at = end

    return run


def _pairs(held: DataFrame, terms: DataFrame, most: int, proper: bool) -> DataFrame | None:
    """Distinct (id, term) of the texts ``held`` that contain a term, written down; None if no term can be in a text."""
    asked = save(askable(held, terms), "terms")
    if (asked.agg(F.sum(F.length("term")).alias("n")).first().n or 0) <= most:
        few = [r.term for r in asked.select("term").collect()]
        return save(held.mapInPandas(_found_in(few, proper), "id long, term string").distinct(), "pairs") if few else None
    sizes = sorted(r.n for r in asked.select(F.least(F.lit(SIZE), F.length("term")).alias("n")).distinct().collect())
    runs = save(asked.mapInPandas(_runs("key"), "key string, gram string"), "runs")
    postings = held.mapInPandas(_runs("id", sizes), "id long, gram string")
    counts = postings.join(runs.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = runs.join(counts, "gram").groupBy("key").agg(F.min(F.struct("n", "gram")).alias("x"), F.count(F.lit(1)).alias("found"))
    whole = runs.groupBy("key").agg(F.count(F.lit(1)).alias("all"))  # a term with a run that no text has is in none
    rarest = save(rarest.join(whole, "key").where(F.col("found") == F.col("all")).select("key", "x.gram"), "rarest")
    near = postings.join(rarest, "gram").select("id", "key").distinct()
    inside = F.contains("text", "term") & (F.col("text") != F.col("term")) if proper else F.contains("text", "term")
    return save(held.join(near, "id").join(asked, "key").where(inside).select("id", "term").distinct(), "pairs")


def _rows(texts: DataFrame, terms: DataFrame, most: int, proper: bool = False) -> DataFrame:
    """(id, term_id) of ``contained``, which come more than once only where a term_id has several terms.

    A term may have many ids and be in many texts: its texts are dealt into blocks that make about ``MADE`` rows each.
    """
    held = texts.where("id is not null and text is not null and text <> ''").select(F.col("id").cast("long").alias("id"), "text")
    pairs = _pairs(held, terms, most, proper)
    if pairs is None:
        return texts.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("term_id")).limit(0)
    hit = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ids = save(terms.join(hit, "term", "left_semi").select(F.col("term_id").cast("long").alias("term_id"), "term").distinct(), "ids")
    size = save(ids.groupBy("term").agg(F.count(F.lit(1)).alias("m")).join(hit, "term").select("term", (F.col("n") * F.col("m")).alias("made"), F.ceil(F.col("n") * F.col("m") / MADE).cast("int").alias("blocks")), "sizes")
    parts = -(-int(size.agg(F.sum("made").alias("n")).first().n or 0) // MADE)
    dealt = lambda df: df.repartition(parts, "term", "block") if parts > 1 else df
    spread = pairs.join(size, "term").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "term", "block")
    named = ids.join(size, "term").select("term_id", "term", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return dealt(spread).join(dealt(named), ["term", "block"]).select("id", "term_id")


def _lone(rows: DataFrame, key: str) -> bool:
    """Whether no value of ``key`` comes twice."""
    return not rows.groupBy(key).count().where("count > 1").take(1)


def contained(texts: DataFrame, terms: DataFrame, most: int = HELD) -> DataFrame:
    """Distinct (id, term_id) of ``texts(id, text)`` that contain a term of ``terms(term_id, term)``, letter for letter.

    Distinct terms of up to ``most`` characters together are held by every task, which looks through its texts once and
    hands on what is found. Of more, each term is looked up by one run of its characters, the one that the fewest texts have
    (terms of one or two characters by themselves), so a term meets only texts that have its rarest run, and only their ids are shuffled before.
    Runs go with a key of their term, not with the term, which may be a whole text. Empty terms and null values match
    nothing; ids are whole numbers.
    """
    rows = _rows(texts, terms, most)
    return rows if _lone(terms, "term_id") else rows.distinct()


def either_way(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct (id, term_id) where the text contains the term or the term contains the text.

    Where no id comes twice, no pair is found twice, as equal strings are left to the first way: nothing is compared again.
    """
    back = _rows(terms.select(F.col("term_id").alias("id"), F.col("term").alias("text")), texts.select(F.col("id").alias("term_id"), F.col("text").alias("term")), HELD, True)
    rows = _rows(texts, terms, HELD).unionByName(back.select(F.col("term_id").alias("id"), F.col("id").alias("term_id")))
    return rows if _lone(texts, "id") and _lone(terms, "term_id") else rows.distinct()
