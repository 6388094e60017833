"""Substring dedup by content-defined chunking.

A gear rolling hash over the 16 bytes from a unit on (a word, or a character of a script without spaces) decides whether a
chunk begins there; as nothing but these bytes decides, an insertion shifts no later border. A chunk's digest covers its
``SPAN`` first units, with what follows it where it is shorter, so that two texts with one digest agree over that stretch.
A digest belongs to the least document that has it. In another document, copied chunks are put together only where
they have one owner and their places advance there as they do here: what lies between is then compared, too. The ends of such
a run are compared unit by unit with what stands beside it in the owner. A run of ``least`` units or more is a
passage that the owner holds in one piece, and is cut from all documents but the owner.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import textkit
from docquarry.llm.common import bit_table, drop, in_bits, ints, maybe_in, released, save, shuffle_width, text_slices
from docquarry.llm.tokens import keys

NONE = np.iinfo(np.int64).max
#: Units that a digest covers; units beside a chunk that are compared; bytes that decide on a border.
SPAN, BESIDE, WINDOW = 24, 20, 16


def chunks(data: np.ndarray, offs: np.ndarray, every: int) -> tuple[np.ndarray, ...]:
    """Of all texts: unit starts, 64 bits of each unit, where each text's units begin, units that begin a chunk, and their digests.

    A chunk begins at a unit whose gear hash is under 2^32 / ``every``, if its text has ``SPAN`` units from there on.
    """
    n = len(data)
    texts = offs[:-1][np.diff(offs) > 0]
    spaced = textkit.SPACED[data]
    unit = spaced.copy()
    unit[1:] &= ~spaced[:-1] | (data[1:] >= 0xE3)
    first = np.zeros(n, bool)
    first[texts] = True
    unit |= first & spaced
    starts = np.flatnonzero(unit)
    of_text = np.searchsorted(starts, offs)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), of_text, starts, np.zeros(0, np.uint64)
    word_ends = np.flatnonzero(spaced & ~np.append(spaced[1:], False)) + 1
    text_ends = np.repeat(offs[1:], np.diff(of_text))
    ends = np.minimum(np.minimum(np.append(starts[1:], n), text_ends), word_ends[np.searchsorted(word_ends, starts, "right")])
    hashes = keys(data, starts, ends)[0]
    decides = starts + WINDOW - 1
    may = (decides < text_ends) & (np.arange(len(starts)) + SPAN <= np.repeat(of_text[1:], np.diff(of_text)))
    at = np.flatnonzero(may)
    at = at[textkit.gear(data)[decides[at]] < np.uint32((1 << 32) // every)]
    sums = np.zeros(len(at), np.uint64)
    for k in range(SPAN):
        sums += hashes[at + k] * textkit.STEP[k]
    return starts, hashes, of_text, at, textkit.mix(sums)


def codes(hashes: np.ndarray) -> np.ndarray:
    """Units in 16 bits, never 0."""
    return (hashes % np.uint64(65_535) + np.uint64(1)).astype(np.uint16)


def beside(code: np.ndarray, first: np.ndarray, step: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The codes of ``BESIDE`` units from unit ``first`` on by ``step`` (-1: backwards), one row each; 0 outside of ``low`` to ``high``."""
    at = first[:, None] + np.arange(BESIDE) * step
    inside = (at >= low[:, None]) & (at < high[:, None])
    return np.where(inside, code[np.clip(at, 0, max(len(code) - 1, 0))] if len(code) else 0, 0).astype(np.uint16)


def agreeing(one: np.ndarray, other: np.ndarray) -> int:
    """How many codes agree, from the first on."""
    n = min(len(one), len(other))
    differ = np.flatnonzero(one[:n] != other[:n])
    return int(differ[0]) if len(differ) else n


def _scatter(every: int, buckets: int):
    """Distinct digests of each slice with their least and greatest document, packed by bucket of the digest."""

    def run(batches):
        for batch in released(batches):
            ids = ints(batch, "doc_id").fill_null(NONE).to_numpy()
            for at, rows, data, offs in text_slices(batch, "text"):
                _, _, of_text, begins, digest = chunks(data, offs, every)
                if not len(digest):
                    continue
                doc = ids[at : at + rows][np.searchsorted(of_text, begins, "right") - 1]
                order = np.lexsort((doc, digest))
                head = np.flatnonzero(np.append(True, digest[order][1:] != digest[order][:-1]))
                own = order[head]
                columns = (digest[own], doc[own], doc[order][np.append(head[1:], len(doc)) - 1])
                bucket = (columns[0] % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                columns = [x[order] for x in columns]
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[cut[p] : cut[p + 1]].tobytes() for p in full], pa.binary()) for x in columns)], ["p", *PACKED])

    return run


PACKED = ("digests", "low", "high")


def _gather(batches):
    """The digests that more than one document has, with the least of them."""
    held, bucket = [], None

    def close():
        digest, low, high = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate((np.uint64, np.int64, np.int64)))
        order = np.lexsort((low, digest))
        digest, low, high = digest[order], low[order], high[order]
        head = np.flatnonzero(np.append(True, digest[1:] != digest[:-1]))
        many = head[low[head] < np.maximum.reduceat(high, head)]
        return pa.RecordBatch.from_arrays([pa.array(digest[many].view(np.int64)), pa.array(low[many])], ["digest", "owner"])

    for batch in batches:
        for p, *parts in zip(*(batch.column(i) for i in range(1 + len(PACKED))), strict=True):
            if bucket is not None and p.as_py() != bucket:
                yield close()
                held = []
            bucket = p.as_py()
            held.append([x.as_py() for x in parts])
    if held:
        yield close()


def _hits(every: int, shared, owners):
    """Of each slice the digests that may be shared, once each: documents, text keys and places that have them, and of the
    least document, if it may own any digest, what stands beside the chunk there."""

    def run(batches):
        for batch in released(batches):
            ids, text_keys = ints(batch, "doc_id").fill_null(NONE).to_numpy(), ints(batch, "key").to_numpy()
            for at, rows, data, offs in text_slices(batch, "text"):
                _, hashes, of_text, begins, digest = chunks(data, offs, every)
                hit = in_bits(shared.value, digest.view(np.int64))
                begins, digest = begins[hit], digest[hit]
                if not len(digest):
                    continue
                text = np.searchsorted(of_text, begins, "right") - 1
                doc, place = ids[at : at + rows][text], begins - of_text[text]
                order = np.lexsort((place, doc, digest))
                cut = np.append(np.flatnonzero(np.append(True, digest[order][1:] != digest[order][:-1])), len(digest))
                low = order[cut[:-1]]
                code, key = codes(hashes), text_keys[at : at + rows]
                owns = in_bits(owners.value, doc[low])
                own = low[owns]
                limits = of_text[text[own]], of_text[text[own] + 1]
                sides = np.hstack([beside(code, begins[own] - 1, -1, *limits), beside(code, begins[own] + SPAN, 1, *limits)])
                packed = np.full(len(low), None, object)
                packed[owns] = [x.tobytes() for x in sides]
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[order])) for x in (doc, key[text], place)]
                yield pa.RecordBatch.from_arrays([pa.array(digest[low].view(np.int64)), pa.array(doc[low]), pa.array(place[low]), pa.array(packed, pa.binary()), *lists], ["digest", "low", "low_place", "sides", "docs", "keys", "places"])

    return run


RUN = "doc long, key long, owner long, u0 int, u1 int, first long, last long"


def runs_of(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(owner, first unit, end, first digest, last digest) of runs of copied chunks (unit, owner, place there, digest)."""
    out: list[list[int]] = []
    line = None
    for owner, _, u, digest in sorted((o, p - u, u, d) for u, o, p, d in hits):
        if line == (owner, _) and u <= out[-1][2]:
            out[-1][2], out[-1][4] = u + SPAN, digest
        else:
            out.append([owner, u, u + SPAN, digest, digest])
        line = (owner, _)
    return [tuple(r) for r in out]


def _runs(batches):
    for batch in batches:
        out = []
        for doc, key, hits in zip(*(batch.column(i) for i in range(3)), strict=True):
            flat = hits.values.flatten()
            out += [(doc.as_py(), key.as_py(), *r) for r in runs_of(list(zip(*(x.to_pylist() for x in flat), strict=True)))]
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (3, 4) else pa.int64()) for i, c in enumerate(columns)], ["doc", "key", "owner", "u0", "u1", "first", "last"])


def _text_key():
    """What tells texts of one id apart. Spark takes it, so that no stage needs a second Python worker beside that of the passages."""
    return F.xxhash64("text")


def _found(docs: DataFrame, every: int, buckets: int | None) -> DataFrame:
    """(doc, key, runs): the runs of copied chunks of each text that has any, each with its owner and what is beside it there."""
    width = shuffle_width(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = plain.mapInArrow(_scatter(every, buckets or 4 * width), "p int, " + ", ".join(f"{c} binary" for c in PACKED))
    shared = save(packed.repartition(width, "p").sortWithinPartitions("p").mapInArrow(_gather, "digest long, owner long"), "shared")
    tables = sc.broadcast(bit_table(shared, "digest")), sc.broadcast(bit_table(shared.select("owner").distinct(), "owner"))
    maybe = plain.withColumn("key", _text_key()).mapInArrow(_hits(every, *tables), "digest long, low long, low_place long, sides binary, docs array<long>, keys array<long>, places array<long>")
    hits = save(maybe.join(shared, "digest"), "hits")
    own = save(hits.where("low = owner and sides is not null").select("digest", F.col("low_place").alias("p"), "sides").dropDuplicates(["digest"]), "sides")
    each = hits.select("digest", "owner", "docs", "keys", "places").join(own.select("digest", "p"), "digest").select("digest", "owner", "p", F.explode(F.arrays_zip("docs", "keys", "places")).alias("x")).where("x.docs > owner")
    grouped = each.groupBy(F.col("x.docs").alias("doc"), F.col("x.keys").alias("key")).agg(F.collect_set(F.struct(F.col("x.places").alias("u"), "owner", "p", "digest")).alias("hits"))
    runs = save(grouped.mapInArrow(_runs, RUN), "runs")
    before = own.select(F.col("digest").alias("first"), F.substring("sides", 1, 2 * BESIDE).alias("before"))
    after = own.select(F.col("digest").alias("last"), F.substring("sides", 2 * BESIDE + 1, 2 * BESIDE).alias("after"))
    ended = runs.join(before, "first").join(after, "last")
    found = save(ended.groupBy("doc", "key").agg(F.collect_list(F.struct("owner", "u0", "u1", "before", "after")).alias("runs")), "copies")
    drop(shared, hits, own, runs)
    return found


def spans_of(size: int, units: np.ndarray, code: np.ndarray, least: int, runs: list[tuple]) -> tuple[list[tuple[int, int]], set[int]]:
    """Byte spans of the passages of a text of ``size`` bytes that others hold, and those owners; from its units and ``_found`` runs."""
    found, owners = [], set()
    for owner, a, b, before, after in runs:
        a -= agreeing(code[max(0, a - BESIDE) : a][::-1], np.frombuffer(before, np.uint16))
        b += agreeing(code[b : b + BESIDE], np.frombuffer(after, np.uint16))
        if b - a >= least:
            found.append((a, b))
            owners.add(owner)
    spans: list[tuple[int, int]] = []
    for a, b in sorted(found):
        first, last = int(units[a]), int(units[b]) if b < len(units) else size
        if spans and first <= spans[-1][1]:
            first, last = spans[-1][0], max(last, spans.pop()[1])
        spans.append((first, last))
    return spans, owners


def _cut_at_once(texts: list[bytes], every: int, most: int = 2 << 20):
    """(unit starts, unit codes) of each text; those of up to ``most`` bytes together are cut at once."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        offs = np.cumsum([0, *map(len, texts[at:end])])
        units, hashes, of_text, _, _ = chunks(np.frombuffer(b"".join(texts[at:end]), np.uint8), offs, every)
        code = codes(hashes)
        for i in range(end - at):
            u = slice(of_text[i], of_text[i + 1])
            yield units[u] - offs[i], code[u]
        at = end


def _spans(every: int, least: int):
    """Byte spans of the repeated passages of each text, from its runs; only texts with runs are cut into units."""

    def run(frames):
        for f in released(frames):
            out = []
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in f.text]
            units = _cut_at_once([t for t, r in zip(texts, f.dq_runs, strict=True) if r is not None], every)
            for doc_id, raw, runs in zip(f.doc_id, texts, f.dq_runs, strict=True):
                spans, owners = ([], ()) if runs is None else spans_of(len(raw), *next(units), least, [(int(r["owner"]), int(r["u0"]), int(r["u1"]), bytes(r["before"]), bytes(r["after"])) for r in runs])
                out.append((doc_id, len(raw), [a for a, _ in spans], [b for _, b in spans], sorted(owners)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "span_starts", "span_ends", "first_docs"]).astype({"doc_id": "Int64"})

    return run


def _matched(docs: DataFrame, every: int, buckets: int | None) -> DataFrame:
    """``docs`` with the runs of each row (dq_runs); rows that repeat share them. Texts of documents without runs are not shuffled."""
    found = _found(docs, every, buckets).select(F.col("doc").alias("dq_doc"), F.col("key").alias("dq_key"), F.col("runs").alias("dq_runs"))
    named = docs.withColumn("dq_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NONE))))
    maybe = maybe_in(named, found.select(F.col("dq_doc").alias("dq_id")).distinct(), "dq_id")
    some = maybe.where("dq_maybe").drop("dq_maybe").select(*docs.columns, "dq_id")
    keyed = some.withColumn("dq_text_key", _text_key())
    held = keyed.join(found, (keyed["dq_id"] == found["dq_doc"]) & (keyed["dq_text_key"] == found["dq_key"]), "left").select(*docs.columns, "dq_runs")
    rest = maybe.where("not dq_maybe").select(*docs.columns, F.lit(None).cast(held.schema["dq_runs"].dataType).alias("dq_runs"))
    return held.unionByName(rest)


def passages(docs: DataFrame, every: int = 4, least: int = 46, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, span_starts, span_ends, first_docs.

    Spans are the bytes of passages of ``least`` units or more that an earlier document (least doc_id; a null id counts as
    the last, so rows without an id are not compared with one another; rows that share
    an id are one document) holds in one piece; ``first_docs`` are those documents. A
    passage of 51 words shows no chunk, or a chunk more than ``BESIDE`` units from both ends, once in a thousand times;
    a unit beyond its end agrees by chance once in 65,535. Where a still earlier document holds 24 units or more of a passage's
    middle, those are its own; the parts before and after them are found if each shows ``least`` units with the 20 beside it. Texts of less than 24 units, null and empty ones have no chunks;
    what repeats within one document stays.
    """
    matched = _matched(docs.select("doc_id", "text"), every, buckets).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "dq_runs")
    return matched.mapInPandas(_spans(every, least), "doc_id long, n_bytes long, span_starts array<long>, span_ends array<long>, first_docs array<long>")


def cut(docs: DataFrame, every: int = 4, least: int = 46, buckets: int | None = None) -> DataFrame:
    """``docs`` with all repeated passages cut out of ``text`` (and ``n_chars``, where there is one, counted again).

    A row whose text is wholly made of repeated passages goes; rows without text stay as they are.
    """
    names, schema = docs.columns, docs.schema
    spans = _spans(every, least)

    def run(frames):
        for f in released(frames):
            texts, keep = [], []
            for s in spans(iter([f[["doc_id", "text", "dq_runs"]]])):
                for text, starts, ends in zip(f.text, s.span_starts, s.span_ends, strict=True):
                    raw, left, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
                    for a, b in zip(starts, ends, strict=True):
                        left.append(raw[at:a])
                        at = b
                    new = b"".join([*left, raw[at:]]).decode("utf-8", "surrogatepass")
                    texts.append(new if starts else text)
                    keep.append(not starts or bool(new.strip()))
            out = f[inner].copy()
            out.columns = names
            if "n_chars" in names:
                out["n_chars"] = [len(t) if t is not None and t != old else n for t, old, n in zip(texts, f.text, f.n_chars, strict=True)]
            out["text"] = texts
            yield out[np.array(keep, bool)] if len(out) else out

    # columns of the input that have a name of ours are set aside meanwhile
    inner = [f"input_{i}_dq" if c.startswith("dq_") else c for i, c in enumerate(names)]
    matched = _matched(docs.toDF(*inner), every, buckets).select(*inner, "dq_runs")
    return matched.mapInPandas(run, schema)
