"""Repair of damaged conversations: an error-correcting Earley parser over the roles of a conversation.

The role grammar is left-linear, so that every chart item starts at the first row and a chart set holds a handful of
items whatever the length: ``C -> e | T``, ``T -> P a``, ``P -> u | S u | T u``, ``S -> s``; that is ``(s?(ua)+)?``. Error
productions delete a row, give it another role, or insert an empty row. Items keep the least (cost, audit).

Rows are sorted by range over the whole table, so a long conversation lies in several partitions. Conversations whole
within one are repaired at once. All others go on as blocks: each block is parsed from each of the grammar's four states
to each, and the blocks of a conversation are put together from these results. Both forms are exact: equally dear
audits over the same rows are never prefixes of one another (an insertion costs something, and all else consumes a
row), so their order does not depend on what follows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import save, shuffle_width

DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Productions of the role grammar; lower case letters are role initials.
GRAMMAR = {"C": ("", "T"), "T": ("Pa",), "P": ("u", "Su", "Tu"), "S": ("s",)}
#: A state of the grammar, and the chart item that stands for it; ``start``: nothing read, then the last role kept.
STATES = {"start": ("P", "u", 0), "s": ("P", "Su", 1), "u": ("T", "Pa", 1), "a": ("P", "Tu", 1)}
ENDS = ("start", "a")
NAMES = {"u": "user", "a": "assistant"}
#: What a block holds at most.
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 18
BLANKS = " \t\n\v\f\r"


class Chart:
    """The current set of an Earley chart: (rule, right side, dot) with the least (cost, audit) of each item."""

    def __init__(self, seeds: dict[tuple, tuple[int, str]]):
        self.items: dict[tuple, tuple[int, str]] = {}
        self.close(seeds)

    def close(self, found: dict[tuple, tuple[int, str]]) -> None:
        """Add items, what they predict and complete, and insertions, until nothing gets cheaper."""
        agenda = list(found.items())
        while agenda:
            item, value = agenda.pop()
            if item in self.items and self.items[item] <= value:
                continue
            self.items[item] = value
            rule, right, dot = item
            if dot == len(right):  # completed: all items that wait for the rule start at the first row, too
                agenda += [((lhs, r, 1), value) for lhs, rights in GRAMMAR.items() for r in rights if r[:1] == rule]
            elif right[dot] in GRAMMAR:
                if dot == 0:
                    agenda += [((right[0], r, 0), value) for r in GRAMMAR[right[0]]]
            elif right[dot] in NAMES:
                agenda.append(((rule, right, dot + 1), (value[0] + INSERT, value[1] + "I")))

    def step(self, row: str) -> Chart:
        """The set after one row: its role initial (x: another), upper case if truncated, or a run of ``d``, rows to delete."""
        found: dict[tuple, tuple[int, str]] = {}

        def offer(item, cost, audit):
            if item not in found or (cost, audit) < found[item]:
                found[item] = (cost, audit)

        drop, more = row[0] == "d", TRUNCATED * row.isupper()
        for item, (cost, audit) in self.items.items():
            rule, right, dot = item
            wants = right[dot] if dot < len(right) else ""
            if wants in GRAMMAR or not wants and rule != "C":
                continue
            offer(item, cost + DELETE * len(row), audit + "D" * len(row))
            if drop or not wants:
                continue
            if wants == row.lower():
                offer((rule, right, dot + 1), cost + more, audit + "K")
            elif wants in NAMES:
                offer((rule, right, dot + 1), cost + REROLE + more, audit + "R")
        return Chart(found)


@lru_cache(maxsize=1 << 15)
def parse(rows: str, state: str = "start") -> dict[str, tuple[int, str]]:
    """Least (cost, audit) from a state of the grammar to each one that these rows can lead to."""
    rule, right, dot = STATES[state]
    if state == "start":
        seeds = {("C", r, 0): (0, "") for r in GRAMMAR["C"]} | {(x, r, 0): (0, "") for x in "TPS" for r in GRAMMAR[x]}
    else:
        seeds = {("T", "Pa", 2): (0, "")} if state == "a" else {(rule, right, dot): (0, "")}
    chart = Chart(seeds)
    for row in re.findall("d+|.", rows):
        chart = chart.step(row)
    return {name: chart.items[item] for name, item in STATES.items() if item in chart.items}


def render(state: str, audit: str, roles: list[str], texts: list[str], copies: list[int]) -> list[str]:
    """The lines ``role:text`` that an audit keeps of these rows or inserts between them, from a state on."""
    out, rows = [], ((r, t) for r, t, n in zip(roles, texts, copies, strict=True) for _ in range(n))
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        wanted = "a" if state == "u" else "u"
        role, text = next(rows) if edit != "I" else (None, "")
        role = role if edit == "K" else NAMES[wanted]
        state = role[0]
        out.append(f"{role}:{text}")
    return out


def read_rows(turns, roles, texts, copies, seen) -> dict:
    """Faults, role pairs and turns of consecutive rows; ``seen(role, text)`` tells whether a row before had both, and notes it."""
    rows, blank, duplicate, truncated, illegal, last, first = [], 0, 0, 0, 0, None, None
    known = [t for t, n in zip(turns, copies, strict=True) if t is not None and n]
    for role, text, n in zip(roles, texts, copies, strict=True):
        if not n:
            continue
        kept = text.strip(BLANKS)
        again, initial = seen(role, text), role[:1]
        letter = initial if initial and initial in "sua" else "x"
        if not kept:
            blank += n
            rows.append("d" * n)
        else:
            cut = not again and kept[-1] not in ".!?"
            duplicate += n - (not again)
            truncated += cut
            rows.append("d" * n if again else (letter.upper() if cut else letter) + "d" * (n - 1))
        illegal += (last is not None and last + initial not in ("su", "ua", "au")) + (n - 1) * (initial + initial not in ("su", "ua", "au"))
        first, last = initial if first is None else first, initial
    return {"rows": "".join(rows), "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "first": first, "last": last, "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known))}


def joined(blocks) -> dict:
    """The result of a conversation from its blocks in order, each with ``read_rows`` of its rows; ``path``: a block's states."""
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    low = high = last = None
    ways = {"start": (0, "", None)}
    for b in blocks:
        for k in total:
            total[k] += b[k]
        total["illegal"] += last is not None and b["first"] is not None and last + b["first"] not in ("su", "ua", "au")
        total["turns"] -= high is not None and b["low"] == high
        last = last if b["last"] is None else b["last"]
        low, high = b["low"] if low is None else low, high if b["high"] is None else b["high"]
        after: dict[str, tuple] = {}
        for state, (cost, audit, path) in ways.items():
            for end, (more, part) in parse(b["rows"], state).items():
                new = (cost + more, audit + part)
                if end not in after or new < after[end][:2]:
                    after[end] = (*new, (path, state, end, part))
        ways = after
    cost, audit, path = min((ways[s] for s in ENDS if s in ways), key=lambda w: w[:2])
    steps = []
    while path:
        path, *step = path
        steps.append(tuple(step))
    gaps = 0 if low is None else high - low + 1 - total.pop("turns")
    total.pop("turns", None)
    return {"gaps": gaps, **total, "cost": cost, "audit": audit, "path": steps[::-1]}


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SORTED = "conv_key string, conv_id long, part int, seq int, open boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, turns array<long>, roles array<string>, texts array<string>, copies array<long>, digests array<string>"


def digest(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).hexdigest()


def sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def _noting(held: set):
    def seen(role, text):
        known = (role, text) in held
        held.add((role, text))
        return known

    return seen


def _batches(rows: list[dict], schema: pa.Schema, most: int = 500):
    for at in range(0, len(rows), most):
        yield pa.RecordBatch.from_pylist(rows[at : at + most], schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _sorted_rows(batches):
    """Repair conversations that lie whole within the partition; hand on blocks of all others."""
    from pyspark import TaskContext

    part, schema, out = TaskContext.get().partitionId(), _schema(SORTED), []
    key, first, begun, seq, held, chars = None, True, False, 0, [], 0  # seq: blocks of the partition so far

    def block():
        nonlocal begun, seq, held, chars
        _, ids, turns, roles, texts, copies = zip(*held, strict=True)
        out.append({"conv_key": key, "conv_id": ids[0], "part": part, "seq": seq, "open": True, "turns": turns, "roles": roles, "texts": texts, "copies": copies, "digests": [digest(r, t) for r, t in zip(roles, texts, strict=True)]})
        begun, seq, held, chars = True, seq + 1, [], 0

    def close(last):
        nonlocal held, chars
        if first or last or begun:
            if held:
                block()
            return
        _, ids, turns, roles, texts, copies = zip(*held, strict=True)
        got = joined([read_rows(turns, roles, texts, copies, _noting(set()))])
        out.append({"conv_key": key, "conv_id": ids[0], "part": part, "seq": seq, "open": False, **{k: got[k] for k in (*RESULT, "audit")}, "repaired_sha256": sha(render("start", got["audit"], roles, texts, copies))})
        held, chars = [], 0

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key:
                if key is not None:
                    close(False)
                    first = False
                key, begun = row[0], False
            if len(held) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                block()
            held.append(row)
            chars += len(row[4])
        yield from _batches(out, schema)
        out.clear()
    if key is not None:
        close(True)
    yield from _batches(out, schema)


READ = "conv_key string, conv_id long, part int, seq int, rows string, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def _read_blocks(batches):
    schema = _schema(READ)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            held, before = set(), set(row["repeated"] or ())

            def seen(role, text, held=held, before=before):
                known = (role, text) in held or digest(role, text) in before
                held.add((role, text))
                return known

            out.append({k: row[k] for k in ("conv_key", "conv_id", "part", "seq")} | read_rows(row["turns"], row["roles"], row["texts"], row["copies"], seen))
        yield from _batches(out, schema)


JOINED = "conv_key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<long>, seqs array<long>, states array<string>, audits array<string>"


def _by_conversation(batches, key_of="conv_key"):
    """Runs of rows of one conversation in a sorted partition."""
    held = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key_of] != row[key_of]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _join_blocks(batches):
    schema = _schema(JOINED)
    for blocks in _by_conversation(batches):
        got = joined(blocks)
        path = got.pop("path")
        row = {"conv_key": blocks[0]["conv_key"], "conv_id": blocks[0]["conv_id"], **got, "parts": [b["part"] for b in blocks], "seqs": [b["seq"] for b in blocks], "states": [p[0] for p in path], "audits": [p[2] for p in path]}
        yield from _batches([row], schema)


def _render_blocks(batches):
    schema = _schema("conv_key string, part int, seq int, n_lines long, lines string")
    for batch in batches:
        for row in batch.to_pylist():
            lines = render(row["state"], row["audit"], row["roles"], row["texts"], row["copies"])
            yield from _batches([{"conv_key": row["conv_key"], "part": row["part"], "seq": row["seq"], "n_lines": len(lines), "lines": "\n".join(lines)}], schema)


def _hash_lines(batches):
    """One hash over the lines of all blocks of a conversation, updated block by block."""
    schema, key, state, any_line = _schema("conv_key string, repaired_sha256 string"), None, None, False
    for batch in batches:
        out = []
        for k, n, lines in zip(*(batch.column(c).to_pylist() for c in (0, 3, 4)), strict=True):
            if k != key:
                if key is not None:
                    out.append({"conv_key": key, "repaired_sha256": state.hexdigest()})
                key, state, any_line = k, hashlib.sha256(), False
            if n:
                state.update(("\n" * any_line + lines).encode("utf-8", "surrogatepass"))
                any_line = True
        yield from _batches(out, schema)
    if key is not None:
        yield from _batches([{"conv_key": key, "repaired_sha256": state.hexdigest()}], schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by ``crc32(conv_id:turn) % 20`` as (conv_key, conv_id, turn, role, text, copies); dropped ones have no copies.

    Equal rows are counted before anything else, so a row that is repeated a million times is one row here.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return counted.withColumn("kind", kind).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_key"),
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2 * F.col("copies")).otherwise(F.col("copies")).cast("long").alias("copies"),
        F.col("role").alias("role_before"),
        F.xxhash64("text").alias("h"),
    )


def repair(conversations: DataFrame, damage=damaged) -> DataFrame:
    """One row per conversation: faults, the cheapest edits that give roles ``(s?(ua)+)?``, and the hash of what they leave.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Rows of a conversation
    are taken by turn, null turns first; rows of one turn by role and a hash of their text. Null roles and texts are one
    space, so they are blank or must get another role; a null conv_id is a conversation of its own. An empty
    table gives no rows. ``damage`` maps the input to rows with copies; other columns of the input are left aside.

    The hash of a conversation is one sequence by definition: for conversations in several blocks one task reads the
    rendered blocks in order and holds one of them at a time.
    """
    spark = conversations.sparkSession
    width = shuffle_width(spark)
    rows = save(damage(conversations), "repair-rows")
    order = ["conv_key", "turn", "role_before", "h"]
    ranged = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).select("conv_key", "conv_id", "turn", "role", "text", "copies")
    all_rows = save(ranged.mapInArrow(_sorted_rows, SORTED), "repair-sorted")
    done = all_rows.where("not open").select("conv_id", *RESULT, "audit", "repaired_sha256")
    blocks = all_rows.where("open").select("conv_key", "conv_id", "part", "seq", "turns", "roles", "texts", "copies", "digests")
    digests = blocks.select("conv_key", "part", "seq", F.explode(F.array_distinct(F.transform(F.arrays_zip("digests", "copies"), lambda x: F.when(x["copies"] > 0, x["digests"])))).alias("digest")).where("digest is not null")
    first = save(digests.groupBy("conv_key", "digest").agg(F.min(F.struct("part", "seq")).alias("at")), "repair-first")
    repeated = digests.join(first, ["conv_key", "digest"]).where("struct(part, seq) > at").groupBy("part", "seq").agg(F.collect_list("digest").alias("repeated"))
    read = blocks.join(repeated, ["part", "seq"], "left").select("conv_key", "conv_id", "part", "seq", "turns", "roles", "texts", "copies", "repeated").mapInArrow(_read_blocks, READ)
    results = save(read.repartition(width, "conv_key").sortWithinPartitions("conv_key", "part", "seq").mapInArrow(_join_blocks, JOINED), "repair-joined")
    steps = results.select(F.explode(F.arrays_zip("parts", "seqs", "states", "audits")).alias("s")).select(F.col("s.parts").cast("int").alias("part"), F.col("s.seqs").cast("int").alias("seq"), F.col("s.states").alias("state"), F.col("s.audits").alias("audit"))
    lines = blocks.join(steps, ["part", "seq"]).select("conv_key", "part", "seq", "state", "audit", "roles", "texts", "copies").mapInArrow(_render_blocks, "conv_key string, part int, seq int, n_lines long, lines string")
    hashes = lines.repartition(width, "conv_key").sortWithinPartitions("conv_key", "part", "seq").mapInArrow(_hash_lines, "conv_key string, repaired_sha256 string")
    return done.unionByName(results.join(hashes, "conv_key").select("conv_id", *RESULT, "audit", "repaired_sha256"))
