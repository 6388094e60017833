"""Conversation repair against a plain search over all edits, with long conversations in many blocks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docquarry.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\v\f\r"


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """All of the contract's columns for one conversation, its rows in order; states by name, searched from the end."""
    rows = after_damage(rows)
    faults, seen = [], set()
    for _, role, text in rows:
        kept = text.strip(BLANKS)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    n = len(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def better(found):
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    names = {"u": "user", "a": "assistant"}
    after = None  # least (cost, audit, lines) of the rows from i on, by state
    for i in range(n, -1, -1):
        now = {}
        for state in follow:
            found = [(0, "", ())] if i == n and state in ("", "a") else []
            if i < n:
                _, role, text = rows[i]
                cost, audit, lines = after[state]
                found.append((cost + 4, "D" + audit, lines))
                if faults[i] in ("", "truncated"):
                    more, to = 3 * (faults[i] == "truncated"), "a" if state == "u" else "u"
                    if role[:1] and role[:1] in follow[state]:
                        cost, audit, lines = after[role[0]]
                        found.append((cost + more, "K" + audit, (f"{role}:{text}", lines)))
                    cost, audit, lines = after[to]
                    found.append((cost + 3 + more, "R" + audit, (f"{names[to]}:{text}", lines)))
            now[state] = better(found)
        for _ in range(3):  # insertions, as long as they change anything
            for state in follow:
                to = "a" if state == "u" else "u"
                cost, audit, lines = now[to]
                now[state] = better([now[state], (cost + 3, "I" + audit, (f"{names[to]}:", lines))])
        after = now
    cost, audit, chain = after[""]
    lines = []
    while chain:
        lines.append(chain[0])
        chain = chain[1]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(spark, rows, frame=None):
    frame = frame if frame is not None else spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(frame).collect()}
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    # rows of one turn: by role, then by a hash of the text
    hashes = {r.text: r.h for r in frame.select(F.coalesce("text", F.lit(" ")).alias("text")).distinct().withColumn("h", F.xxhash64("text")).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", hashes[r[3] if r[3] is not None else " "])
    want = {c: brute(sorted(rs, key=order)) for c, rs in convs.items()}
    assert got == want
    return got


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert len(compare(spark, rows)) == 100


def drawn(draw, conv, n):
    roles = ["user", "assistant", "system", "tool", "", "u", None, "Assistant"]
    return [(conv, draw.choice([None, *range(12)]), draw.choices(roles, [8, 8, 3, 1, 1, 1, 1, 1])[0], draw.choice(["Yes.", "No", " ", "", None, "a?", "b!\n", "é。", "long " * 3 + "."])) for _ in range(n)]


def test_random_rows_nulls_ties_and_repeats(spark):
    draw = random.Random(7)
    rows = [r for conv in [None, *range(150)] for r in drawn(draw, conv, draw.randint(1, 9))]
    compare(spark, rows)


def test_long_conversations_are_parsed_by_blocks(spark, monkeypatch):
    draw = random.Random(9)
    rows = [r for conv in (1, 2) for r in drawn(draw, conv, 60)] + [(3, t, draw.choice(["user", "assistant"]), f"t{draw.randint(0, 40)}{draw.choice(['.', ''])}") for t in range(90)]
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = compare(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got[3][1:4] != (0, 0, 0)


def test_blocks_join_to_what_one_parse_gives():
    draw = random.Random(11)
    for _ in range(300):
        rows = [(t, draw.choice(["user", "assistant", "system", "x"]), draw.choice("abcdefgh") + draw.choice([".", "", "?"]), draw.randint(0, 2)) for t in range(draw.randint(0, 25))]
        held = set()
        whole = repair.joined([repair.read_rows(*(zip(*rows) if rows else ([], [], [], [])), repair._noting(set()))])
        cuts = sorted(draw.choices(range(len(rows) + 1), k=3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        cut = repair.joined([repair.read_rows(*(zip(*p) if p else ([], [], [], [])), repair._noting(held)) for p in parts])
        whole.pop("path"), cut.pop("path")
        assert whole == cut


def test_repeated_row_is_counted_first(spark):
    rows = [(5, 1, "user", "Hi.")] * 700 + [(5, 2, "assistant", "Yes.")]
    assert compare(spark, rows)[5][2] >= 699


def test_empty_tables_and_clashing_columns(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = drawn(random.Random(1), 4, 6)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"copies": F.lit("x"), "conv_key": F.lit(1), "part": F.lit(None), "h": F.lit(2), "audit": F.lit("q")})
    compare(spark, rows, frame)


@pytest.mark.parametrize(("rows", "want"), [("", (0, "")), ("sua", (0, "KKK")), ("a", (3, "IK")), ("u", (3, "KI")), ("uu", (3, "KR")), ("dua", (4, "DKK")), ("s", (4, "D")), ("U", (4, "D")), ("uas", (4, "KKD"))])
def test_small_repairs(rows, want):
    ways = repair.parse(rows)
    assert min(ways[s] for s in repair.ENDS if s in ways) == want
