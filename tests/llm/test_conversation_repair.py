"""Repair against a brute force over edits, across block borders, and on odd tables."""

import hashlib
import heapq
import random
import re

import pytest

from lexalign.llm import conversation_repair as cr

SOUND = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Dijkstra over (place, roles so far as a state) by (cost, letters): a plain reading of the rules."""
    blanks, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for role, text in rows:
        body = text.rstrip(blanks)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, letters, at, roles, lines = heapq.heappop(queue)
        if at == len(rows) and SOUND.fullmatch(roles):
            return faults, cost, letters, lines
        key = (at, roles[-1:])
        if key in done:
            continue
        done.add(key)
        for name in ("user", "assistant"):
            if re.fullmatch(r"s?(ua)*u?", roles + name[0]):
                heapq.heappush(queue, (cost + 3, letters + "I", at, roles + name[0], (*lines, name + ":")))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(queue, (cost + 4, letters + "D", at + 1, roles, lines))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 * (faults[at] == "truncated")
                for letter, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if name[:1] in "sua" and name and re.fullmatch(r"s?(ua)*u?", roles + name[0]):
                        heapq.heappush(queue, (cost + price + extra, letters + letter, at + 1, roles + name[0], (*lines, f"{name}:{text}")))
    raise AssertionError


def expected(rows):
    """All columns for the rows of one conversation as ``(turn, role, text)`` in order."""
    said = [(role if role is not None else " ", text if text is not None else " ") for _, role, text in rows]
    faults, cost, letters, lines = cheapest(said)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for r, _ in said]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, most):
    rng = random.Random(seed)
    out = {}
    for conv in [*range(n), None]:
        rows = [(None, "user", "Null turn.")] if rng.random() < 0.1 else []
        turn = rng.randrange(-3, 3)
        for _ in range(rng.randrange(1, most)):
            turn += rng.choice([1, 1, 1, 2, 5])
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", None, "", "User"])
            text = rng.choice(["One.", "Two!", "Three? \n", "four", "", " \t", None, f"Text {turn}.", f"long {turn} é " * 50 + "."])
            rows.append((turn, role, text))
        out[conv] = rows
    return out


SCHEMA = "conv_id long, turn long, role string, text string, place string, letters int"


@pytest.mark.parametrize("block", [3, 1024])
def test_against_brute_force(spark, block):
    convs = conversations(block, 60, 14)
    convs[1000] = conversations(5, 1, 400)[0] + [(10_000 + i, "user", f"Long one {i}.") for i in range(40)]
    rows = [(c, *r, "x", 1) for c, part in convs.items() for r in part]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair(df, least_block=block).collect()}
    assert got == {c: expected(part) for c, part in convs.items()}
    lines = {}
    for r in cr.repair(df, rows_out=True, least_block=block).collect():
        lines.setdefault(r.conv_id, {})[r.position] = f"{r.role}:{r.text}"
    for c, want in got.items():
        mine = lines.get(c, {})
        assert sorted(mine) == list(range(len(mine)))
        assert hashlib.sha256("\n".join(mine[i] for i in range(len(mine))).encode()).hexdigest() == want[-1]
        assert SOUND.fullmatch("".join(mine[i][0] for i in range(len(mine))))


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["user", "assistant"]), rng.choice([f"Row {i}.", f"row {i}", "Same."])) for i in range(3000)]
    rows += [(3001, "user", "x" * 2_000_000 + ".")]
    df = spark.createDataFrame([(1, *r, "x", 1) for r in rows] + [(2, 0, "user", "Hi.", "x", 1)], SCHEMA)
    placed = cr._placed(df)
    segments = cr._segments(placed, 100)
    assert segments.count() >= 30 and max(len(r.kinds) for r in segments.select("kinds").collect()) <= 100
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair(df, least_block=16).collect()}
    assert got == {1: expected(rows), 2: expected([(0, "user", "Hi.")])}


def test_ties_and_repeats(spark):
    same = [(1, 5, "user", "Hi.", "x", 1)] * 50 + [(1, 5, "assistant", "Yes.", "x", 1)] * 50
    got = cr.repair(spark.createDataFrame(same, SCHEMA)).collect()
    assert [tuple(r)[1:] for r in got] == [expected([(5, "assistant", "Yes.")] * 50 + [(5, "user", "Hi.")] * 50)]
    assert cr.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    import zlib
    schema = "conv_id long, turn long, role string, text string"
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    twice = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 3)
    rows = [(gone, 0, "user", "Hi."), (twice, 0, "user", "Hi."), (None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in cr.op13_conversation_repair(spark, f"{tmp_path}/a").collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[twice] == expected([(0, "user", "Hi.")] * 2)
    assert set(got) == {gone, twice, None}
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert cr.op13_conversation_repair(spark, f"{tmp_path}/b").collect() == []
