"""Conversation structure repair: cheapest edits by a dynamic program with square-root checkpoints.

A conversation is sound if it is empty, or an optional system turn and then user and
assistant turns in alternation, ending with an assistant's. Its rows are edited in order:

* ``D`` delete (4), required for blank rows and for rows whose role and text came before;
* ``I`` insert an empty turn of the user or the assistant (3), between any rows;
* ``K`` keep (0);
* ``R`` change the role to user or assistant (3).

A row that stays though its text does not end a sentence adds 3. Of all cheapest edits the
one whose letters are ASCII-least is taken. What has been put out so far is one of four
states (nothing, system, user, assistant), so the cost of what is still to come is a
vector of four numbers, computed from the last row back.

A conversation may hold most rows of the table, so no task takes one whole:

1. The rows are range-partitioned by conversation and turn and written once with their place.
   First occurrences of role and text come from one aggregate by 128-bit hashes.
2. Blocks of about the square root of the longest conversation's rows are the checkpoints. A
   block folds its part of a conversation into a 4 x 4 matrix (least cost from state to
   state); no text is read.
3. A conversation's matrices are multiplied from the end, one after the other: the cost vector at
   every checkpoint.
4. Each block recomputes its inner vectors from the checkpoint behind it, and walks
   forward along tight edits, once for each state it may be entered in.
5. The texts and the blocks' edits meet in one stream by conversation and place, which follows the
   states, repairs the rows and hashes them. SHA-256 can only be taken in order, so the
   stream of one conversation is one task's, of bounded memory beside the letters it returns.

Defined results: a null role or text counts as one space, so it is blank or has no
known role; null ids are one conversation; null turns come first; rows of one turn are ordered by role, then
by a hash of the text; repeated rows are duplicates; a conversation whose rows all go is empty; an empty
table gives no rows. Columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexalign.llm.common import hashes, session_for_text, shuffle_width, table, written
from lexalign.llm.sharding import crc32_sql

DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: Rows of a block at least: below, a block's overhead outweighs its rows.
LEAST_BLOCK = 1024
_PLACE_BITS = 33         # of monotonically_increasing_id
_BLANKS = " \t\n\x0b\x0c\r"

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 40
#: State after an inserted or rerolled turn, and its role.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = ("user", "user", "assistant", "user")
#: State after a kept row by its initial (s, u, a, other), where that is allowed.
_KEEP = ({NOTHING: SYSTEM}, {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
#: Costs behind the last row, and the letters that reach them.
END, ENDING = (0, 6, 3, 0), ("", "II", "I", "")
FINE, GONE, TRUNCATED = range(3)


def _back(v: tuple, kind: int) -> tuple:
    """Costs before a row (inserts ahead of it included) from those behind it; ``kind`` is 3 * initial + fault."""
    initial, fault = divmod(kind, 3)
    b = [v[s] + DELETE for s in range(4)]
    if fault != GONE:
        extra = CUT if fault == TRUNCATED else 0
        for s in range(4):
            b[s] = min(b[s], v[_NEXT[s]] + REROLE + extra)
        for s, to in _KEEP[initial].items():
            b[s] = min(b[s], v[to] + extra)
    user, assistant = min(b[2], b[3] + INSERT), min(b[3], b[2] + INSERT)
    return min(b[0], user + INSERT), min(b[1], user + INSERT), user, assistant


@lru_cache(1 << 14)
def matrix(kinds: bytes) -> tuple:
    """Least cost over the rows ``kinds`` from each state to each state, row by row of the 4 x 4 matrix."""
    columns = []
    for end in range(4):
        v = tuple(0 if s == end else _FAR for s in range(4))
        for kind in reversed(kinds):
            v = _back(v, kind)
        columns.append(v)
    return tuple(min(columns[end][s], _FAR) for s in range(4) for end in range(4))


def through(m: tuple, v: tuple) -> tuple:
    """Costs before a block from its matrix and those behind it."""
    return tuple(min(m[4 * s + e] + v[e] for e in range(4)) for s in range(4))


@lru_cache(1 << 14)
def walk(kinds: bytes, end: tuple) -> tuple[tuple, tuple]:
    """Letters and last state of the ASCII-least tight edits over a block, for each state it may be entered in."""
    costs = [end]
    for kind in reversed(kinds):
        costs.append(_back(costs[-1], kind))
    costs.reverse()
    letters, exits = [], []
    for s in range(4):
        out = []
        for i, kind in enumerate(kinds):
            initial, fault = divmod(kind, 3)
            extra = CUT if fault == TRUNCATED else 0
            while True:
                now, v = costs[i][s], costs[i + 1]
                if now == DELETE + v[s]:
                    out.append("D")
                elif now == INSERT + costs[i][_NEXT[s]]:
                    out.append("I")
                    s = _NEXT[s]
                    continue
                elif fault != GONE and s in _KEEP[initial] and now == extra + v[_KEEP[initial][s]]:
                    out.append("K")
                    s = _KEEP[initial][s]
                else:
                    out.append("R")
                    s = _NEXT[s]
                break
        letters.append("".join(out))
        exits.append(s)
    return tuple(letters), tuple(exits)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with ``place`` in the order of conversation and turn, written once."""
    spark = rows.sparkSession
    tie, row = F.xxhash64("text"), F.xxhash64(F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "_tie", "_row"]           # ascending: nulls first
    said = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    return written(said.withColumn("_tie", tie).withColumn("_row", row)
                   .repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
                   .select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("place")), "turns")


_SEGMENT = ("conv_id {id}, place long, kinds binary, costs array<long>, blank long, duplicate long, truncated long, "
            "illegal long, first int, last int, low long, high long, turns long")


def _segments(placed: DataFrame, block_rows: int) -> DataFrame:
    """One row for a conversation's part of a block: the kinds of its rows, its matrix and its counts."""
    conv_type = to_arrow_type(placed.schema["conv_id"].dataType)
    partition = F.shiftright("place", _PLACE_BITS).alias("part")
    number = F.floor(F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) / block_rows).alias("block")
    body = F.rtrim("text", F.lit(_BLANKS))
    slim = placed.select(
        "conv_id", "turn", "place", partition, number, *(h.alias(f"h{i}") for i, h in enumerate(hashes("role", "text"))),
        F.when(F.col("role") == "", 3).otherwise((F.instr(F.lit("sua"), F.substring("role", 1, 1)) + 3) % 4).alias("initial"),
        (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    first = slim.groupBy("conv_id", "h0", "h1").agg(F.min("place").alias("place")).select("place", partition, number)

    def fold(rows: pa.Table, firsts: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").to_pylist()
        new = set(firsts.column("place").to_pylist())
        out, at = [], 0
        while at < len(rows):
            conv, upto = rows[at]["conv_id"], at
            while upto < len(rows) and rows[upto]["conv_id"] == conv:
                upto += 1
            part = rows[at:upto]
            faults = [(1 if r["blank"] else 2 if r["place"] not in new else 3 if r["cut"] else 0) for r in part]
            kinds = bytes(3 * r["initial"] + (GONE if f in (1, 2) else TRUNCATED if f else FINE) for r, f in zip(part, faults))
            initials, turns = [r["initial"] for r in part], [r["turn"] for r in part if r["turn"] is not None]
            out.append({
                "conv_id": conv, "place": part[0]["place"], "kinds": kinds, "costs": list(matrix(kinds)),
                **{name: faults.count(i) for i, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))},
                "illegal": sum(not _legal(a, b) for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
                "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))})
            at = upto
        return pa.Table.from_pylist(out, schema=_segment_schema(conv_type))

    return slim.groupBy("part", "block").cogroup(first.groupBy("part", "block")) \
        .applyInArrow(fold, _SEGMENT.format(id=placed.schema["conv_id"].dataType.simpleString()))


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _segment_schema(conv_type: pa.DataType) -> pa.Schema:
    longs = ("blank", "duplicate", "truncated", "illegal")
    return pa.schema([("conv_id", conv_type), ("place", pa.int64()), ("kinds", pa.binary()), ("costs", pa.list_(pa.int64())),
                      *((n, pa.int64()) for n in longs), ("first", pa.int32()), ("last", pa.int32()),
                      ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])


def _checkpoints(segments: DataFrame) -> DataFrame:
    """``(at, behind, summary)``: the costs behind every segment; a conversation's first has its numbers.

    Segments of a conversation stream by from its last to its first, so a task holds one of them.
    """
    faults = ("blank", "duplicate", "truncated", "illegal")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, later, v, sums, low, high, distinct = [], None, END, [0] * 4, None, None, 0

        def first() -> None:        # ``later`` was the first segment of its conversation
            if later:
                gaps = high - low + 1 - distinct if high is not None else 0
                out[-1] = (*out[-1][:2], [gaps, *sums, v[NOTHING]])

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                names=["at", "behind", "summary"])

        for batch in batches:
            for p in batch.to_pylist():
                if later is None or later["conv_id"] != p["conv_id"]:
                    first()
                    v, sums, low, high, distinct = END, [0] * 4, None, None, 0
                elif not _legal(p["last"], later["first"]):
                    sums[3] += 1
                out.append((p["place"], list(v), None))
                v = through(p["costs"], v)
                sums = [n + p[name] for n, name in zip(sums, faults)]
                if p["turns"]:
                    distinct += p["turns"] - (p["high"] == low)
                    low, high = p["low"], p["high"] if high is None else high
                later = p
            if len(out) > 1:        # the last one may yet turn out to be a first one
                held = out.pop()
                yield batch_of()
                out = [held]
        first()
        if out:
            yield batch_of()

    return segments.drop("kinds").repartition(shuffle_width(segments.sparkSession), "conv_id") \
        .sortWithinPartitions("conv_id", F.col("place").desc()) \
        .mapInArrow(multiply, "at long, behind array<long>, summary array<long>")


def _walked(segments: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``(conv_id, place, summary, letters, exits)``: the edits of every segment for each state before it."""
    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [walk(k, tuple(b)) for k, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array([list(f[0]) for f in found], pa.list_(pa.string())),
                 pa.array([list(f[1]) for f in found], pa.list_(pa.int32()))], names=["conv_id", "place", "summary", "letters", "exits"])

    id_type = segments.schema["conv_id"].dataType.simpleString()
    return segments.join(checkpoints, segments["place"] == checkpoints["at"]) \
        .select("conv_id", "place", "kinds", "behind", "summary") \
        .mapInArrow(forward, f"conv_id {id_type}, place long, summary array<long>, letters array<string>, exits array<int>")


class _Repair:
    """Follows the letters and states of one conversation."""

    def __init__(self, conv):
        self.conv, self.state, self.letters, self.todo, self.summary = conv, NOTHING, [], iter(""), [0] * 6
        self.sha, self.lines = hashlib.sha256(), 0

    def segment(self, summary, letters, exits):
        """Edits of the next segment; the state is followed row by row."""
        self.summary = self.summary if summary is None else summary
        self.letters.append(letters[self.state])
        self.todo = iter(letters[self.state])

    def _say(self, role: str, text: str) -> tuple[str, str]:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1
        return role, text

    def _insert(self) -> tuple[str, str]:
        role, self.state = _ROLE[self.state], _NEXT[self.state]
        return self._say(role, "")

    def row(self, role: str, text: str) -> list[tuple]:
        """What stands in the place of a row: ``(edit, role, text)``."""
        out = []
        for letter in self.todo:
            if letter == "I":
                out.append((letter, *self._insert()))
                continue
            if letter == "K":
                self.state = _KEEP["sua".index(role[0])][self.state]
                out.append((letter, *self._say(role, text)))
            elif letter == "R":
                role, self.state = _ROLE[self.state], _NEXT[self.state]
                out.append((letter, *self._say(role, text)))
            break
        return out

    def end(self) -> list[tuple]:
        self.letters.append(ENDING[self.state])
        return [("I", *self._insert()) for _ in ENDING[self.state]]

    def digest(self) -> tuple:
        return (self.conv, *self.summary, "".join(self.letters), self.sha.hexdigest())


def _stream(placed: DataFrame, walked: DataFrame, rows_out: bool) -> DataFrame:
    id_type = placed.schema["conv_id"].dataType.simpleString()
    turns = placed.select("conv_id", "place", F.lit(1).alias("part"), "role", "text", F.lit(None).cast("array<long>").alias("summary"),
                          F.lit(None).cast("array<string>").alias("letters"), F.lit(None).cast("array<int>").alias("exits"))
    edits = walked.select("conv_id", "place", F.lit(0).alias("part"), F.lit(None).cast("string").alias("role"),
                          F.lit(None).cast("string").alias("text"), "summary", "letters", "exits")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {id_type}, position long, edit string, role string, text string" if rows_out else \
        f"conv_id {id_type}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, conv_type = None, [], None

        def said(found: list[tuple]) -> None:
            if rows_out:
                first = now.lines - len(found)
                out.extend((now.conv, first + i, *x) for i, x in enumerate(found))

        def over() -> None:
            if now:
                said(now.end())
                if not rows_out:
                    out.append(now.digest())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()] if rows_out else \
                [conv_type] + [pa.int64()] * 6 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for conv, _, part, role, text, summary, letters, exits in zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    if now is None or now.conv != conv:
                        over()
                        now = _Repair(conv)
                    now.segment(summary, letters, exits)
                else:
                    said(now.row(role, text))
            if out:
                yield batch_of(out)
                out = []
        over()
        if out:
            yield batch_of(out)

    return turns.unionByName(edits).repartition(shuffle_width(placed.sparkSession), "conv_id") \
        .sortWithinPartitions("conv_id", "place", "part").mapInArrow(run, schema)


def repair(rows: DataFrame, rows_out: bool = False, least_block: int = LEAST_BLOCK) -> DataFrame:
    """Repair all conversations of ``(conv_id, turn, role, text)``.

    One row a conversation: its faults, the cost, the letters of its edits and the SHA-256 of
    its repaired lines; or, with ``rows_out``, the repaired rows with ``position`` and ``edit``.
    """
    session_for_text(rows.sparkSession)
    placed = _placed(rows)
    longest = placed.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    segments = written(_segments(placed, max(least_block, math.isqrt(longest))), "turn-blocks")
    return _stream(placed, _walked(segments, _checkpoints(segments)), rows_out)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after fixed damage by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text,
    2 takes its sentence ends, 3 repeats it, 4 makes its role user."""
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    said = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    what = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    return said.withColumn("_d", what).where("_d <> 0") \
        .withColumn("text", F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))) \
        .withColumn("role", F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))) \
        .withColumn("_n", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))) \
        .drop("_d", "_n")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; those without rows left are empty."""
    conversations = table(spark, sf_dir, "conversations")
    done = repair(damage(conversations))
    every = conversations.groupBy("conv_id").agg(F.lit(True).alias("_here")).withColumnRenamed("conv_id", "_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(done, every["_id"].eqNullSafe(done["conv_id"]), "left").select(
        F.col("_id").alias("conv_id"), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


ORACLE_SQL = f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE d <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS initial
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM numbered),
numbers AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id),
ins(s, k, mid, said) AS (VALUES
  (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''),
  (0, 1, 2, E'\nuser:'), (1, 1, 2, E'\nuser:'), (2, 1, 3, E'\nassistant:'), (3, 1, 2, E'\nuser:'),
  (0, 2, 3, E'\nuser:\nassistant:'), (1, 2, 3, E'\nuser:\nassistant:'),
  (2, 2, 2, E'\nassistant:\nuser:'), (3, 2, 3, E'\nuser:\nassistant:')),
edits(mid, e, initial, s2, as_role) AS (VALUES
  (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL),
  (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (3, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL),
  (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (3, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant')),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'c': 0, 'a': '', 't': ''}} AS best FROM numbers
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.s2, min({{
    'c': w.best.c + 3 * ins.k + CASE e.e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
         + CASE WHEN e.e <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END,
    'a': w.best.a || repeat('I', ins.k) || e.e,
    't': w.best.t || ins.said || CASE WHEN e.e = 'D' THEN '' ELSE chr(10) || coalesce(e.as_role, f.role) || ':' || f.text END}})
  FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN ins ON ins.s = w.s JOIN edits e ON e.mid = ins.mid
    AND (e.initial IS NULL OR e.initial = f.initial) AND (e.e = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, w.i + 1, e.s2),
ended AS (
  SELECT w.conv_id, min({{'c': w.best.c + 3 * ins.k, 'a': w.best.a || repeat('I', ins.k), 't': w.best.t || ins.said}}) AS best
  FROM walk w JOIN numbers n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i
  JOIN ins ON ins.s = w.s AND ins.mid IN (0, 3)
  GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN numbers n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
