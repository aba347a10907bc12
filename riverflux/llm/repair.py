"""Conversation structure repair by a min-plus scan of matrices.

A conversation should be an optional system turn and pairs of a user's and an assistant's turn. Four states say what the
turns so far end in; an edit of a turn leads from state to state, and inserted turns lead on without one. So each turn is
a 4 x 4 matrix of (cost, audit) elements, the insertions before it closed in; products take the sum of the costs and the
joined audits, and of several ways the smaller (cost, audit). Audits of equal cost over the same turns are never the
beginning of one another (they name as many turns, and more insertions cost more), so that order survives products,
which are associative: a conversation may be cut anywhere.

Turns are dealt by ranges of (conversation, turn) and cut into pieces of SPAN turns at most, each with its matrix. The
pieces of a conversation are multiplied FAN at a time in a tree over all partitions; the way back down the tree tells each
piece the states in which it begins and ends, and it repairs its turns by itself. No task holds a conversation; what grows
with one is its audit, which is part of the result and has 16 versions in a matrix (so some 10**8 turns are the most).
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverflux.llm.common import discard, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turns of a piece, and pieces of a node of the tree, at most.
SPAN, FAN = 256, 16
#: Bytes of text after which a task hands on its finished pieces.
FLUSH = 4 << 20
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user's, after an assistant's; the user's or assistant's turn that each waits for leads to ON.
ON = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
INITIALS = {2: "u", 3: "a"}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}

Element = tuple[int, str] | None
Matrix = list[list[Element]]
ONE: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def less(a: Element, b: Element) -> Element:
    return b if a is None or b is not None and b < a else a


def close(v: list[Element]) -> list[Element]:
    """What insertions reach from a row of a matrix; in this order of states one round is enough."""
    v = list(v)
    for i in range(4):
        if v[i] is not None:
            v[ON[i]] = less(v[ON[i]], (v[i][0] + INSERT, v[i][1] + "I"))
    return v


def after(state: int, initial: str) -> int | None:
    """The state after a turn that is kept, None where it may not stand."""
    if state == 0 and initial == "s":
        return 1
    return ON[state] if INITIALS[ON[state]] == initial else None


def step(v: list[Element], initial: str, must_go: bool, more: int) -> list[Element]:
    """A row of a matrix after one more turn: insertions, then one edit of the turn."""
    v, out = close(v), [None] * 4
    for i in range(4):
        if v[i] is None:
            continue
        cost, audit = v[i]
        out[i] = less(out[i], (cost + DELETE, audit + "D"))
        if not must_go:
            out[ON[i]] = less(out[ON[i]], (cost + REROLE + more, audit + "R"))
            kept = after(i, initial)
            if kept is not None:
                out[kept] = less(out[kept], (cost + more, audit + "K"))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        line: list[Element] = []
        for j in range(4):
            ways = [(x[0] + b[k][j][0], k) for k, x in enumerate(row) if x is not None and b[k][j] is not None]
            least = min(ways, default=(0,))[0]
            line.append(min(((c, row[k][1] + b[k][j][1]) for c, k in ways if c == least), default=None))
        out.append(line)
    return out


def ending(m: Matrix) -> tuple[int, str, int, str]:
    """cost and audit of the best way from the start to an end, the state before the last insertions, and these."""
    found = []
    for k, x in enumerate(m[0]):
        if x is not None:
            v: list[Element] = [None] * 4
            v[k] = (0, "")
            for e in ENDS:
                y = close(v)[e]
                if y is not None:
                    found.append((x[0] + y[0], x[1] + y[1], k, y[1]))
    return min(found)


def ways(kids: list[Matrix], begin: int, end: int) -> list[tuple[int, int]]:
    """The states in which each of some consecutive matrices begins and ends on the best way from begin to end."""
    best: list[tuple | None] = [None] * 4
    best[begin] = (0, "", (begin,))
    for m in kids:
        new: list[tuple | None] = [None] * 4
        for k, x in enumerate(best):
            for j in range(4):
                if x is not None and m[k][j] is not None:
                    way = (x[0] + m[k][j][0], x[1] + m[k][j][1], (*x[2], j))
                    new[j] = way if new[j] is None or way < new[j] else new[j]
        best = new
    path = best[end][2]
    return list(zip(path, path[1:]))


def packed(m: Matrix) -> dict:
    flat = [x for row in m for x in row]
    return {"costs": [None if x is None else x[0] for x in flat], "audits": [None if x is None else x[1] for x in flat]}


def unpacked(node: dict) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(node["costs"], node["audits"])]
    return [flat[i : i + 4] for i in range(0, 16, 4)]


#: What is counted along a piece or several: they add up, but for what happens between two of them.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")


def joined(a: dict, b: dict) -> dict:
    """The counts of two consecutive pieces together."""
    out = {c: a[c] + b[c] for c in COUNTS}
    out["illegal"] += a["last_role"] + b["first_role"] not in LEGAL
    out["n_turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    turns = {"first_turn": a["first_turn"] if a["first_turn"] is not None else b["first_turn"], "last_turn": b["last_turn"] if b["last_turn"] is not None else a["last_turn"]}
    return out | turns | {"first_role": a["first_role"], "last_role": b["last_role"]}


MATRIX = pa.struct([("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
INFO = pa.struct([*[(c, pa.int64()) for c in COUNTS], ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string())])
MATRIX_DDL, TURN_DDL = "struct<costs: array<long>, audits: array<string>>", "array<struct<role: string, text: string>>"
INFO_DDL = f"struct<{', '.join(f'{c}: long' for c in COUNTS)}, first_turn: long, last_turn: long, first_role: string, last_role: string>"


def batch_of(rows: list[dict], conv: pa.DataType, **columns: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("conv", conv), *columns.items()]))


class Piece:
    """Consecutive turns of one conversation with their matrix."""

    def __init__(self, conv):
        self.conv, self.turns, self.size = conv, [], 0
        self.steps: list[tuple[str, bool, int]] = []
        self.info: dict | None = None

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        said = text.rstrip(SPACES)
        fault = "blank" if not said else "duplicate" if duplicate else "truncated" if said[-1] not in ".!?" else None
        self.steps.append((role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0))
        one = {c: int(c == fault) for c in COUNTS} | {"n_turns": int(turn is not None), "first_turn": turn, "last_turn": turn, "first_role": role[:1], "last_role": role[:1]}
        self.info = one if self.info is None else joined(self.info, one)
        self.turns.append({"role": role, "text": text})
        self.size += len(text)

    def row(self, part: int, seq: int, whole: bool) -> dict:
        """whole: the piece is all of its conversation, which only begins in the first state, so that no other row of the
        matrix is ever read."""
        matrix: Matrix = [list(v) for v in ONE]
        for i in range(1 if whole else 4):
            for one in self.steps:
                matrix[i] = step(matrix[i], *one)
        return {"conv": self.conv, "part": part, "seq": seq, "matrix": packed(matrix), "info": self.info, "turns": self.turns}


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a partition whose turns are in order."""
    part, seq, piece, done, held = TaskContext.get().partitionId(), 0, None, [], 0
    columns = {"part": pa.int32(), "seq": pa.int64(), "matrix": MATRIX, "info": INFO, "turns": pa.list_(TURN)}
    kind, opening = None, True
    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, turn, role, text, duplicate in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "duplicate")]):
            if piece is not None and (piece.conv != conv or len(piece.turns) == SPAN):
                # a conversation between two others is here as a whole; the first and the last may go on in other partitions
                done.append(piece.row(part, seq, piece.conv != conv and seq == 0 and not opening))
                held += piece.size
                seq, opening = (seq + 1, opening) if piece.conv == conv else (0, False)
                piece = None
                if held > FLUSH or len(done) >= FLUSH // SPAN // 16:
                    yield batch_of(done, kind, **columns)
                    done, held = [], 0
            piece = piece or Piece(conv)
            piece.add(turn, role, text, duplicate)
    if piece is not None:
        yield batch_of([*done, piece.row(part, seq, False)], kind, **columns)


def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node of the tree from each group of its kids."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            m, info = unpacked(r["kids"][0]["matrix"]), r["kids"][0]["info"]
            for kid in r["kids"][1:]:
                m, info = times(m, unpacked(kid["matrix"])), joined(info, kid["info"])
            out.append({"conv": r["conv"], "part": r["part"], "seq": r["seq"], "matrix": packed(m), "info": info})
        yield batch_of(out, batch.schema.field("conv").type, part=pa.int32(), seq=pa.int64(), matrix=MATRIX, info=INFO)


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations' cost and audit, and the states and last insertions that go with them."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, audit, end, tail = ending(unpacked(r["matrix"]))
            out.append({"conv": r["conv"], "part": r["part"], "seq": r["seq"], "begin": 0, "end": end, "tail": tail, "cost": cost, "audit": audit, "info": r["info"]})
        yield batch_of(out, batch.schema.field("conv").type, part=pa.int32(), seq=pa.int64(), begin=pa.int32(), end=pa.int32(), tail=pa.string(), cost=pa.int64(), audit=pa.string(), info=INFO)


def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states of a node's kids from its own."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            states = ways([unpacked(k["matrix"]) for k in r["kids"]], r["begin"], r["end"])
            for n, (kid, (begin, end)) in enumerate(zip(r["kids"], states), 1):
                out.append({"conv": r["conv"], "part": kid["part"], "seq": kid["seq"], "begin": begin, "end": end, "tail": r["tail"] if n == len(states) else ""})
        yield batch_of(out, batch.schema.field("conv").type, part=pa.int32(), seq=pa.int64(), begin=pa.int32(), end=pa.int32(), tail=pa.string())


def edited(turns: list[dict], audit: str, state: int) -> list[dict]:
    """The turns after the edits that an audit names, from a state on."""
    out, rest = [], iter(turns)
    for edit in audit:
        turn = {"text": ""} if edit == "I" else next(rest)
        if edit == "K":
            state = after(state, turn["role"][:1])
            out.append(turn)
        elif edit != "D":
            state = ON[state]
            out.append({"role": NAMES[state], "text": turn["text"]})
    return out


def repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one piece: decided and repaired."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            cost, audit, _, _ = ending(unpacked(r["matrix"]))
            out.append({"conv": r["conv"], "cost": cost, "audit": audit, "info": r["info"], "turns": edited(r["turns"], audit, 0)})
        yield batch_of(out, batch.schema.field("conv").type, cost=pa.int64(), audit=pa.string(), info=INFO, turns=pa.list_(TURN))


def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their states as pieces with their audit and repaired turns."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            audit = unpacked(r["matrix"])[r["begin"]][r["end"]][1] + r["tail"]
            out.append({"conv": r["conv"], "part": r["part"], "seq": r["seq"], "audit": audit, "turns": edited(r["turns"], audit, r["begin"])})
        yield batch_of(out, batch.schema.field("conv").type, part=pa.int32(), seq=pa.int64(), audit=pa.string(), turns=pa.list_(TURN))


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equal columns of two tables, nulls included."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def in_pieces(rows: DataFrame) -> DataFrame:
    """A table of pieces (conv, part, seq, matrix, info, turns) from conv, turn, role, text and a number row of each row."""
    rows = rows.withColumn("own", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    # what is said again in its conversation, and where first; blank turns go anyway
    again = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy("conv", "own").agg(F.min(F.struct("turn", "row"))["row"].alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialize(again.select(F.col("conv").alias("c"), F.col("own").alias("o"), "first"))
    marked = rows.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("own") == F.col("o")), "left")
    marked = marked.select("conv", "turn", "role", "text", "row", "own", F.coalesce(F.col("row") != F.col("first"), F.lit(False)).alias("duplicate"))
    order = ["conv", "turn", "role", "own", "row"]
    pieces = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("row", "own")
    kind = dict(rows.dtypes)["conv"]
    out = materialize(pieces.mapInArrow(scan, f"conv {kind}, part int, seq long, matrix {MATRIX_DDL}, info {INFO_DDL}, turns {TURN_DDL}"))
    discard(again)
    return out


def climbed(nodes: DataFrame, level: Callable[[], tuple[Column, Column]]) -> DataFrame:
    """conv, part, seq of the parents with their kids (FAN at most, in order)."""
    part, seq = level()
    kid = F.struct(F.col("part"), F.col("seq"), F.col("matrix"), F.col("info"))
    return nodes.select("conv", part.alias("p"), seq.alias("s"), kid.alias("kid")).groupBy("conv", "p", "s").agg(F.sort_array(F.collect_list("kid")).alias("kids")).withColumnsRenamed({"p": "part", "s": "seq"})


def by_seq() -> tuple[Column, Column]:
    return F.col("part"), F.floor(F.col("seq") / FAN).cast("long")


def by_part() -> tuple[Column, Column]:
    return F.floor(F.col("part") / FAN).cast("int"), F.col("seq")


def through_tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of the whole conversations (as decide() gives them) and of the pieces' states, from pieces of
    conversations that have several."""
    kind = dict(nodes.dtypes)["conv"]
    where_ = f"conv {kind}, part int, seq long"
    levels, steps = [nodes], []
    while True:
        top = levels[-1].agg(F.max("part").alias("part"), F.max("seq").alias("seq")).first()
        if not top["part"] and not top["seq"]:
            break
        steps.append(by_seq if top["seq"] else by_part)  # the pieces of each partition, then the partitions
        levels.append(materialize(climbed(levels[-1], steps[-1]).mapInArrow(multiply, f"{where_}, matrix {MATRIX_DDL}, info {INFO_DDL}")))
    whole = materialize(levels[-1].mapInArrow(decide, f"{where_}, begin int, end int, tail string, cost long, audit string, info {INFO_DDL}"))
    states = whole.select("conv", "part", "seq", "begin", "end", "tail")
    for below, step_ in zip(levels[-2::-1], reversed(steps)):
        kids = climbed(below, step_)
        met = kids.join(states, same(kids, states, "conv", "part", "seq")).select(kids["conv"], kids["part"], kids["seq"], "kids", "begin", "end", "tail")
        states = materialize(met.mapInArrow(hand_down, f"{where_}, begin int, end int, tail string"))
    discard(*levels[1:])
    return whole, states


class Repaired(NamedTuple):
    """conversations: conv, cost, audit, info (counts), turns (repaired: role, text; null if they are in pieces).
    pieces: conv, part, seq (their order), audit, turns of the conversations that were cut."""

    conversations: DataFrame
    pieces: DataFrame


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """The cheapest repair of each conversation that has rows.

    Rows are ordered by turn (nulls first); of equal turns by role and then by a hash of role and text; equal rows are
    interchangeable, and all but the first are duplicates. A null role or text is one space: such a role's initial
    fits nowhere, such a text is blank. Rows without a conversation are one conversation. Texts may be of any
    length, roles may be any text, whose first letter counts. Other columns are not read. An empty table has empty results.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    pieces = in_pieces(rows)
    discard(rows)

    conv = f"conv {dict(pieces.dtypes)['conv']}"
    several = materialize(pieces.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv"))
    alone = pieces.join(several, same(pieces, several, "conv"), "left_anti")
    whole = materialize(alone.mapInArrow(repair_whole, f"{conv}, cost long, audit string, info {INFO_DDL}, turns {TURN_DDL}"))
    cut = pieces.join(several, same(pieces, several, "conv"), "left_semi")
    nodes = materialize(cut.select("conv", "part", "seq", "matrix", "info"))
    roots, states = through_tree(nodes)
    met = cut.join(states, same(cut, states, "conv", "part", "seq")).select(cut["conv"], cut["part"], cut["seq"], "matrix", "turns", "begin", "end", "tail")
    parts = materialize(met.mapInArrow(repair, f"{conv}, part int, seq long, audit string, turns {TURN_DDL}"))
    discard(pieces, nodes, states)
    roots = roots.select("conv", "cost", "audit", "info", F.lit(None).cast(TURN_DDL).alias("turns"))
    return Repaired(whole.unionByName(roots), parts)


def repaired_turns(repaired: Repaired) -> DataFrame:
    """conv, at, role, text: a row for each turn after repair; at (part, seq, n) orders a conversation's."""
    turns = repaired.pieces.select("conv", "part", "seq", "turns").unionByName(repaired.conversations.select("conv", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), "turns"))
    rows = turns.select("conv", "part", "seq", F.posexplode("turns").alias("n", "turn"))
    return rows.select("conv", F.struct("part", "seq", "n").alias("at"), "turn.role", "turn.text")


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, sha of the lines of conversations whose pieces come in order, one after the other."""
    conv, sha, first, kind = None, None, True, None
    for batch in batches:
        out, kind = [], batch.schema.field("conv").type
        for c, lines in zip(batch.column("conv").to_pylist(), batch.column("lines").to_pylist()):
            if sha is not None and c != conv:
                out.append({"conv": conv, "sha": sha.hexdigest()})
                sha = None
            if sha is None:
                conv, sha, first = c, hashlib.sha256(), True
            if lines is not None:
                sha.update(("" if first else "\n").encode() + lines.encode())
                first = False
        yield batch_of(out, kind, sha=pa.string())
    if sha is not None:
        yield batch_of([{"conv": conv, "sha": sha.hexdigest()}], kind, sha=pa.string())


def with_digests(repaired: Repaired) -> DataFrame:
    """The conversations with sha: the SHA-256 of their repaired turns as lines role:text.

    That hash goes through a conversation from front to back: the pieces of one that was cut pass through a task as a
    stream, one at a time."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    conv = f"conv {dict(repaired.pieces.dtypes)['conv']}"
    stream = repaired.pieces.select("conv", "part", "seq", F.when(F.size("turns") > 0, lines).alias("lines")).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    hashed = stream.select("conv", "lines").mapInArrow(digest, f"{conv}, sha string").withColumnRenamed("conv", "c")
    both = repaired.conversations.join(hashed, F.col("conv").eqNullSafe(F.col("c")), "left")
    return both.withColumn("sha", F.coalesce("sha", F.sha2(lines, 256))).drop("c", "turns")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults dealt by a hash of conv_id and turn: dropped, emptied, cut, repeated and renamed turns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind != 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    who = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times_ = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", who.alias("role"), said.alias("text"), times_.alias("copy")).drop("copy")


def op13_min_plus_repair(spark, sf_dir: str) -> DataFrame:
    """A row for each conversation of the table; gaps are null beyond a long."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = with_digests(repair_conversations(damage(conversations)))
    i = lambda c: F.col(f"info.{c}")
    number = lambda c: i(c).cast("decimal(20,0)")
    gaps = F.when(i("n_turns") > 0, (number("last_turn") - number("first_turn") + 1 - number("n_turns")).try_cast("long")).otherwise(0)
    counts = [i(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    found = found.select("conv", gaps.alias("gaps"), *counts, "cost", "audit", F.col("sha").alias("repaired_sha256"), F.lit(True).alias("there"))
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    empty = {"cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()} | dict.fromkeys(["gaps", "blank", "duplicate", "truncated", "illegal"], 0)
    return out.select("conv_id", *[F.when(F.col("there"), F.col(c)).otherwise(F.lit(empty[c])).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")])


OP13_SQL = r"""
WITH RECURSIVE
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
bits AS (SELECT *, [4294967295] || flatten(list_transform(string_split(k, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0])) AS b FROM src),
crc AS (SELECT *, xor(list_reduce(list_transform(b, lambda v: CAST(v AS BIGINT)), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS kind FROM bits),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM crc WHERE kind <> 0)),
inrow AS (SELECT *, row_number() OVER c AS r, left(role, 1) AS ini, lag(left(role, 1)) OVER c AS before FROM dam WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || ':' || text))),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) AS again, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS ending FROM inrow),
rows_ AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (r > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(r) AS n
  FROM rows_ GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
        (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])) v(src, dst, c, a, l)),
edits AS (SELECT * FROM (VALUES (0, 0, 2, 'D', ''), (1, 1, 2, 'D', ''), (2, 2, 2, 'D', ''), (3, 3, 2, 'D', ''), (0, 2, 1, 'R', ''), (1, 2, 1, 'R', ''), (2, 3, 1, 'R', ''), (3, 2, 1, 'R', ''),
        (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (2, 3, 0, 'K', 'a'), (3, 2, 0, 'K', 'u')) v(src, dst, c, e, ini)),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS r, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS l FROM sums
  UNION ALL
  SELECT conv_id, r, st, min(cost), arg_min(audit, (cost, audit)), arg_min(l, (cost, audit)) FROM (
    SELECT d.conv_id AS conv_id, w.r AS r, e.dst AS st, CAST(d.cost + i.c + e.c + CASE WHEN e.e <> 'D' AND w.fault = 'truncated' THEN 5 ELSE 0 END AS BIGINT) AS cost, d.audit || i.a || e.e AS audit,
           d.l || CAST(i.l AS VARCHAR[]) || CASE e.e WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [w.role || ':' || w.text] ELSE [CASE e.dst WHEN 2 THEN 'user:' ELSE 'assistant:' END || w.text] END AS l
    FROM dp d JOIN rows_ w ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND w.r = d.r + 1 JOIN ins i ON i.src = d.st JOIN edits e ON e.src = i.dst
    WHERE (e.e = 'D' OR w.fault NOT IN ('blank', 'duplicate')) AND (e.e <> 'K' OR e.ini = w.ini))
  GROUP BY conv_id, r, st),
fin AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(l, (cost, audit)) AS l FROM (
    SELECT d.conv_id AS conv_id, CAST(d.cost + i.c AS BIGINT) AS cost, d.audit || i.a AS audit, d.l || CAST(i.l AS VARCHAR[]) AS l
    FROM dp d JOIN sums s ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.n = d.r JOIN ins i ON i.src = d.st WHERE i.dst IN (0, 3)) GROUP BY conv_id)
SELECT o.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fin f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
