"""Repair of conversations' structure: the cheapest edits that make the roles an optional system turn followed by pairs of user and assistant.

Each turn is kept, gets another role, or is deleted; before it, and at the end, turns may be inserted. A run of k inserts and the edit of the turn behind it are one
macro edit with the code I..IX. No code is the beginning of another, so of two sequences of as many codes the one whose first different code is
smaller gives the smaller audit, whatever follows. The dynamic program goes turn by turn over four states (nothing yet, after system, after user, after
assistant). A layer holds for each state its least cost and the rank of its audit among the layer's: a candidate is compared by cost, its parent's rank and its
code, no audit is ever built, and parent pointers give it back at the end. Steps are remembered by layer (costs less the least) and kind of turn, of which
there are few, so a turn costs one look-up.

Conversations of up to ``turns`` turns and ``size`` bytes, both parameters, are gathered and repaired one by one in the task that has them. A longer one is
never gathered: its turns are dealt over tasks by range, cut into blocks of up to ``block`` turns, and each block is solved from all four states at once. Its 16 costs
and ranks act as one layer of the same program, of which a second pass goes over the blocks' summaries, and a third rebuilds each block where it is. Only the
digest of the repaired text is made in order, as SHA-256 must be: block by block, holding one at a time.

Defined cases: turns are taken by turn (nulls first), role and text. Null roles and texts are one space, and so are null ids and turns in the text that decides
damage; rows with a null conv_id are one conversation. Repeated rows are turns of their own. A role other than those that begin with s, u or a, or an empty one, can't
be kept. White space is ASCII's. A conversation without turns has zeros, an empty audit and the digest of nothing. Empty tables give no rows. Within a long conversation
turns of one number, role and first 64 characters pass through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import INT, LONG, STRING, batch_of, durable, few_rows_a_batch, schema, small_batches

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = STATES = range(4)
#: Where a kept or made turn leads, by the initial of its role; where an inserted one leads; the inserts that end a conversation.
NEXT = ({"s": AFTER_SYSTEM, "u": AFTER_USER}, {"u": AFTER_USER}, {"a": AFTER_ASSISTANT}, {"u": AFTER_USER})
INSERTED = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
AT_END = (0, 2, 1, 0)
MADE = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
MOST_INSERTS = 2
CODES = sorted("I" * k + edit for k in range(MOST_INSERTS + 1) for edit in "DKR")
CODE = {c: i for i, c in enumerate(CODES)}

#: Faults of a turn.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {"su", "ua", "au"}

Layer = tuple[tuple[int, int] | None, ...]
Kind = tuple[str, int]


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def entered(state: int) -> Layer:
    """The layer in which only one state is reached, at no cost."""
    return tuple((0, 0) if s == state else None for s in STATES)


@dataclass
class Program:
    """The steps of the dynamic program; costs of inserts and deletions must be above 0."""

    costs: Costs = Costs()
    _moves: dict[Kind, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    _steps: dict[tuple[Layer, Kind], tuple[Layer, int, tuple]] = field(default_factory=dict)

    def moves(self, kind: Kind) -> list[tuple[int, int, int, int]]:
        """Macro edits of a turn (initial, fault): from, to, cost, code."""
        if kind not in self._moves:
            initial, fault = kind
            kept = self.costs.truncated if fault == TRUNCATED else 0
            out = []
            for state in STATES:
                at = state
                for k in range(MOST_INSERTS + 1):
                    ways = [(at, self.costs.delete, "D")]
                    if fault not in (BLANK, DUPLICATE):
                        ways += [(NEXT[at][x], kept, "K") for x in (initial,) if x in NEXT[at]]
                        ways += [(NEXT[at][x], kept + self.costs.rerole, "R") for x in "ua" if x in NEXT[at]]
                    out += [(state, to, k * self.costs.insert + c, CODE["I" * k + edit]) for to, c, edit in ways]
                    at = INSERTED[at]
            self._moves[kind] = out
        return self._moves[kind]

    def best(self, candidates: Iterable[tuple[int, int, int, int, int]]) -> tuple[Layer, int, tuple]:
        """candidates: to, cost, rank before, order within that rank, from. The layer less its least cost, that cost, and of each state (from, order)."""
        found: list[tuple[int, int, int, int] | None] = [None] * 4
        for to, *rest in candidates:
            c = tuple(rest)
            if found[to] is None or c < found[to]:
                found[to] = c
        # What follows a pair can follow nothing as well, but for a system turn, which can be deleted; so these two can't win any more.
        paired = found[AFTER_ASSISTANT]
        if paired and found[START] and paired[0] + self.costs.delete < found[START][0]:
            found[START] = None
        if paired and found[AFTER_SYSTEM] and paired[0] < found[AFTER_SYSTEM][0]:
            found[AFTER_SYSTEM] = None
        least = min(f[0] for f in found if f)
        ranks = {x: i for i, x in enumerate(sorted({f[1:3] for f in found if f}))}
        return tuple((f[0] - least, ranks[f[1:3]]) if f else None for f in found), least, tuple((f[3], f[2]) if f else None for f in found)

    def step(self, layer: Layer, kind: Kind) -> tuple[Layer, int, tuple]:
        """The layer behind a turn, what all its costs have grown by, and the parents (state, code)."""
        key = layer, kind
        if key not in self._steps:
            if len(self._steps) > 100_000:
                self._steps.clear()
            self._steps[key] = self.best((to, layer[at][0] + c, layer[at][1], code, at) for at, to, c, code in self.moves(kind) if layer[at])
        return self._steps[key]

    def through(self, layer: Layer, kinds: list[Kind]) -> tuple[Layer, int, list[tuple]]:
        """The layer behind all turns, what costs have grown by, and the parents of each layer."""
        total, parents = 0, []
        for kind in kinds:
            layer, grown, p = self.step(layer, kind)
            total += grown
            parents.append(p)
        return layer, total, parents

    def end(self, layer: Layer) -> tuple[int, int]:
        """The state to end in, by cost, rank and the inserts that follow; and what it costs more than the layer's least."""
        cost, _, _, state = min((layer[s][0] + AT_END[s] * self.costs.insert, layer[s][1], AT_END[s], s) for s in STATES if layer[s])
        return state, cost


def traced(parents: list[tuple], state: int) -> list[int]:
    """The codes, or orders, on the way to a state."""
    back = []
    for p in reversed(parents):
        state, code = p[state]
        back.append(code)
    return back[::-1]


def rebuilt(codes: list[int], turns: list[tuple[str, bytes]], state: int, last: bool) -> tuple[str, list[bytes]]:
    """Audit and repaired turns of codes; turns: role, text. ``last``: with the inserts at the end."""
    lines, audit = [], [CODES[c] for c in codes]

    def insert(state: int) -> int:
        lines.append(MADE[INSERTED[state]].encode() + b":")
        return INSERTED[state]

    for code, (role, text) in zip(audit, turns, strict=True):
        for _ in code[:-1]:
            state = insert(state)
        if code[-1] == "K":
            state = NEXT[state][role[:1]]
        elif code[-1] == "R":
            state = NEXT[state]["a" if state == AFTER_USER else "u"]
            role = MADE[state]
        if code[-1] != "D":
            lines.append(role.encode() + b":" + text)
    if last:
        audit.append("I" * AT_END[state])
        for _ in range(AT_END[state]):
            state = insert(state)
    return "".join(audit), lines


def fault_of(text: bytes, seen: bool) -> int:
    """The first fault of a turn; bytes are stripped of ASCII white space."""
    bare = text.strip()
    return BLANK if not bare else DUPLICATE if seen else TRUNCATED if bare[-1:] not in (b".", b"!", b"?") else FINE


def measured(turns: list[tuple[int | None, str, int]]) -> dict[str, int]:
    """Counts of turns in order; turns: number, role, fault."""
    numbers = {t for t, _, _ in turns if t is not None}
    faults = [f for _, _, f in turns]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(turns, turns[1:])),
    }


def repaired(turns: list[tuple[int | None, str, bytes]], program: Program) -> dict[str, object]:
    """One conversation; turns in order: number, role, text."""
    seen, faults = set(), []
    for _, role, text in turns:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    layer, cost, parents = program.through(entered(START), [(t[1][:1], f) for t, f in zip(turns, faults, strict=True)])
    state, more = program.end(layer)
    audit, lines = rebuilt(traced(parents, state), [t[1:] for t in turns], START, True)
    return measured([(n, r, f) for (n, r, _), f in zip(turns, faults, strict=True)]) | {"cost": cost + more, "audit": audit, "repaired_sha256": hashlib.sha256(b"\n".join(lines)).hexdigest()}


def runs(rows: Iterable[tuple], most: int | None = None) -> Iterator[list[tuple]]:
    """Rows that follow one another with the same first value, up to ``most`` at a time."""
    held: list[tuple] = []
    for r in rows:
        if held and (r[0] != held[0][0] or len(held) == most):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in small_batches(batches):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def in_batches(out: Iterator[dict], kinds: T.StructType, most: int = 500) -> Iterator[pa.RecordBatch]:
    held = []
    for row in out:
        held.append(row)
        if len(held) == most:
            yield batch_of(kinds, {f.name: [r[f.name] for r in held] for f in kinds})
            held = []
    if held:
        yield batch_of(kinds, {f.name: [r[f.name] for r in held] for f in kinds})


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
RESULT = schema(conv_id=LONG, **{c: LONG for c in (*COUNTS, "cost")}, audit=STRING, repaired_sha256=STRING)
SUMMARY = T.StructType([*schema(conv_id=LONG, block=LONG, costs=T.ArrayType(INT), ranks=T.ArrayType(INT), grown=T.ArrayType(LONG), numbers=LONG, least=LONG, largest=LONG, head=STRING, tail=STRING).fields, *schema(**{c: LONG for c in COUNTS[1:]}).fields])
BLOCK = T.StructType([*SUMMARY.fields, *schema(roles=T.ArrayType(STRING), texts=T.ArrayType(T.BinaryType()), faults=T.ArrayType(INT)).fields])
CHOSEN = T.StructType([*schema(block=LONG, enter=INT, leave=INT, last=T.BooleanType()).fields, *RESULT.fields[1:-2]])
PIECE = T.StructType([*schema(conv_id=LONG, block=LONG, last=T.BooleanType(), lines=LONG, audit=STRING, body=T.BinaryType()).fields, *RESULT.fields[1:-2]])


def repair(turns: DataFrame, costs: Costs = Costs(), most_turns: int = 5_000, most_bytes: int = 64 << 20, block: int = 1_000) -> DataFrame:
    """A row a conversation of ``turns``: conv_id, turn, role, text, times (how often the turn stands there; 0: the conversation is reported without it)."""
    few_rows_a_batch(turns.sparkSession)
    turns = turns.select(F.col("conv_id").cast(LONG), F.col("turn").cast(LONG), "role", F.col("text").cast("binary").alias("text"), F.col("times").cast(INT))
    sizes = turns.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text") * F.col("times")).alias("bytes"))
    ids = durable(sizes.filter((F.col("n") > most_turns) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("long_id")))
    n = ids.count()
    if not n:
        return _short(turns, costs)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    listed = F.broadcast(ids) if n <= 1_000_000 else ids  # 8 MB at most
    return _short(turns.join(listed, same, "left_anti"), costs).unionByName(_long(turns.join(listed, same, "left_semi"), costs, block))


def _short(turns: DataFrame, costs: Costs) -> DataFrame:
    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(costs)
        return in_batches(({"conv_id": own[0][0]} | repaired([r[1:4] for r in own for _ in range(r[4])], program) for own in runs(rows_of(batches))), RESULT)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").mapInArrow(conversations, RESULT)


def _summary(own: list[tuple], program: Program) -> dict[str, object]:
    """What the other blocks must know of one; own: conv_id, pos, turn, role, text, fault."""
    kinds = [(r[3][:1], r[5]) for r in own]
    numbers = [r[2] for r in own if r[2] is not None]
    ways = [program.through(entered(s), kinds)[:2] for s in STATES]
    flat = [x for layer, _ in ways for x in layer]
    return measured([(r[2], r[3], r[5]) for r in own]) | {
        "conv_id": own[0][0], "block": own[0][1], "costs": [-1 if x is None else x[0] for x in flat], "ranks": [-1 if x is None else x[1] for x in flat], "grown": [g for _, g in ways],
        "numbers": len(set(numbers)), "least": numbers[0] if numbers else None, "largest": numbers[-1] if numbers else None, "head": own[0][3][:1], "tail": own[-1][3][:1],
    }


def _chosen(blocks: list[dict], program: Program) -> Iterator[dict]:
    """The states in which each block of a conversation is entered and left, and with the last one the conversation's counts and cost."""
    layer, cost, parents, last = entered(START), 0, [], None
    total = dict.fromkeys((*COUNTS, "numbers"), 0)
    low = high = None
    for b in blocks:
        ways = [(to, layer[at][0] + b["grown"][at] + b["costs"][4 * at + to], layer[at][1], b["ranks"][4 * at + to], at) for at in STATES if layer[at] for to in STATES if b["costs"][4 * at + to] >= 0]
        layer, grown, p = program.best(ways)
        cost += grown
        parents.append(p)
        for c in (*COUNTS[1:], "numbers"):
            total[c] += b[c]
        if last is not None:
            total["illegal"] += last["tail"] + b["head"] not in LEGAL
        if b["least"] is not None:
            total["numbers"] -= b["least"] == high
            low, high = b["least"] if low is None else low, b["largest"]
        last = b
    state, more = program.end(layer)
    total |= {"gaps": high - low + 1 - total.pop("numbers") if low is not None else 0, "cost": cost + more}
    out = []
    for b, p in zip(reversed(blocks), reversed(parents), strict=True):
        before = p[state][0]
        out.append({"block": b["block"], "enter": before, "leave": state, "last": b is last} | total)
        state = before
    return reversed(out)


def _long(turns: DataFrame, costs: Costs, block: int) -> DataFrame:
    each = turns.filter("times > 0").select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")
    keys = ("conv_id", F.asc_nulls_first("turn"), "role")
    ordered = each.repartitionByRange(*keys, F.substring("text", 1, 64), F.monotonically_increasing_id()).sortWithinPartitions(*keys, "text")
    rows = durable(ordered.withColumn("pos", F.monotonically_increasing_id()))
    # The first of equal turns isn't a duplicate: a mark with its position stands before it in the order of positions.
    marks = rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("mark"))
    placed = rows.unionByName(marks, allowMissingColumns=True).repartitionByRange("pos").sortWithinPartitions("pos", F.asc_nulls_last("mark"))

    def judged(rows: Iterator[tuple]) -> Iterator[tuple]:
        first = None
        for conv, turn, role, text, pos, mark in rows:
            if mark:
                first = pos
            else:
                yield conv, pos, turn, role, text, fault_of(text, pos != first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(costs)
        made = (_summary(own, program) | {"roles": [r[3] for r in own], "texts": [r[4] for r in own], "faults": [r[5] for r in own]} for own in runs(judged(rows_of(batches)), block))
        return in_batches(made, BLOCK, 1)

    blocks = durable(placed.select("conv_id", "turn", "role", "text", "pos", "mark").mapInArrow(cut, BLOCK))
    names = SUMMARY.names

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(costs)
        return in_batches((c for own in runs(rows_of(batches)) for c in _chosen([dict(zip(names, r, strict=True)) for r in own], program)), CHOSEN)

    chosen = blocks.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(choose, CHOSEN)
    at = [f.name for f in CHOSEN][1:]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(costs)

        def pieces() -> Iterator[dict]:
            for conv, number, roles, texts, faults, *rest in rows_of(batches):
                way = dict(zip(at, rest, strict=True))
                _, _, parents = program.through(entered(way["enter"]), [(r[:1], f) for r, f in zip(roles, faults, strict=True)])
                audit, lines = rebuilt(traced(parents, way["leave"]), list(zip(roles, texts, strict=True)), way["enter"], way["last"])
                yield way | {"conv_id": conv, "block": number, "lines": len(lines), "audit": audit, "body": b"\n".join(lines)}

        return in_batches(pieces(), PIECE, 1)

    # Blocks have numbers of their own, so no key of this join is hot.
    wide = blocks.select("conv_id", "block", "roles", "texts", "faults").join(chosen, "block").select("conv_id", "block", "roles", "texts", "faults", *at)
    pieces = wide.mapInArrow(rebuild, PIECE)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[dict]:
            sha, audit, lines = hashlib.sha256(), [], 0
            for r in rows_of(batches):
                piece = dict(zip(PIECE.names, r, strict=True))
                if piece["lines"]:
                    sha.update(b"\n" * (lines > 0) + piece["body"])
                audit.append(piece["audit"])
                lines += piece["lines"]
                if piece["last"]:
                    yield piece | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                    sha, audit, lines = hashlib.sha256(), [], 0

        return in_batches(conversations(), RESULT)

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(digest, RESULT)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times of conversations (conv_id, turn, role, text) after the damage that crc32 of id and turn decides."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    harm = F.crc32(named.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm <= 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("times"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


OP12_SQL = """
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))) AS name FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(name) + 1), lambda i: ascii(chr(('0x' || substr(hex(name), 2 * i - 1, 2))::INT))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS harm FROM k),
d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS illegal FROM n),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id),
-- Ways to edit a turn behind up to two inserted ones: states 0 (nothing yet), 1 (after system), 2 (after user), 3 (after assistant).
w AS (SELECT * FROM (VALUES (0, 0, ''), (0, 1, 'u'), (0, 2, 'ua'), (1, 0, ''), (1, 1, 'u'), (1, 2, 'ua'), (2, 0, ''), (2, 1, 'a'), (2, 2, 'au'), (3, 0, ''), (3, 1, 'u'), (3, 2, 'ua')) AS t(s, k, ins)),
v AS (SELECT s, k, ins, CASE right(ins, 1) WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE s END AS mid FROM w),
e AS (SELECT s, k, ins, edit, want, CASE WHEN edit = 'D' THEN mid ELSE CASE want WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS t FROM v, (VALUES ('D', ''), ('K', 's'), ('K', 'u'), ('K', 'a'), ('R', 'u'), ('R', 'a')) AS x(edit, want)
    WHERE edit = 'D' OR (want = 's' AND mid = 0) OR (want = 'u' AND mid IN (0, 1, 3)) OR (want = 'a' AND mid = 2)),
p AS (SELECT conv_id, 0 AS i, 0 AS s, {'cost': 0, 'audit': '', 'body': ''} AS b FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT p.conv_id, (p.i + 1)::INT AS i, e.t AS s, min({'cost': (p.b.cost + 5 * e.k + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN f.fault = 't' AND e.edit <> 'D' THEN 5 ELSE 0 END)::INT, 'audit': p.b.audit || repeat('I', e.k) || e.edit,
        'body': p.b.body || replace(replace(e.ins, 'a', chr(10) || 'assistant:'), 'u', chr(10) || 'user:') || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || CASE e.want WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text END}) AS b
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN e ON e.s = p.s AND (e.edit = 'D' OR (f.fault NOT IN ('b', 'd') AND (e.edit = 'R' OR e.want = f.c))) GROUP BY p.conv_id, p.i, e.t),
z AS (SELECT conv_id, min({'cost': b.cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, 'audit': b.audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'body': b.body || CASE s WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}) AS b
    FROM p WHERE i = (SELECT count(*) FROM f WHERE f.conv_id IS NOT DISTINCT FROM p.conv_id) GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    b.cost::BIGINT AS cost, b.audit AS audit, sha256(substr(b.body, 2)) AS repaired_sha256 FROM z LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM z.conv_id
"""
