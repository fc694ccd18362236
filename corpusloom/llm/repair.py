"""Conversation structure repair by Knuth's lightest derivations.

A conversation is well formed if its roles read ``(s?(ua)+)?`` by their initials. Each row is kept, given another role
or deleted, and empty turns may be inserted. Derivations are weighted deductions: an item ``(i, s)`` says how the rows
from ``i`` on end in an accepted state if ``s`` was reached before them, and its weight is (cost, audit), the audit
being the edits' initials in order. The agenda (:func:`lightest`) pops the lightest item, which is then final, and puts
forward what follows from it, until the goal is popped. Among equal costs items with fewer rows come first, so every
deduction is superior: it puts something in front of an audit and adds a cost or a row. It is also monotone, as an
audit in front of others keeps their order.

Rows are sorted over the cluster by conversation and turn, so a long conversation spans tasks. Each task derives its
conversations of up to ``BLOCK`` rows whole. Of longer ones, and of those at the ends of its range, it derives blocks, once
for every pair of states (``Block``), and joins neighbours by deductions with two premises. The blocks of a conversation
then meet, some for each task, and its repaired text is streamed once more for the digest, which needs it in one piece.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.llm import common

BLOCK = 64
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: State before and initial of the next role: the state behind it. ``-`` is the state of no rows.
STEPS = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
STATES, ACCEPTED = "-sua", "-a"
LEGAL = {"su", "ua", "au"}
_WHITE = " \t\n\v\f\r"


@dataclass(frozen=True)
class Row:
    initial: str
    must_go: bool
    cut_off: bool


def deductions(row: Row) -> Iterator[tuple[str, str, int, str]]:
    """(state before, state behind, cost, edit) of each way to deal with a row."""
    extra = CUT_OFF if row.cut_off else 0
    for state in STATES:
        yield state, state, DELETE, "D"
    if not row.must_go:
        for (state, initial), behind in STEPS.items():
            if initial == row.initial:
                yield state, behind, KEEP + extra, "K"
            if initial in ROLES:
                yield state, behind, REROLE + extra, "R"


INSERTS = [(state, behind, INSERT, "I") for (state, initial), behind in STEPS.items() if initial in ROLES]


def lightest(rows: list[Row], ends: str, goals: str) -> dict[str, tuple[int, str]]:
    """For each state of ``goals`` before the rows the lightest (cost, audit) that reaches one of ``ends`` behind them."""
    n = len(rows)
    behind = [[] for _ in range(n + 1)]  # what follows from an item (i, state): edits that lead to it
    for i, row in enumerate(rows):
        behind[i + 1] = list(deductions(row))
    agenda = [(0, 0, "", s) for s in ends]
    heapq.heapify(agenda)
    final: set[tuple[int, str]] = set()
    found: dict[str, tuple[int, str]] = {}
    while agenda and len(found) < len(goals):
        cost, used, audit, state = heapq.heappop(agenda)
        if (used, state) in final:
            continue
        final.add((used, state))
        i = n - used
        if i == 0 and state in goals:
            found[state] = (cost, audit)
        for before, after, price, edit in INSERTS:
            if after == state and (used, before) not in final:
                heapq.heappush(agenda, (cost + price, used, edit + audit, before))
        for before, after, price, edit in behind[i]:
            if after == state and (used + 1, before) not in final:
                heapq.heappush(agenda, (cost + price, used + 1, edit + audit, before))
    return found


Block = dict[str, tuple[int, str]]  # "state before, state behind": (cost, audit)


def block_of(rows: list[Row]) -> Block:
    return {s + t: found for t in STATES for s, found in lightest(rows, t, STATES).items()}


def joined(left: Block, right: Block) -> Block:
    """Blocks of neighbouring rows as one: both premises' weights add up, the lightest state between wins.

    Derivations of one block with equal costs never have audits of which one begins another, as each names every row of
    the block and an insertion costs, so this is monotone in the left premise as well.
    """
    out: Block = {}
    for (s, between), (cost, audit) in left.items():
        for (start, t), (more, rest) in right.items():
            if start == between:
                found = (cost + more, audit + rest)
                if s + t not in out or found < out[s + t]:
                    out[s + t] = found
    return out


class Blocks:
    """Joins blocks as they come, those of like length first, so that no audit is copied often."""

    def __init__(self):
        self.held: list[tuple[int, Block]] = []

    def add(self, block: Block, level: int = 0) -> None:
        while self.held and self.held[-1][0] <= level:
            higher, left = self.held.pop()
            block, level = joined(left, block), max(higher, level) + 1
        self.held.append((level, block))

    def whole(self) -> Block:
        while len(self.held) > 1:
            (_, right), (level, left) = self.held.pop(), self.held.pop()
            self.held.append((level, joined(left, right)))
        return self.held[0][1] if self.held else {s + s: (0, "") for s in STATES}


def best(block: Block) -> tuple[int, str]:
    return min(block["-" + t] for t in ACCEPTED if "-" + t in block)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The rows (role, text) that an audit makes of ``rows``."""
    state = "-"
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if state == "u" else "u"]
        state = STEPS[state, role[:1]]
        yield role, text


class Digest:
    """SHA-256 of ``role:text`` lines."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def hex(self) -> str:
        return self.sha.hexdigest()


@dataclass
class Part:
    """What is known of consecutive rows of a conversation; neighbours are joined by :meth:`follow`."""

    first_turn: int | None = None
    last_turn: int | None = None
    turns: int = 0
    first_initial: str | None = None
    last_initial: str | None = None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def follow(self, other: Part) -> None:
        if other.first_initial is not None:
            self.illegal += self.last_initial is not None and self.last_initial + other.first_initial not in LEGAL
            self.first_initial = other.first_initial if self.first_initial is None else self.first_initial
            self.last_initial = other.last_initial
        if other.first_turn is not None:
            self.turns -= self.last_turn == other.first_turn and self.last_turn is not None
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        self.turns += other.turns
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0


def _part(turn: int | None, role: str, fault: str | None) -> Part:
    known = turn is not None
    return Part(turn, turn, int(known), role[:1], role[:1], fault == "blank", fault == "duplicate", fault == "truncated")


_FOUND = "blocks array<struct<pair: string, cost: long, audit: string>>"
_PART = (
    "part struct<first_turn: long, last_turn: long, turns: long, first_initial: string, last_initial: string, "
    "blank: long, duplicate: long, truncated: long, illegal: long>"
)
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _result(part: Part, block: Block) -> dict:
    cost, audit = best(block)
    counts = {n: int(getattr(part, n)) for n in ("blank", "duplicate", "truncated", "illegal")}
    return {"gaps": part.gaps(), **counts, "cost": cost, "audit": audit}


def _derive(conv_type: str):
    """Rows in order to one row per conversation, or per task a part of one that is long or may go on elsewhere."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        begun, conv, held, blocks, part, opens = False, None, [], None, None, True

        def close(edge: bool):
            """Finish the conversation in hand."""
            row = {"conv": conv}
            rows = [r for r, _, _ in held]
            if blocks.held or edge:
                if rows:
                    blocks.add(block_of(rows))
                found = [{"pair": p, "cost": c, "audit": a} for p, (c, a) in blocks.whole().items()]
                counts = {k: v if v is None or isinstance(v, str) else int(v) for k, v in vars(part).items()}
                return row | {"part": counts, "blocks": found}
            cost, audit = lightest(rows, ACCEPTED, "-")["-"]
            digest = Digest()
            for role, text in repaired(audit, iter([(role, text) for _, role, text in held])):
                digest.add(role, text)
            return row | {"result": _result(part, {"--": (cost, audit)}), "repaired_sha256": digest.hex()}

        for batch in batches:
            names = ("conv", "turn", "role", "text", "fault", "copies")
            for c, turn, role, text, fault, copies in zip(*(batch.column(n).to_pylist() for n in names)):
                if not begun or c != conv:
                    if begun:
                        out.append(close(edge=opens))
                        opens = False
                    begun, conv, held, blocks, part = True, c, [], Blocks(), Part()
                for copy in range(copies):
                    now = fault if copy == 0 or fault == "blank" else "duplicate"
                    held.append((Row(role[:1], now in ("blank", "duplicate"), now == "truncated"), role, text))
                    part.follow(_part(turn, role, now))
                    if len(held) == BLOCK:
                        blocks.add(block_of([r for r, _, _ in held]))
                        held = []
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if begun:
            out.append(close(edge=True))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    spark_schema = f"conv {conv_type}, {_PART}, {_FOUND}, result struct<{_RESULT}>, repaired_sha256 string"
    schema = _arrow(spark_schema)
    return task, spark_schema


def _digests(conv_type: str):
    """Rows in order, each conversation led by its audit, to the digest of what the audit makes of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                names = ("conv", "audit", "role", "text", "copies")
                yield from zip(*(batch.column(n).to_pylist() for n in names))

        def texts():  # of the conversation in hand, copies as often as they stand there
            nonlocal ahead
            for ahead in stream:
                if ahead[1] is not None:
                    return
                for _ in range(ahead[4]):
                    yield ahead[2], ahead[3]
            ahead = None

        stream = iter(rows())
        ahead = next(stream, None)
        while ahead is not None:
            conv, audit, digest, own = ahead[0], ahead[1], Digest(), texts()
            for role, text in repaired(audit, own):
                digest.add(role, text)
            for _ in own:
                pass
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hex()}], schema)

    spark_schema = f"conv {conv_type}, repaired_sha256 string"
    schema = _arrow(spark_schema)
    return task, spark_schema


def _meet(parts: Column) -> Column:
    """The parts of one conversation, in order, as its result."""

    @F.arrow_udf(f"{_RESULT}")
    def join(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            part, blocks = Part(), Blocks()
            for piece in row:
                part.follow(Part(**piece["part"]))
                blocks.add({b["pair"]: (b["cost"], b["audit"]) for b in piece["blocks"]})
            out.append(_result(part, blocks.whole()))
        names = [n.split()[0] for n in _RESULT.split(", ")]
        kinds = [pa.string() if n == "audit" else pa.int64() for n in names]
        return pa.StructArray.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names)

    return join(parts)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``turns`` with faults planted by ``crc32(conv:turn) % 20``, and ``copies``, how often a row stands there (0: dropped).

    1 empties the text, 2 takes its ``.!?``, 3 repeats the row, 4 makes it a user's. Nulls read as one space, also in
    the key.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv_col), F.lit(":"), plain(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain(text_col), "[.!?]", "")).otherwise(plain(text_col))
    return turns.withColumns({
        "copies": F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1),
        role_col: F.when(kind == 4, "user").otherwise(plain(role_col)),
        text_col: text,
    })


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None
) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, a row per conversation.

    Rows are in order of turn (null first), then role and the MD5 digest of the text. ``copies_col`` tells how often a
    row stands there (default once); a conversation whose rows all have 0 copies has zeros, an empty audit and the
    digest of an empty string. Equal rows are copies as well. A row's first fault counts: blank (no character but
    white space), duplicate (role and text stand earlier), truncated (does not end in ``.!?``). ``gaps`` counts turn
    numbers that are missing between the first and the last, ``illegal`` neighbours whose role initials are not su, ua or
    au. Null roles and texts read as one space. A null conversation id is a conversation like others. Other columns are
    not read. An empty table gives an empty one.
    """
    conv_type = turns.schema[conv_col].dataType.simpleString()
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), plain(role_col).alias("role"), plain(text_col).alias("text"),
        (F.col(copies_col) if copies_col else F.lit(1)).cast("long").alias("copies"),
    ).withColumn("at", F.struct(F.col("turn").isNotNull(), "turn")).withColumn("h", F.unhex(F.md5("text")))
    there = given.where("copies > 0")
    same = ["conv", "role", "h"]
    # Narrow rows: copies of a row count as one with more copies; later ones of equal rows at several turns are duplicates.
    counted = there.groupBy(*same, "at").agg(F.sum("copies").alias("copies"))
    first = counted.groupBy(*same).agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").drop("last")
    marks = counted.join(first.select(*[F.col(c).alias(f"_{c}") for c in same], "first"), F.expr(" AND ".join(f"{c} <=> _{c}" for c in same)), "left")
    odd = marks.withColumn("later", F.coalesce(F.col("at") > F.col("first"), F.lit(False))).where("later OR copies > 1")
    odd = odd.select(*[F.col(c).alias(f"_{c}") for c in same], F.col("at").alias("_at"), F.col("copies").alias("_copies"), "later")
    same_row = F.expr(" AND ".join(f"{c} <=> _{c}" for c in [*same, "at"]))
    said = F.rtrim("text", F.lit(_WHITE))
    fault = F.when(said == "", "blank").when(F.col("later"), "duplicate").when(~F.right(said, F.lit(1)).isin(*".!?"), "truncated")
    rows = there.drop("copies").join(odd, same_row, "left").select(
        "conv", "turn", "at", "role", "h", "text", fault.alias("fault"), F.coalesce("_copies", F.lit(1)).alias("copies"), F.col("_copies").isNotNull().alias("many")
    )
    single = rows.where("NOT many").drop("many").unionByName(rows.where("many").drop("many").dropDuplicates(["conv", "at", "role", "h"]))
    rows = common.stored(single)
    order = ["conv", "at", "role", "h"]
    spread = rows.repartitionByRange(common.parts(turns), *order).sortWithinPartitions(*order)
    task, schema = _derive(conv_type)
    columns = ["conv", "turn", "role", "text", "fault", "copies"]
    derived = common.stored(spread.select(*columns).mapInArrow(task, schema).withColumn("task", F.spark_partition_id()))
    done = derived.where("result IS NOT NULL").select("conv", "result.*", "repaired_sha256")
    pieces = derived.where("result IS NULL").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("task", "part", "blocks"))).alias("pieces"))
    met = common.stored(pieces.withColumn("result", _meet(F.col("pieces"))).select("conv", "result.*"))
    long = rows.join(met.select(F.col("conv").alias("_conv")), F.expr("conv <=> _conv"), "left_semi")
    lead = met.select("conv", "audit")
    streamed = long.select("conv", "at", "role", "h", "text", "copies").unionByName(lead, allowMissingColumns=True)
    ordered = streamed.repartition(common.parts(turns), "conv").sortWithinPartitions("conv", F.col("audit").isNull(), "at", "role", "h")
    digest_task, digest_schema = _digests(conv_type)
    digests = ordered.select("conv", "audit", "role", "text", "copies").mapInArrow(digest_task, digest_schema)
    joined_up = met.join(digests.withColumnRenamed("conv", "_conv"), F.expr("conv <=> _conv")).drop("_conv")
    found = done.unionByName(joined_up)
    zeros = {n: F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    every = given.select("conv").distinct()
    whole = every.join(found.withColumnRenamed("conv", "_conv"), F.expr("conv <=> _conv"), "left")
    return whole.select(
        F.col("conv").alias(conv_col), *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
