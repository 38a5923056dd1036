"""Conversation structure repair: cheapest edits by a checkpointed dynamic programme.

A repaired conversation's role initials are ``(s?(ua)+)?``. Costs run backward over the rows; only every
``sqrt(n)``-th vector of state costs is kept, and the walk forward computes one block of them
again at a time, taking the ASCII-least edit that is still on a cheapest way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import WORD, register, table

# Fixed values of the repair: what each edit costs, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT = "blank", "duplicate", "truncated"
FAULTS = [None, BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT]
NEVER = 1 << 60

# States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
# The role each state waits for next, and the state after it; a conversation may end in 0 and 3.
NEXT_ROLE = ["user", "user", "assistant", "user"]
NEXT_STATE = [2, 2, 3, 2]
AT_END = [0, NEVER, NEVER, 0]


def keep_state(state: int, initial: str) -> int | None:
    """The state after keeping a row with this initial, None where the grammar forbids it."""
    if initial == "s":
        return 1 if state == 0 else None
    return NEXT_STATE[state] if initial == NEXT_ROLE[state][0] else None


def with_inserts(costs: list[int]) -> list[int]:
    """Let every state also insert the rows it waits for; two in a row lead from any state to any wait."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT_STATE[s]]) for s, c in enumerate(costs)]
    return costs


def row_costs(after: list[int], code: int) -> list[int]:
    """State costs before a row from those after it; ``code`` is :func:`row_code`'s."""
    initial, must_go, extra = decoded(code)
    out = []
    for s in range(4):
        best = DELETE + after[s]
        if not must_go:
            kept = keep_state(s, initial)
            if kept is not None:
                best = min(best, extra + after[kept])
            best = min(best, REROLE + extra + after[NEXT_STATE[s]])
        out.append(best)
    return with_inserts(out)


def row_code(role: str, fault: str | None) -> int:
    """A row as one byte: its initial's place in ``sua`` (3: any other) and its fault's."""
    return ("sua".find(role[:1]) % 4 if role else 3) * 4 + FAULTS.index(fault)


def decoded(code: int) -> tuple[str, bool, int]:
    fault = FAULTS[code % 4]
    return "sua?"[code // 4], fault in (BLANK_FAULT, DUPLICATE_FAULT), TRUNCATED * (fault == TRUNCATED_FAULT)


def cheapest_edits(codes: bytes | bytearray) -> tuple[int, str]:
    """Cost and audit (initials of the edits in order) of the cheapest repair, ties ASCII-least.

    ``codes`` are :func:`row_code` bytes. Holds 4 numbers for each of sqrt(n) checkpoints and one
    block of sqrt(n) rows at a time, beside the codes and the audit of about a byte a row.
    """
    n = len(codes)
    block = isqrt(n) + 1
    costs = with_inserts(AT_END)
    checkpoints = {n: costs}
    for i in range(n - 1, -1, -1):
        costs = row_costs(costs, codes[i])
        if i % block == 0:
            checkpoints[i] = costs
    total, state, audit = costs[0], 0, bytearray()
    for first in range(0, n, block):
        end = min(first + block, n)
        vectors = [checkpoints[end]]
        for i in range(end - 1, first, -1):
            vectors.append(row_costs(vectors[-1], codes[i]))
        here = checkpoints[first]
        for i in range(first, end):
            after = vectors.pop()
            initial, must_go, extra = decoded(codes[i])
            while True:  # D < I < K < R
                if here[state] == DELETE + after[state]:
                    audit += b"D"
                elif here[state] == INSERT + here[NEXT_STATE[state]]:
                    audit += b"I"
                    state = NEXT_STATE[state]
                    continue
                else:
                    kept = None if must_go else keep_state(state, initial)
                    if kept is not None and here[state] == extra + after[kept]:
                        audit += b"K"
                        state = kept
                    else:
                        audit += b"R"
                        state = NEXT_STATE[state]
                break
            here = after
    left = checkpoints[n]
    while left[state]:
        audit += b"I"
        state = NEXT_STATE[state]
    return total, audit.decode()


# Rows ------------------------------------------------------------------------------


def own_faults(text: Column) -> Column:
    """The fault a row shows by itself: blank, or its last character outside white space ends no sentence."""
    blank = ~F.rlike(text, F.lit(WORD))
    ends = F.rlike(text, F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    return F.when(blank, BLANK_FAULT).when(~ends, TRUNCATED_FAULT)


KEY = ["__turn", "__role", "__h1", "__h2", "__copy"]


def repair_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str, copy: Column, gone: Column) -> DataFrame:
    """The rows under names of their own, in an order that two shuffles agree on: turn (nulls first),
    role, 128 bits of the text, copy. Nulls of role and text are one space. ``gone`` rows only
    make their conversation known."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(" "))
    return rows.select(
        F.col(f"`{conv}`").alias("__conv"),
        F.col(f"`{turn}`").cast("long").alias("__turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("__role"),
        value.alias("__text"),
        F.xxhash64(value).alias("__h1"),
        F.xxhash64(F.lit(1), value).alias("__h2"),
        copy.cast("int").alias("__copy"),
        gone.alias("__gone"),
    )


COUNTS = ["gaps", BLANK_FAULT, DUPLICATE_FAULT, TRUNCATED_FAULT, "illegal", "cost"]


def conversation_facts(ordered: DataFrame) -> DataFrame:
    """One row per conversation: its counts, the cost and audit of its cheapest repair.

    Reads rows without their texts, sorted by Spark inside each conversation, as a stream of
    batches; the task keeps one byte a row of the conversation at hand, as the audit has.
    """
    kind = ordered.schema["__conv"].dataType
    narrow = ordered.select("__conv", *KEY, "__gone", own_faults(F.col("__text")).alias("__fault"))
    same = Window.partitionBy("__conv", "__role", "__h1", "__h2", "__gone").orderBy("__turn", "__copy")
    seen = narrow.repartition("__conv").withColumn("__seen", F.row_number().over(same) > 1)
    fault = F.when(F.col("__fault").eqNullSafe(BLANK_FAULT), BLANK_FAULT).when(F.col("__seen"), DUPLICATE_FAULT).otherwise(F.col("__fault"))
    sorted_rows = seen.select("__conv", *KEY, "__gone", "__seen", fault.alias("__fault")).sortWithinPartitions("__conv", *KEY, "__seen")
    schema = T.StructType([T.StructField("__conv", kind), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())])

    def facts(codes: bytearray, turns: list, tally: dict) -> list:
        cost, audit = cheapest_edits(codes)
        first, last, distinct = turns
        gaps = last - first + 1 - distinct if distinct else 0
        return [gaps, tally[BLANK_FAULT], tally[DUPLICATE_FAULT], tally[TRUNCATED_FAULT], tally["illegal"], cost, audit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        out: list[list] = [[] for _ in schema]

        def close() -> None:
            for column, v in zip(out, [now, *facts(codes, turns, tally)], strict=True):
                column.append(v)

        for batch in batches:
            data = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__conv", "__turn", "__role", "__gone", "__fault")]
            for conv, turn, role, gone, fault in zip(*data, strict=True):
                if not started or conv != now:
                    if started:
                        close()
                    now, started = conv, True
                    codes, turns, tally, before = bytearray(), [None, None, 0], dict.fromkeys([*FAULTS, "illegal"], 0), None
                if gone:
                    continue
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                tally[fault] += 1
                initial = role[:1]
                tally["illegal"] += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                codes.append(row_code(role, fault))
            if len(out[0]) >= 1000:
                yield _batch(out, schema)
                out = [[] for _ in schema]
        if started:
            close()
        yield _batch(out, schema)

    return sorted_rows.mapInArrow(run, schema)


def _batch(columns: list[list], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, kinds, strict=True)], schema=kinds)


def repaired(ordered: DataFrame, facts: DataFrame, digest: bool = False) -> DataFrame:
    """The conversations after their audits: rows ``__conv, position, role, text``.

    With ``digest`` one row per conversation instead, its facts and the SHA-256 of its repaired
    ``role:text`` lines joined by line feeds. Each conversation's audit comes first in its task, then
    its rows as a stream, so no task holds a conversation's texts.
    """
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in ordered.schema if f.name != "__conv"]
    told = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != "__conv"]
    both = facts.select("__conv", F.lit(0).alias("__tag"), *[f.name for f in facts.schema if f.name != "__conv"], *empty).unionByName(
        ordered.filter(~F.col("__gone")).select("__conv", F.lit(1).alias("__tag"), *told, *KEY, "__text", "__gone")
    )
    stream = both.repartition("__conv").sortWithinPartitions("__conv", "__tag", *KEY)
    kind = ordered.schema["__conv"].dataType
    if digest:
        schema = T.StructType([*facts.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    else:
        schema = T.StructType([T.StructField("__conv", kind), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    told_names = [f.name for f in facts.schema if f.name != "__conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        walk: _Walk | None = None

        def close() -> None:
            if walk is None:
                return
            walk.finish()
            if digest:
                for column, v in zip(out, [*walk.told, walk.digest.hexdigest()], strict=True):
                    column.append(v)

        def emit(conv, position, role, text) -> None:
            for column, v in zip(out, (conv, position, role, text), strict=True):
                column.append(v)

        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in ("__conv", "__tag", "__role", "__text", *told_names)}
            for i in range(batch.num_rows):
                if at["__tag"][i].as_py() == 0:
                    close()
                    walk = _Walk([at[n][i].as_py() for n in ("__conv", *told_names)], at["audit"][i].as_py(), None if digest else emit)
                else:
                    walk.row(at["__role"][i].as_py(), at["__text"][i].as_py())
                if len(out[0]) >= 1000:
                    yield _batch(out, schema)
                    out[:] = [[] for _ in schema]
        close()
        yield _batch(out, schema)

    return stream.mapInArrow(run, schema)


class _Walk:
    """Replays one audit over the rows as they come."""

    def __init__(self, told: list, audit: str, emit):
        self.told, self.audit, self.emit = told, audit, emit
        self.at, self.state, self.position = 0, 0, 0
        self.digest = hashlib.sha256()

    def put(self, role: str, text: str, state: int) -> None:
        if self.emit:
            self.emit(self.told[0], self.position, role, text)
        else:
            self.digest.update(("\n" * bool(self.position) + f"{role}:{text}").encode())
        self.position += 1
        self.state = state

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.put(NEXT_ROLE[self.state], "", NEXT_STATE[self.state])
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.put(role, text, keep_state(self.state, role[:1]))
        elif edit == "R":
            self.put(NEXT_ROLE[self.state], text, NEXT_STATE[self.state])

    def finish(self) -> None:
        self.inserts()


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copy: Column | None = None, gone: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Repair every conversation; gives its rows in repair's own names and its facts.

    Faults, first that holds: ``blank`` (no character outside white space), ``duplicate`` (role and
    text stood earlier), ``truncated`` (the last such character is none of ``.!?``). Edits: keep, give the
    role user or assistant, delete (blank and duplicate rows always), insert an empty row.

    Rows stand by turn, nulls first; equal turns by role and hash of the text. Null roles and
    texts are one space (so neither a known role nor a text), null conversation keys form one
    conversation, other columns are not read, an empty table gives no rows. A conversation is
    walked by one task, as its digest and audit are sequential, but as a stream: the task holds one
    byte a row and never its texts.
    """
    ordered = repair_rows(rows, conv, turn, role, text, F.lit(0) if copy is None else copy, F.lit(False) if gone is None else gone)
    return ordered, conversation_facts(ordered)


def repaired_conversations(rows: DataFrame, **names: str) -> DataFrame:
    """The repaired conversations as rows ``conv_id, position, role, text``; those left empty have none."""
    ordered, facts = repair(rows, **names)
    return repaired(ordered, facts).withColumnRenamed("__conv", "conv_id")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn`` (nulls as one space) modulo 20.

    0 drops the row (kept with ``__gone``, so that its conversation is known), 1 empties its text, 2 removes ``.!?`` from it,
    3 repeats the row (``__copy``), 4 makes it a user row.
    """
    word = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    case = F.crc32(F.concat(word[0], F.lit(":"), word[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (case == 0).alias("__gone"),
        F.explode(F.sequence(F.lit(0), F.when(case == 3, 1).otherwise(0))).alias("__copy"),
    )


@register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    ordered, facts = repair(rows, copy=F.col("__copy"), gone=F.col("__gone"))
    out = repaired(ordered, facts, digest=True).withColumnRenamed("__conv", "conv_id")
    return out.select("conv_id", *COUNTS, "audit", "repaired_sha256")
