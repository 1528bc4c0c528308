"""Conversation structure repair: a run-length dynamic programme over min-plus transitions.

Turns become symbols (role class and fault). Equal consecutive symbols are a run, and a run of n
turns is its symbol's min-plus matrix to the power n, put together from cached binary powers. A
conversation is cut wherever the range partitions cut it: each part is summed up by one matrix,
the matrices of a conversation give the cost still to come at every border, and parts are then
unrolled on their own. Only the texts of conversations that span several parts meet in one task,
as a stream of pieces, because their hash is one chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from canvass.llm.common import WORD_BREAK_CHARS, discard, settle, shuffle_parts, small_batches

# What has been put out so far: nothing, the system turn, a user turn last, an assistant turn last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after the next user or assistant turn, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
NEXT_ROLE = ("user", "user", "assistant", "user")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # fixed values: costs of the edits, and of a truncated turn that stays
NEVER = 1 << 60
#: Cost to end from each state: the turns to insert until the pattern accepts.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbol 0 must be deleted; 1 + 2 * class + truncated otherwise, classes other, s, u, a.
MUST_DELETE = 0
PIECE_BYTES = 1 << 20

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(a[s][m] + b[m][t] for m in STATES) for t in STATES) for s in STATES)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[s][t] + v[t] for t in STATES) for s in STATES)


UNIT: Matrix = tuple(tuple(0 if s == t else NEVER for t in STATES) for s in STATES)


def keeps(symbol: int, state: int) -> int | None:
    """The state after keeping the turn as it is, if the pattern allows that."""
    kind = (symbol - 1) // 2 if symbol else 0
    if kind == 1:
        return SYSTEM if state == START else None
    wanted = {2: USER, 3: ASSISTANT}.get(kind)
    return wanted if wanted is not None and NEXT[state] == wanted else None


@cache
def power(symbol: int, k: int) -> Matrix:
    """Transition of 2**k equal turns; any inserted turns come before each."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    out = [[NEVER] * 4 for _ in STATES]
    for first in STATES:
        state = first
        for inserted in range(3):
            cost = inserted * INSERT
            put = lambda to, c: out[first].__setitem__(to, min(out[first][to], cost + c))  # noqa: B023, E731
            put(state, DELETE)
            if symbol != MUST_DELETE:
                extra = TRUNCATED * ((symbol - 1) % 2)
                put(NEXT[state], REROLE + extra)
                if keeps(symbol, state) is not None:
                    put(keeps(symbol, state), extra)
            state = NEXT[state]
    return tuple(map(tuple, out))


def bits(n: int) -> Iterator[int]:
    k = 0
    while n:
        if n & 1:
            yield k
        n >>= 1
        k += 1


@lru_cache(4096)
def run_matrix(symbol: int, n: int) -> Matrix:
    out = UNIT
    for k in bits(n):
        out = times(out, power(symbol, k))
    return out


def before_run(symbol: int, n: int, after: Vector) -> Vector:
    """Cost still to come before a run, given the cost after it."""
    for k in bits(n):
        after = apply(power(symbol, k), after)
    return after


def inside_run(symbol: int, n: int, after: Vector) -> Iterator[Vector]:
    """Cost still to come after each turn of a run, first turn first; holds log n vectors."""
    if n == 1:
        yield after
        return
    k = n.bit_length() - 2
    yield from inside_run(symbol, n - (1 << k), apply(power(symbol, k), after))
    yield from inside_run(symbol, 1 << k, after)


@cache
def choose(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """The ASCII-least cheapest edits at one turn, and the state after it (``after`` is less its least)."""
    out = ""
    while True:
        left = apply(power(symbol, 0), after)[state]
        if DELETE + after[state] == left:
            return out + "D", state
        to = NEXT[state]
        if INSERT + apply(power(symbol, 0), after)[to] == left:
            out, state = out + "I", to
            continue
        extra = TRUNCATED * ((symbol - 1) % 2)
        kept = keeps(symbol, state)
        if kept is not None and extra + after[kept] == left:
            return out + "K", kept
        return out + "R", to


def unroll(runs: list[tuple[int, int]], after: Vector, last: bool, entries: Iterable[int]) -> dict[int, tuple[str, int]]:
    """Audit and final state of a part for each state it may be entered in."""
    borders = [after]
    for symbol, n in reversed(runs):
        borders.append(before_run(symbol, n, borders[-1]))
    borders.reverse()
    state, out = {e: e for e in entries}, {e: [] for e in entries}
    for (symbol, n), end in zip(runs, borders[1:]):
        for v in inside_run(symbol, n, end):
            low = min(v)
            flat = tuple(x - low for x in v)
            for e, s in state.items():
                edits, state[e] = choose(symbol, s, flat)
                out[e].append(edits)
    if last:
        for e, s in state.items():
            out[e].append("I" * (END[s] // INSERT))
    return {e: ("".join(out[e]), state[e]) for e in state}


def _grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows of equal keys, as streams; a stream must be read to its end."""
    rows = (row for batch in small_batches(batches, 4096) for row in zip(*[c.to_pylist() for c in batch.columns]))
    row = next(rows, None)
    while row is not None:
        key = row[:keys]

        def same() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:keys] == key:  # noqa: B023
                yield row
                row = next(rows, None)

        yield key, same()


def _runs(rows: Iterable[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """(class, symbol, turns, of them equal to the one before) of light rows (.., class, symbol, n)."""
    for row in rows:
        kind, symbol, n = row[-3:]
        yield kind, symbol, 1
        if n > 1:
            yield kind, MUST_DELETE, n - 1


def _collapse(rows: Iterable[tuple]) -> tuple[list[tuple[int, int]], int, int, int]:
    """Runs, adjacent turns that may not follow each other, first and last role class."""
    runs: list[list[int]] = []
    illegal, first, last = 0, None, None
    for kind, symbol, n in _runs(rows):
        first = kind if first is None else first
        illegal += n - 1 + (last is not None and not follows(last, kind))
        last = kind
        if runs and runs[-1][0] == symbol:
            runs[-1][1] += n
        else:
            runs.append([symbol, n])
    return [tuple(r) for r in runs], illegal, first, last


def follows(one: int, other: int) -> bool:
    """su, ua and au are the pairs of role initials that may follow each other."""
    return (one, other) in ((1, 2), (2, 3), (3, 2))


def _emitter(schema: T.StructType):
    arrow, names = [to_arrow_type(f.dataType) for f in schema.fields], schema.names

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=names)

    return batch


def _in_lots(rows: Iterable[tuple], batch, most: int = 2000, weight=lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= most or size >= 8 * PIECE_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the turns after damage by the hash of conversation and turn.

    Null role and text are one space, and so is a null conv_id or turn inside the hashed text. Of
    crc32 mod 20, 0 drops the turn, 1 empties its text, 2 takes out its ``.``, ``!`` and ``?``, 3
    repeats it, 4 makes it the user's. Equal rows are one row with their number ``n``.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    marked = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    return marked.where("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _symbol(first: Column) -> Column:
    fine = F.lit(1) + 2 * F.col("class") + F.col("truncated").cast("int")
    return F.when(F.col("blank") | ~first, MUST_DELETE).otherwise(fine).cast("int")


def repair(turns: DataFrame) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation, all turns of it in order.

    ``turns`` has conv_id, turn, role, text and n (equal rows counted, see :func:`damage`). Order is
    by turn, nulls first, ties by role and text (bytes). Result per conversation that has turns:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A null
    conv_id is a conversation of its own. A role whose first character is not s, u or a (an empty
    one too) can only be reroled or deleted. A long conversation is spread over tasks.
    """
    spark = turns.sparkSession
    key = turns.schema["conv_id"].dataType.simpleString()
    n_parts = shuffle_parts(spark)
    whole = ["conv_id", "turn", "role", "text"]
    trimmed = F.rtrim(F.col("text"), F.lit(WORD_BREAK_CHARS))
    role_class = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in "sua"]), F.substring("role", 1, 1)), F.lit(0))
    # The order is fixed by writing it: every later step reads the same parts and positions.
    ranged = settle(
        turns.repartitionByRange(n_parts, *whole).sortWithinPartitions(*whole)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"))
        .select(
            "*", role_class.cast("int").alias("class"), (trimmed == "").alias("blank"),
            (~F.coalesce(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), F.lit(False))).alias("truncated"),
            F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("same"),
        )
    )
    # Positions rise with the order, so the first of equal turns is the least; one row per position comes back.
    firsts = ranged.groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    light = settle(
        ranged.select("conv_id", "part", "pos", "turn", "class", "blank", "truncated", "n").join(firsts, "pos", "left")
        .withColumn("first", F.coalesce("first", F.lit(False)))
        .withColumn("symbol", _symbol(F.col("first")))
    )
    once = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    per_turn = light.groupBy("conv_id", "turn").agg(
        once(F.col("blank")).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first").cast("int"))).alias("duplicate"),
        F.sum((F.col("truncated") & F.col("first") & ~F.col("blank")).cast("long")).alias("truncated"),
    )
    wide = lambda c: c.cast("decimal(20,0)")
    counts = per_turn.groupBy("conv_id").agg(
        (wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).try_cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )

    def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv, part), group in _grouped(batches, 2):
                runs, illegal, first, last = _collapse(group)
                out = UNIT
                for symbol, n in runs:
                    out = times(out, run_matrix(symbol, n))
                yield conv, part, [x for line in out for x in line], illegal, first, last
        return _in_lots(rows(), _emitter(summary_schema))

    def borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts of a conversation, last one first: the cost still to come after each."""
        def rows():
            for (conv,), group in _grouped(batches, 1):
                after, held, follower = END, None, None
                for _, part, flat, illegal, first, last in group:
                    if held:
                        yield (*held, False)
                    illegal += follower is not None and not follows(last, follower)
                    before = apply(tuple(tuple(flat[4 * s : 4 * s + 4]) for s in STATES), after)
                    held = (conv, part, list(after), illegal, before[START], follower is None)
                    after, follower = before, first
                yield (*held, True)
        return _in_lots(rows(), _emitter(border_schema))

    def unrolled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part's border row comes first (position -1)."""
        def rows():
            for (conv, part), group in _grouped(batches, 2):
                _, _, _, after, ends, begins, *_ = next(group)
                runs = _collapse(group)[0]
                got = unroll(runs, tuple(after), ends, (START,) if begins else STATES)
                yield conv, part, [got[s][0] if s in got else None for s in STATES], [got[s][1] if s in got else None for s in STATES], begins, ends
        return _in_lots(rows(), _emitter(audit_schema))

    def chosen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv,), group in _grouped(batches, 1):
                state = START
                for _, part, audits, finals, begins, ends in group:
                    yield conv, part, state, audits[state], begins and ends
                    state = finals[state]
        return _in_lots(rows(), _emitter(chosen_schema))

    def assembled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The part's audit row comes first. Whole conversations are hashed here, parts become pieces."""
        def rows():
            for (conv, part), group in _grouped(batches, 2):
                _, _, _, audit, state, alone, *_ = next(group)
                digest, pieces, size, at, begun = hashlib.sha256(), [], 0, 0, state != START
                turn, left = None, 0
                for edit in audit:
                    if edit != "I":
                        if not left:
                            turn = next(group)
                            left = turn[-1]
                        left -= 1
                        if edit == "D":
                            continue
                    if edit == "K":
                        role, text, state = turn[-3], turn[-2], keeps(1 + 2 * turn[-4], state)
                    else:
                        role, text, state = NEXT_ROLE[state], turn[-2] if edit == "R" else "", NEXT[state]
                    line = (("\n" if begun else "") + f"{role}:{text}").encode()
                    begun = True
                    if alone:
                        digest.update(line)
                        continue
                    pieces.append(line)
                    size += len(line)
                    if size >= PIECE_BYTES:
                        yield conv, part, at, b"".join(pieces), None, None
                        pieces, size, at = [], 0, at + 1
                for _ in group:
                    raise ValueError("an audit does not cover its turns")
                yield (conv, part, at, None, audit, digest.hexdigest()) if alone else (conv, part, at, b"".join(pieces), audit, None)
        return _in_lots(rows(), _emitter(piece_schema), weight=lambda row: len(row[3] or b"") + len(row[4] or ""))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv,), group in _grouped(batches, 1):
                digest, audit = hashlib.sha256(), []
                for row in group:
                    digest.update(row[3])
                    audit.append(row[4] or "")
                yield conv, "".join(audit), digest.hexdigest()
        return _in_lots(rows(), _emitter(text_schema))

    schema = lambda text: T._parse_datatype_string(f"conv_id {key}, {text}")
    summary_schema = schema("part int, matrix array<bigint>, illegal bigint, first int, last int")
    border_schema = schema("part int, after array<bigint>, illegal bigint, cost bigint, ends boolean, begins boolean")
    audit_schema = schema("part int, audits array<string>, finals array<bigint>, begins boolean, ends boolean")
    chosen_schema = schema("part int, state int, audit string, alone boolean")
    piece_schema = schema("part int, at int, piece binary, audit string, repaired_sha256 string")
    text_schema = schema("audit string, repaired_sha256 string")

    by_part = lambda df: df.repartition(n_parts, "conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    cells = light.select("conv_id", "part", "pos", "class", "symbol", "n")
    summary = settle(by_part(cells).select("conv_id", "part", "class", "symbol", "n").mapInArrow(summaries, summary_schema))
    border = settle(summary.repartition(n_parts, "conv_id").sortWithinPartitions("conv_id", F.desc("part")).mapInArrow(borders, border_schema))
    def led(head: DataFrame, rows: DataFrame) -> DataFrame:
        """Rows of every part behind the part's head row (position -1); either lacks the other's columns."""
        return by_part(head.withColumn("pos", F.lit(-1).cast("long")).unionByName(rows, allowMissingColumns=True))

    discard(summary)
    lead = ["conv_id", "part", "pos"]
    audits = settle(led(border, cells).select(*lead, "after", "ends", "begins", "class", "symbol", "n").mapInArrow(unrolled, audit_schema))
    picked = settle(audits.repartition(n_parts, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(chosen, chosen_schema))
    discard(audits)
    texted = led(picked, ranged.select(*lead, "class", "role", "text", "n"))
    done = settle(texted.select(*lead, "audit", "state", "alone", "class", "role", "text", "n").mapInArrow(assembled, piece_schema))
    discard(ranged, picked)
    several = done.where("repaired_sha256 is null").repartition(n_parts, "conv_id").sortWithinPartitions("conv_id", "part", "at")
    texts = done.where("repaired_sha256 is not null").select("conv_id", "audit", "repaired_sha256").unionByName(several.mapInArrow(hashed, text_schema))
    costs = border.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.max(F.when(F.col("begins"), F.col("cost"))).alias("cost"))
    # One row per conversation and kind of fact; a grouping holds null ids together, as a join would not.
    facts = counts.unionByName(costs, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    return facts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in facts.columns if c != "conv_id"])


def repair_report(turns: DataFrame) -> DataFrame:
    """Damage, then repair: one row for every conv_id of ``turns`` (conv_id, turn, role, text).

    A conversation that loses all its turns has zeros, an empty audit and the hash of nothing. An
    empty table gives no rows; other columns of ``turns`` are not read.
    """
    found = repair(damage(turns))
    every = turns.groupBy("conv_id").agg(F.lit(True).alias("given"))
    rows = every.unionByName(found, allowMissingColumns=True).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in found.columns if c != "conv_id"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
