"""Repair of the turn structure of conversations by run-length dynamic programming.

A row is a symbol: the initial of its role and its fault. A conversation should read
``(s?(ua)+)?``, which an automaton of four states accepts; keeping, reroling and deleting rows
and inserting others have costs, so a symbol is a min-plus matrix over the states. Equal
consecutive symbols make a run, and a run is passed by the binary powers of its matrix, which
are remembered for all conversations. Costs to go come from the last row backwards; choices are
then unrolled forwards, the least letter among the cheapest.

Rows are range-partitioned by conversation and turn and sorted, so a conversation of any
length spreads over partitions. One that lies in a partition is repaired where it is. Of those
that go on in another one (two a partition at most), each part gives its matrix; a chain over
these, one row per part, gives each part its cost to go and its first state, and all parts are
unrolled side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import shuffle_parts
from seqloom.session import materialise

#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that is put next, and that row's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
INITIAL_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Costs of the edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAR = 1 << 60

BLANK, DUPLICATE, CUT, FINE = "blank", "duplicate", "truncated", "fine"
FAULTS = (BLANK, DUPLICATE, CUT)
SPACE = " \t\n\v\f\r"
ENDS = (".", "!", "?")

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]
#: (initial or "" if the row has to go or its role is none of the three, fault) as one letter of a run.
Symbol = tuple[str, str]

#: Cost to go from each state when no row is left: rows that make it end after an assistant.
LAST: Vector = (0, 2 * INSERT, INSERT, 0)


def text_fault(text: str) -> str:
    """Fault of a text on its own; a duplicate is found beside others."""
    end = text.rstrip(SPACE)
    return BLANK if not end else FINE if end.endswith(ENDS) else CUT


def symbol(role: str, fault: str) -> Symbol:
    if fault in (BLANK, DUPLICATE):
        return "", BLANK
    return role[:1] if role[:1] in INITIAL_STATE else "", fault


def row_moves(of: Symbol, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row in a state, in the order of their letters."""
    initial, fault = of
    moves = [("D", DELETE, state)]
    if fault != BLANK:
        stay = TRUNCATED if fault == CUT else 0
        after = INITIAL_STATE.get(initial)
        if after == NEXT[state] or (after == SYSTEM and state == START):
            moves.append(("K", stay, after))
        moves.append(("R", REROLE + stay, NEXT[state]))
    return moves


def inserted(costs: Iterable[int]) -> Vector:
    """Costs to go if rows may be inserted first; two at most are of use."""
    costs = list(costs)
    for _ in range(2):
        costs = [min(cost, INSERT + costs[NEXT[state]]) for state, cost in enumerate(costs)]
    return tuple(costs)


def row_matrix(of: Symbol) -> Matrix:
    """[from][to]: least cost of insertions and one row."""
    rows = []
    for state in range(4):
        best, cost, at = [FAR] * 4, 0, state
        for _ in range(3):
            for _, more, after in row_moves(of, at):
                best[after] = min(best[after], cost + more)
            cost, at = cost + INSERT, NEXT[at]
        rows.append(tuple(best))
    return tuple(rows)


def product(x: Matrix, y: Matrix) -> Matrix:
    columns = list(zip(*y, strict=True))
    return tuple(tuple(min(FAR, *map(int.__add__, row, column)) for column in columns) for row in x)


def applied(x: Matrix, costs: Vector) -> Vector:
    return tuple(min(FAR, *map(int.__add__, row, costs)) for row in x)


_powers: dict[Symbol, list[Matrix]] = {}


def powers(of: Symbol, n: int) -> Iterator[Matrix]:
    """The binary powers whose product is the matrix of a run of n; remembered, as they commute in any order."""
    known = _powers.setdefault(of, [row_matrix(of)])
    while len(known) < n.bit_length():
        known.append(product(known[-1], known[-1]))
    return (known[k] for k in range(n.bit_length()) if n >> k & 1)


def runs(symbols: Iterable[Symbol]) -> list[tuple[Symbol, int]]:
    return [(of, sum(1 for _ in same)) for of, same in groupby(symbols)]


def before_run(of: Symbol, n: int, costs: Vector) -> Vector:
    for matrix in powers(of, n):
        costs = applied(matrix, costs)
    return costs


def matrix_of(found: list[tuple[Symbol, int]]) -> Matrix:
    """Min-plus matrix of all runs."""
    total = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
    for of, n in found:
        for matrix in powers(of, n):
            total = product(total, matrix)
    return total


def unrolled(found: list[tuple[Symbol, int]], after: Vector, state: int) -> tuple[str, int]:
    """Cheapest edits of the runs from a state, least letters first, and the state behind them.

    ``after`` are the costs to go behind the runs. Within a run, costs to go are made one row at
    a time; those behind it come from its powers.
    """
    behind, costs = [], after
    for of, n in reversed(found):
        behind.append(costs)
        costs = before_run(of, n, costs)
    letters: list[str] = []
    for (of, n), costs in zip(found, reversed(behind), strict=True):
        steps = [costs]
        one = row_matrix(of)
        for _ in range(n - 1):
            steps.append(applied(one, steps[-1]))
        for costs in reversed(steps):
            bare = [min(cost + costs[to] for _, cost, to in row_moves(of, at)) for at in range(4)]
            least = inserted(bare)
            while True:
                options = [(letter, to) for letter, cost, to in row_moves(of, state) if cost + costs[to] == least[state]]
                if INSERT + least[NEXT[state]] == least[state]:
                    options.append(("I", NEXT[state]))
                letter, state = min(options)
                letters.append(letter)
                if letter != "I":
                    break
    return "".join(letters), state


def ending(state: int) -> str:
    """Insertions behind the last row."""
    letters = ""
    while LAST[state]:
        letters, state = letters + "I", NEXT[state]
    return letters


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that an audit leaves or puts in."""
    rows = iter(rows)
    for letter in audit:
        role, text = (ROLE[state], "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = INITIAL_STATE[role[:1]]
        else:
            role, state = ROLE[state], NEXT[state]
        yield role, text


def legal(before: str, initial: str) -> bool:
    return before + initial in ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there) of every row after damage; rows that are lost are not ``there``.

    What happens to a row is read from a checksum of its conversation and turn.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind)
    is_ = lambda k: F.col("kind") == k
    text = F.when(is_(0) | is_(1), "").when(is_(2), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    once, twice = F.array(F.lit(0)), F.array(F.lit(0), F.lit(1))
    return rows.select(
        "conv_id",
        "turn",
        F.when(is_(4), "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") != 0).alias("there"),
        F.explode(F.when(is_(3), twice).otherwise(once)).alias("copy"),
    ).drop("copy")


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "there boolean, turn long, role string, text string, fault string, part int, pos long"
FIELDS = [x.split()[0] for x in f"{REPORT}, {ROWS}".split(", ")]


def report(rows: list[tuple]) -> tuple:
    """The report of one whole conversation, rows (turn, role, text, fault) in order."""
    found = runs(symbol(role, fault) for _, role, _, fault in rows)
    audit, state = unrolled(found, LAST, START)
    audit += ending(state)
    turns = {turn for turn, *_ in rows if turn is not None}
    lines = "\n".join(f"{role}:{text}" for role, text in repaired(((r, t) for _, r, t, _ in rows), audit))
    faults = [fault for *_, fault in rows]
    pairs = zip(rows, rows[1:], strict=False)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in FAULTS),
        sum(not legal(a[1][:1], b[1][:1]) for a, b in pairs),
        applied(matrix_of(found), LAST)[START],
        audit,
        hashlib.sha256(lines.encode()).hexdigest(),
    )


def with_reports(ordered: DataFrame) -> DataFrame:
    """Reports of the conversations inside each sorted partition, and the rows of its first and last one.

    Only one conversation is held at a time, and no more of it than lies in the partition.
    """
    kind = ordered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *FIELDS]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows, seen, now, n, pos = [], set(), None, 0, 0
        schema = None

        def flushed() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=names)
            out.clear()
            return made

        def closed(edge: bool) -> None:
            nonlocal n
            if edge:
                out.extend((now, *[None] * 8, *row) for row in rows)
            else:
                there = [row[1:5] for row in rows if row[0]]
                out.append((now, *report(there), *[None] * 7))
            n += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            long, string = pa.int64(), pa.string()
            schema = schema or [batch.schema.field("conv_id").type, *[long] * 6, string, string, pa.bool_(), long, string, string, string, pa.int32(), long]
            part = batch.column("part")[0].as_py()
            for conv, turn, role, text, there in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there")), strict=True):
                if conv != now and rows:
                    closed(edge=n == 0)
                    rows, seen = [], set()
                    if len(out) >= 5000:
                        yield flushed()
                now = conv
                fault = text_fault(text)
                if there:
                    mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                    if mark in seen and fault != BLANK:
                        fault = DUPLICATE
                    seen.add(mark)
                rows.append((there, turn, role, text, fault, part, pos))
                pos += 1
        if rows:
            closed(edge=True)
            yield flushed()

    fields = f"conv_id {kind}, {REPORT}, {ROWS}"
    return ordered.mapInArrow(apply, fields)


def ranged(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn (nulls first); ties by role, then by a hash of the text. Equal rows may be parted."""
    tie = F.xxhash64("text")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), F.col("salt")]
    keyed = rows.withColumns({"tie": tie, "salt": F.monotonically_increasing_id()})
    return keyed.repartitionByRange(shuffle_parts(rows), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


#: Rows of a repaired part that go on as one piece of text.
PIECE_ROWS = 1000


def by_part(rows: DataFrame, of_part, schema: str) -> DataFrame:
    """``of_part`` of the rows of each part of a conversation in order; a part lies in a range partition and is held whole."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", *(x.split()[0] for x in schema.split(", "))]
    order = ["part", "conv_id", "pos"]
    dealt = rows.repartition(shuffle_parts(rows), "part", "conv_id").sortWithinPartitions(*order)
    types = rows.sparkSession.createDataFrame([], f"conv_id {kind}, part int, {schema}").schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(types)
        whole = (row for batch in batches for row in batch.to_pylist())
        for (part, conv), same in groupby(whole, key=lambda r: (r["part"], r["conv_id"])):
            found = [dict(zip(names, (conv, part, *row), strict=True)) for row in of_part(list(same))]
            yield pa.RecordBatch.from_pylist(found, schema=made)

    return dealt.mapInArrow(apply, types)


def symbols_of(rows: list[dict]) -> list[tuple[Symbol, int]]:
    return runs(symbol(r["role"], r["fault"]) for r in rows)


def part_matrix(rows: list[dict]) -> list[tuple]:
    initials = [r["role"][:1] for r in rows]
    illegal = sum(not legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
    return [([x for row in matrix_of(symbols_of(rows)) for x in row], initials[0], initials[-1], illegal)]


def part_ends(rows: list[dict]) -> list[tuple]:
    found, after = symbols_of(rows), tuple(rows[0]["after"])
    return [([unrolled(found, after, state)[1] if min(after) < FAR else state for state in range(4)],)]


def part_pieces(rows: list[dict]) -> list[tuple]:
    audit, state = unrolled(symbols_of(rows), tuple(rows[0]["after"]), rows[0]["state"])
    if rows[0]["last"]:
        audit += ending(state)
    lines = [f"{role}:{text}" for role, text in repaired(((r["role"], r["text"]) for r in rows), audit, rows[0]["state"])]
    pieces = [(lines[i : i + PIECE_ROWS], audit if i == 0 else "") for i in range(0, max(1, len(lines)), PIECE_ROWS)]
    return [(i, letters, of) for i, (of, letters) in enumerate(pieces)]


def chained(parts: DataFrame, of_chain, schema: str, *columns: str) -> DataFrame:
    """``of_chain`` of the parts of each conversation in order: one short row per range partition that holds some of it."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    listed = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", *columns))).alias("parts"))
    types = parts.sparkSession.createDataFrame([], f"conv_id {kind}, part int, {schema}").schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(types)
        for batch in batches:
            rows = [
                dict(zip(types.names, (row["conv_id"], part["part"], *more), strict=True))
                for row in batch.to_pylist()
                for part, more in zip(row["parts"], of_chain(row["parts"]), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=made)

    return listed.mapInArrow(apply, types)


def costs_to_go(parts: list[dict]) -> Iterator[tuple]:
    """For each part the costs to go behind it; with the first, the whole cost and the bad neighbours at borders."""
    after, costs = [], LAST
    for part in reversed(parts):
        after.append(costs)
        m = part["matrix"]
        costs = applied(tuple(tuple(m[i : i + 4]) for i in range(0, 16, 4)), costs)
    borders = sum(not legal(a["right"], b["left"]) for a, b in zip(parts, parts[1:], strict=False))
    for i, found in enumerate(reversed(after)):
        yield list(found), costs[START] if i == 0 else 0, borders if i == 0 else 0


def first_states(parts: list[dict]) -> Iterator[tuple]:
    state = START
    for i, part in enumerate(parts):
        yield state, i == len(parts) - 1
        state = part["ends"][state]


def split_reports(rows: DataFrame) -> DataFrame:
    """Reports of conversations that may lie in several range partitions, with the work done part by part.

    Only the checksum of a whole repaired text, by its nature, is made in one go: its pieces
    stream through a task and are not held.
    """
    same = [F.col("conv_id"), F.col("role"), F.sha2(F.col("text").cast("binary"), 256).alias("text")]
    there = rows.filter("there")
    firsts = there.groupBy(*same).agg(F.min(F.struct("part", "pos")).alias("at")).select("at.part", "at.pos", F.lit(True).alias("first"))
    again = F.col("first").isNull() & ~F.col("fault").isin(BLANK, DUPLICATE)
    marked = there.join(firsts, ["part", "pos"], "left").withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault")))
    marked = materialise(marked.select("conv_id", "part", "pos", "turn", "role", "text", "fault"), "split-rows")

    narrow = marked.select("conv_id", "part", "pos", "role", "fault")
    matrices = by_part(narrow, part_matrix, "matrix array<bigint>, left string, right string, illegal bigint")
    matrices = materialise(matrices, "split-matrices")
    costs = chained(matrices, costs_to_go, "after array<bigint>, cost bigint, borders bigint", "matrix", "left", "right")
    costs = materialise(costs, "split-costs")
    on = lambda a, b: (a["part"] == b["part"]) & a["conv_id"].eqNullSafe(b["conv_id"])
    beside = lambda a, b: a.join(b, on(a, b)).drop(b["part"]).drop(b["conv_id"])
    ends = by_part(beside(narrow, costs.select("conv_id", "part", "after")), part_ends, "ends array<int>")
    states = chained(materialise(ends, "split-ends"), first_states, "state int, last boolean", "ends")
    placed = beside(materialise(states, "split-states"), costs.select("conv_id", "part", "after"))
    pieces = by_part(beside(marked, placed), part_pieces, "piece bigint, letters string, lines array<string>")
    digests = whole_digests(materialise(pieces, "split-pieces"))

    faults = [F.count_if(F.col("fault") == f).alias(f) for f in FAULTS]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")
    facts = marked.groupBy("conv_id").agg(gaps, *faults)
    inside = matrices.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    chain = costs.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("borders").alias("borders"))
    found = rows.select("conv_id").distinct()
    for more in (facts, inside, chain, digests):
        named = more.withColumnRenamed("conv_id", "__conv")
        found = found.join(named, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return found.select(
        "conv_id",
        *(count(F.col(c)).alias(c) for c in ("gaps", *FAULTS)),
        (count(F.col("illegal")) + count(F.col("borders"))).alias("illegal"),
        count(F.col("cost")).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def whole_digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of each conversation from its pieces, which stream by in order."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    types = pieces.sparkSession.createDataFrame([], f"conv_id {kind}, audit string, repaired_sha256 string").schema
    order = ["conv_id", "part", "piece"]
    dealt = pieces.repartition(shuffle_parts(pieces), "conv_id").sortWithinPartitions(*order)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(types)
        whole = (row for batch in batches for row in batch.to_pylist())
        for conv, same in groupby(whole, key=lambda r: r["conv_id"]):
            digest, letters, begun = hashlib.sha256(), [], False
            for row in same:
                letters.append(row["letters"])
                for line in row["lines"]:
                    digest.update((b"\n" if begun else b"") + line.encode())
                    begun = True
            found = {"conv_id": conv, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}
            yield pa.RecordBatch.from_pylist([found], schema=made)

    return dealt.mapInArrow(apply, types)


def repair(rows: DataFrame) -> DataFrame:
    """One report per conversation of rows (conv_id, turn, role, text, there).

    Rows that are not ``there`` only name their conversation. Columns are conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256. Order is by turn, nulls
    first; rows of one turn by role, then by a hash of the text. A null conv_id is a
    conversation of its own. A conversation without rows, and none else, has an empty audit and
    the checksum of nothing, unless deleting all of its rows is cheapest. An empty table gives an
    empty result.
    """
    found = materialise(with_reports(ranged(rows)), "conversations")
    report_columns = ["conv_id", *(x.split()[0] for x in REPORT.split(", "))]
    inner = found.filter("part is null").select(*report_columns)
    split = found.filter("part is not null").select("conv_id", *(x.split()[0] for x in ROWS.split(", ")))
    return inner.unionAll(split_reports(split))


def repaired_damage(conversations: DataFrame) -> DataFrame:
    """``repair`` of the rows after ``damaged``; further columns are ignored."""
    return repair(damaged(conversations.select("conv_id", "turn", "role", "text")))
