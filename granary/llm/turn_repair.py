"""Repair of conversation structure: the cheapest edits that give a conversation alternating roles.

A program over the turns that stay: each is kept or gets a new role, and the cheapest way to a turn that stays is the
cheapest over the turns that stayed before, plus the deletions between the two (a difference of prefix sums), plus the
inserts that the two roles need. What a turn adds does not depend on the one before but by its role, so a running minimum
for each role prices all gaps. Of equal costs the audit that is least in ASCII order wins: costs to go are worked out from
the end, and the audit is read off from the start.

Rows are put in one total order over all tasks, so a conversation of any size is spread over many. Those that lie in one
task end there; those that touch a task's bounds are priced by the bit (a 4 by 4 table of costs between roles), and the
tables, a few a task, are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import trimmed, written

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: What the last turn that stayed was: none, system, user, assistant. A conversation may end after none or assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: What may follow what.
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
_NO = 1 << 60
#: A row's code: its role's initial, and whether it must go or is cut short.
_FORCED, _SHORT = 4, 8
#: Bytes of text that a task holds of rows in one total order; this makes the number of tasks.
TASK_BYTES = 64 << 20
_OUT_BYTES = 8 << 20


def _inserts(state: int, role: int) -> int | None:
    """How many inserts (of user or assistant) lead from a state to a turn of a role; None where none do."""
    steps, reached = 0, {state}
    while reached:
        if any(role in _NEXT[s] for s in reached):
            return steps
        steps, reached = steps + 1, {r for s in reached for r in _NEXT[s] if r != SYSTEM}
        if steps > 4:
            return None
    return None


_GAP = {(s, r): n for s in range(4) for r in (SYSTEM, USER, ASSISTANT) if (n := _inserts(s, r)) is not None}
#: Inserts that end a conversation after each state.
_END = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
ENDS = tuple(INSERT * _END[s] for s in range(4))


def _ways(code: int) -> list[tuple[int, int, str]]:
    """(role, cost, letter) of every way to let a row stay."""
    if code & _FORCED:
        return []
    role, extra = code & 3, CUT_SHORT if code & _SHORT else 0
    kept = [(role, extra, "K")] if role else []
    return kept + [(r, extra + REROLE, "R") for r in (USER, ASSISTANT) if r != role]


_WAYS = [_ways(code) for code in range(16)]


def transfer(codes: bytes) -> list[int]:
    """Cheapest cost from each state before these rows to each state after them, row by row."""
    out = []
    for first in range(4):
        least = [_NO] * 4  # cost up to the last row that stayed, less the deletions up to and with it
        least[first] = 0
        for n, code in enumerate(codes):
            stays = []
            for role, cost, _ in _WAYS[code]:
                before = min(least[s] + INSERT * _GAP[s, role] for s in range(4) if (s, role) in _GAP)
                stays.append((role, before + DELETE * n + cost - DELETE * (n + 1)))
            for role, price in stays:
                least[role] = min(least[role], price)
        out += [min(_NO, price + DELETE * len(codes)) if price < _NO // 2 else _NO for price in least]
    return out


def to_go(codes: bytes, ends: tuple[int, ...]) -> list[list[int]]:
    """For every row and state before it, the cheapest cost of it and all that follow; `ends` holds the states' costs after the last."""
    n = len(codes)
    least = [end + DELETE * n for end in ends]  # cost to go with the deletions up to the next row that stays
    out = [[price - DELETE * n for price in least]]
    for i in range(n - 1, -1, -1):
        for role, cost, _ in _WAYS[codes[i]]:
            price = cost + DELETE * i + out[-1][role]
            for s in range(4):
                if (s, role) in _GAP:
                    least[s] = min(least[s], price + INSERT * _GAP[s, role])
        out.append([price - DELETE * i for price in least])
    return out[::-1]


def walk(codes: bytes, ends: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """The audit that is least of the cheapest from a state, with what ends the conversation if this is its last bit; and the state after."""
    go, audit = to_go(codes, ends), []
    for i, code in enumerate(codes):
        if go[i][state] == DELETE + go[i + 1][state]:
            audit.append("D")
            continue
        found = [
            ("I" * _GAP[state, role] + letter, role) for role, cost, letter in _WAYS[code]
            if (state, role) in _GAP and go[i][state] == INSERT * _GAP[state, role] + cost + go[i + 1][role]
        ]
        letters, state = min(found)
        audit.append(letters)
    if last:
        audit.append("I" * _END[state])
    return "".join(audit), state


@lru_cache(1 << 14)
def _whole(codes: bytes) -> tuple[int, str, int]:
    """Cost, audit and the number of adjacent roles that may not stand so."""
    return to_go(codes, ENDS)[0][START], walk(codes, ENDS, START, True)[0], illegal(codes)


def illegal(codes: bytes, before: int = -1) -> int:
    """Adjacent initials other than su, ua and au; `before` is the initial of the row before, or -1."""
    roles = ([] if before < 0 else [before]) + [code & 3 for code in codes]
    return sum((a, b) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)) for a, b in zip(roles, roles[1:]))


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits of an audit that starts in a state."""
    names, rows = {USER: "user", ASSISTANT: "assistant"}, iter(zip(roles, texts))
    out_roles, out_texts = [], []
    for letter in audit:
        if letter == "I":
            role, text = names[_NEXT[state][-1]], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "R":
                role = names[_NEXT[state][-1]]
        state = _INITIALS[role[0]]
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows after the damage that crc32("conv_id:turn") % 20 tells; nulls in it are one space.

    0 takes the row away (present is false; its conversation stays known), 1 empties the text, 2 takes its full stops,
    exclamation and question marks, 3 repeats the row, 4 makes the role user. Null roles and texts are one space.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    made = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return made.select("conv_id", "turn", "role", "text", "present", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def _coded(rows: DataFrame) -> DataFrame:
    """What the program needs of each row: `digest` names (role, text), `code` all that the row itself tells."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(WHITE))
    code = F.when(role.startswith("s"), SYSTEM).when(role.startswith("u"), USER).when(role.startswith("a"), ASSISTANT).otherwise(0)
    code = code + F.when(bare == "", _FORCED).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), _SHORT).otherwise(0)
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    return rows.select(
        "conv_id", "turn", present.alias("present"), role.alias("role"), F.sha2(text, 256).alias("digest"), code.cast("tinyint").alias("code"),
        F.monotonically_increasing_id().alias("at"), text.alias("text"),
    )


def _bits(schema: T.StructType):
    """For mapInArrow, over rows in order: one row for each conversation, or each bit of it, in a task.

    The first and the last may go on in other tasks: those come with codes, digests and all their rows, and no result.
    """
    names = [f.name for f in schema]
    kinds = {"part": pa.int32(), "open": pa.bool_(), "cost": pa.int64(), "audit": pa.string(), "codes": pa.binary(), "digests": pa.list_(pa.string()), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}
    counts = ("gap_first", "gap_last", "gap_distinct", "blank", "duplicate", "truncated", "illegal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, first, part = 0, True, -1
        conv: pa.Scalar | None = None
        rows: list[tuple] = []

        def close(last: bool) -> None:
            nonlocal held, first
            codes, seen, turns, tally = bytearray(), set(), [], [0, 0, 0]
            here = [row for row in rows if row[1]]
            for turn, _, role, digest, code, _ in here:
                if code & _FORCED:
                    tally[0] += 1
                elif (role, digest) in seen:
                    tally[1] += 1
                    code = code & 3 | _FORCED
                else:
                    seen.add((role, digest))
                    tally[2] += code // _SHORT
                codes.append(code)
                if turn is not None and (not turns or turns[-1] != turn):
                    turns.append(turn)
            codes, open_ = bytes(codes), first or last
            roles, texts = [row[2] for row in here], [row[5] for row in here]
            cost = audit = None
            wrong = illegal(codes)
            digests = [row[3] for row in here] if open_ else None
            if not open_:
                cost, audit, wrong = _whole(codes) if len(codes) <= 64 else _whole.__wrapped__(codes)
                roles, texts = repaired(audit, START, roles, texts)
            held += sum(map(len, texts)) + 64 * len(texts)
            span = (turns[0], turns[-1]) if turns else (None, None)
            out.append((conv, part, open_, cost, audit, codes, digests, roles, texts, *span, len(turns), *tally, wrong))
            first = False

        def flushed() -> pa.RecordBatch:
            columns = dict(zip(("conv_id", *kinds, *counts), zip(*out)))
            arrays = [pa.array([c.as_py() for c in columns["conv_id"]], columns["conv_id"][0].type)]
            arrays += [pa.array(columns[name], kind) for name, kind in kinds.items()] + [pa.array(columns[name], pa.int64()) for name in counts]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("conv_id")
            part = batch.column("part")[0].as_py()
            values = own.to_pylist()
            columns = zip(values, *(batch.column(c).to_pylist() for c in ("turn", "present", "role", "digest", "code", "text")))
            for i, (value, *row) in enumerate(columns):
                if conv is None or value != conv.as_py():
                    if conv is not None:
                        close(False)
                        rows = []
                        if held > _OUT_BYTES:
                            yield flushed()
                            out, held = [], 0
                    conv = own[i]
                rows.append(tuple(row))
        if conv is not None:
            close(True)
        if out:
            yield flushed()

    return trimmed(run)


def _joined(schema: str):
    """For applyInArrow by conversation: a few rows a task each, (conv_id, part, costs), to each bit's costs to go at its end."""

    def run(bits: pa.Table) -> pa.Table:
        bits = bits.sort_by("part")
        tables, ends, out = bits.column("costs").to_pylist(), list(ENDS), []
        for table in reversed(tables):
            out.append(ends)
            ends = [min(min(table[4 * s + r] + ends[r] for r in range(4)), _NO) for s in range(4)]
        n = len(tables)
        return pa.table({
            "conv_id": bits.column("conv_id"), "part": bits.column("part"), "ends": pa.array(out[::-1], pa.list_(pa.int64())),
            "last": pa.array([i == n - 1 for i in range(n)]), "parts": pa.array([n] * n, pa.int32()), "total": pa.array([ends[START]] * n, pa.int64()),
        })

    return run, schema


def _chosen(schema: str):
    """For applyInArrow by conversation: each bit's states after, for each state before, to the state it starts in; and what lies over bounds."""

    def run(bits: pa.Table) -> pa.Table:
        bits = bits.sort_by("part")
        state, before, turn, starts, over, same = START, -1, None, [], [], []
        for after, codes_first, codes_last, first, last in zip(*(bits.column(c).to_pylist() for c in ("after", "first_code", "last_code", "gap_first", "gap_last"))):
            starts.append(state)
            over.append(illegal(bytes([codes_first]), before) if codes_first is not None and before >= 0 else 0)
            same.append(int(first is not None and first == turn))
            state = after[state]
            before = codes_last & 3 if codes_last is not None else before
            turn = last if last is not None else turn
        return pa.table({
            "conv_id": bits.column("conv_id"), "part": bits.column("part"), "state": pa.array(starts, pa.int32()),
            "over": pa.array(over, pa.int64()), "same": pa.array(same, pa.int64()),
        })

    return run, schema


def _applied(schema: T.StructType):
    """For mapInArrow: audit and state to repaired roles and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a bit's rows may be large
                row = batch.slice(i, 1)
                got = {c: row.column(c)[0].as_py() for c in ("audit", "state", "roles", "texts")}
                roles, texts = repaired(got["audit"], got["state"], got["roles"], got["texts"])
                put = {"roles": pa.array([roles], pa.list_(pa.string())), "texts": pa.array([texts], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([put.get(f.name, row.column(f.name)) for f in schema], [f.name for f in schema])

    return run


_RESULT = ["conv_id", "part", "parts", "cost", "audit", "roles", "texts", "gaps", "blank", "duplicate", "truncated", "illegal"]


def repair(turns: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Each conversation repaired: conv_id, part, parts, cost, audit, roles, texts, gaps, blank, duplicate, truncated, illegal.

    turns: conv_id (any type that sorts), turn (a whole number), role, text, and maybe `present`, false for a row that only
    names its conversation. Null roles and texts are one space, a null conv_id is one conversation, null turns come first;
    rows of one turn are in the order of role and text digest. A conversation is one row, or, where it lies in several
    tasks, one row a bit, numbered by part in order: audit, roles and texts then go on from bit to bit, cost and gaps stand
    in the first, and the other counts add up. A conversation without rows present has cost 0 and nothing else. Empty
    tables give no rows; other columns are not read.

    Edits: keep 0, rerole to user or assistant 1, delete 2 (blank and duplicate rows must go), insert an empty turn 5; a
    row cut short that stays adds 5. Roles end as `(s?(ua)+)?`.
    """
    rows = _coded(turns)
    spark = rows.sparkSession
    if partitions is None:
        size = turns.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    order = ["conv_id", "turn", "role", "digest", "at"]
    rows = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kind = turns.schema["conv_id"].dataType
    texts = T.ArrayType(T.StringType())
    whole = T.StructType([
        T.StructField("conv_id", kind), T.StructField("part", T.IntegerType()), T.StructField("open", T.BooleanType()), T.StructField("cost", T.LongType()),
        T.StructField("audit", T.StringType()), T.StructField("codes", T.BinaryType()), T.StructField("digests", texts), T.StructField("roles", texts), T.StructField("texts", texts),
        *(T.StructField(c, T.LongType()) for c in ("gap_first", "gap_last", "gap_distinct", "blank", "duplicate", "truncated", "illegal")),
    ])
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "present", "role", "digest", "code", "text", "part")
    bits = written(slim.mapInArrow(_bits(whole), whole), "turns")
    gaps = F.coalesce(F.col("gap_last") - F.col("gap_first") + 1 - F.col("gap_distinct"), F.lit(0)).cast("long")
    closed = bits.filter(~F.col("open")).withColumn("parts", F.lit(1)).withColumn("gaps", gaps).withColumn("part", F.lit(0))
    return closed.select(*_RESULT).unionByName(_over_bounds(bits.filter("open"), kind))


def _over_bounds(bits: DataFrame, kind: T.DataType) -> DataFrame:
    """The conversations that touch a task's bounds, of which there are two a task at most, or one of any size."""
    name = kind.simpleString()
    key = ["conv_id", "part"]
    one_conv = F.col("conv_id").eqNullSafe(F.col("conv_"))

    def met(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        b = b.select(F.col("conv_id").alias("conv_"), F.col("part").alias("part_"), *[c for c in b.columns if c not in key])
        return a.join(b, one_conv & (F.col("part") == F.col("part_")), how).drop("conv_", "part_")

    # Rows equal to one in an earlier bit: only the first of each (role, text) in a bit can be so, and only over many bits.
    spread = bits.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("conv_"))
    many = bits.join(spread, one_conv, "left_semi")
    each = many.select("conv_id", "part", "codes", F.posexplode(F.arrays_zip("roles", "digests")).alias("i", "own"))
    code_at = lambda at: F.conv(F.hex(F.substring("codes", at, F.lit(1))), 16, 10).cast("int")
    each = each.withColumn("code", code_at(F.col("i") + 1)).filter(F.col("code").bitwiseAND(_FORCED) == 0).select("conv_id", "part", "i", "code", "own")
    first = each.groupBy("conv_id", "own").agg(F.array_sort(F.collect_list("part")).alias("all")).filter(F.size("all") > 1)
    later = first.select("conv_id", "own", F.explode(F.slice("all", 2, 1 << 30)).alias("part"))
    again = each.join(
        later.select(F.col("conv_id").alias("conv_"), F.col("own").alias("own_"), F.col("part").alias("part_")),
        one_conv & (F.col("own") == F.col("own_")) & (F.col("part") == F.col("part_")), "left_semi",
    )
    again = again.groupBy(*key).agg(F.collect_list("i").alias("again"), F.sum(F.floor(F.col("code") / _SHORT)).alias("short"))
    tail = bits.select(*key, "codes", "gap_first", "gap_last", "gap_distinct")
    slim = met(tail, again, "left")

    priced_schema = f"conv_id {name}, part int, codes binary, costs array<bigint>"

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_marked(c, a) for c, a in zip(batch.column("codes").to_pylist(), batch.column("again").to_pylist())]
            arrays = [batch.column("conv_id"), batch.column("part"), pa.array(codes, pa.binary()), pa.array([transfer(c) for c in codes], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "codes", "costs"])

    prices = written(slim.select(*key, "codes", "again").mapInArrow(priced, priced_schema), "turn-prices")
    run, schema = _joined(f"conv_id {name}, part int, ends array<bigint>, last boolean, parts int, total bigint")
    ends = prices.select(*key, "costs").groupBy("conv_id").applyInArrow(run, schema)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[walk(c, tuple(e), s, last) for s in range(4)] for c, e, last in zip(*(batch.column(x).to_pylist() for x in ("codes", "ends", "last")))]
            audits = pa.array([[audit for audit, _ in ways] for ways in found], pa.list_(pa.string()))
            after = pa.array([[state for _, state in ways] for ways in found], pa.list_(pa.int32()))
            kept = [batch.column(c) for c in ("conv_id", "part", "parts", "total")]
            yield pa.RecordBatch.from_arrays([*kept, audits, after], ["conv_id", "part", "parts", "total", "audits", "after"])

    walks = met(prices.select(*key, "codes"), ends).select(*key, "codes", "ends", "last", "parts", "total")
    walks = written(walks.mapInArrow(walked, f"conv_id {name}, part int, parts int, total bigint, audits array<string>, after array<int>"), "turn-walks")
    edge = bits.select(
        *key, "gap_first", "gap_last",
        F.when(F.length("codes") > 0, code_at(F.lit(1))).alias("first_code"), F.when(F.length("codes") > 0, code_at(F.lit(-1))).alias("last_code"),
    )
    run, schema = _chosen(f"conv_id {name}, part int, state int, over bigint, same bigint")
    starts = met(walks.select(*key, "after"), edge).groupBy("conv_id").applyInArrow(run, schema)
    done = met(walks, starts).select(*key, "parts", "total", F.element_at("audits", F.col("state") + 1).alias("audit"), "state", "over", "same")
    done = met(met(bits.drop("audit", "cost"), done), again, "left")
    spans = done.groupBy("conv_id").agg(
        F.min("part").alias("part"), F.lit(True).alias("leads"),
        (F.max("gap_last") - F.min("gap_first") + 1 - F.sum(F.col("gap_distinct") - F.col("same"))).alias("span"),
    )
    leading = lambda value: F.when(F.col("leads"), F.coalesce(value, F.lit(0))).otherwise(0).cast("long")
    done = met(done, spans, "left").select(
        "state", "conv_id", "part", "parts", leading(F.col("total")).alias("cost"), "audit", "roles", "texts", leading(F.col("span")).alias("gaps"), "blank",
        (F.col("duplicate") + F.when(F.col("again").isNull(), 0).otherwise(F.size("again"))).alias("duplicate"),
        (F.col("truncated") - F.coalesce("short", F.lit(0))).alias("truncated"), (F.col("illegal") + F.col("over")).alias("illegal"),
    )
    schema = T.StructType([f for f in done.schema if f.name != "state"])
    return written(done.mapInArrow(_applied(schema), schema), "turn-repairs")


def _marked(codes: bytes, again: list[int] | None) -> bytes:
    """codes with the rows that stood in an earlier bit set to go."""
    out = bytearray(codes)
    for i in again or ():
        out[i] = out[i] & 3 | _FORCED
    return bytes(out)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits in order of (conv_id, part) to each conversation's digest and audit; a bit's texts are let go once they are hashed."""
    state: tuple | None = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            conv = row.column("conv_id")
            if state is None or conv.to_pylist() != state[0].to_pylist():
                if state is not None:
                    yield _hash_row(state)
                state = (conv, hashlib.sha256(), [], [False])
            for role, text in zip(row.column("roles")[0].as_py(), row.column("texts")[0].as_py()):
                state[1].update((("\n" if state[3][0] else "") + role + ":" + text).encode())
                state[3][0] = True
            state[2].append(row.column("audit")[0].as_py())
    if state is not None:
        yield _hash_row(state)


def _hash_row(state: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([state[0], pa.array(["".join(state[2])]), pa.array([state[1].hexdigest()])], ["conv_id", "audit", "repaired_sha256"])


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of "role:text" joined by newlines).

    SHA-256 goes from byte to byte, so a conversation of many bits is hashed by one task, a bit at a time.
    """
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = F.array_join(F.zip_with("roles", "texts", lambda role, text: F.concat(role, F.lit(":"), text)), "\n")
    one = fixed.filter("parts = 1").select("conv_id", *counts, "audit", F.sha2(joined, 256).alias("repaired_sha256"))
    many = fixed.filter("parts > 1")
    name = fixed.schema["conv_id"].dataType.simpleString()
    texts = many.select("conv_id", "part", "audit", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    texts = texts.mapInArrow(trimmed(_hashed), f"conv_id {name}, audit string, repaired_sha256 string")
    sums = many.groupBy(F.col("conv_id").alias("conv_")).agg(*[F.sum(c).alias(c) for c in counts])
    return one.unionByName(sums.join(texts, sums.conv_.eqNullSafe(texts.conv_id)).select("conv_id", *counts, "audit", "repaired_sha256"))
