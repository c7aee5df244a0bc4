"""Repair of conversations: the cheapest edits that make turns alternate, by a DP over the turns that are retained.

Rows of a conversation come by turn, null turns first; rows that share a turn by the first 64 characters of `role:text`
and then by its digest, so that repeated rows lie side by side. Each row's first fault counts: blank (white space only),
duplicate (its role and text came earlier), truncated (its last character that is not white space ends no sentence).

Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows), Insert an empty
turn 3; a truncated row that stays costs 3 more. Afterwards the roles' initials read `(s?(ua)+)?`.

The DP goes over rows that are kept or reroled. What lies between two of them is deleted, and costs the difference of two
prefix sums of deletions, so that one running minimum for each state (the role retained last) prices every gap; the pair
of roles says how many turns go in between. Of plans that cost the same, the one whose audit (the edits' initials in
order) is least in ASCII stays. Plans of one state cover the same rows, so no audit is the beginning of another.

A conversation of any length: sorted rows are dealt by ranges, and within a range cut into chunks of bounded size. A
chunk is planned from every state that it may be entered in, and plans of chunks are put together as plans of rows are.
No task holds a conversation's rows; what meets for one conversation is its plans, which are as long as its audit.

Defined results: a null role or text is one space. A null conv_id is a conversation like others. Rows that repeat are
counted before they move. A conversation whose rows all go has an empty audit of deletions and no turns. Columns other
than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import SPACE, map_rows, map_stream, stored

START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = " sua"
NAMES = ("", "system", "user", "assistant")
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Turns to insert before a role, by the role retained last; what is not here cannot follow.
BETWEEN = {(START, SYSTEM): 0, (START, USER): 0, (START, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
AT_END = (0, 2, 1, 0)
OK, TRUNCATED, GONE = "ktd"

Plan = tuple[int, str, str]  # cost, audit, the state after each chunk


def damaged(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults put in by crc32 of `conv_id:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 makes its role user.
    Nulls are one space, in the key too; conv_id and turn themselves stay null.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    out = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("_case"))
    case = F.col("_case")
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(case == 0, F.array().cast("array<int>")).when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def _numbered(rows: DataFrame) -> DataFrame:
    """Distinct rows in order, dealt by ranges: conv_id, turn, role, text, n (how often), later (role and text came before)."""
    blank = F.lit(" ")
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    counted = base.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("said", said)
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = counted.groupBy("conv_id", "said").agg(F.count(F.lit(1)).alias("turns"), F.min(place).alias("first")).where("turns > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    marked = counted.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    marked = marked.select("conv_id", "turn", "role", "text", "n", later.alias("later"), F.substring(F.concat_ws(":", "role", "text"), 1, 64).alias("head"), "said")
    order = ["conv_id", "turn", "head", "said"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n", "later")


@dataclass
class Tally:
    """What is counted over consecutive rows of one conversation."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str = ""
    last: str = ""

    def then(self, o: Tally) -> Tally:
        """Both one after the other: the pair of rows where they meet counts, a turn that both hold counts once."""
        if not self.rows or not o.rows:
            return self if self.rows else o
        met = self.last + o.first not in ("su", "ua", "au")
        shared = self.high is not None and self.high == o.low
        lows, highs = [x for x in (self.low, o.low) if x is not None], [x for x in (self.high, o.high) if x is not None]
        return Tally(
            self.rows + o.rows, self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated, self.illegal + o.illegal + met,
            self.turns + o.turns - shared, min(lows, default=None), max(highs, default=None), self.first, o.last,
        )

    def columns(self) -> tuple[int, ...]:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns, self.blank, self.duplicate, self.truncated, self.illegal


def _marked(turn: int | None, role: str, text: str, n: int, later: bool) -> tuple[Tally, str]:
    """One distinct row and its n - 1 copies: what it adds to the tally, and the mark of its first copy."""
    inner = text.strip(SPACE)
    mark = GONE if not inner or later else OK if inner[-1] in ".!?" else TRUNCATED
    initial = role[:1]
    twice = n - 1 if initial + initial not in ("su", "ua", "au") else 0
    blank, duplicate = (n, 0) if not inner else (0, n if later else n - 1)
    return Tally(n, blank, duplicate, int(mark == TRUNCATED), twice, int(turn is not None), turn, turn, initial, initial), mark


def plans(entry: int, rows: Iterable[tuple[str, str, int]]) -> dict[int, Plan]:
    """The best plan to each state over rows (initial, mark, copies that follow), entered in state `entry`."""
    gone = 0  # deletions if all rows so far went: the prefix sum
    run = {entry: (0, "", 0)}  # by state: cost less the prefix sum, audit, deletions that the audit has room for
    for initial, mark, copies in rows:
        if mark != GONE:
            extra, best = CUT_OFF if mark == TRUNCATED else 0, {}
            for role in (SYSTEM, USER, ASSISTANT):
                kept = initial == INITIALS[role]
                if kept or role != SYSTEM:
                    price, letter = (extra, "K") if kept else (extra + REROLE, "R")
                    found = [(c + price + INSERT * n, audit + "D" * (gone - at) + "I" * n + letter) for state, (c, audit, at) in run.items() if (n := BETWEEN.get((state, role))) is not None]
                    if found:
                        best[role] = min(found)
            gone += 1
            for role, (c, audit) in best.items():
                old = run.get(role)
                if old is None or (c - DELETE, audit) < (old[0], old[1] + "D" * (gone - old[2])):
                    run[role] = c - DELETE, audit, gone
            gone += copies
        else:
            gone += 1 + copies
    return {state: (c + DELETE * gone, audit + "D" * (gone - at), str(state)) for state, (c, audit, at) in run.items()}


Table = dict[int, dict[int, Plan]]


def chained(one: Table, two: Table) -> Table:
    """Plans over two stretches in turn, from each state of entry to each state after."""
    out: Table = {}
    for entry, ways in one.items():
        best: dict[int, Plan] = {}
        for middle, (c, audit, path) in ways.items():
            for state, (d, more, rest) in two.get(middle, {}).items():
                way = c + d, audit + more, path + rest
                if state not in best or way < best[state]:
                    best[state] = way
        out[entry] = best
    return out


def ended(ways: dict[int, Plan]) -> Plan:
    return min((c + INSERT * AT_END[state], audit + "I" * AT_END[state], path) for state, (c, audit, path) in ways.items())


def edited(state: int, audit: str, rows: Iterable[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or come in, for rows (role, text, copies that follow)."""
    given = (x for role, text, copies in rows for x in ((role, text), *((None,) * copies)))
    for letter in audit:
        row = None if letter == "I" else next(given)
        if letter == "K":
            state = INITIALS.index(row[0][0])
            yield letter, *row
        elif letter != "D":
            state = ASSISTANT if state == USER else USER
            yield letter, NAMES[state], row[1] if row else ""


TALLY = "struct<rows:long,blank:long,duplicate:long,truncated:long,illegal:long,turns:long,low:long,high:long,first:string,last:string>"
PLANS = "array<struct<entry:int,state:int,cost:long,audit:string,path:string>>"
PIECES = f"kind string, conv_id long, part long, chunks int, tally {TALLY}, plans {PLANS}, roles array<string>, texts array<string>, copies array<long>, marks string"


def _flat(table: Table) -> list[dict]:
    return [{"entry": e, "state": s, "cost": c, "audit": a, "path": p} for e, ways in table.items() for s, (c, a, p) in ways.items()]


def _table(flat: list[dict]) -> Table:
    out: Table = {}
    for x in flat:
        out.setdefault(x["entry"], {})[x["state"]] = x["cost"], x["audit"], x["path"]
    return out


def _pieces(rows: Iterator[tuple], chunk_rows: int, chunk_chars: int) -> Iterator[tuple]:
    """Of a sorted range: `whole` conversations, `chunk`s of those that it may share with others, and a `segment` for each of these.

    The first and the last conversation of a range may go on in another range.
    """
    number = TaskContext.get().partitionId()
    held: list[tuple] = []  # role, text, mark, copies
    tally, chars, serial, seq, conv, first, whole = Tally(), 0, 0, 0, None, True, False
    before, total = None, Tally()

    def chunk(entries: Iterable[int], kind: str) -> tuple:
        marks = [(role[:1], mark, copies) for role, _, mark, copies in held]
        table = {e: plans(e, marks) for e in entries}
        roles, texts, faults, copies = zip(*held, strict=True)
        return table, (kind, conv, number << 32 | serial, 1, vars(tally).copy(), _flat(table), roles, texts, copies, "".join(faults))

    def close(last: bool) -> Iterator[tuple]:
        """A chunk is full, or the conversation ended within this range."""
        nonlocal held, tally, chars, serial, seq, before, total
        if whole and last and not seq:
            yield chunk([START], "whole")[1]
        else:
            table, row = chunk(range(4), "chunk")
            yield row
            before, total, seq, serial = table if before is None else chained(before, table), total.then(tally), seq + 1, serial + 1
            if last:
                yield "segment", conv, number << 32 | serial - seq, seq, vars(total).copy(), _flat(before), None, None, None, None
        held, tally, chars = [], Tally(), 0
        if last:
            before, total, seq = None, Tally(), 0

    for conv_id, turn, role, text, n, later in rows:
        if not first and conv_id != conv:
            yield from close(True)
            whole = True
        elif len(held) >= chunk_rows or chars >= chunk_chars:
            yield from close(False)
        conv, first = conv_id, False
        more, mark = _marked(turn, role, text, n, later)
        tally = tally.then(more)
        held.append((role, text, mark, n - 1))
        chars += len(role) + len(text)
    if held:
        whole = False
        yield from close(True)


@dataclass
class Repaired:
    """summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    turns: conv_id, part, place, edit, role, text; a conversation's turns come in order of part and place.
    """

    summary: DataFrame
    turns: DataFrame


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, part long, place int, edit string, role string, text string"


def repair(rows: DataFrame, chunk_rows: int = 512, chunk_chars: int = 1 << 20) -> Repaired:
    """The conversations in rows(conv_id, turn, role, text, ...) with their faults counted and their turns repaired.

    A chunk closes after `chunk_rows` distinct rows or `chunk_chars` characters; the result does not depend on them.
    """
    pieces = stored(map_stream(_numbered(rows), PIECES, lambda: partial(_pieces, chunk_rows=chunk_rows, chunk_chars=chunk_chars), flush_rows=512, weigh=(9,), flush_bytes=1 << 12), "pieces")

    def counted(row: tuple) -> Iterator[tuple]:
        conv_id, tally, ways = row
        cost, audit, _ = ended(_table(ways)[START])
        yield conv_id, *Tally(**tally).columns(), cost, audit

    def of_whole(row: tuple) -> Iterator[tuple]:
        conv_id, part, ways, *held = row
        audit = ended(_table(ways)[START])[1]
        return ((conv_id, part, k, *x) for k, x in enumerate(edited(START, audit, zip(*held, strict=True))))

    def joined(segments: Iterator[tuple]) -> Iterator[tuple]:
        """Segments of a conversation lie one after another: its summary and the states between its chunks."""
        conv, table, total, parts, some = None, None, Tally(), [], False

        def out() -> tuple:
            cost, audit, path = ended(table[START])
            return conv, *total.columns(), cost, audit, [{"part": p, "entry": int(e), "state": int(s), "last": p == parts[-1]} for p, e, s in zip(parts, "0" + path, path, strict=False)]

        for conv_id, part, chunks, tally, ways in segments:
            if some and conv_id != conv:
                yield out()
                table, total, parts = None, Tally(), []
            conv, some = conv_id, True
            table = _table(ways) if table is None else chained({START: table[START]}, _table(ways))
            total = total.then(Tally(**tally))
            parts += range(part, part + chunks)
        if some:
            yield out()

    def of_chunk(row: tuple) -> Iterator[tuple]:
        conv_id, part, entry, state, last, ways, *held = row
        audit = _table(ways)[entry][state][1] + "I" * (AT_END[state] if last else 0)
        return ((conv_id, part, k, *x) for k, x in enumerate(edited(entry, audit, zip(*held, strict=True))))

    held = ["roles", "texts", "copies"]
    whole, shared = pieces.where("kind = 'whole'"), pieces.where("kind = 'chunk'")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = pieces.where("kind = 'segment'").select("conv_id", "part", "chunks", "tally", "plans").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part")
    settled = stored(map_stream(segments, f"{SUMMARY}, states array<struct<part:long,entry:int,state:int,last:boolean>>", lambda: joined, flush_rows=64), "settled")
    states = settled.select(F.inline("states")).withColumnRenamed("part", "at")
    summary = map_rows(whole.select("conv_id", "tally", "plans"), SUMMARY, lambda: counted).unionByName(settled.drop("states"))
    turns = map_rows(whole.select("conv_id", "part", "plans", *held), TURNS, lambda: of_whole, weigh=5)
    met = shared.join(states, shared.part == states["at"])
    turns = turns.unionByName(map_rows(met.select("conv_id", "part", "entry", "state", "last", "plans", *held), TURNS, lambda: of_chunk, weigh=5))
    return Repaired(summary, turns)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256 of each conversation's `role:text` lines.

    The digest of a conversation is a chain over its lines in order, so these stream through one task; it holds none of them.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = turns.select("conv_id", "part", "place", F.concat_ws(":", "role", "text").alias("line")).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "place")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        conv, chain = None, None
        for conv_id, _, _, line in rows:
            if chain is not None and conv_id != conv:
                yield conv, chain.hexdigest()
                chain = None
            if chain is None:
                chain = hashlib.sha256()
            else:
                chain.update(b"\n")
            conv = conv_id
            chain.update(line.encode())
        if chain is not None:
            yield conv, chain.hexdigest()

    return map_stream(lines, "conv_id long, sha256 string", lambda: run)
