"""Repair of conversation structure by the cheapest edits, found run by run.

A conversation's turns become symbols: the role's initial with a mark for a truncated text, or "goes" for a blank or
repeated turn. Equal consecutive symbols are one run. One symbol is a min-plus matrix over the four states of the wanted
order `(s?(ua)+)?` (nothing yet, after a system, a user, an assistant turn); a run of n symbols is passed by the cached
powers of two of its matrix, from the last run to the first. The choices are then unrolled forward, splitting runs at powers
of two, so that of all cheapest edits those with the least letters come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .base import long_id, pick, stream, table

SPACES = " \t\n\x0b\x0c\r"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
FAR = 1 << 60  # no path

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the state behind a turn that is made or renamed to fit
MADE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
GOES = "x"  # a blank or repeated turn; other symbols: initial in lower case, in upper case where truncated, o or O for other roles

Vector = tuple[int, int, int, int]
Matrix = tuple[Vector, Vector, Vector, Vector]
Runs = tuple[tuple[str, int], ...]

PAIRS = ("su", "ua", "au")
LARGEST = (1 << 63) - 1

OUT = (
    "conv_id long, place long, edit string, role string, text string, gaps long, blank long, duplicate long, "
    "truncated long, illegal long, cost long, audit string"
)


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(min(a[p][m] + b[m][q] for m in STATES), FAR) for q in STATES) for p in STATES)


def _before(a: Matrix, costs: Vector) -> Vector:
    """Costs to the end before a stretch, from those behind it."""
    return tuple(min(min(a[p][q] + costs[q] for q in STATES), FAR) for p in STATES)


def _made() -> Matrix:
    """Any number of turns put in; a third would only come back to where one leads."""
    rows = []
    for p in STATES:
        row = [FAR] * 4
        row[p] = 0
        q, cost = p, 0
        for _ in range(2):
            q, cost = NEXT[q], cost + INSERT_COST
            row[q] = min(row[q], cost)
        rows.append(tuple(row))
    return tuple(rows)


INSERTS = _made()
ENDING = _before(INSERTS, tuple(0 if p in ENDS else FAR for p in STATES))


def _edits(symbol: str) -> Matrix:
    """One turn, without turns put in before it."""
    rows = [[FAR] * 4 for _ in STATES]
    more = TRUNCATED_COST if symbol.isupper() else 0
    for p in STATES:
        rows[p][p] = DELETE_COST
        if symbol != GOES:
            rows[p][NEXT[p]] = min(rows[p][NEXT[p]], REROLE_COST + more)
            kept = KEPT.get(symbol.lower(), {}).get(p)
            if kept is not None:
                rows[p][kept] = min(rows[p][kept], more)
    return tuple(map(tuple, rows))


@lru_cache(maxsize=None)  # nine symbols times the bits of a run's length
def power(symbol: str, bit: int) -> Matrix:
    """The matrix of 2^bit equal turns."""
    if bit == 0:
        return _times(INSERTS, _edits(symbol))
    half = power(symbol, bit - 1)
    return _times(half, half)


def before_run(symbol: str, n: int, costs: Vector) -> Vector:
    while n:
        bit = n.bit_length() - 1
        costs = _before(power(symbol, bit), costs)
        n -= 1 << bit
    return costs


def _turn(symbol: str, state: int, costs: Vector) -> tuple[str, int]:
    """Letters of one turn and those put in before it, the least of the cheapest, and the state behind."""
    here = _before(power(symbol, 0), costs)
    more = TRUNCATED_COST if symbol.isupper() else 0
    letters = ""
    while True:
        if DELETE_COST + costs[state] == here[state]:
            return letters + DELETE, state
        if INSERT_COST + here[NEXT[state]] == here[state]:
            letters, state = letters + INSERT, NEXT[state]
            continue
        kept = KEPT.get(symbol.lower(), {}).get(state)
        if kept is not None and more + costs[kept] == here[state]:
            return letters + KEEP, kept
        return letters + REROLE, NEXT[state]


def _unrolled(symbol: str, n: int, state: int, costs: Vector) -> Iterator[tuple[str, int]]:
    """Letters and states through a run; `costs` are those behind it."""
    if symbol == GOES:  # what is put in can wait: D comes before I
        yield DELETE * n, state
        return
    todo = [(n, costs)]
    while todo:
        n, costs = todo.pop()
        if n == 1:
            letters, state = _turn(symbol, state, costs)
            yield letters, state
            continue
        last = 1 << (n - 1).bit_length() - 1
        todo.append((last, costs))
        todo.append((n - last, before_run(symbol, last, costs)))


def solve(runs: Runs) -> tuple[int, str, str]:
    """(cost, letters of all turns, letters without those of turns that must go)."""
    behind = [ENDING]
    for symbol, n in reversed(runs):
        behind.append(before_run(symbol, n, behind[-1]))
    cost = behind.pop()[START]
    state, audit, plan = START, [], []
    for symbol, n in runs:
        for letters, state in _unrolled(symbol, n, state, behind.pop()):
            audit.append(letters)
            plan.append(letters.replace(DELETE, "") if symbol == GOES else letters)
    while ENDING[state]:
        audit.append(INSERT)
        plan.append(INSERT)
        state = NEXT[state]
    return cost, "".join(audit), "".join(plan)


_short = lru_cache(maxsize=1 << 15)(solve)


def solved(runs: Runs) -> tuple[int, str, str]:
    return _short(runs) if len(runs) <= 32 else solve(runs)


class _Conversation:
    """One conversation of the stream: first its symbols, then its texts, one at a time."""

    def __init__(self, name: int | None) -> None:
        self.name = name
        self.runs: list[list] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0
        self.initial: str | None = None
        self.least = self.most = None
        self.turns = 0
        self.plan: Iterator[str] | None = None
        self.state, self.place = START, 0

    def symbol(self, initial: str, fault: str | None, copies: int, turn: int | None) -> None:
        if not copies:
            return
        if turn is not None and turn != self.most:  # in order, so each is new or the last one
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        if fault:
            self.faults[fault] += copies if fault != "truncated" else 1
            if fault == "truncated":
                self.faults["duplicate"] += copies - 1
        else:
            self.faults["duplicate"] += copies - 1
        if self.initial is not None and self.initial + initial not in PAIRS:
            self.illegal += 1
        self.illegal += copies - 1  # no role may follow itself
        self.initial = initial
        goes = fault in ("blank", "duplicate")
        if not goes:
            sign = initial if initial and initial in "sua" else "o"
            self._run(sign.upper() if fault else sign, 1)
            copies -= 1
        if copies:
            self._run(GOES, copies)

    def _run(self, symbol: str, n: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])

    def summary(self) -> tuple:
        cost, audit, plan = solved(tuple((s, n) for s, n in self.runs))
        self.plan = iter(plan)
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, LARGEST)
        counts = (gaps, *self.faults.values(), self.illegal, cost, audit)
        return (self.name, None, None, None, None, *counts)

    def _row(self, edit: str, role: str, text: str) -> tuple:
        row = (self.name, self.place, edit, role, text, *[None] * 7)
        self.place += 1
        return row

    def _inserted(self) -> tuple:
        self.state = NEXT[self.state]
        return self._row(INSERT, MADE[self.state], "")

    def text(self, role: str, text: str) -> Iterator[tuple]:
        for letter in self.plan:
            if letter == INSERT:
                yield self._inserted()
                continue
            if letter == KEEP:
                self.state = KEPT[role[0]][self.state]
                yield self._row(KEEP, role, text)
            elif letter == REROLE:
                self.state = NEXT[self.state]
                yield self._row(REROLE, MADE[self.state], text)
            return

    def rest(self) -> Iterator[tuple]:
        for _ in self.plan:
            yield self._inserted()


def _work(rows: Iterable[tuple]) -> Iterator[tuple]:
    now: _Conversation | None = None
    for name, phase, initial, fault, copies, turn, role, text in rows:
        if now is None or now.name != name:
            if now is not None:
                if now.plan is None:
                    yield now.summary()
                yield from now.rest()
            now = _Conversation(name)
        if phase == 0:
            now.symbol(initial, fault, copies, turn)
            continue
        if now.plan is None:
            yield now.summary()
        yield from now.text(role, text)
    if now is not None:
        if now.plan is None:
            yield now.summary()
        yield from now.rest()


def repair(
    turns: DataFrame,
    copies: Column | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Per conversation one row with a null `place` (gaps, blank, duplicate, truncated, illegal, cost, audit), and its repaired
    turns (place from 0, edit K, R or I, role, text), the former before the latter within one partition.

    Turns stand by `turn`, nulls first, equal ones by role and text. A turn's first fault counts: blank (nothing but ASCII
    blanks), duplicate (role and text seen earlier), truncated (the last character but blanks is none of `.!?`). Edits: Keep 0,
    Rerole to user or assistant 2, Delete 3 (a must for blank and duplicate turns), Insert an empty user or assistant turn 2;
    a truncated turn that is not deleted costs 1. The cheapest edits that give role initials `(s?(ua)+)?` are taken, among
    equals those whose letters (K, R, D, I in order) are least. `illegal` counts neighbours whose initials are not su, ua or
    au; `gaps` is the number of whole numbers missing between the least and the largest turn (no more than 2^63 - 1).

    `copies` says how often a row stands in its place: 0 leaves only the conversation's name. Null role or text is one space; a
    null conv_id is a conversation of its own; null turns stand first and make no gaps; a conversation whose rows all have
    0 copies has zeros and an empty audit; an empty table gives no row.

    One shuffle by conversation. A task holds 16 bytes or less per run of equal symbols and two letters per turn, not the
    texts: these follow in a second phase of the same sorted stream, of any length one at a time.
    """
    rows = pick(
        turns,
        conv_id=long_id(conv_id),
        turn=long_id(turn),
        role=F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")),
        text=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")),
        copies=F.lit(1) if copies is None else copies,
    )
    rows = rows.withColumn("copies", F.col("copies").cast("bigint"))
    bare = F.rtrim("text", F.lit(SPACES))
    there = F.col("copies") > 0
    end = F.when(~there, None).when(F.length(bare) == 0, "blank").when(~F.right(bare, F.lit(1)).isin(*STOPS), "truncated")
    rows = rows.withColumn("end", end).repartition("conv_id")
    # windows over more keys than the shuffle's need no other one
    told = W.partitionBy("conv_id", "role", "text", there).orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("nth", F.row_number().over(told))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "nth")
    rows = rows.withColumn("nr", F.row_number().over(order))
    fault = F.when(F.col("end") == "blank", "blank").when(there & (F.col("nth") > 1), "duplicate").otherwise(F.col("end"))
    rows = rows.withColumn("fault", fault)
    stays = there & ~F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    phased = rows.withColumn("phase", F.explode(F.when(stays, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    second = F.col("phase") == 1
    streamed = phased.select(
        "conv_id", "phase", "nr", F.substring("role", 1, 1).alias("initial"), "fault", "copies", "turn",
        F.when(second, F.col("role")).alias("role"), F.when(second, F.col("text")).alias("text"),
    ).sortWithinPartitions("conv_id", "phase", "nr")
    return stream(streamed.drop("nr"), _work, OUT)


def digests(found: DataFrame) -> DataFrame:
    """One row per conversation: its summary and the digest of its repaired turns, `role:text` joined by line ends.

    `found` is what `repair` returns, in its order within partitions."""

    def read(rows: Iterable[tuple]) -> Iterator[tuple]:
        now, hashed, first = None, None, True
        for row in rows:
            if row[1] is None:
                if now is not None:
                    yield (*now, hashed.hexdigest())
                now, hashed, first = (row[0], *row[5:]), hashlib.sha256(), True
                continue
            if not first:
                hashed.update(b"\n")
            first = False
            hashed.update(row[3])
            hashed.update(b":")
            hashed.update(row[4])
        if now is not None:
            yield (*now, hashed.hexdigest())

    schema = (
        "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string"
    )
    return stream(found, read, schema, as_bytes=("role", "text"))


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The turns with planted faults, and how often each stands, by crc32 of `conv_id:turn` modulo 20 (null: one space)."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", None, "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, STOPS, "")).otherwise(text)
    role = F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" ")))
    out = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    return out, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return digests(repair(*damaged(table(spark, folder, "conversations"))))


OP11_SQL = r"""
with recursive keyed as (
  select *, list_reduce([4294967295] || [ord(x)::bigint for x in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')],
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, i: xor(d >> 1, case when d & 1 = 1 then 3988292384 else 0 end))) as crc
  from conversations),
kinds as (select *, xor(crc, 4294967295) % 20 as kind from keyed),
d as (select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
    case kind when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text,
    unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from kinds),
o as (select *, rtrim(text, E' \t\n\x0b\x0c\r') as bare, left(role, 1) as r,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as nr from d),
f as (select *, case when bare = '' then 'b' when row_number() over (partition by conv_id, role, text order by nr) > 1 then 'd'
    when right(bare, 1) not in ('.', '!', '?') then 't' else '' end as fault,
    lag(r) over (partition by conv_id order by nr) || r not in ('su', 'ua', 'au') as bad from o),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (bad) as illegal, count(*) as n
  from f group by conv_id),
-- per state (0 nothing yet, 1 system, 2 user, 3 assistant) the least [cost, letters] with the texts so far
p as (
  select conv_id, 0::bigint as nr, {'c': 0, 'a': '', 't': ''::varchar} as s0, {'c': 999999, 'a': '', 't': ''::varchar} as s1,
    {'c': 2, 'a': 'I', 't': E'user:\n'} as s2, {'c': 4, 'a': 'II', 't': E'user:\nassistant:\n'} as s3
  from (select distinct conv_id from conversations)
  union all
  select conv_id, nr, s0, s1,
    list_min([s2, {'c': s0.c + 2, 'a': s0.a || 'I', 't': s0.t || E'user:\n'}, {'c': s1.c + 2, 'a': s1.a || 'I', 't': s1.t || E'user:\n'},
      {'c': s3.c + 2, 'a': s3.a || 'I', 't': s3.t || E'user:\n'}]),
    list_min([s3, {'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || E'assistant:\n'}, {'c': s0.c + 4, 'a': s0.a || 'II', 't': s0.t || E'user:\nassistant:\n'},
      {'c': s1.c + 4, 'a': s1.a || 'II', 't': s1.t || E'user:\nassistant:\n'}])
  from (
    select p.conv_id, f.nr,
      {'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t} as s0,
      list_min([{'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t},
        {'c': s0.c + case when r = 's' then more else 999999 end, 'a': s0.a || 'K', 't': s0.t || line}]) as s1,
      list_min([{'c': s2.c + 3, 'a': s2.a || 'D', 't': s2.t},
        {'c': s0.c + case when r = 'u' then more else 999999 end, 'a': s0.a || 'K', 't': s0.t || line},
        {'c': s1.c + case when r = 'u' then more else 999999 end, 'a': s1.a || 'K', 't': s1.t || line},
        {'c': s3.c + case when r = 'u' then more else 999999 end, 'a': s3.a || 'K', 't': s3.t || line},
        {'c': s0.c + more + 2, 'a': s0.a || 'R', 't': s0.t || 'user' || said}, {'c': s1.c + more + 2, 'a': s1.a || 'R', 't': s1.t || 'user' || said},
        {'c': s3.c + more + 2, 'a': s3.a || 'R', 't': s3.t || 'user' || said}]) as s2,
      list_min([{'c': s3.c + 3, 'a': s3.a || 'D', 't': s3.t},
        {'c': s2.c + case when r = 'a' then more else 999999 end, 'a': s2.a || 'K', 't': s2.t || line},
        {'c': s2.c + more + 2, 'a': s2.a || 'R', 't': s2.t || 'assistant' || said}]) as s3
    from p join (select *, case fault when 't' then 1 when '' then 0 else 999999 end as more, ':' || text || chr(10) as said, role || ':' || text || chr(10) as line from f) f
      on p.conv_id is not distinct from f.conv_id and f.nr = p.nr + 1)),
e as (select p.conv_id, list_min([s0, s3]) as best from p left join c on p.conv_id is not distinct from c.conv_id where p.nr = coalesce(c.n, 0))
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, best.c::bigint as cost, best.a as audit,
  sha256(regexp_replace(best.t, '\n$', '')) as repaired_sha256
from e left join c on e.conv_id is not distinct from c.conv_id
"""
