import hashlib
import zlib
from itertools import groupby

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabprep.llm.repair import DELETE, INSERT, KEPT, NEXT, SPACES, damaged, digests, repair, solve

from .conftest import clashing, rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def cheapest(symbols):
    """Every sequence of edits, two turns put in at most between others; (cost, letters) of the least."""
    best = None

    def go(i, state, cost, audit, made):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(symbols) and state in (0, 3) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if made < 2:
            go(i, NEXT[state], cost + 2, audit + "I", made + 1)
        if i < len(symbols):
            symbol = symbols[i]
            go(i + 1, state, cost + 3, audit + "D", 0)
            if symbol != "x":
                more = int(symbol.isupper())
                if (kept := KEPT.get(symbol.lower(), {}).get(state)) is not None:
                    go(i + 1, kept, cost + more, audit + "K", 0)
                go(i + 1, NEXT[state], cost + 2 + more, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return best


def runs(symbols):
    return tuple((s, len(list(g))) for s, g in groupby(symbols))


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from("suaoSUAOx"), max_size=6))
def test_edits(symbols):
    assert solve(runs(symbols))[:2] == cheapest(symbols)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.sampled_from("suaoUAx"), st.integers(1, 40)), max_size=5))
def test_long_runs(given):
    """Runs passed by powers cost what the same turns cost one by one, and the letters add up to it."""
    symbols = "".join(s * n for s, n in given)
    cost, audit, plan = solve(runs(symbols))
    assert cost == solve(tuple((s, 1) for s in symbols))[0]
    assert len(audit.replace(INSERT, "")) == len(symbols)
    state, paid, letters = 0, 0, iter(audit)
    for symbol in symbols:
        while (letter := next(letters)) == INSERT:
            state, paid = NEXT[state], paid + 2
        more = int(symbol.isupper())
        paid += {"K": more, "R": 2 + more, "D": 3}[letter]
        state = {"K": lambda: KEPT[symbol.lower()][state], "R": lambda: NEXT[state], "D": lambda: state}[letter]()
    rest = list(letters)
    for _ in rest:
        state = NEXT[state]
    assert state in (0, 3) and paid + 2 * len(rest) == cost
    assert len(plan) == len(audit) - symbols.count("x")


def test_a_million_equal_turns():
    cost, audit, _ = solve((("x", 10**6), ("s", 10**6)))
    assert audit == DELETE * (10**6 + 1) + "K" + "R" * (10**6 - 2)
    assert cost == 3 * (10**6 + 1) + 2 * (10**6 - 2)


def plain(given, damage=True):
    """The contract on lists: everything about a conversation from its rows."""
    found = {}
    for conv, turn, role, text in given:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        found.setdefault(conv, [])
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in turns:
            bare = text.rstrip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            sign = role[:1] if role[:1] and role[:1] in "sua" else "o"
            symbols.append("x" if fault in ("blank", "duplicate") else sign.upper() if fault else sign)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = cheapest(symbols)
        state, made, left = 0, [], iter(turns)
        for letter in audit:
            if letter == "I":
                state = NEXT[state]
                made.append({2: "user:", 3: "assistant:"}[state])
                continue
            _, role, text = next(left)
            if letter == "K":
                state = KEPT[role[0]][state]
                made.append(f"{role}:{text}")
            elif letter == "R":
                state = NEXT[state]
                made.append({2: "user:", 3: "assistant:"}[state] + text)
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, digest))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
ROLES = ["user", "assistant", "system", "tool", None, "", "U"]


def hard():
    rng = __import__("random").Random(11)
    texts = ["Fine.", "Fine.", "cut", " \t\x0b", "", None, "é中! \n", "x. ", "a.b?c!", "long words. " * 3]
    out = [(c, t, ROLES[(t + c) % 2] if rng.random() < 0.7 else rng.choice(ROLES), f"{t}: {rng.choice(texts)}" if rng.random() < 0.5 else rng.choice(texts))
           for c in range(40) for t in range(rng.randint(0, 6))]
    out += [(None, None, None, None), (None, 1, "user", "a."), (50, None, "user", "x."), (50, 2, "assistant", "y"), (50, 9, "user", "z?")]
    out += [(51, 1, "user", "same."), (51, 1, "user", "same."), (51, 1, "assistant", "same."), (52, -(1 << 63), "user", "."), (53, 1, "assistant", "w" * 300_000 + ".")]
    return out


def test_against_lists(spark):
    given = hard()
    df = clashing(spark.createDataFrame(given, SCHEMA)).withColumns({"place": F.lit("x"), "copies": F.lit("x"), "audit": F.lit(1)}).repartition(3)
    assert rows(digests(repair(*damaged(df))), *COLUMNS) == plain(given)
    assert rows(digests(repair(df)), *COLUMNS) == plain(given, damage=False)


def test_repaired_turns(spark):
    given = [(1, 0, "user", "Hi."), (1, 1, "user", "You?"), (1, 2, "assistant", "Yes")]
    found = repair(spark.createDataFrame(given, SCHEMA))
    turns = rows(found.where("place is not null"), "place", "edit", "role", "text")
    assert turns == [(0, "K", "user", "Hi."), (1, "I", "assistant", ""), (2, "K", "user", "You?"), (3, "K", "assistant", "Yes")]
    assert rows(found.where("place is null"), "conv_id", "illegal", "truncated", "cost", "audit") == [(1, 1, 1, 3, "KIKK")]


def test_far_turns_and_nothing(spark):
    far = spark.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], SCHEMA)
    assert rows(repair(far).where("place is null"), "gaps", "audit") == [((1 << 63) - 1, "KK")]
    assert rows(repair(spark.createDataFrame([], SCHEMA))) == []
    gone = digests(repair(far, copies=F.lit(0)))
    assert rows(gone) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_row_many_times(spark):
    """A repeated row is one turn and faults; a long conversation of equal texts is passed as runs."""
    many = spark.range(0, 5000).select(F.lit(1).cast("bigint").alias("conv_id"), (F.col("id") % 50).alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    found = rows(repair(many).where("place is null"), "gaps", "duplicate", "illegal", "cost", "audit")
    assert found == [(0, 4999, 4999, 4999 * 3 + 2, "K" + "D" * 4999 + "I")]
