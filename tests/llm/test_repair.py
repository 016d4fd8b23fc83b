"""Conversation repair against a plain version of the contract and all edits of short ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchmart.llm import repair
from tests.llm.helpers import SMALL, same_as_sql, table

SHAPE = "conv_id long, turn long, role string, text string"
WHITE = "\x20\t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")


def plain_faults(rows):
    """Fault of each (role, text) in order."""
    seen, out = set(), []
    for row in rows:
        if not re.search(r"[^\x20\x09-\x0D]", row[1]):
            out.append("blank")
        elif row in seen:
            out.append("duplicate")
        elif row[1].rstrip(WHITE)[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add(row)
    return out


def plain_repair(rows):
    """(cost, audit, repaired rows): the least over all states of (cost, initials), row by row.

    States are spelled as what has been put out, short of repetition: '', 's', 'u', 'a'.
    """
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def offer(to, at, value):
        if at not in to or value[:2] < to[at][:2]:
            to[at] = value

    def inserted(at):
        for _ in range(3):
            for q, (cost, audit, done) in list(at.items()):
                for r in ("user", "assistant"):
                    if (q, r[0]) in moves:
                        offer(at, moves[q, r[0]], (cost + 3, audit + "I", done + ((r, ""),)))
        return at

    for (role, text), fault in zip(rows, plain_faults(rows)):
        after = {}
        for q, (cost, audit, done) in inserted(best).items():
            offer(after, q, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            if (q, role[:1]) in moves:
                offer(after, moves[q, role[:1]], (cost, audit + "K", done + ((role, text),)))
            for r in ("user", "assistant"):
                if (q, r[0]) in moves:
                    offer(after, moves[q, r[0]], (cost + 3, audit + "R", done + ((r, text),)))
        best = after
    return min((v for q, v in inserted(best).items() if q in ("", "a")), key=lambda v: v[:2])


def plain_report(table_rows):
    convs = defaultdict(list)
    for conv, turn, role, text in table_rows:
        rows = convs[conv]
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in rows if t is not None}
        pairs = [(r, t) for _, r, t in rows]
        faults = plain_faults(pairs)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:]))
        cost, audit, done = plain_repair(pairs)
        text = "\n".join(f"{r}:{t}" for r, t in done)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    out = repair.report(df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                           "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def random_rows(rng, convs, longest):
    rows = []
    for c in convs:
        for turn in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([turn] * 8 + [None, 0, turn + 5]),
                         rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]),
                         rng.choice(["Hi.", "Yes!", "so", "What? ", " \t", "", None, "é.", f"t{turn}."])))
    rng.shuffle(rows)
    return rows


def exhaustive(pairs, faults):
    """The least (cost, initials) over all edits of a short list with few insertions."""
    best = None
    for edits in itertools.product("DKua", repeat=len(pairs)):
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(pairs) + 1):
            out, cost, audit = gaps[0], 3 * len(gaps[0]), "I" * len(gaps[0])
            for e, gap, (role, _), fault in zip(edits, gaps[1:], pairs, faults):
                if e == "D":
                    cost, audit = cost + 4, audit + "D"
                else:
                    if fault in ("blank", "duplicate"):
                        break
                    cost += 3 * (fault == "truncated") + 3 * (e != "K")
                    out, audit = out + ((role[:1] or "-") if e == "K" else e), audit + ("K" if e == "K" else "R")
                out, cost, audit = out + gap, cost + 3 * len(gap), audit + "I" * len(gap)
            else:
                if GOOD.fullmatch(out) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def codes_of(pairs):
    kinds = {"": repair.SOUND, "truncated": repair.CUT, "duplicate": repair.DUPLICATE, "blank": repair.BLANK}
    return "".join(chr(ord("a") + 4 * kinds[f] + "sua".find(r[:1] or "-") % 4)
                   for (r, _), f in zip(pairs, plain_faults(pairs)))


def test_short_lists_by_all_edits():
    rng = random.Random(5)
    for _ in range(40):
        pairs = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "c", ""]))
                 for _ in range(rng.randint(1, 3))]
        want = exhaustive(pairs, plain_faults(pairs))
        cost, audit, _ = plain_repair(pairs)
        assert (cost, audit) == want
        codes = codes_of(pairs)
        assert repair.walk(codes, 0, repair.END, True)[0] == audit
        costs = repair.transfer(codes)
        assert min(costs[r] + repair.END[r] for r in range(4)) == cost


def test_long_walk_has_the_plain_result():
    rng = random.Random(6)
    pairs = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice([f"a{i}.", f"b{i}.", f"c{i}", "", "z."]))
             for i in range(700)]
    assert repair.walk(codes_of(pairs), 0, repair.END, True)[0] == plain_repair(pairs)[1]


@pytest.mark.parametrize("span", [1, 4, 1 << 14])
def test_random_tables(spark, monkeypatch, span):
    monkeypatch.setattr(repair, "SPAN", span)
    rows = random_rows(random.Random(span), [*range(30), None, -7], 9) + random_rows(random.Random(9), [99], 80)
    df = spark.createDataFrame(rows, SHAPE).repartition(5)
    for name in ("conv", "id", "step", "edit", "part", "codes", "gaps", "c0", "copy"):
        df = df.withColumn(name, F.lit("x"))
    assert got(df) == plain_report(rows)


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert got(empty) == []
    edits, about = repair.repair(empty)
    assert edits.count() == 0 and about.count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    long = [(5, t, ("user", "assistant")[t % 2], "w" * 300_000 + ".") for t in range(4)]
    copies = [(None, None, "user", "Same.")] * 3000
    rows = [(dropped, 0, "user", "Gone."), *long, *copies, (7, 1, None, None)]
    want = plain_report(rows)
    assert got(spark.createDataFrame(rows, SHAPE).repartition(3)) == want
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want


def test_edits_are_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "U."), (1, 3, "user", "cut")]
    edits, _ = repair.repair(spark.createDataFrame(rows, SHAPE))
    out = [tuple(r) for r in edits.orderBy("id", "step").select("edit", "turn", "role", "text").collect()]
    kept = "".join(r[2][0] for r in out if r[0] != "D")
    assert GOOD.fullmatch(kept)
    assert [r for r in out if r[0] == "I"] == [("I", None, r[2], "") for r in out if r[0] == "I"]
    assert "".join(r[0] for r in out) == plain_repair([r[2:] for r in rows])[1]


def test_given_conversations(spark):
    df = table(spark, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    from matchmart.llm.registry import QUERIES
    out = QUERIES["op12_repair_chats"](spark, SMALL)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_report(rows)
    same_as_sql(out, repair.ORACLE)


def test_sql_says_the_same_of_odd_rows(spark):
    rows = random_rows(random.Random(11), [*range(40), None], 8)
    df = spark.createDataFrame(rows, SHAPE)
    same_as_sql(repair.report(df), repair.ORACLE, conversations=df.toArrow())
