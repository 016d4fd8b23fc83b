"""Repair of conversation structure by a square-root checkpointed DP.

A conversation's rows, in the order of their turns, are edited so that the initials
of their roles read ``(s?(ua)+)?``. Edits: Keep (cost 0), Rerole to user or
assistant (3), Delete (4; blank and duplicate rows must go), Insert an empty user
or assistant row anywhere (3); a truncated row that stays adds 3. Of the cheapest
lists of edits the one whose initials are ASCII-least is taken.

The pattern is an automaton of four states (nothing yet, after s, after u, after
a) and every edit has one target in it, so a conversation costs four numbers per
row: the cheapest way to the end from each state. ``walk`` keeps these vectors only
at every sqrt(n)-th row, and computes a block's vectors again from the checkpoint at
its end when the walk forward reaches it.

A conversation may hold a third of all rows. Rows get ascending numbers by a range
sort of the whole table, a run of ``SPAN`` numbers within a conversation is a part,
and parts are worked on alone: each gives its 4 x 4 costs between states; a
conversation's parts (a record of some 200 bytes each) give the cost vector at each
part's end; with it each part walks from every state it may be entered in; and the
parts' end states give the state in which each is entered.

Defined cases: null conversation ids are one conversation; rows of one turn go by
role, then by the MD5 of their text, null turns first; a null role or text counts
as one space (a role that is illegal, a blank text); initials other than s, u, a
are never kept; an empty table gives empty tables; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import SPACE, col, load, stage

#: rows of a conversation that one record and one call hold
SPAN = 1 << 14
#: costs, and the two roles that may be given
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {2: "user", 3: "assistant"}
#: faults, in the order in which the first one counts, last to first
SOUND, CUT, DUPLICATE, BLANK = range(4)
#: states: nothing yet, after s, after u, after a; a given role leads from each to
GIVEN = (2, 2, 3, 2)
#: a row's initial (s, u, a, other) leads from each state to
KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
#: cost of reaching the end behind the last row: (ua)+ must be finished
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60


def faults_and_initials(codes: str) -> list[tuple[int, int]]:
    """Codes are letters: four times the fault, plus the initial."""
    return [divmod(ord(c) - ord("a"), 4) for c in codes]


def before(fault: int, initial: int, after: tuple) -> tuple:
    """The cost vector before a row, from the one after it."""
    cost = []
    for q in range(4):
        best = DELETE + after[q]
        if fault < DUPLICATE:
            extra = TRUNCATED * (fault == CUT)
            best = min(best, REROLE + extra + after[GIVEN[q]])
            if KEPT[initial][q] is not None:
                best = min(best, extra + after[KEPT[initial][q]])
        cost.append(best)
    u, a = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + u), min(cost[1], INSERT + u), u, a


def transfer(codes: str) -> list[int]:
    """The cheapest way through a part from each state (row) to each state (column)."""
    rows = faults_and_initials(codes)
    out = [0] * 16
    for q in range(4):
        v = tuple(0 if p == q else FAR for p in range(4))
        for fault, initial in reversed(rows):
            v = before(fault, initial, v)
        out[q::4] = v
    return out


def walk(codes: str, state: int, end: tuple, last: bool) -> tuple[str, int]:
    """The ASCII-least cheapest edits' initials through a part, and the state behind it.

    ``end`` is the cost vector behind the part; rows inserted behind it belong to the
    next part, if there is one.
    """
    rows = faults_and_initials(codes)
    n, step = len(rows), max(1, math.isqrt(len(rows)))
    kept, v = {n: tuple(end)}, tuple(end)
    for i in range(n - 1, -1, -1):
        v = before(*rows[i], v)
        if i % step == 0:
            kept[i] = v
    out = []
    for low in range(0, n, step):
        high = min(low + step, n)
        block = [kept[high]]
        for i in range(high - 1, low - 1, -1):
            block.append(before(*rows[i], block[-1]))
        block.reverse()
        for i in range(low, high):
            (fault, initial), here, after = rows[i], block[i - low], block[i - low + 1]
            extra = TRUNCATED * (fault == CUT)
            while True:
                if here[state] == DELETE + after[state]:
                    out.append("D")
                elif here[state] == INSERT + here[GIVEN[state]]:
                    out.append("I")
                    state = GIVEN[state]
                    continue
                elif KEPT[initial][state] is not None and here[state] == extra + after[KEPT[initial][state]]:
                    out.append("K")
                    state = KEPT[initial][state]
                else:
                    out.append("R")
                    state = GIVEN[state]
                break
    while last and END[state]:
        out.append("I")
        state = GIVEN[state]
    return "".join(out), state


def steps(codes: str, edits: str, state: int) -> list[dict]:
    """The edits one by one: the row each is about (its place in the part) and the role it gives."""
    rows, at, out = faults_and_initials(codes), 0, []
    for e in edits:
        given = ROLES[GIVEN[state]] if e in "IR" else None
        out.append({"at": at, "edit": e, "given": given})
        if e in "IR":
            state = GIVEN[state]
        elif e == "K":
            state = KEPT[rows[at][1]][state]
        at += e != "I"
    return out


def _illegal(first: int, second: int) -> bool:
    return (first, second) not in ((0, 1), (1, 2), (2, 1))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PART = pa.struct([(c, pa.int64()) for c in _COUNTS]
                  + [("head", pa.int32()), ("tail", pa.int32()), ("costs", pa.list_(pa.int64()))])
_PART_TYPE = StructType()
for _c in _COUNTS:
    _PART_TYPE.add(_c, LongType())
_PART_TYPE.add("head", IntegerType()).add("tail", IntegerType()).add("costs", ArrayType(LongType()))
_ENDS_TYPE = (StructType().add("illegal", LongType()).add("cost", LongType())
              .add("ends", ArrayType(ArrayType(LongType()))))
_WALKS_TYPE = ArrayType(StructType().add("edits", StringType()).add("state", IntegerType()))
_STEPS_TYPE = ArrayType(StructType().add("at", IntegerType()).add("edit", StringType()).add("given", StringType()))


@F.arrow_udf(_PART_TYPE)
def _part(codes: pa.Array) -> pa.Array:
    """What a conversation needs to know of each part."""
    out = []
    for c in codes.to_pylist():
        rows = faults_and_initials(c)
        faults, initials = [f for f, _ in rows], [i for _, i in rows]
        out.append({"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
                    "illegal": sum(map(_illegal, initials, initials[1:])),
                    "head": initials[0], "tail": initials[-1], "costs": transfer(c)})
    return pa.array(out, _PART)


@F.arrow_udf(_ENDS_TYPE)
def _ends(parts: pa.Array) -> pa.Array:
    """A conversation's adjacent rows across parts, its cost, and the cost vector behind each part."""
    out = []
    for p in parts.to_pylist():
        v, ends = list(END), []
        for x in reversed(p):
            ends.append(v)
            costs = x["info"]["costs"]
            v = [min(costs[4 * q + r] + v[r] for r in range(4)) for q in range(4)]
        across = sum(_illegal(x["info"]["tail"], y["info"]["head"]) for x, y in zip(p, p[1:]))
        out.append({"illegal": across, "cost": v[0], "ends": ends[::-1]})
    return pa.array(out, pa.struct([("illegal", pa.int64()), ("cost", pa.int64()),
                                    ("ends", pa.list_(pa.list_(pa.int64())))]))


@F.arrow_udf(_WALKS_TYPE)
def _walks(codes: pa.Array, end: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """A part's edits and end state for each state in which it may be entered."""
    out = [[dict(zip(("edits", "state"), walk(c, q, tuple(v), z))) for q in range(1 if a else 4)]
           for c, v, a, z in zip(*(x.to_pylist() for x in (codes, end, first, last)))]
    return pa.array(out, pa.list_(pa.struct([("edits", pa.string()), ("state", pa.int32())])))


@F.arrow_udf(ArrayType(IntegerType()))
def _entered(states: pa.Array) -> pa.Array:
    """The state in which each of a conversation's parts is entered."""
    out = []
    for parts in states.to_pylist():
        q, seen = 0, []
        for x in parts:
            seen.append(q)
            q = x["states"][q]
        out.append(seen)
    return pa.array(out, pa.list_(pa.int32()))


@F.arrow_udf(_STEPS_TYPE)
def _steps(codes: pa.Array, edits: pa.Array, state: pa.Array) -> pa.Array:
    return pa.array(list(map(steps, *(x.to_pylist() for x in (codes, edits, state)))),
                    pa.list_(pa.struct([("at", pa.int32()), ("edit", pa.string()), ("given", pa.string())])))


def _initial(role: Column) -> Column:
    return (F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3))


def _in_order(df: DataFrame) -> DataFrame:
    """conv, turn, role, text and ``id``, which ascends with (conv, turn, role, text's MD5).

    The last sort key splits rows that are alike in all others; the files fix the numbers.
    """
    rows = df.select(col(df, "conv_id").alias("conv"), col(df, "turn").alias("turn"),
                     F.coalesce(col(df, "role"), F.lit(" ")).alias("role"),
                     F.coalesce(col(df, "text"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("tie", F.md5("text")).withColumn("copy", F.monotonically_increasing_id())
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie"), F.asc("copy")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("id"))
    return stage(rows, "repair-rows")


def _coded(rows: DataFrame) -> DataFrame:
    """conv, id, code of every row."""
    texts = F.sha2(F.col("text").cast("binary"), 256)
    firsts = rows.groupBy("conv", "role", texts).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    white = F.lit(" \t\n\x0b\x0c\r")
    fault = (F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK)
             .when(F.col("first").isNull(), DUPLICATE)
             .when(~F.right(F.rtrim("text", white), F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND))
    code = F.char(F.lit(ord("a")) + 4 * fault + _initial(F.col("role")))
    return rows.join(firsts, "id", "left").select("conv", "id", code.alias("code"))


def _parts(rows: DataFrame) -> DataFrame:
    """conv, part, low (its first row's number), codes, info; at most ``SPAN`` rows each."""
    part = F.floor(F.col("id") / SPAN)
    codes = F.sort_array(F.collect_list(F.struct("id", "code")))
    parts = _coded(rows).groupBy("conv", part.alias("part")).agg(codes.alias("rows"))
    parts = parts.select("conv", "part", F.col("rows")[0]["id"].alias("low"),
                         F.array_join(F.col("rows.code"), "").alias("codes"))
    return stage(parts.withColumn("info", _part("codes")), "repair-parts")


def repair(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits of every conversation, and a row about each.

    ``df`` has conv_id, turn, role, text. Edits: conv_id, id and step (their order),
    edit (D, I, K, R), turn, role and text; role and text are those after the edit, a
    deleted row's are its own. Conversations: conv_id, blank, duplicate, truncated,
    illegal, cost, audit.
    """
    rows = _in_order(df)
    parts = _parts(rows)
    listed = F.sort_array(F.collect_list(F.struct("part", "info")))
    count = [F.sum(f"info.{c}").alias(c) for c in _COUNTS]
    convs = stage(parts.groupBy("conv").agg(listed.alias("parts"), *count).withColumn("whole", _ends("parts")),
                  "repair-conversations")

    each = convs.select(F.col("conv").alias("c"), F.posexplode(F.arrays_zip(
        F.col("parts.part").alias("part"), F.col("whole.ends").alias("end"))).alias("k", "x"),
        F.size("parts").alias("n"))
    each = each.select("c", F.col("x.part").alias("p"), F.col("x.end").alias("end"), (F.col("k") == 0).alias("first"),
                       (F.col("k") == F.col("n") - 1).alias("last"))
    walked = parts.join(each, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    walked = stage(walked.select("conv", "part", "low", "codes", "first",
                                 _walks("codes", "end", "first", "last").alias("walks")), "repair-walks")

    chain = F.sort_array(F.collect_list(F.struct("part", F.col("walks.state").alias("states"))))
    chain = walked.groupBy("conv").agg(chain.alias("parts")).withColumn("entered", _entered("parts"))
    chain = chain.select(F.col("conv").alias("c"), F.explode(F.arrays_zip(
        F.col("parts.part").alias("p"), F.col("entered").alias("q"))).alias("x")).select("c", "x.p", "x.q")
    done = walked.join(chain, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    done = done.select("conv", "part", "low", "codes", "q", F.col("walks")[F.col("q")]["edits"].alias("edits"))
    done = stage(done, "repair-edits")

    one = done.select("conv", "low", F.posexplode(_steps("codes", "edits", "q")).alias("step", "x"))
    one = one.select("conv", (F.col("low") + F.col("x.at")).alias("id"), "step", F.col("x.edit").alias("edit"),
                     F.col("x.given").alias("given"))
    about = rows.select(F.col("id").alias("about"), "turn", "role", "text")
    edits = one.join(about, (F.col("id") == F.col("about")) & (F.col("edit") != "I"), "left").select(
        F.col("conv").alias("conv_id"), "id", "step", "edit", "turn", F.coalesce("given", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))

    audit = F.array_join(F.sort_array(F.collect_list(F.struct("part", "edits")))["edits"], "")
    audits = done.groupBy("conv").agg(audit.alias("audit")).withColumnRenamed("conv", "c")
    about = convs.join(audits, F.col("conv").eqNullSafe(F.col("c"))).select(
        F.col("conv").alias("conv_id"), "blank", "duplicate", "truncated",
        (F.col("illegal") + F.col("whole.illegal")).alias("illegal"), F.col("whole.cost").alias("cost"), "audit")
    return edits, about


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, line rows, sorted, to a digest a conversation; a batch is in memory at a time."""
    now, sha = None, None

    def done():
        return pa.record_batch([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])],
                               names=["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1)):
            if sha is None or conv != now:
                if sha is not None:
                    yield done()
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(line.as_buffer())
    if sha is not None:
        yield done()


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of the repaired rows as role:text, joined by newlines.

    The digest of one string is sequential, so a conversation's lines stream through one task.
    """
    lines = edits.where("edit <> 'D'").select(F.col("conv_id").cast("long").alias("conv_id"), "id", "step",
                                              F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "id", "step")
    return lines.select("conv_id", "line").mapInArrow(_hash, "conv_id long, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """The contract's faults, by the CRC of conv_id:turn (nulls: one space)."""
    role, text = (F.coalesce(col(df, c), F.lit(" ")) for c in ("role", "text"))
    name = F.concat_ws(":", *[F.coalesce(col(df, c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = df.select(col(df, "conv_id").alias("conv_id"), col(df, "turn").alias("turn"), role.alias("role"),
                     text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("kind")).where("kind <> 0")
    kind = F.col("kind")
    rows = rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
                       .otherwise(F.col("text")).alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def report(df: DataFrame) -> DataFrame:
    """A row per conversation of ``df`` about its rows after damage and their repair."""
    hurt = damage(df)
    edits, about = repair(hurt)
    turns = hurt.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = df.select(col(df, "conv_id").alias("conv_id")).distinct()
    for i, part in enumerate((turns, about, digests(edits))):
        out = out.join(part.withColumnRenamed("conv_id", f"c{i}"), F.col("conv_id").eqNullSafe(F.col(f"c{i}")), "left")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: faults, cheapest edits and repaired text of every conversation."""
    return report(load(spark, sf_dir, "conversations"))


def _oracle() -> str:
    """The contract in DuckDB: CRCs from a table made by its rule, then the best list of edits per
    state, row by row, in a recursive query. A state is the struct (cost, audit, lines)."""
    def best(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def then(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
        lines = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
        return (f"{{'c': CASE WHEN {when} THEN {state}.c + {cost} ELSE 1000000000 END, "
                f"'a': {state}.a || '{letter}', 't': {lines}}}")

    def insert(state: str, role: str) -> str:
        return then(state, "3", "I", f"'{role}:'")

    def delete(state: str) -> str:
        return then(state, "4", "D", None)

    keep = "role || ':' || text"

    def kept(state: str, initial: str) -> str:
        return then(state, "cut", "K", keep, f"NOT must AND initial = '{initial}'")

    def rerole(state: str, role: str) -> str:
        return then(state, "3 + cut", "R", f"'{role}:' || text", "NOT must")

    def inserted(source: str) -> str:
        return f"""SELECT * EXCLUDE (u1), u1 AS w2, {best("q3", insert("u1", "assistant"))} AS w3
    FROM (SELECT *, {best("q2", *[insert(q, "user") for q in ("q0", "q1", "q3")])} AS u1 FROM {source})"""

    after_u = [f(q, *x) for q in ("q0", "q1", "w3") for f, x in ((kept, "u"), (rerole, ("user",)))]
    return rf"""
WITH RECURSIVE steps AS (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i)
), crcs AS (
    SELECT list(c ORDER BY i) AS crc FROM steps
), named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), dealt AS (
    SELECT * EXCLUDE (name, crc), xor(4294967295::BIGINT, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(range(1, len(name) + 1), lambda k: ascii(name[k])::BIGINT)),
        lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) % 20 AS kind
    FROM named, crcs
), hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM dealt WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM hurt
), told AS (
    SELECT *, role[1] AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
           NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open,
           lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS former
    FROM placed
), marked AS (
    SELECT *, blank OR again AS must, CASE WHEN NOT blank AND NOT again AND open THEN 3 ELSE 0 END AS cut FROM told
), walked AS (
    SELECT conv_id AS conv, 0::BIGINT AS done_rows, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS q0,
           {{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}} AS q1, {{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}} AS q2,
           {{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}} AS q3
    FROM (SELECT DISTINCT conv_id FROM marked)
    UNION ALL
    SELECT conv, done_rows + 1, {delete("q0")}, {best(delete("q1"), kept("q0", "s"))},
           {best(delete("w2"), *after_u)}, {best(delete("w3"), kept("w2", "a"), rerole("w2", "assistant"))}
    FROM ({inserted("walked")}) JOIN marked ON conv IS NOT DISTINCT FROM conv_id AND pos = done_rows + 1
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
           count(*) FILTER (cut > 0) AS truncated, max(pos) AS n,
           count(*) FILTER (pos > 1 AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM marked GROUP BY conv_id
), done AS (
    SELECT f.*, {best("w.q0", "w.w3")} AS best
    FROM facts f JOIN ({inserted("walked")}) w ON w.conv IS NOT DISTINCT FROM f.conv_id AND w.done_rows = f.n
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE = _oracle()
