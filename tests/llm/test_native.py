"""The native operators: DuckDB or plain Python beside Spark, odd rows, SQL only."""

import json
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchmart.llm import chat, exact_dedup, mixing, registry, secrets

from .helpers import SMALL, docs_frame, same_as_sql, table

ODD = [(1, None), (2, ""), (3, " \t\x0b\n"), (4, "a b\tc"), (5, "ab c"), (6, "abc"), (7, "  a b c "), (8, "w " * 40_000),
       (9, None, "en", None), (10, "x", None, "t"), (None, "abc"), (4, "a b\tc")]


def _pandas(rows):
    return pd.DataFrame([(r[0], r[1], (*r, "en", "s")[2] if len(r) < 3 else r[2], r[3] if len(r) > 3 else "s", None)
                         for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_queries_against_duckdb(spark, name):
    same_as_sql(registry.QUERIES[name](spark, SMALL), registry.ORACLE[name])


def test_native_plans_run_no_python(spark):
    for name in ("op5_exact_dedup", "op8_chat_format", "op9_secret_scan", "op10_mix_sources"):
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_dedup_odd_rows(spark):
    docs = docs_frame(spark, ODD)
    index = exact_dedup.scratch_index(spark, 3)
    got = exact_dedup.dedup_groups(docs, index, "b").select(
        "doc_id", "keep_id", "group_size", F_kept(), "digest").withColumnRenamed("digest", "text_sha256")
    same_as_sql(got, exact_dedup.ORACLE, documents=_pandas(ODD))
    kept = exact_dedup.survivors(docs.selectExpr("*", "doc_id AS stay_id", "text AS digest"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [
        (3, " \t\x0b\n"), (7, "  a b c "), (8, "w " * 40_000), (10, "x")]
    assert kept.columns[-2:] == ["stay_id", "digest"]
    assert exact_dedup.dedup_groups(docs_frame(spark, []), index, "c").count() == 0


def F_kept():
    from pyspark.sql import functions as F
    return F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")


def test_the_index_lasts_and_takes_a_batch_once(spark):
    index = exact_dedup.scratch_index(spark, 4)
    day1, day2 = docs_frame(spark, [(1, "a b"), (2, "c")]), docs_frame(spark, [(3, "ab"), (4, "d"), (5, "d ")])
    assert sorted(r.doc_id for r in exact_dedup.survivors(day1, index, "1").collect()) == [1, 2]
    again = exact_dedup.DigestIndex(spark, index.path)
    assert again.buckets == 4
    for _ in range(2):  # a retried batch changes nothing
        assert sorted(r.doc_id for r in exact_dedup.survivors(day2, again, "2").collect()) == [5]
        assert again.rows().count() == 3
    groups = {r.doc_id: r.keep_id for r in exact_dedup.dedup_groups(day2, again, "2").collect()}
    assert groups == {3: 1, 4: 5, 5: 5}
    assert again.compact(f"{index.path}-compact").rows().count() == 3


def test_mixing_odd_rows(spark):
    m = mixing.mix_counts(docs_frame(spark, ODD))
    got = m.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")
    same_as_sql(got, mixing.ORACLE, documents=_pandas(ODD))
    assert mixing.mix_counts(docs_frame(spark, [])).count() == 0


def _fill(sizes, weights):
    """Targets by the rule as it is told: share, cap, share the excess again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        for i in open_:
            target[i] = rest * weights[i] / w
        over = {i for i in open_ if target[i] > 3 * sizes[i]}
        if not over:
            return target
        for i in over:
            target[i] = 3.0 * sizes[i]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [[1000, 1, 1, 1, 50, 2], [5], [0, 7], [3, 3, 3, 3], [1, 900, 2, 800, 3]])
def test_targets_by_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = _fill(sizes, [1 + i % 3 for i in range(len(sizes))])
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = [(i, "word " * 50, "en", "big") for i in range(300)] + [(1000 + i, "word " * 50, "en", "small") for i in range(20)]
    docs = docs_frame(spark, rows).selectExpr("*", "1 AS copies", "2 AS of_source")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    small = sum(v for k, v in n.items() if k >= 1000)
    assert max(n.values()) <= 3 and small == 60  # capped at three times
    assert sum(n.values()) == pytest.approx(320, rel=0.1)


def _plain_spans(text):
    """Base spans by Python's re, every letter of the names in either case."""
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    pattern = rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


SECRETS = [(1, None), (2, ""), (3, "é𝄞 PassWord : 'abc.def' token=short secret=secret=x1y2z3"), (4, "AKIA" * 3 + "ABCDEFGH12345678"),
           (5, "f" * 24 + "g" + "0" * 23), (6, "api_key=a api-key=abcdef APIKEY=abcdefg"), (7, "token token: token: abcdefgh")]


def test_base_spans(spark):
    rows = SECRETS + [(100 + r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: secrets_text(r.base) for r in secrets.scan(docs_frame(spark, rows)).collect()}
    assert got == {i: _plain_spans(t or "") for i, t in rows}


def secrets_text(spans):
    return ",".join(f"{secrets.KINDS[s.kind]}:{s.start}:{s.stop}" for s in spans)


def test_ownership_tells_examples_from_live_ones(spark):
    live, shown = "Zx9" * 3 + "qR7tLm2Kp0aB", "Ab3" * 4 + "cD5eFg6Hi7jK"
    rows = [(i, f"token = {shown}", "en", f"o{i}") for i in range(4)]
    rows += [(10, f"secret: {live}", "en", "me"), (11, f"see {live} there", "en", "me"), (12, f"see {shown} there", "en", "o1")]
    got = {r.doc_id: r for r in secrets.scan(docs_frame(spark, rows)).collect()}
    assert (got[10].n_live, got[0].n_example) == (1, 1)
    assert [(s.start, s.kind, s.stop) for s in got[11].all] == [(4, 3, 4 + len(live))] and got[11].base == []
    assert got[12].all == []


def _plain_scan(rows):
    """Every row's spans by plain Python: (owner, repository, text) rows to rendered base and all spans."""
    base = [[(int(a), secrets.KINDS.index(k), int(b)) for k, a, b in
             (x.split(":") for x in _plain_spans(t or "").split(",") if x)] for _, _, t in rows]
    held, wide = {}, []
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    for (owner, repo, text), spans in zip(rows, base):
        text, own = text or "", []
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(
                    a < m.end() and m.start() < b for a, _, b in spans):
                own.append((m.start(), 3, m.end(), m[0]))
        values = [v for *_, v in own]
        for a, k, b in spans:
            hit = text[a:b]
            values.append(re.match(rf"""(?:{either})["']?\x20*[:=]\x20*["']?(.*)""", hit)[1] if k == 0 else hit)
        for v in values:
            held.setdefault(v, set()).add((owner or "", repo or ""))
        wide.append(own)

    def live(v):
        return (len({o for o, _ in held[v]}) == 1 and len(held[v]) < secrets.EXAMPLE_REPOS
                and len(set(v)) >= secrets.LIVE_CHARS and re.search("[0-9]", v))

    names = [*secrets.KINDS, "owned"]
    return [(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans)),
             ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans + [w[:3] for w in own if live(w[3])])))
            for spans, own in zip(base, wide)]


def test_added_spans_on_a_planted_table(spark):
    rng = random.Random(8)
    values = ["".join(rng.choices("ABCdef0123456789xyzQ", k=rng.randint(18, 40))) for _ in range(30)]
    values += ["aaaa1111aaaa1111aaaa1111", "0123456789abcdef" * 2, "AKIA" + "Q7X2" * 5]
    words = ["see", "token = ", "secret:", ",", "é", " ", "\n", '"', "x1"]
    rows = []
    for i in range(300):
        parts = [rng.choice(words) if rng.random() < 0.7 else " " + rng.choice(values) + rng.choice([" ", "", "."])
                 for _ in range(rng.randint(0, 30))]
        v = rng.choice(values)
        rows.append((i % 40, rng.choice(["".join(parts), f"bare {v} here", None]),
                     rng.choice(["r1", "r2", None]), rng.choice([f"own{values.index(v)}", "me", None])))
    rows += [(900 + k, "one owner's template Tp4" + "kQ9zLm2Xw7" * 2, f"repo{k}", "solo") for k in range(4)]
    df = docs_frame(spark, rows)
    want = _plain_scan([(source, lang, text) for _, text, lang, source in rows])
    assert sum(a != b for a, b in want) > 20 and all(a == b == "" for a, b in want[-4:])
    for name in ("base", "wide", "row", "hash", "owner", "repo", "class", "live", "all"):
        df = df.withColumn(name, F.lit("x"))
    out = secrets.scan(df).select("doc_id", secrets.render(F.col("base")).alias("b"), secrets.render(F.col("all")).alias("a"))
    assert sorted((r.doc_id, r.b, r.a) for r in out.collect()) == sorted((r[0], *w) for r, w in zip(rows, want))


def test_secrets_odd_tables(spark):
    assert secrets.scan(docs_frame(spark, SECRETS).limit(0)).count() == 0
    twice = [(None, "secret: Zx9Zx9qR7tLm2Kp0aB", None, None)] * 3
    assert {(r.doc_id, secrets_text(r.base), r.n_live) for r in secrets.scan(docs_frame(spark, twice)).collect()} == {
        (None, "assign:0:26", 1)}


def test_many_matches_in_one_text_are_placed_in_about_linear_time(spark):
    text = " ".join(f"{i:032x}" for i in range(20_000))
    secrets.scan(docs_frame(spark, [(1, "warm " + "0" * 40)])).collect()
    start = time.perf_counter()
    r = secrets.scan(docs_frame(spark, [(1, text)])).first()
    assert time.perf_counter() - start < 10
    assert [(s.start, s.stop) for s in r.base] == [(33 * i, 33 * i + 32) for i in range(20_000)]


def test_chat_whole_table(spark):
    turns = [(str(r.conv_id), r.turn, r.role, r.text) for r in table(spark, "conversations").collect()]
    got = {(r.conv_id, r.turn): r for r in chat.query(spark, SMALL).collect()}
    assert len(got) == len(turns)
    at = {(c, t): role for c, t, role, _ in turns}
    for c, t, role, text in turns:
        r, body = got[c, t], json.loads(got[c, t].json)
        assert r.json == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if role == "user":
            assert r.status == ("linked" if at.get((c, t + 1)) == "assistant" else "open") and r.errors == ""
            assert body["arguments"] == {"prompt": text, "turn": t}
        elif role == "assistant":
            assert r.status == ("linked" if at.get((c, t - 1)) == "user" else "orphan") and body["content"] == text
        depth = t - max((k for k in range(t) if (c, k) not in at), default=-1) - 1
        plain = role not in ("user", "assistant") or (role == "assistant" and at.get((c, t - 1)) != "user")
        assert plain or r.depth <= depth


def test_chat_calls_results_and_schemas(spark):
    rows = [("a", 0, "user", '{"tool_call":{"id":"x","name":"f","arguments":{"z":1,"b":{"y":2,"a":"é"}}}}'),
            ("a", 1, "tool", '{"tool_result":{"id":"x","content":"ok"}}'), ("a", 2, "assistant", "plain"), ("a", 3, None, None),
            ("a", 4, "user", '{"tool_call":{"id":"x","name":"g","arguments":[1]}}')]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = {r.turn: r for r in chat.link(chat.read_turns(turns), {"f": {"z": ("string", True), "d": ("object", True)}}).collect()}
    assert [got[k].status for k in range(5)] == ["linked", "linked", "orphan", "plain", "duplicate"]
    assert got[0].errors == "b: unknown; d: missing; z: not string" and got[4].errors == "unknown tool: g"
    assert json.loads(got[0].json)["arguments"] == {"b": {"a": "é", "y": 2}, "z": 1}
    assert chat.link(chat.read_turns(turns.limit(0)), chat.REPLY).count() == 0


def test_depths_of_chains_trees_and_cycles(spark):
    edges = [(k, k - 1) for k in range(1, 70)] + [(0, None), (100, 5), (101, 5), (200, 201), (201, 200), (202, 200), (300, 999)]
    got = {r.node: r.depth for r in chat.depths(spark.createDataFrame(edges, "node long, parent long")).collect()}
    assert [got[k] for k in range(70)] == list(range(70)) and got[100] == got[101] == 6 and got[300] == 0
    assert got[200] is got[201] is got[202] is None




def test_chat_odd_rows(spark):
    """Nulls in every column, repeated rows, empty and very long texts, columns with clashing names."""
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (1, None, "user", "q"), (1, None, "assistant", "a"),
            (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "assistant", None), (2, 1, "assistant", ""),
            (3, 0, None, None), (4, 0, "user", "w " * 300_000), (4, 1, "assistant", "x" * 300_000), (5, 0, "user", "{not json")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = sorted(map(tuple, chat.link(chat.read_turns(turns), chat.REPLY).collect()), key=repr)
    got = {}
    for r in want:
        got.setdefault((r[0], r[1], r[2]), []).append((r[5], r[6]))
    assert got[None, 0, "user"] == [("open", 0)] and got[None, 1, "assistant"] == [("orphan", 0)]
    assert got["1", None, "user"] == [("open", 0)] and got["1", None, "assistant"] == [("orphan", 0)]
    assert sorted(s for s, _ in got["2", 0, "user"]) == ["duplicate", "linked"]
    assert got["2", 1, "assistant"] == [("linked", 1)] * 2 and got["3", 0, None] == [("plain", 0)]
    assert got["4", 1, "assistant"] == [("linked", 1)] and got["5", 0, "user"] == [("open", 0)]
    for name in ("kind", "call_id", "node", "status", "said", "parent", "depth", "after", "errors", "json"):
        turns = turns.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, chat.link(chat.read_turns(turns), chat.REPLY).collect()), key=repr) == want


def test_depths_equal_a_plain_walk(spark):
    rng = random.Random(3)
    parents = {k: rng.choice([None, *range(k)]) if k else None for k in range(150)}

    def walk(k):
        return 0 if parents[k] is None else 1 + walk(parents[k])

    got = {r.node: r.depth for r in chat.depths(spark.createDataFrame(list(parents.items()), "node long, parent long")).collect()}
    assert got == {k: walk(k) for k in parents}
