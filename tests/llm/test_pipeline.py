"""The corpus pipeline, stage by stage against plain versions, and its place in the registry."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchmart.llm import mixing, toxicity

from .helpers import SMALL, docs_frame, table
from .test_minhash import brute


def test_stages_one_after_the_other(spark):
    docs = table(spark, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mix sources", "pack"]
    steps = dict(corpus_pipeline.STAGES)

    net = toxicity.fit(docs, table(spark, "labels"))
    score = {r.doc_id: r.score for r in toxicity.scores(docs, net).collect()}
    clean = steps["toxicity"](spark, docs, SMALL).cache()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, s in score.items() if s < 0.3}

    single = steps["exact dedup"](spark, clean, SMALL).cache()
    best = {}
    for i in sorted(r.doc_id for r in clean.collect()):
        key = re.sub(r"[\x20\x09-\x0D]", "", text[i])
        if key not in best or len(text[i]) > len(text[best[key]]):
            best[key] = i
    assert sorted(r.doc_id for r in single.collect()) == sorted(best.values())

    apart = steps["near dedup"](spark, single, SMALL).cache()
    found = brute([(i, text[i]) for i in best.values()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, (_, c) in found.items() if c == i)

    mixed = steps["mix sources"](spark, apart, SMALL).cache()
    want = {r.doc_id: r.copies for r in mixing.mix_counts(apart).collect()}
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == {i: n for i, n in want.items() if n}

    pieces = steps["pack"](spark, mixed, SMALL).toPandas()
    starts = Counter(pieces[pieces.start == 0].doc_id)
    assert starts == {i: n for i, n in want.items() if n}
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_near_stage_keeps_documents_with_null_and_repeated_ids(spark):
    docs = docs_frame(spark, [(None, "one text without an id"), (None, "quite another text"), (8, "a third text of words"),
                              (8, "a fourth that shares the id"), (9, "A Third text of words"), (None, "")])
    step = dict(corpus_pipeline.STAGES)["near dedup"]
    assert sorted(r.text for r in step(spark, docs, SMALL).collect()) == [
        "", "a fourth that shares the id", "a third text of words", "one text without an id", "quite another text"]


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and {int(m[1]) for q in names if (m := re.match(r"op(\d+)_", q))} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("case", ["empty", "null texts", "clashing columns"])
def test_all_stages_on_odd_tables(spark, tmp_path, case):
    rows = [(1, "a short text of some words here"), (2, "a short  text of some words here"), (3, "x " * 3000), (None, "no id"),
            (4, ""), (5, None)]
    docs = docs_frame(spark, rows)
    if case == "empty":
        docs = docs.limit(0)
    elif case == "null texts":
        docs = docs.withColumn("text", F.lit(None).cast("string"))
    else:
        for name in ("score", "node", "part", "uid", "bucket", "row", "best", "digest", "copies", "start", "length"):
            docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    first = pieces[pieces.start == 0]
    if case == "empty":
        assert len(pieces) == 0
    elif case == "null texts":  # one of six equal texts stays; it has no words, so the mix has no size to share
        assert len(first) <= 1
    else:
        assert set(first.doc_id.dropna()) <= {1, 2, 3, 4, 5} and 2 in set(first.doc_id) and 1 not in set(first.doc_id)
        assert pieces.groupby("sequence_id").length.sum().max() <= 2048
