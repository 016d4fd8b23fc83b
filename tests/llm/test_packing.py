"""Packing: every id in one piece, gapless windows, little padding, odd inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchmart.llm import packing

from .helpers import SMALL, docs_frame, table


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(*packing.tokenizer_paths())


def _check(pieces, texts, encoder, window=packing.WINDOW):
    """texts: (doc_id, text) rows with distinct ids."""
    whole = {i: ids + [packing.END_ID] for (i, _), ids in zip(texts, (
        e.ids for e in encoder.tokenizer.encode_batch([t or "" for _, t in texts], add_special_tokens=False)))}
    for doc, p in pieces.groupby("doc_id"):
        p = p.sort_values("start")
        ids = np.array(whole.pop(doc), "<u4")
        assert p.doc_tokens.eq(len(ids)).all()
        assert (p.start + p.length).tolist() == p.start.tolist()[1:] + [len(ids)] and p.start.iat[0] == 0
        for s, n, crc in zip(p.start, p.length, p.ids_crc32):
            assert zlib.crc32(ids[s:s + n].tobytes()) == crc
    assert not whole
    for _, p in pieces.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert (p.offset + p.length).tolist() == p.offset.tolist()[1:] + [p.length.sum()]
        assert p.offset.iat[0] == 0 and p.length.sum() <= window


def test_query_places_every_id_once(spark, encoder):
    texts = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    pieces = packing.query(spark, SMALL).toPandas()
    _check(pieces, texts, encoder)
    used = pieces.length.sum()
    assert pieces.sequence_id.nunique() * packing.WINDOW < 1.02 * used + packing.WINDOW


def test_odd_rows(spark, encoder):
    texts = [(1, None), (2, ""), (3, " "), (4, "a  b \n c"), (5, "word " * 9000), (6, "x" * 40000), (7, "a<|endoftext|> b")]
    pieces = packing.pack(docs_frame(spark, texts)).toPandas()
    _check(pieces, texts, encoder)
    again = packing.pack(docs_frame(spark, texts)).toPandas()
    key = ["doc_id", "start"]
    assert again.sort_values(key, ignore_index=True).equals(pieces.sort_values(key, ignore_index=True))


def test_repeated_rows_and_null_ids(spark):
    pieces = packing.pack(docs_frame(spark, [(7, "same text"), (7, "same text"), (None, "same text")])).toPandas()
    assert len(pieces) == 3
    assert len(set(zip(pieces.sequence_id, pieces.offset))) == 3


def test_empty_table(spark):
    assert packing.pack(docs_frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\x0b\x1c\x85\xa0 ab.,'s1é", max_size=30), min_size=1, max_size=8))
def test_word_by_word_ids_are_the_tokenizers(encoder, texts):
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(50, 80))
def test_windows_hold_at_most_their_capacity(sizes, capacity):
    sizes = np.array(sizes)
    window = packing.pack_sizes(sizes, capacity)
    assert np.bincount(window, sizes).max() <= capacity


def test_differencing_by_hand():
    # The classic example: 8, 7, 6, 5, 4 in two sums differ by 2.
    window = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(window, [8, 7, 6, 5, 4])) == [14, 16]


def test_slices_cover_all_texts_and_hold_bounded_bytes():
    import pyarrow as pa

    from matchmart.llm.common import byte_slices
    texts = pa.array(["a" * n for n in (0, 5, 3, 40, 0, 0, 9, 1, 1)])
    got = byte_slices(texts, 10)
    assert [k for a, b in got for k in range(a, b)] == list(range(len(texts)))
    assert got == [(0, 4), (4, 7), (7, 9)]
    assert byte_slices(texts[:0], 10) == [] and byte_slices(texts.slice(3, 2), 10) == [(0, 1), (1, 2)]


def test_columns_with_clashing_names_and_long_texts(spark, monkeypatch):
    from pyspark.sql import functions as F
    df = docs_frame(spark, [(1, "word " * 30_000), (2, None), (2, None), (3, "x")])
    plain = sorted(map(tuple, packing.pack(df).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))
    for name in ("uid", "bucket", "start", "length", "sequence_id", "offset", "window"):
        df = df.withColumn(name, F.lit("x"))
    got = packing.pack(df)
    assert sorted(map(tuple, got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) == plain
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.WINDOW).count() == 0
