"""Document fingerprints by consistent weighted sampling.

A text is a bag of words (lower-cased, split at white space) weighted by their
counts. For each of ``K`` samples every word draws r, c ~ Gamma(2, 1) and
b ~ U(0, 1) from a hash of the word and the sample's number; with weight w it
stands at t = floor(ln w / r + b), ln y = r (t - b), and the word with the least
ln c - ln y - r is the sample, together with its t. Two texts agree in a sample
with a probability that equals their generalised Jaccard similarity,
sum(min) / sum(max). A fingerprint keeps one byte of a hash of each (word, t);
likeness is the share of equal bytes less chance agreement.

``neighbours`` also fingerprints each text with its last half replaced by the
start of the next document in descending id order. One range partitioning and
sort brings neighbours together and is the only shuffle of texts; a partition
streams through in batches and pairs each row with the one after it. A
partition's last row needs the first row of the next partition: partitions hand
over these two rows each, which are joined on the partition numbers afterwards.

Defined cases: null text is empty; a text without words has an empty
fingerprint, which is like another empty one (1) and unlike all others (0);
null ids come last, equal ids are ordered by a hash of the text; a single row
is its own next document; an empty table gives an empty table; further columns
are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, load, stage, text_of

#: samples in a fingerprint, one byte each
K = 128
#: texts that share their words' draws, words drawn at a time
SLICE, WORDS = 2048, 1024
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _uniforms(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from each 64-bit hash."""
    scale = np.float32(2.0**-24)
    half = np.float32(0.5)
    return (((h >> np.uint64(40)).astype(np.float32) + half) * scale,
            (((h >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) + half) * scale)


def draws(words: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln a, t) of words, given by 64-bit hashes, with their weights: two n x K arrays."""
    key = words[:, None] ^ (np.arange(1, 3 * K + 1, dtype=np.uint64) * _GOLD)
    h = _mix(key)
    u1, u2 = _uniforms(h[:, :K])
    r = -np.log(u1 * u2)
    u3, u4 = _uniforms(h[:, K:2 * K])
    b, _ = _uniforms(h[:, 2 * K:])
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    return np.log(-np.log(u3 * u4)) - r * (t - b) - r, t.astype(np.int32)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, count) of each text's distinct words, ordered by text; the words' hashes."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = pc.dictionary_encode(lists.flatten())
    distinct = coded.dictionary.to_pylist()
    owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    code = coded.indices.to_numpy()
    if "" in distinct:
        real = code != distinct.index("")
        owner, code = owner[real], code[real]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    pairs, count = np.unique(owner * max(1, len(distinct)) + code, return_counts=True)
    return pairs // max(1, len(distinct)), pairs % max(1, len(distinct)), count, hashes


def fingerprints(texts: pa.Array) -> np.ndarray:
    """One row of K bytes for each text, and whether it has words as a last column."""
    out = np.zeros((len(texts), K + 1), np.uint8)
    owner, word, count, hashes = bags(texts)
    if not len(owner):
        return out
    # Each (word, count) draws once for all texts of the slice.
    most = int(count.max()) + 1
    kind, at = np.unique(word * most + count, return_inverse=True)
    drawn, weight = hashes[kind // most], kind % most
    ln_a, t = np.empty((len(kind), K), np.float32), np.empty((len(kind), K), np.int32)
    for k in range(0, len(kind), WORDS):
        ln_a[k:k + WORDS], t[k:k + WORDS] = draws(drawn[k:k + WORDS], weight[k:k + WORDS])
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    sample = np.arange(K)
    for i, lo, hi in zip(owner[begin], begin, [*begin[1:], len(owner)]):
        best, row = None, None
        for k in range(lo, hi, WORDS):  # long texts in blocks
            rows = at[k:min(k + WORDS, hi)]
            nth = ln_a[rows].argmin(axis=0)
            low = ln_a[rows[nth], sample]
            best, row = (low, rows[nth]) if best is None else (
                np.minimum(best, low), np.where(low < best, rows[nth], row))
        chosen = drawn[row] + t[row, sample].astype(np.int64).view(np.uint64) * _GOLD
        out[i, :K] = (_mix(chosen) >> np.uint64(56)).astype(np.uint8)
        out[i, K] = 1
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of fingerprints, 0 to 1."""
    same = (x[:, :K] == y[:, :K]).mean(axis=1)
    found = np.clip((same - 2.0**-8) / (1 - 2.0**-8), 0, 1)
    return np.where((x[:, K] == 1) & (y[:, K] == 1), found, (x[:, K] == y[:, K]).astype(float))


def _bytes(prints: np.ndarray) -> list[bytes]:
    return [p[:K].tobytes() if p[K] else b"" for p in prints]


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_ROW = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, "
        "edited_fingerprint binary, near_edited double, near_next double")
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]


def _rows(ids: pa.Array, texts: list[str], after: list[str]) -> pa.RecordBatch:
    """Result rows of texts and the ones after them."""
    new = [edited(t, n) for t, n in zip(texts, after)]
    # Neighbours mostly are in the slice already: the text after row i is row i + 1.
    chain = all(n is t for n, t in zip(after, texts[1:]))
    own = pa.array([*texts, after[-1]] if chain else [*texts, *after], pa.string())
    prints = fingerprints(pa.concat_arrays([own, pa.array(new, pa.string())]))
    n = len(texts)
    mine, changed = prints[:n], prints[len(own):]
    following = prints[1:n + 1] if chain else prints[n:2 * n]
    return pa.record_batch([
        ids, pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
        pa.array(_bytes(mine), pa.binary()), pa.array(_bytes(changed), pa.binary()),
        pa.array(likeness(mine, changed)), pa.array(likeness(mine, following))], names=_COLUMNS)


_EDGE = f"{_ROW}, part int, first_text string, last_id long, last_text string"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's rows but the last, then its first and last rows' texts."""
    part, first, ids, texts = TaskContext.get().partitionId(), None, [], []

    def done(found: pa.RecordBatch) -> pa.RecordBatch:
        n = found.num_rows
        return pa.record_batch([*found.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()),
                                pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())],
                               names=[*_COLUMNS, "part", "first_text", "last_id", "last_text"])

    for batch in batches:
        for k in range(0, len(batch), SLICE):
            ids += batch.column(0).slice(k, SLICE).to_pylist()
            texts += batch.column(1).slice(k, SLICE).to_pylist()
            first = texts[0] if first is None else first
            if len(texts) > 1:
                yield done(_rows(pa.array(ids[:-1], pa.int64()), texts[:-1], texts[1:]))
                ids, texts = ids[-1:], texts[-1:]
    if texts:
        none = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()),
                pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()),
                pa.nulls(1, pa.float64())]
        yield pa.record_batch([*none, pa.array([part], pa.int32()), pa.array([first]),
                               pa.array(ids, pa.int64()), pa.array(texts)],
                              names=[*_COLUMNS, "part", "first_text", "last_id", "last_text"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            yield _rows(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, its edited text's, and both likenesses."""
    spark = docs.sparkSession
    rows = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = stage(ordered.mapInArrow(_stream, _EDGE), "cws-rows")
    edges = found.where("part IS NOT NULL").select("part", "first_text", "last_id", "last_text")
    # One number per partition that has rows: which one follows which, the first after the last.
    parts = sorted(r.part for r in edges.select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    pairs = edges.join(follows, "part").join(
        edges.select(F.col("part").alias("next"), F.col("first_text").alias("after")), "next")
    last = pairs.select("last_id", "last_text", "after").mapInArrow(_across, _ROW)
    return found.where("part IS NULL").select(*_COLUMNS).unionByName(last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprints of every text and its edited text, and their likenesses."""
    found = neighbours(load(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
