"""Near-duplicate documents by SimHash, fingerprints matched through the Golay code.

Words are lower-cased (A-Z) runs without white space; a document's features are
its three-word shingles, repeats included (the whole sequence if it has fewer
words). A fingerprint bit is 1 if it is set in over half of the shingles' XXH64
values (UTF-8, seed 42). Fingerprints that differ in two bits or fewer are linked,
groups are the connected components.

1. One pass gives each document its fingerprint; documents with one fingerprint
   form a class, so copies cost nothing afterwards.
2. A fingerprint is cut into segments of 22, 21 and 21 bits. Two differing bits
   leave one of the three segments as it is, and put at most two into any other.
   The perfect (23, 12) Golay code gives the next segment its keys: the codeword
   that a segment decodes to, and those that it decodes to with one bit flipped
   (one or six in all). Segments that differ in two bits have a word between them
   that is one bit from both, so they share a key. A fingerprint thus gets, for
   each segment, the segment itself with the keys of its neighbour.
3. Fingerprints that share a key are joined and verified by their differing bits.
4. A key that more than ``CROWD`` fingerprints share is not joined with itself.
   Its fingerprints are dealt by midpoints instead: each to itself and to the 64
   words one bit away. A midpoint has at most 65 fingerprints, all of them within
   two bits of each other, so a star links them, and any two fingerprints within
   two bits share a midpoint. The work is a constant per fingerprint; no link is lost.
5. Components of the links by alternating min-label rounds, written out each round.

Defined cases: null text, or one without words, has fingerprint zero, which is
linked like any other; rows with equal or null ids keep their rows; ids that are
null are no component's name unless it has no other (then null); an empty table
gives an empty table; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import col, load, stage, text_of, word_blocks
from .minhash import components

WORDS = 3
SEED = 42
#: bits in which linked fingerprints may differ; the segments and keys are made for two
BITS = 2
#: (lowest bit, width) of the segments
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: fingerprints of a key that are compared with each other; more go by midpoints
CROWD = 64
#: a class with more than one in so many documents is joined by broadcast (at most so many classes)
SHARE = 1024
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the Golay code
_GENERATOR = 0b110001110101


def shingle_hashes(data: bytes) -> Iterator[np.ndarray]:
    """XXH64 values of a text's shingles, block by block."""
    xxh64 = xxhash.xxh64_intdigest
    tail: list[bytes] = []
    seen = 0
    for words in word_blocks(data.lower()):
        seen += len(words)
        words = tail + words
        if len(words) >= WORDS:
            ends = list(accumulate(map((1).__add__, map(len, words))))
            starts = [0] + ends[:-WORDS]
            joined = b" ".join(words) + b" "
            yield np.array([xxh64(joined[s:e - 1], SEED) for s, e in zip(starts, ends[WORDS - 1:])], np.uint64)
        tail = words[1 - WORDS:]
    if 0 < seen < WORDS:
        yield np.array([xxh64(b" ".join(tail), SEED)], np.uint64)


def fingerprint(data: bytes) -> int:
    """The text's fingerprint as a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(data):
        for k in range(0, len(h), 1 << 14):
            part = np.ascontiguousarray(h[k:k + (1 << 14)], "<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        n += len(h)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_buffer().to_pybytes()) for t in texts], pa.int64())


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of 23-bit words by the generator polynomial."""
    for k in range(22, 10, -1):
        words = np.where(words >> k & 1, words ^ (_GENERATOR << (k - 11)), words)
    return words


class Golay:
    """Decoding of 23-bit words to the index of the only codeword within three bits."""

    def __init__(self) -> None:
        bit = 1 << np.arange(23)
        two = (bit[:, None] | bit)[np.triu_indices(23, 1)]
        three = np.unique(two[:, None] | bit)
        errors = np.unique(np.concatenate([[0], bit, two, three]))
        self.error = np.zeros(1 << 11, np.int64)
        self.error[_syndrome(errors)] = errors  # 2048 errors of weight up to 3, a syndrome each

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[_syndrome(words)]) >> 11

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index): the indices of a word and of all words one bit away, once each."""
        near = np.concatenate([np.zeros(1, np.int64), 1 << np.arange(23)])
        found = np.sort(self.index(words[:, None] ^ near), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        return np.nonzero(new)[0], found[new]


def fingerprint_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of signed 64-bit fingerprints: a segment and the Golay keys of the next."""
    golay = Golay()
    words = prints.view(np.uint64)
    parts = [((words >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    for i, part in enumerate(parts):
        row, index = golay.keys(parts[(i + 1) % len(parts)])
        rows.append(row)
        keys.append(i << 34 | part[row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(prints), 4096):
            part = prints[k:k + 4096]
            row, key = fingerprint_keys(part)
            yield pa.record_batch([pa.array(key), pa.array(part[row])], names=["key", "print"])


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame) -> DataFrame:
    """(node_a, node_b) of distinct fingerprints (column ``print``): enough links between
    fingerprints at most two bits apart for their components to be whole."""
    keys = stage(prints.mapInArrow(_keys, "key long, print long"), "simhash-keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    seats = stage(keys.join(shared, "key"), "simhash-seats")

    few = seats.where(F.col("members") <= CROWD).select("key", "print")
    a, b = few.toDF("key", "node_a"), few.toDF("key", "node_b")
    met = a.join(b, "key").where((F.col("node_a") < F.col("node_b"))
                                 & (_apart(F.col("node_a"), F.col("node_b")) <= BITS))

    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    many = seats.where(F.col("members") > CROWD).select("print").distinct()
    dealt = many.select("print", F.explode(flips).alias("flip")).select(
        F.col("print").bitwiseXOR(F.col("flip")).alias("mid"), "print")
    around = dealt.groupBy("mid").agg(F.collect_list("print").alias("prints"))  # at most 65
    stars = (around.where(F.size("prints") > 1)
             .select(F.array_min("prints").alias("node_a"), F.explode("prints").alias("node_b"))
             .where("node_a <> node_b"))
    return met.select("node_a", "node_b").union(stars).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, print (signed 64 bits), component_id of every document."""
    marks = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), _fingerprint(text_of(docs)).alias("print"))
    marks = stage(marks, "simhash-prints")
    classes = stage(marks.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("members")),
                    "simhash-classes")
    found = stage(links(classes.select("print")), "simhash-links")
    parts = components(found)
    named = (classes.join(parts.withColumnRenamed("node", "print"), "print", "left")
             .withColumn("part", F.coalesce("part", "print")))
    names = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named = stage(named.join(names, "part").select("print", "members", "component_id"), "simhash-names")

    # A class may hold a third of all rows: the few such classes (at most SHARE) go to the rows.
    rows = marks.count()
    big = F.col("members") * SHARE > rows
    hot, rest = (named.where(c).select("print", "component_id") for c in (big, ~big))
    hot = F.broadcast(hot)
    return (marks.join(hot, "print").select("doc_id", "print", "component_id")
            .union(marks.join(hot, "print", "left_anti").join(rest, "print")
                   .select("doc_id", "print", "component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: fingerprint and component of every document."""
    g = near_groups(load(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
