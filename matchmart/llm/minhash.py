"""Near-duplicate documents with b-bit MinHash.

Words are lower-cased (A-Z) runs without white space; a document is the set of
its distinct five-word shingles (one shingle of all words if it has fewer), and
two documents are linked when 100 * intersection >= 85 * union. Groups are the
connected components of all links.

1. One pass over the texts gives each document its set's size, a 128-bit digest
   of the set, and MinHash minima: the low byte of each is kept and packed into
   the b-bit signature, groups of six whole minima give the band keys.
2. Documents with equal sets form a class; everything after this works on one
   node per class, so copies by the million cost nothing more.
3. Classes that share a band key are candidates. In a bucket each class meets
   the bucket's smallest one (a star, as many pairs as members). Pairs whose
   b-bit estimate, corrected for chance agreement, is far below the threshold
   are dropped, the rest is confirmed on the full sets.
4. What a star can miss are links between two classes of a bucket that are in
   different components so far. For buckets that still hold several components
   all such pairs are compared in blocks of bounded size, by signature and by a
   bitmap of the set: the bits in which two bitmaps differ are a lower bound of
   the shingles in which the sets differ, so this drops no link. Only pairs that
   pass both leave the task, to be confirmed as well.
5. Components of the confirmed links by alternating min-label rounds.

With 24 bands of 6 a pair at the threshold is missed by all bands once in
80,000 pairs; the estimate's margin is over five standard deviations.
Both are parameters. The set digest and the shingle hashes have 128 and 64 bits.

Step 4 is the one part whose work can outgrow the input: in a bucket of n
classes that are similar but not linked it compares signatures n^2 / 2 times,
in n / BLOCK times as many bytes shuffled. No pair is left out.

Defined cases: null text, or one without words, is an empty set, linked with
nothing; equal ids in rows with different sets are different nodes with one
name; a component without any id has a null component; an empty table gives an
empty table; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType

from .common import WORD, col, load, stage, text_of

WORDS = 5
BANDS, ROWS = 24, 6
#: a link, in percent of the union
PERCENT = 85
#: how far under the threshold an estimate may lie before a pair is dropped
MARGIN = 0.16
#: bits of a set's bitmap
BITS = 4096
#: classes of a bucket that one task compares with as many others
BLOCK = 1024
_SEED = 20260

_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                    0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words. bytes.lower and bytes.split know ASCII letters and
    exactly the white space U+0020, U+0009 to U+000D."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(known) > 400_000:
        known.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def shingle_set(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles."""
    h = word_hashes(text, known)
    if len(h) == 0:
        return h
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, np.uint64(min(len(h), WORDS)), np.uint64)
    for j in range(min(WORDS, len(h))):
        out = _mix(out + h[j:j + n] * _PRIMES[j])
    return np.unique(out)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    n = BANDS * ROWS
    return (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, n, dtype=np.uint64))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, in bounded blocks."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 512):
        np.minimum(low, (shingles[k:k + 512, None] * a + b).min(axis=0), out=low)
    return low


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to doc_id, n, node, sig, bands."""
    a, b = _coefficients()
    known: dict[bytes, int] = {}
    for batch in batches:
        n, node, sig, bands = [], [], [], []
        for t in batch.column(1):
            s = shingle_set(t.as_py(), known)
            n.append(len(s))
            if len(s) == 0:
                node.append(None), sig.append(None), bands.append(None)
                continue
            node.append(xxhash.xxh3_128_digest(s.tobytes()))
            low = minima(s, a, b)
            sig.append(low.astype(np.uint8).tobytes())  # the low byte of each
            bands.append([xxhash.xxh3_64_intdigest(low[k:k + ROWS].tobytes(), seed=k) - 2**63
                          for k in range(0, len(low), ROWS)])
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                               pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                              names=["doc_id", "n", "node", "sig", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, node (null for empty sets), sig, bands of every document."""
    rows = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"),
                       text_of(docs).alias("text"))
    return rows.mapInArrow(_sketch, "doc_id long, n long, node binary, sig binary, bands array<long>")


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle; two bitmaps differ in no more bits than the sets in shingles."""
    bits = np.zeros(BITS, bool)
    bits[(shingles % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text to node, shingles, bits."""
    known: dict[bytes, int] = {}
    for batch in batches:
        sets = [shingle_set(t.as_py(), known) for t in batch.column(0)]
        yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                               pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                               pa.array([bitmap(s) for s in sets], pa.binary())],
                              names=["node", "shingles", "bits"])


def candidate_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles, bits), one row for each of ``nodes``.

    The texts are fetched by the class's least id; where an id names several
    texts, the set's digest tells which of them is meant.
    """
    ids = classes.join(nodes, "node", "left_semi").select(F.col("least_id").alias("wanted")).distinct()
    rows = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    sets = rows.mapInArrow(_sets, "node binary, shingles array<long>, bits binary")
    return stage(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "near-sets")


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity from equal bytes of packed signatures, less chance agreement (2^-8)."""
    same = (x == y).mean(axis=-1)
    return (same - 2.0**-8) / (1 - 2.0**-8)


def _likely(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node_a, sig_a, node_b, sig_b rows to the node pairs whose estimate is high enough."""
    for p in pairs:
        x, y = (np.frombuffer(b"".join(p[c]), np.uint8).reshape(len(p), -1) for c in ("sig_a", "sig_b"))
        yield p.loc[estimate(x, y) >= PERCENT / 100 - MARGIN, ["node_a", "node_b"]]


def _across(block: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a block pair's two sides that lie in different components and may be links."""
    sig = np.frombuffer(b"".join(block["sig"]), np.uint8).reshape(len(block), -1)
    bits = np.frombuffer(b"".join(block["bits"]), np.uint64).reshape(len(block), -1)
    n = block["n"].to_numpy()
    part = pd.factorize(block["part"])[0]
    node, side = block["node"].to_numpy(), block["side"].to_numpy()
    one = block["i"].iat[0] == block["j"].iat[0]
    left = np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    out = []
    for k in left:
        others = right[(part[right] != part[k]) & ((right > k) | (not one))]
        others = others[estimate(sig[others], sig[k]) >= PERCENT / 100 - MARGIN]
        # With d shingles not shared, 100 (n + m - d) / 2 >= PERCENT (n + m + d) / 2 must hold.
        d = np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1, dtype=np.int64)
        hits = others[(100 + PERCENT) * d <= (100 - PERCENT) * (n[others] + n[k])]
        out += [(min(node[k], node[h]), max(node[k], node[h])) for h in hits]
    return pd.DataFrame(out, columns=["node_a", "node_b"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (node_a, node_b) that are links, compared on full sets.

    A node in very many pairs has one set row, so AQE can split the pairs' side.
    """
    pairs = stage(pairs.distinct(), "near-pairs")
    both = pairs.join(sets.select(F.col("node").alias("node_a"), F.col("shingles").alias("a")), "node_a")
    both = both.join(sets.select(F.col("node").alias("node_b"), F.col("shingles").alias("b")), "node_b")
    shared = F.size(F.array_intersect("a", "b"))
    union = F.size("a") + F.size("b") - shared
    return both.where(shared * 100 >= union * PERCENT).select("node_a", "node_b")


def components(edges: DataFrame) -> DataFrame:
    """(node_a, node_b) links to (node, part): the smallest node reachable.

    Alternates two steps until nothing changes: every node takes the least label
    among its own and its neighbours', then labels follow labels (a label's own
    label), which halves long chains. The work per round is a row per link.
    """
    if edges.isEmpty():
        return edges.select(F.col("node_a").alias("node"), F.col("node_b").alias("part"))
    both = stage(edges.union(edges.select("node_b", "node_a")).toDF("node", "other").distinct(), "near-edges")
    labels = stage(both.groupBy("node").agg(F.min("other").alias("least"))
                   .select("node", F.least("node", "least").alias("part")), "near-labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), F.col("part").alias("heard")), "other")
        heard = heard.groupBy("node").agg(F.min("heard").alias("heard"))
        near = labels.join(heard, "node").select(
            "node", F.col("part").alias("was"), F.least("part", "heard").alias("part"))
        near = stage(near, "near-round")
        leaders = near.select(F.col("node").alias("leader"), F.col("part").alias("over"))
        jumped = stage(near.join(leaders, near["part"] == leaders["leader"]).select(
            "node", "was", F.col("over").alias("part")), "near-labels")
        moved = jumped.where("part <> was").limit(1).count()
        labels = jumped.select("node", "part")
        if not moved:
            return labels


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' sketches, and (node, least_id, part) of every class."""
    marks = stage(sketches(docs), "near-sketches")
    full = marks.where("node IS NOT NULL")
    classes = stage(full.groupBy("node").agg(F.min("sig").alias("sig"), F.min("doc_id").alias("least_id"),
                                             F.first("bands").alias("bands")), "near-classes")
    band = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = band.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members"))
    buckets = stage(buckets.where("members > 1"), "near-buckets")
    seats = stage(band.join(buckets, ["band", "key"]), "near-seats")

    sets = candidate_sets(docs, classes, seats.select("node").distinct())

    star = seats.where(F.col("node") != F.col("pivot")).select(
        F.col("pivot").alias("node_a"), F.col("node").alias("node_b")).distinct()
    sigs = classes.select("node", "sig")
    star = (star.join(sigs.toDF("node_a", "sig_a"), "node_a").join(sigs.toDF("node_b", "sig_b"), "node_b")
            .mapInPandas(_likely, "node_a binary, node_b binary"))
    links = stage(confirm(star, sets), "near-links")
    parts = components(links)

    # Buckets of two have been compared in full; larger ones with several components have not.
    open_seats = seats.where("members > 2").join(parts, "node", "left").withColumn(
        "part", F.coalesce("part", "node"))
    several = (open_seats.groupBy("band", "key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
               .where("lo <> hi").select("band", "key"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    marked = sets.select("node", "bits", F.size("shingles").alias("n")).join(sigs, "node")
    rest = (open_seats.join(several, ["band", "key"], "left_semi").join(marked, "node")
            .where(F.col("node") != F.col("pivot"))
            .withColumn("blocks", blocks)
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("band", "key", "node", "part", "sig", "bits", "n", F.least("own", "other").alias("i"),
                    F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side")))
    more = rest.groupBy("band", "key", "i", "j").applyInPandas(_across, "node_a binary, node_b binary")
    found = stage(confirm(more, sets), "near-links")
    parts = components(links.union(found))

    named = classes.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    return marks, named.select("node", "least_id", "part")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, component_id of every document."""
    marks, named = _named(docs)
    named = named.groupBy("part").agg(F.min("least_id").alias("component_id")).join(
        named.select("node", "part"), "part").select("node", "component_id")
    out = marks.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "node",
                      F.when(F.col("node").isNull(), F.col("doc_id"))
                      .otherwise(F.col("component_id")).alias("component_id"))


@F.arrow_udf(BinaryType())
def _node(texts: pa.Array) -> pa.Array:
    """The digest of a text's set, as in the sketches."""
    known: dict[bytes, int] = {}
    return pa.array([xxhash.xxh3_128_digest(shingle_set(t.as_py(), known).tobytes()) for t in texts], pa.binary())


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns, and every document with an empty set.

    The group's node with the smallest id stays (null ids last, then the smallest
    digest), of its rows with that id the one whose text has the smallest MD5,
    then the smallest other columns. Rows alike in all of these differ at most in
    nested columns.
    """
    _, named = _named(docs)
    best = named.groupBy("part").agg(F.min(F.struct(F.col("least_id").isNull().alias("odd"), "least_id", "node")).alias("best"))
    # Keys without nulls, so that the rows are dealt once for both the choice and the join.
    best = best.select(F.col("best.node").alias("node"), F.col("best.odd").alias("odd"),
                       F.coalesce("best.least_id", F.lit(0)).alias("id"))
    texts, own = text_of(docs), col(docs, "doc_id").cast("long")
    full = docs.where(texts.rlike(WORD))
    plain = [col(docs, f.name) for f in docs.schema if isinstance(f.dataType, AtomicType) and f.name != "text"]
    rows = full.select(_node(texts).alias("node"), own.isNull().alias("odd"), F.coalesce(own, F.lit(0)).alias("id"),
                       F.struct(F.md5(texts.cast("binary")), *plain).alias("order"),
                       F.struct(*(col(docs, c) for c in docs.columns)).alias("row"))
    rows = rows.groupBy("node", "odd", "id").agg(F.min_by("row", "order").alias("row"))
    rows = rows.join(best, ["node", "odd", "id"], "left_semi").select("row.*")
    return rows.union(docs.where(~texts.rlike(WORD)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the component of every document."""
    g = near_groups(load(spark, sf_dir, "documents"))
    return g.select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
