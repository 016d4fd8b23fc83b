"""Phrase collocations, counted in counting quotient filters.

Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into
words ``[^\\x20\\x09]+``. Everything is per language. Candidates are phrases of two to
four words that occur at least ``LEAST`` times; a candidate's score is its lowest over
all cuts in two parts, floor(2000000 * a / (l + r)); a candidate is dropped if its words
lie inside a longer one with at least 80 % of its count.

1. Words are counted. Those with at least ``LEAST`` occurrences can be in candidates;
   the ``VOCABULARY`` most frequent of them get ids of 21 bits and are broadcast.
2. Each text becomes a run of ids (0 breaks it at piece ends and at other words),
   written once and read by the two counts below.
3. An n-gram's ids are packed and permuted by a Feistel network, which can be
   undone. Of the permuted number's high bits, the first name the shard and the next
   the quotient; the rest is the remainder, kept in full. So a sorted filter holds,
   for each quotient in unary its number of entries, then remainders and counters,
   and nothing is lost. A task fills a filter with up to ``FILL`` n-grams and sends each
   shard its part. A shard merges its sorted filters and adds up their counters. The
   permutation spreads distinct n-grams evenly, and a frequent one is one entry per
   filter, so shards are of one size whatever the text.
4. A phrase occurs at most as often as its parts. A bitmap of fixed size holds the
   frequent pairs; three and four words are counted where all their pairs are in it.
   A bit shared by two pairs costs a needless entry, never a result.
5. If there are more frequent words than ``VOCABULARY``, phrases with any of the others
   are counted as strings beside the filters, so none is left out.

Defined cases: null text is empty, null lang is ``und``; a row's id plays no part, so
repeated rows count again; phrases tied in score and count go by their UTF-8 bytes; an
empty table gives an empty table; further columns are left alone.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_blocks, col, load, stage, text_of

#: occurrences that make a phrase a candidate, its most words, phrases reported per language
LEAST, LONGEST, TOP = 30, 4, 2000
#: percent of a phrase's count that make a longer one cover it
COVER = 80
#: frequent words that get an id (at most 2^21 - 1); the rest goes by strings
VOCABULARY = 1 << 20
#: bits of an id, of the bitmap's index, n-grams of a task's filter, n-grams of a shard (about)
ID, MAP, FILL, SHARD = 21, 27, 1 << 22, 1 << 21
#: distinct words that a task counts before it passes them on
WORDS = 300_000
#: ids in a row of encoded text (about), parts of a language that are ranked alone
ROW, PARTS = 1 << 19, 64
_SCORE = 2_000_000

_BREAK = b"."
_FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\n\x0b\x0c\r",
                        string.ascii_lowercase.encode() + _BREAK * 10)


def tokens(data: bytes) -> Iterator[list[bytes]]:
    """A text's words with ``_BREAK`` between pieces, in lists of bounded size."""
    for block in byte_blocks(data):
        yield block.translate(_FOLD).replace(_BREAK, b" . ").split()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """lang, text rows."""
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield lang, text.as_buffer().to_pybytes()


# ------------------------------------------------------------------------------ words

def _count_rows(counts: dict[str, Counter]) -> pa.RecordBatch:
    langs = [lang for lang, c in counts.items() for _ in c]
    return pa.record_batch([pa.array(langs, pa.string()),
                            pa.array([w for c in counts.values() for w in c], pa.binary()),
                            pa.array([n for c in counts.values() for n in c.values()], pa.int64())],
                           names=["lang", "phrase", "f"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, data in _texts(batch):
            for words in tokens(data):
                counts[lang].update(words)
                counts[lang].pop(_BREAK, None)
                if sum(map(len, counts.values())) > WORDS:
                    yield _count_rows(counts)
                    counts.clear()
    if counts:
        yield _count_rows(counts)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase (one word's bytes), f of (lang, text) rows."""
    found = texts.mapInArrow(_count_words, "lang string, phrase binary, f long")
    return stage(found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "phrase-words")


# ------------------------------------------------------------------------------ ids

def _encoder(words: Broadcast):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, text to runs of 32-bit ids."""
        ids: dict[str, dict[bytes, int]] = defaultdict(dict)
        for i, (lang, word) in enumerate(words.value, 1):
            ids[lang][word] = i
        runs: list[np.ndarray] = []
        size = 0

        def row(run: np.ndarray) -> pa.RecordBatch:
            run = run[(run != 0) | (np.concatenate([[0], run[:-1]]) != 0)]  # one 0 a gap
            return pa.record_batch([pa.array([run.astype("<u4").tobytes()], pa.binary()), pa.array([len(run)])],
                                   names=["ids", "n"])

        for batch in batches:
            for lang, data in _texts(batch):
                known = ids[lang]
                for part in tokens(data):
                    runs.append(np.array([known.get(w, 0) for w in part], np.uint32))
                    size += len(part)
                    if size > 2 * ROW and (runs[-1] == 0).any():  # a long text parts where no phrase goes
                        run = np.concatenate(runs)
                        end = np.flatnonzero(run == 0)[-1] + 1
                        yield row(run[:end])
                        runs, size = [run[end:]], len(run) - end
                runs.append(np.zeros(1, np.uint32))
                if size > ROW:
                    yield row(np.concatenate(runs))
                    runs, size = [], 0
        if runs:
            yield row(np.concatenate(runs))

    return encode


# ------------------------------------------------------------------------------ packed n-grams

def _scramble(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _halves(n: int) -> tuple[int, int]:
    """Bits of the two halves of n packed ids."""
    return ID * (n - n // 2), ID * (n // 2)


def permute(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """n ids, packed and permuted: the number's first 63 bits (or all), and its last 21."""
    n = len(ids)
    wide, narrow = _halves(n)
    hi, lo = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
    for x in ids[:n - n // 2]:
        hi = hi << np.uint64(ID) | x.astype(np.uint64)
    for x in ids[n - n // 2:]:
        lo = lo << np.uint64(ID) | x.astype(np.uint64)
    for salt in (1, 2, 3):
        lo = (lo ^ _scramble(hi, salt)) & np.uint64((1 << narrow) - 1)
        hi = (hi ^ _scramble(lo, -salt % 2**64)) & np.uint64((1 << wide) - 1)
    if n < 4:
        return hi << np.uint64(narrow) | lo, np.zeros(len(hi), np.uint64)
    return hi << np.uint64(ID) | lo >> np.uint64(ID), lo & np.uint64((1 << ID) - 1)


def restore(n: int, key: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """The ids that were permuted."""
    wide, narrow = _halves(n)
    cut = np.uint64(ID if n == 4 else narrow)
    hi, lo = key >> cut, key & np.uint64((1 << int(cut)) - 1)
    if n == 4:
        lo = lo << np.uint64(ID) | rest
    for salt in (3, 2, 1):
        hi = (hi ^ _scramble(lo, -salt % 2**64)) & np.uint64((1 << wide) - 1)
        lo = (lo ^ _scramble(hi, salt)) & np.uint64((1 << narrow) - 1)
    ids = [hi >> np.uint64(ID * k) for k in range(wide // ID - 1, -1, -1)]
    ids += [lo >> np.uint64(ID * k) for k in range(narrow // ID - 1, -1, -1)]
    return [x & np.uint64((1 << ID) - 1) for x in ids]


def _key_bits(n: int) -> int:
    return min(ID * n, 63)


def _added(key: np.ndarray, rest: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct entries with the sums of their counters."""
    order = np.lexsort((rest, key)) if rest.any() else np.argsort(key, kind="stable")
    key, rest, f = key[order], rest[order], f[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (rest[1:] != rest[:-1])
    return key[new], rest[new], np.add.reduceat(f, np.flatnonzero(new)) if len(f) else f


# ------------------------------------------------------------------------------ filters

def _low_bytes(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _from_low_bytes(data: memoryview, size: int) -> np.ndarray:
    m = len(data) // size if size else 0
    full = np.zeros((m, 8), np.uint8)
    full[:, :size] = np.frombuffer(data, np.uint8).reshape(m, size)
    return full.view("<u8").reshape(-1)


def _layout(n: int, shard_bits: int, m: int) -> tuple[int, int, int, int]:
    """Bits of the quotient, then bits and bytes of the remainder, and bytes of the rest."""
    quotient = min(max(m.bit_length() - 1, 0), _key_bits(n) - shard_bits)
    left = _key_bits(n) - shard_bits - quotient
    return quotient, left, -(-left // 8), -(-ID // 8) if n == 4 else 0


def filter_bytes(n: int, shard_bits: int, key: np.ndarray, rest: np.ndarray, f: np.ndarray) -> bytes:
    """A filter of one shard's sorted entries: entries per quotient in unary, remainders,
    counters of a byte each, and the full counters of those that a byte can't hold."""
    m = len(key)
    quotient, left, size, extra = _layout(n, shard_bits, m)
    q = (key >> np.uint64(left)) & np.uint64((1 << quotient) - 1)
    runs = np.bincount(q.astype(np.int64), minlength=1 << quotient)
    unary = np.ones(m + (1 << quotient), np.uint8)
    unary[np.cumsum(runs) + np.arange(1 << quotient)] = 0
    small = np.where(f < 255, f, 255).astype(np.uint8)
    return b"".join([np.packbits(unary).tobytes(), _low_bytes(key & np.uint64((1 << left) - 1), size),
                     _low_bytes(rest, extra) if extra else b"", small.tobytes(), f[f >= 255].astype("<i8").tobytes()])


def filter_entries(n: int, shard_bits: int, shard: int, m: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``filter_bytes`` wrote."""
    quotient, left, size, extra = _layout(n, shard_bits, m)
    view, at = memoryview(data), 0

    def take(count: int) -> memoryview:
        nonlocal at
        at += count
        return view[at - count:at]

    bits = m + (1 << quotient)
    unary = np.unpackbits(np.frombuffer(take(-(-bits // 8)), np.uint8), count=bits)
    q = (np.cumsum(unary == 0)[unary == 1]).astype(np.uint64)
    low = _from_low_bytes(take(m * size), size) if size else np.zeros(m, np.uint64)
    rest = _from_low_bytes(take(m * extra), extra) if extra else np.zeros(m, np.uint64)
    f = np.frombuffer(take(m), np.uint8).astype(np.int64)
    f[f == 255] = np.frombuffer(view[at:], "<i8")
    return (np.uint64(shard) << np.uint64(quotient) | q) << np.uint64(left) | low, rest, f


def _grams(run: np.ndarray, n: int, likely: np.ndarray | None) -> list[np.ndarray]:
    """The ids of a run's n-grams without breaks, all of whose pairs are in the bitmap."""
    size = len(run) - n + 1
    if size <= 0:
        return [run[:0]] * n
    whole = np.ones(size, bool)
    for k in range(n):
        whole &= run[k:k + size] != 0
    if likely is not None:
        pair = np.zeros(len(run) - 1, bool)
        at = np.flatnonzero((run[:-1] != 0) & (run[1:] != 0))
        bit = _bit(permute([run[at], run[at + 1]])[0])
        pair[at] = likely[bit >> 3] >> (bit & 7) & 1
        for k in range(n - 1):
            whole &= pair[k:k + size]
    at = np.flatnonzero(whole)
    return [run[at + k] for k in range(n)]


def _bit(pair_key: np.ndarray) -> np.ndarray:
    """A permuted pair's place in the bitmap."""
    return (pair_key >> np.uint64(2 * ID - MAP)).astype(np.int64)


def _filler(sizes: tuple[int, ...], shard_bits: int, likely: Broadcast | None):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of ids to filters: size (words of the n-grams), shard, m (entries), data."""
        bitmap = None if likely is None else np.frombuffer(likely.value, np.uint8)
        held: dict[int, list[tuple]] = {n: [] for n in sizes}
        counts = dict.fromkeys(sizes, 0)

        def flush(n: int) -> pa.RecordBatch:
            key, rest, f = _added(*map(np.concatenate, zip(*held[n])))
            held[n], counts[n] = [], 0
            shard = (key >> np.uint64(_key_bits(n) - shard_bits)).astype(np.int64)
            names, starts = np.unique(shard, return_index=True)
            cuts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(key)])]
            return pa.record_batch([pa.array([n] * len(names), pa.int32()), pa.array(names, pa.int64()),
                                    pa.array([c.stop - c.start for c in cuts], pa.int64()),
                                    pa.array([filter_bytes(n, shard_bits, key[c], rest[c], f[c]) for c in cuts],
                                             pa.binary())], names=["size", "shard", "m", "data"])

        for batch in batches:
            for blob in batch.column(0):
                run = np.frombuffer(blob.as_buffer(), "<u4")
                for n in sizes:
                    key, rest = permute(_grams(run, n, bitmap))
                    held[n].append(_added(key, rest, np.ones(len(key), np.int64)))
                    counts[n] += len(held[n][-1][0])
                    if counts[n] > FILL:
                        yield flush(n)
        for n in sizes:
            if counts[n]:
                yield flush(n)

    return fill


def _merger(shard_bits: int, least: int):
    def merge(filters: pa.Table) -> pa.Table:
        """A shard's filters to its n-grams that occur often enough."""
        n, shard = filters["size"][0].as_py(), filters["shard"][0].as_py()
        parts = [filter_entries(n, shard_bits, shard, m.as_py(), d.as_buffer())
                 for m, d in zip(filters["m"], filters["data"])]
        key, rest, f = _added(*map(np.concatenate, zip(*parts)))
        often = f >= least
        ids = np.stack(restore(n, key[often], rest[often]), axis=1).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n), pa.array(ids.reshape(-1)))
        return pa.table({"size": pa.array([n] * len(ids), pa.int32()), "ids": lists, "f": f[often]})

    return merge


def frequent(codes: DataFrame, sizes: tuple[int, ...], shard_bits: int, likely: Broadcast | None = None) -> DataFrame:
    """size, ids, f of the n-grams of encoded texts with at least ``LEAST`` occurrences."""
    filters = codes.select("ids").mapInArrow(_filler(sizes, shard_bits, likely),
                                             "size int, shard long, m long, data binary")
    merged = filters.groupBy("size", "shard").applyInArrow(_merger(shard_bits, LEAST),
                                                           "size int, ids array<int>, f long")
    return stage(merged, "phrase-grams")


def _bitmap(pairs: DataFrame) -> bytes:
    """A bit for each frequent pair: 2^MAP bits, whatever the number of pairs."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.uint64).reshape(-1, 2)
            yield pa.record_batch([pa.array(_bit(permute([ids[:, 0], ids[:, 1]])[0]))], names=["bit"])

    found = pairs.select("ids").mapInArrow(bits, "bit long")
    page = 1 << 15  # the bits of Spark's bitmaps
    rows = (found.groupBy(F.floor(F.col("bit") / page).alias("page"))
            .agg(F.bitmap_construct_agg(F.col("bit") % page).alias("bits")).collect())  # 2^MAP bits at most
    out = bytearray((1 << MAP) // 8)
    for r in rows:
        out[r["page"] * page // 8:(r["page"] + 1) * page // 8] = r["bits"]
    return bytes(out)


def _speller(words: Broadcast):
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """ids, f to lang, phrase, f."""
        known = words.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array([known[i[0] - 1][0] for i in ids], pa.string()),
                                   pa.array([b" ".join(known[k - 1][1] for k in i) for i in ids], pa.binary()),
                                   batch.column(1)], names=["lang", "phrase", "f"])

    return spell


def _other_phrases(words: Broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of two words and more with a word that has no id."""
        known: dict[str, set[bytes]] = defaultdict(set)
        for lang, word in words.value:
            known[lang].add(word)
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, data in _texts(batch):
                tail: list[bytes] = []
                for part in tokens(data):
                    # The last words of the block before: phrases that begin in them are counted here.
                    part = tail + part
                    tail = part[max(0, len(part) - LONGEST + 1):]
                    counts[lang].update(_with_others(part, known[lang], len(part) - len(tail)))
                counts[lang].update(_with_others(tail, known[lang], len(tail)))
                if sum(map(len, counts.values())) > WORDS:
                    yield _count_rows(counts)
                    counts.clear()
        if counts:
            yield _count_rows(counts)

    return count


def _with_others(words: list[bytes], known: set[bytes], starts: int) -> Iterable[bytes]:
    for i in range(starts):
        odd = False
        for n, word in enumerate(words[i:i + LONGEST], 1):
            if word == _BREAK:
                break
            odd |= word not in known
            if odd and n > 1:
                yield b" ".join(words[i:i + n])


def phrase_counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all words and phrases with at least ``LEAST`` occurrences, and (lang, n)."""
    spark = texts.sparkSession
    every = word_counts(texts)
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    often = every.where(F.col("f") >= LEAST)
    kept = often.orderBy(F.desc("f"), "lang", "phrase").limit(VOCABULARY).select("lang", "phrase").collect()
    words = spark.sparkContext.broadcast([(r["lang"], bytes(r["phrase"])) for r in kept])

    codes = stage(texts.mapInArrow(_encoder(words), "ids binary, n long"), "phrase-codes")
    size = codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shard_bits = min(max(size // SHARD, 1).bit_length() - 1, 24)
    pairs = frequent(codes, (2,), shard_bits)
    likely = spark.sparkContext.broadcast(_bitmap(pairs))
    longer = frequent(codes, tuple(range(3, LONGEST + 1)), shard_bits, likely)
    phrases = pairs.union(longer).select("ids", "f").mapInArrow(_speller(words), "lang string, phrase binary, f long")
    out = often.union(phrases)
    if len(kept) == VOCABULARY:
        others = texts.mapInArrow(_other_phrases(words), "lang string, phrase binary, f long")
        out = out.union(others.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST))
    return stage(out.select("lang", F.col("phrase").cast("string").alias("phrase"), "f"), "phrase-counts"), totals


def collocations(df: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate that no longer one covers.

    ``df`` has text and lang.
    """
    texts = df.select(F.coalesce(col(df, "lang"), F.lit("und")).alias("lang"), text_of(df).alias("text"))
    counts, totals = phrase_counts(texts)
    words = F.split("phrase", " ")
    found = counts.select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).where(F.size("words") > 1)

    cut = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
                     F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * {_SCORE}BD DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    lowest = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("x"))
    scored = lowest.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")

    spans = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n in range(2, LONGEST)
                      for i in range(1, LONGEST - n + 2)])
    inner = found.where(F.size("words") > 2).select("lang", "words", "a", F.explode(spans).alias("s"))
    inner = inner.where((F.col("s.n") < F.size("words")) & (F.col("s.i") + F.col("s.n") - 1 <= F.size("words")))
    inner = inner.select("lang", F.array_join(F.slice("words", F.col("s.i"), F.col("s.n")), " ").alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    big = "DECIMAL(20, 0)"
    covered = F.expr(f"CAST(longer AS {big}) * 100 >= CAST(a AS {big}) * {COVER}")
    open_ = scored.join(around, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    return open_.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def first_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first phrases, with their rank.

    A language may hold all rows: its first are sought in ``PARTS`` parts, then among theirs.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        part = part.where(F.col("rank") <= top)
    return part.drop("part")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: each language's first phrases."""
    out = first_phrases(collocations(load(spark, sf_dir, "documents")))
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts
), words AS (
    SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
    SELECT lang, w[i:i + k - 1] AS g FROM starts, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(w)
), counts AS (
    SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(g) = 1 GROUP BY lang
), found AS (
    SELECT lang, g, f AS a FROM counts WHERE len(g) > 1 AND f >= 30
), cuts AS (
    SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM found
), scored AS (
    SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
    FROM cuts c
    JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:c.k]
    JOIN counts y ON y.lang = c.lang AND y.g = c.g[c.k + 1:len(c.g)]
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
    SELECT lang, g[i:i + k - 1] AS g, max(a) AS longer
    FROM (SELECT lang, g, a, unnest(range(1, len(g) + 1)) AS i FROM found), (VALUES (2), (3)) AS sizes(k)
    WHERE k < len(g) AND i + k - 1 <= len(g)
    GROUP BY ALL
), ranked AS (
    SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, s.l, s.r, t.n, s.score
    FROM lowest s JOIN totals t ON t.lang = s.lang
    LEFT JOIN inside i ON i.lang = s.lang AND i.g = s.g
    WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * s.a::HUGEINT
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS "rank",
       phrase, a, l, r, n, score
FROM ranked
QUALIFY "rank" <= 2000
"""
