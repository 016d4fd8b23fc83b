"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

1. One pass over the texts makes token ids, adds the end id, and cuts every
   document: runs of a whole window are windows of their own, what remains is
   cut into pieces of at most ``PIECE`` ids, so a piece's numbers (start,
   length, CRC of its ids) are known where its ids are and ids never travel.
2. The remaining pieces are dealt by hash into buckets of about
   ``BUCKET_PIECES``, as many buckets as the input needs. In each, multiway
   differencing merges the two partial partitions with the largest imbalance
   so that they cancel (largest sums meet smallest), until one partition into
   k near-equal windows is left. If a window is over capacity, k rises and the
   bucket is packed again; k starts at the least number that could do.

Pieces of at most a quarter of a window leave about 0.2 % padding; whole
remainders of up to a window each would leave about 2 % to 3 %.

A text without two white-space characters in a row is tokenised word by word:
a space after a character that is not white space always starts a new pre-token,
so the ids of " word" do not depend on what surrounds it, and each distinct word
of a slice of texts is tokenised once. Words are encoded by the rank file of
the same vocabulary, which is several times as fast for single words; texts'
first words, other texts and texts with special tokens go to the tokenizer
itself.

Defined cases: null and empty texts have the end id alone; rows with equal ids
are packed as separate documents; an empty table gives an empty table; further
columns are left alone.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, col, load, stage, text_of

WINDOW = 2048
PIECE = 512
BUCKET_PIECES = 4096
END_ID = 1
#: bytes of texts that are tokenised together (a longer one alone)
SLICE = 2 << 20
#: words whose ids a Python worker remembers
REMEMBERED = 200_000
#: windows that are full on their own get ids from here on
_FULL = 1 << 62

_TWO_SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]{2}"


#: how the tokenizer splits a text before merging (a fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer's file and the rank file of the same vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class WordEncoder:
    """Token ids of many texts at a time: each distinct word is tokenised once."""

    def __init__(self, path: str, ranks_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_TWO_SPACES, *map(re.escape, special)])
        self.known: dict[str, bytes] = {}
        #: byte-level vocabularies write the space as U+0120
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.leads[i] = token.startswith("\u0120")

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of " word" for each word, all in one text: a word's first id is one that
        starts with a space, and no other of its ids does."""
        ids = np.array(self.words.encode_ordinary(" " + " ".join(words)), "<u4")
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(words):
            return self._encode([" " + w for w in words])
        flat, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
        return [flat[a:b] for a, b in zip((4 * starts).tolist(), ends)]

    def _remember(self, words: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        # A word that is empty or ends in white space (a text's last) cannot stand before a space.
        odd = [w for w in new if not w or w[-1].isspace()]
        self.known.update(zip(odd, self._encode([" " + w for w in odd])))
        plain = [w for w in new if w and not w[-1].isspace()]
        for k in range(0, len(plain), 1000):
            self.known.update(zip(plain[k:k + 1000], self._encode_words(plain[k:k + 1000])))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids (unsigned 32 bits) of every text."""
        whole = pc.match_substring_regex(texts, self.whole)
        words = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        starts = words.offsets.to_numpy()
        coded = pc.dictionary_encode(words.flatten())
        distinct = coded.dictionary.to_pylist()
        self._remember(distinct)
        # Beside the distinct words, each text's first word, which has no space before it.
        code = coded.indices.to_numpy().copy()
        firsts = [distinct[c] for c in code[starts[:-1]]]
        code[starts[:-1]] = len(distinct) + np.arange(len(firsts))
        ids = [self.known[w] for w in distinct] + self._encode(firsts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        flat, counts = np.frombuffer(b"".join(ids), "<u4"), size[code]
        ends = np.cumsum(counts)
        ids = flat[np.arange(ends[-1]) + np.repeat(begin[code] - (ends - counts), counts)]
        out = np.split(ids, ends[starts[1:-1] - 1])
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = np.frombuffer(self._encode([texts[int(i)].as_py()])[0], "<u4")
        return out


_encoders: dict[tuple[str, str], WordEncoder] = {}


def _cut(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    full = n // window * window
    cuts = [(s, window) for s in range(0, full, window)]
    return cuts + [(s, min(piece, n - s)) for s in range(full, n, piece)]


def _pieces(paths: tuple[str, str], window: int, piece: int):
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(paths) or _encoders.setdefault(paths, WordEncoder(*paths))
        for batch in batches:
            rows, start, length, crc, tokens = [], [], [], [], []
            texts = batch.column(1)
            for k, stop in byte_slices(texts, SLICE):
                for i, ids in enumerate(encoder.encode(texts.slice(k, stop - k)), k):
                    ids = np.append(ids, end)
                    for s, m in _cut(len(ids), window, piece):
                        rows.append(i), start.append(s), length.append(m), tokens.append(len(ids))
                        crc.append(zlib.crc32(ids[s:s + m]))
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64()))] + [
                pa.array(x, pa.int64()) for x in (start, length, crc, tokens)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k-1, of each size: Karmarkar-Karp for k sums.

    A partial partition is the descending array of its sums, less the least one
    once it has k of them, beside the nodes that made them; absent sums are 0.
    """
    n = len(sizes)
    left, right = np.full(2 * n * 8, -1), np.full(2 * n * 8, -1)
    nodes = n
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        (_, _, a, x), (_, _, b, y) = heapq.heappop(heap), heapq.heappop(heap)
        if len(a) < len(b):
            a, x, b, y = b, y, a, x
        free = k - len(a)
        sums, made = np.concatenate([a, b[:free]]), np.concatenate([x, y[:free]])
        r = len(b) - free
        if r > 0:  # the largest of what is left of b meets the smallest of a
            if nodes + r > len(left):
                left, right = (np.concatenate([z, np.full(len(z) + r, -1)]) for z in (left, right))
            at = slice(len(a) - r, len(a))
            ids = np.arange(nodes, nodes + r)
            left[ids], right[ids] = made[at], y[free:][::-1]
            sums[at] += b[free:][::-1]
            made[at] = ids
            nodes += r
        order = np.argsort(-sums, kind="stable")
        sums, made = sums[order], made[order]
        if len(sums) == k:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), turn, sums, made))
        turn += 1
    window = np.empty(nodes, np.int64)
    window[heap[0][3]] = np.arange(len(heap[0][3]))
    for node in range(nodes - 1, n - 1, -1):  # a node is newer than its parts
        window[left[node]] = window[right[node]] = window[node]
    return window[:n]


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows for the sizes, none over capacity, as few as differencing gets by with."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, min(k, len(sizes)))
        if k >= len(sizes) or np.bincount(window, sizes).max() <= capacity:
            return window
        k += max(1, k // 500)


def _pack(capacity: int):
    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("uid", ignore_index=True)
        window = pack_sizes(bucket["length"].to_numpy(), capacity)
        bucket["sequence_id"] = bucket["bucket"] * (1 << 32) + window
        bucket["offset"] = bucket.groupby("sequence_id")["length"].cumsum() - bucket["length"]
        return bucket[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]
    return run


_OUT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long")


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, window: int = WINDOW,
         piece: int = PIECE, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    cut = rows.mapInArrow(_pieces(paths or tokenizer_paths(), window, piece),
                          "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    # Written once: ids are made once, and each piece's uid is the same for whoever reads it.
    cut = stage(cut.withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    full = cut.where(F.col("length") == window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.lit(_FULL) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.where(F.col("length") < window)
    buckets = max(1, -(-part.count() // bucket_pieces))
    packed = part.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets))).groupBy("bucket").applyInPandas(
        _pack(window), _OUT)
    return full.unionByName(packed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every piece of every document and its place."""
    return pack(load(spark, sf_dir, "documents"))
