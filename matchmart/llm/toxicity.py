"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own embedding beside the sum of the embeddings of its
character n-grams (both hashed into tables of fixed size). Windows of ``T``
words that overlap by ``T - STRIDE`` go through a forward and a backward GRU;
attention pools the states into a vector and a logit. A text's logit is the
largest of all its windows, calibrated by a logistic curve.

Training fits on the driver and sees at most ``SAMPLE`` labelled texts of each
label of at most ``SAMPLE_CHARS`` characters, chosen by a hash of the id; the share of toxic labels comes from all that may be seen. It is
multiple-instance learning: a toxic text's best window must be toxic, a clean
text's windows must not; which window that is comes first from the features'
log odds, which also fill one column of the embeddings to begin with, and then
from the model. A fifth of the sample is kept back for the calibration.

Scoring reads whole texts in Arrow functions: every window of every text, with
the model (about 2 MB, whatever the input) in the closure. Only the text goes to
Python. Texts are worked on in slices of ``SLICE`` bytes (a longer one alone), their
windows ``BATCH`` at a time, so memory follows neither rows nor their width. No shuffle.

Defined cases: null or wordless texts score 0; labels for ids that do not occur
and null labels are left out; without both labels in the sample every text
scores 0; an empty table gives an empty table; further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import byte_slices, col, load, text_of

T, STRIDE = 32, 16
#: sizes of the hashed embedding tables, of a word's two parts, of a GRU, of the attention
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
DW = DC = H = A = 8
GRAMS = (3, 4, 5, 6)
#: most labelled texts per label in training, and their most characters
SAMPLE, SAMPLE_CHARS = 1500, 20_000
THRESHOLD = 0.3
#: bytes of text whose words are looked up together, windows per matrix step, words whose vectors are summed together
SLICE, BATCH, WORDS = 2 << 20, 1024, 16_384
_SEED = 7


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-cased runs of letters and digits: (codes, offsets of texts, distinct words)."""
    clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "))
    lists = pc.split_pattern(clean, " ")
    coded = pc.dictionary_encode(lists.flatten())
    return coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


@dataclass
class Features:
    """Table rows of distinct words: one word row, and a run of n-gram rows, for each."""
    word: np.ndarray
    gram: np.ndarray
    start: np.ndarray
    scale: np.ndarray


def features(words: list[str]) -> Features:
    """``WORDS`` words at a time, as their n-grams are many."""
    parts = [_features(words[k:k + WORDS]) for k in range(0, len(words), WORDS)] or [_features([])]
    if len(parts) == 1:
        return parts[0]
    before = np.cumsum([0] + [len(p.gram) for p in parts[:-1]])
    return Features(np.concatenate([p.word for p in parts]), np.concatenate([p.gram for p in parts]),
                    np.concatenate([p.start + b for p, b in zip(parts, before)]),
                    np.concatenate([p.scale for p in parts]))


def _features(words: list[str]) -> Features:
    raw = [w.encode() or b" " for w in words]
    word = np.fromiter((xxhash.xxh32_intdigest(w) for w in raw), np.int64, len(raw)) % WORD_ROWS
    flat = np.frombuffer(b"".join(b"^" + w + b"$" for w in raw), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), size)
    left = np.repeat(end, size) - np.arange(len(flat))  # bytes from here to the word's end
    rows, owners = [], []
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = max(0, len(flat) - n + 1)
        h[:m] = h[:m] * np.uint64(0x100000001B3) + flat[n - 1:n - 1 + m]
        if n in GRAMS:
            at = np.flatnonzero(left >= n)
            g = (h[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            rows.append((g >> np.uint64(40)).astype(np.int32) % GRAM_ROWS)
            owners.append(owner[at])
    order = np.argsort(np.concatenate(owners), kind="stable")
    gram, owner = np.concatenate(rows)[order], np.concatenate(owners)[order]
    count = np.bincount(owner, minlength=len(raw))  # never 0: "^w$" has three bytes or more
    return Features(word, gram, np.cumsum(count) - count, 1 / np.sqrt(count))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def window_table(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts given by word offsets: (text, first word, words)."""
    n = np.diff(offsets)
    many = np.where(n > 0, np.maximum(0, -(-(n - T) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    # The last window ends with the text, so only texts under T words have room left.
    first = np.minimum(nth * STRIDE, np.maximum(n[text] - T, 0))
    return text, offsets[:-1][text] + first, np.minimum(n[text], T)


class Net:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = _SEED):
        r = np.random.default_rng(seed)
        def normal(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "Ew": normal(WORD_ROWS, DW, scale=0.05), "Ec": normal(GRAM_ROWS, DC, scale=0.05),
            "W": normal(DW + DC, 6 * H, scale=0.3), "b": np.zeros(6 * H, np.float32),
            "Uf": normal(H, 3 * H, scale=0.3), "Ub": normal(H, 3 * H, scale=0.3),
            "Wa": normal(2 * H, A, scale=0.3), "va": normal(A, scale=0.3),
            "u": normal(2 * H, scale=0.3), "c": np.zeros(1, np.float32)}
        self.curve = (1.0, 0.0)

    def inputs(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct word's vector, and its part of the gates in both directions."""
        p = self.p
        grams, ends = np.empty((len(f.word), DC), p["Ec"].dtype), np.append(f.start, len(f.gram))
        for k in range(0, len(f.word), WORDS):
            a, b = ends[k], ends[min(k + WORDS, len(f.word))]
            grams[k:k + WORDS] = np.add.reduceat(p["Ec"][f.gram[a:b]], f.start[k:k + WORDS] - a, axis=0)
        grams *= f.scale[:, None].astype(grams.dtype)
        x = np.concatenate([p["Ew"][f.word], grams], axis=1)
        # After the last word comes the row for "no word here": it keeps the state.
        none = np.zeros((1, 6 * H), np.float32)
        none[0, :H] = none[0, 3 * H:4 * H] = 30
        return x, np.concatenate([x @ p["W"] + p["b"], none])

    def _run(self, gates: np.ndarray, codes: np.ndarray, u: np.ndarray, back: bool, keep: list | None):
        """States of one direction, windows x T x H."""
        out = np.empty((*codes.shape, H), np.float32)
        h = np.zeros((len(codes), H), np.float32)
        for t in range(T - 1, -1, -1) if back else range(T):
            x, g = gates[codes[:, t]], h @ u
            zr = _sigmoid(x[:, :2 * H] + g[:, :2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(x[:, 2 * H:] + r * g[:, 2 * H:])
            if keep is not None:
                keep.append((t, h, z, r, n, g[:, 2 * H:]))
            h = n + z * (h - n)
            out[:, t] = h
        return out

    def forward(self, gates: np.ndarray, codes: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows of rows of ``gates``; its last row stands for no word."""
        p = self.p
        kf, kb = ([], []) if trace is not None else (None, None)
        s = np.concatenate([self._run(np.ascontiguousarray(gates[:, :3 * H]), codes, p["Uf"], False, kf),
                            self._run(np.ascontiguousarray(gates[:, 3 * H:]), codes, p["Ub"], True, kb)], axis=2)
        a = np.tanh(s @ p["Wa"])
        e = a @ p["va"]
        e = np.where(codes == len(gates) - 1, np.float32(-30), e)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        w = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", w, s)
        if trace is not None:
            trace.update(kf=kf, kb=kb, s=s, a=a, w=w, pooled=pooled)
        return pooled @ p["u"] + p["c"][0]

    def gradients(self, f: Features, codes: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """Weighted mean log loss and its gradients."""
        p, tr = self.p, {}
        x, gates = self.inputs(f)
        logit = self.forward(gates, codes, tr)
        prob = _sigmoid(logit)
        total = weights.sum()
        loss = float((weights * np.logaddexp(0, np.where(labels > 0, -logit, logit))).sum() / total)
        d = ((prob - labels) * weights / total).astype(np.float32)
        g = {"c": d.sum(keepdims=True), "u": tr["pooled"].T @ d}
        dpool = d[:, None] * p["u"]
        ds = tr["w"][:, :, None] * dpool[:, None]
        dw = np.einsum("bh,bth->bt", dpool, tr["s"])
        de = tr["w"] * (dw - (tr["w"] * dw).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("bt,bta->a", de, tr["a"])
        da = de[:, :, None] * p["va"] * (1 - tr["a"] ** 2)
        g["Wa"] = np.einsum("bth,bta->ha", tr["s"], da)
        ds += da @ p["Wa"].T
        dgates = np.zeros_like(gates)
        for at, side, kept, name in ((0, ds[:, :, :H], tr["kf"], "Uf"), (3 * H, ds[:, :, H:], tr["kb"], "Ub")):
            u, du, dh = p[name], np.zeros_like(p[name]), np.zeros((len(codes), H), np.float32)
            for t, before, z, r, n, gn in reversed(kept):
                dh = dh + side[:, t]
                dn = dh * (1 - z) * (1 - n ** 2)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                np.add.at(dgates[:, at:at + 3 * H], codes[:, t], np.concatenate([dz, dr, dn], axis=1))
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                du += before.T @ dg
                dh = dh * z + dg @ u.T
            g[name] = du
        dgates = dgates[:-1]
        g["W"], g["b"] = x.T @ dgates, dgates.sum(axis=0)
        dx = dgates @ p["W"].T
        g["Ew"], g["Ec"] = np.zeros_like(p["Ew"]), np.zeros_like(p["Ec"])
        np.add.at(g["Ew"], f.word, dx[:, :DW])
        many = np.diff(np.append(f.start, len(f.gram)))
        np.add.at(g["Ec"], f.gram, np.repeat(dx[:, DW:] * f.scale[:, None], many, axis=0))
        return loss, g

    def words(self, texts: pa.Array):
        """(distinct words, codes in order, then the code of no word; and each window's text, first word, words)."""
        code, offsets, distinct = words_of(texts)
        if "" in distinct:  # a text without words splits into one empty word
            blank = distinct.index("")
            bad = np.cumsum(np.append(0, code == blank))
            offsets, code = offsets - bad[offsets], code[code != blank]
        return distinct, np.append(code, len(distinct)), *window_table(offsets)

    @staticmethod
    def window_codes(code: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        step, out = np.arange(T), np.empty((len(first), T), np.int32)
        for k in range(0, len(first), 8 * BATCH):
            part = slice(k, k + 8 * BATCH)
            out[part] = code[np.where(step < size[part, None], first[part, None] + step, len(code) - 1)]
        return out

    def windows(self, texts: pa.Array):
        """(distinct words, codes by window, text of each window)."""
        distinct, code, text, first, size = self.words(texts)
        return distinct, self.window_codes(code, first, size), text

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The largest window logit of each text; -inf for texts without words."""
        out = np.full(len(texts), -np.inf, np.float32)
        for a, b in byte_slices(texts, SLICE):
            distinct, code, text, first, size = self.words(texts.slice(a, b - a))
            if not len(text):
                continue
            gates = self.inputs(features(distinct))[1]
            for k in range(0, len(text), BATCH):
                part = slice(k, k + BATCH)
                found = self.forward(gates, self.window_codes(code, first[part], size[part]))
                np.maximum.at(out, a + text[part], found)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        a, b = self.curve
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(a * self.logits(texts).astype(np.float64) + b)))


def _log_odds(f: Features, text: np.ndarray, word: np.ndarray, labels: np.ndarray):
    """Log odds of toxic for a text that has it, for each word row and each n-gram row.

    ``text`` and ``word`` say which text has which distinct word, in order of texts;
    a hundred texts at a time, as their n-grams are many.
    """
    many = np.diff(np.append(f.start, len(f.gram)))
    count = {"word": np.zeros((2, WORD_ROWS)), "gram": np.zeros((2, GRAM_ROWS))}
    for lo in range(0, len(labels), 100):
        a, b = np.searchsorted(text, (lo, lo + 100))
        t, w = text[a:b], word[a:b]
        span = many[w]
        inner = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        for name, rows, of in (("word", f.word[w], t), ("gram", f.gram[np.repeat(f.start[w], span) + inner],
                                                        np.repeat(t, span))):
            seen = np.unique(rows * 100 + (of - lo))
            np.add.at(count[name], (labels[lo + seen % 100].astype(int), seen // 100), 1)
    p, n = labels.sum(), len(labels) - labels.sum()
    return [np.log((c[1] + 0.5) / (p + 1)) - np.log((c[0] + 0.5) / (n + 1)) for c in count.values()]


def train(texts: list[str], labels: np.ndarray, rounds: int = 2, passes: int = 4,
          rate: float = 0.01, seed: int = _SEED, prior: float | None = None) -> Net:
    """A network fitted to whole texts with labels 0 and 1.

    ``prior`` is the share of label 1 where the texts come from, if the sample's differs.
    """
    net, rng = Net(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float32)
    back = rng.random(len(texts)) < 0.2
    distinct, codes, text = net.windows(pa.array(texts, pa.string()))
    if not len(codes) or not 0 < labels[~back].sum() < (~back).sum():
        return _silent(net)
    f = features(distinct)
    many = np.diff(np.append(f.start, len(f.gram)))
    # Which words occur in which fitted text.
    key = np.unique((text[:, None] * (len(distinct) + 1) + codes).ravel())
    has, word = key // (len(distinct) + 1), key % (len(distinct) + 1)
    use = ~back[has] & (word < len(distinct))
    odds_w, odds_c = _log_odds(f, (np.cumsum(~back) - 1)[has[use]], word[use], labels[~back])
    # Rows that say little or were hardly seen start at 0.
    odds_w, odds_c = (np.where(np.abs(o) > 2, np.clip(o, -4, 4), 0) for o in (odds_w, odds_c))
    net.p["Ew"][:, 0] += 0.5 * odds_w
    net.p["Ec"][:, 0] += 0.5 * odds_c
    word_odds = np.append(np.maximum(odds_w[f.word], np.maximum.reduceat(odds_c[f.gram], f.start)), -9)
    guess = word_odds[codes].max(axis=1)

    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(rounds):
        order = np.lexsort((guess, text))
        last = np.append(text[order][1:] != text[order][:-1], True)
        best = order[last]
        best = best[~back[text[best]]]
        clean = np.flatnonzero((labels[text] == 0) & ~back[text])
        more = rng.choice(clean, min(len(clean), 2 * len(best)), replace=False) if len(clean) else clean
        use = np.concatenate([best, more])
        for _ in range(passes):
            for part in np.array_split(rng.permutation(use), max(1, len(use) // 128)):
                rows, at = np.unique(codes[part], return_inverse=True)
                at = at.reshape(codes[part].shape)
                real = rows[rows < len(distinct)]
                if len(real) == len(rows):
                    at = at.copy()  # the last row must stand for no word even if unused
                span = many[real]
                sub = Features(f.word[real], f.gram[np.repeat(f.start[real] - (np.cumsum(span) - span), span)
                                                    + np.arange(span.sum())],
                               np.cumsum(span) - span, f.scale[real])
                y = labels[text[part]]
                share = max(y.mean(), 0.05)
                _, g = net.gradients(sub, at, y, np.where(y > 0, 0.5 / share, 0.5 / (1 - min(share, 0.95))))
                step += 1
                for k, v in net.p.items():
                    m, s = state[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.01 * (g[k] ** 2 - s)
                    v -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-6)
        gates = net.inputs(f)[1]
        guess = np.concatenate([net.forward(gates, codes[k:k + BATCH]) for k in range(0, len(codes), BATCH)])
    # The curve from a text's largest logit to its probability, on what was kept back.
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, text, guess)
    held = back & np.isfinite(top)
    net.curve = _calibrate(top[held], labels[held]) if 0 < labels[held].sum() < held.sum() else (1.0, 0.0)
    if prior and 0 < prior < 1:
        drawn = labels.mean()
        shift = np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))
        net.curve = net.curve[0], net.curve[1] + float(shift)
    return net


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and intercept of a logistic curve, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        s = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.5 * (a - 1), (p - y).sum()])
        hess = np.array([[(s * x * x).sum() + 0.5, (s * x).sum()], [(s * x).sum(), s.sum()]])
        move = np.linalg.solve(hess, g)
        a, b = max(0.1, a - np.clip(move[0], -0.5, 0.5)), b - np.clip(move[1], -0.5, 0.5)
    return float(a), float(b)


def _silent(net: Net) -> Net:
    """A network that scores everything 0."""
    net.p["u"][:], net.p["c"][:] = 0, -np.inf
    return net


def held_out(doc_id):
    """Rows that training must not see: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Net:
    """Train on a bounded sample of the labelled texts that may be seen.

    Ids are chosen from the labels alone; the at most ``2 * sample`` of them are
    broadcast to the texts, so no text is shuffled.
    """
    known = labels.select(col(labels, "doc_id").cast("long").alias("id"), col(labels, "toxic").cast("int").alias("toxic"))
    known = known.where("id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    by = known.withColumn("by", F.xxhash64("id", F.lit(_SEED)))
    picks = by.where("toxic = 0").orderBy("by").limit(sample).unionAll(by.where("toxic = 1").orderBy("by").limit(sample))
    rows = docs.select(col(docs, "doc_id").cast("long").alias("id"), text_of(docs).alias("text"))
    rows = rows.where(F.length("text") <= sample_chars).join(F.broadcast(picks), "id")
    got = rows.select("toxic", "text", "by").orderBy("by", "text").limit(2 * sample).collect()
    y = np.array([r.toxic for r in got], np.float32)
    net = Net()
    if not 0 < y.sum() < len(y):
        return _silent(net)
    return train([r.text for r in got], y, prior=share)


def scorer(net: Net):
    """The score of a text column, as an Arrow function."""
    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(net.score(texts.cast(pa.string())), pa.float64())
    return score


def scores(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score of every document."""
    return docs.select(col(docs, "doc_id").cast("long").alias("doc_id"), scorer(net)(text_of(docs)).alias("score"))


def clean(docs: DataFrame, net: Net, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under ``threshold``, with their own columns."""
    return docs.where(scorer(net)(text_of(docs)) < threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's score, by a network that is trained on this corpus's labels."""
    docs = load(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, load(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
