"""Toxicity scores from a bidirectional GRU with attention pooling, trained in numpy.

Every word of a text enters the network as the sum of a word embedding and of
the embeddings of its character 5-grams (the byte before the word counts, so
that word starts are known).  A GRU reads each window of 64 words in both
directions, attention pools its states, and a logistic unit scores the window.
All windows of a text, overlapping by half, are scored; the text's score is
its highest window score.

Training takes a bounded sample of labelled rows (``TRAIN_ROWS`` per class)
in one task: document-level counts choose the word and 5-gram vocabulary by
a chi-squared test, embeddings start from log-odds, and Adam fits all weights to
one window per document and epoch - the highest-scoring one, the usual
multiple-instance choice, and for clean documents a random one besides.  The
weights are below 1 MB and are broadcast; scoring is one pass over the texts
without a shuffle.

Inputs of a score are the text's bytes only.  Defined cases: a null or empty
text is one empty window and gets the network's score for no words; labels
other than 0 and 1 and null labels are not trained on; a document with several
label rows trains once, as toxic if any row says so; without rows of both
classes every score is the share of toxic rows seen (0 without any); repeated rows
are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C

TRAIN_ROWS = 1500
WORDS, STRIDE = 64, 32
GRAM = 5
VOCABULARY = 4096
EMBED, HIDDEN, ATTENTION = 8, 8, 8
EPOCHS, BATCH, RATE = 10, 96, 0.01
CHI2 = 33.0
TABLE_BITS = 20


# ------------------------------------------------------------------ features

def tokens(buf: np.ndarray, offsets: np.ndarray):
    """Word (start, end, document, hash) and 5-gram (word, hash) arrays of a piece."""
    low = C.LOWER[buf]
    start, end, doc = C.find_words(low, offsets, C.ALNUM)
    low = np.where(C.ALNUM[low], low, np.uint8(0x20))
    low = np.concatenate([np.full(1, 0x20, np.uint8), low])  # a byte before the first word
    prefix = C.POLY.prefix_bytes(low)
    word = C.POLY.span(prefix, start + 1, end + 1)
    count = np.maximum(end - start + 1 - GRAM + 1, 0)  # grams of the word with the byte before it
    owner = np.repeat(np.arange(len(start)), count)
    at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(owner))
    # the byte before the first word of a text may belong to the previous text: it counts as a space
    gram = C.POLY2.span(C.POLY2.prefix_bytes(low), at, at + GRAM)
    joined = np.flatnonzero((start > 0) & np.isin(start, offsets) & C.ALNUM[low[start]]) if len(start) else np.zeros(0, np.int64)
    for k in joined:
        if count[k]:
            head = np.concatenate([[np.uint8(0x20)], low[start[k] + 1:start[k] + GRAM]])
            i = int(np.searchsorted(owner, k))
            gram[i] = C.POLY2.span(C.POLY2.prefix_bytes(head), np.array([0]), np.array([GRAM]))[0]
    return doc, word, owner, gram


class Vocabulary:
    """Feature numbers (from 1) of 64-bit hashes, by a direct table and a full check."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.concatenate([[np.uint64(0)], hashes.astype(np.uint64)])
        self.table = np.zeros(1 << TABLE_BITS, np.int16)
        self.table[(self.hashes[1:] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = np.arange(1, len(self.hashes))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, feature numbers) of known hashes."""
        f = self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
        at = np.flatnonzero(f)
        at = at[self.hashes[f[at]] == h[at]]
        return at, f[at].astype(np.int64)


def inputs(buf: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary):
    """(document of each word, word of each feature, feature)."""
    doc, word, owner, gram = tokens(buf, offsets)
    a, f = vocabulary.find(word)
    b, g = vocabulary.find(gram)
    return doc, np.concatenate([a, owner[b]]), np.concatenate([f, g])


def windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word within it, words) of all overlapping windows; an empty text has one empty window."""
    count = np.maximum(-(-(n_words - WORDS) // STRIDE), 0) + 1
    doc = np.repeat(np.arange(len(n_words)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, k * STRIDE, np.minimum(n_words[doc] - k * STRIDE, WORDS)


# ------------------------------------------------------------------- network

def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(features: int, odds: np.ndarray, rng) -> dict[str, np.ndarray]:
    h, e = HIDDEN, EMBED
    p = {"emb": rng.normal(0, 0.05, (features + 1, e)), "wa": rng.normal(0, 0.3, (2 * h, ATTENTION)), "ba": np.zeros(ATTENTION),
         "va": rng.normal(0, 0.3, ATTENTION), "out": rng.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
    p["emb"][0] = 0
    p["emb"][1:, 0] = odds / 2
    for d in "fb":
        p["w" + d], p["u" + d], p["b" + d] = rng.normal(0, 0.2, (e, 3 * h)), rng.normal(0, 0.2, (h, 3 * h)), np.zeros(3 * h)
        # start with states that follow the log-odds of what is read, and attention on high states
        p["w" + d][0, 2 * h:] = 1
    p["wa"], p["va"], p["out"] = np.abs(p["wa"]), np.full(ATTENTION, 1.0), np.full(2 * h, 0.5)
    return {k: v.astype(np.float32) for k, v in p.items()}


def gru(xp: np.ndarray, mask: np.ndarray, u: np.ndarray, backward: bool, keep: bool):
    """States [T, N, H] from projected inputs [T, N, 3H]; gates are kept for the backward pass."""
    t_max, n, _ = xp.shape
    h = HIDDEN
    state = np.zeros((n, h), np.float32)
    states, saved = np.zeros((t_max, n, h), np.float32), [None] * t_max
    for t in range(t_max - 1, -1, -1) if backward else range(t_max):
        a = state @ u
        zr = sigmoid(xp[t, :, :2 * h] + a[:, :2 * h])
        z, r = zr[:, :h], zr[:, h:]
        cand = np.tanh(xp[t, :, 2 * h:] + r * a[:, 2 * h:])
        new = cand + z * (state - cand)
        m = mask[t][:, None]
        if keep:
            saved[t] = (state, z, r, cand, a[:, 2 * h:])
        state = state + m * (new - state)
        states[t] = state
    return states, saved


def pool(states: np.ndarray, mask: np.ndarray, p: dict):
    u = np.tanh(states @ p["wa"] + p["ba"])
    s = u @ p["va"]
    s = np.where(mask > 0, s, -30)
    a = np.exp(s - s.max(0))
    a = a / a.sum(0) * (mask.sum(0) > 0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return u, a, pooled, pooled @ p["out"] + p["c"][0]


def gru_back(d_states: np.ndarray, saved: list, mask: np.ndarray, u: np.ndarray, backward: bool):
    """Gradients of the projected inputs and of the recurrent weights."""
    t_max, n, h = d_states.shape
    dxp, du, carry = np.zeros((t_max, n, 3 * h), np.float32), np.zeros_like(u), np.zeros((n, h), np.float32)
    for t in range(t_max) if backward else range(t_max - 1, -1, -1):
        state, z, r, cand, an = saved[t]
        m = mask[t][:, None]
        total = carry + d_states[t]
        new = total * m
        dz = new * (state - cand) * z * (1 - z)
        dn = new * (1 - z) * (1 - cand * cand)
        dr = dn * an * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], 1)
        dxp[t] = np.concatenate([dz, dr, dn], 1)
        du += state.T @ da
        carry = total * (1 - m) + new * z + da @ u.T
    return dxp, du


def gradients(x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, p: dict):
    """Loss gradients of one batch; x is [T, N, E]."""
    g, back = {}, {}
    states = []
    for d, rev in (("f", False), ("b", True)):
        s, back[d] = gru(x @ p["w" + d] + p["b" + d], mask, p["u" + d], rev, True)
        states.append(s)
    states = np.concatenate(states, 2)
    u, a, pooled, logit = pool(states, mask, p)
    dl = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
    g["out"], g["c"] = pooled.T @ dl, dl.sum(keepdims=True)
    dp = dl[:, None] * p["out"]
    ds = a[:, :, None] * dp
    da = np.einsum("tnh,nh->tn", states, dp)
    dscore = a * (da - (a * da).sum(0))
    g["va"] = np.einsum("tn,tna->a", dscore, u)
    du = dscore[:, :, None] * p["va"] * (1 - u * u)
    g["wa"], g["ba"] = np.einsum("tnh,tna->ha", states, du), du.sum((0, 1))
    ds = ds + du @ p["wa"].T
    dx = np.zeros_like(x)
    for k, (d, rev) in enumerate((("f", False), ("b", True))):
        dxp, g["u" + d] = gru_back(ds[:, :, k * HIDDEN:(k + 1) * HIDDEN], back[d], mask, p["u" + d], rev)
        g["w" + d], g["b" + d] = np.einsum("tne,tnk->ek", x, dxp), dxp.sum((0, 1))
        dx += dxp @ p["w" + d].T
    return g, dx


def score_windows(doc, first, size, bound, owner, feature, p: dict, step: int = 4096) -> np.ndarray:
    """Logits of windows; ``bound`` gives each document's first word in the piece."""
    words = int(bound[-1])
    x = np.zeros((words + 1, EMBED), np.float32)
    np.add.at(x, owner, p["emb"][feature])
    out = np.zeros(len(doc), np.float32)
    project = {d: x @ p["w" + d] + p["b" + d] for d in "fb"}
    for lo in range(0, len(doc), step):
        part = slice(lo, lo + step)
        t = np.arange(max(1, int(size[part].max())))[:, None]
        mask = (t < size[part]).astype(np.float32)
        at = np.minimum(bound[doc[part]] + first[part] + t, words)
        states = [gru(project[d][at], mask, p["u" + d], d == "b", False)[0] for d in "fb"]
        out[part] = pool(np.concatenate(states, 2), mask, p)[3]
    return out


# ------------------------------------------------------------------ training

def choose_features(doc: np.ndarray, h: np.ndarray, y: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, log-odds) of the features whose presence depends on the label the most."""
    pair = np.unique(np.rec.fromarrays([h, doc], names="h,d"))
    value, first = np.unique(pair["h"], return_index=True)
    cut = np.append(first, len(pair))
    ones = np.add.reduceat(y[pair["d"]].astype(np.float64), first) if len(pair) else np.zeros(0)
    zeros = np.diff(cut) - ones
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    both = ones + zeros
    expect = both * n1 / (n1 + n0)
    chi2 = (ones - expect) ** 2 / np.maximum(expect * (1 - both / (n1 + n0)), 1e-9) * (n1 + n0) / n0
    order = np.lexsort((value, -chi2))[:limit]
    order = order[(chi2[order] >= CHI2) & (both[order] >= 3)] if (chi2 >= CHI2).any() else order[:64]
    odds = np.log((ones + 0.2) / (n1 + 0.4)) - np.log((zeros + 0.2) / (n0 + 0.4))
    return value[order], np.clip(odds[order], -4, 4)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> dict:
    """Weights and vocabulary from labelled texts."""
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.0}
    rng = np.random.default_rng(seed)
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    words, grams = [], []
    for lo, hi in C.pieces(offsets):
        doc, word, owner, gram = tokens(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        words.append((doc + lo, word))
        grams.append((doc[owner] + lo, gram))
    found = [choose_features(np.concatenate([d for d, _ in part]), np.concatenate([h for _, h in part]), y, VOCABULARY) for part in (words, grams)]
    vocabulary = Vocabulary(np.concatenate([f[0] for f in found]))
    p = init(len(vocabulary.hashes) - 1, np.concatenate([f[1] for f in found]), rng)

    owners, features, counts, base = [], [], [], 0
    for lo, hi in C.pieces(offsets):
        doc, owner, feature = inputs(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], vocabulary)
        owners.append(owner + base)
        features.append(feature)
        counts.append(np.bincount(doc, minlength=hi - lo))
        base += len(doc)
    owner, feature, n_words = np.concatenate(owners), np.concatenate(features), np.concatenate(counts)
    order = np.argsort(owner, kind="stable")
    owner, feature = owner[order], feature[order]
    bound = np.concatenate([[0], np.cumsum(n_words)])
    doc, first, size = windows(n_words)
    start = bound[doc] + first
    cut = np.searchsorted(owner, start), np.searchsorted(owner, start + size)
    # first choice: the window with the highest sum of log-odds
    odds = np.concatenate([[0], np.cumsum(p["emb"][feature, 0])])
    logit = odds[cut[1]] - odds[cut[0]]
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    heads = np.searchsorted(doc, np.arange(len(y) + 1))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for epoch in range(EPOCHS):
        best = np.array([heads[d] + int(np.argmax(logit[heads[d]:heads[d + 1]])) for d in range(len(y))])
        other = np.array([rng.integers(heads[d], heads[d + 1]) for d in np.flatnonzero(y == 0)], np.int64)
        chosen = rng.permutation(np.concatenate([best, other]))
        for lo in range(0, len(chosen), BATCH):
            w = chosen[lo:lo + BATCH]
            t_max = max(1, int(size[w].max()))
            mask = (np.arange(t_max)[:, None] < size[w]).astype(np.float32)
            x = np.zeros((t_max, len(w), EMBED), np.float32)
            span = np.concatenate([np.arange(a, b) for a, b in zip(cut[0][w], cut[1][w])]).astype(np.int64)
            column = np.repeat(np.arange(len(w)), (cut[1] - cut[0])[w])
            row = owner[span] - start[w][column]
            np.add.at(x, (row, column), p["emb"][feature[span]])
            g, dx = gradients(x, mask, y[doc[w]], share[doc[w]], p)
            g["emb"] = np.zeros_like(p["emb"])
            np.add.at(g["emb"], feature[span], dx[row, column])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            for k, v in g.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-6))
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * v
                m[1] = 0.999 * m[1] + 0.001 * v * v
                p[k] -= (RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
            p["emb"][0] = 0
        logit = score_windows(doc, first, size, bound, owner, feature, p)
    # the decision bound between the classes' document logits, on the training rows
    top = np.maximum.reduceat(logit, heads[:-1])
    cuts = np.sort(top)
    middle = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
    ones, zeros = np.sort(top[y == 1]), np.sort(top[y == 0])
    errors = np.searchsorted(ones, middle) / len(ones) + 1 - np.searchsorted(zeros, middle) / len(zeros)
    least = np.flatnonzero(errors <= errors.min() + 1e-12)
    gap = np.append(np.diff(cuts), 0)
    p["c"] = p["c"] - np.float32(middle[least[np.argmax(gap[np.maximum(least - 1, 0)])]])
    return {"weights": p, "hashes": vocabulary.hashes[1:]}


# ------------------------------------------------------------------- scoring

def score_texts(buf: np.ndarray, offsets: np.ndarray, model: dict, vocabulary: Vocabulary | None) -> np.ndarray:
    n = len(offsets) - 1
    if "constant" in model:
        return np.full(n, model["constant"])
    out = np.zeros(n)
    for lo, hi in C.pieces(offsets, 1 << 20):
        word_doc, owner, feature = inputs(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], vocabulary)
        n_words = np.bincount(word_doc, minlength=hi - lo)
        bound = np.concatenate([[0], np.cumsum(n_words)])
        doc, first, size = windows(n_words)
        logit = score_windows(doc, first, size, bound, owner, feature, model["weights"])
        out[lo:hi] = sigmoid(np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(hi - lo))).astype(np.float64))
    return out


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The model, from at most ``rows`` labelled texts per class that are not held out.

    The sample is the rows with the smallest hashes of their id; its texts go to
    one task, and only the weights come to the driver."""
    known = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    sample = C.written(parts[0].unionByName(parts[1]), "toxic-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = C.written(C.split_by(texts, sample)[0].join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "toxic-texts")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        return pd.DataFrame({"model": [pickle.dumps(train(frame["text"].tolist(), frame["toxic"].to_numpy()))]})

    found = texts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else {"constant": 0.0}


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column ``toxicity``: the score of every whole text."""
    spark = docs.sparkSession
    C.prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        vocabulary = Vocabulary(model["hashes"]) if "hashes" in model else None
        for text in parts:
            buf, offsets = C.strings(pa.array(text, pa.string(), from_pandas=True))
            yield pd.Series(score_texts(buf, offsets, model, vocabulary))

    return docs.withColumn("toxicity", run(F.col("text").cast("string")))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract columns over all of ``documents``, trained on ``labels.toxic``."""
    C.prepare(spark)
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.table(spark, sf_dir, "labels"))
    out = scores(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
