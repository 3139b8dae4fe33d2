"""Quality classifier by gated-attention multiple-instance learning (operator 6).

A document is a bag of passages of ``PASSAGE`` words. Each passage is described by the shares of
byte classes, lengths, repetition and line structure and by a hashed histogram of its words, and
encoded by one hidden layer. Attention gates, tanh(V h) times sigmoid(U h), weigh the passages; the
weighted sum is the document's representation, scored by a logistic layer. All weights are learnt
together from document labels by Adam with a fixed seed.

Learning takes labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``max_rows`` in
order of a hash of the id. Scores depend on the text alone and cover every passage.

Defined cases: null counts as empty; a text without words is one passage of zeros; without
labelled rows of both classes every score is 0.5; repeated rows stay repeated; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.buckets import spread
from millrace.llm.common import Poly, arrow_map, groups_of, held_out, joined, symbols, table, text_bytes, word_bounds
from millrace.llm.toxicity import labelled

PASSAGE = 64  # words
BUCKETS = 32  # of the hashed word histogram
HIDDEN, GATE = 24, 12
#: byte classes: lower, upper, digit, beyond ASCII, each common mark, other marks
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "", ".", ",", "!?", "|", "#$%&*", "\"'()-:;", "\n"]
_class = np.full(256, len(CLASSES), np.int64)
for _k, _c in enumerate(CLASSES):
    _class[list(_c.encode())] = _k
_class[128:] = 3
_class[[9, 11, 12, 13, 32]] = len(CLASSES) + 1
N_CLASS = len(CLASSES) + 2
N_FEATURES = N_CLASS + 7 + BUCKETS


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and where each document's passages start (one more at the end)."""
    data, starts = joined(texts)
    if not len(data):
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(len(texts) + 1, np.int64)
    lo, hi = word_bounds(data)
    doc = np.searchsorted(starts, lo, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    bag = np.concatenate(([0], np.cumsum(n_pass)))
    passage = bag[doc] + (np.arange(len(lo)) - first_word[doc]) // PASSAGE
    total = int(bag[-1])
    words = np.bincount(passage, minlength=total)
    x = np.zeros((total, N_FEATURES), np.float32)
    if len(lo):
        full = np.flatnonzero(words)
        at = np.searchsorted(passage, full)
        own = doc[at]
        new = np.diff(own, prepend=-1) > 0
        begin = np.where(new, starts[own], lo[at])  # what stands between passages counts with the one before
        end = np.append(np.where(new[1:], starts[own[:-1] + 1] - 1, begin[1:]), starts[own[-1] + 1] - 1)
        which, rank = spread(end - begin)
        counts = np.bincount(full[which] * N_CLASS + _class[data[begin[which] + rank]], minlength=total * N_CLASS).reshape(total, N_CLASS)
        x[:, :N_CLASS] = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        h = Poly(symbols(data)).slices(lo, hi)
        size = (hi - lo).astype(float)
        w = np.maximum(words, 1)
        x[:, N_CLASS] = np.bincount(passage, size, total) / w / 10
        x[:, N_CLASS + 1] = np.bincount(passage, size <= 3, total) / w
        x[:, N_CLASS + 2] = np.bincount(passage, size > 14, total) / w
        x[:, N_CLASS + 3] = np.bincount(passage[1:], (h[1:] == h[:-1]) & (passage[1:] == passage[:-1]), total) / w
        order = np.lexsort((h, passage))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        x[:, N_CLASS + 4] = np.bincount(passage[order], new, total) / w
        x[:, N_CLASS + 5] = np.minimum(w, PASSAGE) / PASSAGE
        capital = (data[lo] >= 65) & (data[lo] <= 90)
        x[:, N_CLASS + 6] = np.bincount(passage, capital, total) / w
        bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
        x[:, N_CLASS + 7:] = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / w[:, None]
        x[words == 0] = 0
    return x, bag


def _sums(values: np.ndarray, bag: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bag[:-1], axis=0)


class Model:
    """Gated-attention network over bags; ``p`` holds the parameter arrays."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, p: dict[str, np.ndarray]) -> None:
        self.mean, self.scale, self.p = mean, scale, p

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (v * u) @ p["w"]
        doc = np.repeat(np.arange(len(bag) - 1), np.diff(bag))
        e = np.exp(a - np.maximum.reduceat(a, bag[:-1])[doc])
        att = e / _sums(e, bag)[doc]
        z = _sums(att[:, None] * h, bag)
        logit = z @ p["o"] + p["c"][0]
        return {"h": h, "v": v, "u": u, "att": att, "doc": doc, "z": z, "logit": logit}

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The score of each text."""
        if not self.p:
            return np.full(len(texts), 0.5)
        out = []
        for lo, hi in groups_of(texts):
            x, bag = passages(texts[lo:hi])
            out.append(1 / (1 + np.exp(-np.clip(self.forward((x - self.mean) / self.scale, bag)["logit"], -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bag)
        h, v, u, att, doc = f["h"], f["v"], f["u"], f["att"], f["doc"]
        d = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
        dz = d[:, None] * p["o"]
        datt = (h * dz[doc]).sum(axis=1)
        da = att * (datt - _sums(att * datt, bag)[doc])
        dv, du = da[:, None] * p["w"] * u * (1 - v * v), da[:, None] * p["w"] * v * u * (1 - u)
        dh = att[:, None] * dz[doc] + dv @ p["V"].T + du @ p["U"].T
        dpre = dh * (1 - h * h)
        return {"W": x.T @ dpre, "b": dpre.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da, "o": f["z"].T @ d, "c": np.array([d.sum()])}


def train(texts: list[bytes], y: list[int], epochs: int = 24, batch: int = 128, seed: int = 7) -> Model:
    if len(set(y)) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {})
    parts = [passages(texts[lo:hi]) for lo, hi in groups_of(texts)]
    x = np.concatenate([q[0] for q in parts]).astype(np.float64)
    n = np.concatenate([np.diff(q[1]) for q in parts])
    at = np.concatenate(([0], np.cumsum(n)))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    shape = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "o": (HIDDEN,), "c": (1,)}
    model = Model(mean, scale, {k: rng.normal(0, 0.2 if len(s) > 1 else 0.1, s) for k, s in shape.items()})
    m, s = ({k: np.zeros(q.shape) for k, q in model.p.items()} for _ in range(2))
    target, t = np.array(y, float), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), batch):
            own = order[lo:lo + batch]
            rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in own])
            g = model.gradients(x[rows], np.concatenate(([0], np.cumsum(n[own]))), target[own])
            t += 1
            for k, q in model.p.items():
                grad = g[k] + 1e-4 * q
                m[k] += 0.1 * (grad - m[k])
                s[k] += 0.01 * (grad * grad - s[k])
                q -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, label: str = "quality") -> Model:
    texts, y = labelled(docs, labels, label, max_rows)
    return train([t.encode() for t in texts], y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row; the model has a fixed size and is broadcast."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def one(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0), "score": pa.array(held.value.score(text_bytes(b.column(1))), pa.float64())}

    return arrow_map(src, one, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double", ["doc_id", "text"])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
