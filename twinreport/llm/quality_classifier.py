"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE bytes. Each passage is described by counts of hashed pairs of bytes and a few
shares of character classes, and encoded by a learned layer. Gated attention (tanh and sigmoid branches) learned from the
documents' labels weighs the passages; the weighted mean of their encodings is the document's, from which a logistic unit
gives the score. Fitting uses plain numpy on the driver, on at most TRAIN labelled documents chosen by a hash of their
id and at most PASSAGES passages of each, evenly spread over it, so what is collected is bounded in bytes; scoring reads
every whole text where it lies, without a shuffle.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1. Documents' ids, languages and sources are
never inputs.

Defined results: a null text counts as empty; an empty text is one passage without bytes, scored like any other; a null
doc_id is returned as null, is not held out and never trains; repeated rows each give a row; of several labels of an id
the least counts; null labels are not used; without labels of both classes every score is the share of label 1 (0.5 if
none); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

PASSAGE = 1024
LEAN = 128
HASHED = 256
#: Labelled documents that are fitted on, at most; chosen by a hash of the id, the rarer class first up to half.
TRAIN = 4000
#: Passages of a document that is fitted on, at most.
PASSAGES = 32
WIDTH, GATE, EPOCHS, BATCH = 24, 16, 12, 64

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_CLASS = np.zeros(256, np.int64)
_CLASS[[ord(c) for c in " \t\n\r\x0b\x0c"]] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 3
_CLASS[ord("0") : ord("9") + 1] = 4
_CLASS[128:] = 5
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 6
_CLASS[[ord(c) for c in "#*$%&|<>{}[]=+/\\@^~_`"]] = 7
CLASSES = 8
FEATURES = HASHED + CLASSES + 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def describe(text: str) -> np.ndarray:
    """A row of features for each passage of the whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    n = max(1, -(-len(raw) // PASSAGE))
    at = np.arange(len(raw)) // PASSAGE
    size = np.maximum(np.bincount(at, minlength=n), 1)[:, None]
    pairs = (raw[:-1] * 256 + raw[1:]) * 2654435761 % (1 << 32) * HASHED >> 32
    hashed = np.bincount(at[1:] * HASHED + pairs, minlength=n * HASHED).reshape(n, HASHED) if len(raw) > 1 else np.zeros((n, HASHED))
    kinds = np.bincount(at * CLASSES + _CLASS[raw], minlength=n * CLASSES).reshape(n, CLASSES)
    upper = kinds[:, 3:4] / np.maximum(kinds[:, 2:3] + kinds[:, 3:4], 1)
    variety = (hashed > 0).sum(axis=1, keepdims=True) / HASHED
    data = raw.astype(np.uint8).tobytes()
    packed = np.array([[len(zlib.compress(data[i * PASSAGE : (i + 1) * PASSAGE], 1))] for i in range(n)])
    # Weak repetition of a short passage says little: all rates lean towards those of an ordinary text of LEAN bytes.
    repeats = (packed + LEAN * 0.5) / (size + LEAN)
    return np.concatenate([np.sqrt(hashed / (size + LEAN)), kinds / (size + LEAN / 8), upper, variety * PASSAGE / (size + PASSAGE), repeats], axis=1)


class AttentionModel:
    """Parameters and their fit; deterministic for the same rows."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": g(FEATURES, WIDTH), "b": np.zeros(WIDTH), "V": g(WIDTH, GATE), "U": g(WIDTH, GATE), "w": g(GATE, 1)[:, 0], "o": g(WIDTH, 1)[:, 0], "c": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """x: all passages of n bags, bag: the number of each passage's bag, ascending."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        starts = np.searchsorted(bag, np.arange(n))  # every bag has a passage
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "y": y}

    def gradient(self, x: np.ndarray, bag: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bag, len(label))
        d = (f["y"] - label) * weight / len(label)
        dz = d[:, None] * p["o"]
        da = (dz[bag] * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.bincount(bag, f["a"] * da, len(label))[bag])
        dts = de[:, None] * p["w"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - f["h"] ** 2)
        return {"W": x.T @ du, "b": du.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "o": f["z"].T @ d, "c": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], label: np.ndarray, seed: int = 5) -> AttentionModel:
        if len(label) == 0 or label.min() == label.max():
            self.constant = float(label.mean()) if len(label) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        bags = [(b - self.mean) / self.scale for b in bags]
        share = label.mean()
        weight = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                bag = np.repeat(np.arange(len(own)), [len(bags[j]) for j in own])
                g = self.gradient(np.concatenate([bags[j] for j in own]), bag, label[own], weight[own])
                step += 1
                for k in self.p:
                    gk = g[k] + 1e-5 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk**2
                    self.p[k] = self.p[k] - 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return self.forward((np.concatenate(bags) - self.mean) / self.scale, bag, len(bags))["y"]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    """text, quality of at most `most` labelled documents that are not held out: up to half of each class, by hash of the id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.col("doc_id"), F.lit("train"))
    chosen = [known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(most // 2) for q in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # at most `most` ids
    return texts(docs).join(few, "doc_id").select("doc_id", "text", "quality")


def spread(bag: np.ndarray, most: int = PASSAGES) -> np.ndarray:
    """At most `most` passages, evenly spread."""
    return bag if len(bag) <= most else bag[np.linspace(0, len(bag) - 1, most).round().astype(int)]


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> AttentionModel:
    """Fits on the driver; the passages of the bounded sample are described where the texts lie, so no text is collected."""

    def each(batch: dict[str, list]) -> Iterator[dict[str, list]]:
        bags = [spread(describe(t)).astype(np.float32) for t in batch["text"]]
        yield {"doc_id": batch["doc_id"], "quality": batch["quality"], "n": [len(b) for b in bags], "bag": [b.tobytes() for b in bags]}

    rows = map_batches(training_rows(docs, labels, most), lambda: each, "doc_id long, quality int, n int, bag binary")
    # Equal ids may have several rows and texts: one each, the least, chosen before anything is collected.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("n", "bag", "quality")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    bags = [np.frombuffer(b, np.float32).reshape(n, FEATURES).astype(float) for n, b in zip(rows["n"], rows["bag"], strict=True)]
    return AttentionModel().fit(bags, rows["quality"].to_numpy(float))


def score_documents(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""

    def each(batch: dict[str, list]) -> Iterator[dict[str, list]]:
        for i in range(0, len(batch["text"]), 256):
            part = {k: v[i : i + 256] for k, v in batch.items()}
            # Rounded, as the order of sums depends on which documents share a batch.
            score = np.round(model.score([describe(t) for t in part["text"]]), 9)
            yield {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist()}

    return map_batches(texts(docs, held_out(F.col("doc_id")).alias("held_out")), lambda: each, SCHEMA)


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    return score_documents(docs, fit(docs, labels, most))
