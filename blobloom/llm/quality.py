"""Quality classifier: gated-attention multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages. Each passage is encoded from byte statistics
and hashed byte trigrams by a learned layer; gated attention weighs the
passages; the weighted sum is scored by a logistic layer. Only documents have
labels. Training takes a bounded sample of labelled documents (``TRAIN_DOCS``);
every passage of every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a passage, passages encoded at once, and the bound on training documents and their passages.
PASSAGE, CHUNK, TRAIN_DOCS, TRAIN_PASSAGES = 600, 512, 4000, 40_000
HASHES, HIDDEN, ATTENTION, EPOCHS = 256, 24, 12, 30
SEED = 7

#: Byte classes: other, lower, upper, digit, space, line end, sentence mark, joining mark, symbol, beyond ASCII.
CLASSES = 10
_CLASS = np.zeros(256, np.uint8)
for _k, _s in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "'\"()-", "!?#$%&*|<>{}[]=+/\\@^_~`"), 1):
    for _c in _s:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 9
FEATURES = 2 * CLASSES + 5 + HASHES


def encode(data: bytes | None) -> np.ndarray:
    """Features of each passage of a text, one row each; one passage for an empty text."""
    b = np.frombuffer(data or b"", np.uint8)
    n = max(1, -(-len(b) // PASSAGE))
    return np.concatenate([_encode(b[i * PASSAGE : (i + CHUNK) * PASSAGE]) for i in range(0, n, CHUNK)])


def _encode(b: np.ndarray) -> np.ndarray:
    n = max(1, -(-len(b) // PASSAGE))
    out = np.zeros((n, FEATURES), np.float32)
    if not len(b):
        return out
    at = np.arange(len(b)) // PASSAGE
    cls = _CLASS[b].astype(np.int64)
    size = np.bincount(at, minlength=n)[:, None]
    counts = np.bincount(at * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES)
    share = counts / size
    words = np.bincount(at[1:][(cls[1:] != 4) & (cls[1:] != 5) & ((cls[:-1] == 4) | (cls[:-1] == 5))], minlength=n) + 1
    low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.int64)
    out[:, :CLASSES] = share
    out[:, CLASSES : 2 * CLASSES] = np.sqrt(share)
    k = 2 * CLASSES
    out[:, k] = size[:, 0] / words / 10
    out[:, k + 1] = np.log1p(size[:, 0]) / 7
    out[:, k + 2] = 1
    if len(b) > 2:
        mix = (low[:-2] * 31 + low[1:-1]) * 31 + low[2:]
        h = (mix * 2654435761 >> 12) & (HASHES - 1)
        tri = np.bincount(at[2:] * HASHES + h, minlength=n * HASHES).reshape(n, HASHES)
        out[:, k + 5 :] = np.sqrt(tri / size)
        # repetition: share of distinct trigrams (by a finer hash), and of a passage's most frequent
        fine = np.bincount(at[2:] * 4096 + ((mix * 2246822519 >> 9) & 4095), minlength=n * 4096).reshape(n, 4096)
        out[:, k + 3] = (fine > 0).sum(axis=1) / size[:, 0]
        out[:, k + 4] = fine.max(axis=1) / size[:, 0] * 5
    return out


class Model:
    """Encoder, gated attention and score, with Adam on the logistic loss of documents."""

    NAMES = ("W", "b", "V", "U", "w", "c", "d")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float):
        r = np.random.default_rng(SEED)
        g = lambda *s: r.normal(size=s) / np.sqrt(s[0])
        self.mean, self.scale = mean, scale
        self.p = {
            "W": g(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, ATTENTION), "U": g(HIDDEN, ATTENTION),
            "w": g(ATTENTION), "c": g(HIDDEN), "d": np.array(np.log(prior / (1 - prior))),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        a = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a /= np.add.reduceat(a, starts)[of]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return x, h, t, s, a, of, z, y

    def gradient(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        x, h, t, s, a, of, z, y = self.forward(x, starts)
        dy = (y - label) * weight / weight.sum()
        dz = dy[:, None] * p["c"]
        da = (dz[of] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, starts)[of])
        du = de[:, None] * p["w"]
        dt, ds = du * s * (1 - t**2), du * t * s * (1 - s)
        dh = a[:, None] * dz[of] + dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - h**2)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dy, "d": dy.sum()}

    def fit(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 3e-3) -> None:
        r = np.random.default_rng(SEED)
        ends = np.append(starts[1:], len(x))
        share = label.mean()
        weight = np.where(label == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) if 0 < share < 1 else np.ones(len(label))
        weight = np.sqrt(weight)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for docs in np.array_split(r.permutation(len(starts)), max(1, len(starts) // batch)):
                n = ends[docs] - starts[docs]
                rows = np.concatenate([np.arange(starts[d], ends[d]) for d in docs])
                g = self.gradient(x[rows], np.cumsum(n) - n, label[docs], weight[docs])
                step += 1
                for k in self.p:
                    grad = g[k] + (1e-4 * self.p[k] if k == "W" else 0)
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v2[k] = 0.999 * v2[k] + 0.001 * grad**2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, data: bytes | None) -> float:
        x = encode(data)
        return float(self.forward(x, np.array([0]))[-1][0])


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model:
    """Fits on labelled documents outside the held-out fold: at most TRAIN_DOCS, those first by hash of the id."""
    lab = labels.filter(labels["doc_id"].isNotNull() & labels[target].isNotNull()).select(
        labels["doc_id"].alias("l_id"), labels[target].cast("int").alias("label")
    )
    lab = lab.filter(F.crc32(F.col("l_id").cast("string").cast("binary")) % 3 != 1)
    lab = lab.groupBy("l_id").agg(F.max("label").alias("label"))
    lab = lab.orderBy(F.xxhash64("l_id"), "l_id").limit(TRAIN_DOCS)
    rows = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("binary").alias("t")).join(F.broadcast(lab), F.col("id") == F.col("l_id"))

    def bags(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in it:
            x = [encode(t) for t in g["t"]]
            yield pd.DataFrame(
                {"id": g["id"], "label": g["label"], "n": [len(v) for v in x], "x": [v.astype(np.float16).tobytes() for v in x]}
            )

    got = rows.mapInPandas(bags, "id bigint, label int, n int, x binary")
    # bounded as well for very long documents: whole bags, in hash order, those that still fit in TRAIN_PASSAGES passages
    got = got.withColumn("o", F.xxhash64("id")).orderBy("o", "id").limit(TRAIN_DOCS).toPandas()
    fits, used = [], 0
    for n in got["n"]:
        fits.append(used + n <= TRAIN_PASSAGES)
        used += n * fits[-1]
    got = got[np.array(fits, bool)]
    if not len(got):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), 0.5)
    x = np.concatenate([np.frombuffer(b, np.float16).reshape(-1, FEATURES) for b in got["x"]]).astype(np.float32)
    n = got["n"].to_numpy()
    label = got["label"].to_numpy().astype(float)
    model = Model(x.mean(0), x.std(0) + 1e-2, float(np.clip(label.mean(), 0.02, 0.98)))
    model.fit(x, np.cumsum(n) - n, label)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; null and empty texts are one empty passage.

    A null id is not held out; repeated rows are scored alike; extra columns are ignored.
    """

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype=float)

    rows = docs.select(docs["doc_id"].alias("doc_id"), scored(docs["text"].cast("binary")).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
