"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from counts over its bytes and words; a gated attention,
learned from document labels only, weighs the passages, and the weighted sum of their encodings gives the score.

The model is fitted on at most ``MAX_DOCS`` labelled rows (those with the smallest md5 of their id; equal rows count once); fitting and
scoring read every passage of a document. Fitting is seeded and full of plain sums, so reruns agree.

Null, empty and wordless texts are one empty passage and get the score of that. Ties and repeated rows are scored one by one. Without
labelled documents of both classes the score is 0.5 everywhere. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutsites.llm.arrays import BYTE_CODES, LEADS, NOT_SPACE, Texts, mix, repeats, words_of
from cutsites.llm.common import per_text

PASSAGE = 64
MAX_DOCS = 6000
HASHED = 32
HIDDEN, GATES = 24, 12
_b = np.arange(256)
_CLASSES = [
    (_b >= 65) & (_b <= 90), (_b >= 97) & (_b <= 122), (_b >= 48) & (_b <= 57), _b >= 128,
    np.isin(_b, list(b".,;:")), np.isin(_b, list(b"!?")), np.isin(_b, list(b"#*$%&<>")), _b == 124, _b == 10,
]
WIDTH = 5 + len(_CLASSES) + HASHED


def passages(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of every text (one longer)."""
    words = words_of(texts, NOT_SPACE, BYTE_CODES)
    per = np.maximum(-(-words.counts // PASSAGE), 1)
    first = np.concatenate([[0], np.cumsum(per)])
    x = np.zeros((first[-1], WIDTH), np.float32)
    if not len(words):
        return x, first
    inner = np.arange(len(words)) - np.repeat(words.first[:-1], words.counts)
    begin = np.flatnonzero(inner % PASSAGE == 0)
    passage = first[words.text[begin]] + inner[begin] // PASSAGE
    last = np.append(begin[1:], len(words)) - 1
    low, high = words.start[begin], words.end[last]
    n = (last - begin + 1).astype(np.float32)

    def over_bytes(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[high] - total[low]

    def over_words(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float32), begin)

    chars = np.maximum(over_bytes(LEADS[texts.data]), 1)
    of = np.repeat(np.arange(len(begin)), last - begin + 1)
    _, earlier = repeats(mix(words.hash ^ mix(of + 1)))
    same = np.zeros(len(words), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
    length = words.end - words.start
    x[passage, 0] = n / PASSAGE
    x[passage, 1] = over_words(length) / n / 8
    x[passage, 2] = over_words(length > 12) / n
    x[passage, 3] = over_words(earlier) / n
    x[passage, 4] = over_words(same) / n
    for k, members in enumerate(_CLASSES):
        x[passage, 5 + k] = over_bytes(members[texts.data]) / chars
    # Pairs of neighbouring bytes by hash: character habits beyond the counts above.
    pair = np.zeros(len(texts.data), np.int64)
    pair[1:] = (texts.data[:-1].astype(np.int64) * 31 + texts.data[1:]) * 0x9E3779B1 >> 7 & (HASHED - 1)
    of_byte = np.zeros(len(texts.data) + 1, np.int64)
    np.add.at(of_byte, low, 1)
    where = np.cumsum(of_byte[:-1]) - 1
    inside = where >= 0
    table = np.bincount(where[inside] * HASHED + pair[inside], minlength=len(begin) * HASHED).reshape(-1, HASHED)
    x[passage, 5 + len(_CLASSES) :] = table / chars[:, None]
    return x, first


class Model:
    """Encoder, gated attention and classifier."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "w": normal(WIDTH, HIDDEN), "wb": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, GATES), "vb": np.zeros(GATES, np.float32),
            "u": normal(HIDDEN, GATES), "ub": np.zeros(GATES, np.float32), "a": normal(GATES), "c": normal(HIDDEN), "cb": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["wb"])
        t, s = np.tanh(h @ p["v"] + p["vb"]), 1 / (1 + np.exp(-(h @ p["u"] + p["ub"])))
        e = (t * s) @ p["a"]
        bag, starts = np.repeat(np.arange(len(first) - 1), np.diff(first)), first[:-1]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        weight = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(weight[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "bag": bag, "weight": weight, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["cb"])))}

    def gradient(self, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        p, h, weight, bag = self.p, f["h"], f["weight"], f["bag"]
        d = (f["y"] - y) / len(y)
        dz = d[:, None] * p["c"]
        de = weight * ((h - f["z"][bag]) * dz[bag]).sum(1)
        da = de[:, None] * p["a"]
        dt, ds = da * f["s"] * (1 - f["t"] ** 2), da * f["t"] * f["s"] * (1 - f["s"])
        dh = (weight[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T) * (1 - h**2)
        return {
            "w": f["x"].T @ dh, "wb": dh.sum(0), "v": h.T @ dt, "vb": dt.sum(0), "u": h.T @ ds, "ub": ds.sum(0),
            "a": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ d, "cb": np.array([d.sum()]),
        }


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 0) -> Model | None:
    """Adam on the cross-entropy of document labels; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    every = np.concatenate(bags)
    model = Model(every.mean(0), every.std(0) + 1e-3, seed)
    rng = np.random.default_rng(seed)
    one = {k: np.zeros_like(v) for k, v in model.p.items()}
    two = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, total = 0, epochs * -(-len(bags) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            f = model.forward(np.concatenate([bags[i] for i in chosen]), first)
            step += 1
            for k, g in model.gradient(f, y[chosen]).items():
                g = g + decay * model.p[k]
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                move = one[k] / (1 - 0.9**step) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
                model.p[k] = (model.p[k] - rate * (1 - step / (total + 1)) * move).astype(np.float32)
    return model


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from."""
    return F.expr(f"crc32(coalesce(cast(`{doc_id}` as string), '')) % 3 = 1")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model | None:
    """Learn from labelled rows that are not held out; an id labelled twice counts with its smaller label."""
    marks = (
        labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("__y"))
        .withColumn("__order", F.expr("md5(cast(doc_id as string))")).orderBy("__order", "doc_id").limit(max_docs)
    )
    # At most max_docs ids and marks: the bound that allows the broadcast.
    chosen = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")

    def features(texts: Texts) -> dict[str, object]:
        x, first = passages(texts)
        return {"x": pa.array([x[first[i] : first[i + 1]].tobytes() for i in range(len(texts))], pa.binary())}

    # An id may be on any number of rows: equal ones count once, and the rows themselves are limited before they reach the driver.
    rows = per_text(chosen, features, [T.StructField("x", T.BinaryType())], ["__y", "__order"]).dropDuplicates(["__order", "x"])
    rows = rows.orderBy("__order", "x").limit(max_docs).toPandas()
    bags = [np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in rows["x"]]
    return train(bags, rows["__y"].to_numpy(np.float32)) if bags else None


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Append ``score`` (0 to 1) to every row."""

    def make(texts: Texts) -> dict[str, object]:
        if model is None or not len(texts):
            return {"score": np.full(len(texts), 0.5)}
        x, first = passages(texts)
        return {"score": np.clip(model.forward(x, first)["y"].astype(np.float64), 0, 1)}

    return per_text(docs, make, [T.StructField("score", T.DoubleType(), False)], keep, text)
