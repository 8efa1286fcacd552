"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into blocks of ``BLOCK`` bytes; two neighbouring blocks form a chunk, so
chunks overlap by half and cover the whole text.  ``FILTERS`` learned filters of
``WIDTH`` bytes run over it every ``STRIDE`` bytes; their largest response in each
chunk goes through a small hidden layer, and the mean and the largest of the chunks'
hidden values are combined into one probability.  Text, and nothing else, is input.

Fitted by back-propagation (Adam) on a bounded sample: at most ``per_class`` labelled
documents of each label outside the held-out fold.  The model has a fixed size.

Defined cases: a null or empty text is one chunk of padding and gets that score;
without labelled rows every score is 0.5; a text of any length is read in slices of
bounded memory; repeated rows are scored alike; other columns are
kept, one named like the added one replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import TEXT, add_columns, held_out, small, table, with_bytes
from emberspark.llm.labelled import labelled_sample

PER_CLASS = 2000
WIDTH, STRIDE, FILTERS, HIDDEN, BLOCK = 6, 1, 16, 16, 256
PAD = 256
EPOCHS = 8
SLICE_BLOCKS = 2048


def new_model(seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    return {"conv": (rng.standard_normal((WIDTH, PAD + 1, FILTERS)) * 0.15).astype(np.float32),
            "cb": np.full(FILTERS, 0.1, np.float32),
            "v": (rng.standard_normal((FILTERS, HIDDEN)) * 0.3).astype(np.float32), "vb": np.full(HIDDEN, 0.1, np.float32),
            "u": (rng.standard_normal(2 * HIDDEN) * 0.1).astype(np.float32), "ub": np.zeros(1, np.float32)}


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one padded array of byte values, each text's number of blocks, and its bytes."""
    n = np.array([len(t) for t in texts], np.int64)
    blocks = np.maximum(1, -(-n // BLOCK))
    flat = np.full(int(blocks.sum()) * BLOCK + WIDTH, PAD, np.int16)
    at = 0
    for t, k in zip(texts, blocks):
        flat[at:at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(k) * BLOCK
    return flat, blocks, n


def convolve(model: dict, flat: np.ndarray, lo: int, hi: int, last: np.ndarray) -> np.ndarray:
    """Responses of the filters in blocks lo to hi: (blocks, positions, filters).

    ``last`` marks the last block of a text: its windows do not reach into the next text.
    """
    view = flat[lo * BLOCK:hi * BLOCK].reshape(hi - lo, BLOCK)
    ahead = np.full((hi - lo, WIDTH), PAD, np.int16)
    inner = np.flatnonzero(~last[lo:hi])
    ahead[inner] = flat[((inner + lo + 1) * BLOCK)[:, None] + np.arange(WIDTH)]
    wide = np.concatenate([view, ahead], axis=1)
    out = model["conv"][0][wide[:, 0:BLOCK:STRIDE]]
    for k in range(1, WIDTH):
        out += model["conv"][k][wide[:, k:k + BLOCK:STRIDE]]
    out[wide[:, 0:BLOCK:STRIDE] == PAD] = -1e9
    return out


def pool(model: dict, flat: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of every filter in every block, and where it is."""
    total = int(blocks.sum())
    last = np.zeros(total, bool)
    last[np.cumsum(blocks) - 1] = True
    best = np.empty((total, FILTERS), np.float32)
    where = np.empty((total, FILTERS), np.int16)
    for lo in range(0, total, SLICE_BLOCKS):
        hi = min(total, lo + SLICE_BLOCKS)
        out = convolve(model, flat, lo, hi, last)
        best[lo:hi] = out.max(axis=1)
        where[lo:hi] = out.argmax(axis=1) if model.get("fit") else 0
    return best, where


def forward(model: dict, best: np.ndarray, blocks: np.ndarray) -> dict:
    """From block maxima to one probability a text; keeps what the gradient needs."""
    first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    last = np.zeros(len(best), bool)
    last[np.cumsum(blocks) - 1] = True
    nxt = np.arange(len(best)) + ~last  # a text's last block stands alone
    pair = np.maximum(best, best[nxt])
    h = np.maximum(pair + model["cb"], 0)
    pre = h @ model["v"] + model["vb"]
    c = np.maximum(pre, 0)
    mean = np.add.reduceat(c, first) / blocks[:, None]
    top = np.maximum.reduceat(c, first)
    z = np.concatenate([mean, top], axis=1) @ model["u"] + model["ub"]
    return {"first": first, "nxt": nxt, "pair": pair, "h": h, "pre": pre, "c": c, "mean": mean, "top": top,
            "p": 0.5 * (1 + np.tanh(0.5 * z.astype(np.float64)))}


def gradient(model: dict, flat: np.ndarray, blocks: np.ndarray, best: np.ndarray, where: np.ndarray, x: dict,
             miss: np.ndarray) -> dict:
    """Gradients for ``miss`` = weight * (p - label)."""
    miss = miss.astype(np.float32)
    doc = np.repeat(np.arange(len(blocks)), blocks)
    g = {"u": miss @ np.concatenate([x["mean"], x["top"]], axis=1), "ub": miss.sum(keepdims=True)}
    dc = (miss / blocks)[doc][:, None] * model["u"][:HIDDEN]
    is_top = x["c"] == x["top"][doc]
    ties = np.add.reduceat(is_top.astype(np.float32), x["first"])
    dc = dc + is_top * (miss[:, None] * model["u"][HIDDEN:] / ties)[doc]
    dpre = dc * (x["pre"] > 0)
    g["v"], g["vb"] = x["h"].T @ dpre, dpre.sum(axis=0)
    dpair = (dpre @ model["v"].T) * (x["h"] > 0)
    g["cb"] = dpair.sum(axis=0)
    own = best >= best[x["nxt"]]
    dbest = np.where(own, dpair, 0)
    np.add.at(dbest, x["nxt"], np.where(own, 0, dpair))
    at = (np.arange(len(best)) * BLOCK)[:, None] + where.astype(np.int64) * STRIDE
    end = np.repeat(np.cumsum(blocks) * BLOCK, blocks)[:, None]
    cols = np.broadcast_to(np.arange(FILTERS), at.shape)
    g["conv"] = np.zeros_like(model["conv"])
    for k in range(WIDTH):
        byte = np.where(at + k < end, flat[at + k], PAD).astype(np.int64)
        g["conv"][k] = np.bincount((byte * FILTERS + cols).ravel(), dbest.ravel(),
                                   minlength=(PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
    return g


def fit(texts: list[bytes], labels: list[int], weights: list[float], epochs: int = EPOCHS, batch: int = 32,
        rate: float = 4e-3) -> dict:
    """A fitted model; without texts, one that answers 0.5."""
    model = new_model()
    if not texts:
        return {**model, "u": np.zeros_like(model["u"])}
    model["fit"] = True
    y, share = np.array(labels, float), np.array(weights, float)
    names = [k for k in model if k != "fit"]
    m = {k: np.zeros_like(model[k]) for k in names}
    s = {k: np.zeros_like(model[k]) for k in names}
    rng, step = np.random.default_rng(5), 0
    steps = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), batch):
            own = order[at:at + batch]
            flat, blocks, _ = lay_out([texts[i] for i in own])
            best, where = pool(model, flat, blocks)
            x = forward(model, best, blocks)
            g = gradient(model, flat, blocks, best, where, x, share[own] * (x["p"] - y[own]) / len(own))
            step += 1
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k in names:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.01 * (g[k] ** 2 - s[k])
                model[k] -= now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)
    del model["fit"]
    return model


def score_texts(texts: list[bytes], model: dict, group_bytes: int = 4 << 20) -> np.ndarray:
    """One probability a text; texts are laid out together up to ``group_bytes``."""
    scores, at = [], 0
    while at < len(texts):
        to, held = at + 1, len(texts[at])
        while to < len(texts) and held + len(texts[to]) <= group_bytes:
            held += len(texts[to])
            to += 1
        flat, blocks, _ = lay_out(texts[at:to])
        scores.append(forward(model, pool(model, flat, blocks)[0], blocks)["p"])
        at = to
    return np.concatenate(scores) if scores else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    """A model from the labelled documents outside the held-out fold (at most ``per_class`` of each label)."""
    return fit(*labelled_sample(docs, labels, label, per_class))


def score_quality(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with ``quality_score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame, schema = with_bytes(docs, text, keep, "quality_score double")

    def run(batches):
        for b in small(batches):
            scores = score_texts(b.column(TEXT).to_pylist(), shared.value)
            yield add_columns(b, [pa.array(scores, pa.float64())], ["quality_score"])

    return frame.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return score_quality(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out("doc_id", 5).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


SQL: dict[str, str] = {}
