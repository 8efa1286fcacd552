"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of the
weights of its words and of their first four and five bytes; a document's score is
the noisy-or of its sentences.  It is fitted as 1 - prod(1 - p); in scoring the bias p0 of
all sentences counts once a document, 1 - (1 - p0) prod(1 - q), and what a sentence adds
is its evidence beyond it, q = (p - p0) / (1 - p0), or nothing if
that is negative, so that clean sentences add nothing however many there are.  Only
document labels are needed: the gradient of the noisy-or reaches the sentences in
proportion to their share in it, so the weights settle on the words that make a
document toxic, and the sentences that carry them are located with the same weights.

The model is fitted on a bounded sample (``per_class`` labelled documents of each
label outside the held-out fold, of any length, 64 MB in all) and is a table of at most
``MAX_FEATURES`` weights (those in most documents); scoring reads every sentence of every text.

Defined cases: a null or empty text has one empty sentence, so its score is that of
the bias alone; without labelled rows every score is 0.0; without rows of one label
the model learns the other; repeated rows are scored alike; other columns are kept,
those named like the added ones replaced.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import TEXT, add_columns, held_out, small, table, with_bytes
from emberspark.llm.labelled import labelled_sample

PER_CLASS = 4000
MAX_FEATURES = 200_000
MIN_DOCS = 3
EPOCHS = 25
END = b"\x01"
ENDERS = b".!?\n"
# A-Z to a-z; sentence ends to END; every other ASCII byte that is not a letter or digit to a blank.
NORMAL = bytes(1 if b in ENDERS else b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))


def words_and_ends(text: bytes) -> list[bytes]:
    """The words of a text, with END behind each sentence but the last."""
    return text.translate(NORMAL).replace(END, b" \x01 ").split()


def features(word: bytes) -> tuple[bytes, ...]:
    return (word, b"4" + END + word[:4], b"5" + END + word[:5])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def log_clean(z: np.ndarray, bias: float) -> np.ndarray:
    """log(1 - q) of sentences: how much cleaner than the bias alone they leave a document, never above 0."""
    return np.minimum(np.logaddexp(0, bias) - np.logaddexp(0, z), 0)


def fit(texts: list[bytes], labels: list[int], weights: list[float], epochs: int = EPOCHS, batch: int = 256,
        rate: float = 0.3, sparse: float = 1e-4) -> dict:
    """Noisy-or regression by Adagrad with a lasso; returns ``{"bias": float, "weights": {feature: float}}``."""
    if not texts:
        return {"bias": -np.inf, "weights": {}}
    seen: dict[bytes, int] = {}  # feature -> documents
    for text in texts:
        for f in {f for word in set(words_and_ends(text)) if word != END for f in features(word)}:
            seen[f] = seen.get(f, 0) + 1
    common = sorted((f for f, n in seen.items() if n >= MIN_DOCS), key=lambda f: (-seen[f], f))[:MAX_FEATURES]
    del seen
    index = {f: i for i, f in enumerate(common)}
    # all texts' features one after another: blocks that are given back as a whole
    ids, sentence, ends, counts = array("i"), array("i"), [0], []
    for text in texts:
        k, said = 0, set()
        for word in words_and_ends(text):
            if word == END:
                k += 1
                said.clear()
            elif word not in said:  # a word counts once in a sentence
                said.add(word)
                for f in features(word):
                    if (i := index.get(f)) is not None:
                        ids.append(i)
                        sentence.append(k)
        ends.append(len(ids))
        counts.append(k + 1)
    del index
    ids, sentence = (np.frombuffer(x, np.int32) if x else np.zeros(0, np.int32) for x in (ids, sentence))
    docs = [(ids[x:y], sentence[x:y], k) for x, y, k in zip(ends, ends[1:], counts)]
    y, share = np.array(labels, float), np.array(weights, float)
    w, bias = np.zeros(len(common)), -6.0
    w2, bias2 = np.full(len(common), 1e-3), 1.0
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), batch):
            own = order[at:at + batch]
            n = np.array([docs[d][2] for d in own])
            first = np.concatenate([[0], np.cumsum(n)])
            ids = np.concatenate([docs[d][0] for d in own])
            sent = np.concatenate([docs[d][1] + f for d, f in zip(own, first)])
            z = np.bincount(sent, w[ids], minlength=first[-1]) + bias
            p = sigmoid(z)
            clean = np.add.reduceat(-np.logaddexp(0, z), first[:-1])  # log of prod(1 - p)
            none = np.exp(clean)
            pull = np.where(y[own] == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * share[own]
            g = np.clip(np.repeat(pull, n) * p, -5, 5)
            gw = np.bincount(ids, g[sent], minlength=len(w))
            w2 += gw * gw
            pace = rate / np.sqrt(w2)
            w -= pace * gw
            w = np.sign(w) * np.maximum(np.abs(w) - pace * sparse * len(own), 0)  # words without bearing go to zero
            gb = float(g.sum())
            bias2 += gb * gb
            bias -= rate * gb / np.sqrt(bias2)
    return {"bias": float(bias), "weights": {f: float(x) for f, x in zip(common, w) if x}}


def score_texts(texts: list[bytes], model: dict, memo: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document scores, and for each document the scores of its sentences."""
    get, bias = model["weights"].get, model["bias"]
    if len(memo) > 200_000:
        memo.clear()
    memo[END] = None
    scores, parts = np.zeros(len(texts)), []
    for d, text in enumerate(texts):
        words = words_and_ends(text)
        for word in set(words).difference(memo):
            memo[word] = sum(get(f, 0.0) for f in features(word))
        values = np.array([memo[x] for x in words], dtype=float)  # an end is nan
        end = np.isnan(values)
        z = np.full(int(end.sum()) + 1, bias)
        said = set()  # a word counts once in a sentence
        sentence = np.cumsum(end)
        for i in np.flatnonzero(~end & (values != 0)):
            if (at := (sentence[i], words[i])) not in said:
                said.add(at)
                z[at[0]] += values[i]
        scores[d] = -np.expm1(log_clean(z, bias).sum() - np.logaddexp(0, bias)) if np.isfinite(bias) else 0.0
        parts.append(sigmoid(z))
    return np.clip(scores, 0.0, 1.0), parts


def locate(text: bytes, sentence_scores: np.ndarray, least: float) -> list[dict]:
    """Code-point spans (end exclusive) of the sentences with at least the given score."""
    out = []
    if (sentence_scores >= least).any():
        raw = np.frombuffer(text, np.uint8)
        stops = np.append(np.flatnonzero(np.isin(raw, np.frombuffer(ENDERS, np.uint8))), len(raw))
        lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        for k in np.flatnonzero(sentence_scores >= least):
            out.append({"start": int(lead[stops[k - 1] + 1 if k else 0]), "end": int(lead[stops[k]]),
                        "score": float(sentence_scores[k])})
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> dict:
    """A model from the labelled documents outside the held-out fold (at most ``per_class`` of each label)."""
    return fit(*labelled_sample(docs, labels, label, per_class))


def score_toxicity(docs: DataFrame, model: dict, text: str = "text", least: float = 0.5,
                   keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with ``toxic_score`` and ``offending`` (the sentences scoring ``least`` or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame, schema = with_bytes(docs, text, keep, "toxic_score double, offending array<struct<start:long,end:long,score:double>>")

    def run(batches):
        model, memo = shared.value, {}
        for b in small(batches):
            texts = b.column(TEXT).to_pylist()
            scores, parts = score_texts(texts, model, memo)
            found = pa.array([locate(t, p, least) for t, p in zip(texts, parts)],
                             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
            yield add_columns(b, [pa.array(scores, pa.float64()), found], ["toxic_score", "offending"])

    return frame.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and its offending sentences."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out("doc_id", 5).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "offending")


SQL: dict[str, str] = {}
