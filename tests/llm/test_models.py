"""Classifiers and the language model: held-out accuracy, brute force, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from helpers import LOWER, SCHEMA, write_tables
from emberspark.llm import labelled
from emberspark.llm import lmscore as L
from emberspark.llm import quality as Q
from emberspark.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


@pytest.mark.parametrize("query,label,least", [(Q.op2_quality, "quality", 0.95), (T.op9_toxicity, "toxic", 0.97)])
def test_held_out_accuracy(spark, labels, query, label, least):
    rows = [r for r in query(spark, SF).select("doc_id", "held_out", "score", "predicted").collect()]
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    own = [(r.predicted, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(own) > 300 and sum(p == y for p, y in own) / len(own) >= least


def test_offending_sentences_are_located(spark):
    docs = spark.createDataFrame([(i, f"Nice day number {i}. You are a é{'grumble' if i % 2 else 'friend'} indeed! Bye\nnow", "en", "s", 1)
                                  for i in range(400)], SCHEMA)
    marks = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    model = T.train(docs, marks)
    for r in T.score_toxicity(docs, model).collect():
        assert (r.toxic_score >= 0.5) == bool(r.doc_id % 2)
        assert ["grumble" in r.text[s.start:s.end] for s in r.offending] == [True] * (r.doc_id % 2)


def test_clean_sentences_add_nothing_however_many():
    bad, good = b"you are a grumble.", b"the day is fine. we walk home."
    model = T.fit([good + bad] * 40 + [good] * 200, [1] * 40 + [0] * 200, [1.0] * 240)
    scores, _ = T.score_texts([good, good * 20000, b"zq xv. " * 20000, good * 20000 + bad, b""], model, {})
    assert (scores[[0, 1, 2, 4]] < 0.5).all() and scores[3] >= 0.5
    assert scores[2] == scores[4] == pytest.approx(float(T.sigmoid(np.array(model["bias"]))))


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (0, 5, 256, 700, 512)]
    model = {**{k: v.astype(np.float64) for k, v in Q.new_model().items()}, "fit": True}
    y = np.array([0, 1, 0, 1, 1.0])

    def loss(m):
        flat, blocks, _ = Q.lay_out(texts)
        best, where = Q.pool({k: v for k, v in m.items()}, flat, blocks)
        x = Q.forward(m, best, blocks)
        return -(y * np.log(x["p"]) + (1 - y) * np.log(1 - x["p"])).sum(), (flat, blocks, best, where, x)

    _, (flat, blocks, best, where, x) = loss(model)
    g = Q.gradient(model, flat, blocks, best, where, x, x["p"] - y)
    for k, at in (("u", (3,)), ("ub", (0,)), ("v", (2, 4)), ("vb", (1,)), ("cb", (5,))):
        up, down = dict(model), dict(model)
        up[k], down[k] = model[k].copy(), model[k].copy()
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert abs((loss(up)[0] - loss(down)[0]) / 2e-3 - g[k][at]) < 2e-2 * max(1, abs(g[k][at]))


def test_one_text_scores_alike_in_any_company():
    texts = [b"", b"abc", b"x" * 3000, "é日".encode() * 900]
    model = Q.new_model()
    alone = [Q.score_texts([t], model)[0] for t in texts]
    assert np.allclose(Q.score_texts(texts, model), alone) and np.allclose(Q.score_texts(texts[::-1], model), alone[::-1])


def test_without_labels_and_odd_rows(spark, odd, none, clashing):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (empty, nulls):
        folder = write_tables(spark, documents=odd, labels=marks)
        for q in (Q.op2_quality, T.op9_toxicity):
            rows = q(spark, folder).collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.score_toxicity(none, T.fit([], [], [])).count() == 0
    assert T.score_toxicity(clashing, T.fit([], [], [])).where("toxic_score = 0").count() == odd.count()
    assert Q.score_quality(clashing, Q.fit([], [], [])).where("quality_score = 0.5").count() == odd.count()


def test_lm_base_and_probability(spark, odd):
    rows = [r for r in L.op1_lm(spark, write_tables(spark, documents=odd)).collect()]
    texts = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER)) + [None]) for r in odd.collect()]
    c = Counter(w for i, t in texts if i is not None and crc(i, 10) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(t), sum(w in c for w in t), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6))
                   for i, t in texts)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.train_tokens == n and r.held_out == (r.doc_id is None or crc(r.doc_id, 10) == 0) and r.score < 0 for r in rows)


def test_lm_bits_sum_to_one():
    """The probabilities of all 256 next bytes sum to one under each set of weights."""
    rng = np.random.default_rng(1)
    tab = L.odds(rng.integers(0, 9, L.SLOTS).astype(float), rng.integers(0, 9, L.SLOTS).astype(float))
    w = [x * rng.random(x.shape).astype(np.float32) for x in L.new_weights()]
    key = (np.uint64(0x616263646566) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert np.allclose(np.exp(L.predict(key, tab, w).astype(float)).sum(axis=1), 1, atol=1e-4)


def test_lm_batches_do_not_matter():
    rng = random.Random(3)
    texts = [L.normal(bytes(rng.choice(b"abc de") for _ in range(rng.randint(0, 400)))) for _ in range(50)]
    counts = np.zeros(2 * L.SLOTS, np.uint32)
    L.count_bits(*np.unique(L.keys_of(texts)[0], return_counts=True), counts)
    assert counts.sum() == sum(map(len, texts)) * 8 * len(L.ORDERS)
    tab = L.odds(counts[0::2].astype(float), counts[1::2].astype(float))
    w = L.learn(texts[:20], np.minimum(counts, 65535).astype(np.uint16), L.new_weights())
    alone = [L.score_texts([t], tab, w)[0] for t in texts]
    assert np.allclose(L.score_texts(texts, tab, w), alone)
    # the mixture of a text's blocks, step by step
    key, n = L.keys_of([texts[0]])
    p = L.predict(key, tab, w).astype(float)
    belief, total = np.full(2, 0.5), 0.0
    for at in range(0, len(key), L.BLOCK):
        a = belief * np.exp(p[:, at:at + L.BLOCK].sum(axis=1))
        total += math.log(a.sum())
        belief = (1 - L.SHARE) * a / a.sum() + L.SHARE / 2
    assert abs(total - alone[0]) < 1e-4
    assert sum(alone) / sum(map(len, texts)) > -math.log(5)  # learned: six symbols at random


def test_lm_empty(spark):
    assert L.op1_lm(spark, write_tables(spark, documents=([], SCHEMA))).count() == 0


def test_sample_is_one_block_of_memory(spark):
    """The driver holds the sample's texts in Arrow, not as thousands of objects; fits read them one by one, with the same model."""
    rows = [(i, f"{'vile' if i % 3 == 0 else 'nice'} words {i} " * 20, int(i % 3 == 0)) for i in range(120)] + [(500, None, 1), (None, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts, y, weights = labelled.labelled_sample(frame, frame, "toxic", 100)
    want = {i: (t or "").encode() for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 5}
    assert isinstance(texts, labelled.Texts) and [texts[i] for i in range(len(texts))] == list(texts) == [want[i] for i in sorted(want)]
    assert y == [int(i % 3 == 0) if i < 500 else 1 for i in sorted(want)] and abs(sum(weights) - len(y)) < 1e-9
    assert T.fit(texts, y, weights) == T.fit(list(texts), y, weights)
    none = labelled.labelled_sample(frame, frame.where("false"), "toxic", 100)
    assert len(none[0]) == 0 and none[1:] == ([], []) and T.fit(*none)["weights"] == {}
