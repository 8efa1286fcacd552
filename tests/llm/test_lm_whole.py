"""The language model over a whole corpus: exact contexts, weights from every training text."""

import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from helpers import SCHEMA, write_tables
from emberspark.llm import lmscore as L


def clashing_words(n=20_000):
    """Two words whose six-byte contexts share a slot of the hashed table."""
    rng, seen = random.Random(5), {}
    for _ in range(n):
        word = "".join(rng.choice("abcdefghij") for _ in range(6))
        key = L.keys_of([word.encode() + L.END])[0][-1:]
        at = int(L.contexts(key)[-1][0])
        if seen.setdefault(at, word)[-3:] != word[-3:]:
            return seen[at], word
    raise AssertionError("no clash")


def documents():
    a, b = clashing_words()
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice([a, "other", "words", "né"]) + rng.choice("xyz ") for _ in range(60)), "en", "s", 1) for i in range(40)]
    return rows + [(i, (b + "q ") * 20, "en", "s", 1) for i in range(40, 60)] + [(None, b + "x", "en", "s", 1), (60, None, "en", "s", 0)]


def test_scores_rest_on_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(L, "COUNTED", 3000)  # several runs
    monkeypatch.setattr(L, "PART_BYTES", 5000)  # and several parts
    docs = spark.createDataFrame(documents(), SCHEMA)
    folder = write_tables(spark, documents=docs)
    got = {(r.doc_id, round(r.score, 9)) for r in L.op1_lm(spark, folder).collect()}
    frame = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    weights = L.train(frame)[3]
    counts = defaultdict(lambda: [0, 0])

    def bits(text):
        raw = bytes(L.HEAD) + L.normal(text)
        for at in range(L.HEAD, len(raw)):
            node = 1
            for k in range(8):
                yield k, node, raw[at] >> (7 - k) & 1, [(raw[at - o:at], node) for o in L.ORDERS]
                node = 2 * node + (raw[at] >> (7 - k) & 1)

    for i, t, *_ in documents():
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            for _, _, bit, places in bits((t or "").encode()):
                for place in places:
                    counts[place][bit] += 1
    scores = defaultdict(list)
    for i, s in got:
        scores[i].append(s)
    for i, t, *_ in documents():
        cost = []
        for k, node, bit, places in bits((t or "").encode()):
            v = [L.odds(*np.array([[float(x)] for x in counts.get(p, (0, 0))])) for p in places]
            z = [sum(w[o, g[0]] * (v[o][0] >> 2) / 256 for o in range(len(v))) for w, g in zip(weights, L.gates(v, np.array([node]), k))]
            cost.append(-np.log1p(np.exp(np.array(z) * (1 - 2 * bit))))
        p = np.array(cost).reshape(-1, 8, 2).sum(axis=1).T
        want = L.combine(p, np.array([p.shape[1]]))[0] / np.log(10)
        assert any(abs(want - s) < 2e-3 * abs(want) + 1e-3 for s in scores[i]), (i, want, scores[i])


def test_what_is_kept_grows_with_the_corpus(spark):
    """Distinct strings of the training texts, each with its count: none is added into another's."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(3000)) for _ in range(40)]
    frame = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string").withColumn("text", F.col("text").cast("binary"))
    kept = []
    for n in (10, 40):
        whole = L.train(frame.where(F.col("doc_id") < n))[1]
        mine = [L.opened(bytes(r.names), bytes(r.times)) for r in whole.collect()]
        want, times = np.unique(L.keys_of([L.normal(t.encode()) for i, t in enumerate(texts[:n]) if zlib.crc32(str(i).encode()) % 10])[0], return_counts=True)
        key, c = np.concatenate([k for k, _ in mine]), np.concatenate([c.sum(axis=1) for _, c in mine])
        order = np.argsort(key[c > 0])
        assert (key[c > 0][order] == want).all() and (c[c > 0][order] == times).all()
        kept.append(len(want))
    assert kept[1] > 3 * kept[0]


def test_long_texts_teach_the_weights(spark):
    """A corpus of texts above 65,536 bytes alone moves the weights from their start."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    rows = [(i, i, " ".join(rng.choice(words) for _ in range(15_000))) for i in range(8)]
    frame = spark.createDataFrame(rows, "row long, doc_id long, text string").withColumn("text", F.col("text").cast("binary"))
    weights = L.train(frame)[3]
    assert all((abs(w - L.START) > 0.05).any(axis=0).sum() > 20 for w in weights)


def test_a_run_names_each_string_once(spark, monkeypatch):
    """What a task reads names a string once, however many pieces its texts are counted in; runs end at ``RUN_BYTES``."""
    monkeypatch.setattr(L, "COUNTED", 2000)
    text = "the same words again and again " * 30
    frame = spark.createDataFrame([(i, i, text, 0) for i in range(40)], "row long, doc_id long, text string, fold int").withColumn(
        "text", F.col("text").cast("binary")).coalesce(1)

    def runs():
        return L.named(frame, 1).where("part >= 0").collect()

    whole = runs()
    assert len(whole) == 1
    key, times = np.unique(L.keys_of([L.normal(text.encode())] * 40)[0], return_counts=True)
    assert (L.unpack_names(bytes(whole[0].names)) >> np.uint64(4) == key).all() and (L.unpack(bytes(whole[0].times), np.uint32) == times).all()
    monkeypatch.setattr(L, "RUN_BYTES", 10_000)
    cut = runs()
    assert len(cut) > 2 and len({r.batch for r in cut}) == len(cut)
    assert sum(L.unpack(bytes(r.times), np.uint32).astype(int).sum() for r in cut) == times.sum()


def test_runs_do_not_change_scores(spark, monkeypatch):
    folder = write_tables(spark, documents=spark.createDataFrame(documents(), SCHEMA))
    found = []
    for counted, run in ((4 << 20, 32 << 20), (2000, 5000), (500, 400)):
        monkeypatch.setattr(L, "COUNTED", counted)
        monkeypatch.setattr(L, "RUN_BYTES", run)
        found.append(sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in L.op1_lm(spark, folder).collect()))
    assert found[0] == found[1] == found[2]


def test_predictions_are_found_by_key():
    """Also key zero, and keys that share a place with others."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 5000):
        key = np.unique(np.append(rng.integers(0, 1 << 56, n, dtype=np.uint64), np.uint64(0)))
        value = rng.normal(size=(len(key), len(L.GATES))).astype(np.float16)
        order = rng.permutation(len(key))
        told = L.Told(key[order], value[order].view(np.uint32).ravel())
        ask = rng.integers(0, len(key), 3 * n)
        assert (told.of(key[ask]) == value[ask].T.astype(np.float32)).all()
        assert told.of(key[:0]).shape == (len(L.GATES), 0)


def test_slopes_by_prefix_are_those_of_single_strings():
    """Strings that agree so far are taken together; the sums are those of each alone."""
    rng = random.Random(6)
    texts = [L.normal("".join(rng.choice("abc ") for _ in range(300)).encode()) for _ in range(8)]
    names = np.concatenate([(L.keys_of([t])[0] << np.uint64(4)) | np.uint64(i % L.FOLDS) for i, t in enumerate(texts)])
    names, times = np.unique(names, return_counts=True)
    two = L.by_fold(*L.added_up((L.shortened(names >> np.uint64(4), 2) << np.uint64(4)) | (names & np.uint64(15)), times))
    counted = L.Counted(*L.by_fold(names, times), two)
    weights = [w + np.float32(0.01) * np.arange(w.shape[1], dtype=np.float32) % 1 for w in L.new_weights()]
    got = counted.slopes(weights)
    want = [np.zeros_like(x) for x in got]
    for k, bit, node, found in counted.bits():
        for f in range(L.FOLDS):
            for i in np.flatnonzero(counted.counts[:, f]):
                v = [L.odds(*(m.sum(axis=1)[p[i]:p[i] + 1] - m[p[i], f] for m in (n0, n1))) for n0, n1, p in found]
                x = np.array([(o[0] >> 2) / 256 for o in v])
                for total, w, g in zip(want, weights, L.gates(v, node[i:i + 1], k)):
                    p = 1 / (1 + np.exp(-(w[:, g[0]] * x).sum()))
                    t = counted.counts[i, f]
                    total[g[0], :len(x)] += t * (bit[i] - p) * x
                    total[g[0], len(x):] += [t * p * (1 - p) * x[a] * x[b] for a, b in L.PAIRS]
    for x, y in zip(got, want):
        assert np.allclose(x, y, rtol=1e-4, atol=1e-3)
