import random

import numpy as np
import pytest
import xxhash

from helpers import LOWER, SCHEMA, odd_documents, words, write_tables
from emberspark.llm import simhash as S


def plain_fingerprint(text):
    w = (text or "").translate(LOWER)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64(" ".join(w[i:i + k]).encode(), seed=42).intdigest() for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def plain_classes(rows):
    rows = [(d, plain_fingerprint(t)) for d, t in rows if d is not None]
    pairs = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if (x ^ y).bit_count() <= 2]
    return classes(pairs, {d for d, _ in rows})


def near_prints(rng, families=20, size=30):
    """Families around random fingerprints, at distances up to 6, and lone ones; some bits always agree."""
    out = set()
    for _ in range(families):
        base = rng.getrandbits(64) & ~0xFFFF | 0x1234
        out |= {base ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for _ in range(size)}
    return sorted(out | {rng.getrandbits(64) for _ in range(300)})


def test_fingerprints_match_a_plain_version(spark, odd):
    got = {(r.doc_id, r.fingerprint) for r in S.simhash_classes(odd).collect()}
    assert got == {(r[0], f"{plain_fingerprint(r[1]):016x}") for r in odd_documents()}


def test_long_texts_in_parts(monkeypatch):
    text = words(random.Random(3), 500)
    monkeypatch.setattr(S, "WORDS", 7)
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_query_matches_brute_force(spark, odd):
    folder = write_tables(spark, documents=odd)
    got = {r.doc_id: r.component_id for r in S.op11_simhash(spark, folder).collect()}
    want = plain_classes([(r[0], r[1]) for r in odd_documents()])
    assert got == {**want, None: None}


@pytest.mark.parametrize("limit", [S.LIMIT, 8])
@pytest.mark.parametrize("parts", [(1,), (2,), (3,), (4,), (1, 2, 3)])
def test_forest_connects_all_links(spark, monkeypatch, limit, parts):
    monkeypatch.setattr(S, "PARTS", parts)
    prints = near_prints(random.Random(7), 6, 25)
    signed = {p: int(np.uint64(p).view(np.int64)) for p in prints}
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp long").repartition(3)
    back = {x: p for p, x in signed.items()}
    found = [(back[r.a], back[r.b]) for r in S.links(df, 2, limit).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    every = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2]
    assert classes(found, prints) == classes(every, prints)


def test_thresholds_keep_their_sum_and_avoid_crowded_parts():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2 ** 64, 1000, np.uint64)
    masks = S.group_bits(sample, 3)
    assert np.bitwise_or.reduce(masks) == np.uint64(2 ** 64 - 1) and sum(int(m).bit_count() for m in masks) == 64
    crowded = np.where(rng.random(1000) < 0.9, sample & ~masks[0], sample)
    t, cost = S.thresholds(crowded, masks, crowded, 1e6, 2)
    assert (t.sum(axis=1) == 2 - 3 + 1).all() and (cost > 0).all()
    assert (t[(crowded & masks[0]) == 0][:, 0] == -1).mean() > 0.9


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (2000, 64)).astype(np.uint64)
    for i in range(8):  # bits 0, 8, 16, ... repeat bit 0
        bits[:, 8 * i] = bits[:, 0]
    sample = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    alike = sum(1 << 8 * i for i in range(8))
    assert any(int(m) & alike == alike for m in S.group_bits(sample, 3))


def test_odd_tables(spark, odd, none, clashing):
    assert S.simhash_classes(none).count() == 0
    assert S.simhash_classes(clashing).count() == odd.count()
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5),
            (4, "x y z", "en", "s", 5), (4, "a b c", "en", "s", 5), (5, "x y z", "en", "s", 5)]
    got = {(r.doc_id, r.component_id) for r in S.simhash_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, None)}
