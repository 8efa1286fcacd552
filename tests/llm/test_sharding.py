import zlib
from collections import Counter

import numpy as np

from helpers import write_tables
from emberspark.llm import sharding as S


def test_exact_sizes_and_gapless_slots(spark, odd):
    folder = write_tables(spark, documents=odd)
    rows = S.op8_shard(spark, folder).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == odd.count() and max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_many_buckets_a_shard(spark):
    df = spark.range(0, 5000, 1, 7)
    got = S.shuffle_into_shards(df, shards=3, bucket_rows=100).collect()
    assert sorted(r.id for r in got) == list(range(5000))
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    again = S.shuffle_into_shards(df, shards=3, bucket_rows=100).collect()
    assert {r.id: (r.shard, r.slot) for r in got} == {r.id: (r.shard, r.slot) for r in again}


def test_rows_of_the_matrix_add_up():
    sizes, _, _ = S.bucket_sizes(1000, 16, 20)
    before = np.concatenate([[0], np.cumsum([0, 400, 1, 0, 599])])
    rows = [S.matrix_row(sizes, before, p, 5) for p in range(5)]
    assert (sum(rows) == sizes).all()
    assert [r.sum() for r in rows] == [0, 400, 1, 0, 599]


def test_every_place_is_as_likely():
    # one row of a partition of 3 among 6 rows: its chance to land in the first of two buckets is a half
    sizes = np.array([3, 3])
    first = [S.matrix_row(sizes, np.array([0, 2, 6]), 0, seed)[0] for seed in range(4000)]
    share = np.bincount(first, minlength=3) / 4000  # hypergeometric: 0.2, 0.6, 0.2
    assert abs(share - [0.2, 0.6, 0.2]).max() < 0.04


def test_empty_and_clashing(spark, none, clashing):
    assert S.shuffle_into_shards(none).count() == 0
    got = S.shuffle_into_shards(clashing)
    assert got.count() == clashing.count() and dict(got.dtypes)["shard"] == "int"


def test_draws_beyond_numpy(monkeypatch):
    rng = np.random.default_rng(3)
    sizes, _, _ = S.bucket_sizes(5_000_000_000, 16, 1_000_000_000)
    before = np.cumsum([0, 3_000_000_000, 1, 0, 1_999_999_999])
    rows = [S.matrix_row(sizes, before, p, 5) for p in range(4)]
    assert (sum(rows) == sizes).all() and [int(r.sum()) for r in rows] == [3_000_000_000, 1, 0, 1_999_999_999]
    # mean and deviation of large draws
    good, bad, drawn = 30_000_000_000, 70_000_000_000, 10_000_000_000
    x = np.array([S.hypergeometric(rng, good, bad, drawn) for _ in range(4000)], float)
    sd = (drawn * 0.3 * 0.7 * (1 - drawn / 1e11)) ** 0.5
    assert abs(x.mean() - 3e9) < 5 * sd / 4000 ** 0.5 and abs(x.std() / sd - 1) < 0.06
    # the same sampler on a small population has the law itself
    monkeypatch.setattr(S, "LARGE", 0)
    got = np.bincount([S.hypergeometric(rng, 7, 11, 6) for _ in range(20000)], minlength=7) / 20000
    from math import comb
    want = np.array([comb(7, k) * comb(11, 6 - k) / comb(18, 6) for k in range(7)])
    assert abs(got - want).max() < 0.015
    assert S.hypergeometric(rng, 5, 0, 3) == 3 and S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 4, 4, 8) == 4
