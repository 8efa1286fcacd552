import random

from helpers import same_rows, write_tables
from emberspark.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=600, dim=24):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dim)], 0) for i in range(n)]
    hot = [rng.gauss(0, 0.3) for _ in range(dim)]
    rows += [(1000 + i, hot, 1) for i in range(200)]  # ties
    rows += [(2000, None, 0), (2020, [None] * dim, 0), (2040, [float("nan")] * dim, 0), (2060, [float("inf")] + [0.0] * (dim - 1), 0),
             (2080, [0.5] * 3, 0), (2081, [0.25] * 3, 0), (None, hot, 0)]
    return rows


def brute(rows, k):
    import math
    good = [(v, [math.floor(64 * x) for x in e]) for v, e in rows
            if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, x in good:
        if q % 20 == 0:
            own = sorted((-sum(a * b for a, b in zip(x, y)), v) for v, y in good if v != q and len(y) == len(x))[:k]
            out += [(q, r + 1, v, -s) for r, (s, v) in enumerate(own)]
    return sorted(out)


def test_matches_brute_force_for_any_blocks(spark):
    df = spark.createDataFrame(vectors(), SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    v = K.quantize(df).cache()
    for block, queries, k in ((8192, 512, 20), (100, 7, 20), (64, 64, 3)):
        got = K.search(v, v.where("vec_id % 20 = 0"), k, block, queries)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, k)


def test_query_matches_sql(spark):
    rows = [r for r in vectors() if r[0] is not None and r[1] is not None and r[1][0] is not None]
    folder = write_tables(spark, embeddings=(rows, SCHEMA))
    same_rows(K.op7_topk(spark, folder), K.SQL["op7_topk"], folder)


def test_empty_table(spark):
    assert K.op7_topk(spark, write_tables(spark, embeddings=([], SCHEMA))).count() == 0
