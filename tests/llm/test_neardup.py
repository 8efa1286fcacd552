import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import LOWER, SCHEMA, odd_documents, same_rows, words, write_tables
from emberspark.llm import neardup as N
from emberspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, k):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    k = min(k, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, k):
    rows = [(d, sets_of(t, k)) for d, t in rows if d is not None]
    label = {d: d for d, _ in rows}
    changed = True
    links = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def family(rng, n, size, edits):
    base = words(rng, size).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(size)] = words(rng, 1)
        out.append(" ".join(own))
    return out


def corpus():
    """A large family of near copies, families around the threshold, a passage that many share, chains."""
    rng = random.Random(5)
    texts = family(rng, 150, 150, 5) + [t for _ in range(25) for t in family(rng, 6, 90, 5)]
    passage = words(rng, 60)
    texts += [passage + " " + words(rng, rng.randint(20, 120)) for _ in range(150)]
    step = words(rng, 100).split()
    for i in range(40):  # each is linked with the next only
        texts.append(" ".join(step))
        step = step[4:] + words(rng, 4).split()
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("k", [4, 5])
def test_finds_every_class(spark, k):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, k).collect()}
    assert got == brute(rows, k)


def test_query_matches_sql(spark, odd):
    folder = write_tables(spark, documents=odd.where("doc_id is not null").dropDuplicates(["doc_id"]))
    same_rows(N.op4_neardup(spark, folder), N.SQL["op4_neardup"], folder)


def test_odd_rows(spark, odd, none, clashing):
    got = N.near_duplicates(odd, 4).collect()
    assert len(got) == odd.count()
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    label = brute([(r[0], r[1]) for r in odd_documents()], 4)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == label
    assert N.near_duplicates(none).count() == 0
    assert N.near_duplicates(clashing, 4).count() == odd.count()


def test_one_row_of_each_class_stays(spark, odd):
    left = N.keep_one(odd, 4).collect()
    label = brute([(r[0], r[1]) for r in odd_documents()], 4)
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted(set(label.values()))
    assert sum(r.doc_id is None for r in left) == 2 and left[0].__fields__ == odd.columns


def test_components_of_odd_graphs(spark):
    path = [(i, i + 1) for i in range(30)]
    star = [(100, x) for x in range(101, 140)]
    edges = path + star + [(5, 5), (200, 201), (201, 200), (139, 300), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200, 300: 100, 301: 100}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_stay_whole_after_a_join_on_their_keys(spark):
    from emberspark.llm.common import gathered
    df = spark.range(1000).select((F.col("id") % 50).alias("node"), "id")
    plan = gathered(df.join(df.groupBy("node").count(), "node"), ["node"])._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64(node" in plan and "REPARTITION_BY_COL" in plan


def close_family(n, size, edits, seed=9):
    """Texts of one mould whose similarity lies below the threshold."""
    rng = random.Random(seed)
    base = words(rng, size).split()
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(0, size, 5), edits):
            own[at] = words(rng, 1)
        out.append(" ".join(own))
    return out


def test_pairs_met_often_name_their_documents_once(spark, monkeypatch):
    """A pair below the threshold is in some 15 root nodes; its documents are named in the first of them."""
    texts = [t for s in range(20) for t in close_family(8, 100, 3, seed=s)]
    named = []
    whole = N._doubtful
    monkeypatch.setattr(N, "_doubtful", lambda *a: named.append(whole(*a)) or named[-1])
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, 4).collect()}
    assert got == brute(list(enumerate(texts)), 4)
    assert named and 0 < sum(d.count() for d in named) < 4 * len(texts)


def test_nodes_that_do_not_shrink_branch_once(spark, monkeypatch):
    """Branching of a large family just below the threshold makes few rows, and its links are still found."""
    texts = close_family(300, 100, 2)
    rows = []
    whole = N._branch
    monkeypatch.setattr(N, "_branch", lambda m: rows.append(whole(m)) or rows[-1])
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, 4).collect()}
    assert got == brute(list(enumerate(texts)), 4)
    assert sum(d.count() for d in rows[1:]) < 2 * len(N.CHOICES) * len(texts)
