import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import same_rows, write_tables
from emberspark.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Every node from whole sequences, its subtree by comparing beginnings."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, t = role or "", text or ""
            key = hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0, key), (r, t)))
    turns = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in convs.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(set)
    for seq in members:
        if seq:
            children[seq[:-1]].add(seq)
    leaves, saved = defaultdict(int), defaultdict(int)
    for seq in members:
        gain = (len(members[seq]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        for d in range(len(seq) + 1):
            saved[seq[:d]] += gain
            leaves[seq[:d]] += not children[seq]
    return sorted((min(m), len(seq), min(members[seq[:-1]]) if seq else None, len(m), len(children[seq]), leaves[seq], saved[seq],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if whole[c] == seq))).encode()).hexdigest())
                  for seq, m in members.items())


def conversations(seed=4, n=300):
    """Few different turns, so that beginnings meet; copies, long ones, ties, nulls and repeats."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, turn, rng.choice(["user", None]) if turn == 3 else "user", rng.choice(["a b", "c", "Das Ü", "", None])))
    rows += [(c, t, "user", "hot turn") for c in range(1000, 1100) for t in range(5)]
    rows += [(2000 + k, t, "u", f"{t % 7} x") for k in range(3) for t in range(60 + 5 * k)]
    rows += [(3000, None, "u", "first"), (3000, 1, "u", "tie b"), (3000, 1, "u", "tie a"), (3000, 1, "u", "tie a"), (3000, 2, None, None),
             (None, 1, "u", "nobody's"), (-7, 0, "u", "a b"), (-7, 1, "u", "c"), (-20, 0, "u", "c"), (-20, 1, "u", "c"), (7_000_000_019, 0, "u", "c")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def talk(spark):
    return spark.createDataFrame(conversations(), SCHEMA).repartition(4).cache()


def found(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, *r[3:]) for r in df.select(COLUMNS).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("block,run", [(256, 200_000), (256, 60), (4, 60), (1, 9), (3, 1)])
def test_nodes_match_a_plain_version(spark, talk, block, run):
    assert found(P.prefix_trie(*P.rebuilt(talk), block=block, run_turns=run)) == plain(conversations())


def test_query_matches_sql(spark, talk):
    folder = write_tables(spark, conversations=talk)
    same_rows(P.op12_trie(spark, folder), P.SQL["op12_trie"], folder)


def test_each_node_once(spark, talk):
    nodes = P.prefix_trie(*P.rebuilt(talk), block=8, run_turns=100)
    assert nodes.count() == nodes.select("conv_id", "depth").distinct().count()


def test_odd_tables(spark, talk):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.prefix_trie(*P.rebuilt(empty)).count() == 0
    assert P.prefix_trie(*P.rebuilt(empty.union(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)))).count() == 0
    clash = talk.withColumns({c: F.lit("mine") for c in ["depth", "n", "path", "pos", "digest", "words", "row", "first", "at", "block"]})
    assert found(P.prefix_trie(*P.rebuilt(clash))) == plain(conversations())
    # a conversation whose only turn is cut away is a member of the root
    gone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = found(P.prefix_trie(*P.rebuilt(spark.createDataFrame([(gone, 0, "u", "x")], SCHEMA))))
    assert rows == [(gone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())]


def test_tree_is_balanced_by_medians():
    tree = P._Tree()
    ends = {s: tree.insert([s, 1], s) for s in P._medians(1023)}
    assert len(set(ends.values())) == 1023 and len(tree.turn) == 1 + 2 * 1023

    def height(v):
        level, most = [v], 0
        while level:
            most += 1
            level = [x for y in level for x in (tree.lo[y], tree.hi[y]) if x >= 0]
        return most

    assert height(tree.eq[0]) == 10
