"""Prefix trie of conversations, from ternary search trees over range shards.

Conversations are sequences of turns, and every distinct beginning of one is a node.  The
sequences, cut into blocks of ``BLOCK`` turns, are sorted by path and range-partitioned with
the conversation's id last, so that neither copies of a conversation nor a long one gather in
a task.  A task reads its range in runs of about ``RUN`` turns.  Of each run it encodes the
turns by a dictionary in sorted order and builds a ternary search tree, balanced by inserting
the median sequence first, then the medians of both halves; a loop from the last node back
adds up members, leaves and savings.

Nodes on the path of a run's first or last sequence may go on in the neighbouring run, and
nodes above a block's end go on in the next block: these are open, and everything above an
open node is.  All others are finished in their task.  Partial rows of an open node are merged
by its key (depth and a 128-bit hash of its turns, the XOR over position and turn), and sums
over subtrees of open nodes follow by doubling: in round k every node adds its sum to its
ancestor 2**k levels up, so that a path of any depth takes log2(depth) rounds.  The digest of
an open node's members is computed in one task that streams the runs' lists in order, since
SHA-256 has no other way; nothing else of a node is held together.

Defined cases: rows without a conversation id belong to no conversation; null turns come
first; rows of one conversation and turn are ordered by the MD5 of role and text, and repeated
rows are turns of their own; a null role or text is empty; conversations whose turns are all
cut away are members of the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberspark.llm.common import crc32_text, cut, gathered, table
from emberspark.operators.ranking import global_row_number

BLOCK = 256
RUN = 200_000
DIGEST = 32  # hex digits of a turn in a path
WORD = r"[^\x20\x09-\x0D]+"
NODE = ("open boolean, depth long, x1 long, x2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n long, "
        "children long, leaves long, saved long, words long, first_end long, ends string")
KEY = ["depth", "x1", "x2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, words``: the turns of each conversation in order, from 0, their text as a digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    ranked = global_row_number(turns, ["conv_id", "turn", "digest"], "row")
    return ranked.withColumnRenamed("row", "pos").select("conv_id", "pos", "digest", "words")


def rebuilt(conversations: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (``conv_id, at, digest, words``) and lengths (``conv_id, total``) of conversations with a shared beginning.

    The first h turns of conversation c are those of the first of its ``family``, h = crc32(c) mod ``heads``.
    """
    ranked = numbered_turns(conversations)
    size = ranked.groupBy("conv_id").agg(F.min("pos").alias("first"), F.count("*").alias("len"))
    head = F.col("conv_id") - F.col("conv_id") % family
    size = cut(size.select("conv_id", "first", "len", (crc32_text("conv_id") % heads).alias("h"), head.alias("base")))
    lead = size.where("conv_id = base").select(F.col("base"), F.col("len").alias("base_len"))
    size = size.join(lead, "base", "left").withColumn("take", F.least("h", F.coalesce("base_len", F.lit(0))))
    own = ranked.join(size.select("conv_id", "first", "h", "base", "take"), "conv_id").withColumn("pos", F.col("pos") - F.col("first"))
    lent = (own.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < heads - 1))
            .select("base", F.col("pos").alias("at"), "digest", "words"))
    taken = size.select("conv_id", "base", "h").join(lent, "base").where("at < h").select("conv_id", "at", "digest", "words")
    kept = own.where("pos >= h").select("conv_id", (F.col("take") + F.col("pos") - F.col("h")).alias("at"), "digest", "words")
    total = F.col("take") + F.greatest(F.col("len") - F.col("h"), F.lit(0))
    return taken.unionByName(kept), size.select("conv_id", total.alias("total"))


def _blocks(turns: DataFrame, lengths: DataFrame, block: int) -> DataFrame:
    """One row for each conversation and block of its turns; ``q1, q2``: the hash of all that comes before."""
    parts = turns.select("conv_id", F.floor(F.col("at") / block).alias("block"), F.struct(
        "at", "digest", "words", F.xxhash64(F.lit(1), "at", "digest").alias("e1"),
        F.xxhash64(F.lit(2), "digest", "at").alias("e2")).alias("t"))
    # A block has at most ``block`` rows.
    parts = parts.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list("t")).alias("t"), F.bit_xor("t.e1").alias("b1"), F.bit_xor("t.e2").alias("b2"))
    parts = parts.join(lengths, "conv_id").select(
        "*", (F.col("total") <= (F.col("block") + 1) * block).alias("ends"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = parts.withColumns({"q1": F.coalesce(F.bit_xor("b1").over(before), F.lit(0)),
                               "q2": F.coalesce(F.bit_xor("b2").over(before), F.lit(0))})
    rows = later.select("block", "q1", "q2", F.array_join("t.digest", "").alias("path"), "conv_id", "ends",
                        F.col("t.words").alias("words"), F.col("t.e1").alias("e1"), F.col("t.e2").alias("e2"))
    none = F.array().cast("array<long>")
    bare = lengths.where("total = 0").select(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("q1"),
                                             F.lit(0).cast("long").alias("q2"), F.lit("").alias("path"), "conv_id",
                                             F.lit(True).alias("ends"), none.alias("words"), none.alias("e1"), none.alias("e2"))
    return rows.unionByName(bare)


class _Tree:
    """A ternary search tree of encoded sequences; node 0 stands for the empty one.

    Each node holds one turn; ``lo`` and ``hi`` lead to its smaller and larger siblings, ``eq`` to its children.
    """

    def __init__(self):
        self.turn, self.lo, self.hi, self.eq, self.parent = [-1], [-1], [-1], [-1], [-1]
        self.depth, self.seq = [0], [-1]

    def _new(self, turn: int, parent: int, seq: int) -> int:
        self.turn.append(turn)
        self.lo.append(-1)
        self.hi.append(-1)
        self.eq.append(-1)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.seq.append(seq)
        return len(self.turn) - 1

    def insert(self, turns: list[int], seq: int) -> int:
        """The node of a sequence; ``seq`` is kept with the nodes that are new."""
        turn, lo, hi, eq = self.turn, self.lo, self.hi, self.eq
        at = 0
        for t in turns:
            side, of, cur = eq, at, eq[at]
            while cur >= 0 and turn[cur] != t:
                side, of = (lo, cur) if t < turn[cur] else (hi, cur)
                cur = side[of]
            if cur < 0:
                cur = self._new(t, at, seq)
                side[of] = cur
            at = cur
        return at


def _medians(n: int) -> list[int]:
    """0..n-1, each range's middle before its halves."""
    out, left = [], [(0, n)]
    while left:
        lo, hi = left.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            out.append(mid)
            left += [(mid + 1, hi), (lo, mid)]
    return out


def _trie(run: pa.Table, lo: int, hi: int, first: bool, last: bool, block: int) -> list[tuple]:
    """Node rows of rows ``lo..hi`` of a run, all of one block and beginning; ``first``, ``last``: the run begins, ends here."""
    depth0 = run.column("block")[lo].as_py() * block
    root = run.column("q1")[lo].as_py(), run.column("q2")[lo].as_py()
    path = run.column("path").slice(lo, hi - lo).to_pylist()
    conv = run.column("conv_id").slice(lo, hi - lo).to_pylist()
    ends = run.column("ends").slice(lo, hi - lo).to_pylist()
    starts = [i for i in range(len(path)) if not i or path[i] != path[i - 1]]
    stops = [*starts[1:], len(path)]
    turns = [[path[i][j:j + DIGEST] for j in range(0, len(path[i]), DIGEST)] for i in starts]
    code = {d: k for k, d in enumerate(sorted({d for s in turns for d in s}))}

    tree, end = _Tree(), [0] * len(starts)
    for s in _medians(len(starts)):
        end[s] = tree.insert([code[d] for d in turns[s]], s)

    size = len(tree.turn)
    n, least, opened = [0] * size, [None] * size, [False] * size
    listed: list[list[int]] = [[] for _ in range(size)]
    opened[0] = True
    for s, node in enumerate(end):
        rows = range(starts[s], stops[s])
        n[node], least[node] = len(rows), conv[rows[0]]
        listed[node] = [conv[i] for i in rows if ends[i]]
        goes_on = len(listed[node]) < len(rows)
        opened[node] |= goes_on or (first and not s) or (last and s == len(end) - 1)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    words = [0] * size
    hashes = {}
    for s in range(len(starts)):
        row = lo + starts[s]
        hashes[s] = [np.bitwise_xor.accumulate(np.array([r, *run.column(c)[row].as_py()], np.int64)) for c, r in (("e1", root[0]), ("e2", root[1]))]
        hashes[s].append(run.column("words")[row].as_py())
    for v in range(size - 1, 0, -1):
        p = tree.parent[v]
        words[v] = hashes[tree.seq[v]][2][tree.depth[v] - 1]
        n[p] += n[v]
        least[p] = least[v] if least[p] is None else min(least[p], least[v])
        opened[p] |= opened[v]
        if not opened[v]:
            leaves[v] += not children[v]
            saved[v] += (n[v] - 1) * words[v]
            children[p] += 1
            leaves[p] += leaves[v]
            saved[p] += saved[v]
    out = []
    for v in range(size):
        p, d = tree.parent[v], tree.depth[v]
        x = (0, 0) if not v else (0, 0) if not opened[v] and not opened[p] else tuple(int(h[d]) for h in hashes[tree.seq[v]][:2])
        x = root if not v else x
        above = (None, None) if not v else root if not p else tuple(int(h[d - 1]) for h in hashes[tree.seq[v]][:2]) if opened[p] else (None, None)
        text = ",".join(map(str, listed[v]))
        if not opened[v]:
            out.append((False, depth0 + d, *x, *above, least[v], None if opened[p] else least[p], n[v], children[v], leaves[v], saved[v],
                        words[v], None, hashlib.sha256(text.encode()).hexdigest()))
        elif v or not depth0:
            out.append((True, depth0 + d, *x, *above, least[v], None, n[v], children[v], leaves[v], saved[v], words[v],
                        listed[v][0] if listed[v] else None, text or None))
        else:  # the block before has the node itself, this one what hangs below
            out.append((True, depth0, *x, None, None, None, None, 0, children[v], leaves[v], saved[v], 0, None, None))
    return out


def _shard(block: int, run_turns: int):
    def handle(held: list[pa.RecordBatch]):
        run = pa.Table.from_batches(held).combine_chunks()
        keys = [run.column(c).to_numpy() for c in ("block", "q1", "q2")]
        edges = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        bounds = [0, *edges.tolist(), run.num_rows]
        rows = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            rows += _trie(run, lo, hi, lo == 0, hi == run.num_rows, block)
            if len(rows) > 20_000:
                yield rows
                rows = []
        yield rows

    schema = pa.schema([(c.split()[0], {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}[c.split()[1]])
                        for c in NODE.split(", ")])

    def run(batches):
        held, weight = [], 0
        for b in batches:
            at, sizes = 0, np.cumsum(b.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            while at < b.num_rows:
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + run_turns - weight, "right")))
                held.append(b.slice(at, to - at))
                weight += int(sizes[min(to, b.num_rows) - 1] - before)
                at = to
                if weight >= run_turns or at < b.num_rows:
                    for rows in handle(held):
                        yield from _batches(rows, schema)
                    held, weight = [], 0
        if held:
            for rows in handle(held):
                yield from _batches(rows, schema)

    return run


def _batches(rows: list[tuple], schema: pa.Schema):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _digests(pieces: DataFrame) -> DataFrame:
    """``depth, x1, x2, ends_sha256`` of listed members, whose pieces are streamed in order."""
    def run(batches):
        key, sha, out = None, None, []
        for b in batches:
            for depth, x1, x2, _, text in zip(*(c.to_pylist() for c in b.columns)):
                if (depth, x1, x2) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (depth, x1, x2), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
        if key:
            out.append((*key, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip([*KEY, "ends_sha256"], map(list, zip(*out)))))

    return gathered(pieces.select(*KEY, "first_end", "ends"), KEY, ["first_end"]).mapInArrow(
        run, "depth long, x1 long, x2 long, ends_sha256 string")


def _merged(opened: DataFrame) -> DataFrame:
    """Open nodes, their partial rows merged and their sums taken over whole subtrees."""
    nodes = cut(opened.groupBy(*KEY).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"),
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("words").alias("words")))
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count("*").alias("more"))
    nodes = nodes.join(below, KEY, "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = cut(nodes.withColumns({"leaves": F.col("leaves") + (F.col("children") == 0).cast("long"),
                                   "saved": F.col("saved") + (F.col("n") - 1) * F.col("words")}))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums, step = nodes.select(*KEY, F.col("p1").alias("a1"), F.col("p2").alias("a2"), "leaves", "saved"), 1
    while step <= deepest:
        up = sums.where("a1 is not null")
        given = up.groupBy((F.col("depth") - step).alias("depth"), F.col("a1").alias("x1"), F.col("a2").alias("x2")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = sums.select((F.col("depth") + step).alias("depth"), F.col("x1").alias("a1"), F.col("x2").alias("a2"),
                           F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        sums = cut(sums.join(given, KEY, "left").join(jump, ["depth", "a1", "a2"], "left").select(
            *KEY, F.col("b1").alias("a1"), F.col("b2").alias("a2"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        step *= 2
    return nodes.drop("leaves", "saved").join(sums.select(*KEY, "leaves", "saved"), KEY)


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK, run_turns: int = RUN) -> DataFrame:
    """One row for each node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has ``conv_id, at`` (from 0, gapless), ``digest`` (32 characters for each distinct turn) and ``words``;
    ``lengths`` has ``conv_id, total`` of every conversation, turnless ones too.
    """
    rows = _blocks(turns, lengths, block)
    order = ["block", "q1", "q2", "path", "conv_id"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_shard(block, run_turns), NODE))
    opened = nodes.where("open")
    merged = cut(_merged(opened))
    up = merged.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent"))
    empty = hashlib.sha256(b"").hexdigest()
    above = merged.join(up, ["depth", "p1", "p2"], "left").join(_digests(opened.where("first_end is not null")), KEY, "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n", "children", "leaves", "saved",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    closed = nodes.where("not open").join(up, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "parent").alias("parent_conv_id"), "n", "children", "leaves", "saved",
        F.col("ends").alias("ends_sha256"))
    return above.unionByName(closed).select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"),
                                            F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                                            F.col("saved").alias("saved_tokens"), "ends_sha256")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


# Nodes by their whole path; each node's ancestors are the beginnings of its smallest member.
SQL = {"op12_trie": """
WITH bits AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM range(256) r(i))),
o AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos, digest, words
  FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295],
      list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o), bits),
s AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, digest, words FROM (
  SELECT c.conv_id, 0 AS own, pos, digest, words FROM c JOIN o ON o.conv_id = base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, digest, words FROM c JOIN o ON o.conv_id = c.conv_id AND pos >= h)),
p AS MATERIALIZED (SELECT conv_id, depth, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path, words FROM s
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words FROM p GROUP BY ALL),
u AS MATERIALIZED (SELECT n.*, a.path AS above, b.conv_id AS parent FROM n LEFT JOIN p a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1
  LEFT JOIN n b ON b.depth = a.depth AND b.path = a.path),
k AS (SELECT depth - 1 AS depth, above AS path, count(*) AS kids FROM u WHERE depth > 0 GROUP BY ALL),
f AS MATERIALIZED (SELECT u.*, coalesce(kids, 0) AS kids FROM u LEFT JOIN k USING (depth, path)),
t AS (SELECT p.depth, p.path, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * f.words) AS saved
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY ALL),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT depth, path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM l JOIN p USING (conv_id, depth) GROUP BY ALL)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM f JOIN t USING (depth, path) LEFT JOIN e USING (depth, path)
"""}
