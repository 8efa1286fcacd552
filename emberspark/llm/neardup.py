"""Near-duplicate classes by a chosen-path set similarity join.

Every set of word shingles is embedded by ``SIZE`` minwise hashes.  A tree starts with all
documents; a node chooses a few of the hash positions at random (by a hash of the node's
name, so all its documents choose alike) and sends each document to one child a chosen
position, named by the position's value there.  Two documents of similarity s stay together
with probability s at each choice.  A node of at most ``SMALL`` documents is compared
exhaustively; larger ones branch again, to ``DEPTH`` levels.  ``TREES`` independent trees
bring the chance to miss a link of similarity 0.8 below 0.2**TREES where nodes get small.

Large nodes hold documents alike to each other, or a passage that many share.  At first
they are dealt into blocks of ``SMALL`` documents, each compared together with the node's
few leaders, so that a large class hangs together at a cost linear in its size.  Once these
links are known, nodes whose documents are of one class hold nothing more to find, and only
those of several classes branch on, without documents that are in small nodes (or alone) for
two thirds of the roots' 20 choices: a link of similarity 0.8 disagrees in 14 of 20 or more with
a chance below 2e-6, so theirs were compared there.  Of what is large at the last level, or keeps
two thirds of its parent and so would not get smaller, all pairs of documents of different
classes are compared, in parts of ``CROSS`` documents or ``PART_BYTES`` of shingles, two parts a task.

Comparing estimates the similarity from one byte a minwise hash and keeps pairs well below
the threshold too; what is kept is confirmed on full shingle sets of the texts: first each
document against the closest smaller partner in a spanning forest of each block.  After that
a block names the documents that may have a partner of another class, their sets are sent
there, and only a spanning forest of true links among the classes leaves the task, so that
thousands of texts just below the threshold cost comparisons but no rows.  A pair that is in
several small nodes of the roots makes its documents be named in the first of them only, and
sets whose sizes alone rule a link out are not compared.  Equal sets are one
node of the graph from the start, whatever their number.

Defined cases: documents without words (or null text) have no shingles and are alone;
documents with one id are one node; a null id is alone, in class null, and kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import cut, gathered, small, table, utf8
from emberspark.llm.components import components
from emberspark.llm.shingles import minhash, mix, shingle_set

PERCENT = 80
SIZE = 128
TREES = 12
DEPTH = 5
SMALL = 64
LEADERS = 8
#: Positions that a node chooses on average besides the first: the root, and deeper nodes.
ROOT, DEEPER = 1.0, 0.5
CROSS = 512
#: Shingles of one part of documents that meet in a task (a larger set is a part of its own).
PART_BYTES = 16 << 20
#: Pairs compared together in a task.
PAIRS = 1 << 13
#: One-byte minwise hashes that must agree, of 128: a link of 0.8 (102 expected) misses 84 with a chance of about 3e-5.
ALIKE = 84


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, key, sig``: the set's size, a 128-bit digest of it, and its minwise hashes."""

    def run(batches):
        for b in small(batches, "text"):
            n, key, sig = [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(minhash(s, SIZE).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                                              pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "key", "sig"])

    return docs.mapInArrow(run, f"doc_id {_id_type(docs)}, n_shingles long, key binary, sig binary")


def _chosen(node: np.ndarray, expected: float) -> np.ndarray:
    """Which positions each node chooses: one row a node, at least one position."""
    draw = mix(node[:, None] ^ mix(np.arange(SIZE, dtype=np.uint64) + np.uint64(1)))
    chosen = draw < np.uint64(int(expected / SIZE * 2 ** 64))
    chosen[np.arange(len(node)), draw.argmin(axis=1)] = True
    return chosen


#: The roots' choices: tree and position, the same for all documents.
CHOICES = [(t, int(p)) for t in range(TREES) for p in np.flatnonzero(_chosen(mix(np.array([t + 1], np.uint64)), ROOT)[0])]
assert len(CHOICES) <= 64


def _children(node: np.ndarray, sig: np.ndarray, more: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and name of every child that the rows' nodes send them to."""
    row, position = np.nonzero(_chosen(node, more))
    value = sig[row, position].astype(np.uint64)
    return row, mix(mix(node[row] + position.astype(np.uint64)) ^ value)


def _roots(sig: np.ndarray):
    """Row and name of every child of the roots; the last bits of a name say which of the roots' choices it comes of."""
    for k, (t, position) in enumerate(CHOICES):
        node = mix(mix(np.array([t + 1], np.uint64)) + np.uint64(position))
        name = mix(node ^ sig[:, position].astype(np.uint64))
        yield np.arange(len(sig)), name & ~np.uint64(63) | np.uint64(k)


def _branch(members: DataFrame) -> DataFrame:
    """``node, rep, parent`` (the size of the node it comes of) of the next level, written; ``members`` has ``rep, sig``
    and, below the root, ``node, size``."""
    root = "node" not in members.columns

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, SIZE)
            rep = b.column("rep").to_numpy()
            parent = np.zeros(len(rep), np.int64) if root else b.column("size").to_numpy()
            if root:
                found = _roots(sig)
            else:
                found = [_children(b.column("node").to_numpy().view(np.uint64), sig, DEEPER)]
            for row, name in found:
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(rep[row]), pa.array(parent[row])],
                                                 names=["node", "rep", "parent"])

    return cut(members.mapInArrow(run, "node long, rep long, parent long"))


def _sized(members: DataFrame) -> DataFrame:
    """Members of nodes of two documents and more, with the node's size."""
    sizes = members.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(sizes, "node")


def _runs(batches, keys: list[str]):
    """Tables of the rows that agree in ``keys``, from batches sorted by them."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _whole(batches, keys: list[str]):
    """Tables of whole runs of rows that agree in ``keys``, from batches sorted by them, and where each run begins."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        cols = [t.column(k).to_numpy() for k in keys]
        first = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1])
        if len(first) > 1:
            yield t.slice(0, first[-1]).combine_chunks(), first[:-1]
        held = t.slice(first[-1])
    if held is not None:
        yield held.combine_chunks(), np.zeros(1, np.int64)


def _pairs_within(first: np.ndarray, rows: int):
    """Rows (i, j), i < j, of all pairs within runs that begin at ``first``, some at a time."""
    later = np.repeat(np.append(first[1:], rows), np.diff(first, append=rows)) - np.arange(rows) - 1
    ends = np.cumsum(later)
    at = 0
    while at < rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = later[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _agreement(m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many one-byte hashes agree in each pair of rows (i, j)."""
    eight = (m[i] == m[j]).view(np.uint64).sum(axis=1, dtype=np.uint64)  # eight counts of at most 16, a byte each
    return ((eight * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _alike(t: pa.Table, first: np.ndarray, may):
    """Rows (i, j) of the pairs within runs for which ``may(i, j)`` holds and enough hashes agree, and how many do."""
    m, out = _matrix(t), [(np.zeros(0, np.int64),) * 3]
    for i, j in _pairs_within(first, len(m)):
        own = may(i, j)
        i, j = i[own], j[own]
        alike = _agreement(m, i, j)
        own = alike >= ALIKE
        out.append((i[own], j[own], alike[own]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sizes_allow(n: np.ndarray, percent: int):
    """Whether sets of the sizes of rows i and j may be a link: the smaller is at least that part of the larger."""
    return lambda i, j: 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many one-byte hashes agree, for all pairs of rows of x and y."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for j in range(SIZE):
        out += x[:, j, None] == y[None, :, j]
    return out


def _matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(-1, SIZE)


def _forest(alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a spanning forest of greatest agreement, over pairs that agree enough."""
    n = len(alike)
    best, source = np.full(n, -1), np.full(n, -1)
    out, left = np.zeros(n, bool), n
    pairs = []
    while left:
        rest = np.where(out, -2, best)
        i = int(rest.argmax())
        if rest[i] >= ALIKE:
            pairs.append((source[i], i))
        out[i] = True
        left -= 1
        closer = alike[i].astype(np.int64) > best
        best[closer], source[closer] = alike[i][closer], i
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def _forests(first: np.ndarray, i: np.ndarray, j: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j), sorted by i, are a spanning forest of greatest agreement of each run."""
    run = np.searchsorted(first, i, "right")
    edges = np.flatnonzero(np.diff(run, prepend=-1, append=-1))
    kept = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hi - lo == 1:
            kept.append(np.array([lo]))
            continue
        rows, back = np.unique(np.concatenate([i[lo:hi], j[lo:hi]]), return_inverse=True)
        x, y = back[:hi - lo], back[hi - lo:]
        matrix, place = np.zeros((len(rows), len(rows)), np.int64), np.zeros((len(rows), len(rows)), np.int64)
        matrix[x, y] = matrix[y, x] = alike[lo:hi]
        place[x, y] = place[y, x] = np.arange(lo, hi)
        kept.append(place[_forest(matrix)])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _compare(nodes: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``node, block, a, b, alike``: a spanning forest of the possible links in each block, written; ``nodes`` has ``node, block, rep``."""
    rows = nodes.join(reps.select("rep", "n", "bytes"), "rep")

    def run(batches):
        for t, first in _whole(batches, ["node", "block"]):
            rep = t.column("rep").to_numpy()
            fits = _sizes_allow(t.column("n").to_numpy(), percent)
            i, j, alike = _alike(t, first, lambda i, j: (rep[i] != rep[j]) & fits(i, j))
            own = _forests(first, i, j, alike)
            if len(own):
                i, j = i[own], j[own]
                yield pa.RecordBatch.from_arrays(
                    [t.column("node").chunk(0).take(pa.array(i)), t.column("block").chunk(0).take(pa.array(i)),
                     pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j])), pa.array(alike[own], pa.int32())],
                    names=["node", "block", "a", "b", "alike"])

    return cut(gathered(rows.select("node", "block", "rep", "n", "bytes"), ["node", "block"]).mapInArrow(
        run, "node long, block int, a long, b long, alike int"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the nodes whose documents are not yet all of one class."""
    mixed = (_labelled(members, labels).groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("node"))
    return members.join(mixed, "node")


def _blocks(members: DataFrame) -> DataFrame:
    """``node, block, rep``: small nodes whole; large ones in blocks, each with the node's leaders."""
    block = F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("size") / (SMALL - LEADERS)).cast("int"))
    dealt = members.select("node", F.when(F.col("size") <= SMALL, F.lit(0)).otherwise(block).cast("int").alias("block"), "rep")
    leaders = (members.where(F.col("size") > SMALL).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(LEADERS)))
               .groupBy("node", "salt").agg(F.min("rep").alias("rep"), F.max("size").alias("size")))
    everywhere = leaders.select("node", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / (SMALL - LEADERS)).cast("int") - 1))
                                .alias("block"), "rep")
    return dealt.unionByName(everywhere)


def _confirm(edges: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those ``a, b`` of a checkpointed edge table that are links, from the full sets of both texts.

    Partners of ``a`` go in blocks of about 256 to one task each, together with the text of ``a``.
    """
    degree = edges.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"))
    placed = edges.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    needs = placed.select("a", "part", F.col("b").alias("id"), F.lit(1).alias("role")).unionByName(
        placed.select("a", "part", F.col("a").alias("id"), F.lit(0).alias("role")).distinct())
    needs = cut(needs)  # small beside the texts: sent to all executors below the session's bound, else joined by id
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(needs, "id").select("a", "part", "role", "id", "text")

    def run(batches):
        hub, sets = None, []
        for b in batches:
            out = []
            for a, part, role, id_, text in zip(*(b.column(c) for c in b.schema.names)):
                at = (a.as_py(), part.as_py())
                if at != hub:
                    hub, sets = at, []
                own = shingle_set(text.as_py(), k)
                if not role.as_py():
                    sets.append(own)
                    continue
                for s in sets:
                    common = len(np.intersect1d(s, own, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(own) - common) and common:
                        out.append((at[0], id_.as_py()))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return gathered(texts, ["a", "part"], ["role"]).mapInArrow(run, "a long, b long")


BLOCK = ["node", "block", "x", "y"]


def _met(rows: DataFrame, parts) -> DataFrame:
    """``rows`` of (node, block) dealt into ``parts`` parts (a column of an aggregate), any two of which meet as ``x, y``."""
    sizes = rows.groupBy("node", "block").agg(parts.cast("int").alias("parts"))
    return (rows.join(sizes, ["node", "block"])
            .withColumn("own", F.pmod(F.xxhash64("rep", "node"), F.col("parts")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("parts", "other"))


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two parts that meet; of one part twice, if it meets itself."""
    own, x = t.column("own").to_numpy(), t.column("x")[0].as_py()
    left = np.flatnonzero(own == x)
    return left, left if x == t.column("y")[0].as_py() else np.flatnonzero(own != x)


def _shared(nodes: pa.ChunkedArray) -> np.ndarray:
    """The small root nodes of each row, in the order of the roots' choices (0: not small)."""
    lists = nodes.combine_chunks()
    names, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()])
    out = np.zeros((len(lists), len(CHOICES)), np.uint64)
    out[np.repeat(np.arange(len(lists)), np.diff(ends, prepend=0)), (names & np.uint64(63)).astype(np.int64)] = names
    return out


def _first_met(shared: np.ndarray, node: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j, in a node together, are in no small root node together or in this as the first."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), PAIRS):
        x, y = i[at:at + PAIRS], j[at:at + PAIRS]
        both = (shared[x] == shared[y]) & (shared[x] != 0)
        first = both.argmax(axis=1)
        out[at:at + PAIRS] = ~both[np.arange(len(x)), first] | (shared[x, first] == node[x])
    return out


def _doubtful(nodes: DataFrame, reps: DataFrame, labels: DataFrame, percent: int, large: bool) -> DataFrame:
    """``node, block, rep, component`` of documents that may have a link to another class in their block, written.

    A pair that is in several small root nodes counts in the first of them only.
    """
    rows = _labelled(nodes.select("node", "block", "rep"), labels)
    mixed = (rows.groupBy("node", "block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("node", "block"))
    rows = rows.join(mixed, ["node", "block"])
    rows = (_met(rows, F.ceil(F.count("*") / CROSS)) if large
            else rows.withColumns({"x": F.lit(0), "y": F.lit(0), "own": F.lit(0)}))
    rows = rows.join(reps.select("rep", "n", "bytes", "nodes"), "rep")

    def run(batches):
        for t, first in _whole(batches, BLOCK):
            rep, label, node = (t.column(c).to_numpy() for c in ("rep", "component", "node"))
            fits, shared = _sizes_allow(t.column("n").to_numpy(), percent), _shared(t.column("nodes"))
            own, x, y = (t.column(c).to_numpy() for c in ("own", "x", "y"))
            # of two parts that meet, the pairs within each of them belong to other tasks
            i, j, _ = _alike(t, first, lambda i, j: (label[i] != label[j]) & ((x[i] == y[i]) | (own[i] != own[j])) & fits(i, j))
            met = _first_met(shared, node.view(np.uint64), i, j)
            at = np.union1d(i[met], j[met])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [t.column("node").chunk(0).take(pa.array(at)), t.column("block").chunk(0).take(pa.array(at)),
                     pa.array(rep[at]), pa.array(label[at])], names=["node", "block", "rep", "component"])

    return cut(gathered(rows.select(*BLOCK, "own", "rep", "component", "n", "bytes", "nodes"), BLOCK).mapInArrow(
        run, "node long, block int, rep long, component long").distinct())


def _sets(ids: DataFrame, docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """``rep, n, shingles, bytes`` of the texts with the given ids, written; each set of an id once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(ids, "rep")

    def run(batches):
        for b in small(batches, "text"):
            sets = [shingle_set(x, k) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["rep", "key", "n", "shingles"])

    found = (texts.select("rep", "text").mapInArrow(run, "rep long, key binary, n long, shingles binary").where("n > 0")
             .groupBy("rep", "key").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")))
    return cut(found.join(reps.select("key", "bytes"), "key").drop("key"))


def _forest_of_links(sets: list[np.ndarray], alike: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray,
                     percent: int) -> list[tuple[int, int]]:
    """Rows (i, j) of links between different classes, as few as join all classes that have any."""
    side = np.union1d(left, right)
    code = np.split(np.unique(np.concatenate([sets[i] for i in side]), return_inverse=True)[1],
                    np.cumsum([len(sets[i]) for i in side])[:-1])
    code = dict(zip(side.tolist(), code))
    n = np.array([len(s) for s in sets])
    inside = np.zeros(1 + max(int(c.max()) for c in code.values()), np.uint8)
    other = np.concatenate([code[j] for j in right.tolist()])
    first = np.concatenate([[0], np.cumsum(n[right])[:-1]])
    group = np.unique(label, return_inverse=True)[1]
    out = []
    for at, i in enumerate(left.tolist()):
        may = (alike[at] >= ALIKE) & (group[right] != group[i])
        if left is right:
            may[:at + 1] = False
        if not may.any():
            continue
        inside[code[i]] = 1
        common = np.add.reduceat(inside[other], first, dtype=np.int64)
        inside[code[i]] = 0
        for j in right[may & (common > 0) & (100 * common >= percent * (n[i] + n[right] - common))].tolist():
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def _joined(nodes: DataFrame, reps: DataFrame, labels: DataFrame, docs: DataFrame, k: int, percent: int,
            large: bool = False) -> DataFrame | None:
    """``a, b``: links that join all classes between which a block has any; None if no block may have one.

    Confirmed on the full sets, within the task in which a block's documents meet.
    """
    rows = _doubtful(nodes, reps, labels, percent, large)
    if not rows.limit(1).count():
        return None
    sets = _sets(rows.select("rep").distinct(), docs, reps, k)
    rows = rows.join(sets.groupBy("rep").agg(F.sum("n").alias("n")), "rep")
    rows = _met(rows, F.greatest(F.ceil(F.count("*") / CROSS), F.ceil(8 * F.sum("n") / PART_BYTES)))
    rows = rows.drop("n").join(sets.select("rep", "shingles", "bytes").hint("merge"), "rep")

    def run(batches):
        for t in _runs(batches, BLOCK):
            left, right = _sides(t)
            if not len(left) or not len(right):
                continue
            m, rep = _matrix(t), t.column("rep").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
            found = _forest_of_links(sets, _agree(m[left], m[right]), t.column("component").to_numpy(), left, right, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rep[x[i]] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return cut(gathered(rows.select(*BLOCK, "own", "rep", "component", "shingles", "bytes"), BLOCK).mapInArrow(
        run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Linked are documents whose sets of k-word shingles have a Jaccard similarity of at least
    ``percent`` / 100; ``component_id`` is the smallest id reachable by links.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text"))
    named = cut(sketch(docs, k))
    sets = named.where("doc_id is not null and key is not null")
    reps = cut(sets.groupBy("key").agg(F.min(F.col("doc_id").cast("long")).alias("rep"), F.max("sig").alias("sig"),
                                        F.max("n_shingles").alias("n")))

    members = cut(_sized(_branch(reps.select("rep", "sig"))))
    blocks = cut(_blocks(members))
    # a document's small root nodes, where its pairs are compared once for all
    placed = members.where(F.col("size") <= SMALL).groupBy("rep").agg(F.collect_set("node").alias("nodes"))
    reps = cut(reps.withColumn("bytes", _low_bytes("sig")).join(placed, "rep", "left"))
    # an id with several sets, or the copies of a set: their representatives are linked as they stand
    given = (sets.join(reps.select("key", "rep"), "key").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a"))
             .where("a <> b").select("a", "b"))
    pairs = _compare(blocks, reps, percent)
    # each document against the partner with the smaller id that seems closest
    tested = cut(pairs.groupBy("b").agg(F.max(F.struct("alike", (-F.col("a")).alias("a"))).alias("x"))
                 .select((-F.col("x.a")).alias("a"), "b"))
    links = cut(_confirm(tested, docs, k, percent).unionByName(given))
    labels = cut(components(links))
    # then the classes against each other

    def join_classes(nodes, large=False):
        nonlocal links, labels
        more = _joined(nodes, reps, labels, docs, k, percent, large)
        if more is not None and more.limit(1).count():
            links = links.unionByName(more)
            labels = cut(components(links))

    # documents without a possible link in their block are in no forest
    join_classes(pairs.select("node", "block", F.explode(F.array("a", "b")).alias("rep")).distinct())
    # large nodes of several classes branch on, without the documents most of whose root nodes are small
    large = members.where(F.col("size") > SMALL)
    often = large.groupBy("rep").agg(F.count("*").alias("c")).where(F.col("c") * 3 > len(CHOICES)).select("rep")
    deeper_blocks, whole, large = [], [], large.join(often, "rep").select(*members.columns)
    for level in range(1, DEPTH):
        large = cut(_mixed(large, labels))
        if not large.limit(1).count():
            break
        deeper = cut(_sized(_branch(large.select("node", "rep", "size").join(reps.select("rep", "sig"), "rep"))))
        deeper_blocks.append(deeper.where(F.col("size") <= SMALL).select("node", F.lit(0).alias("block"), "rep"))
        # a node that keeps most of its parent's documents would not get smaller: its pairs are compared as they are
        alike = F.col("size") * 3 >= F.col("parent") * 2
        whole.append(deeper.where((F.col("size") > SMALL) & alike))
        large = deeper.where((F.col("size") > SMALL) & ~alike)
    if deeper_blocks:
        join_classes(reduce(DataFrame.unionByName, deeper_blocks))
        large = cut(_mixed(reduce(DataFrame.unionByName, whole, large), labels))
        if large.limit(1).count():
            join_classes(large.select("node", F.lit(0).alias("block"), "rep"), large=True)

    classes = reps.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("component"))
    return (named.join(classes, "key", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(
                "component", F.col("doc_id").cast("long"))).cast(_id_type(docs)))
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each near-duplicate class: of the smallest id, and of its rows the least."""
    found = cut(near_duplicates(docs, k, percent).select("doc_id", "kept"))
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        return left
    again = cut(again)
    rest = [F.col(c) for c in docs.columns if c != "doc_id"]
    least = left.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("x")).select("doc_id", "x.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(least.select(*docs.columns))


def _low_bytes(col: str):
    """Every fourth byte of a binary column: the low bytes of its 32-bit numbers."""
    hexed = F.hex(F.col(col))
    return F.unhex(F.regexp_replace(hexed, "(..)......", "$1"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents, on four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=4)


# Every pair that shares a shingle, counted; classes by a recursive walk over the links.
SQL = {"op4_neardup": """
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""}
