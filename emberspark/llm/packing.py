"""Best-fit packing of documents into token sequences, improved by swaps.

A document is its byte-pair ids followed by id 0.  One longer than a sequence is cut
into full pieces, the first of which may be shorter; full pieces are sequences of
their own, and the others are packed.

Pieces are dealt at random into groups of about ``GROUP`` pieces, each packed by one
task: best fit, longest first, and then a local search on the underfull bins.  Its
moves carry fill from the emptiest bin to fuller ones - a piece moves, one piece is
exchanged for one shorter, or two for one - and each raises the sum of squared fills,
so it ends; a bin that loses its last piece is gone.  A group stops at its lower bound
ceil(tokens / length).  A group wastes about one bin in thousands, whatever the
number of groups, and nothing but piece lengths is shuffled.

Defined cases: a null or empty text is the id 0 alone; repeated rows are packed each;
a null id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm.common import cut, small, table, utf8

LENGTH = 2048
GROUP = 8192
#: Sources that the local search may find stuck, in turn, before it ends.
PATIENCE = 8


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """The public vocabulary as a tokenizers file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Ids as the tokenizers library gives them for the vocabulary file.

    tiktoken encodes the same vocabulary several times faster.  It is used for texts
    in Latin-1, where both split alike; all others, and those that spell the special
    token, go through tokenizers.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        self.full = None

    def __call__(self, text: bytes) -> np.ndarray:
        """The ids of a text and id 0 at the end."""
        s = text.decode("utf-8", "replace")
        if "<|endoftext|>" not in s and _latin(s):
            ids = self.fast.encode_ordinary(s)
        else:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.json_path)
            ids = self.full.encode(s, add_special_tokens=False).ids
        return np.array([*ids, 0], dtype="<u4")


def _latin(s: str) -> bool:
    try:
        s.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def piece_bounds(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter."""
    head = n % length or length
    return [(0, min(n, head)), *((at, length) for at in range(head, n, length))]


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r is set if some bin has room for exactly r
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = length, len(bins)
            bins.append([])
        bins[b].append(int(item))
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, length: int, patience: int = PATIENCE) -> list[list[int]]:
    """Local search on the underfull bins; returns the bins that still hold something.

    The source is the emptiest bin.  Of all moves that carry d ids from it into a bin
    that has room for d, the one that raises the sum of squared fills most is made;
    a source without such a move is set aside.
    """
    size = [int(x) for x in sizes]
    least = -(-sum(size) // length)
    fill = {b: sum(size[i] for i in items) for b, items in enumerate(bins)}
    under = {b for b, f in fill.items() if f < length}
    alive, stuck = len(bins), set()
    while alive > least and len(stuck) < patience and len(under - stuck) > 1:
        source = min(under - stuck, key=lambda b: (fill[b], b))
        have = bins[source]
        outs = [(size[i], (i,)) for i in have]
        outs += [(size[i] + size[j], (i, j)) for k, i in enumerate(have) for j in have[k + 1:]]
        best = (0, 0, (), ())
        for b in under:
            if b == source:
                continue
            room, more = length - fill[b], fill[b] - fill[source]
            if 2 * room * (more + room) <= best[0]:
                continue
            backs = [(0, ()), *((size[t], (t,)) for t in bins[b])]
            for out, items in outs:
                for back, returned in backs:
                    d = out - back
                    if 0 < d <= room and not (len(items) == 2 and not returned) and 2 * d * (more + d) > best[0]:
                        best = (2 * d * (more + d), b, items, returned)
        gain, to, items, returned = best
        if not gain:
            stuck.add(source)
            continue
        d = sum(size[i] for i in items) - sum(size[t] for t in returned)
        bins[source] = [i for i in have if i not in items] + list(returned)
        bins[to] = [i for i in bins[to] if i not in returned] + list(items)
        fill[source] -= d
        fill[to] += d
        if fill[to] == length:
            under.discard(to)
        if not bins[source]:
            under.discard(source)
            alive -= 1
        stuck.discard(to)
    return [b for b in bins if b]


def pack(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item."""
    bins = improve(best_fit(sizes, length), sizes, length)
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in sorted(items):
            bin_of[i], offset[i] = b, at
            at += int(sizes[i])
    return bin_of, offset


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
             files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` as little-endian bytes) of every piece."""
    frame = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text"))
    id_field = frame.schema["doc_id"].dataType.simpleString()
    files = files or tokenizer_files()

    def run(batches):
        encode = Encoder(*files)
        for b in small(batches, "text"):
            row, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = encode(text)
                for k, (at, n) in enumerate(piece_bounds(len(raw), length)):
                    own = raw[at:at + n].tobytes()
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(n)
                    crc.append(zlib.crc32(own))
                    if with_ids:
                        ids.append(own)
            out = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                   pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return frame.mapInArrow(run, f"doc_id {id_field}, piece int, start long, length long, ids_crc32 long"
                            + (", ids binary" if with_ids else ""))


def pack_pieces(pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` (any columns, with ``length``) with ``sequence_id`` and ``offset``."""
    pieces = cut(pieces.drop("sequence_id", "offset"))  # the texts are encoded once
    numbered = pieces.withColumn("__row of packing", F.monotonically_increasing_id())
    short = numbered.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group))
    dealt = short.withColumn("__group of packing", F.pmod(F.xxhash64("__row of packing"), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__row of packing")  # the same packing on every attempt
        b, offset = pack(rows.column("length").to_numpy(), length)
        ids = (rows.column("__group of packing")[0].as_py() << 32) + b
        rows = rows.drop_columns(["__row of packing", "__group of packing"])
        return rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    packed = dealt.groupBy("__group of packing").applyInArrow(run, f"{kept}, sequence_id long, offset long")
    # a full piece is a sequence: a negative number, which no group uses
    full = numbered.where(F.col("length") >= length).select(
        *pieces.columns, (-1 - F.col("__row of packing")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack_pieces(tokenize(table(spark, sf_dir, "documents", "doc_id", "text")))


SQL: dict[str, str] = {}
