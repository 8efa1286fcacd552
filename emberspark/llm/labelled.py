"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberspark.llm.common import cut, held_out, utf8


class Texts(Sequence):
    """Texts of an Arrow column, each read out as bytes when it is asked for.

    The column is one block of memory, which is given back as a whole; thousands of bytes objects would leave
    the driver's memory in pieces that it keeps.
    """

    def __init__(self, column: pa.ChunkedArray):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, at) -> bytes:
        return self.column[int(at)].as_py()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, fold: int = 5,
                    doc_id: str = "doc_id", text: str = "text", most_bytes: int = 64 << 20) -> tuple[Texts, list[int], list[float]]:
    """Texts, labels and row weights of at most ``per_class`` documents of each label and ``most_bytes`` of text.

    Rows whose id falls in the held-out fold are never read.  The documents taken are
    those with the smallest hash of their id, so the choice is uniform and the same on
    every run; weights restore the share that each label has among all labelled rows.
    Texts of any length are taken, in that order, as long as they fit into ``most_bytes``.
    Conflicting or null labels of one id: the largest, or no label.  The bounds are what
    allows the ids to be broadcast and the texts to be collected.
    """
    known = (labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", fold))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(label), F.col("doc_id"))
    taken = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        taken = part if taken is None else taken.unionAll(part)
    texts = cut(docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text")).join(F.broadcast(taken), "doc_id")
                .groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    left, fits = most_bytes, []
    for r in texts.select("doc_id", F.length("text").alias("size"), order.alias("at")).orderBy("at", "doc_id").collect():
        if r.size <= left:
            left -= r.size
            fits.append(r.doc_id)
    ids = docs.sparkSession.createDataFrame([(x,) for x in fits], docs.select(F.col(doc_id).alias("doc_id")).schema)
    rows = texts.join(F.broadcast(ids), "doc_id").toArrow()
    name = rows.column("doc_id").to_pylist()
    order = sorted(range(len(name)), key=name.__getitem__)
    y = [rows.column("y")[i].as_py() for i in order]
    got = {k: max(1, y.count(k)) for k in (0, 1)}
    total = max(1, sum(counts.values()))
    weights = [counts[k] / total * len(y) / got[k] for k in y]
    return Texts(rows.column("text").take(pa.array(order, pa.int64()))), y, weights
