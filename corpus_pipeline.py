"""Corpus pipeline: from documents to packed token sequences.

Stages, each on all that its predecessor kept:

1. ``toxicity``: documents that the multiple-instance model scores 0.5 or more go.  The
   model is trained on the labelled documents of the stage's own input, outside the
   held-out fold, and the labels of ``sf_dir``.
2. ``near_dedup``: one document of each near-duplicate class stays (five-word shingles,
   similarity 0.8): that with the smallest id; of repeated rows of one id, one.
3. ``decontamination``: documents that hold a window of a benchmark item go.
4. ``secrets``: every secret is replaced by a mark; ``n_chars`` follows.
5. ``packing``: the texts' token pieces, placed in sequences of at most 2048 ids.

All but the last return the columns of documents.  Each result is written as Parquet to
a fresh folder below ``spark.checkpoint.dir`` and read again by the next stage.

Defined cases: null texts count as empty and stay null; null ids are never duplicates;
an empty table gives an empty result; extra columns go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberspark.llm import decontam, neardup, packing, secrets
from emberspark.llm import toxicity as tox
from emberspark.llm.common import scratch, table


CORE = ("doc_id", "text", "lang", "source", "n_chars")
EXTRA = "other columns"


def _core(docs: DataFrame) -> DataFrame:
    """The columns of documents, and any others in one, out of the operators' way."""
    extra = [F.col(f"`{c}`") for c in docs.columns if c not in CORE]
    return docs.select(*CORE, F.struct(*extra).alias(EXTRA)) if extra else docs


def _back(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*[F.col(c) if c in CORE else F.col(f"`{EXTRA}`").getField(c).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = tox.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return _back(tox.score_toxicity(_core(docs), model).where("toxic_score < 0.5"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _back(neardup.keep_one(_core(docs)), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_core(docs), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _back(found.where("n_hit = 0"), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(secrets.scan(_core(docs)))
    size = F.when(F.size("secret_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _back(clean.withColumn("n_chars", size), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_pieces(packing.tokenize(docs))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secrets", secret_scan), ("packing", pack)]

# Trained scores, sketches and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
