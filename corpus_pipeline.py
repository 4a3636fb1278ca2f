"""The corpus pipeline: five training-data operators, each reading what the one before it kept.

Every stage takes (spark, docs, sf_dir), works on all of docs and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm._shared import Workspace, shared_dir, unused_name
from veilframe.llm.importance import resample
from veilframe.llm.minhash import near_duplicates
from veilframe.llm.mixing import mixed_documents
from veilframe.llm.pieces import encode_documents
from veilframe.llm.suffix import cut_repeats


#: Bytes of the strings that the pipeline removes: passages of just over 50 words have 285 bytes and more.
REPEATED = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling rejects go. Rows without an id are judged by their text like others; an empty table stays empty."""
    row = unused_name(docs, "_row")
    rows = Workspace(spark, "quality").keyed(docs, "rows", row)
    kept = resample(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=row).filter("kept").select(row)
    return rows.join(kept.hint("merge"), row, "left_semi").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; of rows that repeat it, one.

    Rows that share an id but no text are told apart. Rows without an id, and texts without words, link with nothing and stay.
    """
    row = unused_name(docs, "_row")
    rows = Workspace(spark, "near-dedup").keyed(docs, "rows", row)
    kept = near_duplicates(rows, row_col=row).filter("kept").select(row)
    return rows.join(kept.hint("merge"), row, "left_semi").select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of REPEATED bytes that stand anywhere else too are cut out of the texts; every document stays, n_chars is counted again."""
    row = unused_name(docs, "_row")
    cut = cut_repeats(Workspace(spark, "suffix-dedup").keyed(docs, "rows", row), row, length=REPEATED)
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else cut[c] for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; repeats are rows. Texts without words are never taken."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row per row; null and empty texts have no tokens."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("pieces", pieces)]

#: Sketches, suffixes and pieces are not expressible in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
