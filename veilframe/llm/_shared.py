"""Helpers that several operators share: staged tables, bounded Arrow slices, temp paths."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as a column has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Workspace:
    """Tables written to the shared folder and read again: lineage ends there, so a lost executor costs one stage.

    ``put`` writes and rereads; ``drop`` deletes what no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def put(self, df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def keyed(self, df: DataFrame, tag: str, key: str) -> DataFrame:
        """``put`` with a column that tells every row from all others, where ids can be null or repeat."""
        return self.put(df.withColumn(key, F.monotonically_increasing_id()), tag)

    def drop(self, *tags: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for tag in tags:
            p = jvm.org.apache.hadoop.fs.Path(self.path(tag))
            p.getFileSystem(conf).delete(p, True)


def range_sorted(df: DataFrame, order: list, work: Workspace, tag: str, rows_each: int = 50_000, most: int = 10_000) -> DataFrame:
    """A written copy of df in one global order, with ``part``, the number of a row's range: at most ``most`` ranges of about ``rows_each`` rows."""
    parts = max(1, min(most, -(-df.count() // rows_each)))
    return work.put(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), tag)


def lean(step):
    """A step over Arrow batches that gives its memory back when its partition ends, as the worker lives on for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library can
                ctypes.CDLL(None).malloc_trim(0)

    return run


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no slice holds more than ``most`` bytes of one string column, single longer rows aside."""
    start, held = 0, 0
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


#: White space of the contracts: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words_column(text):
    """The words of a text as an array: empty for null and for texts of white space only."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def grouped(df: DataFrame, keys: list[str], fn, schema, partitions: int | None = None) -> DataFrame:
    """Runs ``fn(key, table)`` on the rows of each key; ``fn`` yields record batches of ``schema``.

    Groups are streamed from partitions sorted by key, many small groups to a task, so a group costs no more than its rows.
    The caller bounds the groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            rows = list(zip(*columns))
            start = 0
            for i, key in enumerate(rows):
                if key != at:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield from fn(at, pa.Table.from_batches(held))
                    held, at, start = [], key, i
            held.append(batch.slice(start))
        if held:
            yield from fn(at, pa.Table.from_batches(held))

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(lean(run), schema)
