"""The mapping store: versions of the mapping and its counters in a folder, one commit per batch.

A version is two Parquet tables in a folder of its own. It comes into force by one rename of a small finished file to the next number
under ``commits``, which fails if that number is taken. Nothing in force is ever deleted or overwritten, so readers always see a whole
version, a writer that dies leaves only files that nobody reads, and of two writers that read one version the second fails.
Commits carry the number of the last batch of each stream, so a batch that is repeated issues nothing. Values and displays can be
encrypted with AES-GCM; the key is handed to each use and is not kept.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.anonymize import MAPPING, issue_codes, settled

COUNTERS = "entity_type string, last_ordinal long"


class MappingStore:
    """A mapping in a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, key: bytes | None = None):
        if key is not None and len(key) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")
        self.spark, self.path, self._key = spark, path.rstrip("/"), key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict]:
        """Number and content of the last commit; 0 and nothing before the first."""
        folder = self._path(f"{self.path}/commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number:
            return 0, {"version": None, "batches": {}}
        stream = self._fs.open(self._path(f"{self.path}/commits/{number:012d}"))
        try:
            return number, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> str | None:
        return self._latest()[1]["version"]

    def _crypt(self, df: DataFrame, function: str) -> DataFrame:
        if self._key is None:
            return df
        # The key travels as a one-row table: as a literal it would show in plans.
        key = F.broadcast(self.spark.createDataFrame([(bytearray(self._key),)], "_key binary"))
        both = df.join(key)
        if function == "encrypt":
            change = lambda c: F.base64(F.aes_encrypt(F.col(c), F.col("_key")))
        else:
            change = lambda c: F.aes_decrypt(F.unbase64(F.col(c)), F.col("_key")).cast("string")
        return both.withColumns({c: change(c) for c in ("value", "display")}).drop("_key")

    def mapping(self) -> DataFrame:
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], MAPPING)
        return self._crypt(self.spark.read.schema(MAPPING).parquet(f"{self.path}/{v}/mapping"), "decrypt")

    def counters(self) -> DataFrame:
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], COUNTERS)
        return self.spark.read.schema(COUNTERS).parquet(f"{self.path}/{v}/counters")

    def commit(self, mapping: DataFrame, counters: DataFrame, expected: str | None, batch: tuple[str, int] | None = None) -> str:
        """Writes a version and puts it in force; fails if another writer came first since ``expected`` was read."""
        v = f"v-{uuid.uuid4().hex}"
        self._crypt(mapping, "encrypt").write.parquet(f"{self.path}/{v}/mapping")
        counters.write.parquet(f"{self.path}/{v}/counters")
        number, last = self._latest()
        if last["version"] != expected:
            raise RuntimeError("the mapping changed since it was read")
        self._publish(number + 1, {"version": v, "batches": last["batches"] | ({batch[0]: batch[1]} if batch else {})})
        return v

    def _publish(self, number: int, content: dict) -> None:
        jvm = self.spark._jvm
        fresh = self._path(f"{self.path}/pending-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        qualified = lambda p: p.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(qualified(fresh), qualified(self._path(f"{self.path}/commits/{number:012d}")), no_options)
        except Py4JJavaError as e:
            self._fs.delete(fresh, False)
            raise RuntimeError("another writer came first") from e

    def issue(self, seen: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Issues codes for a batch of sightings; without new values or better displays nothing is written.

        ``batch`` is the name of a stream and the number of its batch: one that was issued before gets the mapping as it is.
        """
        last = self._latest()[1]
        if batch and last["batches"].get(batch[0], -1) >= batch[1]:
            return self.mapping()
        before = self.mapping()
        after, counted = issue_codes(seen, before, self.counters())
        after = settled(after)
        if not after.select("entity_type", "value", "display", "code").exceptAll(before.select("entity_type", "value", "display", "code")).limit(1).count():
            return before
        self.commit(after, counted, last["version"], batch)
        return self.mapping()

    def change(self, edit: Callable[[DataFrame], DataFrame]) -> None:
        """Puts an edited mapping in force; the counters stay."""
        expected = self.version()
        self.commit(edit(self.mapping()), self.counters(), expected)
