"""Web archives: writing, reading back, and merging their indexes into capture histories (operator 1).

Writing. Captures with equal payloads keep one copy: the capture with the largest id is a response, the others are revisits that name
it. Each archive holds its records in order of URL key and time, so its index is a sorted run. Records are written by Spark's own
text writer with the record separator of the format, so they go through its commit protocol to any file system it knows.

Merging. The runs are cut at common boundaries, and each cut is merged by a tournament tree of losers over its runs: the
winner is emitted as far as the runner-up allows, then its next key replays its path to the root. The parts follow one another in
global order of URL key, time and id.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm._shared import Workspace, lean

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_EACH, BYTES_EACH = 4000, 256 << 20  # of one archive, at most
SMALL = BYTES_EACH // RECORDS_EACH  # bytes of payloads of which that many fit
ROWS_EACH = 100_000  # index rows that one merge task is meant to hold
EPOCH = "2024-01-01 00:00:00"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: five hex digits are four letters."""
    hexes = F.sha1(payload)
    fives = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexes, i * 5 + 1, 5), 16, 10).cast("int"))
    letter = lambda v, shift: F.substring(F.lit(ALPHABET), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(fives, lambda v: F.concat(letter(v, 15), letter(v, 10), letter(v, 5), letter(v, 0))), "")


def url_key(url: str | None) -> str:
    """Sort-friendly key of an address: host turned round, then path and query; scheme, user, port 80/443 and 'www.' are left out."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    turned = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{turned}){unquote(parts.path).lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([url_key(u) for u in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=["id", "url", "payload", "ts", "key"])


def write_archives(pages: DataFrame, path: str, work: Workspace, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts_col: str | None = None, least: int = 0) -> None:
    """Writes one record per row under ``path``. Payloads below ``least`` bytes are always responses; null payloads are empty.

    Without ``ts_col`` a capture's time is EPOCH plus its id in seconds. Rows with a null id are responses and are not referred to.
    Payloads of more than SMALL bytes go to archives of their own, with as many records as fit in BYTES_EACH by the longest of
    them, so an archive is only longer if one record is; a record of 2 GB and more cannot be read back.
    """
    ts = F.col(ts_col) if ts_col else F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.coalesce(F.col(id_col), F.lit(0)))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), ts.alias("ts"))
    digest = F.unhex(F.sha1(F.col("payload").cast("binary")))
    shared = rows.filter(F.octet_length("payload") >= least).groupBy(digest.alias("d")).agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = work.put(shared, "shared")
    keyed = rows.mapInArrow(_keys, "id long, url string, payload string, ts timestamp, key string").withColumn("d", F.when(F.octet_length("payload") >= least, F.unhex(F.sha1(F.col("payload").cast("binary")))))
    marked = keyed.join(shared, "d", "left").withColumn("refers", F.when(F.col("first") != F.col("id"), F.col("first")))
    end = "\r\n"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(end))
    n = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}"), line("Content-Length", n), F.lit(end))
    block = F.concat(http, F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit("")))
    record = F.concat(
        F.lit(f"WARC/1.1{end}"),
        line("WARC-Type", F.when(F.col("refers").isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload").cast("binary")))),
        F.when(F.col("refers").isNull(), F.lit("")).otherwise(
            F.concat(F.lit(f"WARC-Profile: {PROFILE}{end}"), line("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), F.col("refers").cast("string"), F.lit(">"))))
        ),
        F.lit(f"Content-Type: application/http; msgtype=response{end}"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(end),
        block,
    )
    longest = rows.filter(F.octet_length("payload") > SMALL).agg(F.max(F.octet_length("payload"))).first()[0]
    sorts = [("small", F.octet_length("payload") <= SMALL, RECORDS_EACH)] + ([("large", F.octet_length("payload") > SMALL, max(1, BYTES_EACH // longest))] if longest else [])
    for folder, own, most in sorts:
        ordered = marked.filter(own).sortWithinPartitions("key", "ts", "id").select(record.alias("value"))
        ordered.write.option("lineSep", end * 2).option("maxRecordsPerFile", most).text(f"{path}/{folder}")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields (names in lower case) and block of each record, by its declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode()
        if not head.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.split("\r\n")[1:])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, stop - at, fields, data[start:stop]
        at = stop + 4


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:capture:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


INDEX = "run string, seq long, key string, ts string, id long, url string, offset long, length long, type string, refers long, digest string, n long"


def _index(full: bool):
    names = [x.split()[0] for x in INDEX.split(", ")] + ["payload"] * full
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in INDEX.split(", ")] + [pa.string()] * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                for seq, (at, length, fields, block) in enumerate(records(data.as_py())):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    url, kind = fields.get("warc-target-uri"), fields["warc-type"]
                    declared = int(re.search(rb"(?i)^content-length: *(\d+)", head, re.M)[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (declared != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"the payload of {fields['warc-record-id']} is not what was written")
                    row = (name.rpartition("/")[2], seq, url_key(url), fields["warc-date"], _number(fields["warc-record-id"]), url, at, length, kind, _number(fields.get("warc-refers-to")), digest, declared)
                    rows.append(row + ((payload.decode(),) if full else ()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """The index of all archives under ``path``, one row per record; with ``full`` also the payload (empty for revisits)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_index(full), INDEX + (", payload string" if full else ""))


class LoserTree:
    """Merges sorted runs of (key, row). The root's winner is known; each inner node holds the loser of its match."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [r for r in runs if r]
        self.at = [0] * len(self.runs)
        k = len(self.runs)
        self.nodes = [-1] * k
        self.winner = self._play(1) if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _play(self, node: int) -> int:
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._before(b, a):
            a, b = b, a
        self.nodes[node] = b
        return a

    def _runner_up(self) -> int:
        """The best of the losers on the winner's path."""
        best, node = -1, (self.winner + len(self.runs)) // 2
        while node >= 1:
            if best < 0 or self._before(self.nodes[node], best):
                best = self.nodes[node]
            node //= 2
        return best

    def merged(self) -> Iterator[tuple]:
        k = len(self.runs)
        while k:
            w = self.winner
            run, at = self.runs[w], self.at[w]
            if at >= len(run):
                return
            other = self._runner_up() if k > 1 else -1
            stop = len(run) if other < 0 or self.at[other] >= len(self.runs[other]) else max(at + 1, bisect_right(run, self.runs[other][self.at[other]], at))
            yield from run[at:stop]
            self.at[w] = stop
            node = (w + k) // 2
            while node >= 1:
                if self._before(self.nodes[node], w):
                    w, self.nodes[node] = self.nodes[node], w
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    get = lambda c: table.column(c).to_pylist()
    # A run's rows stand together and in their own order, which is that of the keys.
    runs: list[list[tuple]] = []
    last = None
    for row, (run, key, ts, i) in enumerate(zip(get("run"), get("key"), get("ts"), get("id"))):
        if run != last:
            runs.append([])
            last = run
        runs[-1].append((key, ts, i is not None, i or 0, row))
    order = [k[4] for k in LoserTree(runs).merged()]
    yield from table.take(pa.array(order, pa.int64())).to_batches(max_chunksize=10_000)


def capture_histories(index: DataFrame, rows: int) -> DataFrame:
    """The records of all runs in global order of URL key, time and id; ``rows`` is their number.

    A range gets its piece of each run, put together again by the place in the run; what a merge holds is the index rows of one range.
    """
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_EACH))
    return index.repartitionByRange(parts, "key", "ts", "id").sortWithinPartitions("run", "seq").mapInArrow(lean(_merge), index.schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the pages, reads the archives back and merges their indexes; one row per page, in order of the histories.

    page_id, payload_bytes, payload_digest, record_type, refers_to; then url_key, captured_at, archive and the record's place in it.
    Rows that repeat an id are records of their own; of equal payloads all rows with the largest id are responses. Null and empty
    payloads are records of 0 bytes, null addresses have an empty key. An empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "archives")
    write_archives(pages, work.path("warc"), work, id_col, url_col, payload_col, least=least)
    index = work.put(read_archives(spark, work.path("warc")), "index")
    merged = capture_histories(index, index.count())
    return merged.select(
        F.col("id").alias(id_col), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").alias("refers_to"),
        F.col("key").alias("url_key"), F.col("ts").alias("captured_at"), F.col("run").alias("archive"), "offset", "length",
    )
