"""Removal of repeated byte strings by suffix sorting (operator 2).

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else in the corpus.

Windows of that length are dealt to the corpus-wide comparison by an anchor, the window's smallest hash of GRAM bytes: equal
windows have equal anchors, so windows with different anchors are never compared. Consecutive windows of one anchor are a run,
one row of a few numbers. Copies of a run are counted with a combining aggregation and stand for one another from there on, so
thousands of copies of a passage are a few rows by the time they are shuffled. Of each anchor with runs that differ, one copy of
each goes to a suffix sort:

* suffixes smaller than their successor are sorted directly,
* the others are induced from them by scanning the buckets of first bytes in order,
* common prefixes of neighbours of at least ``length`` bytes then mark the windows that occur twice.

A hot anchor, with more than MOST_RUNS different runs, is split before it is sorted. Windows are told apart by where the anchor
stands in them, in ranges of WIDTHS; all windows of a range hold the same bytes around the anchor, and equal windows have equal ones, so
these bytes deal the parts of the runs to groups of their own. Groups that are still too large are split by the next width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from veilframe.llm._shared import Workspace, byte_slices, grouped, lean, unused_name

LENGTH = 400
GRAM = 100
CHUNK = 1 << 19  # bytes of a text hashed at once
BLOCK_BYTES = 1 << 19  # bytes of contested runs sorted at once
MOST_RUNS = 1024  # different runs of an anchor that one sort takes
WIDTHS = (64, 8, 1)  # windows of one part of a run; of one window, all in a group are equal

_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_LOW = np.uint64((1 << 20) - 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def runs_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window start of each run of windows with one anchor."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data, wide = np.frombuffer(text, np.uint8), length - gram + 1
    hashes, firsts, lasts = [], [], []
    for at in range(0, len(data) - length + 1, CHUNK):
        piece = data[at : at + CHUNK + length - 1]
        h = _gram_hashes(piece, gram)
        key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes is the smallest
        n = len(h) - wide + 1
        rows = -(-len(key) // wide)
        table = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
        table[: len(key)] = key
        table = table.reshape(rows, wide)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        hashes.append(h[anchor[first]].view(np.int64))
        firsts.append(first + at)
        lasts.append(np.r_[first[1:] - 1, n - 1] + at)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (id, anchor, run, n, s, e): runs with their number in the text, and with a null anchor what repeats inside it."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in byte_slices(batch, 1):
                columns: list[list] = [[] for _ in names]
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = (text or "").encode()
                    anchors, first, last = runs_of(raw, length, gram)
                    if not len(anchors):
                        continue
                    view = memoryview(raw)
                    prints = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first)).view(np.int64)
                    _, index, counts = np.unique(np.stack([anchors, prints], 1), axis=0, return_index=True, return_counts=True) if len(np.unique(prints)) < len(prints) else (0, np.arange(len(prints)), np.ones(len(prints), np.int64))
                    if len(index) < len(prints):
                        twice = np.isin(prints, prints[index[counts > 1]])
                        for s, e in _merged([(a, b + length) for a, b in zip(first[twice].tolist(), last[twice].tolist())]):
                            for c, v in zip(columns, (i, None, None, 0, s, e)):
                                c.append(v)
                    columns[0] += [i] * len(index)
                    columns[1] += anchors[index].tolist()
                    columns[2] += prints[index].tolist()
                    columns[3] += counts.tolist()
                    columns[4] += first[index].tolist()
                    columns[5] += (last[index] + length).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def suffix_order(pieces: list[bytes], wanted: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, piece starts, and the suffixes of the first ``wanted[k]`` positions of each piece in order, by two-stage sorting.

    Pieces end in a separator smaller than any byte; comparisons end there, ties are in order of position.
    """
    lens = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(np.r_[0, lens + 1])[:-1]
    raw = b"\0".join(pieces) + b"\0"
    text = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    ends = starts + lens
    text[ends] = 0
    n = len(text)
    # Smaller than the successor? Equal bytes have the type of the next that differs.
    differ = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]
    change = differ[np.searchsorted(differ, np.arange(n))]
    small = np.r_[text, 0][np.minimum(change + 1, n)] > text[change]
    small[ends] = False
    # A wanted suffix needs its successors up to the first that is sorted directly, or the end.
    stops = np.r_[np.flatnonzero(small | (text == 0)), n]
    limit = np.minimum(stops[np.searchsorted(stops, starts + np.array(wanted, np.int64) - 1)], ends)
    active = np.zeros(n + 1, np.int8)
    np.add.at(active, starts, 1)
    np.add.at(active, limit + 1, -1)
    active = np.cumsum(active[:-1]) > 0
    direct = np.flatnonzero(active & small & (text > 0))
    piece_end = np.repeat(ends, lens + 1)
    two = text[direct].astype(np.int32) * 512 + text[direct + 1]
    direct = direct[np.argsort(two, kind="stable")]
    cuts = np.r_[0, np.flatnonzero(np.diff(np.sort(two))) + 1, len(direct)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a > 1:
            at = direct[a:b].tolist()
            to = piece_end[direct[a:b]].tolist()
            keys = [raw[p:q] for p, q in zip(at, to)]
            direct[a:b] = [at[k] for k in sorted(range(b - a), key=keys.__getitem__)]
    bound = np.searchsorted(text[direct], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    large = active & ~small & (text > 0)
    order: list[np.ndarray] = []

    def scan(found: np.ndarray, c: int) -> np.ndarray:
        before = found[found > 0] - 1
        before = before[large[before]]
        first = text[before]
        same = before[first == c]
        before, first = before[first != c], first[first != c]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cut = np.r_[0, np.flatnonzero(np.diff(first)) + 1, len(before)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b > a:
                induced[first[a]].append(before[a:b])
        return same

    scan(ends, 0)
    for c in range(1, 257):
        found = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(found):
            order.append(found)
            found = scan(found, c)
        sorted_ = direct[bound[c] : bound[c + 1]]
        if len(sorted_):
            order.append(sorted_)
            scan(sorted_, c)
    return text, starts, np.concatenate(order) if order else np.zeros(0, np.int64)


def common_prefixes(raw: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the next one, up to ``most`` bytes; suffixes have as many."""
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    words = np.zeros(len(raw), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(raw)].astype(np.uint64) << np.uint64(8 * k)
    a, b = order[:-1], order[1:]
    out = np.full(len(a), most, np.int64)
    alive = np.arange(len(a))
    for at in range(0, most, 8):
        # Past the end of the text two suffixes are no longer both of ``most`` bytes.
        x = words[np.minimum(a[alive] + at, len(raw) - 1)] ^ words[np.minimum(b[alive] + at, len(raw) - 1)]
        ended = x != 0
        low = x[ended] & (~x[ended] + np.uint64(1))
        out[alive[ended]] = np.minimum(at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3), most)
        alive = alive[~ended]
    return out


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece the starts of its windows that also occur at another place of the pieces."""
    wanted = [len(p) - length + 1 for p in pieces]
    text, starts, order = suffix_order(pieces, wanted)
    owner = np.searchsorted(starts, order, side="right") - 1
    order = order[order - starts[owner] < np.array(wanted)[owner]]
    equal = common_prefixes(b"\0".join(pieces) + b"\0", order, length) >= length
    hit = np.zeros(len(text), bool)
    hit[order[:-1][equal]] = True
    hit[order[1:][equal]] = True
    return [np.flatnonzero(hit[s : s + w]) for s, w in zip(starts.tolist(), wanted)]


def _spans(starts: np.ndarray, base: int, length: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [(base + a, base + b + length) for a, b in zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist())]


def _contested(length: int):
    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, first, alone, pieces = (table.column(c).to_pylist() for c in ("id", "s", "alone", "bytes"))
        rows = [(i, s, e) for i, base, one, hits in zip(ids, first, alone, repeated_windows(pieces, length)) if one for s, e in _spans(hits, base, length)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["id", "s", "e"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for part in byte_slices(batch, 1):
            z = [squeeze.compress((t or "").encode()) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z, pa.binary()), *part.columns[2:]], names=["id", "z", *part.schema.names[2:]])


def _packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    squeeze = zstandard.ZstdCompressor(level=1)
    yield from lean(lambda it: (pa.array([squeeze.compress((t.as_py() or "").encode()) for t in x], pa.binary()) for x in it))(texts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that are listed for each text."""
    names = ["id", "grp", "alone", "hot", "s", "bytes"]
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for i, z, runs in zip(*(batch.column(k).to_pylist() for k in range(3))):
            raw = expand.decompress(z, max_output_size=1 << 31)
            for r in runs:
                for c, v in zip(columns, (i, r["grp"], r["alone"], r["hot"], r["s"], raw[r["s"] : r["e"]])):
                    c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def parts_of(run: bytes, width: int, length: int, gram: int) -> Iterator[tuple[int, bytes, int, int]]:
    """Range, common bytes, start and end of the parts of a run whose windows have the anchor in ranges of ``width`` places."""
    with np.errstate(over="ignore"):
        at = int(np.argmin(_gram_hashes(np.frombuffer(run, np.uint8), gram) & ~_LOW))
    first, last = at - (len(run) - length), at  # places of the anchor in the last and in the first window
    for k in range(max(first, 0) // width, last // width + 1):
        low, high = max(first, k * width), min(last, k * width + width - 1)
        core = run[max(at - k * width, 0) : at - (k * width + width - 1) + length]
        yield k, core, at - high, at - low + length


def _split(width: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "grp", "part", "alone", "s", "bytes"]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for i, grp, one, base, raw in zip(*(batch.column(k).to_pylist() for k in range(5))):
                for k, core, s, e in parts_of(raw, width, length, gram):
                    group = xxhash.xxh3_64_intdigest(core + grp.to_bytes(8, "little", signed=True) + k.to_bytes(4, "little")) - 2**63
                    for c, v in zip(columns, (i, group, xxhash.xxh3_64_intdigest(raw[s:e]) - 2**63, one, base + s, raw[s:e])):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _without(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of stretches that are cut out."""
    cuts = _merged([(s["s"], s["e"]) for s in spans or ()])
    return b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(raw)])), len(cuts)


def _left(packed: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The text that is left of a packed one, without the bytes of characters that were cut in half."""
    expand = zstandard.ZstdDecompressor()
    kept = lambda z, spans: _without(expand.decompress(z.as_py(), max_output_size=1 << 31), spans.as_py())[0].decode(errors="ignore")
    yield from lean(lambda it: (pa.array([kept(*x) for x in zip(*columns)], pa.string()) for columns in it))(packed)


def _finish(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[list] = [[] for _ in range(6 if full else 5)]
            for i, z, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = expand.decompress(z, max_output_size=1 << 31)
                kept, cuts = _without(raw, spans)
                out = (i, len(raw), len(raw) - len(kept), cuts, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if full else None)
                for c, v in zip(rows, out):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names[: len(rows)])

    return run


def _sorted(pieces: DataFrame, length: int) -> DataFrame:
    """(id, s, e): what the suffix sort finds in pieces (id, grp, alone, s, bytes), many groups to a block."""
    total = pieces.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    dealt = pieces.select("id", "s", "alone", "bytes", F.pmod(F.xxhash64("grp"), F.lit(blocks)).alias("block"))
    return grouped(dealt, ["block"], _contested(length), "id long, s long, e long")


def repeated_spans(source: DataFrame, work: Workspace, length: int, most_runs: int) -> DataFrame:
    """(id, spans) of the texts with repeated strings, for a written table (id, text) whose ids are keys of rows."""
    gram = min(GRAM, max(1, length // 4))
    names = ["id", "anchor", "run", "n", "s", "e"]
    runs = work.put(source.mapInArrow(lean(lambda it: _runs(it, length, gram, names)), ", ".join(f"{c} long" for c in names)), "runs")
    each = runs.filter("anchor is not null").groupBy("anchor", "run").agg(F.sum("n").alias("n"), F.min(F.struct("id", "s", "e")).alias("rep"))
    each = work.put(each, "each")
    anchors = each.groupBy("anchor").agg((F.count("*") > most_runs).alias("hot"), F.count("*").alias("runs")).filter("runs > 1").drop("runs")
    whole = each.filter("n > 1").select("anchor", "run")
    # These joins are with tables that grow with the input, so none is broadcast however small.
    spans = runs.filter("n = 1").join(whole.hint("merge"), ["anchor", "run"]).select("id", "s", "e").union(runs.filter("anchor is null").select("id", "s", "e"))
    spans = work.put(spans, "whole")
    work.drop("runs")

    contested = each.join(work.put(anchors, "anchors").hint("merge"), "anchor")
    contested = contested.select("rep.id", F.struct(F.col("anchor").alias("grp"), (F.col("n") == 1).alias("alone"), "hot", "rep.s", "rep.e").alias("r"))
    contested = work.put(contested.groupBy("id").agg(F.collect_list("r").alias("r")), "contested")
    work.drop("each", "anchors")
    packed = source.mapInArrow(lean(_pack), "id long, z binary")
    pieces = packed.join(contested.hint("merge"), "id").mapInArrow(lean(_cut), "id long, grp long, alone boolean, hot boolean, s long, bytes binary")
    pieces = work.put(pieces, "pieces0")
    work.drop("contested")
    for level, width in enumerate(WIDTHS):
        spans = spans.union(work.put(_sorted(pieces.filter("not hot"), length), f"sorted{level}"))
        if not pieces.filter("hot").limit(1).count():
            break
        schema = "id long, grp long, part long, alone boolean, s long, bytes binary"
        parts = work.put(pieces.filter("hot").select("id", "grp", "alone", "s", "bytes").mapInArrow(lean(_split(width, length, gram)), schema), f"parts{level}")
        n = F.sum(F.when(F.col("alone"), 1).otherwise(2))
        different = work.put(parts.groupBy("grp", "part").agg(n.alias("n"), F.min(F.struct("id", "s")).alias("rep"), F.first("bytes").alias("bytes")), f"different{level}")
        again = parts.filter("alone").join(different.filter("n > 1").select("grp", "part").hint("merge"), ["grp", "part"])
        spans = spans.union(work.put(again.select("id", "s", (F.col("s") + F.length("bytes")).alias("e")), f"again{level}"))
        groups = different.groupBy("grp").agg((F.count("*") > most_runs).alias("hot"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
        left = different.join(work.put(groups, f"groups{level}").hint("merge"), "grp").select("rep.id", "grp", (F.col("n") == 1).alias("alone"), "hot", "rep.s", "bytes")
        pieces = work.put(left, f"pieces{level + 1}")
        work.drop(f"pieces{level}", f"parts{level}", f"different{level}", f"groups{level}")
    by_text = work.put(spans.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    work.drop("whole", *(f"{x}{k}" for k in range(len(WIDTHS) + 1) for x in ("pieces", "sorted", "again")))
    return by_text


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, full: bool = False, most_runs: int = MOST_RUNS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every input row, with ``full`` also kept_text.

    Null and empty texts have no bytes. Strings are judged on the input: of two copies both go. A repeated row is another place,
    so its text goes too if it is long enough. kept_text drops the bytes of characters that were cut in half. Texts are read
    whole; other columns are not read. Rows are told apart by keys of their own, so ids may be null or repeat. An empty table
    gives an empty result.
    """
    work = Workspace(docs.sparkSession, "suffix")
    source = work.keyed(docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("own")), "source", "id").select("id", "text", "own")
    by_text = repeated_spans(source.select("id", "text"), work, length, most_runs)
    packed = source.mapInArrow(lean(_pack), "id long, z binary, own long")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if full else "")
    return packed.join(by_text.hint("merge"), "id", "left").select("own", "z", "spans").mapInArrow(lean(_finish(full)), schema).withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, row_col: str, text_col: str = "text", length: int = LENGTH, most_runs: int = MOST_RUNS) -> DataFrame:
    """docs with the texts that ``remove_repeats`` calls kept_text; null texts become empty, other columns are as they were.

    docs is a written table and ``row_col`` a key of its rows, so no copy of the texts is made, and they are shuffled with their rows.
    """
    work, spans = Workspace(docs.sparkSession, "suffix"), unused_name(docs, "_spans")
    found = repeated_spans(docs.select(F.col(row_col).cast("long").alias("id"), F.col(text_col).alias("text")), work, length, most_runs)
    packed = docs.withColumn(text_col, F.arrow_udf(_packed, BinaryType())(text_col))
    joined = packed.join(found.select(F.col("id").alias(row_col), F.col("spans").alias(spans)).hint("merge"), row_col, "left")
    return joined.withColumn(text_col, F.arrow_udf(_left, StringType())(text_col, spans)).select(docs.columns)
