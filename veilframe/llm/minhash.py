"""Near-duplicate documents by bottom-k sketches (operator 10).

One hash function orders all shingles; a document keeps its k smallest as its sketch. Documents with equal shingle sets are
one class from the start. Inverted lists of the retained values bring classes together; inside a list, sketches of unions
estimate the similarity, and the estimated links make candidate groups. Full shingle sets then confirm the links.

Lists of up to BLOCK members are compared whole. A value in more documents than that is hot, a common passage or a large group of
copies, and says little by itself. A document with hot values among its listed ones is listed under the COLD smallest of its other
retained values too: a link of 0.75 whose hot shingles are at most HOT_SHARE of either text shares at least 3 in 8 of its other shingles.
Only texts that are hot for the most part meet in hot lists. These are dealt in blocks that share a few pivots, the members
with the largest share of hot values (a link that rests on hot values alone joins both texts to such a member) and some others.
Who is not linked to the list's largest component then meets one member of each different set of hot values. So what is compared
grows with the members and the different sets of hot values, not with the square of a list.

Candidate groups larger than BLOCK are dealt like hot lists; what pivots leave open meets every block of its group, each
link being confirmed on full sets. Emitted links are spanning forests, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilframe.llm._shared import Workspace, byte_slices, grouped, lean
from veilframe.llm.components import connected_components

K = 64  # values in a sketch
LISTS = 12  # smallest values of a sketch that have an inverted list: a link of 0.75 shares none with 0.25 ** 12
WORDS = 5
SIMILAR = 75  # percent
ESTIMATE = 0.5  # five standard deviations of the estimate below 0.75
BLOCK = 1024
PIVOTS = 32
COLD = 24  # values that are not hot under which a text with hot ones is listed
HOT_SHARE = 0.6
SHINGLES_EACH = 2_000_000  # shingles of a group that one task may hold

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_P = np.uint64(0x9E3779B185EBCA87)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lowered, words split at ASCII white space."""
    ids: dict[bytes, int] = {}
    split = [(t or "").encode().lower().split() for t in texts]
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, sum(map(len, split)))
    table = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    h = table[flat] if len(flat) else np.zeros(0, np.uint64)
    n = len(h) - words + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(words if n > 0 else 0):
        rolled = rolled * _P + h[k : k + n]
    rolled = _mix(rolled)
    out, at = [], 0
    for ws in split:
        m = len(ws)
        if m >= words:
            one = np.sort(rolled[at : at + m - words + 1])
            out.append(one[np.r_[True, one[1:] != one[:-1]]])
        elif m:
            short = np.uint64(m)
            for x in h[at : at + m]:
                short = short * _P + x
            out.append(_mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def _prints(one: np.ndarray) -> tuple[int, int]:
    """Print of a set in two signed numbers."""
    p = xxhash.xxh3_128_intdigest(one)
    return (p >> 64) - (p >> 127 << 64), (p & 2**64 - 1) - ((p >> 63 & 1) << 64)


def _sketches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in byte_slices(batch, 1):
            with np.errstate(over="ignore"):
                sets = shingle_sets(part.column(1).to_pylist())
            prints = [_prints(s) for s in sets]
            posts = [s[:LISTS].view(np.int64) for s in sets]
            lens = np.cumsum([0, *map(len, posts)]).astype(np.int32)
            post = pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(posts) if posts else np.zeros(0, np.int64)))
            sketch = pa.array([(s[:K] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())
            n = pa.array([len(s) for s in sets], pa.int64())
            fp1, fp2 = (pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1))
            kept = [part.column(k) for k in range(part.num_columns) if k != 1]
            yield pa.RecordBatch.from_arrays([*kept, n, fp1, fp2, post, sketch], schema=schema)


def _forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a dense boolean graph, breadth first."""
    n, out = len(adjacent), []
    free = np.ones(n, bool)
    for root in range(n):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        for u in queue:
            new = np.flatnonzero(adjacent[u] & free)
            free[new] = False
            out += [(u, int(v)) for v in new]
            queue += new.tolist()
    return out


def _counts(parts: list[np.ndarray], width: int) -> np.ndarray:
    """Sets hashed into ``width`` columns; products of rows are never below the sizes of intersections."""
    m = np.zeros((len(parts), width), np.float32)
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    np.add.at(m, (rows, (np.concatenate(parts) % np.asarray(width, parts[0].dtype)).astype(np.int64)), 1)
    return m


def estimated_links(sketches: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix of pairs whose union-sketch estimate reaches ESTIMATE; sketches are sorted."""
    n = len(sketches)
    lens = np.array([len(s) for s in sketches])
    m = _counts(sketches, 4096 if n > 32 else 1 << 12)
    common = m @ m.T
    # A cut sketch is known up to its largest value, a whole set everywhere.
    upto = np.array([int(s[-1]) if len(s) == K else 2**32 for s in sketches], np.int64)
    known = np.stack([np.searchsorted(s.astype(np.int64), upto, side="right") for s in sketches])  # values of i up to the limit of j
    size = np.where(upto[:, None] <= upto[None, :], lens[:, None] + known.T, known + lens[None, :])
    out = common >= ESTIMATE * (size - common)
    np.fill_diagonal(out, False)
    return out | out.T


def exact_links(sets: list[np.ndarray], labels: np.ndarray | None = None, percent: int = SIMILAR) -> list[tuple[int, int]]:
    """Confirmed links that join different labels: a forest over the labels, each link checked on full sets."""
    n = len(sets)
    label = np.arange(n) if labels is None else np.unique(labels, return_inverse=True)[1].copy()
    sizes = np.array([len(s) for s in sets], np.float64)
    width = 1 << int(np.clip(np.ceil(np.log2(8 * max(1, np.median(sizes)))), 12, max(12, np.log2(2**24 / n))))
    m = _counts(sets, width)
    common = m @ m.T
    share = common / (sizes[:, None] + sizes[None, :])
    # |A & B| >= p / (1 + p) * (|A| + |B|), and no set is larger than another by more than 1 / p
    possible = (share >= percent / (100 + percent) - 1e-6) & (100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :]))
    i, j = np.nonzero(np.triu(possible, 1))
    order = np.argsort(-share[i, j], kind="stable")
    i, j = i[order], j[order]
    out, at = [], 0
    while at < len(i):
        stop = min(at + 512, len(i))
        for a, b in zip(i[at:stop].tolist(), j[at:stop].tolist()):
            if label[a] == label[b]:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                out.append((a, b))
                label[label == label[b]] = label[a]
        open_ = label[i[stop:]] != label[j[stop:]]
        i, j, at = i[stop:][open_], j[stop:][open_], 0
    return out


def _edge_batch(ids: list, edges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if edges:
        yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in edges], pa.int64()), pa.array([ids[b] for _, b in edges], pa.int64())], names=["a", "b"])


def _estimate_block(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
    ids = table.column("id").to_pylist()
    first = {x: n for n, x in reversed(list(enumerate(ids)))}
    keep = sorted(first.values())
    raw = table.column("sketch").to_pylist()
    yield from _edge_batch([ids[k] for k in keep], _forest(estimated_links([np.frombuffer(raw[k], np.uint32) for k in keep])))


def _exact_block(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Confirmed links of the sets of one block; of texts that repeat an id, the one with the print of the set counts."""
    with np.errstate(over="ignore"):
        sets = shingle_sets(table.column("text").to_pylist())
    ids = table.column("id").to_pylist()
    prints = table.column("fp1").to_pylist()
    keep = sorted({x: k for k, x in enumerate(ids) if _prints(sets[k])[0] == prints[k]}.values())
    labels = np.array(table.column("label").to_pylist())[keep] if "label" in table.column_names else None
    if keep:
        yield from _edge_batch([ids[k] for k in keep], exact_links([sets[k] for k in keep], labels))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, w): the retained values of sketches."""
    for batch in batches:
        sketches = [np.frombuffer(raw, np.uint32) for raw in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sketches])
        values = np.concatenate(sketches).astype(np.int64) if sketches else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values)], names=["id", "w"])


def _relisted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, w, hot, share, kind) from (id, sketch, hot values): the values under which a text with hot values is listed again.

    ``share`` is the part of its retained values that is hot, ``kind`` tells sets of hot values apart.
    """
    for batch in batches:
        rows: list[list] = [[] for _ in range(5)]
        for i, raw, hot in zip(*(batch.column(k).to_pylist() for k in range(3))):
            values = np.frombuffer(raw, np.uint32).astype(np.int64)
            is_hot = np.isin(values, hot)
            share = float(is_hot.mean())
            listed = [(w, False) for w in values[~is_hot][:COLD].tolist()]
            if share > HOT_SHARE:
                listed += [(w, True) for w in values[is_hot][:LISTS].tolist()]
            kind = xxhash.xxh3_64_intdigest(values[is_hot].tobytes()) - 2**63
            for w, h in listed:
                for c, v in zip(rows, (i, w, h, share, kind)):
                    c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["id", "w", "hot", "share", "kind"])


def _distinct_lists(postings: DataFrame, value: str) -> DataFrame:
    """(value, members) of the lists with several members; of lists with the same members one is enough."""
    lists = postings.groupBy(value).agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("sig"), F.min("id").alias("lo")).filter("members > 1")
    return lists.groupBy("members", "sig", "lo").agg(F.min(value).alias(value)).select(value, "members")


def _up_to(n):
    return F.sequence(F.lit(0).cast("long"), n - 1)


def _dealt(members: DataFrame, blocks: str, pivot) -> DataFrame:
    """Gives each member of a key its block; in keys of several blocks the pivots stand in every block."""
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.col(blocks))
    return members.withColumn("block", F.explode(F.when((F.col(blocks) > 1) & pivot, _up_to(F.col(blocks))).otherwise(F.array(block))))


def _by_hash():
    return F.pmod(F.xxhash64("id", F.lit(2)), F.col("members")) < PIVOTS


def _open(members: DataFrame, labels: DataFrame, key: str, work: Workspace, tag: str) -> tuple[DataFrame, DataFrame]:
    """Members with their component's label, and per key with several components the largest, (key, main, rest)."""
    known = work.put(members.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"), tag)
    sizes = known.groupBy(key, "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy(key).agg(F.max_by("label", F.struct("n", F.col("label"))).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    return known, main.filter("all > most").select(key, "main", (F.col("all") - F.col("most")).alias("rest"))


def _hot_tiles(members: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """(w, a, b, id): what is outside a hot list's largest component with one member of each set of hot values."""
    known, main = _open(members, labels, "w", work, "hot-known")
    known = known.join(main, "w")
    # Of the members with one set of hot values the smallest has the largest share of them, so whom it links with is the most.
    heads = known.groupBy("w", "kind").agg(F.max_by("id", F.struct("share", -F.col("id"))).alias("id"), F.first("rest").alias("rest"))
    heads = work.put(heads, "hot-heads")
    counts = heads.groupBy("w").agg(F.ceil(F.count("*") / BLOCK).alias("head_blocks"))
    rest = known.filter("label <> main").join(counts, "w").select("w", F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("rest") / BLOCK)).alias("a"), F.explode(_up_to(F.col("head_blocks"))).alias("b"), "id")
    heads = heads.join(counts, "w").select("w", F.explode(_up_to(F.ceil(F.col("rest") / BLOCK))).alias("a"), F.pmod(F.xxhash64("id", F.lit(4)), F.col("head_blocks")).alias("b"), "id")
    return rest.unionByName(heads)


def _group_tiles(members: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame:
    """(grp, a, block, id, label): what is outside a group's largest component with all blocks of the group."""
    known, main = _open(members, labels, "grp", work, "group-known")
    known = known.join(main, "grp")
    n_rest = F.ceil(F.col("rest") / BLOCK)
    everyone = known.select("grp", F.explode(_up_to(n_rest)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).alias("block"), "id", "rep", "fp1", "label")
    rest = known.filter("label <> main").select("grp", F.pmod(F.xxhash64("id", F.lit(3)), n_rest).alias("a"), F.explode(_up_to(F.col("blocks"))).alias("block"), "id", "rep", "fp1", "label")
    return everyone.unionByName(rest)


def _estimated(reps: DataFrame, work: Workspace) -> DataFrame:
    """(id, component): candidate groups, what estimated links of at least ESTIMATE connect. Columns of reps: id, post, sketch."""
    edges = "a long, b long"
    # Joins with tables that grow with the input are never broadcast, however small one is by chance.
    with_sketch = lambda m: m.join(reps.select("id", "sketch").hint("merge"), "id")
    postings = reps.select("id", F.explode("post").alias("v"))
    lists = work.put(_distinct_lists(postings, "v"), "lists")
    members = postings.join(lists.filter(F.col("members") <= BLOCK).select("v").hint("merge"), "v")
    links = work.put(grouped(with_sketch(members).select("v", "id", "sketch"), ["v"], _estimate_block, edges), "estimated")
    hot = lists.filter(F.col("members") > BLOCK).select("v")
    if not hot.limit(1).count():
        work.drop("lists")
        return work.put(connected_components(links, work, "g"), "groups")

    touched = work.put(reps.join(postings.join(hot, "v").select("id").distinct(), "id", "left_semi").select("id", "sketch"), "touched")
    values = touched.mapInArrow(_unpacked, "id long, w long")
    hot = work.put(values.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("w"), "hot")
    held = values.join(hot, "w", "left_semi").groupBy("id").agg(F.collect_list("w").alias("held"))
    again = work.put(touched.join(held, "id").mapInArrow(lean(_relisted), "id long, w long, hot boolean, share double, kind long"), "relisted")
    work.drop("lists", "touched")
    relisted = work.put(_distinct_lists(again, "w"), "lists2")
    members = work.put(again.join(relisted, "w").withColumn("blocks", F.ceil(F.col("members") / BLOCK)), "members2")
    best = Window.partitionBy("w").orderBy(F.desc("share"), "id")
    central = members.filter("blocks > 1").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= PIVOTS).select("w", "id", F.lit(True).alias("central"))
    dealt = _dealt(members.join(central, ["w", "id"], "left"), "blocks", F.coalesce("central", _by_hash()))
    links = work.put(links.unionByName(grouped(with_sketch(dealt.select("w", "block", "id")).select("w", "block", "id", "sketch"), ["w", "block"], _estimate_block, edges)), "estimated2")
    groups = work.put(connected_components(links, work, "g"), "groups")
    work.drop("estimated", "relisted", "lists2", "hot")
    large = members.filter("blocks > 1").select("w", "id", "share", "kind")
    if large.limit(1).count():
        tiles = with_sketch(_hot_tiles(large, groups, work)).select("w", "a", "b", "id", "sketch")
        more = grouped(tiles, ["w", "a", "b"], _estimate_block, edges)
        links = work.put(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "estimated3")
        groups = work.put(connected_components(links, work, "h"), "groups2")
        work.drop("groups", "estimated3", "hot-known", "hot-heads")
    work.drop("members2", "estimated2")
    return groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, n_shingles, component_id, kept for every input row, and ``row_col``, a key of rows, if there is one.

    Texts with fewer than five words have one shingle, the whole sequence; texts without words (null, empty) have none and link
    with nothing. Links are transitive in component_id, the smallest id reachable; kept marks it. Repeated rows of an id get
    the same result, rows that share an id but not a text each that of their text; with ``row_col`` only one row of a component is kept. Rows without an id get no component and are kept.
    An empty table gives an empty result. Texts are read whole; other columns of the input are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    schema = "id long, " + "row long, " * bool(row_col) + "n long, fp1 long, fp2 long, post array<long>, sketch binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    sk = work.put(source.mapInArrow(lean(lambda it: _sketches(it, arrow)), schema), "sketch")
    # One row for each different set; from here on ids are those of sets.
    linkable = sk.filter("id is not null and n > 0")
    classes = linkable.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("post").alias("post"), F.first("sketch").alias("sketch"))
    classes = work.keyed(classes, "classes", "id")
    groups = _estimated(classes.select("id", "post", "sketch"), work)

    # Candidate groups, confirmed on full sets.
    sized = groups.hint("merge").join(classes.select("id", "n", "rep", "fp1"), "id").select("id", "n", "rep", "fp1", F.col("component").alias("grp"))
    sized = work.put(sized, "sized")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / SHINGLES_EACH))
    members = work.put(sized.join(sized.groupBy("grp").agg(F.count("*").alias("members"), blocks.alias("blocks")), "grp"), "grouped")
    texts = source.select(F.col("id").alias("rep"), "text").join(members.select("rep").hint("merge"), "rep", "left_semi").withColumn("print", F.xxhash64("text"))
    texts = texts.dropDuplicates(["rep", "print"]).drop("print")
    edges = "a long, b long"
    dealt = _dealt(members, "blocks", _by_hash()).select("grp", "block", "id", "rep", "fp1")
    links = work.put(grouped(dealt.join(texts.hint("merge"), "rep").select("grp", "block", "id", "fp1", "text"), ["grp", "block"], _exact_block, edges), "links")
    labels = work.put(connected_components(links, work, "c"), "labels")
    large = members.filter("blocks > 1")
    if large.limit(1).count():
        tiles = _group_tiles(large, labels, work).join(texts, "rep").select("grp", "a", "block", "id", "fp1", "label", "text")
        more = grouped(tiles, ["grp", "a", "block"], _exact_block, edges)
        links = work.put(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), "links2")
        labels = work.put(connected_components(links, work, "d"), "labels2")
    work.drop("sized", "grouped", "group-known", "links", "links2")
    least = labels.join(classes.select("id", "rep"), "id")
    least = work.put(least.select("id", "component", "rep"), "least")
    smallest = least.join(least.groupBy("component").agg(F.min("rep").alias("smallest")), "component").select("id", F.col("component").alias("node"), "smallest")
    resolved = classes.select("id", "rep", "fp1", "fp2").join(smallest.hint("merge"), "id", "left")
    resolved = resolved.select("fp1", "fp2", F.coalesce("smallest", "rep").alias("component"), *([F.coalesce("node", "id").alias("node")] if row_col else []))
    resolved = work.put(resolved, "resolved")
    work.drop("classes", "labels", "labels2", "least")
    row = ["row"] if row_col else []
    out = sk.select("id", *row, "n", "fp1", "fp2").join(resolved.hint("merge"), ["fp1", "fp2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = out.withColumn("component", F.when(F.col("id").isNotNull(), component)).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
    if row_col:
        # Of the rows that repeat the smallest id of a component one is kept; components of different texts may share an id.
        out = work.put(out.select("id", "row", "n", "component", "node", "kept"), "rows")
        work.drop("sketch", "resolved")
        first = out.filter("kept and id is not null and node is not null").groupBy("node").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
        out = out.join(first.hint("merge"), "row", "left").withColumn("kept", F.col("kept") & (F.col("id").isNull() | F.col("node").isNull() | F.coalesce("first", F.lit(False))))
    columns = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept"]
    return out.select(*columns, *([F.col("row").alias(row_col)] if row_col else []))
