"""Near-duplicate embeddings by int8 tile products (operator 4).

Distinct vectors are dealt to tiles. Every pair of tiles meets in one task: products of the int8 codes bound each cosine from above,
by the exact quantisation error of both vectors, and only pairs that may reach the threshold are computed in double precision from the
vectors themselves. A task returns a number of links per vector and, for what it found connected, stars: never its pairs.

All pairs are compared, which no index is trusted to do; the work grows with the square of the distinct vectors, the memory of a task and
what is shuffled per tile do not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import Workspace, grouped
from veilframe.llm.components import connected_components

THRESHOLD = 0.95
TILE = 4096
#: More than the rounding of float32 sums of products of unit vectors, and of the double cosine itself.
SLACK = 1e-9


def _parsed(kind: type, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if v is None else np.array([np.nan if x is None else x for x in v], kind) for v in batch.column(1).to_pylist()]
            ok = [v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any()) for v in vectors]
            raw = [v.tobytes() if good else None for v, good in zip(vectors, ok)]
            prints = [xxhash.xxh3_128_intdigest(r) if r else 0 for r in raw]
            signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
            columns = [batch.column(0), pa.array(raw, pa.binary()), pa.array([len(v) if good else 0 for v, good in zip(vectors, ok)], pa.int32()), signed([p >> 64 for p in prints]), signed([p & (2**64 - 1) for p in prints])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


class Tile:
    """Unit vectors of a tile in double precision, their int8 codes, and the exact norm of each one's quantisation error."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        vectors = vectors.astype(np.float64)
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        self.ids, self.weights = ids, weights
        self.unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.scale = float(np.abs(self.unit).max()) / 127
        self.codes = np.rint(self.unit / self.scale).astype(np.int8)
        back = self.codes * self.scale
        self.error = np.linalg.norm(self.unit - back, axis=1)
        self.length = np.linalg.norm(back, axis=1)


def linked_pairs(a: Tile, b: Tile, same: bool, threshold: float = THRESHOLD, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of the pairs with a cosine of at least the threshold, in parts.

    <u, v> <= <u', v'> + |u - u'| + |u'| |v - v'| for quantised u', v', so a pair can only be a link if the product of the codes reaches
    (threshold - error_u - |u'| error_v) / (scale_a scale_b). Sums of int8 products are whole numbers that float32 holds exactly
    up to 2 ** 24; longer vectors are summed in parts.
    """
    other = b.codes.astype(np.float32).T.copy()
    worst, parts = float(b.error.max()), 1040
    for at in range(0, len(a.codes), rows):
        mine = slice(at, min(at + rows, len(a.codes)))
        codes = a.codes[mine].astype(np.float32)
        product = codes[:, :parts] @ other[:parts]
        for k in range(parts, codes.shape[1], parts):
            product = product.astype(np.float64) + codes[:, k : k + parts] @ other[k : k + parts]
        least = (threshold - a.error[mine] - a.length[mine] * worst - SLACK) / (a.scale * b.scale)
        flat = np.flatnonzero(product >= np.floor(least)[:, None].astype(product.dtype))
        i, j = flat // product.shape[1], flat % product.shape[1]
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        near = product[i - at, j] * (a.scale * b.scale) + a.error[i] + a.length[i] * b.error[j] >= threshold - SLACK
        i, j = i[near], j[near]
        for k in range(0, len(i), 65_536):
            x, y = i[k : k + 65_536], j[k : k + 65_536]
            cosine = np.einsum("nd,nd->n", a.unit[x], b.unit[y])
            yield x[cosine >= threshold], y[cosine >= threshold]


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position connected with each, by spreading minima over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile_of(table: pa.Table, kind: type) -> Tile:
    first = {}
    for k, x in enumerate(table.column("id").to_pylist()):
        first.setdefault(x, k)
    keep = list(first.values())
    raw = table.column("raw").to_pylist()
    return Tile(np.array(list(first)), table.column("weight").to_numpy()[keep], np.stack([np.frombuffer(raw[k], kind) for k in keep]))


def _meet(kind: type, threshold: float):
    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        sides = np.array(table.column("side").to_pylist())
        same = key[1] == key[2]
        left = _tile_of(table.filter(pa.array(sides == 0)), kind)
        right = left if same else _tile_of(table.filter(pa.array(sides == 1)), kind) if (sides == 1).any() else None
        if right is None:
            return
        n = len(left.ids)
        links = np.zeros(n + (0 if same else len(right.ids)), np.int64)
        shift = 0 if same else n
        ids = left.ids if same else np.r_[left.ids, right.ids]
        froms, tos = [], []
        for x, y in linked_pairs(left, right, same, threshold):
            np.add.at(links, x, right.weights[y])
            np.add.at(links, y + shift, left.weights[x])
            froms.append(x)
            tos.append(y + shift)
        if not froms:
            return
        label = _stars(len(ids), np.concatenate(froms), np.concatenate(tos))
        hit = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit], pa.int64()), pa.array(ids[label[hit]], pa.int64()), pa.array(links[hit])], names=["id", "root", "links"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """id, n_links, component_id, kept for every input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of different lengths. Equal
    vectors are compared once and all linked: n_links counts rows. Labels and other columns are not read. Rows without an id get
    no component and are kept.
    """
    work = Workspace(vectors.sparkSession, "vectors")
    double = vectors.schema[vector_col].dataType.elementType.typeName() == "double"
    kind = np.float64 if double else np.float32
    names = ["id", "raw", "dim", "fp1", "fp2"]
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(_parsed(kind, names), "id long, raw binary, dim int, fp1 long, fp2 long")
    rows = work.put(rows, "rows")
    usable = rows.filter("id is not null and raw is not null")
    classes = work.put(usable.groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("dim").alias("dim")), "classes")
    reps = usable.join(classes.select(F.col("rep").alias("id"), "fp1", "fp2", "weight"), ["id", "fp1", "fp2"])
    tiles = classes.groupBy("dim").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    dealt = reps.join(F.broadcast(tiles), "dim").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    dealt = work.put(dealt.select("dim", "tile", "tiles", "id", "weight", "raw"), "dealt")
    # Tile t stands on the left of its pairs with later tiles and itself, on the right of those with earlier ones.
    left = dealt.withColumn("a", F.col("tile")).withColumn("b", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1))).withColumn("side", F.lit(0))
    right = dealt.filter("tile > 0").withColumn("b", F.col("tile")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile") - 1))).withColumn("side", F.lit(1))
    both = left.unionByName(right).select("dim", "a", "b", "side", "id", "weight", "raw")
    met = work.put(grouped(both, ["dim", "a", "b"], _meet(kind, threshold), "id long, root long, links long"), "met")
    components = connected_components(met.select(F.col("id").alias("a"), F.col("root").alias("b")), work, "c")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    resolved = classes.join(links, F.col("rep") == F.col("id"), "left").drop("id").join(components, F.col("rep") == F.col("id"), "left").drop("id")
    resolved = resolved.select("fp1", "fp2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    resolved = work.put(resolved, "resolved")
    work.drop("dealt", "met")
    # Rows that link with nothing have the print 0, which no class has.
    out = rows.select("id", "fp1", "fp2").join(resolved, ["fp1", "fp2"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
