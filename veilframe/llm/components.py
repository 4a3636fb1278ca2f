"""Connected components of a distributed edge list, by alternating large and small stars.

Each partition of edges is first contracted to stars of its own, so rounds only join what partitions share, and edges that
fit in one partition need no round. Every step is a minimum per node (combined before the shuffle) joined back to the edges;
both sides of that join are written tables, so adaptive execution can split the partition of a node with very many edges.
Nothing is gathered on the driver but two numbers per round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import Workspace

EDGES_EACH = 250_000  # of one partition
HELD_EDGES = 1_000_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars around the smallest id of what the edges (a, b) of a partition connect, at most HELD_EDGES at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in (0, 1)]))
        if sum(x.shape[1] for x in held) >= HELD_EDGES:
            yield _stars(held)
            held = []
    if held:
        yield _stars(held)


def _stars(held: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate(held, axis=1)
    ids, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(ends.shape)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    leaf = label != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[label[leaf]])], names=["hi", "lo"])


def _members(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(stars.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def connected_components(edges: DataFrame, work: Workspace, tag: str) -> DataFrame:
    """(id, component) for the end points of edges (a, b); component is the smallest id of the component.

    Loops and repeated edges are allowed. Ids without an edge do not appear.
    """
    kept = edges.filter("a <> b").select("a", "b")
    parts = max(1, -(-kept.count() // EDGES_EACH))
    # Few edges take few tasks: coalescing needs no shuffle.
    put = lambda df, name: work.put(df.coalesce(parts), name)
    stars = kept.coalesce(parts).mapInArrow(_contracted, "hi long, lo long")
    if parts == 1:
        return _members(put(stars, f"{tag}-0"))
    e = put(stars.distinct(), f"{tag}-0")
    before, last = None, f"{tag}-0"
    for n in count():
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}-l{n}")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = put(large, f"{tag}-L{n}")
        low = put(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{tag}-s{n}")
        small = large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = small.union(low.select("hi", F.col("m").alias("lo"))).distinct()
        e = put(small, f"{tag}-{n + 1}")
        work.drop(last, f"{tag}-l{n}", f"{tag}-L{n}", f"{tag}-s{n}")
        last = f"{tag}-{n + 1}"
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first())
        if now == before:
            break
        before = now
    return _members(e)
