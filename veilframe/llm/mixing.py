"""Mixing sources to target weights by weighted fair queueing (operator 9).

Every document of a source stands in a queue whose order is a hash of its id. Its virtual finish time is the words of
its source up to and with it, divided by the source's target; a second and third copy follow a whole source later.
The mix is the queue of all sources sorted by finish time over the cluster and cut where the total budget is used up.

No source is ever handled by one task: the running sum within a source is a sum over hash buckets, in two levels, plus a running
sum inside a bucket. The cut is found from the sums of the sorted ranges, then inside one of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm._shared import Workspace, range_sorted, unused_name, words_column

#: Rows of the whole table for each bucket that a source is cut into; small, so that a source with most rows is cut fine enough to deal out evenly.
BUCKET_ROWS = 500
COPIES = 3


def source_targets(sizes: DataFrame, work: Workspace, weights: tuple[int, ...] = (1, 2, 3), copies: int = COPIES) -> DataFrame:
    """sid, source_size, target for a table (sid, source, source_size) with one row per source.

    Shares by weight, at most ``copies`` times a source's size, what is over given to the others by weight until none is
    above: a level L with target = min(copies * size, L * weight), raised until the sources below it stay the same.
    """
    ranked = range_sorted(sizes, [F.col("source").asc_nulls_last()], work, "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("start")
    weighed = ranked.join(F.broadcast(starts), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    weighed = work.put(weighed.select("sid", "source_size", "weight", (F.col("source_size") * copies).alias("cap")), "weighed")
    level = 0.0
    while True:
        below = F.col("cap") / F.col("weight") < level
        total, capped, weight = weighed.agg(F.sum("source_size"), F.sum(F.when(below, F.col("cap"))), F.sum(F.when(~below, F.col("weight")))).first()
        raised = (total - (capped or 0)) / weight if weight else math.inf
        if weight is None or raised <= level:
            break
        level = raised
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select("sid", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), row_col: str | None = None) -> DataFrame:
    """id, size, source_size, target, taken, source for every input row, and ``row_col``, a key of rows, if there is one.

    Texts without words (null, empty) have size 0 and are never taken; texts are read whole. A null source is a source of its own, the
    last. Rows without an id share one place in the order, rows with the same id stand side by side. An empty table gives an empty
    result. Reruns agree: the order depends on ids and ``seed`` only. Other columns are not read.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.xxhash64(F.col(source_col).isNull(), F.col(source_col)).alias("sid"),
        F.size(words_column(F.col(text_col))).cast("long").alias("size"),
        key.alias("h"),
        *([F.col(row_col).cast("long").alias("row")] if row_col else []),
    )
    row = ["row"] if row_col else []
    sized = work.put(sized, "sized")
    buckets = max(16, -(-sized.count() // BUCKET_ROWS))
    shelf = math.isqrt(buckets)  # buckets whose sums are added up first
    sized = sized.withColumn("bucket", (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(2**32)).cast("int"))
    sums = work.put(sized.groupBy("sid", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size")).withColumn("shelf", F.floor(F.col("bucket") / shelf)), "sums")
    targets = source_targets(sums.groupBy("sid").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size")), work, weights)

    def earlier(column: str, order: str, *by: str):
        return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    shelves = sums.groupBy("sid", "shelf").agg(F.sum("bucket_size").alias("shelf_size")).withColumn("shelf_offset", earlier("shelf_size", "shelf", "sid")).drop("shelf_size").join(targets, "sid")
    offsets = sums.withColumn("offset", earlier("bucket_size", "bucket", "sid", "shelf")).join(shelves.hint("merge"), ["sid", "shelf"])
    offsets = work.put(offsets.select("sid", "bucket", (F.col("offset") + F.col("shelf_offset")).alias("offset"), "source_size", "target"), "offsets")
    within = Window.partitionBy("sid", "bucket").orderBy("h", "id", *row).rowsBetween(Window.unboundedPreceding, 0)
    queue = sized.withColumn("run", F.sum("size").over(within)).join(offsets.hint("merge"), ["sid", "bucket"])
    queue = queue.select("id", "source", "size", "source_size", "target", "h", (F.col("offset") + F.col("run")).alias("upto"), *row)
    queue = work.put(queue, "queue")
    budget = sums.agg(F.coalesce(F.sum("bucket_size"), F.lit(0))).first()[0]
    work.drop("sized", "sums", "offsets", "ranked", "weighed")

    finish = lambda copy: (F.col("upto") + F.col("source_size") * copy) / F.col("target")
    live = (F.col("size") > 0) & (F.col("target") > 0)
    order = ["finish", "h", "id", *row]
    copies = queue.filter(live).select("id", "h", "size", *row, F.explode(F.array(*[finish(c) for c in range(COPIES)])).alias("finish"))
    line = range_sorted(copies, order, work, "line")
    # At most 10,000 ranges, so their sums may come to the driver.
    used, cut = 0, None
    for r in line.groupBy("part").agg(F.sum("size").alias("words")).orderBy("part").collect():
        if used + r["words"] > budget:
            cut = r["part"]
            break
        used += r["words"]
    last = None
    if cut is not None:
        inside = line.filter(F.col("part") == cut).withColumn("run", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        last = inside.filter(F.col("run") <= budget - used).agg(F.max(F.struct(*order)).alias("e")).first()["e"]
        last = last or line.filter(F.col("part") < cut).agg(F.max(F.struct(*order)).alias("e")).first()["e"]
    work.drop("line")

    def is_taken(copy: int):
        if cut is None:
            return F.col("size")
        if last is None:
            return F.lit(0)
        # Rows with equal times and hashes have equal ids.
        place = [(finish(copy), F.lit(last["finish"])), (F.col("h"), F.lit(last["h"])), *[(F.col(r), F.lit(last[r]).cast("long")) for r in row]]
        before = F.lit(True)
        for here, edge in reversed(place):
            before = (here < edge) | ((here == edge) & before)
        return F.when(before, F.col("size")).otherwise(F.lit(0))

    taken = F.when(live, sum((is_taken(c) for c in range(1, COPIES)), is_taken(0))).otherwise(F.lit(0)).cast("long")
    return queue.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "source", *([F.col("row").alias(row_col)] if row_col else []))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each input row as often as the mix takes it, with the columns of the input. Rows without an id are rows as others."""
    row, n = unused_name(docs, "_mix_row"), unused_name(docs, "_mix_n")
    rows = Workspace(docs.sparkSession, "mixed").keyed(docs, "rows", row)
    taken = mix(rows, id_col=id_col, row_col=row, **options).filter("taken > 0")
    taken = taken.select(F.col(row), F.expr("cast(taken / size as int)").alias(n))
    joined = rows.join(taken.hint("merge"), row)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select([rows[c] for c in docs.columns])
