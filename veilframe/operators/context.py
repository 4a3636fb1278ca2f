"""Context of a block: neighbours on a page, labels of cells, keys of JSON leaves.

Each is a join or a window: nearest neighbours are a self-join of a page with a rank, the label above a cell is the last one of an
ordered column, the cell to the left is a lag that must be adjacent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.values import joined_labels, looks_like_a_label

SAME_LINE = 0.3  # share of the narrower extent that must overlap


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two extents as a share of the smaller; 0 where one is empty."""
    smaller = F.least(a1 - a0, b1 - b0)
    return F.when(smaller > 0, F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0)) / smaller).otherwise(0.0)


def page_windows(blocks: DataFrame, radius: int = 1) -> DataFrame:
    """(doc_id, page, block_index, context, start): a block with its nearest neighbours left and above before it, right and below after it, and
    where in that the block itself starts.

    ``blocks`` has doc_id, page, block_index, text, x0, y0, x1, y1; blocks without a page or a box stand alone. The self-join is by page,
    which bounds it; a page is never split.
    """
    placed = blocks.filter("page is not null and x0 is not null")
    other = placed.select("doc_id", "page", *[F.col(c).alias(f"o_{c}") for c in ("block_index", "text", "x0", "y0", "x1", "y1")])
    pairs = placed.join(other, ["doc_id", "page"]).filter("block_index <> o_block_index")
    column = overlap_share(F.col("x0"), F.col("x1"), F.col("o_x0"), F.col("o_x1")) >= SAME_LINE
    row = overlap_share(F.col("y0"), F.col("y1"), F.col("o_y0"), F.col("o_y1")) >= SAME_LINE
    side = (
        F.when(row & (F.col("o_x1") <= F.col("x0")), "left").when(row & (F.col("o_x0") >= F.col("x1")), "right")
        .when(column & (F.col("o_y1") <= F.col("y0")), "above").when(column & (F.col("o_y0") >= F.col("y1")), "below")
    )
    distance = F.greatest(F.col("o_x0") - F.col("x1"), F.col("x0") - F.col("o_x1"), F.col("o_y0") - F.col("y1"), F.col("y0") - F.col("o_y1"))
    near = pairs.withColumn("side", side).filter("side is not null").withColumn("distance", distance)
    rank = F.row_number().over(Window.partitionBy("doc_id", "page", "block_index", "side").orderBy("distance", "o_block_index"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= radius)
    texts = lambda s, far_first: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct((-F.col("rank") if far_first else F.col("rank")).alias("r"), F.col("o_text").alias("t"))))), lambda x: x["t"])
    around = near.groupBy("doc_id", "page", "block_index").agg(*[texts(s, s in ("left", "above")).alias(s) for s in ("left", "above", "right", "below")])
    joined = blocks.join(around, ["doc_id", "page", "block_index"], "left").filter("text is not null")
    none = F.array().cast("array<string>")
    before = F.concat(F.coalesce("left", none), F.coalesce("above", none))
    parts = F.concat(before, F.array("text"), F.coalesce("right", none), F.coalesce("below", none))
    start = F.when(F.size(before) > 0, F.length(F.array_join(before, " | ")) + 3).otherwise(0)
    return joined.select("doc_id", "page", "block_index", F.array_join(parts, " | ").alias("context"), start.alias("start"))


def detect_on_pages(blocks: DataFrame, doc_type: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Blocks of pages with ``findings``: what a block gives alone, and what its neighbours make of it, cut to the block.

    Cells and leaves need no window: their labels go to ``detect`` as its label column. Plain texts have neither.
    """
    from veilframe.functions.spans import FINDINGS, clip
    from veilframe.operators.detect import detect

    keys = ["doc_id", "page", "block_index"]
    alone = detect(blocks, "text", doc_type, types, out="_alone")
    both = detect(page_windows(blocks), "context", doc_type, types, out="_windowed").drop("context")
    # Blocks without a page join their window by null-safe equality.
    joined = alone.join(both.select(*[F.col(k).alias(f"_{k}") for k in keys], "start", "_windowed"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    inside = clip(F.col("_windowed"), F.col("start"), F.col("start") + F.length("text")).cast(FINDINGS)
    return joined.select(*blocks.columns, merge_passes(F.col("_alone"), inside).alias("findings"))


#: Formats whose blocks have neighbours on a page, and those whose blocks have labels.
POSITIONED, LABELLED = ("pdf", "image"), ("csv", "xlsx", "json")


def detect_all(blocks: DataFrame, doc_type: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Blocks of any formats with ``findings``, each read as its ``doc_format`` asks: with its neighbours, with its ``label``, or by itself.

    ``blocks`` has the columns of page_windows, doc_format and label; what a format does not use may be null.
    """
    from veilframe.operators.detect import detect

    form = F.coalesce("doc_format", F.lit(""))
    pages = detect_on_pages(blocks.filter(form.isin(*POSITIONED)), doc_type, types)
    cells = detect(blocks.filter(form.isin(*LABELLED)), "text", doc_type, types, label_col="label")
    plain = detect(blocks.filter(~form.isin(*POSITIONED, *LABELLED)), "text", doc_type, types)
    return pages.unionByName(cells).unionByName(plain)


def merge_passes(alone: Column, windowed: Column) -> Column:
    """Findings of a block alone and with its context: context adds findings, or widens the first of its type that it overlaps, never less."""

    def step(acc: Column, x: Column) -> Column:
        over = lambda d: (d["entity_type"] == x["entity_type"]) & (d["s"] < x["e"]) & (x["s"] < d["e"])
        first = F.array_position(F.transform(acc, over), True)
        held = F.try_element_at(acc, first.cast("int"))
        wider = (x["e"] - x["s"]) > (held["e"] - held["s"])
        swapped = F.transform(acc, lambda d, i: F.when((i + 1 == first) & wider, x).otherwise(d))
        return F.when(first == 0, F.array_append(acc, x)).otherwise(swapped)

    return F.aggregate(windowed, alone, step)


def table_labels(cells: DataFrame) -> DataFrame:
    """CSV cells (doc_id, row, col, text, header): adds ``label``, the header and a label directly to the left."""
    w = Window.partitionBy("doc_id", "row").orderBy("col")
    left = F.when(F.lag("col").over(w) == F.col("col") - 1, F.lag("text").over(w))
    return cells.withColumn("label", joined_labels(F.col("header"), F.when(looks_like_a_label(left), left)))


def sheet_labels(cells: DataFrame) -> DataFrame:
    """Sheet cells (doc_id, sheet, row, col, text): adds ``label``, the nearest label above in the column and one directly to the left."""
    up = Window.partitionBy("doc_id", "sheet", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(looks_like_a_label(F.col("text")), F.col("text")), ignorenulls=True).over(up)
    w = Window.partitionBy("doc_id", "sheet", "row").orderBy("col")
    left = F.when(F.lag("col").over(w) == F.col("col") - 1, F.lag("text").over(w))
    return cells.withColumn("label", joined_labels(above, F.when(looks_like_a_label(left), left)))


def leaf_key(path: Column) -> Column:
    """The innermost key of a path like $["a"][0]["b"]; null where there is none."""
    keys = F.regexp_extract_all(path, F.lit(r'\["((?:[^"\\]|\\.)*)"\]'), F.lit(1))
    return F.regexp_replace(F.try_element_at(keys, F.lit(-1)), r"\\(.)", "$1")
