"""Reports and sinks: previews, audits, manifests, markdown, and texts written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.spans import splice


def preview(findings: DataFrame) -> DataFrame:
    """(doc_id, entity_type, n, n_unredactable, places) from findings (doc_id, entity_type, place, read_only): counts and places, never values."""
    return findings.groupBy("doc_id", "entity_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("read_only")).alias("n_unredactable"), F.array_join(F.sort_array(F.collect_set("place")), ",").alias("places")
    )


def approved(preview_rows: DataFrame, failed: DataFrame, unattended: bool = True) -> DataFrame:
    """(doc_id, approved): never with failed sections, nor, unattended, with what cannot be redacted."""
    totals = preview_rows.groupBy("doc_id").agg(F.sum("n_unredactable").alias("n_unredactable"))
    joined = totals.join(failed.select("doc_id").distinct().withColumn("failed", F.lit(True)), "doc_id", "full")
    fine = F.coalesce("n_unredactable", F.lit(0)) == 0 if unattended else F.lit(True)
    return joined.select("doc_id", (fine & F.col("failed").isNull()).alias("approved"))


def audit_entries(counts: DataFrame, mode: str, written: Column) -> DataFrame:
    """One entry per document: time, mode, counts by type, whether it was written. Append them to a table with ``write.mode('append')``."""
    entries = counts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("counts"))
    return entries.select(F.current_timestamp().alias("timestamp"), "doc_id", F.lit(mode).alias("mode"), "counts", written.alias("written"))


def manifest_diff(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_id, state): new, unchanged, held, changed or gone, from hashes of what is there and what the manifest recorded.

    With no source at all nothing is gone: an empty folder is more likely a mistake.
    """
    if not sources.limit(1).count():
        return manifest.select("source_id").limit(0).withColumn("state", F.lit(""))
    now = sources.select("source_id", F.col("content_hash").alias("now"))
    both = now.join(manifest.select("source_id", "status", "source_hash", "held_source_hash"), "source_id", "full")
    state = (
        F.when(F.col("now").isNull(), "gone").when(F.col("status").isNull(), "new")
        .when((F.col("status") == "published") & (F.col("now") == F.col("source_hash")), "unchanged")
        .when((F.col("status") == "held") & (F.col("now") == F.col("held_source_hash")), "held").otherwise("changed")
    )
    return both.select("source_id", state.alias("state"))


def nearest_rank(df: DataFrame, column: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """Nearest-rank percentiles per key and the maximum, from counts of values that are added up before they are shuffled."""
    picks = [F.expr(f"percentile_disc({float(share)}) WITHIN GROUP (ORDER BY {column})").alias(name) for name, share in shares.items()]
    return df.groupBy(*keys).agg(*picks, F.max(column).alias("max"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """(n_documents, n_written, n_held, n_failed, n_replaced) of a run's outcomes (status, n_replaced)."""
    count = lambda status: F.count_if(F.col("status") == status)
    return outcomes.agg(
        F.count("*").alias("n_documents"), count("written").alias("n_written"), count("held").alias("n_held"), count("failed").alias("n_failed"),
        F.coalesce(F.sum("n_replaced"), F.lit(0)).cast("long").alias("n_replaced"),
    )


def failure_text(message: Column, most: int = 300) -> Column:
    """What went wrong in one line of at most ``most`` characters."""
    return F.left(F.trim(F.regexp_replace(message, r"(?U)\s+", " ")), F.lit(most))


def plain(value: Column) -> Column:
    """A cell as text: dates as ISO, null as nothing."""
    return F.coalesce(value.cast("string"), F.lit(""))


def folder_type(path: Column, known: list[str], otherwise: str = "generic") -> Column:
    """The type of a document by the first folder of its path below the inbox, if it is a known one."""
    folder = F.when(F.contains(path, F.lit("/")), F.lower(F.substring_index(path, "/", 1)))
    return F.when(folder.isin(known), folder).otherwise(otherwise)


def publishable(sources: DataFrame, manifest: DataFrame, gone_at_most: float = 0.5) -> DataFrame:
    """(source_id, action) of a publishing run: publish, skip or withdraw.

    An empty source withdraws nothing (see manifest_diff); a run that would withdraw more than a share of what is published is an error,
    as a folder that moved is more likely than that so much was deleted.
    """
    states = manifest_diff(sources, manifest)
    gone, published = states.filter("state = 'gone'").count(), manifest.filter("status = 'published'").count()
    if published and gone > gone_at_most * published:
        raise ValueError(f"{gone} of {published} published documents have no source; nothing was withdrawn")
    action = F.when(F.col("state").isin("new", "changed"), "publish").when(F.col("state") == "gone", "withdraw").otherwise("skip")
    return states.select("source_id", action.alias("action"))


def write_back(blocks: DataFrame, replacements: DataFrame) -> DataFrame:
    """Blocks with replaced texts; a replacement for a block that is not there is an error."""
    lost = replacements.join(blocks, ["doc_id", "block_index"], "left_anti").limit(1).count()
    if lost:
        raise ValueError("a replacement has no block")
    joined = blocks.join(replacements.select("doc_id", "block_index", F.col("text").alias("_new")), ["doc_id", "block_index"], "left")
    return joined.withColumn("text", F.coalesce("_new", "text")).drop("_new")


def splice_blocks(docs: DataFrame, blocks: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole texts with their blocks (doc_id, start, end, old, text) replaced. A span that no longer holds its old text fails the query."""
    spans = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), "old", F.col("text").alias("new")))).alias("_spans"))
    joined = docs.join(spans, "doc_id", "left")
    moved = F.exists("_spans", lambda x: F.substring(F.col(text_col), x["s"] + 1, x["e"] - x["s"]) != x["old"])
    checked = F.when(F.coalesce(moved, F.lit(False)), F.raise_error(F.lit("a block changed under its replacement")).cast("string")).otherwise(F.coalesce(splice(F.col(text_col), F.col("_spans"), lambda x: x["new"]), F.col(text_col)))
    return joined.withColumn(text_col, checked).drop("_spans")


def csv_lines(cells: DataFrame, delimiter: str = ",") -> DataFrame:
    """Rows of cells (doc_id, row, col, text) as CSV lines: quoted where needed, missing cells empty."""
    quoted = F.when(F.col("text").rlike(rf'["\r\n{delimiter}]'), F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("text"))
    rows = cells.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", quoted.alias("t")))).alias("m"), F.max("col").alias("last"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), delimiter)
    return rows.select("doc_id", "row", line.alias("line"))


def path_steps(path: str) -> list[str | int]:
    """The keys and indexes of a path like $["a"][0]; anything else is an error."""
    import json
    import re

    steps = re.findall(r'\[("(?:[^"\\]|\\.)*"|\d+)\]', path)
    if "$" + "".join(f"[{s}]" for s in steps) != path or not steps:
        raise ValueError(f"not a path: {path}")
    return [json.loads(s) for s in steps]


def json_write(docs: DataFrame, replacements: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """JSON documents with the leaves (id, path, text) replaced; a target that is missing or no string fails the query. The indent stays."""
    import json
    import re
    from collections.abc import Iterator

    import pyarrow as pa

    changes = replacements.groupBy(id_col).agg(F.collect_list(F.struct("path", "text")).alias("_changes"))
    joined = docs.select(id_col, json_col).join(changes, id_col, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if edits:
                    value = json.loads(text)
                    for edit in edits:
                        *above, last = path_steps(edit["path"])
                        at = value
                        for step in above:
                            at = at[step]
                        if not isinstance(at[last], str):
                            raise ValueError(f"{edit['path']} is no string")
                        at[last] = edit["text"]
                    indent = re.search(r"\n( +)\S", text)
                    text = json.dumps(value, ensure_ascii=False, indent=len(indent[1]) if indent else None)
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, json_col])

    return joined.mapInArrow(run, docs.select(id_col, json_col).schema)


def markdown_table(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """(key, markdown): a table of the columns' texts, pipes and line ends escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))), lambda x: x["t"]), "\n")
    return rows.groupBy(key).agg(F.concat(F.lit(head + "\n"), body).alias("markdown"))


def fenced_json(text: Column) -> Column:
    """JSON in a fence longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), lambda t: F.length(t))), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
    return F.concat(fence, F.lit("json\n"), text, F.lit("\n"), fence)


def reading_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, row, text): positioned blocks in reading order. A block joins a row if half of the smaller height overlaps what the
    row spans so far, so rows are a fold over the page, not a comparison of neighbours."""

    def step(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        overlap = F.least(last["y1"], b["y1"]) - F.greatest(last["y0"], b["y0"])
        joins = last.isNotNull() & (overlap >= 0.5 * F.least(last["y1"] - last["y0"], b["y1"] - b["y0"]))
        one = F.struct(b["x0"].alias("x0"), b["text"].alias("text"))
        grown = F.struct(F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["y1"], b["y1"]).alias("y1"), F.array_append(last["cells"], one).alias("cells"))
        fresh = F.struct(b["y0"].alias("y0"), b["y1"].alias("y1"), F.array(one).alias("cells"))
        return F.when(joins, F.array_append(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.array_append(acc, fresh))

    empty = F.array().cast("array<struct<y0:double,y1:double,cells:array<struct<x0:double,text:string>>>>")
    ordered = F.array_sort(F.collect_list(F.struct(F.col("y0").cast("double").alias("y0"), F.col("x0").cast("double").alias("x0"), F.col("y1").cast("double").alias("y1"), "text")))
    pages = blocks.groupBy("doc_id", "page").agg(F.aggregate(ordered, empty, step).alias("rows"))
    rows = pages.select("doc_id", "page", F.posexplode("rows").alias("row", "r"))
    return rows.select("doc_id", "page", "row", F.array_join(F.transform(F.array_sort("r.cells"), lambda c: c["text"]), " | ").alias("text"))


def front_matter(doc_type: Column, source_hash: Column, redacted_at: Column) -> Column:
    """The head of a published document."""
    return F.concat_ws("\n", F.lit("---"), F.lit("type: document"), F.lit("redacted: true"), F.concat(F.lit("doc_type: "), doc_type), F.concat(F.lit("source_hash: "), source_hash), F.concat(F.lit("redacted_at: "), redacted_at), F.lit("---"))


def first_lines(text: Column, most: int = 30) -> Column:
    """The first lines of a text, and how many more there are."""
    lines = F.split(text, "\n")
    more = F.size(lines) - most
    return F.when(more > 0, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n... "), more.cast("string"), F.lit(" more lines"))).otherwise(text)
