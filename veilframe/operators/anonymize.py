"""Replacing findings: markers, stable codes, and the way back.

Codes are issued for a whole batch at once: distinct values are joined to the mapping, the missing ones are numbered in order of first
sight after the last ordinal of their type, and the driver commits one new version of the mapping. Values are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.spans import covered, match_spans, outside, output_spans, splice
from veilframe.functions.values import code_of, collapsed, display_of, is_all_caps, normalize_value

MAPPING = "entity_type string, value string, display string, code string, ordinal long"
TOKEN = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9_]*_[A-Z]+(?![A-Za-z0-9_])"


def settled(df: DataFrame) -> DataFrame:
    """A table that is computed once and read from the shared folder by all that follows: spark.checkpoint.dir, or one in the warehouse."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def writable(blocks: DataFrame, markdown: bool = False) -> DataFrame:
    """The blocks that anonymizing may change: read-only ones (results of formulas, names of a workbook) only where the output is markdown."""
    return blocks if markdown else blocks.filter(~F.coalesce("read_only", F.lit(False)))


def redact(df: DataFrame, text_col: str = "text", findings_col: str = "findings", out: str = "redacted") -> DataFrame:
    """Adds the text with each finding replaced by its type in angle brackets."""
    return df.withColumn(out, splice(F.col(text_col), F.col(findings_col), lambda f: F.concat(F.lit("<"), f["entity_type"], F.lit(">"))))


def masked_report(df: DataFrame, text_col: str = "text", findings_col: str = "findings", out: str = "report") -> DataFrame:
    """Adds the text with each finding as [[TYPE score]] and lines cut at 300 characters."""
    marked = splice(F.col(text_col), F.col(findings_col), lambda f: F.concat(F.lit("[["), f["entity_type"], F.lit(" "), F.format_number(f["score"], 2), F.lit("]]")))
    return df.withColumn(out, F.array_join(F.transform(F.split(marked, "\n"), lambda x: F.left(x, F.lit(300))), "\n"))


def sightings(df: DataFrame, order: list[str], text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """One row per finding: its place in the order of the batch, its key and its form."""
    rows = df.select(*order, text_col, F.posexplode(findings_col).alias("_pos", "_f"))
    form = collapsed(covered(F.col(text_col), F.col("_f")))
    return rows.select(F.struct(*order, F.col("_f.s")).alias("place"), F.col("_f.entity_type").alias("entity_type"), normalize_value(F.col("_f.entity_type"), form).alias("value"), form.alias("display"))


def issue_codes(seen: DataFrame, mapping: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mapping with the new values of a batch, and the counters after it.

    ``seen`` is the result of sightings. Ordinals follow the order of first sight within a type; counters only grow, so a forgotten code
    is never issued again. A value whose display is all capitals takes the first later form in mixed case.
    """
    mixed = F.when(~is_all_caps(F.col("display")) & (F.col("display") != F.lower("display")), F.col("display"))
    values = seen.groupBy("entity_type", "value").agg(
        F.min("place").alias("place"), F.min_by("display", "place").alias("first"), F.min_by(mixed, F.when(mixed.isNotNull(), F.col("place"))).alias("mixed")
    )
    known = mapping.select("entity_type", "value", F.col("display").alias("known_display"), "code", "ordinal")
    joined = values.join(known, ["entity_type", "value"], "full")
    fresh = joined.filter("code is null").join(F.broadcast(counters), "entity_type", "left")
    # Numbered per range of places, so that one type's values are not in one task; each range starts after those before it.
    fresh = settled(fresh.repartitionByRange("entity_type", "place").withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy("entity_type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = fresh.groupBy("entity_type", "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    number = F.col("_start") + F.row_number().over(Window.partitionBy("entity_type", "_part").orderBy("place"))
    fresh = fresh.join(starts, ["entity_type", "_part"]).withColumn("ordinal", (F.coalesce("last_ordinal", F.lit(0)) + number).cast("long"))
    fresh = fresh.withColumn("code", code_of(F.col("entity_type"), F.col("ordinal"))).drop("last_ordinal", "_part", "_start")
    base = F.coalesce(F.nullif("known_display", F.lit("")), F.col("first"), F.col("value"))
    shown = lambda d: d.select("entity_type", "value", display_of(base, F.col("mixed")).alias("display"), "code", "ordinal")
    after = shown(joined.filter("code is not null")).unionByName(shown(fresh))
    tops = after.groupBy("entity_type").agg(F.max("ordinal").alias("top"))
    counted = counters.join(tops, "entity_type", "full").select("entity_type", F.greatest("last_ordinal", "top").alias("last_ordinal"))
    return after, counted


def pseudonymize(df: DataFrame, mapping: DataFrame, id_col: str, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """Adds ``pseudonymized``, ``codes`` (spans in the output with type and code) and leaves texts without findings as they are."""
    rows = df.select(id_col, F.explode(findings_col).alias("_f"), text_col)
    rows = rows.select(id_col, "_f", F.col("_f.entity_type").alias("entity_type"), normalize_value(F.col("_f.entity_type"), covered(F.col(text_col), F.col("_f"))).alias("value"))
    coded = rows.join(mapping.select("entity_type", "value", "code"), ["entity_type", "value"])
    per_text = coded.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("_f.s"), F.col("_f.e"), "entity_type", "code"))).alias("_coded"))
    joined = df.join(per_text, id_col, "left")
    mark = lambda x: x["code"]
    placed = F.zip_with(output_spans(F.col("_coded"), mark), F.col("_coded"), lambda o, c: F.struct(o["s"].alias("s"), o["e"].alias("e"), c["entity_type"].alias("entity_type"), c["code"].alias("code")))
    return joined.withColumn("pseudonymized", F.coalesce(splice(F.col(text_col), F.col("_coded"), mark), F.col(text_col))).withColumn("codes", placed).drop("_coded")


def code_spans(text: Column) -> Column:
    """Whole tokens that look like codes."""
    return match_spans(text, TOKEN)


def _known_codes(df: DataFrame, mapping: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(id_col, text_col, F.explode(code_spans(F.col(text_col))).alias("_t")).withColumn("code", covered(F.col(text_col), F.col("_t")))
    hits = rows.join(mapping.select("code", F.coalesce(F.nullif("display", F.lit("")), "value").alias("display")), "code")
    return hits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("_t.s"), F.col("_t.e"), "display"))).alias("_codes"))


def reverse(df: DataFrame, mapping: DataFrame, id_col: str, text_col: str = "text", out: str = "reversed") -> DataFrame:
    """Adds the text with every known code replaced by its display; other text, and codes nobody issued, stay."""
    joined = df.join(_known_codes(df, mapping, id_col, text_col), id_col, "left")
    return joined.withColumn(out, F.coalesce(splice(F.col(text_col), F.col("_codes"), lambda x: x["display"]), F.col(text_col))).drop("_codes")


def without_codes(df: DataFrame, mapping: DataFrame, id_col: str, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """Findings cut to what lies outside known codes, so that a text redacted before is left as it is."""
    joined = df.join(_known_codes(df, mapping, id_col, text_col), id_col, "left")

    def parts(f: Column) -> Column:
        return F.transform(outside(f, F.col("_codes")), lambda x: F.struct(f["entity_type"].alias("entity_type"), x["s"].alias("s"), x["e"].alias("e"), f["score"].alias("score")))

    # A part without a letter or digit is what stood between codes.
    cut = F.filter(F.flatten(F.transform(findings_col, parts)), lambda f: covered(F.col(text_col), f).rlike(r"[\p{L}\p{N}]"))
    return joined.withColumn(findings_col, F.when(F.col("_codes").isNull(), F.col(findings_col)).otherwise(cut)).drop("_codes")


def forget(mapping: DataFrame, codes: DataFrame) -> DataFrame:
    """The mapping without some codes, all or none: a code that was never issued is an error. Counters stay."""
    missing = codes.join(mapping, "code", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} codes are not in the mapping; nothing was forgotten")
    return mapping.join(codes, "code", "left_anti")
