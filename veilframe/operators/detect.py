"""Detection: recognizers over a text column, context, and one owner for each stretch of text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.spans import FINDINGS, bound, covered, match_spans
from veilframe.operators import arrow_detect
from veilframe.operators.patterns import PatternSpec, allowed, specs_for

THRESHOLD = 0.5
BOOST, FLOOR = 0.35, 0.4
WORDS_BEFORE = 5
MAX_CHARS = 1_000_000
#: More recognizers than this are run by the Arrow backend unless a caller says otherwise.
NATIVE_AT_MOST = 8


def boosted(score: float) -> float:
    """The score of a match with a context word near."""
    return round(min(1.0, max(score + BOOST, FLOOR)), 4)


def context_before(text: Column, x: Column, label: Column | None = None) -> Column:
    """A label, the last words before a span, and the span itself, lower case."""
    words = F.filter(F.split(F.substring(text, F.lit(1), x["s"]), r"(?U)\s+"), lambda w: w != "")
    last = F.slice(words, F.greatest(F.size(words) - WORDS_BEFORE, F.lit(0)) + 1, WORDS_BEFORE)
    parts = [F.array_join(last, " "), covered(text, x)]
    return F.lower(F.concat_ws(" ", *([label] if label is not None else []), *parts))


def _scored(spec: PatternSpec, text: Column, x: Column, label: Column | None) -> Column:
    base = F.lit(float(spec.score))
    if spec.check is not None:
        return F.when(spec.check(covered(text, x)), F.lit(1.0)).otherwise(F.lit(0.0))
    if not spec.context:
        return base
    near = context_before(text, x, label).rlike("|".join(map(re.escape, spec.context)))
    return F.when(near, F.lit(boosted(spec.score))).otherwise(base)


def spec_findings(spec: PatternSpec, text: Column, threshold: float = THRESHOLD, label: Column | None = None) -> Column:
    """The findings of one recognizer at or above the threshold."""
    spans = match_spans(text, spec.compiled)
    if spec.lead:
        skip = lambda x: F.length(F.regexp_extract(covered(text, x), rf"\A(?:{spec.lead})", 0))
        spans = F.filter(F.transform(spans, lambda x: F.struct((x["s"] + skip(x)).alias("s"), x["e"].alias("e"))), lambda x: x["e"] > x["s"])
    name = spec.reported_as or spec.entity_type
    found = F.transform(spans, lambda x: F.struct(F.lit(name).alias("entity_type"), x["s"].alias("s"), x["e"].alias("e"), _scored(spec, text, x, label).alias("score")))
    found = F.filter(found, lambda f: f["score"] >= threshold)
    return F.when(text.rlike(spec.guard), found).otherwise(F.array().cast(FINDINGS)) if spec.guard else found


def resolve(findings: Column) -> Column:
    """Findings without overlaps, in order of position.

    Overlapping findings of one type are their union; the same stretch found as several types goes to the higher score, then to the
    smaller name. Of different types that overlap, the higher score stays whole, then the longer, then the smaller name, and the other
    keeps only what is outside, so that nothing found is left uncovered.
    """

    def same_type(acc: Column, x: Column) -> Column:
        touching = lambda y: (y["entity_type"] == x["entity_type"]) & (y["s"] < x["e"]) & (x["s"] < y["e"])
        hit = F.filter(acc, touching)
        merged = F.struct(
            x["entity_type"].alias("entity_type"),
            F.least(x["s"], F.array_min(F.transform(hit, lambda y: y["s"]))).alias("s"),
            F.greatest(x["e"], F.array_max(F.transform(hit, lambda y: y["e"]))).alias("e"),
            F.greatest(x["score"], F.array_max(F.transform(hit, lambda y: y["score"]))).alias("score"),
        )
        return F.array_append(F.filter(acc, lambda y: ~touching(y)), merged)

    def place(acc: Column, x: Column) -> Column:
        # What is left of x outside the findings already placed, which go first.
        def cut(parts: Column, y: Column) -> Column:
            piece = lambda s, e, p: F.struct(p["entity_type"].alias("entity_type"), s.alias("s"), e.alias("e"), p["score"].alias("score"))
            both = lambda p: F.filter(F.array(piece(p["s"], F.least(p["e"], y["s"]), p), piece(F.greatest(p["s"], y["e"]), p["e"], p)), lambda q: q["e"] > q["s"])
            return F.flatten(F.transform(parts, both))

        return F.concat(acc, F.aggregate(acc, F.array(x).cast(FINDINGS), cut))

    empty = F.array().cast(FINDINGS)
    rank = lambda x: F.struct((-x["score"]).alias("r"), (x["s"] - x["e"]).alias("l"), x["entity_type"].alias("t"), x["s"].alias("s"), x.alias("x"))
    unions = lambda fs: F.aggregate(F.array_sort(F.transform(fs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x.alias("x")))), empty, lambda acc, k: same_type(acc, k["x"]))
    placed = lambda fs: F.aggregate(F.array_sort(F.transform(fs, rank)), empty, lambda acc, k: place(acc, k["x"]))
    by_start = lambda fs: F.transform(F.array_sort(F.transform(fs, lambda x: F.struct(x["s"].alias("s"), x.alias("x")))), lambda k: k["x"])
    return F.when(F.size(findings) < 2, findings).otherwise(bound(bound(findings, unions), lambda u: by_start(placed(u))))


def detect(df: DataFrame, text_col: str = "text", doc_type: str | None = None, types: list[str] | None = None, threshold: float = THRESHOLD, label_col: str | None = None, out: str = "findings", resolved: bool = True, backend: str | None = None, more: tuple[PatternSpec, ...] = ()) -> DataFrame:
    """Adds the findings of each text. Null texts and texts without a letter or digit have none; texts over a million characters fail.

    Only recognizers of allowed types are compiled, of the registry and, for types that are asked for, of ``more``. ``backend`` is 'native'
    (expressions, a few recognizers to a projection) or 'arrow' (batches in Python); unset, their number decides, and recognizers
    that are functions of the text take Arrow.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold is between 0 and 1")
    specs = specs_for(types if types is not None else [*allowed(doc_type), *(s.entity_type for s in more)], more)
    arrow_only = [s.entity_type for s in specs if s.find or s.accepts]
    native_only = [s.entity_type for s in specs if s.check is not None and s.check not in arrow_detect.CHECKS and not s.accepts]
    backend = backend or ("arrow" if arrow_only or len(specs) > NATIVE_AT_MOST and not native_only else "native")
    unfit = arrow_only if backend == "native" else native_only
    if unfit:
        raise ValueError(f"these recognizers have no {backend} form: {', '.join(dict.fromkeys(unfit))}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    checked = F.when(F.length(text) > MAX_CHARS, F.raise_error(F.lit(f"a text is longer than {MAX_CHARS} characters")).cast("string")).otherwise(F.when(text.rlike(r"[\p{L}\p{N}]"), text).otherwise(F.lit("")))
    kept = df.columns
    label = F.col(label_col) if label_col else None
    if backend == "arrow":
        column = arrow_detect.findings_column(checked, label, specs, threshold, boosted, WORDS_BEFORE, resolved)
        return df.select(*[c for c in kept if c != out], column.alias(out))
    step = df.withColumn("_text", checked)
    parts = []
    for at in range(0, len(specs), 6):
        part = f"_found{at}"
        step = step.withColumn(part, F.concat(*[spec_findings(s, F.col("_text"), threshold, label) for s in specs[at : at + 6]]))
        parts.append(part)
    step = step.withColumn("_all", F.array_distinct(F.concat(*parts)))
    return step.select(*[c for c in kept if c != out], (resolve(F.col("_all")) if resolved else F.col("_all")).alias(out))


def exploded(df: DataFrame, *keys: str, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """One row per finding: keys, entity_type, start, end, score, value."""
    rows = df.select(*keys, text_col, F.explode(findings_col).alias("f"))
    return rows.select(*keys, F.col("f.entity_type"), F.col("f.s").alias("start"), F.col("f.e").alias("end"), F.col("f.score"), covered(F.col(text_col), F.col("f")).alias("value"))
