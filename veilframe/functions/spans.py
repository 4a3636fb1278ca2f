"""Spans over text columns: all matches of a pattern with code-point offsets, and the algebra of spans.

A span is a struct with ``s`` and ``e`` (half open, from 0). Everything is a Catalyst expression; offsets count code points, as
``length`` and ``substring`` do, so text outside the basic plane needs no care.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:int,e:int>>"
FINDINGS = "array<struct<entity_type:string,s:int,e:int,score:double>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, however often ``body`` reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of a Java pattern that never matches the empty string, in order.

    Splitting gives the gaps and extracting the matches, by the same matcher; a fold over both turns lengths into offsets.
    """
    p = F.lit(pattern)
    empty = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(F.coalesce(end, start).alias("pos"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span(start, end))).alias("out"))

    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(text.rlike(pattern), F.aggregate(pieces, empty, step)["out"]).otherwise(F.array().cast(SPANS))


def covered(text: Column, x: Column) -> Column:
    """The text under a span."""
    return F.substring(text, x["s"] + 1, x["e"] - x["s"])


def clip(spans: Column, start: Column, end: Column) -> Column:
    """Spans cut to [start, end) and counted from start; empty ones are dropped."""
    cut = F.transform(spans, lambda x: F.struct(x["entity_type"].alias("entity_type"), (F.greatest(x["s"], start) - start).alias("s"), (F.least(x["e"], end) - start).alias("e"), x["score"].alias("score")))
    return F.filter(cut, lambda x: x["e"] > x["s"])


def union(spans: Column) -> Column:
    """Overlapping spans merged; touching ones stay apart."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last["s"], F.greatest(last["e"], x["e"]))))
        return F.when(last.isNotNull() & (x["s"] < last["e"]), merged).otherwise(F.array_append(acc, x))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def outside(x: Column, holes: Column) -> Column:
    """The parts of a span outside sorted, disjoint holes."""

    def step(acc: Column, h: Column) -> Column:
        hits = (h["s"] < x["e"]) & (h["e"] > acc["pos"])
        out = F.when(h["s"] > acc["pos"], F.array_append(acc["out"], span(acc["pos"], F.least(h["s"], x["e"])))).otherwise(acc["out"])
        return F.struct(F.when(hits, F.greatest(acc["pos"], h["e"])).otherwise(acc["pos"]).alias("pos"), F.when(hits, out).otherwise(acc["out"]).alias("out"))

    start = F.struct(x["s"].alias("pos"), F.array().cast(SPANS).alias("out"))
    close = lambda acc: F.when(acc["pos"] < x["e"], F.array_append(acc["out"], span(acc["pos"], x["e"]))).otherwise(acc["out"])
    return F.aggregate(holes, start, step, close)


def splice(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """The text with each of sorted, disjoint spans replaced by ``mark`` of it. Pieces are built side by side and joined once."""
    before = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"].cast("int")))
    pieces = F.zip_with(F.slice(before, 1, F.size(spans)), spans, lambda p, x: F.concat(F.substring(text, p + 1, x["s"] - p), mark(x)))
    tail = F.substring(text, F.element_at(before, -1) + 1, F.length(text))
    return F.when(spans.isNotNull(), F.array_join(F.concat(pieces, F.array(tail)), ""))


def output_spans(spans: Column, mark: Callable[[Column], Column]) -> Column:
    """Where the marks of ``splice`` stand in its output."""

    def step(acc: Column, x: Column) -> Column:
        s, n = x["s"] + acc["shift"], F.length(mark(x))
        return F.struct((acc["shift"] + n - (x["e"] - x["s"])).alias("shift"), F.array_append(acc["out"], span(s, s + n)).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("shift"), F.array().cast(SPANS).alias("out")), step)["out"]
