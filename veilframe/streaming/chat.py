"""Conversations as streams: each micro-batch is one transaction of the mapping store.

Names found in one message of a request are masked in all messages of that request; later batches know the values of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators.anonymize import pseudonymize, settled, sightings, without_codes
from veilframe.operators.detect import detect
from veilframe.operators.known import dictionary, find_known, merge_known
from veilframe.operators.store import MappingStore


def local_sweep(found: DataFrame, request_col: str, id_col: str, text_col: str = "text") -> DataFrame:
    """Adds to ``findings`` the values that other messages of the same request were found to hold.

    The dictionary is per request: its keys are prefixed by the request in the join, so no request sees another's names.
    """
    from veilframe.functions.spans import covered, match_spans
    from veilframe.functions.values import normalize_value
    from veilframe.operators.known import NAME_WORD

    values = found.select(F.col(request_col).alias("_req"), text_col, F.explode("findings").alias("f")).select("_req", F.col("f.entity_type").alias("entity_type"), covered(F.col(text_col), F.col("f")).alias("value"))
    names = values.filter("entity_type = 'PERSON'").withColumn("key", normalize_value(F.col("entity_type"), F.col("value"))).select("_req", "key").distinct()
    names = names.join(dictionary(values.select("entity_type", "value")).select("key", "first", "n"), "key")
    words = found.select(request_col, id_col, text_col, match_spans(F.col(text_col), NAME_WORD).alias("_ws"))
    words = words.select(F.col(request_col).alias("_req"), id_col, text_col, "_ws", F.posexplode("_ws").alias("_i", "_w")).withColumn("first", F.lower(covered(F.col(text_col), F.col("_w"))))
    hits = words.join(names, ["_req", "first"]).select(id_col, text_col, "key", F.col("_w.s").alias("s"), F.try_element_at("_ws", F.col("_i") + F.col("n"))["e"].alias("e")).filter("e is not null")
    hits = hits.filter(normalize_value(F.lit("PERSON"), covered(F.col(text_col), {"s": F.col("s"), "e": F.col("e")})) == F.col("key"))
    per_text = hits.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct(F.lit("PERSON").alias("entity_type"), "s", "e", F.lit(1.0).alias("score")))).alias("_local"))
    joined = found.join(per_text, id_col, "left")
    return joined.withColumn("findings", F.when(F.col("_local").isNull(), F.col("findings")).otherwise(merge_known(F.col("findings"), F.col("_local")))).drop("_local")


def whole_chunks(chunks: DataFrame, key: str, order: str, text_col: str = "text") -> DataFrame:
    """(key, order, text): the chunks of streamed replies moved to boundaries, so that no code is split and each can be reversed by itself.

    What a chunk ends in that may go on as a code, a run of letters, digits and underscores that starts with a capital, is held back and put before
    the next chunk; the last chunk holds nothing back. Together the chunks stay the text they were.
    """

    def step(acc: Column, x: Column) -> Column:
        text = F.concat(acc["held"], F.coalesce(x["text"], F.lit("")))
        held = F.when(x["last"], F.lit("")).otherwise(F.regexp_extract(text, r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]*\z", 0))
        ready = F.struct(x["at"].alias("at"), F.left(text, F.length(text) - F.length(held)).alias("text"))
        return F.struct(held.alias("held"), F.array_append(acc["out"], ready).alias("out"))

    kind = chunks.schema[order].dataType.simpleString()
    start = F.struct(F.lit("").alias("held"), F.array().cast(f"array<struct<at:{kind},text:string>>").alias("out"))
    listed = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text_col).alias("text")))).alias("c"))
    marked = F.transform("c", lambda x, i: F.struct(x["at"].alias("at"), x["text"].alias("text"), (i == F.size("c") - 1).alias("last")))
    return listed.select(key, F.explode(F.aggregate(marked, start, step)["out"]).alias("x")).select(key, F.col("x.at").alias(order), F.col("x.text").alias(text_col))


def redact_batch(batch: DataFrame, store: MappingStore, id_col: str = "message_id", request_col: str = "conv_id", text_col: str = "text", order: list[str] | None = None, number: tuple[str, int] | None = None) -> DataFrame:
    """A batch of messages pseudonymized under one commit of the store; equal texts are analyzed once.

    ``number`` names the stream and its batch: a batch that was committed before gets the codes it got then.
    """
    distinct = batch.select(text_col).distinct()
    analyzed = detect(distinct, text_col, doc_type="chat")
    # Messages without a text stay, with no findings.
    found = batch.join(analyzed.withColumnRenamed(text_col, "_text"), F.col(text_col).eqNullSafe(F.col("_text"))).drop("_text")
    before = store.mapping()
    found = local_sweep(without_codes(found, before, id_col, text_col), request_col, id_col, text_col)
    known = find_known(found, dictionary(before.select("entity_type", F.col("value"))), id_col, text_col)
    merged = known.withColumn("findings", merge_known(F.col("findings"), F.col("known"))).drop("known")
    # The findings are written down before codes are issued: a lost executor must not see other codes.
    merged = settled(merged)
    mapping = store.issue(sightings(merged, order or [id_col], text_col), number)
    return pseudonymize(merged, mapping, id_col, text_col)


def redact_stream(messages: DataFrame, store: MappingStore, sink: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs redact_batch on each micro-batch of a stream and writes it under the batch's number, so a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        redact_batch(batch, store, number=(checkpoint, number), **options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
