"""Known values: names and ids that a store, or the same request, already knows, found wherever they stand.

The sweep is a dictionary join. Texts are cut into words (or runs that look like ids), each an equi-join key into the dictionary; a
window of the text around a hit must then equal the dictionary's key. Cost does not depend on the size of the dictionary, which is joined
by Spark's choice of strategy and never turned into one large pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.spans import FINDINGS, covered, match_spans
from veilframe.functions.values import normalize_value

NAME_TYPE = "PERSON"
ID_TYPES = (
    "IN_AADHAAR AIS_DOWNLOAD_ID IFSC UPI_ID BANK_ACCOUNT_NUMBER DEMAT_DP_ID TAN CIN EPF_UAN CKYC_NUMBER MF_FOLIO_NUMBER DRIVING_LICENSE IN_PASSPORT ITR_ACK_NUMBER RATION_CARD_NUMBER "
    "PHONE_NUMBER IN_PAN EMAIL_ADDRESS CREDIT_CARD IN_GSTIN IN_VOTER IN_VEHICLE_REGISTRATION"
).split()
MIN_ID_CHARS, MIN_NAME_LETTERS = 8, 5
NAME_WORD = r"[\p{L}\p{M}]+"
ID_RUN = r"(?U)[\w.+@#*\-]+"  # a slash ends a run, as in UPI/<number>/ref
ID_EDGES = r"[._\-+*#]+"


def swept_types(types: Column) -> Column:
    """Of the types asked for those that known values are swept for."""
    return F.array_sort(F.array_intersect(types, F.array(*map(F.lit, [NAME_TYPE, *ID_TYPES]))))


def dictionary(values: DataFrame) -> DataFrame:
    """Values (entity_type, value) that may be swept for: names of two words or more without digits, ids of eight characters or more."""
    from veilframe.operators.names import is_not_a_name_word

    key = normalize_value(F.col("entity_type"), F.col("value"))
    rows = values.select("entity_type", key.alias("key")).distinct()
    rows = rows.withColumn("words", F.transform(F.regexp_extract_all("key", F.lit(NAME_WORD), F.lit(0)), lambda w: F.lower(w)))
    long_words = F.size(F.filter("words", lambda w: F.length(w) >= 2))
    letters = F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w))
    name = (
        (F.col("entity_type") == NAME_TYPE) & ~F.col("key").rlike(r"\p{Nd}") & (long_words >= 2) & (letters >= MIN_NAME_LETTERS)
        & ~is_not_a_name_word(F.try_element_at("words", F.lit(1))) & ~is_not_a_name_word(F.try_element_at("words", F.lit(-1)), leading=False)
    )
    ids = F.col("entity_type").isin(ID_TYPES) & (F.length("key") >= MIN_ID_CHARS) & F.col("key").rlike(r"[\p{Nd}@]")
    return rows.filter(name | ids).withColumn("first", F.when(F.col("entity_type") == NAME_TYPE, F.try_element_at("words", F.lit(1)))).withColumn("n", F.size("words"))


def _whole(text: Column, s: Column, e: Column) -> Column:
    around = F.concat(F.substring(text, s, F.when(s > 0, 1).otherwise(0)), F.lit(" "), F.substring(text, e + 1, F.lit(1)))
    return ~around.rlike(r"[\p{L}\p{N}_]")


def sweep_names(texts: DataFrame, known: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, s, e, entity_type, n) of known names: whole words, any case, only blanks between; candidates may overlap."""
    words = texts.select(id_col, text_col, match_spans(F.col(text_col), NAME_WORD).alias("_words"))
    words = words.select(id_col, text_col, "_words", F.posexplode("_words").alias("_i", "_w")).withColumn("first", F.lower(covered(F.col(text_col), F.col("_w"))))
    hit = words.join(known.filter(F.col("entity_type") == NAME_TYPE), "first")
    end = F.try_element_at("_words", F.col("_i") + F.col("n"))["e"]
    hit = hit.select(id_col, text_col, F.col("_w.s").alias("s"), end.alias("e"), "entity_type", "key", "n").filter("e is not null")
    x = {"s": F.col("s"), "e": F.col("e")}
    same = normalize_value(F.lit(NAME_TYPE), covered(F.col(text_col), x)) == F.col("key")
    return hit.filter(same & _whole(F.col(text_col), F.col("s"), F.col("e"))).select(id_col, "s", "e", "entity_type")


def sweep_ids(texts: DataFrame, known: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, s, e, entity_type) of known ids: runs of id characters, trimmed, looked up by their plain key and as a phone number."""
    runs = texts.select(id_col, text_col, F.explode(match_spans(F.col(text_col), ID_RUN)).alias("_r")).withColumn("run", covered(F.col(text_col), F.col("_r")))
    front = F.length(F.regexp_extract("run", rf"\A{ID_EDGES}", 0))
    bare = F.regexp_replace("run", rf"\A{ID_EDGES}|{ID_EDGES}\z", "")
    runs = runs.select(id_col, (F.col("_r.s") + front).alias("s"), bare.alias("run")).filter(F.length("run") >= MIN_ID_CHARS).withColumn("e", F.col("s") + F.length("run"))
    plain, phone = normalize_value(F.lit(""), F.col("run")), normalize_value(F.lit("PHONE_NUMBER"), F.col("run"))
    keys = runs.withColumn("_k", F.explode(F.array(F.struct(F.lit(False).alias("as_phone"), plain.alias("key")), F.struct(F.lit(True).alias("as_phone"), phone.alias("key"))))).select(id_col, "s", "e", "_k.*")
    ids = known.filter(F.col("entity_type") != NAME_TYPE).select("entity_type", "key", (F.col("entity_type") == "PHONE_NUMBER").alias("as_phone"))
    return keys.join(ids, ["key", "as_phone"]).groupBy(id_col, "s", "e").agg(F.min("entity_type").alias("entity_type"))


def find_known(texts: DataFrame, known: DataFrame, id_col: str, text_col: str = "text", excluded: str | None = None) -> DataFrame:
    """Adds ``known``: matches of both sweeps that overlap neither one another (first, then longest) nor the spans in ``excluded``."""
    hits = sweep_names(texts, known, id_col, text_col).unionByName(sweep_ids(texts, known, id_col, text_col))
    per_text = hits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("s", (-F.col("e")).alias("ne"), "entity_type"))).alias("_hits"))
    joined = texts.join(per_text, id_col, "left")
    free = F.col("_hits")
    if excluded:
        free = F.filter(free, lambda m: ~F.exists(excluded, lambda x: (x["s"] < -m["ne"]) & (m["s"] < x["e"])))

    def step(acc: Column, m: Column) -> Column:
        found = F.struct(m["entity_type"].alias("entity_type"), m["s"].alias("s"), (-m["ne"]).cast("int").alias("e"), F.lit(1.0).alias("score"))
        return F.when(m["s"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(0)), acc).otherwise(F.array_append(acc, found))

    return joined.withColumn("known", F.coalesce(F.aggregate(free, F.array().cast(FINDINGS), step), F.array().cast(FINDINGS))).drop("_hits")


def merge_known(findings: Column, known: Column) -> Column:
    """Findings with known matches taken in.

    A match is left out where another type overlaps it on a different stretch, or its own type already covers it. Otherwise it
    replaces what it overlaps by one finding over all of it; the very same stretch takes the known type.
    """

    def step(acc: Column, m: Column) -> Column:
        over = lambda d: (d["s"] < m["e"]) & (m["s"] < d["e"])
        hits = F.filter(acc, over)
        foreign = F.exists(hits, lambda d: (d["entity_type"] != m["entity_type"]) & ((d["s"] != m["s"]) | (d["e"] != m["e"])))
        held = F.exists(hits, lambda d: (d["entity_type"] == m["entity_type"]) & (d["s"] <= m["s"]) & (d["e"] >= m["e"]))
        wide = F.struct(
            m["entity_type"].alias("entity_type"),
            F.least(m["s"], F.array_min(F.transform(hits, lambda d: d["s"]))).alias("s"),
            F.greatest(m["e"], F.array_max(F.transform(hits, lambda d: d["e"]))).alias("e"),
            m["score"].alias("score"),
        )
        return F.when(foreign | held, acc).otherwise(F.array_append(F.filter(acc, lambda d: ~over(d)), wide))

    merged = F.aggregate(known, findings, step)
    return F.transform(F.array_sort(F.transform(merged, lambda x: F.struct(x["s"].alias("s"), x.alias("x")))), lambda k: k["x"])
