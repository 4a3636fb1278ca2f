"""Quality rules as a bitmask ledger (operator 3), in DataFrame functions only.

Each rule is evaluated once per text; the ledger holds the measurements and one bit per failed rule. Policies are
versioned masks over the ledger, so a new policy reads no text again, and an ablation (what would be kept without
a rule) is an aggregation of bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import words_column

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A rule: its bit, its name, and the condition under which a text fails it."""

    bit: int
    name: str
    fails: str


#: Bits 0 and 1 are the base rules; a bit is never given to another rule. Conditions hold for texts with words.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "no_words", "n_words = 0"),
)
#: Versions of the policy: a text is kept if it fails none of the rules in the mask.
POLICIES = {"v1": 0b1000011, "v2": 0b1111111}
BASE = 0b0000011


def _pairs_after(a: Column, f) -> Column:
    """f(x, next x) over an array; the last has a null neighbour."""
    return F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), f)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and the measurements. Null and empty texts measure 0 everywhere.

    Repeated windows are found inside the row: hashes of three words are sorted with their positions, equal neighbours mark the
    windows found twice or more, and a fold over the sorted positions adds up what they cover.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col), text.alias("t"), F.transform(words_column(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h"))
    n = F.size("h")
    three = F.zip_with(
        F.zip_with(F.slice("h", 1, F.greatest(n - 2, F.lit(0))), F.slice("h", 2, F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b)),
        F.slice("h", 3, F.greatest(n - 2, F.lit(0))),
        lambda ab, c: F.xxhash64(ab, c),
    )
    step = step.select(id_col, "t", n.cast("long").alias("n_words"), F.array_sort(F.transform(three, lambda k, i: F.struct(k.alias("k"), i.alias("i")))).alias("s"))
    # Both of two equal neighbours start a repeated window.
    twice = F.flatten(F.filter(_pairs_after(F.col("s"), lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    step = step.select(id_col, "t", "n_words", F.array_sort(twice).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct((i + 3).alias("upto"), (acc["n"] + i + 3 - F.greatest(acc["upto"], i)).alias("n")),
    )["n"]
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    step = step.select(id_col, "t", "n_words", covered.alias("n_repeat_words"), lines.alias("lines"))
    return step.select(
        id_col,
        "n_words",
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``failed``, a long with one bit for each failed rule."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failed", out)


def apply_policy(entries: DataFrame, version: str = "v2") -> DataFrame:
    """Adds base_failed and kept under a version of the policy; reads the ledger only."""
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return entries.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0))


def ablations(entries: DataFrame, version: str = "v2", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of a policy: texts that fail it, that fail it alone, and that would be kept without it.

    Rows are first counted per distinct bit pattern, so what is exploded by rule is at most 2^rules rows.
    """
    mask = POLICIES[version]
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    table = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1])
    each = patterns.select("bits", "n", F.explode(table).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
