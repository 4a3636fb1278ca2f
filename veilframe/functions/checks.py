"""Checks of identifiers, each a Column of booleans over a Column of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The dihedral multiplication table of order ten and the position permutations of Verhoeff's check, row by row.
DIHEDRAL = "0123456789" "1234067895" "2340178956" "3401289567" "4012395678" "5987604321" "6598710432" "7659821043" "8765932104" "9876543210"
PERMUTED = "0123456789" "1576283094" "5803796142" "8916043527" "9453126870" "4286573901" "2793806415" "7046913258"


def verhoeff(text: Column) -> Column:
    """Whether a run of digits, white space aside, ends in its Verhoeff check digit."""
    digits = F.regexp_replace(text, r"\s+", "")
    pairs = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.cast("int").alias("d"), (i % 8).alias("p")))
    at = lambda table, row, column: F.substring(F.lit(table), row * 10 + column + 1, F.lit(1)).cast("int")
    rest = F.aggregate(pairs, F.lit(0), lambda c, x: at(DIHEDRAL, c, at(PERMUTED, x["p"], x["d"])))
    return F.when(digits.rlike(r"\A[0-9]+\z"), rest == 0).otherwise(False)


def luhn(text: Column) -> Column:
    """Whether the digits of a card number, blanks and dashes aside, pass the Luhn check."""
    return F.coalesce(F.call_function("luhn_check", F.regexp_replace(text, r"[ \-]", "")), F.lit(False))


def download_stamp(text: Column) -> Column:
    """Whether the last 12 digits are a date of 2000 to 2099 and a time of day."""
    stamp = F.right(text, F.lit(12))
    number = lambda at, n: F.substring(stamp, at, n).cast("int")
    day = F.try_to_timestamp(F.substring(stamp, 1, 8), F.lit("yyyyMMdd"))
    return F.coalesce(day.isNotNull() & number(1, 4).between(2000, 2099) & (number(9, 2) < 24) & (number(11, 2) < 60), F.lit(False))


def has_digit_or_at(text: Column) -> Column:
    return text.rlike(r"[\p{Nd}@]")
