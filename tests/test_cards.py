"""Card numbers beside other numbers: a run of digits takes none from its neighbours."""

import os

import pytest
from oracle import TABLES, same_rows

from veilframe.operators.detect import detect, exploded
from veilframe.plans.catalogue import ORACLE_SQL, QUERIES

CARD = "4111111111111111"
TEXTS = [
    f"{CARD} 27.65.93.188 then", f"at 38.253.197.126 {CARD}", f"+1 (836) 555-9331 {CARD} 53.121.55.90 end", f"{CARD} {CARD}", f"{CARD}-{CARD}", f"-{CARD}", f"{CARD}-", f"x{CARD}y", f"{CARD}.",
    f"12 {CARD}", f"1 4111111111111112 {CARD}", "4111111111111112 1", "0000000000000", "12345678901234567890", f"1234 {CARD}12345", f"٣{CARD}٣", f"{CARD}@example.com", "555-9331 12.5 nothing", "4111 1111 1111 1111", f"to {CARD}.x@example.com, {CARD}", "", None,
]


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    """The small tables with documents of odd texts, the last two rows of one id."""
    folder = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        if t != "documents":
            os.symlink(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet")
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = [*TEXTS, f"{CARD} again", f"{CARD} 9"]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    pq.write_table(pa.table({"doc_id": ids, "text": pa.array(texts, pa.string()), "lang": ["en" if k % 2 else None for k in ids]}), folder / "documents.parquet")
    return str(folder)


def test_card_luhn_valid_beside_other_numbers(spark, odd_dir):
    same_rows(spark, odd_dir, QUERIES["card_luhn_valid"], ORACLE_SQL["card_luhn_valid"])


def test_redaction_summary_beside_other_numbers(spark, odd_dir):
    same_rows(spark, odd_dir, QUERIES["redaction_summary"], ORACLE_SQL["redaction_summary"])


@pytest.mark.parametrize("backend", ["native", "arrow"])
def test_cards_beside_other_numbers_are_found(spark, backend):
    fours, amex = "4111 1111 1111 1111", "3782 822463 10005"
    texts = {
        f"{CARD} 27.65.93.188": [CARD], f"197.126 {CARD}": [CARD], f"555-9331 {CARD} 53": [CARD], f"{CARD} {CARD}": [CARD, CARD], f"{fours} 27.65": [fours], f"126 {fours}": [fours],
        f"{fours} {CARD}": [fours, CARD], fours.replace(" ", "-"): [fours.replace(" ", "-")], amex: [amex], f"7{fours}": [], f"1-{fours}": [], "12345678901234567890": [],
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = exploded(detect(rows, types=["CREDIT_CARD"], backend=backend), "k").orderBy("k", "start").collect()
    assert [[r.value for r in found if r.k == k] for k in range(len(texts))] == list(texts.values())
