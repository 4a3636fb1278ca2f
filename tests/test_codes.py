"""Codes, the store, and the way back."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import anonymize, names
from veilframe.operators.detect import detect
from veilframe.operators.known import dictionary, sweep_ids, sweep_names
from veilframe.operators.store import MappingStore


def _texts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string")


def _run(spark, store, *texts):
    found = anonymize.without_codes(detect(_texts(spark, *texts), types=["IN_PAN", "PERSON"]), store.mapping(), "k").cache()
    mapping = store.issue(anonymize.sightings(found, ["k"]))
    return [r.pseudonymized for r in anonymize.pseudonymize(found, mapping, "k").orderBy("k").collect()]


@pytest.mark.parametrize("key", [None, b"0123456789abcdef"])
def test_codes_are_stable_and_reversible(spark, tmp_path, key):
    store = MappingStore(spark, f"file://{tmp_path}/store", key)
    first = _run(spark, store, "Mr. RAVI KUMAR has PAN ABCPE1234F.", "pan abcpe1234f again", "nothing")
    assert first == ["Mr. PERSON_A has PAN IN_PAN_A.", "pan IN_PAN_A again", "nothing"]
    version = store.version()
    assert _run(spark, store, "pan ABCPE1234F") == ["pan IN_PAN_A"] and store.version() == version
    assert _run(spark, store, first[0]) == [first[0]]
    assert _run(spark, store, "Mr. Ravi Kumar and Smt. K LAKSHMI") == ["Mr. PERSON_A and Smt. PERSON_B"]
    back = anonymize.reverse(_texts(spark, "PERSON_A's PAN is IN_PAN_A.", "PERSON_AB and XPERSON_A and PERSON_A_1", "PERSON_Z"), store.mapping(), "k").orderBy("k").collect()
    assert [r.reversed for r in back] == ["Ravi Kumar's PAN is ABCPE1234F.", "PERSON_AB and XPERSON_A and PERSON_A_1", "PERSON_Z"]
    if key:
        raw = spark.read.parquet(f"file://{tmp_path}/store/{store.version()}/mapping").select("value").collect()
        assert all("RAVI" not in r.value for r in raw)


def test_forgotten_codes_are_not_issued_again(spark, tmp_path):
    store = MappingStore(spark, f"file://{tmp_path}/store")
    _run(spark, store, "Mr. Ravi Kumar", "Mr. Anil Rao")
    codes = spark.createDataFrame([("PERSON_B",)], "code string")
    store.change(lambda m: anonymize.forget(m, codes))
    assert _run(spark, store, "Mr. Anil Rao", "Mr. Ravi Kumar") == ["Mr. PERSON_C", "Mr. PERSON_A"]
    with pytest.raises(ValueError):
        anonymize.forget(store.mapping(), spark.createDataFrame([("PERSON_Q",)], "code string"))


def test_a_late_writer_does_not_overwrite(spark, tmp_path):
    store = MappingStore(spark, f"file://{tmp_path}/store")
    stale = store.version()
    _run(spark, store, "Mr. Ravi Kumar")
    with pytest.raises(RuntimeError):
        store.commit(store.mapping(), store.counters(), stale)


def test_known_values(spark):
    known = dictionary(spark.createDataFrame([("PERSON", "Periwinkle Zanzibar"), ("PERSON", "Ravi"), ("PERSON", "Dear Sir"), ("IN_PAN", "ABCPE1234F"), ("PHONE_NUMBER", "9876543210"), ("IFSC", "short")], "entity_type string, value string"))
    texts = _texts(spark, "ask periwinkle zanzibar", "PERIWINKLE   ZANZIBAR's", "Periwinkle Zanzibaria", "XPeriwinkle Zanzibar", "Periwinkle, Zanzibar", "Ravi")
    assert {(r.k, r.s, r.e) for r in sweep_names(texts, known, "k").collect()} == {(0, 4, 23), (1, 0, 21)}
    texts = _texts(spark, "id abcpe-1234f.", "call +91-98765-43210!", "ABCPE12345F", "xABCPE1234F")
    assert {(r.k, r.s, r.e, r.entity_type) for r in sweep_ids(texts, known, "k").collect()} == {(0, 3, 14, "IN_PAN"), (1, 6, 20, "PHONE_NUMBER")}


def test_names_are_cut_before_digits(spark):
    rows = spark.createDataFrame([("Ravi PAN ABCPE1234F",), ("Form 16",), ("Ravi Kumar",)], "t string").select(names.name_before_digits(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == ["Ravi", None, "Ravi Kumar"]


def test_capitalised_pairs(spark):
    rows = names.capitalised_pairs(_texts(spark, "Please call Ravi Kumar today", "nothing here")).select("k", F.explode("names").alias("f")).collect()
    assert [(r.k, r.f.s, r.f.e) for r in rows] == [(0, 12, 22)]


def test_a_writer_that_died_blocks_nobody_and_readers_see_whole_versions(spark, tmp_path):
    store = MappingStore(spark, f"file://{tmp_path}/store")
    _run(spark, store, "Mr. Ravi Kumar")
    (tmp_path / "store" / "v-dead").mkdir()
    (tmp_path / "store" / "pending-dead").write_text("{")
    first = store.version()
    assert _run(spark, store, "Mr. Anil Rao") == ["Mr. PERSON_B"] and store.version() != first
    with pytest.raises(RuntimeError):
        store._publish(2, {"version": first, "batches": {}})
    assert sorted(p.name for p in (tmp_path / "store" / "commits").iterdir() if not p.name.startswith(".")) == ["000000000001", "000000000002"]


def test_a_repeated_batch_issues_nothing(spark, tmp_path):
    store = MappingStore(spark, f"file://{tmp_path}/store")
    seen = lambda *names: anonymize.sightings(detect(_texts(spark, *names), types=["PERSON"]), ["k"])
    store.issue(seen("Mr. Ravi Kumar"), ("stream", 4))
    version = store.version()
    assert store.issue(seen("Mr. Anil Rao"), ("stream", 4)).count() == 1 and store.version() == version
    assert store.issue(seen("Mr. Anil Rao"), ("stream", 5)).count() == 2
    assert store.issue(seen("Mr. Vijay Rao"), ("other", 0)).count() == 3


def test_codes_split_over_chunks_are_reversed(spark):
    from veilframe.streaming.chat import whole_chunks

    parts = ["Ask PER", "SON", "_A", "B, PERSON_", "A or IN_PAN_A", ". I", "N", " PERSON_A"]
    chunks = spark.createDataFrame([(1, n, t) for n, t in enumerate(parts)] + [(2, 0, None), (3, 0, "X")], "reply int, seq int, text string")
    mapping = spark.createDataFrame([("PERSON", "RAVI", "Ravi", "PERSON_A", 1), ("PERSON", "ANIL", "Anil", "PERSON_AB", 28), ("IN_PAN", "P", "P", "IN_PAN_A", 1)], anonymize.MAPPING)
    whole = whole_chunks(chunks, "reply", "seq").withColumn("id", F.struct("reply", "seq"))
    rows = anonymize.reverse(whole, mapping, "id").orderBy("reply", "seq").collect()
    assert "".join(r.reversed for r in rows if r.reply == 1) == "Ask Anil, Ravi or P. IN Ravi"
    assert "".join(r.text for r in rows if r.reply == 1) == "".join(parts) and [r.reversed for r in rows if r.reply > 1] == ["", "X"]
    assert not any(r.text.endswith(("PER", "PERSON", "PERSON_A", "PERSON_")) for r in rows[:-3])


def test_ordinals_follow_first_sight_over_many_ranges(spark):
    rows = spark.range(5000).select(F.struct((4999 - F.col("id")).alias("at")).alias("place"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("entity_type"), F.col("id").cast("string").alias("value"), F.col("id").cast("string").alias("display"))
    empty = spark.createDataFrame([], anonymize.MAPPING), spark.createDataFrame([], "entity_type string, last_ordinal long")
    after, counters = anonymize.issue_codes(rows.repartition(16), *empty)
    got = {r.value: r.ordinal for r in after.collect()}
    assert all(got[str(k)] == (4999 - k) // 2 + 1 for k in range(5000)) and {r.last_ordinal for r in counters.collect()} == {2500}


def test_a_publishing_run_that_would_withdraw_most_is_an_error(spark):
    from veilframe.plans import reports

    manifest = spark.createDataFrame([(k, "published", "h", "") for k in range(10)], "source_id int, status string, source_hash string, held_source_hash string")
    sources = lambda n: spark.createDataFrame([(k, "h") for k in range(n)], "source_id int, content_hash string")
    assert {r.action for r in reports.publishable(sources(6), manifest).collect()} == {"skip", "withdraw"}
    assert reports.publishable(sources(0), manifest).count() == 0
    with pytest.raises(ValueError):
        reports.publishable(sources(2), manifest)
