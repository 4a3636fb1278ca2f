"""Detection tables: what is found, what is not, and both backends alike."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import spans
from veilframe.operators.detect import detect, exploded, resolve

FOUND = [
    ("PAN: ABCPE1234F", "IN_PAN", "ABCPE1234F"), ("ABCPE1234F", "IN_PAN", "ABCPE1234F"), ("IFSC HDFC0001234", "IFSC", "HDFC0001234"), ("tan ABCD12345E", "TAN", "ABCD12345E"),
    ("ABCDE1234F202501151030", "AIS_DOWNLOAD_ID", "ABCDE1234F202501151030"), ("DOB: 15/08/1990", "IN_DATE_OF_BIRTH", "15/08/1990"), ("Date of Birth: 15-Aug-1990", "IN_DATE_OF_BIRTH", "15-Aug-1990"),
    ("Born on 1990-08-15", "IN_DATE_OF_BIRTH", "1990-08-15"), ("UAN: 123456789012", "EPF_UAN", "123456789012"), ("passport M1234567", "IN_PASSPORT", "M1234567"),
    ("Passport No: M12 34567", "IN_PASSPORT", "M12 34567"), ("mobile 9876543210", "PHONE_NUMBER", "9876543210"), ("ration card RC12345678", "RATION_CARD_NUMBER", "RC12345678"),
    ("MR. R RAJESH KUMAR", "PERSON", "R RAJESH KUMAR"), ("SMT. K LAKSHMI", "PERSON", "K LAKSHMI"), ("MR RAJESH KUMAR SAVINGS ACCOUNT", "PERSON", "RAJESH KUMAR"),
    ("12 MG Road, Indiranagar, Bengaluru 560038", "IN_ADDRESS", "12 MG Road, Indiranagar, Bengaluru 560038"), ("BHOPAL - 462001", "IN_ADDRESS", "BHOPAL - 462001"),
    ("my pincode is 560038", "IN_ADDRESS", "560038"), ("My address is 14 Test Lane, Sampleville, Bengaluru 560038.", "IN_ADDRESS", "14 Test Lane, Sampleville, Bengaluru 560038"),
    ("é😀 write to a.b@example.com", "EMAIL_ADDRESS", "a.b@example.com"), ("card 4111 1111 1111 1111", "CREDIT_CARD", "4111 1111 1111 1111"), ("2341 2341 2346", "IN_AADHAAR", "2341 2341 2346"),
]
CLEAN = [
    "ABCDE1234F", "PAN: AB12CD34EF", "HDFC1001234", "ABCDE1234F202513151030", "ABCDE1234F202501322530", "Transaction date: 15/08/1990", "15/08/1990", "Q4(Jan-Mar)", "123456789012", "M1234567", "my ID M1234567",
    "call me on 9876543210", "Narration", "Registration", "Cardholder", "DR NEFT TRANSFER 5000", "MS Excel sheet", "mr ravi", "NEFT-123456 credited", "IMPS - 560038", "Amount 5,60,038.00", "Balance, closing 1250000",
    "Email address: none on file, 12", " ", "", None,
]
MOBILES = ["9876543210", "98765 43210", "98765-43210", "+91 98765 43210", "+91-9876543210", "919876543210", "09876543210"]
NOT_MOBILES = ["salary 12,50,000", "Rs 9876543210.50", "1234567890", "98765432101234", "TXN9876543210", "UPI/9876543210/ref", "ref 123-456-7890"]


@pytest.fixture(scope="module")
def found(spark):
    texts = [t for t, _, _ in FOUND] + CLEAN
    rows = exploded(detect(spark.createDataFrame(list(enumerate(texts)), "k int, text string")), "k").collect()
    return {k: {(r.entity_type, r.value) for r in rows if r.k == k} for k in range(len(texts))}


@pytest.mark.parametrize("k", range(len(FOUND)))
def test_found(found, k):
    assert FOUND[k][1:] in found[k]


@pytest.mark.parametrize("k", range(len(CLEAN)))
def test_clean(found, k):
    assert found[len(FOUND) + k] == set()


def test_mobiles_in_chat(spark):
    rows = spark.createDataFrame(list(enumerate(MOBILES + NOT_MOBILES)), "k int, text string")
    hit = {r.k: r.value for r in exploded(detect(rows, types=["IN_MOBILE"]), "k").collect()}
    assert hit == dict(enumerate(MOBILES))


def test_backends_agree(spark):
    texts = [t for t, _, _ in FOUND] + CLEAN + MOBILES + NOT_MOBILES
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    for types in (["IN_PAN", "IFSC", "TAN", "EMAIL_ADDRESS"], ["IN_AADHAAR", "CREDIT_CARD", "AIS_DOWNLOAD_ID", "IN_VOTER"], ["EPF_UAN", "IN_PASSPORT", "IN_DATE_OF_BIRTH"]):
        native, arrow = (sorted(exploded(detect(rows, types=types, backend=b), "k").collect()) for b in ("native", "arrow"))
        assert native == arrow


def test_recognizers_of_the_caller(spark):
    from veilframe.functions.checks import luhn
    from veilframe.operators.patterns import PatternSpec

    even = PatternSpec("EVEN", r"\b\d{3}\b", 0.3, accepts=lambda t: int(t) % 2 == 0)
    stars = PatternSpec("STARS", guard=None, find=lambda t: [(k, k + 1, 0.9) for k, c in enumerate(t) if c == "*"])
    native = PatternSpec("LUHN", r"\b\d{4}\b", 0.3, check=lambda t: luhn(t) & (F.length(t) == 4))
    rows = spark.createDataFrame([(1, "123 124 * 0018 1234")], "k int, text string")
    found = lambda *specs, **kw: {(r.entity_type, r.value) for r in exploded(detect(rows, types=[s.entity_type for s in specs], more=specs, **kw), "k").collect()}
    assert found(even, stars) == {("EVEN", "124"), ("STARS", "*")} and found(native) == {("LUHN", "0018")}
    for specs, backend in (((even,), "native"), ((native,), "arrow"), ((native, stars), None)):
        with pytest.raises(ValueError):
            found(*specs, backend=backend)


def test_context_words_far_before_a_match(spark):
    rows = spark.createDataFrame([(1, "account " + "x" * 300 + " is 123456789012345678"), (2, "account one two three four five 123456789012345678")], "k int, text string")
    for backend in ("native", "arrow"):
        assert [r.k for r in exploded(detect(rows, types=["BANK_ACCOUNT_NUMBER"], backend=backend), "k").collect()] == [1]


def test_arguments(spark):
    rows = spark.createDataFrame([("x",)], "text string")
    for bad in ({"types": ["NO_SUCH_TYPE"]}, {"types": []}, {"threshold": 2}):
        with pytest.raises(ValueError):
            detect(rows, **bad)


def _findings(*xs):
    return "cast(array(" + ",".join(f"named_struct('entity_type', '{t}', 's', {s}, 'e', {e}, 'score', {p}D)" for t, s, e, p in xs) + f") as {spans.FINDINGS})"


@pytest.mark.parametrize(
    "found, kept",
    [
        ([("A", 0, 5, 0.5), ("A", 3, 9, 0.7)], [("A", 0, 9)]),
        ([("A", 0, 5, 0.5), ("B", 0, 5, 0.9)], [("B", 0, 5)]),
        ([("A", 0, 5, 0.5), ("B", 0, 5, 0.5)], [("A", 0, 5)]),
        ([("A", 0, 9, 0.9), ("B", 2, 4, 0.5)], [("A", 0, 9)]),
        ([("A", 0, 6, 0.9), ("B", 4, 9, 0.5)], [("A", 0, 6), ("B", 6, 9)]),
        ([("A", 2, 4, 0.9), ("B", 0, 9, 0.5)], [("B", 0, 2), ("A", 2, 4), ("B", 4, 9)]),
    ],
)
def test_resolve_leaves_nothing_uncovered(spark, found, kept):
    from veilframe.operators import arrow_detect

    rows = spark.sql(f"SELECT {_findings(*found)} AS f").select(F.explode(resolve(F.col("f"))).alias("x")).select("x.*").collect()
    assert [(r.entity_type, r.s, r.e) for r in rows] == kept
    assert [x[:3] for x in arrow_detect.resolve(found)] == kept


def test_spans_count_code_points(spark):
    rows = spark.createDataFrame([("😀é 12 x 345",)], "t string").select(spans.match_spans(F.col("t"), r"\d+").alias("s"))
    assert [tuple(x) for x in rows.first().s] == [(3, 5), (8, 11)]
