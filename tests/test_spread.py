"""Detection in Arrow batches runs once per text, in more than one task, whatever row groups the file has."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import arrow_detect
from veilframe.operators.detect import boosted
from veilframe.operators.patterns import specs_for
from veilframe.plans.catalogue import QUERIES


@pytest.mark.parametrize("name", ["detect_document", "mobile_chat", "synth_mobile_forms"])
def test_texts_are_searched_once_and_in_several_tasks(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_recognizers_without_their_words_are_passed_over():
    ready = arrow_detect.compiled(specs_for(["BANK_ACCOUNT_NUMBER"]))
    find = lambda text, label, threshold=0.5: arrow_detect.findings_of(text, label, ready, threshold, boosted, 5)
    number, hit = "ref 123456789", [("BANK_ACCOUNT_NUMBER", 4, 13, 0.5)]
    assert find(number, None) == [] and find(number, "My ACCOUNT") == hit and find(f"{number} account", None) == []
    assert find("AcC 123456789", None) == hit and find(number, None, 0.1) == [("BANK_ACCOUNT_NUMBER", 4, 13, 0.15)]
