"""Batches of messages."""

from veilframe.operators.store import MappingStore
from veilframe.streaming.chat import redact_batch


def test_messages_without_a_text_stay(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/checkpoints")
    batch = spark.createDataFrame([(1, 1, "write to ravi@example.com"), (2, 1, None), (3, 2, None), (4, 2, "")], "message_id long, conv_id long, text string")
    out = {r.message_id: r for r in redact_batch(batch, MappingStore(spark, f"file://{tmp_path}/store", b"k" * 32)).collect()}
    assert sorted(out) == [1, 2, 3, 4]
    assert "ravi@example.com" not in out[1].pseudonymized and out[2].text is None
