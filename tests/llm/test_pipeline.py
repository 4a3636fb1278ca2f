"""The pipeline, stage by stage, and the SQL of the operators that have it."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from oracle import same_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from veilframe.llm._shared import shared_dir  # noqa: E402
from veilframe.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from veilframe.llm.suffix import remove_repeats  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, QUERIES[name], ORACLE_SQL[name])


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    from test_operators import _near, _repeats

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "pieces" or docs.columns == columns
        seen[name] = before
    after = lambda name: [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {i for i, _ in after("quality")}
    clean = [i for i, x in labels.items() if x.quality == 1 and x.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    _, label = _near(seen["near_dedup"])
    assert {i for i, _ in after("near_dedup")} == {i for i, c in label.items() if i == c}
    removed = {x[0]: x[2] for x in _repeats(seen["suffix_dedup"], corpus_pipeline.REPEATED)}
    whole = dict(seen["suffix_dedup"])
    assert all((t == whole[i]) == (removed[i] == 0) for i, t in after("suffix_dedup") if whole[i])
    assert len(after("suffix_dedup")) == len(seen["suffix_dedup"])
    # The mix takes whole documents, up to three times each, and each source near its target.
    before, mixed = Counter(seen["mixing"]), Counter(after("mixing"))
    assert all(n <= 3 * before[x] for x, n in mixed.items()) and set(mixed) <= set(before)
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken = Counter(), Counter()
    for i, t in seen["mixing"]:
        sizes[sources[i]] += size(t)
    for (i, t), n in mixed.items():
        taken[sources[i]] += n * size(t)
    target = _targets(sizes)
    longest = max(size(t) for _, t in seen["mixing"])
    assert all(abs(taken[s] - target[s]) <= longest for s in sizes)
    # One row of pieces for each row, as the library makes them.
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = {x: sp.encode(x[1] or "") for x in mixed}
    expected = Counter((x[0], len(ids[x]), sha(",".join(map(str, ids[x]))), sha(sp.decode(ids[x]))) for x in mixed.elements())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()) == expected


def _targets(sizes):
    """What each source's share comes to: weights 1, 2, 3 by code point, three times its size at most, the rest shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, full = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        left, shares = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / shares for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "pieces" or out.columns == docs.columns)


def test_stages_keep_columns_with_clashing_names_and_odd_texts(spark, tmp_path):
    names = "_row _kept _mix_row _mix_n kept key rank label kept_text ratio id component part".split()
    text = lambda k: " ".join(f"v{k}y{j}" for j in range(60))
    rows = [(k, text(k), "en", "s", 1) for k in range(30)] + [(40, None, "en", None, None), (41, "", None, "s", 0), (42, text(7), "en", "s", 1), (43, "w " * 60_000, "en", "t", 1), (5, text(5), "en", "s", 1), (5, text(99), "en", "t", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out = docs.collect()
        if name == "pieces":
            break
        assert docs.columns == columns and all(r[n] == f"{n}{r.doc_id}" for r in out for n in names)
        ids = sorted(r.doc_id for r in out)
        if name == "quality":  # nothing is labelled bad, so all that has words stays
            assert ids == sorted([*range(30), 42, 43, 5, 5])
        if name == "near_dedup":  # the repeated row and the copy go, the other text of the id stays
            assert ids == sorted([*range(30), 43, 5]) and sum(r.text == text(99) for r in out) == 1


def test_run_applies_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert len(rows) > 100 and all(r.n_tokens > 0 and len(r.ids_sha256) == 64 for r in rows)


def test_null_ids_pass_and_repeats_do_not(spark, tmp_path):
    rows = [(None, "a b c d e f", "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (1, "g h i j k l", "en", "s", 1), (1, "g h i j k l", "en", "s", 1), (None, "g h i j k l", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "None", "None", "None"]
    assert corpus_pipeline.suffix_dedup(spark, docs.limit(3), "").count() >= 3


def test_rows_without_an_id_keep_their_columns_through_all_stages(spark, tmp_path):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    rows = [(None if k % 2 else k, text(k), "ab"[k // 20 % 2] + "l", "ab"[k // 20 % 2], 1) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    known, nulls = {t: (i, lang, source) for i, t, lang, source, _ in rows}, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out = docs.collect()
        nulls[name] = sum(r.doc_id is None for r in out)
        assert name == "pieces" or all(known[r.text] == (r.doc_id, r.lang, r.source) for r in out)
        if name == "mixing":
            words = {s: sum(80 for r in out if r.source == s) for s in "ab"}
            assert abs(words["a"] - 6400 / 3) <= 80 and abs(words["b"] - 12800 / 3) <= 80
    assert nulls["suffix_dedup"] == nulls["near_dedup"] > 0 and nulls["pieces"] == nulls["mixing"] > 0


def test_dedup_stages_leave_one_copy_of_the_texts(spark, tmp_path):
    """What a stage's folder still holds when its result is written, against its input."""
    rng, shared = random.Random(3), Path(urlparse(shared_dir(spark)).path)
    text = lambda: " ".join(f"{rng.randrange(10**6)}" for _ in range(400))
    spark.createDataFrame([(k, text(), "en", "s", 1) for k in range(300)], DOCS).write.option("compression", "zstd").parquet(f"{tmp_path}/docs")
    held = lambda at: {p: p.stat().st_size for p in at.rglob("*.parquet")}
    docs, copy = spark.read.parquet(f"{tmp_path}/docs"), sum(held(tmp_path).values())
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.suffix_dedup):
        before = held(shared)
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{stage.__name__}")
        assert copy / 2 < sum(n for p, n in held(shared).items() if p not in before) < 1.2 * copy


def test_suffix_dedup_cuts_the_texts_as_the_operator_does(spark):
    passage = "".join(f"ä{j}" for j in range(200))
    rows = [(1, passage, "en", "s", 1), (1, "x" + passage[1:], "en", "s", 1), (None, "y" * 251, "de", None, None), (2, None, None, "t", 1), (3, "", "en", "t", 1), (4, "short", "en", "t", 1)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], DOCS + ", _spans long")
    left = {r.doc_id: r.kept_text for r in remove_repeats(docs, id_col="_spans", length=corpus_pipeline.REPEATED, full=True).withColumnRenamed("_spans", "doc_id").collect()}
    assert len(left[0]) < 10 and left[2] == "" and left[5] == "short"
    got = corpus_pipeline.suffix_dedup(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=lambda r: r[-1]) == [(i, left[k], lang, source, len(left[k]), k) for k, (i, _, lang, source, _) in enumerate(rows)]
