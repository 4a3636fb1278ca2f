"""One query per training-data operator, with production parameters, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.archives import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.suffix import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), full=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.quality_rules import apply_policy, ledger

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return apply_policy(ledger(_table(spark, sf_dir, "documents"))).select(*columns)


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.vectors import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.extraction import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veilframe.llm.pieces import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).drop("source")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_archives": op1_archives,
    "op2_suffix": op2_suffix,
    "op3_quality_rules": op3_quality_rules,
    "op4_vectors": op4_vectors,
    "op5_extraction": op5_extraction,
    "op6_licenses": op6_licenses,
    "op7_pieces": op7_pieces,
    "op8_importance": op8_importance,
    "op9_mixing": op9_mixing,
    "op10_minhash": op10_minhash,
}

#: White space as a DuckDB character class.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS last FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS BIGINT)) AS fives FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((fives[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to
FROM v""",
    "op4_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
walk(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, w.root FROM walk w JOIN links l ON l.a = w.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM walk GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM pos),
twice AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(c.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),
f AS (
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f""",
    "op9_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(concat(CAST(doc_id AS VARCHAR), ':mix')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY source),
r AS (SELECT source, ss, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rn FROM s),
w AS (SELECT source, ss, rn, (rn - 1) % 3 + 1 AS weight, 3 * ss AS cap, 3 * ss / ((rn - 1) % 3 + 1) AS ratio FROM r),
l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, ss, CAST(coalesce(least(cap, arg_min(level, (ratio, rn)) FILTER (ratio >= level) OVER () * weight), cap) AS DOUBLE) AS target FROM l),
q AS (SELECT d.*, t.ss, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.doc_id, h, size, (upto + k * ss) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0 AND target > 0),
run AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM c),
got AS (SELECT doc_id, sum(size) AS taken FROM run WHERE used <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, size, ss AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN got ON q.doc_id = got.doc_id""",
    "op10_minhash": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM pos),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
walk(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, w.root FROM walk w JOIN links l ON l.x = w.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM walk GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
}
