"""Quality by importance resampling (operator 8).

Two generative models over hashed word n-grams, one of target text (labelled good and not toxic) and one of the raw corpus,
give each document the mean of log p_target / p_raw over its n-grams. Toxic text is told by marks, words and beginnings of words as
inflected words share them: whether a text holds them is a second ratio, of labelled toxic texts against the others, by a lower
confidence bound of the odds in the languages a word stands in. Evidence of the different words of a text adds up.

N-grams of a text are not independent, so sums of logarithms overstate what they say. The log importance weight is the two ratios scaled
to log odds of target text by a logistic fit on a held-out half of the labelled sample. Gumbel noise from a hash of the id is added and
the k documents with the largest sums stay, a sample without replacement in proportion to the weights. k is the caller's, or as many as it
takes for the sample to hold all but LOSS of the held-out target texts. So a text that is clearly good or bad is decided by its weight, others
by chance.

Counts of the raw model cover all documents. Only the labelled rows are sampled, at most SAMPLE of them by a hash of their ids.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm._shared import Workspace, byte_slices, lean

BUCKETS = 1 << 16  # for words, and as many for pairs of words
SAMPLE = 20_000
#: A mark stands in so many toxic texts at least, and its odds are e ** LEAST_ODDS times as high, at Z standard errors below.
LEAST_TEXTS, LEAST_ODDS, Z = 3, 1.0, 2.0
#: Lengths of the beginnings of words.
STEM, LONGEST_STEM = 4, 12
#: The most that evidence counts, in levels; the shrinkage of the logistic fit, and the rows of each kind that it takes to be labelled wrongly.
MOST_EVIDENCE, SHRINK, UNSURE = 2.0, 1e-4, 0.1
LOSS = 0.002
#: Toxic and clean held-out texts that a language needs for a level of its own.
OWN_LEVEL = 10
HELD_PIECES = 200_000  # counted pieces that a task holds before it passes them on
TOKEN = re.compile(r"\w+|[^\w\s]+")
RAW, TARGET = 0, 1
#: What the sample is used for: to fit the models, or to set the level.
FIT, HELD_OUT = 0, 1


def ngrams(texts: list[str | None], buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Of each text, lower case: hashed words (below ``buckets``) and pairs of words (above); the words by number. All words."""
    ids: dict[str, int] = {}
    split = [TOKEN.findall((t or "").lower()) for t in texts]
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, sum(map(len, split)))
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))[flat] if ids else np.zeros(0, np.uint64)
    mask = np.uint64(buckets - 1)
    one = (h & mask).astype(np.int32)
    two = (((h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(20)) & mask).astype(np.int32) + buckets
    out, at = [], 0
    for ws in split:
        n = len(ws)
        out.append((np.concatenate([one[at : at + n], two[at : at + max(n - 1, 0)]]), flat[at : at + n]))
        at += n
    return out, list(ids)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(model, bucket, n) of one partition; columns in: text, quality, toxic, use."""
    total = np.zeros((2, 2 * BUCKETS), np.int64)
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in byte_slices(batch, 0):
                marks = zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))
                grams, _ = ngrams(part.column(0).to_pylist())
                if grams:
                    total[RAW] += np.bincount(np.concatenate([g for g, _ in grams]), minlength=2 * BUCKETS)
                for (g, _), (quality, toxic, use) in zip(grams, marks):
                    if use == FIT and toxic != 1 and quality == 1:
                        total[TARGET] += np.bincount(g, minlength=2 * BUCKETS)
    model, bucket = np.nonzero(total)
    columns = [pa.array(model, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[model, bucket])]
    yield pa.RecordBatch.from_arrays(columns, names=["model", "bucket", "n"])


def stems(word: str) -> list[str]:
    """The beginnings of a word that can be marks."""
    return [word[:n] for n in range(STEM, min(len(word), LONGEST_STEM) + 1)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, whole, piece, bad, good): toxic and other texts with a word or stem; piece null for all texts. Columns in: text, lang, toxic."""
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        found: dict = {}
        for (lang, whole, piece, toxic), n in held.items():
            found.setdefault((lang, whole, piece), [0, 0])[not toxic] += n
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64())
        table = [(*key, *n) for key, n in found.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in table], kind) for k, kind in enumerate(kinds)], names=["lang", "whole", "piece", "bad", "good"])

    for batch in batches:
        for text, lang, toxic in zip(*(batch.column(k).to_pylist() for k in range(3))):
            words = set(TOKEN.findall((text or "").lower()))
            held.update((lang, True, w, toxic == 1) for w in words)
            held.update((lang, False, p, toxic == 1) for p in {p for w in words for p in stems(w)})
            held[lang, None, None, toxic == 1] += 1
            if len(held) > HELD_PIECES:
                yield rows()
                held.clear()
    yield rows()


def toxic_marks(counts: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with the lower bound of their log odds, of a table of (lang, whole, piece, bad, good)."""
    counts = counts.groupBy("lang", "whole", "piece").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # What share of texts is toxic differs by language, so a word is held against that of the languages it stands in.
    texts = counts.filter("piece is null").select(F.col("lang").alias("of"), ((F.col("bad") + 0.5) / (F.col("bad") + F.col("good") + 1)).alias("share"))
    held = counts.filter("piece is not null").join(F.broadcast(texts), F.col("lang").eqNullSafe(F.col("of")))
    n = F.col("bad") + F.col("good")
    summed = held.groupBy("whole", "piece").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), (F.sum(n * F.col("share")) / F.sum(n)).alias("share"))
    p, z = F.col("bad") / n, F.lit(Z)
    low = (p + z * z / 2 / n - z * F.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)
    odds = F.log(low / (1 - low)) - F.log(F.col("share") / (1 - F.col("share")))
    found = summed.filter(F.col("bad") >= LEAST_TEXTS).select("whole", "piece", odds.alias("odds")).filter(F.col("odds") >= LEAST_ODDS).collect()
    return tuple({r.piece: r.odds for r in found if r.whole == whole} for whole in (True, False))


def log_ratio(top: np.ndarray, bottom: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log p_top / p_bottom per bucket, words and pairs each a distribution of their own."""
    out = np.empty(2 * BUCKETS)
    for half in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        p = (top[half] + smooth) / (top[half].sum() + smooth * BUCKETS)
        q = (bottom[half] + smooth) / (bottom[half].sum() + smooth * BUCKETS)
        out[half] = np.log(p / q)
    return out


def _scores(ratio: np.ndarray, marks: tuple[dict[str, float], dict[str, float]]):
    words, parts = marks
    heads = {p[:STEM] for m in marks for p in m}

    def evidence(word: str) -> float:
        if word[:STEM] not in heads:
            return 0.0
        return max([words.get(word, 0.0), *(parts.get(p, 0.0) for p in stems(word))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in byte_slices(batch, 1):
                    grams, known = ngrams(part.column(1).to_pylist())
                    mean = [float(ratio[g].mean()) if len(g) else None for g, _ in grams]
                    each = np.fromiter(map(evidence, known), np.float64, len(known))
                    # Each word counts once; long texts hold more words that are marked by chance.
                    bad = [float(each[np.unique(w[each[w] > 0])].sum() / np.sqrt(len(w))) if len(w) else 0.0 for _, w in grams]
                    kept = [part.column(k) for k in range(part.num_columns) if k != 1]
                    names = [part.schema.names[k] for k in range(part.num_columns) if k != 1]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(mean, pa.float64()), pa.array(bad, pa.float64())], names=[*names, "ratio", "evidence"])

    return run


def level_between(scores: np.ndarray, good: np.ndarray, cost: float = 5.0) -> float:
    """The level with the most bad below it, less ``cost`` times the share of good below it."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order].astype(float)
    below_good, below_bad = np.r_[0, np.cumsum(g)] / max(g.sum(), 1), np.r_[0, np.cumsum(1 - g)] / max((1 - g).sum(), 1)
    at = int(np.argmax(below_bad - cost * below_good))
    return float(s[0] - 1 if at == 0 else s[-1] + 1 if at == len(s) else (s[at - 1] + s[at]) / 2)


def kth_largest(df: DataFrame, column: str, k: int, few: int = 4096) -> float | None:
    """The k-th largest value of a column by narrowing histograms; what reaches the driver is bounded."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None or k <= 0:
        return None
    above = 0
    inside = df.filter(F.col(column).isNotNull())
    for _ in range(12):
        if lo == hi:
            return lo
        width = (hi - lo) / 1024
        rows = inside.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(1023)).alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        lo, hi = r["lo"], r["hi"]
        inside = inside.filter(F.col(column).between(lo, hi))
        if r["n"] <= few:
            values = sorted((x[0] for x in inside.select(column).collect()), reverse=True)
            return values[min(k - above, len(values)) - 1]
    return lo


def toxic_levels(held) -> tuple[float, dict[str, float]]:
    """The evidence from which a text is toxic: of all languages, and of those with enough held-out texts; held: lang, evidence, toxic."""

    def level(rows) -> float:
        # Texts without any evidence are never toxic.
        return max(-level_between(-rows.evidence.to_numpy(), ~rows.toxic.to_numpy()), 1e-9)

    def enough(rows, n: int) -> bool:
        return rows.toxic.sum() >= n and (~rows.toxic).sum() >= n

    if not enough(held, 1):
        return np.inf, {}
    return level(held), {lang: level(rows) for lang, rows in held.groupby("lang") if enough(rows, OWN_LEVEL)}


def log_odds(features: np.ndarray, target: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Coefficients (the first of a constant) of a logistic fit by damped Newton steps; what is aimed at stays off 0 and 1 by the number of rows."""
    n = target.sum()
    aim = np.where(target, 1 - UNSURE / (n + 2 * UNSURE), UNSURE / (len(target) - n + 2 * UNSURE))
    scale = features.std(axis=0)
    scale[scale == 0] = 1
    x = np.column_stack([np.ones(len(features)), features / scale])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + SHRINK * np.eye(len(w)), x.T @ (aim - p) - SHRINK * w)
        w += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w / np.r_[1, scale]


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: str = "gumbel", lang_col: str = "lang", row_col: str | None = None, k: int | None = None) -> DataFrame:
    """id, ratio, toxic, weight, key, kept for every input row, and ``row_col``, a key of rows, if there is one.

    toxic is the evidence over the level of the language, 0 below it; weight is in log odds. Texts without words (null, empty) have no
    ratio and are not kept. If the labels hold no good text, or none to set against it, all others are, or k of them by chance. Repeated rows share one
    key and stay or go together; labels that repeat an id count once. Null ids have no label, but a weight, and share their noise.
    Texts are read whole. Without a column of languages, all texts are of one. An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "importance")
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    row = [F.col(row_col).cast("long").alias("row")] if row_col else []
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang"), *row)
    turn = F.xxhash64("label_id", F.lit("sample"))
    marked = labels.select(F.col(id_col).alias("label_id"), "quality", "toxic").dropna(subset=["label_id", "quality"]).dropDuplicates(["label_id"])
    chosen = work.put(marked.withColumn("turn", turn).orderBy("turn", "label_id").limit(sample).withColumn("use", F.pmod("turn", F.lit(2)).cast("int")).drop("turn"), "labels")
    with_marks = source.join(F.broadcast(chosen), F.col("id") == F.col("label_id"), "left").select("text", "quality", "toxic", "use")
    counts = with_marks.mapInArrow(lean(_histograms), "model int, bucket int, n long").groupBy("model", "bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, 2 * BUCKETS))
    total[counts.model, counts.bucket] = counts.n
    fitted = total[TARGET].sum() > 0
    ratio = (log_ratio(total[TARGET], total[RAW]) if fitted else np.zeros(2 * BUCKETS)).astype(np.float32)
    fit = source.join(F.broadcast(chosen.filter(f"use = {FIT}")), F.col("id") == F.col("label_id")).select("text", "lang", "toxic")
    pieces = work.put(fit.mapInArrow(lean(_pieces), "lang string, whole boolean, piece string, bad long, good long"), "pieces")
    marks = toxic_marks(pieces) if fitted else ({}, {})
    work.drop("pieces")
    schema = f"id {dict(docs.dtypes)[id_col]}, lang string, " + "row long, " * bool(row_col) + "ratio double, evidence double"
    scored = work.put(source.mapInArrow(lean(_scores(ratio, marks)), schema), "scores")

    uniform = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    noise = -F.log(-F.log(uniform))
    held = scored.join(F.broadcast(chosen.filter(f"use = {HELD_OUT}")), F.col("id") == F.col("label_id")).filter("ratio is not null").select("lang", "ratio", "evidence", "quality", (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"), noise.alias("noise")).toPandas()
    held = held.astype({"toxic": bool})
    common, own = toxic_levels(held)
    toxic_level = F.coalesce(F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.col("lang")], F.lit(common)) if own else F.lit(float(common))
    over = F.col("evidence") / toxic_level
    scored = scored.withColumn("toxic", F.when(over >= 1, F.least(over, F.lit(MOST_EVIDENCE))).otherwise(0.0)).drop("evidence")
    target = ((held.quality == 1) & ~held.toxic).to_numpy()
    decided = fitted and target.any() and not target.all()
    held_over = held.evidence / held.lang.map(own).fillna(common)
    # Ratios of languages differ, as the target holds other shares of them than the corpus; those with enough texts have a constant of their own.
    langs = [x for x, rows in held.assign(target=target).groupby("lang") if min(rows.target.sum(), (~rows.target).sum()) >= OWN_LEVEL]
    features = np.column_stack([held.ratio, np.where(held_over >= 1, np.minimum(held_over, MOST_EVIDENCE), 0.0), *[(held.lang == x).astype(float) for x in langs]])
    constant, *slopes = log_odds(features, target).tolist() if decided else [0.0] * (features.shape[1] + 1)
    weight = F.lit(constant) + F.lit(slopes[0]) * F.col("ratio") + F.lit(slopes[1]) * F.col("toxic")
    if langs:
        weight += F.coalesce(F.create_map(*[F.lit(x) for pair in zip(langs, slopes[2:]) for x in pair])[F.col("lang")], F.lit(0.0))
    keyed = scored.withColumn("weight", weight).withColumn("key", F.col("weight") + noise)
    keyed = work.put(keyed.drop("lang"), "keys")
    work.drop("scores")
    if k is None and decided:
        keys = constant + features @ np.array(slopes) + held.noise.to_numpy()
        k = keyed.filter(F.col("key") >= float(np.quantile(keys[target], LOSS, method="lower")) - 1e-9).count()
    elif k is None:
        k = keyed.filter("key is not null").count()
    cut = kth_largest(keyed.select("key"), "key", k)
    kept = F.col("key").isNotNull() & (F.col("key") >= F.lit(cut)) if cut is not None else F.lit(False)
    out = keyed.select(F.col("id").alias(id_col), "ratio", "toxic", "weight", "key", *([F.col("row").alias(row_col)] if row_col else []))
    return out.withColumn("kept", kept)
