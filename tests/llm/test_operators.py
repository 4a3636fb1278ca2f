"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from veilframe.llm import archives, extraction, importance, licenses, minhash, mixing, pieces, quality_rules, suffix, vectors  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) + str(rng.randrange(3000)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Near and exact copies, a shared passage, runs of one character, repeats, null, empty and very long texts."""
    rng = random.Random(5)
    base, passage = _words(rng, 120), _words(rng, 90)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, base), (7, base), (8, base)]
    for k in range(9, 29):
        w = base.split()
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(len(w))] = "x" + str(k)
        rows.append((k, " ".join(w)))
    rows += [(k, _words(rng, rng.randrange(5, 60)) + "\n" + passage + "\n" + _words(rng, rng.randrange(5, 60))) for k in range(29, 45)]
    rows += [(45, "a" * 1500), (46, "Orre " * 300), (47, "é" * 900 + "😀"), (48, _words(rng, 9000)), (49, "b" * 399), (50, "b" * 400), (51, "c" * 401)]
    rows += [(k, _words(rng, 70)) for k in range(52, 80)]
    return rows + [(79, rows[-1][1])]


def test_pieces_equal_the_library(frame, corpus):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = corpus + [(900, " a  b"), (901, "▁▁x ▁"), (902, "日本 \x00\t<s> ﬁ"), (903, " " * 70 + "x")]
    df = pieces.encode_documents(frame([(i, t, "de", "s", 1) for i, t in rows]).withColumnRenamed("lang", "n_tokens"), MODEL, full=True)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids), r.decoded) for r in df.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = set()
    for i, t in rows:
        ids = sp.encode(t or "")
        expected.add((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)), tuple(ids), sp.decode(ids)))
    assert got == expected


def test_merge_rounds_equal_the_library_on_random_text():
    sp, model, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel.load(MODEL), random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("ab ▁ thé\t\n日😀\x00<s>-=/.,01xyzXYZ") * rng.choice([1, 1, 2, 5, 17]) for _ in range(rng.randrange(25)))
        assert model.encode(t) == sp.encode(t)
        ids = [rng.randrange(3, 600) for _ in range(6)]
        assert model.decode(ids) == sp.decode(ids)


def _rules(t):
    w = WORD.findall(t or "")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(frame, corpus):
    rows = corpus + [(800, "x\nx\ny\n\n"), (801, "a a a a a"), (802, "# * $ %&|<>")]
    entries = quality_rules.apply_policy(quality_rules.ledger(frame(rows).withColumnRenamed("lang", "failed")))
    for r in entries.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in {_rules(t) for i, t in rows if i == r.doc_id}
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    table = {r.rule: r for r in quality_rules.ablations(entries.drop("kept", "base_failed")).collect()}
    bits = [r.failed for r in entries.collect()]
    for rule in quality_rules.RULES:
        b = 1 << rule.bit
        assert (table[rule.name].n_failed, table[rule.name].n_failed_alone, table[rule.name].n_kept_without) == (sum(bool(x & b) for x in bits), sum(x == b for x in bits), sum(not x & ~b for x in bits))


def _near(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return sets, label


@pytest.mark.parametrize("block", [1024, 6])
def test_near_duplicates(frame, corpus, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    sets, label = _near(corpus)
    got = minhash.near_duplicates(frame(corpus).withColumnRenamed("lang", "component_id")).collect()
    assert len(got) == len(corpus)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), label[i], label[i] == i) for i in sets}


def _repeats(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = set()
    for i, b in texts:
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k : k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.add((i, len(b), sum(mark), sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, most_runs", [(400, 1024), (400, 1), (250, 1024), (250, 2)])
def test_repeated_strings(frame, corpus, length, most_runs):
    got = suffix.remove_repeats(frame(corpus).withColumnRenamed("lang", "n_bytes"), length=length, most_runs=most_runs).collect()
    assert len(got) == len(corpus)
    assert {tuple(r) for r in got} == _repeats(corpus, length)


@pytest.mark.parametrize("most_runs", [1024, 1])
def test_repeated_strings_of_rows_without_an_id(frame, most_runs):
    rng = random.Random(8)
    passage = _words(rng, 110)
    assert len(passage) > 600
    # The whole passage stands in rows without an id and in one with an id; others share parts of it only.
    rows = [(i, _words(rng, 20) + passage + _words(rng, 20)) for i in (None, None, 1)]
    rows += [(k, _words(rng, 20) + passage[60 * k : 60 * k + 430] + _words(rng, 20)) for k in (2, 3)] + [(3, "z" * 500), (3, "z" * 450)]
    got = suffix.remove_repeats(frame(rows), most_runs=most_runs).collect()
    assert Counter(tuple(r) for r in got) == Counter(x for k, (i, t) in enumerate(rows) for x in [(i, *next(y for y in _repeats([(n, t) for n, (_, t) in enumerate(rows)], 400) if y[0] == k)[1:])])


def test_suffix_order_is_that_of_sorting():
    rng = random.Random(2)
    for _ in range(100):
        parts = [bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 7))]
        _, starts, order = suffix.suffix_order(parts, [len(p) for p in parts])
        assert order.tolist() == [k for _, k in sorted((p[i:], s + i) for p, s in zip(parts, starts.tolist()) for i in range(len(p)))]


def test_common_prefixes():
    rng = random.Random(3)
    for _ in range(100):
        parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(20, 60))) for _ in range(4)]
        raw = b"\0".join(parts) + b"\0"
        _, starts, order = suffix.suffix_order(parts, [len(p) - 19 for p in parts])
        order = np.array([k for k in order.tolist() if any(s <= k <= s + len(p) - 20 for p, s in zip(parts, starts.tolist()))])
        got = suffix.common_prefixes(raw, order, 20)
        for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), got.tolist()):
            assert n == next((k for k in range(20) if raw[a + k] != raw[b + k]), 20)


def test_a_hot_run_is_split_by_the_bytes_around_its_anchor():
    rng = random.Random(4)
    text = _words(rng, 200).encode()
    for first, last in zip(*suffix.runs_of(text)[1:]):
        run = text[first : last + suffix.LENGTH]
        for width in suffix.WIDTHS:
            starts = [k for _, core, s, e in suffix.parts_of(run, width, suffix.LENGTH, suffix.GRAM) for k in range(s, e - suffix.LENGTH + 1) if core in run[k : k + suffix.LENGTH]]
            assert sorted(starts) == list(range(last - first + 1))


def test_mixing(frame, corpus):
    rows = [(i, t, "en", [None, "a", "b", "c", "é", "d"][i % 6]) for i, t in corpus if i != 79] + [(79, corpus[-1][1], "en", "a")]
    df = frame(rows).withColumnRenamed("lang", "size")
    got = mixing.mix(df).collect()
    assert sorted(mixing.mix(df).collect(), key=str) == sorted(got, key=str) and len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    longest = max(len(WORD.findall(t or "")) for _, t, _, _ in rows)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= longest
    assert all(r.taken <= 3 * r.size for r in got)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    assert all(counts[r.doc_id] * r.size >= r.taken for r in got)


def test_importance_keeps_good_text(frame):
    rng = random.Random(3)
    good = [(i, _words(rng, 60), "en", "s") for i in range(200)]
    bad = [(i, "!! ".join(_words(rng, 60).upper().split()) + "!!", "en", "s") for i in range(200, 260)]
    toxic = [(i, _words(rng, 30) + " idiot " + _words(rng, 30), "en", "s") for i in range(260, 300)]
    df = frame(good + bad + toxic + [(300, None), (301, "")])
    labels = frame([(i, int(not 200 <= i < 260), int(i >= 260)) for i in range(0, 300, 2)] + [(0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in importance.resample(df, labels).collect()}
    assert len(got) == 302 and not got[300] and not got[301]
    assert sum(got[i] for i in range(200)) >= 194 and sum(got[i] for i in range(200, 300)) <= 6
    again = {r.doc_id: r.kept for r in importance.resample(df, labels).collect()}
    assert got == again
    assert all(r.kept == (r.doc_id < 300) for r in importance.resample(df, labels.limit(0)).collect())


def test_importance_rejects_inflected_toxic_words_of_every_language(frame):
    rng = random.Random(9)
    stem, ends = {"de": "dummerl", "fr": "sotard"}, [a + b for a in "aeiou" for b in ("n", "st", "rei", "x")]
    rows, n = [], 0
    for lang, toxic in (("en", 80), ("de", 60), ("fr", 60)):
        for k in range(300 + toxic):
            words = _words(rng, 60).split()
            if k >= 300:
                words[5:8] = [stem[lang] + rng.choice(ends) for _ in range(3)] if lang in stem else ["idiot"] * 3
            rows.append((n, " ".join(words), lang, int(k >= 300)))
            n += 1
    labels = frame([(i, 1, t) for i, _, _, t in rows if i % 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in importance.resample(frame([r[:3] for r in rows]), labels).collect()}
    for lang in ("en", "de", "fr"):
        assert sum(kept[i] for i, _, g, t in rows if g == lang and t) <= 3
        assert sum(kept[i] for i, _, g, t in rows if g == lang and not t) >= 290


def test_importance_is_a_gumbel_sample_by_brute_force_ratios(frame, spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    # Good and bad share their words in different parts, so that many texts are neither clearly good nor clearly bad.
    text = lambda p: " ".join((rng.choice("abcdefgh") if rng.random() < p else rng.choice("stuvwxyz")) for _ in range(12))
    rows = [(k, text(0.6 if k % 2 else 0.4), None, None, None) for k in range(600)] + [(600, None), (601, " "), (602, "z " * 50_000), (3, text(0.6))]
    quality = {k: k % 2 for k in range(0, 600)}
    labels = frame([(k, q, 0) for k, q in quality.items()], "doc_id long, quality int, toxic int")
    docs = frame(rows).withColumnRenamed("source", "ratio").withColumnRenamed("lang", "key")
    got = importance.resample(docs, labels).withColumn("u", (F.pmod(F.xxhash64("doc_id", F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)).collect()
    assert len(got) == len(rows)
    use = {r.doc_id: r.use for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2)).alias("use")).collect()}
    grams = lambda t: importance.ngrams([t])[0][0][0].tolist()
    raw, good = Counter(), Counter()
    for i, t, *_ in rows:
        raw.update(grams(t))
        if quality.get(i) == 1 and use[i] == 0:
            good.update(grams(t))
    n = importance.BUCKETS
    sums = {(c, half): sum(v for g, v in m.items() if (g >= n) == half) for c, m in (("raw", raw), ("good", good)) for half in (False, True)}
    ratio = lambda g: np.log((good[g] + 1) / (sums["good", g >= n] + n) / ((raw[g] + 1) / (sums["raw", g >= n] + n)))
    means = {t: np.mean([ratio(g) for g in grams(t)]) if t and t.strip() else None for _, t, *_ in rows}
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, []).append(means[t])
    for r in got:
        assert any((m is None and r.ratio is None) or (m is not None and r.ratio == pytest.approx(m, abs=1e-5)) for m in by_id[r.doc_id])
    live = [r for r in got if r.ratio is not None]
    # The weight is affine in the ratio, and of all such the log odds that fit the held-out labels best.
    slope, constant = np.polyfit([r.ratio for r in live], [r.weight for r in live], 1)
    assert slope > 0 and all(r.weight == pytest.approx(constant + slope * r.ratio, abs=1e-6) for r in live)
    x, w, y = np.array([(r.ratio, r.weight, quality[r.doc_id]) for r in live if use.get(r.doc_id) == 1]).T
    left = np.where(y == 1, 1 - 0.1 / (y.sum() + 0.2), 0.1 / (len(y) - y.sum() + 0.2)) - 1 / (1 + np.exp(-w))
    assert abs(left.mean()) < 1e-4 and abs((left * x / x.std()).mean()) < 1e-4
    assert all(r.key == pytest.approx(r.weight - np.log(-np.log(r.u)), abs=1e-6) for r in live)
    reached = sorted(r.key for r in live if use.get(r.doc_id) == 1 and quality[r.doc_id] == 1)
    k = sum(r.key >= reached[int(importance.LOSS * (len(reached) - 1))] for r in live)
    cut = sorted((r.key for r in live), reverse=True)[k - 1]
    assert all(r.kept == (r.ratio is not None and r.key >= cut) for r in got)
    # Noise decides where the weight does not.
    half = [r for r in importance.resample(docs, labels, k=300).collect() if r.ratio is not None]
    plain = sorted((r.weight for r in half), reverse=True)[299]
    assert sum(r.kept for r in half) == 300 and sum(r.kept != (r.weight >= plain) for r in half) > 20
    assert sum(r.kept for r in half if quality.get(r.doc_id) == 1) > 1.2 * sum(r.kept for r in half if quality.get(r.doc_id) == 0)


def test_kth_largest(spark):
    values = [float(x % 977) for x in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 17, 4500, 9000):
        assert importance.kth_largest(df, "v", k, few=50) == sorted(values, reverse=True)[k - 1]


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    x = np.concatenate([base.repeat(12, 0) + rng.normal(size=(72, 16)) * rng.choice([0.05, 0.2, 0.3], size=(72, 1)), rng.normal(size=(20, 16)) * 1e200]).tolist()
    x += [x[0], x[0], [2 * v for v in x[1]], [0.0] * 16, None, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [0.0] * 15, [], [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, "l") for i, v in enumerate(x)], "vec_id long, embedding array<double>, n_links string")
    ok = [i for i, v in enumerate(x) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(x))}
    for a in ok:
        for b in ok:
            if a != b and len(x[a]) == len(x[b]):
                u, v = np.array(x[a]) / np.abs(x[a]).max(), np.array(x[b]) / np.abs(x[b]).max()
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                    links[a].add(b)
    label = {i: i for i in links}
    for _ in x:
        label = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
    got = vectors.near_vectors(df, tile=16).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, len(links[i]), label[i], label[i] == i) for i in links}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy
now</div><header class="site-header">Site</header><main><article class="post"><h1>Title &lt;x&gt;</h1><p><b>One &amp;amp; two<br><p>Three   four
five</p><ul><li>item<li>other</ul><aside>Related</aside><form><input name=q>Search</form></article></main><div id="comments"><p>First!</p></div><div class="cookie-notice">Cookies</div><footer>&copy; us</footer></body></html>"""


def test_extraction(spark):
    rows = [(k, f"https://www.a.example/{k}", PAGE.replace("Three", f"Three{k}")) for k in range(4)] + [(8, None, None), (9, "x", ""), (10, "http://b.example:80/", "<p>alone"), (11, "http://b.example/", "<nav>menu</nav><script>x"), (0, "https://a.example/0", PAGE.replace("Three", "Three0"))]
    got = extraction.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    main = lambda k: f"Title <x>\nOne &amp; two\nThree{k} four five\nitem\nother"
    expected = [(k, f"https://www.a.example/{k}", main(k)) for k in range(4)] + [(8, None, ""), (9, "x", ""), (10, "http://b.example:80/", "alone"), (11, "http://b.example/", ""), (0, "https://a.example/0", main(0))]
    assert sorted(((r.page_id, r.url or "", r.text, r.n_chars) for r in got)) == sorted((i, u or "", t, len(t)) for i, u, t in expected)


def _article_page(rng, layout):
    """A page of a layout with its known article: blocks of text, parts beside it, odd markup."""
    word = lambda: rng.choice(["river", "stone", "caf\u00e9", "a&amp;b", "x &lt; y", "news", "&eacute;t&#233;"])
    clean = lambda t: __import__("html").unescape(t)
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    head, paras = sentence(5), [sentence(rng.randrange(20, 60)) for _ in range(rng.randrange(3, 8))]
    odd = ["<p>", '<p class="lead" title="5" tall">', "<p title='it\u2019s'>", "<P data-x=1/>".replace("/", ""), '<p id="search-forms">']
    body = [f"{rng.choice(odd)}{p}</p>" if rng.random() < 0.8 else f"<p>{p}" for p in paras]
    link = lambda: f'<a href="/{word()}">{word()}</a>'
    beside = [
        f'<div class="ad-slot">{sentence(12)}</div>', f'<div class="related-posts"><h3>{sentence(3)}</h3><ul>' + "".join(f"<li>{link()}" for _ in range(5)) + "</ul></div>",
        f'<aside>{sentence(30)}</aside>', f'<form><p>{sentence(8)}</p><input name=q></form>', f'<div class="share-buttons">{link()}{link()}</div>', f"<script>if (a < b) document.write('<p>{sentence(9)}</p>')</script>",
        f'<div class="cookie-notice"><p>{sentence(20)}</p></div>', f"<!-- {sentence(5)} > -->", '<div style="display: none">hidden words</div>',
    ]
    for _ in range(3):
        body.insert(rng.randrange(len(body) + 1), rng.choice(beside))
    comments = f'<section id="comments"><div class="comment-body"><p>{sentence(80)}</p></div><div class="comment-body"><p>{sentence(60)}</p></div></section>'
    top = f'<nav><ul><li>{link()}<li>{link()}</ul></nav><header class="site-header"><h1>{sentence(2)}</h1></header>'
    bottom = f'<div id="sidebar"><h2>{sentence(2)}</h2><p>{sentence(25)}</p></div><footer><p>{sentence(10)}</p></footer>'
    text = "".join(body)
    long_part = sentence(150)
    inner = {
        "article": f"<article><h1>{head}</h1>{text}</article>{comments}",
        "beside": f"<div><h1>{head}</h1><div class=content>{text}</div></div>{comments}",
        "body": f"<article><h1>{head}</h1><div class='article-body'>{text}</div></article>{comments}",
        "words": f"<main><article class='post'><header class=entry-header><h1>{head}</h1></header>{text}<div class='side-by-side'><p>{long_part}</p></div><section class='legal-analysis'><p>{long_part}</p></section></article></main>{comments}",
        "plain": f"<div id=wrap><div class='content sidebar-left'><h1>{head}</h1>{text}</div></div>",
    }[layout]
    expected = [head, *paras] + ([long_part] * 2 if layout == "words" else [])
    return f"<!doctype html><html><head><title>t</title><style>p > a {{}}</style></head><body>{top}{inner}{bottom}</body></html>", "\n".join(clean(x) for x in expected)


def test_extraction_of_generated_pages(spark):
    rng = random.Random(31)
    rows, expected = [], {}
    for h, layout in enumerate(["article", "beside", "body", "words", "plain"]):
        for k in range(30):
            page, text = _article_page(rng, layout)
            rows.append((100 * h + k, f"https://User@www.H{h}.example:8080/{k}" if k % 2 else f"//h{h}.example/{k}", page))
            expected[100 * h + k] = text
    rows.append((9999, "http://h0.example/long", "<article><h1>x</h1>" + "".join(f"<p>{'word ' * 20}{k}</p>" for k in range(20_000)) + "</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS paths", "2 AS host")
    got = {r.page_id: r for r in extraction.extract_main_text(pages).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[9999].text.count("\n") == 20_000
    wrong = [(i, got[i].text, t) for i, t in expected.items() if got[i].text != t]
    assert not wrong, (len(wrong), wrong[0])


def test_archives(spark):
    rows = [(k, f"http://h{k % 5}.example/p{k % 3}?q", ["same", "é\r\n\r\nWARC/1.1\r\n", f"own {k}", ""][k % 4]) for k in range(40)] + [(40, None, None), (None, "http://n.example/\n", "same"), (41, "http://[bad", "x" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS id", "'k' AS key")
    got = archives.archive_pages(df).collect()
    assert len({r.archive for r in got}) > 1 and {r.archive for r in got if r.payload_bytes > archives.SMALL}.isdisjoint({r.archive for r in got if r.payload_bytes <= archives.SMALL})
    payload = {i: (t or "") for i, _, t in rows}
    last = {}
    for i, t in payload.items():
        if i is not None:
            last[t] = max(last.get(t, i), i)
    import base64

    assert len(got) == len(rows)
    for r in got:
        t = payload[r.page_id]
        assert r.payload_bytes == len(t.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        if r.page_id is not None:
            assert (r.record_type, r.refers_to) == (("response", None) if last[t] == r.page_id else ("revisit", last[t]))
    keys = [(r.url_key, r.captured_at) for r in got]
    assert keys == sorted(keys)


def test_loser_tree():
    rng = random.Random(6)
    for k in range(0, 9):
        runs = [sorted((rng.randrange(20), n, j) for j in range(rng.randrange(0, 12))) for n in range(k)]
        assert list(archives.LoserTree(runs).merged()) == sorted(x for r in runs for x in r)


def _license_shingles(text):
    w = [x for x in re.sub(r"[^\w]+|_", " ", (text or "").lower()).split(" ") if x]
    return [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]


def _contained(text, template):
    """The largest share of a template's shingles in any stretch of the text of twice its length, by trying all."""
    own, of = set(_license_shingles(template)), _license_shingles(text)
    span = 2 * len(template.split()) + 8
    return max((len(own & set(of[k : k + span])) / len(own) for k in range(max(1, len(of) - span + 1))), default=0.0)


def test_licenses(frame, corpus):
    names = list(licenses.TEMPLATES)
    rows = [(1000 + 50 * n + k, _words(random.Random(k), k) + " " + licenses.TEMPLATES[name].upper() + " " + _words(random.Random(k), 40 - k)) for n, name in enumerate(names) for k in (0, 3, 37)]
    whole = " ".join(licenses.TEMPLATES.values())
    rows += [(9001, _words(random.Random(1), 30_000) + " " + whole + " " + _words(random.Random(2), 30_000)), (None, licenses.TEMPLATES["MIT"]), (9002, whole), (9002, whole)]
    got = licenses.scan_licenses(frame(corpus + rows).withColumnRenamed("lang", "license").withColumnRenamed("source", "words")).collect()
    full = {(r.doc_id, r.license) for r in got if r.containment == 1.0}
    assert {(i, names[(i - 1000) // 50]) for i, _ in rows[: 3 * len(names)]} <= full
    assert {(i, n) for i in (9001, 9002) for n in names} | {(None, "MIT")} <= full
    assert [r.license for r in got if r.doc_id == 9002].count("MIT") == 2
    assert not [r for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert {r.first_word for r in got if r.doc_id in range(1000, 4000, 50) and r.n_shingles > 3 and r.containment == 1 and names[(r.doc_id - 1000) // 50] == r.license} == {0}
    part = " ".join(licenses.TEMPLATES["MIT"].split()[:-9])
    assert {(r.license, r.n_shared < r.n_shingles) for r in licenses.scan_licenses(frame([(1, part)])).collect()} == {("MIT", True)}


def test_licenses_equal_brute_force_on_edited_copies(frame):
    rng, rows = random.Random(21), []
    for n, name in enumerate(licenses.TEMPLATES):
        for k in range(12):
            words = licenses.TEMPLATES[name].split()
            for _ in range(rng.randrange(0, 2 + len(words) // 16)):
                at = rng.randrange(len(words))
                edit = rng.randrange(3)
                words[at : at + 1] = [] if edit == 0 else ["zzz"] if edit == 1 else [words[at], "yyy"]
            rows.append((100 * n + k, _words(rng, rng.randrange(0, 50)) + " " + " ".join(words) + " " + _words(rng, rng.randrange(0, 50))))
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan_licenses(frame(rows)).collect()}
    expected = {(i, name): c for i, t in rows for name, template in licenses.TEMPLATES.items() if (c := _contained(t, template)) >= 0.75}
    assert len(expected) > 100
    # The stretches of the operator are a little longer, so a share can only be larger.
    assert all(got.get(k, 0) >= c - 1e-9 for k, c in expected.items())
    assert set(got) == set(expected)


def test_empty_tables(frame, spark):
    none = frame([])
    assert minhash.near_duplicates(none).count() == 0 and suffix.remove_repeats(none).count() == 0 and mixing.mix(none).count() == 0
    assert pieces.encode_documents(none, MODEL).count() == 0 and quality_rules.ledger(none).count() == 0 and licenses.scan_licenses(none).count() == 0
    assert importance.resample(none, frame([], "doc_id long, quality int, toxic int")).count() == 0
    pages = frame([], "page_id long, url string, html string")
    assert archives.archive_pages(pages).count() == 0 and extraction.extract_main_text(pages).count() == 0
    assert vectors.near_vectors(frame([], "vec_id long, embedding array<float>")).count() == 0
