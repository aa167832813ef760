"""The registered queries against their SQL, a library, a parser, numpy or brute force."""

import html
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from corpusloom.llm import decontamination, html_extraction, mixing, ngram_join, quality_classifier, registry, secret_scans
from corpusloom.llm import common as llm_common
from oracle import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    same(spark, sf, registry.queries()[name], registry.oracle_sql()[name])


def test_token_counts_are_the_librarys(spark, sf):
    from corpusloom.llm import token_counts
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.queries()["op4_token_counts"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def _article(page):
    article = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
    return "\n".join(b for b in blocks if b)


def test_html_equals_a_plain_reading_of_the_articles(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = registry.queries()["op3_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == _article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_html_density_finds_the_text_without_article_tags_and_class_names(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = wrong_chars = chars = 0
    for page in pages:
        plain = re.sub(r' class="[^"]*"', "", page.replace("<article>", "<div>").replace("</article>", "</div>"))
        want, got = _article(page), html_extraction.extract(plain)
        right += got == want
        w, g = set(want.split("\n")), set(got.split("\n"))
        chars += sum(map(len, w))
        wrong_chars += sum(map(len, w ^ g))
    assert right / len(pages) >= 0.9 and wrong_chars / chars < 0.01


def test_held_out_accuracy_and_a_brute_force_vote(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in registry.queries()["op8_quality_classifier"](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    right = [a == b for a, b in held]
    assert len(held) > 50 and sum(right) / len(right) >= 0.95
    assert sum(b for a, b in held if a == 1) / sum(a == 1 for a, _ in held) >= 0.98

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    some = docs.where("doc_id % 10 = 3").collect()
    x = quality_classifier.terms([r.text.encode() for r in some])
    v = model.project(x)
    for row, r in zip(v, some, strict=True):
        near = [(round(float(row @ u), quality_classifier.PLACES), k) for k, u in enumerate(model.vectors)]
        least = sorted((c for c, _ in near), reverse=True)[quality_classifier.NEIGHBOURS - 1]
        votes = [(max(c, 0.0) ** quality_classifier.SHARPNESS * model.weights[k], model.labels[k]) for c, k in near if c >= least]
        assert got[r.doc_id].score == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=1e-6)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixing_meets_targets_and_rates_follow_numpy(spark, sf):
    got = registry.queries()["op9_mixing"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs) and all(r.n_tokens == len(_words(docs[r.doc_id].text)) for r in got)
    right = [r.domain == docs[r.doc_id].lang for r in got if r.n_tokens >= 20]
    assert sum(right) / len(right) > 0.9

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "text")
    model = mixing.fit(d, mixing.labelled_languages(d, spark.read.parquet(f"{sf}/labels.parquet")), key="doc_id", text="text", domain="lang")
    rows = mixing.rates(llm_common.written(mixing.posteriors(d, model, text="text").drop("text"), "p"), model["domains"], mixing.TARGETS).collect()
    p, t, w = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows], float), np.array([r.rate for r in rows])
    share = (p * (t * w)[:, None]).sum(axis=0) / t.sum()
    assert np.allclose(share, [mixing.TARGETS[x] for x in model["domains"]], atol=1e-4) and (w >= 0).all()
    rate, mass = np.ones(len(t)), (p * t[:, None]).sum(axis=0)  # the same descent in numpy
    wanted = np.array([mixing.TARGETS[x] for x in model["domains"]])
    wanted = mass.sum() * wanted / wanted.sum()
    for _ in range(mixing.ROUNDS):
        total = (p * (t * rate)[:, None]).sum(axis=0)
        if np.max(np.abs(total - wanted) / np.maximum(wanted, 1e-3 * mass.sum())) <= mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate - p @ (mixing.STEP * (total - wanted) / mass))
    assert np.allclose(rate, w, atol=1e-6, rtol=0) and rows[0].gap <= mixing.TOLERANCE
    # Of all rates that meet the targets the descent from 1 finds those of a projection: 1 less a sum of posteriors, or 0.
    off, *_ = np.linalg.lstsq(p[w > 1e-9], 1 - w[w > 1e-9], rcond=None)
    assert np.allclose(np.maximum(0, 1 - p @ off), w, atol=1e-3)
    for r in rows[:40]:  # posteriors by hand
        seen = {x for x in _words(docs[r.doc_id].text) if x in model["words"]}
        s = np.array(model["prior"]) + (np.array(model["base"]) + sum((np.array(model["words"][x][:-1]) for x in seen), np.zeros(len(p[0])))) * (r.n_tokens > 0)
        e = np.exp(s - s.max())
        assert np.allclose(e / e.sum(), r.posterior, atol=1e-9)


def _component(ids, sets):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def _shingles(text):
    w = _words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_equals_brute_force(spark, sf):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scores = {r.doc_id: r.predicted for r in registry.queries()["op8_quality_classifier"](spark, sf).collect()}
    kept = [i for i in rows if scores[i]]
    sets = {i: _shingles(rows[i].text) for i in kept}
    kept = [i for i, c in _component(kept, sets).items() if i == c]

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(g) for g in grams}
    hit = lambda w: any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1))
    kept = [i for i in kept if not hit(words(rows[i].text))]

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == sorted(kept) and all(r.rate >= 0 for r in got.values())
    total = {}
    for r in got.values():
        total[r.domain] = total.get(r.domain, 0) + r.rate * r.n_tokens
    whole = sum(total.values())
    assert all(abs(v / whole - mixing.TARGETS[k]) < 0.02 for k, v in total.items())

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = {r.doc_id: r for r in corpus_pipeline.without_secrets(spark, docs, sf).collect()}
    for i, r in rows.items():
        redacted = re.sub(r"AKIA[A-Z0-9]{12,}", "[access]", clean[i].text)
        assert redacted == clean[i].text and clean[i].n_chars == len(clean[i].text)
        if not re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}|(?i:password|passwd|secret|token|api_?key)", r.text):
            assert clean[i].text == r.text


@pytest.mark.parametrize("seed", range(3))
def test_join_finds_every_link_of_random_near_copies(spark, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = [vocabulary[k] for k in rng.integers(0, 3000, int(rng.integers(3, 700)))]
        texts.append(base)
        for _ in range(int(rng.integers(0, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, max(1, len(base) // 25) + 2))):
                copy[int(rng.integers(0, len(copy)))] = vocabulary[int(rng.integers(0, 3000))]
            texts.append(copy[: len(copy) - int(rng.integers(0, 2) * len(copy) // 6)])
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = {k: _shingles(" ".join(t)) for k, t in enumerate(texts)}
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df).collect()}
    assert got == _component(list(sets), sets)


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(5)
    for _ in range(50):
        pool = rng.integers(0, 2**63, 800).astype(np.uint64)
        a, b = np.unique(pool[: int(rng.integers(1, 500))]), np.unique(pool[int(rng.integers(0, 200)) : int(rng.integers(201, 800))])
        x, y = (np.frombuffer(ngram_join.bit_sketch(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        assert np.bitwise_count(ngram_join.folded(x, size) ^ ngram_join.folded(y, size)).sum() <= len(np.setxor1d(a, b))


def test_winnowing_keeps_a_print_of_every_shared_window():
    rng = np.random.default_rng(6)
    for _ in range(200):
        span = rng.integers(0, 2**63, 10).astype(np.uint64)
        a = np.r_[rng.integers(0, 2**63, int(rng.integers(0, 20))).astype(np.uint64), span, rng.integers(0, 2**63, 5).astype(np.uint64)]
        b = np.r_[span, rng.integers(0, 2**63, int(rng.integers(0, 20))).astype(np.uint64)]
        pa, pb = (decontamination.winnow(h, np.zeros(len(h), np.int64))[1] for h in (a, b))
        assert len(np.intersect1d(pa, pb))


def test_secrets_equal_their_sql_where_there_are_some(spark):
    sf = "/root/testdata/sf0.01"
    same(spark, sf, registry.queries()["op5_secret_scans"], registry.oracle_sql()["op5_secret_scans"])
    assert secret_scans.find_secrets(spark.read.parquet(f"{sf}/documents.parquet")).where("size(spans) > 0").count() > 0
