"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import hashlib
import time
import zlib

import corpus_pipeline
import pytest
from corpusloom.llm import (
    decontamination,
    html_extraction,
    mixing,
    ngram_join,
    quality_classifier,
    quality_rules,
    secret_scans,
    token_counts,
    url_filters,
    warc,
)
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
PLAIN = " ".join(f"word{k}" for k in range(80))


def docs(spark, *texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOC)


def odd(spark):
    return docs(spark, None, "", "   \n\t ", "one", LONG, PLAIN, PLAIN, ids=[0, 1, 2, 3, 4, 5, None])


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# 1 --------------------------------------------------------------------------------------------------------------------
def test_join_small_cases(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(odd(spark)).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (59_996, 4), 5: (76, 5), None: (76, None)}


def test_join_ties_repeats_and_thresholds(spark):
    base = [f"a{k}" for k in range(104)]  # 100 shingles
    near = base[:-1] + ["z"]
    texts = [" ".join(base), " ".join(near), " ".join(base), "A B", "a b", "a b c", " ".join(base[:79]), " ".join(base[:78])]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs(spark, *texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 0, 7: 7 if 74 / 100 < 0.75 and 74 / 75 < 0.75 else 0}
    twice = docs(spark, texts[0], texts[1], ids=[7, 7])
    assert [r.component_id for r in ngram_join.ngram_join(twice).collect()] == [7, 7]


def test_join_chains_reach_the_smallest(spark):
    words = [f"c{k}" for k in range(400)]
    texts = [" ".join(words[20 * k : 20 * k + 200]) for k in range(8)]
    assert {r.component_id for r in ngram_join.ngram_join(docs(spark, *texts[::-1])).collect()} == {0}


def test_join_links_an_equal_text_after_a_row_without_id(spark):
    words = [f"w{k}" for k in range(60)]
    text, near = " ".join(words), " ".join([*words, "more"])
    df = spark.createDataFrame([(None, text), (4, text), (2, near)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(df).collect()} == {None: None, 4: 2, 2: 2}


def test_join_empty_table_and_columns(spark):
    assert ngram_join.ngram_join(docs(spark).where("false")).count() == 0
    clash = docs(spark, PLAIN, PLAIN).withColumn("_gone", F.lit(1)).withColumn("n", F.lit(2)).withColumn("words", F.lit("x"))
    kept = ngram_join.keep_one(clash)
    assert kept.columns == clash.columns and [r.doc_id for r in kept.collect()] == [0]


def test_join_takes_keys_of_any_type(spark):
    df = docs(spark, PLAIN, PLAIN + " more", "other", ids=[2, 10, 3]).withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(df).collect()} == {"k10": "k10", "k2": "k10", "k3": "k3"}
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == ["k10", "k3"]


def test_hot_words_change_no_link(spark):
    base = [f"a{k}" for k in range(104)]
    texts = [" ".join(base[k % 5 : 100 - k % 7] + [f"u{k}"] * (k % 9)) for k in range(30)] + [" ".join([f"v{k}x{j}" for j in range(40)] + base[:20]) for k in range(20)]
    texts += [" ".join(f"b{k // 40 * 0 + j}" for j in range(k, 600 + k)) for k in range(0, 200, 40)]
    df = docs(spark, *texts)
    plain = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, hot_rows=10**9).collect()}
    hot = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, hot_share=1, hot_rows=3).collect()}
    assert plain == hot and len(set(plain.values())) > 20


def test_pairs_below_the_threshold_grow_in_proportion(spark, monkeypatch):
    """Documents of one template at a similarity of 0.73: what is verified grows with them, not with their square."""
    checked = []
    verified = ngram_join.verified

    def counted(docs, key, text, pairs, scratch, size=5):
        checked[-1] += pairs.count()
        return verified(docs, key, text, pairs, scratch, size)

    monkeypatch.setattr(ngram_join, "verified", counted)
    template = [f"t{k}" for k in range(104)]
    for n in (250, 500, 1000):
        texts = []
        for k in range(n):  # 16 of 100 shingles are a document's own
            words = list(template)
            for j in range(3):
                words[10 + 30 * j] = f"own{k}x{j}"
            texts.append(" ".join([*words, f"own{k}end"]))
        sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts[:2]]
        assert 0.72 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.75
        checked.append(0)
        assert {r.doc_id == r.component_id for r in ngram_join.ngram_join(docs(spark, *texts)).collect()} == {True}
    assert checked[1] <= 2.2 * checked[0] and checked[2] <= 2.2 * checked[1] and checked[2] <= 3 * 1000


def test_blocks_return_a_forest_of_true_links():
    rng = __import__("numpy").random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**62, 60).astype("uint64")
        sets += [sorted({*base[int(rng.integers(0, 12)) :].tolist(), *rng.integers(0, 2**62, int(rng.integers(0, 9))).tolist()}) for _ in range(5)]
    np = __import__("numpy")
    members = [(k % 2, k, k, len(s), np.array(s, np.uint64).tobytes()) for k, s in enumerate(sets)]
    for two in (False, True):
        near = lambda a, b: 4 * len(set(sets[a]) & set(sets[b])) >= 3 * len(set(sets[a]) | set(sets[b])) and (not two or a % 2 != b % 2)
        got = ngram_join._linked(two, list(members)).tolist()
        parent = {k: k for k in range(len(sets))}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in got:
            assert near(a, b) and root(a) != root(b)
            parent[root(a)] = root(b)
        assert all(root(a) == root(b) for a in range(len(sets)) for b in range(a) if near(a, b))


# 2 --------------------------------------------------------------------------------------------------------------------
def urls(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "page_id long, url string")


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        (None, None, "allow"),
        ("", None, "allow"),
        ("example.com/en/7", None, "allow"),
        ("http://EXAMPLE.com/en/78", "example.com/en/7", "allow"),
        ("http://a.example.com/en/6?x#y", "com/en/", "block"),
        ("http://notexample.com/en/7", "com/en/", "block"),
        ("http://x.net/de/8", "net/de/", "allow"),
        ("http://x.example.net/de/81", "example.net/de/8", "block"),
        ("x://com", None, "allow"),
        ("http://com/en/", "com/en/", "block"),
        ("http://" + "a." * 3000 + "org/es/", "org/es/", "block"),
    ],
)
def test_url_rules(spark, url, rule, verdict):
    got = url_filters.filter_urls(urls(spark, url), url_filters.rules_frame(spark)).first()
    assert (got.url_rule, got.url_verdict) == (rule, verdict)


def test_url_clashes_repeats_and_no_rules(spark):
    pages = urls(spark, "http://a.org/es/1", "http://a.org/es/1").withColumn("n_rules", F.lit("x")).withColumn("digest", F.lit("d"))
    got = url_filters.filter_urls(pages, url_filters.rules_frame(spark))
    assert got.count() == 2 and got.where("url_verdict = 'block' and digest = 'd'").count() == 2
    both = url_filters.rules_frame(spark, [("allow", "a.org", "/"), ("block", "a.org", "/"), (None, "x", "y")])
    assert {r.url_verdict for r in url_filters.filter_urls(pages, both).collect()} == {"block"}
    none = url_filters.filter_urls(pages, url_filters.rules_frame(spark).where("false"), default_verdict="block")
    assert {r.url_verdict for r in none.collect()} == {"block"}
    assert url_filters.filter_urls(pages.where("false"), both).count() == 0


def test_url_rules_of_any_length_and_number_of_lengths(spark):
    long = "/" + "p" * 6000
    rules = url_filters.rules_frame(spark, [("block", "a.org", long), *[("allow", "b.org", "/" + "q" * k) for k in range(40)]])
    pages = urls(spark, "http://x.a.org" + long + "tail", "http://a.org/p", "http://b.org/" + "q" * 90).withColumn("_u_host", F.lit(1)).withColumn("_u_path", F.lit(2))
    for bound in (1024, 3):
        got = url_filters.filter_urls(pages, rules, max_lengths=bound, default_verdict="none").orderBy("page_id").collect()
        assert [r.url_verdict for r in got] == ["block", "none", "allow"] and [r.n_rules for r in got] == [1, 0, 40]
        assert got[2].url_rule == "b.org/" + "q" * 39 and {(r._u_host, r._u_path) for r in got} == {(1, 2)}


# 3 --------------------------------------------------------------------------------------------------------------------
PARA = "<p>" + "Some real text of the article. " * 5 + "</p>"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("<nav><a>Home</a></nav><form><input>Send</form>", ""),
        ("a &amp;lt; b &#233;&nbsp;c", "a &lt; b é c"),
        ("<article><h1>T</h1><p>x<br>y <b>z</b></p><div class='user-comments'><p>no</p></div><p>w</article><footer>f</footer>", "T\nx y z\nw"),
        ("<article><p>3 < 5</p><script>var a='<p>no</p>'</script><!-- <p>no</p> --><aside>no</aside></article>", "3 < 5"),
        ("<article><p>a<p>b<li>c<li>d", "a\nb\nc\nd"),
        ("<div role=banner>no</div><main><header><h1>T</h1></header><p>x</p></main>", "T\nx"),
    ],
)
def test_html(page, text):
    assert html_extraction.extract(page) == text


def test_html_without_article_finds_the_surge():
    page = f"<div>Menu</div><h2>Head</h2>{PARA * 3}<div class=ad>Buy</div>{PARA}<footer>c</footer>"
    got = html_extraction.extract(page).split("\n")
    assert got[0] == "Head" and len(got) == 5 and "Buy" not in got and "Menu" not in got


def test_html_surge_and_dive_choose_the_lines_of_marked_pages():
    long = "\n".join(["Some real text of the article. " * 5] * 3).replace(". \n", ".\n").strip()
    for teaser in ("<article><p>Read on</p></article>", "<main><h2>New</h2></main>"):
        assert html_extraction.extract(f"{teaser}<div>{PARA * 3}</div>").split("\n")[-3:] == long.split("\n")
    assert html_extraction.extract(f"<article><p>Read on</p></article><div>{PARA * 3}</div>") == long
    # A short element inside the text stays, short lines around an article do not, and the article's own first lines do.
    assert html_extraction.extract(f"<div>{PARA}<article><p>Quote</p></article>{PARA}</div>").split("\n")[1] == "Quote"
    assert html_extraction.extract(f"<div>Menu</div><article><p>a</p><p>b</p><p>c</p><p>d</p>{PARA * 3}</article><div>End</div>") == "a\nb\nc\nd\n" + long
    # Text ends where a window holds nothing, and what follows must surge again.
    page = f"<article>{PARA * 3}<aside><p>1<p>2<p>3<p>4</aside><p>tail</p></article>"
    assert html_extraction.extract(page) == long
    assert html_extraction.extract(page, surge=3) == long + "\ntail"
    assert html_extraction.extract(page, lines=6) == long + "\ntail"


def test_html_long_repeats_and_clashes(spark):
    page = "<article>" + PARA * 3000 + "</article>"
    df = spark.createDataFrame([(1, page, "old"), (1, page, "old"), (2, None, None)], "page_id long, html string, text string")
    got = html_extraction.extract_text(df).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [1, 1, 2] and len(got[0].text.split("\n")) == 3000 and got[0].text == got[1].text and got[2].text == ""
    assert html_extraction.extract_text(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "unit",
    ["<div>", "</span>", '<a b="c', "<a \">\"'>'", "<span>x", "<p>y", "<!", "<nav><i>", "<x class=ad>", "<b " + "a" * 50, "<li><ul>", "&amp", "<table><tr><td>", "<!-- a", "<a href='"],
)
def test_html_takes_time_in_proportion(unit):
    page = "<div>" * 1000 + "<span>" * 20_000 + unit * (2_000_000 // len(unit)) + "</span>" * 20_000
    began = time.perf_counter()
    html_extraction.extract(page)
    assert time.perf_counter() - began < 30


def test_html_class_names_tell_by_their_last_part():
    kept = "<div id='notice-of-meeting'>Meeting on Monday</div><p class='share-price'>12 euros</p>"
    gone = "".join(f"<div class='{c}'>Gone</div>" for c in ("user-comments", "cookie-banner", "ad-300x250", "adSlot", "share-buttons", "sidebar2", "related-posts", "comment-list"))
    assert html_extraction.extract(f"<article>{PARA}{kept}{gone}{PARA}</article>").split("\n")[1:-1] == ["Meeting on Monday", "12 euros"]


TALK = "".join(f"<p>{x} and more words of a reader, long enough to surge.</p>" for x in ("First I think so", "Second I do not", "Third of all"))


def test_html_comments_and_adverts_of_unknown_names_go():
    want = html_extraction.extract(f"<article>{PARA * 3}</article>")
    for name in ("discussion-thread", "visitor-voices", "zz9"):
        assert html_extraction.extract(f"<article>{PARA * 3}</article><div class='{name}'>{TALK}</div>") == want
        assert html_extraction.extract(f"<body>{PARA * 3}<div class='{name}'>{TALK}</div></body>") == want
        assert html_extraction.extract(f"<div id=wrap><div class=content><h1>T</h1>{PARA * 2}<div class='{name}'>Buy now, the best of all offers of this week</div>{PARA}</div></div>") == "T\n" + want
    for name in ("content-part", "post_body", "highlight", "wp-block-quote", "row"):
        assert len(html_extraction.extract(f"<article>{PARA}<div class='{name}'>{PARA}</div>{PARA * 2}</article>").split("\n")) == 4
    even = "".join(f"<div class='x{k}'>{PARA}</div>" for k in "abcd")  # no box has most of the text: none is an island
    assert len(html_extraction.extract(f"<article>{even}</article>").split("\n")) == 4
    assert html_extraction.extract(f"<article><p>{'Teaser text that surges. ' * 5}</p></article><div class=zz>{'<p>' + 'Long text of the page. ' * 20 + '</p>'}</div>").endswith("page.")


# 4 --------------------------------------------------------------------------------------------------------------------
def test_token_small_cases(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))
    texts = [None, "", LONG, "<|endoftext|>a<|endoftext|>", "a" * 10_001, "é日本🎉 \u0000\u2028 x", "x", "x", "  \n\n\t y "]
    df = docs(spark, *texts).withColumn("n_tokens", F.lit(-1)).withColumn("n_bytes", F.lit("z"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df).collect()}
    assert got == {k: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}
    assert token_counts.count_tokens(df.where("false")).count() == 0


def test_very_long_words_take_their_own_pass(spark):
    import random

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.vocabulary_path(token_counts.VOCABULARY))
    merger = token_counts.Merger(token_counts.vocabulary_path(token_counts.VOCABULARY))
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=n)) for n in (1, 2, 300, 900, 5000)] + ["a" * 999, "ab" * 700, "日本" * 500]
    for w in words:
        n = len(tok.encode(w, add_special_tokens=False).ids)
        assert merger.count([w.encode()]).tolist() == [n] and merger.count_long(w.encode()) == n
    began = time.perf_counter()
    merger.count(["".join(rng.choices("etaoinshrdlu", k=200_000)).encode()])
    assert time.perf_counter() - began < 10


# 5 --------------------------------------------------------------------------------------------------------------------
def spans(spark, *texts):
    found = secret_scans.find_secrets(docs(spark, *texts))
    return {r.repository: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}


def test_secret_spans(spark):
    key = "AKIA" + "Z" * 16
    texts = [None, "", f"é {key}", "Token = 'abcdefgh' SECRET:short", "token: api: abcdefghij", "x" + "0a" * 16 + "g", "api_key=" + "f" * 40, "AKIA123", LONG]
    assert spans(spark, *texts) == {
        0: [], 1: [], 2: [("access", 2, 22)], 3: [("assign", 0, 17)], 4: [], 5: [("hex", 1, 33)], 6: [("assign", 0, 48), ("hex", 8, 48)], 7: [], 8: [],
    }


def test_widely_copied_extras_are_examples(spark):
    token = "ghp_" + "a1B2" * 8
    one = docs(spark, f"see {token}", f"and {token}")
    assert all(len(r.spans) == 1 and r.spans[0].live for r in secret_scans.find_secrets(one).collect())
    many = docs(spark, *[f"see {token} password=hunter2222" for _ in range(4)]).withColumn("source", F.concat(F.lit("s"), "doc_id"))
    got = secret_scans.find_secrets(many).collect()
    assert all([(s.kind, s.live) for s in r.spans] == [("assign", False)] for r in got)


def test_a_value_in_many_repositories_is_an_example(spark):
    token = "ghp_" + "a1B2" * 8
    n = secret_scans.LIVE_REPOSITORIES
    for k in (n, n + 1):
        found = secret_scans.find_secrets(docs(spark, *[f"see {token}"] * k).withColumn("source", F.lit("one"))).collect()
        assert [len(r.spans) for r in found] == [int(k == n)] * k


def test_redaction_of_long_texts_and_overlaps(spark):
    many = " ".join(f"ü{k} token=abcdefgh{k}" for k in range(3000))
    texts = [many, "x" * 5000 + "é token=" + "0a" * 20 + "y" * 9000 + " AKIA" + "Z" * 16, "secret=AKIA" + "Q" * 16 + "f" * 40 + " end"]
    got = {r.doc_id: r.text for r in secret_scans.redact(docs(spark, *texts)).collect()}
    assert got[0] == " ".join(f"ü{k} [assign]" for k in range(3000))
    assert got[1] == "x" * 5000 + "é [assign]" + " [access]" and got[2] == "[assign] end"


def test_redaction(spark):
    df = docs(spark, "a password=hunter2222 b", "a password=hunter2222 b", None, "ü token=" + "0a" * 20 + " z", ids=[1, 1, 2, None]).withColumn("_spans", F.lit(0)).withColumn("_own", F.lit(0))
    got = secret_scans.redact(df)
    assert got.columns == df.columns and sorted(r.text or "" for r in got.collect()) == ["", "a [assign] b", "a [assign] b", "ü [assign] z"]
    assert secret_scans.redact(df.where("false")).count() == 0


# 6 --------------------------------------------------------------------------------------------------------------------
def bench(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_decontamination_small_cases(spark):
    item = " ".join(f"b{k}" for k in range(14))
    items = bench(spark, (10, item), (2, item.upper()), (3, "Tiny item"), (4, ""), (5, None), (None, "lost words here"))
    texts = [None, "", "x " + item + " y", "b0 b1 b2 b3 b4 b5 b6 b7 b8", "a tiny, ITEM tiny item", LONG + " " + item, "lost words here"]
    df = docs(spark, *texts).withColumn("row", F.lit("r")).withColumn("items", F.lit("i"))
    for block in (decontamination.BLOCK_BYTES, 20):
        got = {r.doc_id: (r.n_words, len({w for h in r.hits for w in range(h.a, h.b)}), list(r.items)) for r in decontamination.find_contamination(df, items, block_bytes=block).collect()}
        assert got == {0: (0, 0, []), 1: (0, 0, []), 2: (16, 14, ["10", "2"]), 3: (9, 0, []), 4: (5, 4, ["3"]), 5: (60_014, 14, ["10", "2"]), 6: (3, 3, [])}
    clean = decontamination.drop_contaminated(df, items, block_bytes=20)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [0, 1, 3]
    assert decontamination.find_contamination(df, items.where("false")).where("size(hits) > 0").count() == 0
    assert decontamination.find_contamination(df.where("false"), items).count() == 0


def test_items_without_a_name_mark_words_and_are_not_listed(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    items = bench(spark, (None, passage), (None, "two words"), (5, passage + " end"))
    texts = ["x " + passage + " y", "some two words", "y " + passage + " end"]
    for block in (decontamination.BLOCK_BYTES, 0):
        got = {r.doc_id: (sum(h.b - h.a for h in r.hits), list(r.items)) for r in decontamination.find_contamination(docs(spark, *texts), items, block_bytes=block).collect()}
        assert got == {0: (12, ["5"]), 1: (2, []), 2: (13, ["5"])}
        assert decontamination.drop_contaminated(docs(spark, *texts), items, block_bytes=block).count() == 0


def test_items_of_several_rows_count_once_whatever_the_blocks(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(12)) for x in "ab")
    items = bench(spark, (7, one), (7, two), (8, two))
    for block in (decontamination.BLOCK_BYTES, 20):
        found = decontamination.find_contamination(docs(spark, one + " " + two), items, block_bytes=block).collect()
        assert [list(r.items) for r in found] == [["7", "8"]]


def test_a_large_benchmark_is_joined_with_the_same_result(spark, sf):
    df, items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    df = df.unionByName(df.where("doc_id < 20"))
    got = []
    for block in (decontamination.BLOCK_BYTES, 0):
        found = decontamination.find_contamination(df, items, block_bytes=block)
        rows = found.select("doc_id", "n_words", decontamination.hit_words(F.col("hits")).alias("n"), F.array_join("items", ",").alias("i")).collect()
        got.append(sorted(map(tuple, rows)))
        kept = decontamination.drop_contaminated(df, items, block_bytes=block)
        got[-1].append(sorted(r.doc_id for r in kept.collect()))
    assert got[0] == got[1] and sum(r[2] > 0 for r in got[0][:-1]) >= 3


# 7 --------------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 400_000
    rows = [(3, "http://a/ü?x=1\r\ny", big), (1, None, big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (1, "again", big), (6, "%41", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, folder)
    back = warc.read_records(index, folder).collect()
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes) for r in back) == sorted(
        (i, u or "", "revisit" if (i, h) == (3, big) else "response", 1 if (i, h) == (3, big) else None, len((h or "").encode())) for i, u, h in rows
    )
    for r in back:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.digest and len(r.payload) == r.payload_bytes
    some = warc.read_records(index.where("page_id = 2"), folder).collect()
    assert [bytes(r.payload) for r in some] == [b"short"]
    assert warc.read_records(warc.write_archives(pages.where("false"), folder), folder).count() == 0


def test_warc_without_broadcast_and_with_rolled_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 200)
    monkeypatch.setattr(warc, "REGION", 300)
    rows = [(k, f"u{k}", "same payload of every row " * 10 if k % 3 else f"own {k} " * 30) for k in range(40)] + [(None, "n", "same payload of every row " * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = []
    for k, bound in enumerate((warc.BROADCAST_BYTES, 0)):
        index = warc.write_archives(pages, f"file://{tmp_path}/{k}", broadcast_bytes=bound)
        assert index.select("file").distinct().count() > 4
        back = warc.read_records(index, f"file://{tmp_path}/{k}")
        got.append(sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes) for r in back.collect()))
    assert got[0] == got[1] and len(got[0]) == 41 and sum(x[1] == "response" for x in got[0]) == 15


def test_reads_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 5_000_000, 10), ("b", 0, 5), ("b", 0, 5)]
    assert [(f, len(r)) for f, r in warc._coalesced(iter(rows))] == [("a", 2), ("a", 1), ("b", 2)]


# 8 --------------------------------------------------------------------------------------------------------------------
def test_classifier_small_cases(spark):
    good, bad = "The quick brown fox jumps over the lazy dog again. ", "BUY*** NOW!!! $$$ "
    df = docs(spark, *[good * (k % 5 + 2) if k % 2 else bad * (k % 5 + 2) for k in range(60)])
    marks = labels(spark, *[(k, k % 2, 0) for k in range(60)], (61, None, 0), (None, 1, 0))
    model = quality_classifier.fit(df, marks)
    tried = odd(spark).withColumn("score", F.lit("old"))
    got = quality_classifier.score(tried, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and next(r.score for r in got if r.doc_id == 0) == pytest.approx(model.alike)
    clash = df.withColumn("_quality_score", F.lit("mine"))
    kept = quality_classifier.keep_good(clash, marks)
    assert kept.columns == clash.columns and {(r.doc_id % 2, r._quality_score) for r in kept.collect()} == {(1, "mine")}
    none = quality_classifier.fit(df, marks.where("false"))
    assert {r.score for r in quality_classifier.score(df, none).collect()} == {0.5}
    one = quality_classifier.fit(df, marks.where("quality = 1"))
    assert {r.score for r in quality_classifier.score(df, one).collect()} == {1.0}
    assert quality_classifier.score(df.where("false"), model).count() == 0


def test_classifier_ties_and_texts_without_words(spark):
    same = "one text that many rows share and label apart "
    df = docs(spark, *[same] * 60, *["!!"] * 30, "", None)
    marks = labels(spark, *[(k, int(k % 3 == 0), 0) for k in range(60)], *[(k, 0, 0) for k in range(60, 90)])
    model = quality_classifier.fit(df, marks)
    got = {r.doc_id: r.score for r in quality_classifier.score(df, model).collect()}
    learnt = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    assert got[0] == pytest.approx(sum(k % 3 == 0 for k in learnt) / len(learnt), abs=1e-6) and len({got[k] for k in range(60)}) == 1
    assert got[90] == got[91] == 0.0  # the shortest labelled texts are junk
    twice = docs(spark, "b", "a", "b", ids=[1, 1, 1])
    assert quality_classifier.fit(twice, labels(spark, (1, 1, 0))).labels.tolist() == [1.0]


# 9 --------------------------------------------------------------------------------------------------------------------
def test_mixing_small_cases(spark):
    df = docs(spark, None, "", *["the cat and the dog"] * 4, *["der hund und die katze"] * 2, ids=[0, 1, 2, 3, 4, 4, 5, 6])
    df = df.withColumn("lang", F.when(F.col("text").contains("hund"), "de").otherwise("en")).withColumn("rate", F.lit("old"))
    got = mixing.mix(df, df.select("doc_id", "lang").where("doc_id > 1"), {"en": 0.5, "de": 0.5, "fr": 0.3}).collect()
    total = {d: sum(r.rate * r.n_tokens for r in got if r.domain == d) for d in ("en", "de")}
    assert len(got) == 8 and all(r.rate >= 0 for r in got) and total["en"] == pytest.approx(total["de"], rel=0.05)
    assert len({r.rate for r in got if r.doc_id == 4}) == 1
    assert len({r.gap for r in got}) == 1 and got[0].gap <= 1e-6
    far = mixing.mix(df.where("lang = 'en'"), df.select("doc_id", "lang"), {"de": 1.0}).first()  # no rates give German tokens alone
    assert far.gap > 1e-6
    none = mixing.mix(df, df.select("doc_id", "lang").where("false"), {"en": 1.0}).collect()
    assert {(r.rate, r.gap) for r in none} == {(1.0, None)}
    assert mixing.mix(df.where("false"), df.select("doc_id", "lang"), {"en": 1.0}).count() == 0


def test_mixing_many_domains_clashes_long_texts_and_ties(spark):
    words = [" ".join(f"d{k}w{j}" for j in range(6)) for k in range(90)]
    df = docs(spark, *[w for w in words for _ in range(2)]).withColumn("lang", F.concat(F.lit("l"), F.lpad((F.col("doc_id") / 2).cast("int").cast("string"), 2, "0")))
    got = mixing.mix(df, df.select("doc_id", "lang"), {f"l{k:02d}": 1.0 for k in range(90)}).collect()
    assert len({r.domain for r in got}) > 30 and all(r.rate >= 0 for r in got)
    df = docs(spark, "the cat", "der hund", "the cat", LONG, "nothing known").withColumn("lang", F.when(F.col("doc_id") == 1, "de").when(F.col("doc_id") == 3, "xx").otherwise("en"))
    clash = df
    for c in ("_m", "_s", "_e", "_t", "_rate", "_found", "Rate", "Domain"):
        clash = clash.withColumn(c, F.lit("mine"))
    out = mixing.mix(clash, df.select("doc_id", "lang").where("doc_id < 2"), {"en": 0.5, "de": 0.5})
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "_m", "_s", "_e", "_t", "_rate", "_found", "n_tokens", "domain", "posterior", "rate", "gap"]
    got = {r.doc_id: r for r in out.collect()}
    assert {(r._m, r._s, r._e, r._t, r._rate, r._found) for r in got.values()} == {("mine",) * 6}
    assert got[3].n_tokens == 60_000 and got[3].domain == got[4].domain == "de" and got[4].posterior == pytest.approx(0.5)


# 10 -------------------------------------------------------------------------------------------------------------------
def test_rules_small_cases(spark):
    df = odd(spark).unionByName(docs(spark, "a b c " * 30, PLAIN + "\nsame\nsame\n \n", ids=[8, 9])).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("y"))
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.n_dup_lines, r.base_failed, r.kept) for r in quality_rules.quality_rules(df).collect()}
    assert got[0] == got[1] == got[2] == (0, 0, 0, True, False) and got[3] == (1, 0, 0, True, False)
    assert got[4] == (60_000, 0, 0, False, True) and got[5] == (80, 0, 0, False, True) and got[8] == (90, 90, 0, True, False) and got[9][:3] == (82, 0, 1)
    assert quality_rules.quality_rules(df.where("false")).count() == 0


def test_cascade_order_changes_no_verdict(spark):
    df = quality_rules.measure(docs(spark, PLAIN, PLAIN.upper(), "!! " * 200 + PLAIN, "# $ " * 60 + PLAIN))
    one = quality_rules.apply_rules(df, list(quality_rules.RULES)).select("doc_id", "kept").collect()
    two = quality_rules.apply_rules(df, list(quality_rules.RULES)[::-1]).select("doc_id", "kept").collect()
    assert sorted(one) == sorted(two)


def test_repeats_are_exact_in_very_long_texts(spark):
    rows = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("t"))
    texts = rows.select(F.explode(F.array("t", F.concat("t", F.lit(" w5 w6 w7 w8 w5 w6 w7")))).alias("text"))
    assert sorted(r.n_repeat_words for r in quality_rules.measure(texts).collect()) == [0, 11]


def test_rules_keep_columns_and_nulls(spark):
    df = odd(spark).withColumn("_w", F.lit(1)).withColumn("_l", F.lit(2))
    out = quality_rules.quality_rules(df)
    assert [c for c in out.columns if c in df.columns] == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text is None and got[1].text == "" and (got[5]._w, got[5]._l) == (1, 2)
    other = quality_rules.quality_rules(df.withColumn("body", F.lit("a b c " * 30)), text="body").collect()
    assert {r.n_repeat_words for r in other} == {90} and {r.text for r in other} == {r.text for r in df.collect()}


def test_cascade_order_is_by_rejections_per_character(spark):
    df = quality_rules.measure(docs(spark, *["!! " * 200 + PLAIN] * 3, *["# $ " * 60 + PLAIN] * 2, PLAIN.upper()))
    assert [r.name for r in quality_rules.cascade_order(df)] == ["symbols", "exclamations", "shouting", "duplicate_lines", "word_length"]


# pipeline -------------------------------------------------------------------------------------------------------------
def test_pipeline_stages_keep_columns_and_survive_empty_tables(spark, tmp_path, sf):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    empty = docs(spark, "x").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    df = odd(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns
        assert out.count() > 0
