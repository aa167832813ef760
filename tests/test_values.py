"""Values of queries that have no SQL: against loops, or by hand."""

import random

from corpusloom.operators import figures, pages, passages, select


def test_windows_are_spread_like_a_greedy_loop(spark):
    rng = random.Random(2)
    rows = [(k, at, rng.randrange(6) / 2) for k in range(4) for at in rng.sample(range(300), 40)]
    got = {(r.key, r.at) for r in select.spread_windows(spark.createDataFrame(rows, "key int, at long, score double"), "key", "at", "score", 25, 5).collect()}
    want = set()
    for k in range(4):
        kept = []
        for _, at in sorted((-s, at) for key, at, s in rows if key == k):
            if len(kept) < 5 and all(abs(at - x) >= 25 for x in kept):
                kept.append(at)
        want |= {(k, at) for at in kept}
    assert got == want and len(got) == 20


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, k, n) for k, n in enumerate([5, 9, 3, 4, 1, 2])] + [(2, 0, 11), (2, 1, 10), (2, 2, 1)]
    got = {(r.key, r.pos) for r in select.pack_skipping(spark.createDataFrame(rows, "key int, pos int, n int"), "key", "pos", "n", 10).collect() if r.packed}
    assert got == {(1, 0), (1, 2), (1, 4), (2, 1)}


def test_the_best_passage_is_the_middle_one_of_the_best(spark):
    filler = "nothing of the kind is said here. " * 12  # 408 characters
    texts = [filler * 3 + "Zebra crossings cost 4200 euros. " + filler * 3, "zebra", "", filler * 6, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.start, r.score) for r in passages.best_passage(df, "Zebra crossings cost 4200", "doc_id").collect()}
    # Windows of 1200 characters start at every 400th; 400, 800 and 1200 hold the sentence that begins at 1224.
    assert got[0][0] == 800 and got[0][1] > 0 and got[1] == (0, got[1][1]) and got[3] == (0, 0.0)


def test_figures_are_counted_by_sentence(spark):
    text = "It has 24 cores [1]. Plain words only. The price, e.g. in 2024, is unknown. It draws 350 W at 1.5 GHz. No. 3 is missing [2]. Version 1.2.3 is out [4]."
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.sentences, r.with_figures, r.cited, r.absent) for r in figures.figure_stats(df).collect()}
    assert got[1] == (6, 3, 2, 2) and got[2][1:] == (0, 0, 0) and got[3][1:] == (0, 0, 0)


def test_references_are_other_hosts_by_what_they_say(spark):
    rows = [
        (1, "a.org", 0, "https://a.org/solar-panels", "solar panels"),  # the page's own host
        (1, "a.org", 1, "https://b.org/x", "solar"),
        (1, "a.org", 2, "https://c.org/solar-panels", "more"),
        (1, "a.org", 3, "https://d.org/cats", "cats"),
        (1, "a.org", 4, "https://www.facebook.com/solar", "solar panels"),
        (1, "a.org", 5, "https://e.org/panels", "solar"),
        (1, "a.org", 6, "https://f.org/panels", "panels"),
    ]
    df = spark.createDataFrame(rows, "page_id int, domain string, pos int, link string, anchor string")
    got = [(r["place"], r.pos, r.score) for r in pages.select_references(df, "solar panels").orderBy("place").collect()]
    assert got == [(1, 2, 1.0), (2, 5, 1.0), (3, 1, 0.5)]
