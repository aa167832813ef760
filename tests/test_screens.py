import re

from corpusloom.operators import screens


def test_mentions_however_punctuated(spark):
    texts = ["U.S. Urology Partners met US-Urology partners, not USA Urology Partners", "none given, One GI", "US é Urology Partners", None, "", "the the the_the", "word " * 3000 + "one gi " * 3]
    names = ["US Urology Partners", "One GI", "the the", "...", "usurologypartners"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.name): r.n for r in screens.mentions(docs, spark.createDataFrame([(n,) for n in names], "name string")).collect()}

    def brute(text, name):
        chars = re.findall("[A-Za-z0-9]", name)
        p = r"(?<![A-Za-z0-9])(?=(" + r"[\W_]*".join(chars) + r")(?![A-Za-z0-9]))"
        return len(re.findall(p, text or "", re.I)) if chars else 0

    wanted = {(k, n): brute(t, n) for k, t in enumerate(texts) for n in names}
    assert got == {k: n for k, n in wanted.items() if n}
    assert got[(0, "US Urology Partners")] == 2 and got[(5, "the the")] == 3 and got[(6, "One GI")] == 3
    assert screens.mentions(docs, spark.createDataFrame([], "name string")).count() == 0


def test_known_errors_by_block(spark):
    facts = [{"name": "f", "terms": ["ram"], "conditions": [{"all": ["4 ?gb", "ram"], "none": ["not"], "needs_cite": [3, 4]}, {"all": ["best"]}]}]
    reports = {1: ["4GB RAM [5]", "the best"], 2: ["4GB RAM [3]", "best"], 3: ["4GB RAM", "best"], 4: ["not 4 GB ram [5]", "best"], 5: ["nothing", None], 6: [None]}
    df = spark.createDataFrame([(r, t) for r, ts in reports.items() for t in ts], "report int, text string")
    assert {r.report: r.status for r in screens.known_errors(df, facts).collect()} == {1: "present", 2: "clear", 3: "clear", 4: "clear", 5: "absent", 6: "absent"}


def test_quotes_and_conflicts(spark):
    text = "It is **very**  slow in winter.\n\nOthers say it is quick.\n\n## Researched but not used\nAn unused line here."
    reports = spark.createDataFrame([(1, text)], "report int, text string")
    quotes = spark.createDataFrame([(1, "is very slow `in`"), (1, "unused line here"), (1, "It is"), (2, "is very slow in"), (1, None)], "report int, quote string")
    assert [r.found for r in screens.quotes_in_reports(quotes, reports).collect()].count(True) == 1
    blocks = spark.createDataFrame([(1, 0, "Alpha X: it is very slow in winter"), (1, 1, "alpha-x is quick in every winter"), (1, 2, "Beta is cheap to buy")], "report int, at int, text string")
    rows = [
        (1, 0, "Alpha-X", "very slow in winter", "is quick in every winter"), (1, 1, "alphax", "is quick in every winter", "very slow in winter"), (1, 2, "alphax", "very slow in winter", "slow in winter"),
        (1, 3, "alphax", "very slow in winter", "Beta is cheap to buy"), (1, 4, "ax", "very slow in winter", "is quick in every winter"), (1, 5, "alphax", "it is very slow in", "stands nowhere at all"), (1, 6, None, None, None),
    ]
    pairs = spark.createDataFrame(rows, "report int, pos int, subject string, a string, b string")
    assert [r.pos for r in screens.conflict_pairs(pairs, blocks).collect()] == [0]
