import re

from corpusloom.operators import excerpts, finding_files
from pyspark.sql import functions as F


def brute(text, keywords, window, most, budget):
    """Excerpts' spans by one loop over matches of one text."""
    hits = []
    for k, w in enumerate(keywords):
        p = excerpts.keyword_pattern(w)
        hits += [(m.start(), m.end(), k) for m in list(re.finditer(p, text))[: excerpts.HITS]] if p else []
    if not hits:
        return []
    merged = []
    for a, b, k in sorted([*hits, (0, min(excerpts.HEAD, len(text)), -1)]):
        a, b = max(0, a - max(1, window // 2)), min(len(text), b + max(1, window // 2))
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2] | {k})
        else:
            merged.append((a, b, {k}))
    out, left = [], budget
    for a, b, _ in sorted(merged, key=lambda m: -len(m[2]))[:most]:
        if b - a > left:
            out += [(a, a + left)] if left >= excerpts.SHORTEST else []
            break
        out.append((a, b))
        left -= b - a
    return sorted(out)


def test_excerpts_equal_a_loop(spark):
    filler = "lorem ipsum dolor sit amet " * 120
    texts = [None, "", "   ", "no such word", "AI at once", "maintain said chain " * 300, (filler + "the AI\n market ") * 9 + "solid \n state", filler + "é_AI AI. $/kWh C&I " + filler * 3 + "ai " * 50, "ai " * 40, "ü" * 2000 + " AI"]
    keywords = ["AI", "solid state", "$/kWh", " ", "C&I"]
    df = spark.createDataFrame([(k, t, "taken") for k, t in enumerate(texts)], "doc_id int, text string, spans string")
    for limits in ({"window": 1200, "most": 8, "budget": 12_000}, {"window": 100, "most": 3, "budget": 1700}, {"window": 1, "most": 8, "budget": 1100}):
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in excerpts.excerpts(df, keywords, **limits).collect()}
        assert got == {k: brute(t or "", keywords, **limits) for k, t in enumerate(texts)}
    assert excerpts.excerpts(df, []).where("excerpt <> ''").count() == 0 and excerpts.excerpts(df.limit(0), keywords).count() == 0
    assert excerpts.excerpts(df, ["AI"]).where("doc_id = 4").first().excerpt == "AI at once"


FINDING = "run_id string, idx int, title string, url string, domain string, published string, relevance double, source_type string, publisher string, query string, summary string, notes string, facts array<struct<claim:string,confidence:int,quote:string>>"


def test_findings_go_to_files_and_back(spark, tmp_path):
    rows = [
        ("r1", 1, "A [x] title", "https://a.org/1", "a.org", "2024-01-02", 7.5, "standard", "Maker", "q", "It is so.", "one\n\n### sub\ntwo", [("first", 9, 'she "said" so'), ("second", None, "")]),
        ("r1", 2, "B", "", "", None, 0.0, None, None, "", "", "", []),
        ("r2", 3, "C — D", "u", "d", "unknown", 3.0, None, "Maker", "q", "s", "n", None),
    ]
    df = spark.createDataFrame(rows, FINDING)
    path = f"file://{tmp_path}/findings"
    finding_files.write_files(df, path)
    got = {r.idx: r for r in finding_files.read_files(spark, path).collect()}
    assert [tuple(f) for f in got[1].facts] == rows[0][12] and got[1].notes == rows[0][11] and got[1].title == "A [x] title" and got[1].run_id == "r1"
    assert (got[1].relevance, got[1].source_type, got[1].publisher, got[1].summary) == (7.5, "standard", "Maker", "It is so.")
    assert got[2].published is None and got[2].url == "" and got[2].facts == [] and got[2].source_type is None
    assert got[3].published is None and got[3].publisher == "Maker" and got[3].source_type is None
    finding_files.write_files(df.where("run_id = 'r2'").withColumn("title", F.lit("new")), path)
    assert {r.title for r in finding_files.read_files(spark, path).collect()} == {"A [x] title", "B", "new"}
    junk = spark.createDataFrame([("no finding",), (None,), ("# [7] T\n\n- **Relevance:** high/10\n",)], "text string")
    assert [(r.idx, r.relevance) for r in finding_files.parsed(junk).collect()] == [(7, 0.0)]


def test_surest_facts_first(spark):
    df = spark.createDataFrame([([("a", 2, "q"), ("b", 9, ""), ("", 10, ""), ("c", None, "")],)], f"f array<{finding_files.FACT}>")
    assert df.select(finding_files.render_facts(F.col("f"), 2, by_confidence=True, quotes=False)).first()[0] == "- b (confidence 9/10)"
    assert df.select(finding_files.render_facts(F.col("f"))).first()[0] == '- a (confidence 2/10)\n  > "q"\n- b (confidence 9/10)\n- c'
