import pytest
from corpusloom.operators import reports
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "reply, wanted",
    [
        ('```json\n{"a": 1,}\n```', '{"a": 1}'),
        ('<think>{"no": 1}</think> so: [1, {"b": "}"}] end', '[1, {"b": "}"}]'),
        ('{"a": [1, 2', '{"a": [1, 2]}'),
        ('{"a": 1, "b": "cut off he', '{"a": 1, "b": "cut off he"}'),
        ('{"a": 1, "b', '{"a": 1}'),
        ("nothing", None),
        (None, None),
    ],
)
def test_tolerant_json(reply, wanted):
    assert reports.tolerant_json(reply) == wanted


def test_facet_needs_two_shared_words_and_first_wins(spark):
    q = spark.createDataFrame([(1, "US youth soccer field dimensions"), (2, "soccer"), (3, "pricing comparison of platforms"), (4, None)], "id long, query string")
    f = spark.createDataFrame([("field dimension standards", 0), ("comparing platform prices", 1), ("platforms comparison", 2)], "facet string, facet_order int")
    assert dict(reports.facet_of_query(q, f).collect()) == {1: "field dimension standards", 2: None, 3: "comparing platform prices", 4: None}


def test_rerank_is_all_or_nothing(spark):
    rows = [("a", 0, 0.1), ("a", 1, 0.9), ("b", 0, 0.1), ("b", 1, None)]
    got = {(r.q, r["rank"]): r.place for r in reports.reranked(spark.createDataFrame(rows, "q string, rank long, second double")).collect()}
    assert got == {("a", 0): 2, ("a", 1): 1, ("b", 0): 1, ("b", 1): 2}


def test_evidence_lines_fold_and_cap(spark):
    rows = [("t", 1, 0, "One line."), ("t", 1, 1, "one LINE"), ("t", 1, 2, "b"), ("t", 1, 3, "c"), ("t", 1, 4, "d"), ("t", 2, 0, "one line!")]
    got = reports.evidence_lines(spark.createDataFrame(rows, "topic string, source long, pos long, line string")).collect()
    assert sorted((r.source, r.pos) for r in got) == [(1, 0), (1, 2), (1, 3)]


def test_repeats_are_across_sections(spark):
    a = "quantum widgets reduce overall shipping latency across northern regional warehouses"
    rows = [(1, 0, 0, a), (1, 0, 1, a), (1, 1, 2, a + " lately"), (2, 1, 3, a)]
    got = reports.repeats(spark.createDataFrame(rows, "report long, section long, pos long, text string")).collect()
    assert sorted((r.report, r.pos, r.earlier) for r in got) == [(1, 2, 0), (1, 2, 1)]


def test_kinds_drop_singletons_unless_all_are(spark):
    rows = [(1, "red cars", 2), (1, "blue car", 3), (1, "boat", 9), (2, "plane", 1)]
    got = reports.kinds_by_head(spark.createDataFrame(rows, "report long, name string, sources long")).collect()
    assert sorted((r.report, r.label, r.n) for r in got) == [(1, "blue car", 2), (2, "plane", 1)]


def test_listed_asks_need_two_items(spark):
    df = spark.createDataFrame([(1, "Tell me:\n- first thing\n2. second thing"), (2, "- only one"), (3, None)], "id long, q string")
    assert [(r.id, r.pos, r.item) for r in reports.listed_asks(df, "id", "q").orderBy("pos").collect()] == [(1, 0, "first thing"), (1, 1, "second thing")]


def test_facet_name_cuts_at_a_word(spark):
    long = "Word_" * 40
    assert spark.range(1).select(reports.facet_name(F.lit(long))).first()[0] == " ".join(["word"] * 22)
