"""Which sentences are cited anew or rewritten, and which replies of a model are refused."""

from corpusloom.operators import source_checks as cc
from corpusloom.operators.figures import claim_tokens
from pyspark.sql import functions as F

SOURCES = {1: "The old card has 12 GB and draws 1,200 W in v1.2.3.", 2: "Qwen-3.8 Flash runs in 12GB at 24.00 tok/s, 53.2% of it.", 3: "12B-15B parameters, 12 days; 125.7 GB; 3 – 12 GB."}


def decide(spark, sentence, action, cite=None, revised=None, allowed=(1, 2, 3), question=""):
    schema = "s string, reply struct<action:string,cite:array<string>,revised:string,reason:string>, sources map<int,string>, q string"
    df = spark.createDataFrame([(sentence, (action, cite, revised, None), SOURCES, question)], schema)
    known = F.transform_values("sources", lambda k, v: cc.evidence(v))
    r = df.select(cc.decision(F.col("s"), cc.read_reply(F.col("reply")), F.array(*[F.lit(a) for a in allowed]), known, cc.evidence(F.col("q"))).alias("x")).first().x
    return r.outcome, r.text


def test_citations_move_to_sources_that_state_every_figure(spark):
    s = "It needs 24 tok/s and 1200 W [1]."
    assert decide(spark, s, "keep") == ("kept", s) and decide(spark, s, "nonsense") == ("kept", s) and decide(spark, s, None) == ("kept", s)
    assert decide(spark, s, "recite", ["[2]"]) == ("recited", "It needs 24 tok/s and 1200 W [2][1].")  # alone it lacks the watts
    assert decide(spark, "It runs at 24 tok/s [1].", " RECITE", ["2"]) == ("recited", "It runs at 24 tok/s [2].")
    assert decide(spark, s, "recite", ["3"]) == ("rejected", s) and decide(spark, s, "recite", ["7"]) == ("rejected", s) and decide(spark, s, "recite", ["1"]) == ("kept", s)
    assert decide(spark, "It runs at 24 tok/s [1].", "recite", ["2"], allowed=(1,))[0] == "rejected"
    assert decide(spark, "Of 777 it runs 24 tok/s [1].", "recite", ["2"])[0] == "rejected" and decide(spark, "Of 777 it runs 24 tok/s [1].", "recite", ["2"], question="I have 777")[0] == "recited"


def test_rewritten_sentences_need_their_units(spark):
    s = "- **Memory:** it takes 99GB [1]."
    assert decide(spark, s, "rewrite", revised="It takes  12GB [2].") == ("rewritten", "- **Memory:** It takes 12GB [2].")
    assert decide(spark, s, "rewrite", revised="It takes 12GB, a range [3].")[0] == "rewritten"  # the end of "3 – 12 GB"
    assert decide(spark, s, "rewrite", revised="It takes 15GB of it [3].")[0] == "rejected"  # 15B parameters are no memory
    assert decide(spark, s, "rewrite", revised="It takes 126GB of it [3].") == ("rejected", s)  # a rounding has no unit there
    for bad in ("", s):
        assert decide(spark, s, "rewrite", revised=bad)[0] == "kept"
    for bad in ("12GB [2].", "It takes 12GB now.", "It takes 12GB [9].", "It takes 12GB " + "so " * 20 + "[2]."):
        assert decide(spark, s, "rewrite", revised=bad) == ("rejected", s)


def test_what_a_source_has_and_states(spark):
    cases = [("1.2.3", 1, True, True), ("1200W", 1, True, True), ("12days", 3, True, True), ("12days", 1, True, False), ("125GB", 3, True, False), ("53.2%", 2, True, True), ("Qwen3.8", 2, True, True), ("Qwen9.9", 2, False, False), ("24.0tok/s", 2, True, True)]
    for text, source, has, states in cases:
        df = spark.createDataFrame([(text, SOURCES[source])], "t string, s string").select(F.get(claim_tokens(F.col("t")), F.lit(0)).alias("t"), cc.evidence(F.col("s")).alias("s"))
        r = df.select(cc.has(F.col("s"), F.col("t")).alias("h"), cc.states(F.col("s"), F.col("t")).alias("s")).first()
        assert (r.h, r.s) == (has, states), text


def test_a_report_is_corrected_in_one_pass(spark):
    reports = spark.createDataFrame([(1, "One [1]. Two [2]. Three."), (2, "same"), (3, None)], "id int, md string")
    decided = spark.createDataFrame([(1, 9, 17, "rewritten", "2nd [3]."), (1, 0, 8, "recited", "One [4]."), (1, 18, 24, "rejected", "x"), (2, 0, 4, "kept", "y")], "id int, start int, end int, outcome string, text string")
    got = {r.id: (r.md, r.kept, r.recited, r.rewritten, r.rejected) for r in cc.corrected(reports, decided, "id").collect()}
    assert got == {1: ("One [4]. 2nd [3]. Three.", 0, 1, 1, 1), 2: ("same", 1, 0, 0, 0), 3: (None, 0, 0, 0, 0)}
