import pandas as pd
import pytest
from corpusloom.operators import models
from corpusloom.plans import depth
from pyspark.sql import functions as F


def test_a_reply_is_repaired_once_and_a_failing_model_degrades(spark):
    asked = []

    def model(p):
        asked.append(len(p))
        return p.map(lambda x: '{"relevance": "85"}' if models.REPAIR in x or x == "good" else "what?")

    assert models.replies(pd.Series(["good", "bad"]), model).tolist() == ['{"relevance": "85"}'] * 2 and asked == [2, 1]

    def broken(p):
        raise RuntimeError

    assert models.replies(pd.Series(["a"]), broken).tolist() == [None]
    df = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    call = models.notes(F.lit("alpha gamma"), F.col("text"))
    got = models.answered(df, call, F.col("text"), broken).orderBy("doc_id").collect()
    assert [(r.relevance, r.relevance_by) for r in got] == [(5, "stand-in"), (0, "stand-in")]


@pytest.mark.parametrize("reply, want", [('{"verdict": "Supported"}', "supported"), ('{"verdict": "unsupported", "quote": "no such words here"}', "unverifiable"), ('{"verdict": "unsupported", "quote": "the tent is green"}', "unsupported"), ("junk", "unverifiable")])
def test_verdicts_are_held_by_their_quotes(spark, reply, want):
    df = spark.createDataFrame([("a claim about 77 other things", "Look: the tent is green today.")], "claim string, text string")
    got = models.answered(df, models.verdict(F.col("claim"), F.col("text")), F.col("claim"), lambda p: p.map(lambda _: reply)).first()
    assert got.verdict == want


def test_depth_table_is_the_known_one(spark):
    df = spark.range(1, 11).select(F.col("id").cast("int").alias("depth"))
    got = [tuple(r) for r in depth.with_depth_table(df).orderBy("depth").collect()]
    assert got[0] == (1, 1, 3, 8, 28, 49, 1) and got[6] == (7, 6, 6, 54, 52, 342, 2) and got[9] == (10, 8, 7, 85, 60, 516, 2)
    rounds, kept = depth.simulated(1, 0.55)
    assert rounds == 1 and kept > 5
