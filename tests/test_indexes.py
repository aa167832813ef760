"""The posting and vector indexes: brute force, plans, and files of other runs when one is replaced."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from corpusloom.operators import postings, run_index
from pyspark.sql import functions as F

ROW = "run_id string, doc long, kind string, title string, body string"
TEXTS = ["The cat sat on the mat.", "A dog; a cat!", None, "", "cat cat cat " + "x " * 40 + "dog", "Öl und Cat-Food für den Hund", "cat dog " * 30]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(f"r {k % 3}/ü", k, "finding", "Cat book" if k == 3 else None, t) for k, t in enumerate(TEXTS)], ROW)


def files(path, run=None):
    from pathlib import Path

    return {(str(p), p.stat().st_mtime_ns) for p in Path(path.removeprefix("file://")).rglob("*.parquet") if run is None or f"run_id={run}" in str(p)}


def by_hand(rows, queries, limit):
    tokens = {r.doc: re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), f"{r.title or ''} {r.body or ''}")) for r in rows}
    tf = {d: Counter(w) for d, w in tokens.items()}
    df = Counter(w for c in tf.values() for w in c)
    n, avg = len(rows), sum(map(len, tokens.values())) / len(rows)
    run, out = {r.doc: r.run_id for r in rows}, []
    for q, text in queries:
        words = set(re.findall("[a-z0-9]+", (text or "").lower()))
        hits = []
        for d, c in tf.items():
            if words and all(c[w] for w in words):
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(tokens[d]) / avg)) for w in words)
                hits.append((-round(s, 6), run[d], d))
        out += [(q, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(hits)[:limit])]
    return out


def test_search_equals_brute_force(spark, rows, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i")
    index.write(rows)
    asked = [(1, "cat"), (2, "Cat dog"), (3, "cat unknown"), (4, ""), (5, None), (6, "dog's cat"), (7, "cat-food"), (8, "cat CAT dog")]
    queries = spark.createDataFrame(asked, "q long, text string")
    got = sorted((r.q, r["rank"], r.doc, r.score) for r in index.search(queries, 3).collect())
    assert got == sorted(by_hand(rows.collect(), asked, 3)) and {x[0] for x in got} == {1, 2, 7, 8}


def test_search_reads_only_the_words_that_were_asked(spark, rows, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i")
    index.write(rows)
    found = index.search(spark.createDataFrame([(1, "cat dog")], "q long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [cat,dog])" in plan and "body" not in plan and "Python" not in plan and "Arrow" not in plan


def test_many_words_are_joined_instead(spark, rows, tmp_path, monkeypatch):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i")
    index.write(rows)
    queries = spark.createDataFrame([(1, "cat dog"), (2, "mat the")], "q long, text string")
    want = sorted(map(str, index.search(queries).collect()))
    monkeypatch.setattr(postings, "PUSHED", 2)
    assert sorted(map(str, index.search(queries).collect())) == want and len(want) == 4


def test_a_run_is_replaced_added_to_and_deleted_alone(spark, rows, tmp_path):
    path = f"file://{tmp_path}/i"
    index = postings.PostingIndex(spark, path)
    index.write(rows)
    first = files(path)
    index.write(spark.createDataFrame([("r 1/ü", 99, "finding", None, "new words")], ROW))
    kept = {f for f in first if "r 1" not in f[0]}
    assert kept and kept <= files(path) and not (first - kept) & files(path)
    assert {r.doc for r in index.docs().collect()} == {0, 2, 3, 5, 6, 99}
    assert {r.term for r in index.postings().where("doc = 99").collect()} == {"new", "words"}
    index.write(spark.createDataFrame([("r 1/ü", 100, "finding", None, "more")], ROW), replace=False)
    assert {99, 100} <= {r.doc for r in index.docs().collect()}
    index.delete(["r 1/ü", "none"])
    assert {r.run_id for r in index.postings().collect()} == {"r 0/ü", "r 2/ü"} and kept <= files(path)


def snippet_by_hand(text, words):
    spans = [m.span() for m in re.finditer("[A-Za-z0-9]+", text)]
    token = [text[a:b].lower() for a, b in spans]
    best = max(range(max(1, len(token) - 15)), key=lambda s: (len(set(token[s : s + 16]) & words), -s))
    out = " … " if best else ""
    at = spans[best][0] if best else 0
    for (a, b), t in list(zip(spans, token, strict=True))[best : best + 16]:
        out += text[at:a] + (f"\x02{text[a:b]}\x03" if t in words else text[a:b])
        at = b
    return out + (" … " if best + 16 < len(token) else text[at:])


def test_snippets(spark, rows, tmp_path):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i")
    index.write(rows)
    queries = spark.createDataFrame([(1, "cat dog"), (2, "cat"), (3, "hund öl")], "q long, text string")
    got = {(r.q, r.doc): r.snip for r in index.snippets(index.search(queries), queries).collect()}
    assert got[1, 4] == "\x02cat\x03 " * 3 + "x " * 12 + "x … " and got[2, 3] == "" and got[1, 1] == "A \x02dog\x03; a \x02cat\x03!"
    assert got[2, 0] == "The \x02cat\x03 sat on the mat." and got[3, 5].count("\x02") == 2
    for (q, doc), snip in got.items():
        words = {1: {"cat", "dog"}, 2: {"cat"}, 3: {"hund", "l"}}[q]
        if TEXTS[doc]:
            hits = [m.start() for m in re.finditer("[A-Za-z0-9]+", TEXTS[doc])]
            assert snip.replace("\x02", "").replace("\x03", "").replace(" … ", "") in TEXTS[doc] and len(re.findall("[A-Za-z0-9]+", snip)) == min(16, len(hits))
            assert len(set(re.findall("\x02([^\x03]*)", snip.lower())) & words) == len(set(re.findall("\x02([^\x03]*)", snippet_by_hand(TEXTS[doc], words).lower())) & words)


# ----------------------------------------------------------------------------------------------------------------------
def test_bags_of_words_are_unit_vectors_and_the_same_everywhere():
    v = run_index.bag_of_words(["a b", "b  A", "", "!?"])
    assert v.shape == (4, 64) and (v[0] == v[1]).all() and not v[2:].any() and abs(np.linalg.norm(v[0]) - 1) < 1e-5


def test_models_see_bounded_batches_and_must_answer_all(spark):
    df = spark.createDataFrame([(k, None if k == 3 else "t" * k) for k in range(70)], "id long, text string").coalesce(1)

    def model(texts):
        assert len(texts) <= 32
        return np.array([[len(t), 1.0] for t in texts])

    got = {r.id: r.vector for r in run_index.embedded(df, model=model).collect()}
    assert got[5] == [5.0, 1.0] and got[3] == [0.0, 1.0] and len(got) == 70
    with pytest.raises(Exception, match="returned 1 vectors for"):
        run_index.embedded(df, model=lambda texts: np.zeros((1, 2))).collect()
    assert run_index.embedded(df.where("false")).count() == 0


def test_runs_are_indexed_replaced_and_deleted_alone(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    index = run_index.RunIndex(spark, path)
    ov = spark.createDataFrame([(f"r{k}", "T", f"# Head\n\ncommon words number {k}\n\n## Next\n\nmore") for k in range(3)], "run_id string, title string, text string")
    fs = spark.createDataFrame([(f"r{k}", i, "F", "para\n\n" + "long " * 600) for k in range(3) for i in (1, 12)] + [("r0", 3, None, None)], "run_id string, idx int, title string, text string")
    index.index(ov, fs)
    ids = {r.id for r in index.chunks().collect()}
    assert {"r0:ov:0", "r0:ov:1", "r1:f12:0", "r1:f12:2"} <= ids and not any(":f3:" in i for i in ids)
    first = files(path)
    index.index(ov.where("run_id = 'r1'"), fs.where("false"))
    assert {r.id for r in index.chunks().where("run_id = 'r1'").collect()} == {"r1:ov:0", "r1:ov:1"}
    assert {f for f in first if "run_id=r1" not in f[0]} == {f for f in files(path) if "run_id=r1" not in f[0]}
    links = {(r.run_id, r.other): r.score for r in index.similar_runs().collect()}
    assert set(links) == {(a, b) for a in ("r0", "r1", "r2") for b in ("r0", "r1", "r2") if a != b} and all(0.55 <= s <= 1 for s in links.values())
    assert index.similar_runs(most=1).count() == 3 and index.similar_runs(floor=1.01).count() == 0
    index.delete(["r2"])
    assert {r.run_id for r in index.chunks().collect()} == {"r0", "r1"}


def test_question_of_head_words(spark):
    df = spark.createDataFrame([("The the cat, SAT on",), (None,), ("é",)], "text string")
    assert [r.q for r in df.select(postings.head_words(F.col("text")).alias("q")).collect()] == ["the cat sat", "", ""]


def test_many_questions_are_met_by_arrays(spark, rows, tmp_path, monkeypatch):
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i")
    index.write(rows)
    asked = [(1, "cat"), (2, "Cat dog"), (3, "cat unknown"), (4, ""), (5, None), (6, "dog's cat"), (7, "cat-food"), (8, "cat CAT dog"), (9, "dog cat")]
    queries = spark.createDataFrame(asked, "q long, text string")
    monkeypatch.setattr(postings, "FEW", 0)
    monkeypatch.setattr(postings, "HELD", 3)  # a document or two at a time
    for sets in (postings.SETS, 1):
        monkeypatch.setattr(postings, "SETS", sets)
        for limit in (1, 3, 20):
            got = sorted((r.q, r["rank"], r.doc, r.score) for r in index.search(queries, limit).collect())
            assert got == sorted(by_hand(rows.collect(), asked, limit)) and {x[0] for x in got} == {1, 2, 7, 8, 9}


def test_pairs_of_questions_and_documents_are_never_rows(spark, tmp_path):
    """100 questions that 200 documents answer: joined as rows they are 20,000, of which each task gives back the best."""
    index = postings.PostingIndex(spark, f"file://{tmp_path}/i")
    rows = [(f"r{k % 2}", k, "finding", None, f"common w{k % 100} " + "pad " * (k % 7)) for k in range(200)]
    index.write(spark.createDataFrame(rows, ROW))
    asked = [(k, f"common w{k}") for k in range(100)] + [(200, "common")]
    found = index.search(spark.createDataFrame(asked, "q long, text string"), 3)
    assert "Arrow" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.q, r["rank"], r.doc, r.score) for r in found.collect()) == sorted(by_hand(index.docs().collect(), asked, 3))


def test_postings_leave_a_task_in_large_batches():
    """Every document was a batch of its own; now documents share batches of about BATCH rows."""
    import pyarrow as pa

    n = 500
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None, "Cat"] * (n // 2)), pa.array([f"cat Öl w{k}" for k in range(n)]), pa.array(["r"] * n)], names=["doc", "title", "body", "run_id"])
    made = list(postings._terms(iter([b])))
    assert len(made) == 1 and made[0].schema.names == ["term", "doc", "tf", "run_id"]
    rows = {(r["doc"], r["term"]): r["tf"] for r in made[0].to_pylist()}
    assert len(rows) == 3 * n and rows[1, "cat"] == 2 and rows[2, "cat"] == 1 and rows[7, "w7"] == 1 and rows[7, "l"] == 1


def test_postings_leave_a_task_in_the_order_of_their_table(monkeypatch):
    """They left it text by text, and the sort before the writing compared whole rows."""
    import pyarrow as pa

    docs = [(k * 7 % 40, "Same", f"w{k % 9} öl a{k} same" if k % 5 else None, f"r{k % 3}" if k % 4 else None) for k in range(40)]
    docs.append((None, None, "w1", "r1"))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("doc", "title", "body", "run_id"), r, strict=True)) for r in docs[i : i + 13]], pa.schema([("doc", pa.int64()), ("title", pa.string()), ("body", pa.string()), ("run_id", pa.string())])) for i in range(0, 41, 13)]
    want = Counter((r or "", w, -1 if d is None else d) for d, t, b, r in docs for w in re.findall("[a-z0-9]+", f"{t or ''} {b or ''}".lower()))
    for many, runs in ((10**6, 1), (30, 5)):
        monkeypatch.setattr(postings, "SORTED", many)
        made = [[(r["run_id"] or "", r["term"], -1 if r["doc"] is None else r["doc"], r["tf"]) for r in b.to_pylist()] for b in postings._terms(iter(batches))]
        assert len(made) == runs or runs > 1 < len(made)
        assert all(b == sorted(b) for b in made) and {r[:3]: r[3] for b in made for r in b} == dict(want)


def test_embedded_rows_are_whole_and_words_count_as_often_as_they_stand(spark):
    df = spark.range(200).select("id", F.lit("a b").alias("text")).coalesce(1)
    assert run_index.embedded(df, batch=32).where("size(vector) = 64").select("id").distinct().count() == 200
    v = run_index.bag_of_words(["a a b"]) * math.sqrt(5)
    assert sorted(abs(v[v != 0]).round(9)) == [1, 2]
