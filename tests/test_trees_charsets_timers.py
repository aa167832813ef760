"""Comment trees, the charset ladder, idle timers and approximate near-duplicates."""

import random
from datetime import datetime, timedelta

import pytest
from corpusloom.functions import charsets
from corpusloom.operators import dedup, minhash, threads
from corpusloom.streaming import idle
from pyspark.sql import functions as F

COMMENT = "thread long, id string, parent string, ord long, kind string, body string, score int"


def walk(rows, parent, depth, out, most):
    for r in sorted((r for r in rows if r[2] == parent), key=lambda r: (r[3], r[1])):
        if len(out) >= most:
            return
        if r[4] != "t1":
            continue
        body = (r[5] or "").strip()
        if body and body not in ("[deleted]", "[removed]"):
            out.append(f"{'  ' * depth}[{r[6] or 0:+d}] {body}")
        walk(rows, r[1], depth + 1, out, most)


@pytest.mark.parametrize("most", [3, 80])
def test_threads_read_like_a_walk_of_the_tree(spark, most):
    rng = random.Random(most)
    rows = []
    for t in range(4):
        for k in range(120):
            parent = None if k == 0 or rng.random() < 0.1 else f"c{rng.randrange(k)}"
            rows.append((t, f"c{k}", parent, rng.randrange(5), rng.choice(["t1"] * 9 + ["more"]), rng.choice(["text", " padded\n", "[deleted]", "[removed]", "", None, "two\nlines"]), rng.choice([None, -3, 0, 12])))
    got = {r.thread: r.text for r in threads.as_text(threads.shown(spark.createDataFrame(rows, COMMENT), most)).collect()}
    for t in range(4):
        out = []
        walk([r for r in rows if r[0] == t], None, 0, out, most)
        assert got[t] == "\n".join(out)


def test_threads_of_great_depth_and_rows_without_a_root(spark):
    rows = [(1, str(k), str(k - 1) if k else None, 0, "t1", f"b{k}", 1) for k in range(700)]
    rows += [(2, "a", "b", 0, "t1", "x", 1), (2, "b", "a", 0, "t1", "y", 1), (2, "c", "gone", 0, "t1", "z", 1), (2, "r", None, 0, "t1", "root", 5)]
    got = threads.shown(spark.createDataFrame(rows, COMMENT), 1000).collect()
    assert {(r.id, r.depth) for r in got if r.thread == 1} == {(str(k), k) for k in range(700)} and [r.line for r in got if r.thread == 2] == ["[+5] root"]
    assert threads.shown(spark.createDataFrame(rows, COMMENT).where("false")).count() == 0


# ----------------------------------------------------------------------------------------------------------------------
TEXT = "Torque the plug to 13 ft·lb at 20°C — the “factory” spec, says René."
PAGE = f"<html><head><title>T</title></head><body><p>{TEXT}</p></body></html>"


def test_every_rung_of_the_ladder(spark):
    meta = PAGE.replace("<head>", '<head><meta http-equiv="x" content="text/html; charset=windows-1252">')
    far = "x" * 5000 + meta
    cases = [
        (PAGE.encode(), None, PAGE), (PAGE.encode(), "shift_jis", PAGE), ((PAGE + "°").encode()[:-1], None, PAGE), ((PAGE + "😀").encode()[:-1], None, PAGE), ((PAGE + "😀").encode()[:-3], "koi8-r", PAGE),
        (PAGE.encode("cp1252"), "windows-1252", PAGE), (PAGE.encode("cp1252"), "ISO_8859-1", PAGE), (meta.encode("cp1252"), None, meta), (PAGE.encode("cp1252"), None, PAGE), (far.encode("cp1252"), "", far),
        ("Привет, мир".encode("koi8-r"), "KOI8-R", "Привет, мир"), ("日本語のページ".encode("shift_jis"), "Shift_JIS", "日本語のページ"), ("<meta charset='koi8-r'>Привет".encode("koi8-r"), "no-such", "<meta charset='koi8-r'>Привет"),
        ("日本".encode("utf-16"), "utf-16", "日本"), ("é".encode("latin-1") + b"abcd", "hex", "éabcd"), (b"\x81abc\xff", None, "�abc�"), (b"", None, ""), (b"\xff", "utf-8", ""), (b"\xffabc", "utf-8", "ÿabc"), (None, "utf-8", None),
    ]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b), c) for k, (b, c, _) in enumerate(cases)], "k int, body binary, charset string")
    got = {r.k: r.text for r in df.select("k", charsets.decoded(F.col("body"), F.col("charset")).alias("text")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}


# ----------------------------------------------------------------------------------------------------------------------
START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def spells(spark, calls, seconds=900):
    df = spark.createDataFrame([(m, at(a), None if b is None else at(b)) for m, a, b in calls], "model string, start timestamp, end timestamp")
    return sorted(((r.since - START).seconds // 60, (r.at - START).seconds // 60) for r in idle.idle_spells(df, seconds).collect())


def test_idle_after_the_last_of_overlapping_calls(spark):
    assert spells(spark, [("a", 0, 5), ("a", 1, 30), ("a", 10, 12)]) == [(30, 45)]
    assert spells(spark, [("a", 0, 5), ("a", 20, 21), ("a", 35, 36)]) == [(5, 20), (36, 51)]  # 14 minutes are too few
    assert spells(spark, [("a", 0, 5), ("a", 2, None), ("a", 90, 91)]) == []  # one is in flight for good
    assert spells(spark, [("a", 0, -3)]) == [(0, 15)]


def test_a_timer_fires_without_calls_and_not_while_one_is_active(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "model string, at timestamp, step int"
    q = None

    def send(k, *rows):
        spark.createDataFrame([(m, at(t), s) for m, t, s in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
        q.processAllAvailable()
        return sorted((r.model, (r.since - START).seconds // 60, (r.at - START).seconds // 60) for r in spark.sql("select * from idle_out").collect())

    folder.mkdir()
    stream = idle.idle_stream(spark.readStream.schema(schema).parquet(str(folder)), 900, "1 minute")
    q = stream.writeStream.format("memory").queryName("idle_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        assert send(0, ("a", 0, 1), ("a", 2, -1), ("b", 0, 1)) == []
        assert send(1, ("c", 10, 1)) == []  # too early for a
        assert send(2, ("c", 40, -1)) == [("a", 2, 17)]  # a's timer fires without a call of a; b is still in flight
        assert send(3, ("b", 41, -1), ("c", 42, 1)) == [("a", 2, 17)]
        assert send(4, ("a", 100, 1)) == [("a", 2, 17), ("b", 41, 56)]  # c is in flight again, a only now
        assert send(5, ("a", 101, -1), ("a", 130, 1), ("a", 131, -1), ("c", 131, -1)) == [("a", 2, 17), ("a", 101, 116), ("b", 41, 56)]
    finally:
        q.stop()


# ----------------------------------------------------------------------------------------------------------------------
def groups(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_minhash_finds_nine_of_ten_exact_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    exact = [(r.a, r.b, r.containment) for r in dedup.near_pairs(docs).collect()]
    found = [(r.a, r.b, r.containment) for r in minhash.near_links(docs).collect()]
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    mine, theirs = groups(ids, [x[:2] for x in found]), groups(ids, [x[:2] for x in exact])
    recall = sum(mine[a] == mine[b] for a, b, _ in exact) / len(exact)
    true = {x[:2] for x in exact}
    print(f"recall {recall:.4f} of {len(exact)} pairs; {len(found)} links")
    assert recall >= 0.9 and sum(theirs[a] == theirs[b] for a, b, _ in found) / len(found) >= 0.95 and true


def test_minhash_small_cases_and_growth(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (4, None), (5, ""), (6, "one"), (7, "one"), (None, text), (8, "other words entirely")], "doc_id long, text string")
    got = {(r.a, r.b) for r in minhash.near_links(df).collect()}
    assert {(1, 2), (1, 3), (6, 7)} <= got and {x for p in got for x in p} == {1, 2, 3, 6, 7}
    assert minhash.near_links(df.where("false")).count() == 0
    template = [f"t{k}" for k in range(100)]
    found = []
    for n in (200, 400):
        texts = [(k, " ".join([*template[:50], f"own{k}", *template[50:]])) for k in range(n)]
        links = minhash.near_links(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        found.append(len(links))
        assert set(groups(range(n), [(r.a, r.b) for r in links]).values()) == {0}
    assert found[1] <= 2.5 * found[0] < 200 * 199 / 10
