"""Line deduplication, spelling variants and collocations: small cases, skew and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from corpusloom.llm import collocations, line_dedup, spelling
from corpusloom.llm.common import Scratch
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en") if len(r) == 2 else r for r in rows for i, t in [r[:2]]], DOC)


# 11 -------------------------------------------------------------------------------------------------------------------
LINE = "this line is long enough to be counted, number "


def lines_by_hand(rows, min_docs=5):
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(lower(x)) >= 40 and i is not None:
                held[lower(x)].add(i)
    out = []
    for i, t in rows:
        gone = [len(held[lower(x)]) >= min_docs and i is not None and i != max(held[lower(x)]) if len(lower(x)) >= 40 else False for x in (t or "").split("\n")]
        kept = "\n".join(x for x, g in zip((t or "").split("\n"), gone, strict=True) if not g)
        out.append((i, len(gone), sum(gone), kept))
    return sorted(out, key=str)


def deduplicated(df, **more):
    got = line_dedup.deduplicated(df, line_dedup.keep_bitmaps(df), **more)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str)


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_lines_small_cases(spark, broadcast_bytes):
    rows = [(i, f"{LINE}{i % 2}\nown {i}\n  {LINE.upper()}0\t\n{LINE}{i}") for i in range(12)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (None, f"{LINE}0\n{LINE}1"), (23, f"{LINE}0\n{LINE}0"), (3, f"{LINE}0"), (3, f"{LINE}0"), (24, "é" * 40), (25, "é" * 39)]
    rows += [(30 + k, "é" * 40 + "\nx") for k in range(3)] + [(40 + k, "É" * 40) for k in range(7)] + [(50, "a\n" * 60_000 + f"{LINE}1")]
    assert deduplicated(docs(spark, rows), broadcast_bytes=broadcast_bytes) == lines_by_hand(rows)


def test_lines_empty_table_clashing_names_and_other_keys(spark):
    df = docs(spark, [(1, "x")]).where("false")
    assert line_dedup.keep_bitmaps(df).count() == 0 and deduplicated(df) == []
    rows = [(i, f"{LINE}0\n{i}") for i in range(6)]
    clash = docs(spark, rows).select(F.format_string("k%d", "doc_id").alias("doc"), "text", F.lit(1).alias("n_lines"), F.lit(2).alias("_KEEP"), F.lit(3).alias("row"))
    got = line_dedup.deduplicated(clash, line_dedup.keep_bitmaps(clash, key="doc"), key="doc").collect()
    assert {(r.doc, r.text, r.n_lines, r.n_lines_, r.n_dropped) for r in got} == {(f"k{i}", f"{LINE}0\n{i}" if i == 5 else str(i), 1, 2, int(i < 5)) for i in range(6)}


def test_bitmaps_are_small_and_name_only_rows_that_lose_lines(spark):
    rows = [(i, "\n".join([f"{LINE}0"] * 5000 + [f"own {i}"])) for i in range(5)] + [(9, "plain")]
    got = {r.doc: (r.n_dropped, len(r.keep)) for r in line_dedup.keep_bitmaps(docs(spark, rows)).collect()}
    assert set(got) == {0, 1, 2, 3} and all(n == 5000 and size < 40 for n, size in got.values())


@pytest.mark.parametrize("seed", range(30))
def test_ranges_cut_anywhere_decide_the_same(seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(rng.choice([2, 6])), 0, -rng.randrange(12)) for _ in range(rng.randrange(1, 60))})
    rows = [(a, b, -d, s) for a, b, d in pairs for s in range(rng.randrange(1, 4))]
    held = defaultdict(set)
    for a, b, d, _ in rows:
        held[a, b].add(d)
    wanted = sorted((a, d, s) for a, b, d, s in rows if len(held[a, b]) >= 5 and d != max(held[a, b]))
    cuts = sorted(k for k in {0, len(rows), *(rng.randrange(len(rows)) for _ in range(rng.randrange(6)))} if k in (0, len(rows)) or rows[k][:3] != rows[k - 1][:3])
    made = []
    for i, j in zip(cuts, cuts[1:], strict=False):
        state = line_dedup._Range(5, pa.int64())
        at = i
        while at < j:
            to = min(j, at + rng.randrange(1, 6))
            made += state.read(pa.record_batch([pa.array([r[k] for r in rows[at:to]], pa.int64()) for k in range(4)], names=["h1", "h2", "doc", "spot"]))
            at = to
        made += state.end()
    got = pa.Table.from_batches(made).to_pylist()
    docs_of, head = Counter(), {}
    for r in got:
        if r["kind"] == line_dedup.SUMMARY:
            docs_of[r["h1"]] += r["docs"]
            head[r["h1"]] = max(r["doc"], head.get(r["h1"], -1))
    assert sum(r["kind"] == line_dedup.SUMMARY for r in got) <= 2 * (len(cuts) - 1)
    found = [(r["h1"], r["doc"], r["spot"]) for r in got if r["kind"] == line_dedup.GOES or r["kind"] == line_dedup.OPEN and docs_of[r["h1"]] >= 5 and r["doc"] != head[r["h1"]]]
    assert sorted(found) == wanted


def test_a_line_of_all_documents_is_read_in_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(LINE + "0\nown "), F.col("id").cast("string")).alias("text"))
        scratch = Scratch(spark, "t")
        gone = line_dedup.dropped_lines(df, scratch)
        assert gone.count() == 19_999 and gone.where("doc = 19999").isEmpty()
        rows = line_dedup.line_rows(df, "doc_id", "text", 40).repartitionByRange("h1", "h2", F.desc("doc"))
        assert max(r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 4000
        scratch.drop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# 12 -------------------------------------------------------------------------------------------------------------------
def groups_by_hand(rows, min_count=3):
    n = Counter()
    for i, t in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            x = re.sub("[A-Z]", lambda m: m[0].lower(), x)
            h = 1 if i is None else zlib.crc32(f"{i}:{x}".encode())
            n[x[: h % len(x)] + x[h % len(x) + 1 :] if h % 97 == 0 else x] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        found[w] = (len(others), best if best and n[best] >= 2 * n[w] else None)

    def root(w):
        return root(found[w][1]) if found[w][1] else w

    return {w: (found[w][1], root(w), n[w], found[w][0], n[found[w][1]] if found[w][1] else None) for w in n}


def spelled(df, **more):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(df, **more).collect()}


def test_spelling_equals_brute_force_on_random_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=300))) for i in range(30)]
    want = groups_by_hand(rows)
    assert spelled(docs(spark, rows)) == want and sum(v[0] is not None for v in want.values()) > 50
    assert any(v[0] and v[1] != v[0] for v in want.values())  # chains


def test_spelling_small_cases(spark):
    rows = [(None, "Letter LETTER letter letters letters lettes, 12 ligne lïgne"), (1, None), (2, ""), (3, "1 2 3"), (4, "x" * 200_000 + " Straße STRAßE straße"), (4, "x" * 200_000), (4, "x" * 200_000)]
    assert spelled(docs(spark, rows)) == groups_by_hand(rows)
    many = [(None, " ".join(["abcde"] * 8 + ["abcdx"] * 4 + ["bbcde"] * 8 + ["abcdexy"] * 3 + ["abcdex"] * 3))]  # ties: the smaller form
    got = spelled(docs(spark, many))
    assert got == groups_by_hand(many) and got["abcdx"][:2] == ("abcde", "abcde") and got["abcde"][0] is None and got["abcdexy"] == (None, "abcdexy", 3, 1, None)
    assert spelled(docs(spark, rows).where("false")) == {}
    clash = docs(spark, many).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))
    assert spelled(clash) == got


def test_roots_follow_long_chains(spark):
    rows = [("a" * (5 + k), 3 * 2**k) for k in range(12)]
    words = spark.createDataFrame(rows, "word string, n long")
    scratch = Scratch(spark, "t")
    found = scratch.written(spelling.forms(words, spelling.near_words(words)), "f")
    assert {r.root for r in spelling.roots(found, scratch).collect()} == {"a" * 16} and found.where("form is null").count() == 1
    scratch.drop()


# 13 -------------------------------------------------------------------------------------------------------------------
def phrases_by_hand(rows, min_count=30, top=2000):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    out = defaultdict(list)
    for (lang, w), a in found.items():
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        held = any(k == lang and len(v) > len(w) and 100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (k, v), b in found.items())
        if not held:
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def mined(df, **more):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **more).collect())


@pytest.mark.parametrize("bits", [16, 0])
def test_phrases_equal_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)  # with none, the filters are full and hold nothing back
    monkeypatch.setattr(collocations, "SLICE_BYTES", 2000)
    rng = random.Random(6)
    words = [*"abcdefgh", "é", "日本", "x-y", "Ab"]
    text = lambda: "".join(rng.choices(words, [1 / (k + 1) for k in range(12)])[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randrange(300)))
    rows = [(i, text() + " new york city" * rng.randrange(3), rng.choice(["en", "fr", None, "und"])) for i in range(120)]
    want = phrases_by_hand(rows)
    assert mined(spark.createDataFrame(rows, DOC)) == want and len(want) > 60
    assert mined(spark.createDataFrame(rows, DOC), top=7) == phrases_by_hand(rows, top=7)


def test_phrases_small_cases(spark):
    rows = [(0, None, "en"), (1, "", None), (2, " .,\n", "fr"), (3, "Hot DOG " * 40, "en"), (3, "Hot DOG " * 40, "en"), (4, "a b. " * 29, "de"), (5, "c d! " * 30, None), (6, "c d? " * 30, "und"), (7, "w" * 300_000, "en"), (8, "p q r s\n" * 50_000, "it")]
    got = mined(spark.createDataFrame(rows, DOC))
    assert got == phrases_by_hand(rows) and ("und", 1, "c d", 60, 60, 60, 120, 1_000_000) in got and not any(x[0] in ("de", "fr") for x in got)
    empty = spark.createDataFrame(rows, DOC).where("false")
    assert mined(empty) == []
    clash = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("z") for c in ("phrase", "size", "f", "n", "rank")})
    assert mined(clash) == got


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**15
    rows = [("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1), ("en", 0, "", 9 * 10**15), ("en", 1, "c", big), ("en", 3, "a b c", 8 * big // 10), ("en", 2, "b c", big - 2)]
    frequent = spark.createDataFrame(rows, "lang string, size int, phrase string, f long")
    found = collocations.scored(frequent)
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in found.collect()}
    assert got["a b"] == (big - 1, big, big + 1, 2000000 * (big - 1) // (2 * big + 1)) and got["a b c"][3] == min(2000000 * (8 * big // 10) // x for x in (2 * big - 2, 2 * big - 1))
    assert {r.phrase for r in collocations.without_contained(found).collect()} == {"a b c"}


def test_digest_is_of_the_kept_text(spark, sf):
    got = line_dedup.query(spark, sf).where("n_dropped > 0").limit(3).collect()
    d = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in line_dedup.deduplicated(d, line_dedup.keep_bitmaps(d)).collect()}
    assert got and all(hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == r.kept_sha256 for r in got)
