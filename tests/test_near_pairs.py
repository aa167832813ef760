"""Near-duplicates by containment: brute force, and what is written and dealt on the way."""

import random
import re

import pytest
from corpusloom.functions import shingling
from corpusloom.operators import dedup, minhash
from pyspark.sql import functions as F


def sets(texts):
    words = {k: re.findall("[a-z0-9]+", (t or "").lower()) for k, t in texts}
    return {k: {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))} for k, w in words.items() if w}


def by_hand(texts):
    first, out = {}, set()
    for k, s in sorted(sets(texts).items()):
        out |= {(first[frozenset(s)], k, 1.0)} if frozenset(s) in first else {(j, k, round(len(s & set(o)) / min(len(s), len(o)), 4)) for o, j in first.items() if len(s & set(o)) / min(len(s), len(o)) >= 0.7}
        first.setdefault(frozenset(s), k)
    return out


def texts(n, seed=5):
    """Texts that are copies, cut, joined or changed here and there, with a passage that many share."""
    r = random.Random(seed)
    made = ["", None, "ÄÖ ... !", "one", "One.", "a b c", "A-b C", "a b c d e f g h", "İstanbul a b c d e f g h", "x " * 30, "x " * 31]
    base = [[f"w{r.randrange(400)}" for _ in range(r.choice([9, 20, 60, 150]))] for _ in range(n // 6)]
    passage = [f"p{k}" for k in range(14)]
    while len(made) < n:
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = f"n{r.randrange(9)}"
        w = w[: r.choice([len(w), len(w), len(w) // 2])] + r.choice([[], [], passage, r.choice(base)])
        made.append(" ".join(w).upper() if r.random() < 0.2 else ", ".join(w))
    return list(enumerate(made))


def test_near_pairs_equal_brute_force(spark):
    rows = texts(260)
    want = by_hand(rows)
    got = [tuple(r) for r in dedup.near_pairs(spark.createDataFrame([*rows, (None, "one")], "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200 and len({c for *_, c in want}) > 20


def test_keep_first_compares_copies_with_all_that_are_kept(spark):
    """A copy of a text that went because of a kept one was kept: it had been held against its first document alone."""
    made = [t for _, t in texts(160, seed=3)]
    rows = list(enumerate(made + made[::2]))
    want, kept, of = {}, [], sets(rows)
    for k, _ in rows:
        s = of.get(k)
        want[k] = s is None or not any(len(s & o) / min(len(s), len(o)) >= 0.7 for o in kept)
        kept += [s] * (s is not None and want[k])
    assert sum(not want[k] for k in range(0, 160, 2)) > 20 and sum(want.values()) > 40
    assert dict(dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want
    base = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(0, base), (1, base + " tail"), (2, base + " tail"), (3, base + " TAIL"), (4, None)], "doc_id long, text string")
    assert dict(dedup.keep_first(docs).collect()) == {0: True, 1: False, 2: False, 3: False, 4: True}


def test_shingles_of_one_document_alone_are_dealt_once_and_never_written(spark, monkeypatch):
    """All sets were written twice, and each of their shingles was dealt three times; now only what several hold goes on."""
    rows = [(k, " ".join(f"d{k}x{j}" for j in range(100))) for k in range(30)] + [(30, " ".join(f"d0x{j}" for j in range(90)))]
    put, written = [], dedup.Scratch.written

    def seen(self, df, what):
        made = written(self, df, what)
        put.append((what, sum(made.agg(F.sum(F.size(c))).first()[0] or 0 for c, kind in made.dtypes if kind.startswith("array"))))
        return made

    monkeypatch.setattr(dedup.Scratch, "written", seen)
    assert [tuple(r) for r in dedup.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [(0, 30, 1.0)]
    assert sum(n for _, n in put) == 2 * 83


@pytest.mark.parametrize("block", [3, 500])
def test_pairs_are_counted_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    rows = texts(200, seed=9)
    got = [tuple(r) for r in dedup.near_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows)


def test_a_set_travels_once_a_block_and_not_once_a_pair(spark, monkeypatch):
    """40 texts of one template are 780 pairs; each carried a whole set."""
    rows = [(k, " ".join([f"t{j}" for j in range(60)] + [f"own{k}"])) for k in range(40)]
    carried, counted = spark.sparkContext.accumulator(0), dedup._counted

    def counting(batches):
        for b in batches:
            carried.add(len(b.column("s").drop_null()))
            yield from counted(iter([b]))

    monkeypatch.setattr(dedup, "_counted", counting)
    made = dedup.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(made) == 780 and {r.containment for r in made} == {round(53 / 54, 4)} and carried.value == 40


@pytest.mark.parametrize("at_once", [1, 60, 10**6])
def test_sets_of_slices_are_those_of_texts(spark, monkeypatch, at_once):
    import pyarrow as pa

    rows = texts(120)
    size = dict(spark.createDataFrame(rows, "k long, text string").select("k", F.size(dedup.shingles(F.col("text")))).collect())
    found, known = {}, {}
    for at, some in shingling.slices(pa.array([(t or "").lower() for _, t in rows]), at_once):
        values, ends = shingling.shingle_sets(some, 8)
        for k, (i, j) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            found[at + k] = frozenset(values[i:j].tolist())
    of = sets(rows)
    assert {k: len(s) for k, s in found.items()} == size == {k: len(of.get(k, ())) for k, _ in rows}
    for k, s in found.items():
        assert known.setdefault(s, frozenset(of.get(k, ()))) == frozenset(of.get(k, ()))


def test_minhash_carries_signatures_of_those_that_met(spark, monkeypatch):
    """Signatures had 8 bytes a minimum, every round joined those of all documents, and all buckets were written."""
    rows = [(k, " ".join(f"d{k}x{j}" for j in range(50))) for k in range(30)] + [(30, " ".join([*(f"d0x{j}" for j in range(50)), "more"])), (31, "..."), (None, "one")]
    put, written = {}, minhash.written

    def seen(df, what):
        made = written(df, what)
        put.setdefault(what, []).append(made.count())
        return made

    monkeypatch.setattr(minhash, "written", seen)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.a, r.b) for r in minhash.near_links(docs).collect()] == [(0, 30)]
    assert put["met-signatures"] == [2] and sum(put["asked"]) <= 64 and "buckets" not in put
    assert dict(minhash.signatures(docs).dtypes)["sig"] == "array<int>" and minhash.signatures(docs).count() == 31


@pytest.mark.parametrize(("bands", "rows", "block"), [(64, 2, 2000), (4, 1, 2000), (4, 1, 7), (3, 2, 2)])
def test_minhash_compares_all_that_share_a_band(spark, monkeypatch, bands, rows, block):
    """Of a bucket, what was unlike the centres of four rounds was linked to nothing, nor a near one of a centre to the rest."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(40))
    families = [[f"f{f}x{k}" for k in range(60)] for f in range(24)]
    made = [passage + " " + " ".join(w[: r.choice([30, 45, 60])] + [f"own{r.randrange(10**6)}"] * r.choice([1, 1, 5])) for w in families for _ in range(4)]
    r.shuffle(made)
    docs = spark.createDataFrame([(f"d{k:03}", t) for k, t in enumerate(made)], "doc_id string, text string")
    known = {x.id: (x.n, x.sig) for x in minhash.signatures(docs, bands=bands, rows=rows).collect()}
    near = set()
    for a in known:
        for b in known:
            (m, s), (n, t) = known[a], known[b]
            j = sum(x == y for x, y in zip(s, t, strict=True)) / len(s)
            if a < b and any(s[k : k + rows] == t[k : k + rows] for k in range(0, len(s), rows)) and j / (1 + j) * (m + n) / min(m, n) >= 0.7:
                near.add((a, b))
    root = {}
    for links in (near, {(x.a, x.b) for x in minhash.near_links(docs, bands=bands, rows=rows).collect()}):
        assert links <= near
        root[len(root)] = of = dict(zip(known, known, strict=True))
        for a, b in sorted(links):
            low, high = sorted((of[a], of[b]))
            of.update({k: low for k, v in of.items() if v == high})
    assert root[0] == root[1] and 1 < len(set(root[0].values())) < len(known)
