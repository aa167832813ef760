"""Sections and edits of reports, and the library rebuilt from a research folder."""

import json
import os

import pytest
from corpusloom.functions import markdown as md
from corpusloom.operators import reindex
from pyspark.sql import functions as F


def value(spark, column, *cells, kinds="string"):
    names = [f"c{k}" for k in range(len(cells))]
    kinds = kinds.split("|")
    df = spark.createDataFrame([tuple(cells)], ", ".join(f"{n} {kinds[min(k, len(kinds) - 1)]}" for k, n in enumerate(names)))
    return df.select(column(*[F.col(n) for n in names]).alias("v")).first().v


BODY = "# T\n\nlead\n\n## TL;DR\n\nshort [1].\n\n## Open questions (2)\n\n- a\n### deep\nb\n\n## First\n\none\n\n## Second\n\ntwo\n"


@pytest.mark.parametrize("text", [BODY, "", "no heading", "\n\n# a\n## b\n####### not\n#nor\n", "x\n# y", "# only", "```\n# in a fence\n```\n"])
def test_sections_joined_are_the_report(spark, text):
    assert value(spark, lambda t: md.rendered(md.sections(t)), text) == text


def test_sections_know_what_they_stand_in(spark):
    got = value(spark, lambda t: md.with_parents(md.sections(t)), BODY)
    assert [(r.level, r.heading, r.path) for r in got] == [(1, "T", [0]), (2, "TL;DR", [0, 1]), (2, "Open questions (2)", [0, 2]), (3, "deep", [0, 2, 3]), (2, "First", [0, 4]), (2, "Second", [0, 5])]


def test_open_questions_go_last_but_before_the_lists_that_close(spark):
    last = lambda t: value(spark, md.open_questions_last, t)
    assert last(BODY) == "# T\n\nlead\n\n## TL;DR\n\nshort [1].\n\n## First\n\none\n\n## Second\n\ntwo\n\n## Open questions (2)\n\n- a\n### deep\nb\n"
    tail = "\n## Not researched\n\n- z\n"
    assert last(BODY + tail) == "# T\n\nlead\n\n## TL;DR\n\nshort [1].\n\n## First\n\none\n\n## Second\n\ntwo\n\n## Open questions (2)\n\n- a\n### deep\nb\n\n## Not researched\n\n- z\n"
    for same in ("# T\n\n## First\n\nx\n", last(BODY), last(BODY + tail), "## open questions\n\nq\n\n## Researched but not used\n\n- s\n", None, ""):
        assert last(same) == same


def test_unused_lines_leave_the_report(spark):
    text = "body [1]\n\nUNUSED: [2] — no figures\n## UNUSED: [3]: same\n- **UNUSED:** [2] again\n1. UNUSED: [9] — never given\n__UNUSED__: [4]\nend"
    got = value(spark, lambda t: md.split_unused(t, F.array(F.lit(2), F.lit(3), F.lit(4))), text)
    assert got.text == "body [1]\n\nend\n" and [(u.id, u.reason) for u in got.unused] == [(2, "no figures"), (3, "same"), (4, "")]


def test_titles_slugs_and_short_forms(spark):
    assert value(spark, md.without_title, "\n # A  b\n\nx") == "x" and value(spark, md.without_title, "x\n# A") == "x\n# A" and value(spark, md.without_title, None) == ""
    assert value(spark, md.without_title, "# A  b\n\nx", "a B ") == "x" and value(spark, md.without_title, "# A b\n\nx", "other") == "# A b\n\nx"
    got = value(spark, md.outline, ["A & B!", "a b", "", "A-B", "é"], kinds="array<string>")
    assert [g.id for g in got] == ["a-b", "a-b-2", "section", "a-b-3", "section-2"]
    assert value(spark, md.tldr, BODY) == "short [1]." and value(spark, md.tldr, "plain " * 300) == ("plain " * 300)[:900] and value(spark, md.tldr, None) == ""
    assert value(spark, md.table_cell, " a|b\n c ") == "a\\|b c" and value(spark, md.cited_sources, [5, 0, 2, 9, 2, 7, -1], kinds="array<int>") == "[2][5][7] +1" and value(spark, md.cited_sources, [], kinds="array<int>") == ""


def pieces(text, limit):
    out, held = [], ""
    for p in text.strip().split("\n\n") if text.strip() else []:
        if len(joined := f"{held}\n\n{p}" if held else p) <= limit:
            held = joined
            continue
        out += [held] if held else []
        held = ""
        if len(p) <= limit:
            held = p
            continue
        for line in p.split("\n"):
            if len(joined := f"{held}\n{line}" if held else line) <= limit:
                held = joined
                continue
            out += [held] if held else []
            while len(line) > limit:
                out.append(line[:limit])
                line = line[limit:]
            held = line
    return out + ([held] if held else [])


@pytest.mark.parametrize("text", ["", "a", "aaa\n\nbbb\n\ncc", "x" * 35, "aaaa\nbbbbbbbbbb\ncc\n\nd", "y" * 20 + "\nzz\n" + "w" * 21 + "\n\n" + "v" * 10, "\n\n\n\naaaaaaa\n\n\n\nbbbbbbbb"])
def test_messages_stay_below_the_limit(spark, text):
    assert value(spark, lambda t: md.messages(t, 10), text) == pieces(text, 10)


def test_citations_move_and_frames_stay(spark):
    cite = lambda t, ids: value(spark, md.with_citations, t, ids, kinds="string|array<int>")
    assert cite("It is 5 GB [1][2].", [3]) == "It is 5 GB [3]." and cite("A [1] and B [2]", [4, 5]) == "A and B [4][5]" and cite("Plain. ", [7]) == "Plain. [7]" and cite("[1] first", [2]) == "[2] first" and cite("So ([1]).", [2]) == "So ([2])."
    frame = lambda a, b: value(spark, md.keep_frame, a, b)
    assert frame("- **Speed:** old [1]", "new [1]") == "- **Speed:** new [1]" and frame("old", "* new") == "new" and frame("2) old", "- **L** new") == "2) **L** new" and frame("**A** old", "**B** new") == "**B** new"


def test_edits_are_made_in_one_pass(spark):
    made = lambda t, *e: value(spark, md.edited, t, list(e), kinds="string|array<struct<start:int,end:int,new:string>>")
    text = "zero one é two three"
    assert made(text, (11, 14, "2"), (0, 4, "0"), (14, 14, "!")) == "0 one é 2! three"
    assert made(text, (0, 8, "A"), (5, 10, "B"), (15, 99, "C"), (18, 17, "D")) == "A é two three" and made(text) == text and made("", (0, 0, "x")) == "x"


# ----------------------------------------------------------------------------------------------------------------------
def folder(tmp_path):
    def put(path, text):
        target = tmp_path / "research" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())

    finding = lambda n, title, notes="noted": f"# [{n}] {title}\n\n- **URL:** https://a.org/{n}\n- **Domain:** a.org\n- **Published:** unknown\n- **Relevance:** 7/10\n- **Source type:** standard — Maker\n- **Found via:** q\n\n**Summary:** s{n}\n\n## Notes\n\n{notes}\n\n## Key facts\n\n- c (confidence 9/10)\n"
    put("r1/meta.json", json.dumps({"query": "Q1", "depth": 3, "title": "One", "status": "stopped", "list": [1]}))
    put("r1/overview.md", "# One\n\nwhole overview words")
    put("r1/findings/001_a.md", finding(1, "A"))
    put("r1/findings/002_b.md", finding(2, "B").encode("utf-8")[:-1])
    put("r1/findings/003_torn.md", "# no number\n")
    put("r1/findings/009_again.md", finding(2, "again"))
    put("r2/meta.json", "{}")
    put("r2/findings/001_x.md", finding(1, "X", "münchen").encode("cp1252"))
    put("r3/meta.json", '{"query": "torn')
    put("r3/findings/001_y.md", finding(1, "Y"))
    put("r4/notes.txt", "nothing")
    put("r5/meta.json", "[1]")
    put("r5/overview.md", "lost")
    return f"file://{tmp_path}/research", put


def test_a_library_is_restored_once_and_completed_later(spark, tmp_path):
    path, put = folder(tmp_path)
    library = reindex.Library(spark, f"file://{tmp_path}/library")
    assert library.reindex(path) == {"runs": 2, "findings": 3, "indexed": 2}
    runs = {r.id: r for r in library.runs().collect()}
    assert (runs["r1"].query, runs["r1"].depth, runs["r1"].status, runs["r1"].recency) == ("Q1", 3, "stopped", "all") and (runs["r2"].query, runs["r2"].depth, runs["r2"].status, runs["r2"].title) == ("r2", 1, "completed", None)
    rows = {(r.run_id, r.idx): r for r in library.findings().collect()}
    assert set(rows) == {("r1", 1), ("r1", 2), ("r2", 1)} and rows["r1", 2].title == "B" and rows["r1", 1].published is None and rows["r1", 1].relevance == 7.0
    assert {(r.run_id, r.doc) for r in library.postings.postings().where("term in ('overview', 'noted', 'nchen')").collect()} == {("r1", 0), ("r1", 1), ("r1", 2), ("r2", 1)}
    assert {r.id for r in library.vectors.chunks().collect()} >= {"r1:ov:0", "r1:f1:0", "r2:f1:0"}

    def written():
        return {(os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, names in os.walk(tmp_path / "library") for f in names}

    before = written()
    assert library.reindex(path) == {"runs": 0, "findings": 0, "indexed": 0} and written() == before
    put("r3/meta.json", '{"query": "whole"}')
    assert library.reindex(path) == {"runs": 1, "findings": 1, "indexed": 1} and before <= written() | {x for x in before if "_SUCCESS" in x[0]}
    library.vectors.delete(["r1"])
    assert library.reindex(path) == {"runs": 0, "findings": 0, "indexed": 1} and library.findings().count() == 4


def test_stored_findings_take_what_only_the_files_hold(spark, tmp_path):
    path, _ = folder(tmp_path)
    files = reindex.scanned(spark, path)
    rows = reindex.findings_of(files).unionByName(spark.createDataFrame([("r1", 8, "findings/gone.md", "G", "", "", None, 1.0, "its summary")], reindex.FINDINGS))
    got = {(r.run_id, r.idx): r for r in reindex.stored_findings(rows, files).collect()}
    assert got["r1", 1].notes == "noted" and [f.claim for f in got["r1", 1].facts] == ["c"] and (got["r1", 1].query, got["r1", 1].source_type, got["r1", 1].publisher) == ("q", "standard", "Maker")
    assert got["r2", 1].notes == "münchen" and got["r1", 8].notes == "its summary" and got["r1", 8].facts == [] and got["r1", 8].publisher == ""
