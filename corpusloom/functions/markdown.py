"""Reports in Markdown as Column expressions: their sections, what is moved, cut or renumbered in them, and edits of sentences.

A report is cut before every heading; joined again the pieces are the report, whatever is in it. Lines in code fences that
begin like a heading count as one. Null reports stay null, or are empty where a function says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import views
from .citations import GROUP
from .text import let

# Fixed values.
TAILS = ("## Researched but not used", "## Not researched")
_OPEN = r"(?i)^##[ \t]+open questions\b"
_UNUSED = (
    r"(?m)^[ \t]*(?:#{1,6}[ \t]*|[-*+][ \t]+|\d{1,3}[.)][ \t]+)?(?:\*\*|__)?UNUSED(?:\*\*|__)?[ \t]*:(?:\*\*|__)?[ \t]*"
    r"\[(\d+)\][ \t]*(?:[—–:-]+[ \t]*)?(.*?)[ \t]*$\n?"
)
_LIST_MARK = r"^(\s*(?:[-*+]|\d{1,3}[.)])\s+)"
_BOLD_LABEL = r"^(\*\*[^*\n]{1,80}\*\*:?\s*)"
TITLE = r"\A\s*#\s+[^\n]*\n+"
MESSAGE = 4000
SECTION = "struct<level:int,heading:string,text:string>"

_WHITE = " \t\n\x0b\x0c\r"


def _rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_WHITE))


def _lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(_WHITE))


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE))


def _after(text: Column, at: Column) -> Column:
    """``text`` from the 0-based place ``at`` on."""
    return F.substring(text, at + 1, F.length(text))


def sections(md: Column) -> Column:
    """(level, heading, text) of every piece that begins with a heading, and of what stands before the first (level 0)."""

    def of(p: Column) -> Column:
        level = F.length(F.regexp_extract(p, r"^(#{1,6})[ \t]", 1))
        return F.struct(level.cast("int").alias("level"), _strip(F.regexp_extract(p, r"^#{1,6}[ \t]+([^\n]*)", 1)).alias("heading"), p.alias("text"))

    return F.transform(F.filter(F.split(md, r"(?m)^(?=#{1,6}[ \t])"), lambda p: p != ""), of)


def rendered(parts: Column) -> Column:
    """The report that ``parts`` are the sections of."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def with_parents(parts: Column) -> Column:
    """Each section's place in the tree: the places of itself and of the sections that it stands in, from the top."""

    def up(done: Column, p: Column) -> Column:
        at = F.size(done["path"])
        open_ = F.filter(done["open"], lambda o: o["level"] < p["level"])
        path = F.concat(F.transform(open_, lambda o: o["at"]), F.array(at))
        return F.struct(F.concat(open_, F.array(F.struct(p["level"].alias("level"), at.alias("at")))).alias("open"), F.concat(done["path"], F.array(path)).alias("path"))

    start = F.struct(F.array().cast("array<struct<level:int,at:int>>").alias("open"), F.array().cast("array<array<int>>").alias("path"))
    paths = F.aggregate(parts, start, up)["path"]
    return F.zip_with(parts, paths, lambda p, at: F.struct(p["level"].alias("level"), p["heading"].alias("heading"), p["text"].alias("text"), at.alias("path")))


def open_questions_last(md: Column) -> Column:
    """The report with its open questions after all other sections, before the lists that close it; unchanged without them,
    or with them in place."""
    parts = F.filter(F.split(md, r"(?m)^(?=## )"), lambda p: p != "")
    is_open = lambda p: p.rlike(_OPEN)
    is_tail = lambda p: p.startswith(TAILS[0]) | p.startswith(TAILS[1])

    def moved(p: Column, k: Column) -> Column:
        join = lambda a: F.array_join(a, "")
        section = _strip(p[k])
        rest = F.concat(_rstrip(join(F.slice(p, 1, k))), F.lit("\n\n"), _lstrip(join(F.slice(p, k + 2, F.size(p)))))
        first = lambda r: F.array_min(F.filter(F.array(*[F.locate("\n" + t, r) for t in TAILS]), lambda x: x > 0))
        end = lambda r, at: F.when(at.isNull(), F.concat(_rstrip(r), F.lit("\n\n"), section, F.lit("\n"))).otherwise(
            F.concat(_rstrip(F.substring(r, F.lit(1), at - 1)), F.lit("\n\n"), section, F.lit("\n\n"), _lstrip(F.substring(r, at, F.length(r))))
        )
        return let(rest, lambda r: let(first(r), lambda at: end(r, at)))

    def placed(p: Column) -> Column:
        at = F.array_min(F.transform(F.filter(F.transform(p, lambda x, i: F.struct(i.alias("i"), is_open(x).alias("o"))), lambda x: x["o"]), lambda x: x["i"]))
        return let(at, lambda k: F.when(k.isNull() | (k + 1 >= F.size(p)), md).when(is_tail(F.get(p, k + 1)), md).otherwise(moved(p, k)))

    return let(parts, placed)


def split_unused(md: Column, allowed: Column) -> Column:
    """(text, unused): the report without its UNUSED lines, and of these (id, reason), once for each allowed id."""
    at = lambda g: F.regexp_extract_all(md, F.lit(_UNUSED), F.lit(g))
    found = F.zip_with(at(1), at(2), lambda i, why: F.struct(i.try_cast("int").alias("id"), _strip(why).alias("reason")))

    def first(rows: Column) -> Column:
        ids = F.transform(rows, lambda x: x["id"])
        return F.filter(rows, lambda x, i: F.array_contains(allowed, x["id"]) & (F.array_position(ids, x["id"]) == i + 1))

    return F.struct(F.concat(_rstrip(F.regexp_replace(md, _UNUSED, "")), F.lit("\n")).alias("text"), let(found, first).alias("unused"))


def without_title(md: Column, title: Column | None = None) -> Column:
    """The report without the title at its top; with ``title`` only if it says the same, whatever its case and spaces."""
    md = F.coalesce(md, F.lit(""))
    gone = F.regexp_replace(md, TITLE, "")
    if title is None:
        return gone
    plain = lambda c: F.lower(_strip(F.regexp_replace(c, r"\s+", " ")))
    said = F.ltrim(_lstrip(F.regexp_extract(md, TITLE, 0)), F.lit("#"))
    return F.when(md.rlike(TITLE) & (plain(said) == plain(F.coalesce(title, F.lit("")))), gone).otherwise(md)


def outline(headings: Column) -> Column:
    """(id, heading) of headings in order: a slug of each, numbered from its second use on."""
    slug = lambda h: F.substring(F.btrim(F.regexp_replace(F.lower(h), "[^a-z0-9]+", "-"), F.lit("-")), 1, 60)
    bases = F.transform(headings, lambda h: F.when(slug(h) == "", F.lit("section")).otherwise(slug(h)))

    def numbered(b: Column) -> Column:
        nth = lambda x, i: F.size(F.filter(F.slice(b, 1, i), lambda y: y == x)) + 1
        return F.zip_with(F.transform(b, lambda x, i: F.when(nth(x, i) == 1, x).otherwise(F.concat(x, F.lit("-"), nth(x, i)))), headings, lambda x, h: F.struct(x.alias("id"), h.alias("heading")))

    return let(bases, numbered)


def tldr(md: Column, fallback: int = 900, most: int = 2000) -> Column:
    """The section that is headed so, else the report's first characters."""
    md = F.coalesce(md, F.lit(""))
    said = _strip(F.regexp_extract(md, r"(?is)(?:^|\n)## tl;dr[^\n]*\n(.*?)(?=\n#|\z)", 1))
    return F.substring(F.when(said.isin("") | said.startswith("#"), F.substring(_strip(md), 1, fallback)).otherwise(said), 1, most)


def messages(text: Column, limit: int = MESSAGE) -> Column:
    """The text in pieces of at most ``limit`` characters, cut between paragraphs, else lines, else anywhere."""
    state = lambda out, held: F.struct(out.alias("out"), held.alias("held"))
    none = F.array().cast("array<string>")
    closed = lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["held"])))

    def add(a: Column, x: Column, sep: str) -> Column:
        return F.when(a["held"] == "", x).otherwise(F.concat(a["held"], F.lit(sep), x))

    def line(a: Column, x: Column) -> Column:
        full = F.floor((F.length(x) - 1) / limit).cast("int")
        cut = F.when(F.length(x) > limit, F.transform(F.sequence(F.lit(0), full - 1), lambda k: F.substring(x, k * limit + 1, F.lit(limit)))).otherwise(none)
        rest = F.when(F.length(x) > limit, F.substring(x, full * limit + 1, F.lit(limit))).otherwise(x)
        return F.when(F.length(add(a, x, "\n")) <= limit, state(a["out"], add(a, x, "\n"))).otherwise(state(F.concat(closed(a), cut), rest))

    def paragraph(a: Column, x: Column) -> Column:
        lines = F.aggregate(F.split(x, "\n"), state(closed(a), F.lit("")), line)
        return F.when(F.length(add(a, x, "\n\n")) <= limit, state(a["out"], add(a, x, "\n\n"))).when(F.length(x) <= limit, state(closed(a), x)).otherwise(lines)

    made = F.aggregate(F.split(_strip(F.coalesce(text, F.lit(""))), "\n\n"), state(none, F.lit("")), paragraph)
    return let(made, closed)


def table_cell(text: Column) -> Column:
    """A value that breaks no table row."""
    return F.replace(_strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit("|"), F.lit("\\|"))


def cited_sources(ids: Column, most: int = 3) -> Column:
    """Markers of the ``most`` smallest ids and the number of others."""
    own = F.array_sort(F.array_distinct(F.filter(ids, lambda i: i > 0)))
    shown = lambda o: F.array_join(F.transform(F.slice(o, 1, most), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")
    return F.coalesce(let(own, lambda o: F.when(F.size(o) > most, F.concat(shown(o), F.lit(" +"), F.size(o) - most)).otherwise(shown(o))), F.lit(""))


def with_citations(sentence: Column, ids: Column) -> Column:
    """The sentence with markers of ``ids`` alone, where its last marker was, or at its end."""
    marker = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), "")

    def made(p: Column) -> Column:
        head = F.array_join(F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: F.rtrim(x)), "")
        whole = lambda h: F.concat(h, F.when((h == "") | F.substring(h, -1, 1).isin("(", " ", "\n"), F.lit("")).otherwise(F.lit(" ")), marker, F.element_at(p, -1))
        return F.when(F.size(p) == 1, F.concat(_rstrip(sentence), F.lit(" "), marker)).otherwise(let(head, whole))

    return let(F.split(sentence, GROUP), made)


def keep_frame(original: Column, revised: Column) -> Column:
    """The revised sentence with the list mark and bold label that the original had, and without a mark that it had not."""
    mark = F.regexp_extract(original, _LIST_MARK, 1)
    label = F.regexp_extract(F.regexp_replace(original, _LIST_MARK, ""), _BOLD_LABEL, 1)
    body = F.regexp_replace(revised, _LIST_MARK, "")
    return F.concat(mark, F.when((label != "") & ~body.rlike(_BOLD_LABEL), label).otherwise(""), body)


def edited(md: Column, edits: Column) -> Column:
    """The report with edits (start, end, new) made, offsets in characters of the report as it was. One pass over the
    edits in order of their start; one that begins before another's end, or reaches past the report, is not made."""
    state = lambda out, at: F.struct(out.alias("out"), at.alias("at"))
    order = F.array_sort(F.transform(edits, lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["new"].alias("new"))))

    def take(a: Column, e: Column) -> Column:
        good = (e["start"] >= a["at"]) & (e["end"] >= e["start"]) & (e["end"] <= F.length(md)) & e["new"].isNotNull()
        piece = F.substring(md, a["at"] + 1, e["start"] - a["at"])
        return F.when(good, state(F.concat(a["out"], F.array(piece, e["new"])), e["end"])).otherwise(a)

    made = F.aggregate(order, state(F.array().cast("array<string>"), F.lit(0)), take)
    return F.coalesce(let(made, lambda a: F.concat(F.array_join(a["out"], ""), _after(md, a["at"]))), md)


def _report(spark, d):
    """Documents as reports: sentences in sections, open questions between them, and a closing list."""
    t = F.col("text")
    half = F.floor(F.length(t) / 2).cast("int")
    md = F.concat(
        F.lit("# Title "), F.col("lang"), F.lit("\n\n## TL;DR\n\n"), F.substring(t, 1, 200), F.lit("\n\n## Open Questions left\n\nq "), F.col("doc_id"), F.lit("\n\n## First\n\n"), F.substring(t, F.lit(1), half), F.lit("\n### Sub\nx"), _after(t, half),
        F.when(F.col("doc_id") % 2 == 0, F.lit("\n\n## Not researched\n\n- x\nUNUSED: [3] — no use\n- **UNUSED:** [9] x\n")).otherwise("\n"),
    )
    return views.table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "text", md.alias("md"))


def section_rows(reports: DataFrame, key: str, md: str = "md") -> DataFrame:
    """(key, at, level, heading, parent, text): the tree of each report; a section's parent is the place of the one it is in."""
    tree = reports.select(key, F.posexplode(with_parents(sections(F.col(md)))).alias("at", "s"))
    return tree.select(key, "at", "s.level", "s.heading", F.try_element_at("s.path", F.lit(-2)).alias("parent"), "s.text")


def _edits(spark, d):
    """Every sentence that begins one of the text's first lines replaced in its place, with the marks of both sides."""
    rows = _report(spark, d).select("doc_id", "text", F.length("text").alias("n"))
    ends = F.array(*[F.struct((F.col("n") * k / 8).cast("int").alias("start"), (F.col("n") * k / 8 + F.col("n") / 20).cast("int").alias("end"), F.lit(f"<{k}>").alias("new")) for k in (5, 1, 3)])
    return rows.select("doc_id", F.md5(edited(F.col("text"), ends)).alias("digest"))


_H = "floor(length(text) / 2)"
_MD = f"""r as (select doc_id, text, '# Title ' || lang || chr(10) || chr(10) || '## TL;DR' || chr(10) || chr(10) || substr(text, 1, 200) || chr(10) || chr(10) as a, '## Open Questions left' || chr(10) || chr(10) || 'q ' || doc_id || chr(10) || chr(10) as o,
  '## First' || chr(10) || chr(10) || substr(text, 1, cast({_H} as bigint)) || chr(10) as f, '### Sub' || chr(10) || 'x' || substr(text, cast({_H} as bigint) + 1) as s,
  case when doc_id % 2 = 0 then chr(10) || chr(10) || '## Not researched' || chr(10) || chr(10) || '- x' || chr(10) || 'UNUSED: [3] — no use' || chr(10) || '- **UNUSED:** [9] x' || chr(10) else chr(10) end as e from documents where text is not null and not regexp_matches(text, '(^|\\n)#'))"""
_W = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUERIES = {
    "report_round_trip": (
        lambda s, d: _report(s, d).select("doc_id", (rendered(sections(F.col("md"))) == F.col("md")).alias("same"), F.md5(rendered(sections(F.col("md")))).alias("digest")),
        f"with {_MD.replace(' and not regexp_matches(text, ' + chr(39) + '(^|' + chr(92) + 'n)#' + chr(39) + ')', '')} select doc_id, true as same, md5(a || o || f || s || e) as digest from r",
    ),
    "report_questions_last": (
        lambda s, d: _report(s, d).where(~F.col("text").rlike("(?m)^#")).select("doc_id", F.md5(open_questions_last(F.col("md"))).alias("digest")),
        f"""with {_MD} select doc_id, md5(case when doc_id % 2 = 0 then rtrim(a, {_W}) || chr(10) || chr(10) || rtrim(f || s, {_W}) || chr(10) || chr(10) || trim(o, {_W}) || chr(10) || chr(10) || ltrim(e, {_W}) else rtrim(rtrim(a, {_W}) || chr(10) || chr(10) || f || s || e, {_W}) || chr(10) || chr(10) || trim(o, {_W}) || chr(10) end) as digest from r""",
    ),
    "report_sections": (
        lambda s, d: section_rows(_report(s, d).where(~F.col("text").rlike("(?m)^#")), "doc_id").select("doc_id", "at", "level", "heading", "parent", F.length("text").alias("n")),
        f"""with {_MD}, x as (select doc_id, unnest([{{'at': 0, 'level': 1, 'heading': substr(a, 3, instr(a, chr(10)) - 3), 'parent': null, 'n': instr(a, '## TL;DR') - 1}}, {{'at': 1, 'level': 2, 'heading': 'TL;DR', 'parent': 0, 'n': length(a) - instr(a, '## TL;DR') + 1}},
          {{'at': 2, 'level': 2, 'heading': 'Open Questions left', 'parent': 0, 'n': length(o)}}, {{'at': 3, 'level': 2, 'heading': 'First', 'parent': 0, 'n': length(f)}},
          {{'at': 4, 'level': 3, 'heading': 'Sub', 'parent': 3, 'n': length(s) + case when doc_id % 2 = 0 then 2 else 1 end}}, {{'at': 5, 'level': 2, 'heading': 'Not researched', 'parent': 0, 'n': length(e) - 2}}]) as x from r)
        select doc_id, cast(x.at as int) as at, cast(x.level as int) as level, x.heading as heading, cast(x.parent as int) as parent, cast(x.n as int) as n from x where x.at < 5 or doc_id % 2 = 0""",
    ),
    "edited_reports": (
        _edits,
        """with n as (select doc_id, text, length(text) as n from documents where text is not null), p as (select *, [cast(trunc(n * k / 8.0::double) as int) for k in [1, 3, 5]] as a, [cast(trunc(n * k / 8.0::double + n / 20.0::double) as int) for k in [1, 3, 5]] as b from n)
        select doc_id, md5(substr(text, 1, a[1]) || '<1>' || substr(text, b[1] + 1, a[2] - b[1]) || '<3>' || substr(text, b[2] + 1, a[3] - b[2]) || '<5>' || substr(text, b[3] + 1)) as digest from p""",
    ),
}
