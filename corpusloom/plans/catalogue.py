"""Registered queries of the library's own operators, and their equivalents in ANSI SQL."""

from __future__ import annotations

from ..functions import asks, captions, charsets, citations, coerce, markdown, text, urls
from ..operators import candidates, source_checks, dedup, excerpts, figures, finding_files, library, minhash, models, outcomes, pages, passages, picks, postings, reindex, reports, run_index, runs, screens, search, select, store, threads
from ..streaming import bench, bus, idle
from . import depth

_MODULES = (outcomes, runs, urls, text, select, search, dedup, citations, passages, bench, depth, coerce, pages, reports, figures, candidates, asks, library, models, bus, excerpts, finding_files, screens, postings, run_index, threads, charsets, idle, minhash, reindex, markdown, captions, store, source_checks, picks)


def flagship(spark, sf_dir):
    return queries()["rrf_library_search"](spark, sf_dir)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
