"""Retrieval: keyword search with BM25, exact vector search, rank fusion, and what is built on them.

Vectors are compared by whole-stage arithmetic on arrays; a query's vectors are a stated set that is broadcast, so each
corpus vector is read once and only each task's best rows travel. Query sets that grow with the table are taken in
blocks of bounded size, compared by matrix products on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import words
from ..sources import views
from . import postings

K1, B = 1.2, 0.75
RRF_K, SEARCH_LIMIT = 60, 30
#: Query rows that are broadcast at once, and corpus rows of one matrix product with them.
QUERY_BLOCK, ROW_BLOCK = 4096, 512
QUERY = "the of and"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def keyword_search(docs: DataFrame, query: str, *, key: str = "doc_id", text: str = "text", limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """Documents that hold every term, by BM25 over the whole corpus: (key, score). One pass gives counts, one the scores."""
    terms = list(dict.fromkeys(query.lower().replace('"', " ").split()))
    counted = docs.select(F.col(key), words(F.col(text)).alias("w"))
    tf = [F.size("w") - F.size(F.array_remove(F.col("w"), term)) for term in terms]
    counted = counted.select(key, F.size("w").alias("n"), *[c.alias(f"t{k}") for k, c in enumerate(tf)])
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg_n"), *[F.count_if(F.col(f"t{k}") > 0).alias(f"d{k}") for k in range(len(terms))])
    both = counted.where(" and ".join(f"t{k} > 0" for k in range(len(terms))) or "false").join(F.broadcast(stats))
    score = F.lit(0.0)
    for k in range(len(terms)):
        idf = F.ln(1 + (F.col("docs") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))
        score = score + idf * F.col(f"t{k}") * (K1 + 1) / (F.col(f"t{k}") + K1 * (1 - B + B * F.col("n") / F.col("avg_n")))
    out = both.select(key, F.round(score, 6).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, *, floor: float | None = None) -> DataFrame:
    """(q, id, score, rank): the k nearest by cosine for each of a stated, broadcast set of queries (q, vector).

    vectors: id, embedding. A bounded list of each task's best is merged, so a query's candidates never meet in full.
    """
    qs = queries.select("q", F.col("vector").alias("_v"), norm(F.col("vector")).alias("_n"))
    scored = vectors.withColumn("_m", norm(F.col("embedding"))).join(F.broadcast(qs))
    scored = scored.select("q", "id", F.round(dot(F.col("embedding"), F.col("_v")) / F.nullif(F.col("_m") * F.col("_n"), F.lit(0.0)), 4).alias("score"))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(column, dim: int | None = None) -> np.ndarray:
    """Unit vectors, one per row; a null, a zero vector, one that holds a null or one of another length is NaN throughout."""
    rows = column.to_pylist()
    dim = dim or max((len(x) for x in rows if x), default=1)
    m = np.full((len(rows), dim), np.nan)
    for i, x in enumerate(rows):
        if x is not None and len(x) == dim:
            m[i] = x
    with np.errstate(invalid="ignore"):
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(size > 0, size, np.nan)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row by score of four decimals, then id, in any order; NaN comes last."""
    if score.shape[1] <= k:
        return score, np.broadcast_to(ids, score.shape)
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    key = np.nan_to_num(np.rint(score * -10_000), nan=20_000, posinf=30_000).astype(np.int64) * len(ids) + place
    at = np.argpartition(key, k - 1, axis=1)[:, :k]
    return np.take_along_axis(score, at, 1), ids[at]


def vector_topk_of_many(vectors: DataFrame, queries: DataFrame, k: int, *, block: int = QUERY_BLOCK, apart: bool = False) -> DataFrame:
    """``vector_topk`` for query sets of any size, such as every 20th row of the table itself.

    Queries are broadcast in blocks of about ``block`` rows (their place by hash), so what is sent is bounded by the block
    and never grows with the table; each task keeps the best k of its own rows per query, and only these are merged. Ids are
    integers or strings. With ``apart`` both sides have a column of that name, and rows that are equal in it never meet.
    """
    spark = vectors.sparkSession
    queries = queries.select("q", "vector", *["apart"] * apart).where("q is not null")
    n = -(-queries.count() // block) or 1
    text = vectors.schema["id"].dataType.simpleString() == "string"
    kind, made_of = ("string", pa.string()) if text else ("bigint", pa.int64())
    found = None
    for j in range(n):
        part = (queries if n == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(n)) == j)).toArrow()
        unit = _matrix(part.column("vector"))
        sent = spark.sparkContext.broadcast((part.column("q").to_pylist(), unit, np.array(part.column("apart").to_pylist() if apart else [])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, unit, groups = sent.value
            score, ids = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.str_ if text else np.int64)
            for b in batches:
                for at in range(0, b.num_rows if len(q) else 0, ROW_BLOCK):
                    rows = b.slice(at, ROW_BLOCK)
                    new = np.round(unit @ _matrix(rows.column(1), unit.shape[1]).T, 4)
                    own = np.array(rows.column(0).to_pylist()) if text else rows.column(0).to_numpy()
                    if apart:
                        new[groups[:, None] == np.array(rows.column(2).to_pylist())] = -np.inf
                    score, ids = _joined(score, ids, *_best(new, own, k), k)
            kept = ~np.isneginf(score)
            row, _ = np.nonzero(kept)
            named = pa.array([q[i] for i in row.tolist()], qtype)
            yield pa.RecordBatch.from_arrays([named, pa.array(ids[kept].tolist(), made_of), pa.array(score[kept], pa.float64(), from_pandas=True)], names=["q", "id", "score"])

        qtype = part.schema.field("q").type
        columns = [F.col("id").cast(kind), "embedding", *["apart"] * apart]
        made = vectors.select(*columns).mapInArrow(run, f"q {queries.schema['q'].dataType.simpleString()}, id {kind}, score double")
        found = made if found is None else found.unionByName(made)
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _joined(score: np.ndarray, ids: np.ndarray, more: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate([score, more], axis=1), np.concatenate([ids, own], axis=1)
    order = np.lexsort((ids, np.where(np.isnan(score), 2.0, -score)), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector of each group, by position: partial sums combine before the shuffle."""
    made = vectors.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = made.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return ordered.select(group, F.transform("v", lambda e: F.round(e["x"], 6)).alias("centroid"))


def best_of_groups(hits: DataFrame, group: str) -> DataFrame:
    return hits.groupBy("q", group).agg(F.max("score").alias("score"))


def fuse(*ranked: DataFrame, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of (run_id, pos, engine) lists with 0-based positions; every hit adds, a run may have several.
    ``by`` names the columns that tell one question's lists from another's."""
    all_ = ranked[0]
    for r in ranked[1:]:
        all_ = all_.unionByName(r)
    return all_.groupBy(*by, "run_id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("pos"))), 9).alias("points"), (F.count_distinct("engine") > 1).alias("both"))


def library_search(docs: DataFrame, vectors: DataFrame, query: str, vector: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Hybrid search: keyword and vector hits of runs, fused. docs: doc_id, text, run_id; vectors: id, embedding, run_id."""
    place = lambda *order: (F.row_number().over(W.orderBy(*order)) - 1)  # noqa: E731  over at most ``limit`` rows
    words_ = keyword_search(docs, query, limit=limit).withColumn("pos", place(F.desc("score"), F.asc("doc_id")))
    words_ = words_.join(docs.select("doc_id", "run_id"), "doc_id").select("run_id", "pos", F.lit("keyword").alias("engine"))
    near = vector_topk(vectors.select("id", "embedding"), vector, limit).join(vectors.select("id", "run_id"), "id")
    near = near.select("run_id", (F.col("rank") - 1).alias("pos"), F.lit("semantic").alias("engine"))
    return fuse(words_, near)


def _vectors(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("run_id"))


def _asked(spark, d, ids):
    return views.table(spark, d, "embeddings").where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))


def _every_20th(spark, d):
    return views.table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))


def _runs_of_docs(spark, d):
    return views.table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 10).cast("int").alias("run_id"))


def _related(spark, d, pool, floor, limit):
    """Runs related to one run: nearest vectors of other runs, the best of each run, a floor, a limit."""
    v = _vectors(spark, d)
    q = centroids(v.where("run_id = 0"), "run_id").select(F.lit(0).alias("q"), F.col("centroid").alias("vector"))
    hits = vector_topk(v.where("run_id <> 0").select("id", "embedding"), q, pool).join(v.select("id", "run_id"), "id")
    top = best_of_groups(hits, "run_id").withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "run_id")))
    return top.where((F.col("place") <= limit) & (F.col("score") >= floor)).select("run_id", "score", "place")


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_BM25 = f"""w as (select doc_id, {_WORDS} as w from documents), c as (
  select doc_id, len(w) as n, len(list_filter(w, lambda x: x = 'the')) as t0, len(list_filter(w, lambda x: x = 'of')) as t1, len(list_filter(w, lambda x: x = 'and')) as t2 from w
), s as (
  select count(*) as docs, avg(n) as avg_n, count(*) filter (t0 > 0) as d0, count(*) filter (t1 > 0) as d1, count(*) filter (t2 > 0) as d2 from c
), bm as (
  select doc_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / avg_n)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / avg_n))
    + ln(1 + (docs - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * n / avg_n)), 6) as score
  from c, s where t0 > 0 and t1 > 0 and t2 > 0
), top as (select * from bm order by score desc, doc_id limit 30)"""


def _near(ids: str, k: int, where: str = "true") -> str:
    return f"""q as (select vec_id as q, embedding::double[] as v from embeddings where vec_id in ({ids})), sc as (
  select q, vec_id as id, label as run_id, round(list_dot_product(embedding::double[], v) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(v, v))), 4) as score from embeddings, q where {where}
), near as (select q, id, run_id, score, cast(row_number() over (partition by q order by score desc, id) as int) as rank from sc qualify rank <= {k})"""


_CENTROID = "cen as (select label as run_id, i, avg(x::double) as x from (select label, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by label, i), cv as (select run_id, list(round(x, 6) order by i) as centroid from cen group by run_id)"
QUERIES = {
    "keyword_and_search": (lambda s, d: keyword_search(views.table(s, d, "documents").select("doc_id", "text"), QUERY), f"with {_BM25} select * from top"),
    "vector_topk": (lambda s, d: vector_topk(_vectors(s, d).select("id", "embedding"), _asked(s, d, [3, 77, 150]), 20), f"with {_near('3, 77, 150', 20)} select q, id, score, rank from near"),
    "vector_topk_all": (lambda s, d: vector_topk_of_many(_vectors(s, d).select("id", "embedding"), _every_20th(s, d), 20), f"with {_near('select vec_id from embeddings where vec_id % 20 = 0', 20)} select q, id, score, rank from near"),
    "centroid_by_label": (lambda s, d: centroids(_vectors(s, d), "run_id").select("run_id", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("centroid").alias("n")), f"with {_CENTROID} select run_id, round(list_sum(centroid), 4) as total, cast(len(centroid) as int) as n from cv"),
    "rrf_library_search": (
        lambda s, d: library_search(_runs_of_docs(s, d), _vectors(s, d), QUERY, _asked(s, d, [3])),
        f"""with {_BM25}, {_near('3', 30)}, hits as (
          select cast(doc_id % 10 as int) as run_id, row_number() over (order by score desc, doc_id) - 1 as pos, 'keyword' as engine from top union all select run_id, rank - 1, 'semantic' from near
        ) select run_id, round(sum(1 / (60 + pos)), 9) as points, count(distinct engine) > 1 as both from hits group by run_id""",
    ),
    "similar_runs": (
        lambda s, d: _related(s, d, 20, 0.0, 3),
        f"""with {_CENTROID}, sc as (select id, run_id, round(list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v))), 4) as score
          from (select vec_id as id, label as run_id, embedding::double[] as e from embeddings where label <> 0), (select centroid as v from cv where run_id = 0)),
        near as (select * from sc order by score desc, id limit 20), b as (select run_id, max(score) as score from near group by run_id), p as (select *, cast(row_number() over (order by score desc, run_id) as int) as place from b)
        select run_id, score, place from p where place <= 3 and score >= 0""",
    ),
    "prior_block": (
        lambda s, d: _context(s, d, 32, 0.3, 8, False),
        f"with {_near('3', 32, 'label <> 3')} select id, run_id, score from (select *, row_number() over (partition by run_id order by score desc, id) as k from near where score >= 0.3) where k <= 3 order by score desc, id limit 8",
    ),
    "ask_context": (
        lambda s, d: _context(s, d, 30, 0.2, 10, True),
        f"with {_near('3', 30, 'label <> 3')} select id, run_id, score from (select *, row_number() over (partition by run_id order by score desc, id) as k from near where score >= 0.2) order by k > 3, score desc, id limit 10",
    ),
}


def _asked_all(spark, d):
    """Every 20th row asks; its own run is ``apart``."""
    return views.table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"), F.col("label").alias("apart"))


def _pools(spark, d, pool, floor):
    """(q, own, id, run_id, score): each question's nearest vectors that reach the floor."""
    v, q = _vectors(spark, d), _asked_all(spark, d)
    hits = vector_topk_of_many(v.select("id", "embedding"), q, pool).where(F.col("score") >= floor)
    return hits.join(v.select("id", "run_id"), "id").join(q.select("q", F.col("apart").alias("own")), "q").select("q", "own", "id", "run_id", "score")


def _context_all(spark, d, pool, floor, limit, backfill, apart):
    from .select import diversify_each

    hits = _pools(spark, d, pool, floor)
    return diversify_each(hits.where("run_id <> own") if apart else hits, ["q"], "run_id", [F.desc("score"), F.asc("id")], 3, limit, backfill).drop("own")


def _prior_related(spark, d):
    """Runs of the prior block whose best score reaches the floor, three at most."""
    best = _context_all(spark, d, 32, 0.3, 8, False, True).groupBy("q", "run_id").agg(F.max("score").alias("score")).where("score >= 0.35")
    return best.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "run_id"))).where("place <= 3")


def _similar_all(spark, d):
    """The runs that are nearest to each run's mean vector, by their best of the pool."""
    v = _vectors(spark, d)
    means = centroids(v, "run_id").select(F.col("run_id").alias("q"), F.col("centroid").alias("vector"), F.col("run_id").alias("apart"))
    hits = vector_topk_of_many(v.select("id", "embedding", F.col("run_id").alias("apart")), means, 20, apart=True).join(v.select("id", "run_id"), "id")
    top = best_of_groups(hits, "run_id").withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "run_id")))
    return top.where("place <= 3 and score >= 0").select("q", "run_id", "score", "place")


def _library_all(spark, d):
    """Every 20th row asks with the first words of its document and with its vector; both lists of runs are fused."""
    index = postings.indexed(spark, d)
    asked = views.table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("q"), postings.head_words(F.col("text")).alias("text"))
    words_ = index.search(asked, SEARCH_LIMIT).select("q", (F.col("doc") % 10).cast("int").alias("run_id"), (F.col("rank") - 1).alias("pos"), F.lit("keyword").alias("engine"))
    v = _vectors(spark, d)
    near = vector_topk_of_many(v.select("id", "embedding"), _asked_all(spark, d), SEARCH_LIMIT).join(v.select("id", "run_id"), "id")
    return fuse(words_, near.select("q", "run_id", (F.col("rank") - 1).alias("pos"), F.lit("semantic").alias("engine")), by=("q",))


_EVERY = "select vec_id from embeddings where vec_id % 20 = 0"
_OWN = "own as (select vec_id as q, label as own from embeddings)"
_PRIOR = f"{_near(_EVERY, 32)}, {_OWN}, p as (select * from (select *, row_number() over (partition by q, run_id order by score desc, id) as k from near join own using (q) where score >= 0.3 and run_id <> own) where k <= 3 qualify row_number() over (partition by q order by score desc, id) <= 8)"
QUERIES |= {
    "prior_block_all": (lambda s, d: _context_all(s, d, 32, 0.3, 8, False, True), f"with {_PRIOR} select q, id, run_id, score from p"),
    "prior_related_all": (_prior_related, f"with {_PRIOR}, b as (select q, run_id, max(score) as score from p group by all) select q, run_id, score, cast(row_number() over (partition by q order by score desc, run_id) as int) as place from b where score >= 0.35 qualify place <= 3"),
    "ask_context_all": (
        lambda s, d: _context_all(s, d, 30, 0.2, 10, True, False),
        f"with {_near(_EVERY, 30)}, k as (select *, row_number() over (partition by q, run_id order by score desc, id) as k from near where score >= 0.2) select q, id, run_id, score from k qualify row_number() over (partition by q order by k > 3, score desc, id) <= 10",
    ),
    "similar_runs_all": (
        _similar_all,
        f"""with {_CENTROID}, sc as (select cv.run_id as q, id, label as run_id, round(list_dot_product(e, centroid) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(centroid, centroid))), 4) as score
        from (select vec_id as id, label, embedding::double[] as e from embeddings) join cv on cv.run_id <> label), near as (select * from sc qualify row_number() over (partition by q order by score desc, id) <= 20),
        b as (select q, run_id, max(score) as score from near group by all) select q, run_id, score, cast(row_number() over (partition by q order by score desc, run_id) as int) as place from b where score >= 0 qualify place <= 3""",
    ),
    "rrf_library_search_all": (
        _library_all,
        f"""with {postings.search_sql(postings.HEAD_SQL, SEARCH_LIMIT)}, {_near(_EVERY, 30)}, hits as (select q, cast(doc % 10 as int) as run_id, rank - 1 as pos, 'keyword' as engine from found union all select q, run_id, rank - 1, 'semantic' from near)
        select q, run_id, round(sum(1 / (60 + pos)), 9) as points, count(distinct engine) > 1 as both from hits group by all""",
    ),
}


def _context(spark, d, pool, floor, limit, backfill):
    from .select import diversify

    v = _vectors(spark, d).where("run_id <> 3")
    hits = vector_topk(v.select("id", "embedding"), _asked(spark, d, [3]), pool).where(F.col("score") >= floor).join(v.select("id", "run_id"), "id")
    return diversify(hits.select("id", "run_id", "score"), "run_id", [F.desc("score"), F.asc("id")], 3, limit, backfill)
