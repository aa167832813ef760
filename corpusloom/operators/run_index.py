"""The library's vector index: runs' overviews and findings in chunks, each with an embedding, replaced run by run.

Chunks are named ``run:ov:i`` and ``run:f{idx}:i``. The table is partitioned by run: indexing runs again overwrites their
partitions alone, deleting drops them. An embedder is a function of a list of texts to rows of floats, called on bounded
batches inside tasks; without one, hashed bags of words stand in, which are the same on every machine.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import views
from ..sources.scratch import scratch_path, written
from .passages import chunk_array
from .search import centroids, vector_topk_of_many

DIMENSIONS, BATCH = 64, 32
LINKS, LINK_FLOOR, LINK_POOL = 3, 0.55, 20
_CHUNKS = "id string, kind string, title string, text string, vector array<double>, run_id string"


@lru_cache(maxsize=100_000)
def _place(word: str, dimensions: int) -> tuple[int, int]:
    h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
    return h // 2 % dimensions, 1 - 2 * (h % 2)


def bag_of_words(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of hashed word counts with signs; a text without words is zero throughout."""
    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts, strict=True):
        for w, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
            at, sign = _place(w, dimensions)
            row[at] += sign * n
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(size > 0, size, 1.0)


def embedded(rows: DataFrame, text: str = "text", model: Callable[[list[str]], np.ndarray] = bag_of_words, batch: int = BATCH) -> DataFrame:
    """``rows`` with ``vector``; the model sees at most ``batch`` texts at once, nulls as empty ones. A model that returns
    another number of vectors than it was given texts is an error."""
    place, names = rows.columns.index(text), [*rows.columns, "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, batch):  # no more rows than the model sees are held as Python values
                rows = b.slice(k, batch)
                part = [t or "" for t in rows.column(place).to_pylist()]
                found = model(part)
                if len(found) != len(part):
                    raise ValueError(f"the model returned {len(found)} vectors for {len(part)} texts")
                made = [np.asarray(v, float) for v in found]
                ends = np.cumsum([0, *map(len, made)])
                vectors = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(made)))
                yield pa.RecordBatch.from_arrays([*rows.columns, vectors], names=names)

    return rows.mapInArrow(run, rows.withColumn("vector", F.array().cast("array<double>")).schema)


def run_chunks(overviews: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, kind, title, text, run_id) of runs' overviews (run_id, title, text) and findings (run_id, idx, title, text)."""
    both = overviews.select("run_id", F.lit("overview").alias("kind"), F.lit("ov").alias("part"), "title", "text").unionByName(
        findings.select("run_id", F.lit("finding").alias("kind"), F.concat(F.lit("f"), "idx").alias("part"), "title", "text")
    )
    cut = both.select("run_id", "kind", "part", "title", F.posexplode(chunk_array(F.col("text"))).alias("i", "text"))
    return cut.select(F.concat_ws(":", "run_id", "part", "i").alias("id"), "kind", "title", "text", F.col("run_id").cast("string").alias("run_id"))


class RunIndex:
    """The chunk table under ``path``, a folder that all executors share; one path for each embedding model."""

    def __init__(self, spark: SparkSession, path: str, model: Callable[[list[str]], np.ndarray] = bag_of_words):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(_CHUNKS).parquet(self.path)

    def index(self, overviews: DataFrame, findings: DataFrame) -> None:
        """Index the runs of these rows; their earlier chunks go, all others stay as they are."""
        made = embedded(run_chunks(overviews, findings).hint("rebalance", "run_id"), model=self.model).select("id", "kind", "title", "text", "vector", "run_id")
        out = made.sortWithinPartitions("run_id", "id").write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic")
        out.mode("overwrite").parquet(self.path)

    def delete(self, runs: list[str]) -> None:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(top):
            name = s.getPath().getName()
            if name.startswith("run_id=") and unquote(name.removeprefix("run_id=")) in runs:
                fs.delete(s.getPath(), True)

    def similar_runs(self, most: int = LINKS, floor: float = LINK_FLOOR, pool: int = LINK_POOL) -> DataFrame:
        """(run_id, other, score): of the ``pool`` overview chunks of other runs that are nearest to the mean of a run's own,
        each run's best; the first ``most`` of them that reach ``floor``."""
        own = self.chunks().where("kind = 'overview'").select("id", F.col("vector").alias("embedding"), F.col("run_id").alias("apart"))
        means = written(centroids(own, "apart"), "means").select(F.col("apart").alias("q"), F.col("centroid").alias("vector"), "apart")
        near = vector_topk_of_many(own, means, pool, apart=True).join(own.select("id", F.col("apart").alias("run_id")), "id")
        best = near.groupBy("q", "run_id").agg(F.max("score").alias("score")).where(F.col("score").isNotNull())
        top = best.withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "run_id")))
        return top.where((F.col("k") <= most) & (F.col("score") >= floor)).select(F.col("q").alias("run_id"), F.col("run_id").alias("other"), "score")


def _parts(spark, d):
    """A run for each source: its first document is the overview, the others are findings."""
    docs = views.table(spark, d, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").alias("idx"), F.col("lang").alias("title"), F.regexp_replace("text", r"([.!?]) ([A-Z])", "$1\n\n$2").alias("text"))
    first = docs.groupBy("run_id").agg(F.min("idx").alias("idx"))
    return docs.join(first, ["run_id", "idx"], "left_semi"), docs.join(first, ["run_id", "idx"], "left_anti")


def _indexed(spark, d):
    index = RunIndex(spark, scratch_path(spark, "run-index"))
    index.index(*_parts(spark, d))
    return index


def _upkeep(spark, d):
    index = _indexed(spark, d)
    overviews, findings = _parts(spark, d)
    again = "run_id in ('src1', 'src2')"
    index.index(overviews.where(again), findings.where(again).where("idx % 2 = 0"))
    index.delete(["src6", "none"])
    return index.chunks().groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("first"), F.sum(F.length("text")).alias("chars"))


#: Keeps sums of ratios off the places where they would be rounded up or down by their last bit.
_MARK = 0.7310585786
_C = r"""t as (select source, doc_id, lang, regexp_replace(text, '([.!?]) ([A-Z])', '\1' || chr(10) || chr(10) || '\2', 'g') as t from documents),
  m as (select *, regexp_replace(coalesce(t, ''), '(?m)^(#{1,6}\s.*)$', chr(10) || chr(10) || chr(1) || '\1' || chr(10) || chr(10), 'g') as m from t),
  b as (select source, doc_id, lang, list_filter(list_transform(regexp_split_to_array(m, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as b from m),
  c as (select source, doc_id, lang, flatten(list_transform(b, lambda x: case when starts_with(x, chr(1)) or length(x) <= 1800 then [x]
    else list_transform(range(0, cast(floor((length(x) - 1) / 1300) as bigint) + 1), lambda k: substr(x, k * 1300 + 1, 1300)) end)) as b from b),
  f(source, doc_id, lang, b, k, head, held, done) as (
    select source, doc_id, lang, b, 0, '', cast([] as varchar[]), cast(null as varchar) from c
    union all
    select source, doc_id, lang, b, k + 1, case when starts_with(b[k + 1], chr(1)) then substr(b[k + 1], 2) else head end,
      case when k = len(b) or starts_with(b[k + 1], chr(1)) then [] when full_ then (case when length(held[-1]) <= 400 then [held[-1]] else [] end) || [b[k + 1]] else held || [b[k + 1]] end,
      case when (k = len(b) or starts_with(b[k + 1], chr(1)) or full_) and (len(held) > 0 or head <> '') then array_to_string(case when head = '' then held else [head] || held end, chr(10) || chr(10)) end
    from (select *, len(held) > 0 and list_sum(list_transform(held, lambda p: length(p))) + length(b[k + 1]) > 1300 as full_ from f) where k <= len(b)),
  firsts as (select source, min(doc_id) as doc_id from documents group by source),
  ch as (select source as run_id, doc_id, case when doc_id in (select doc_id from firsts) then 'overview' else 'finding' end as kind,
    source || case when doc_id in (select doc_id from firsts) then ':ov:' else ':f' || doc_id || ':' end || (row_number() over (partition by doc_id order by k) - 1) as id, done as text from f where done is not null),
  w as (select id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from ch),
  h as (select id, cast('0x' || substr(md5(w), 1, 8) as bigint) as h from w),
  x as (select id, (h // 2) % 64 as dim, cast(sum(1 - 2 * (h % 2)) as double) as x from h group by all),
  s as (select id, sqrt(sum(x * x)) as s from x group by id),
  v as (select id, dim, x / case when s > 0 then s else 1 end as x from x join s using (id))"""
QUERIES = {
    "run_index_chunks": (
        lambda s, d: _indexed(s, d).chunks().select("id", "run_id", "kind", F.length("text").alias("n"), F.round(_MARK * F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 6).alias("mark")),
        f"with recursive {_C}, k as (select id, round({_MARK} * sum(x * (dim + 1)), 6) as mark from v group by id) select ch.id, run_id, kind, cast(length(text) as int) as n, coalesce(mark, 0) as mark from ch left join k using (id)",
    ),
    "run_index_upkeep": (
        _upkeep,
        f"""with recursive {_C} select run_id, kind, count(*) as chunks, min(id) as first, cast(sum(length(text)) as bigint) as chars from ch
        where run_id <> 'src6' and not (run_id in ('src1', 'src2') and kind = 'finding' and doc_id % 2 = 1) group by all""",
    ),
    "run_links": (
        lambda s, d: _indexed(s, d).similar_runs(floor=0.0),
        f"""with recursive {_C}, ov as (select ch.id, run_id, dim, x from ch join v using (id) where kind = 'overview'), n as (select run_id, count(*) as n from ch where kind = 'overview' group by all),
        cen as (select run_id, dim, round(sum(x) / any_value(n), 6) as x from ov join n using (run_id) group by all), cn as (select run_id, sqrt(sum(x * x)) as m from cen group by all), vn as (select id, run_id, sqrt(sum(x * x)) as n from ov group by all),
        dots as (select c.run_id as q, o.run_id, o.id, sum(c.x * o.x) as p from cen c join ov o on c.dim = o.dim and c.run_id <> o.run_id group by all),
        sc as (select q, dots.run_id, dots.id, round(p / nullif(n * m, 0), 4) as score from dots join vn using (id) join cn on cn.run_id = q),
        near as (select * from sc qualify row_number() over (partition by q order by score desc, id) <= 20), best as (select q, run_id, max(score) as score from near group by all)
        select q as run_id, run_id as other, score from best where score >= 0 qualify row_number() over (partition by q order by score desc, run_id) <= 3""",
    ),
}
