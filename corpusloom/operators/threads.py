"""Comment threads as text: replies below what they answer, from rows that know their parent alone.

A comment's place is the path of (order, id) from its thread's root, found by doubling: each round joins every comment to
the ancestor that it has reached and takes that one's path over, so a thread of depth n takes log2(n) rounds of one join,
whatever the number of comments. Paths then sort in the order in which the thread is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources import views
from ..sources.scratch import remove, scratch_path

SHOWN = 80
# Fixed values.
COMMENT, GONE = "t1", ("[deleted]", "[removed]")


def placed(comments: DataFrame) -> DataFrame:
    """Rows (thread, id, parent, ord, kind, body, score) that stand in a thread, with their ``path``.

    What is no comment is left out with all below it; so are rows whose parent is missing, and rows of a cycle. Siblings
    stand by ord, then id.
    """
    spark = comments.sparkSession
    base = scratch_path(spark, "threads")
    own = F.array(F.struct(F.col("ord").cast("long").alias("ord"), F.col("id").cast("string").alias("id")))
    steps = comments.where(F.col("kind") == COMMENT).select("thread", F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("up"), own.alias("path"))
    steps.write.parquet(f"{base}/0")
    k, left = 0, None
    while True:
        steps = spark.read.schema(steps.schema).parquet(f"{base}/{k}")
        open_ = steps.where("up is not null").count()
        if open_ == 0 or open_ == left:  # what remains in two rounds has no root
            break
        left = open_
        above = steps.select("thread", F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        done, rest = steps.where("up is null"), steps.where("up is not null")
        moved = rest.join(above, ["thread", "up"]).select("thread", "id", F.col("next").alias("up"), F.concat("head", "path").alias("path"))
        k += 1
        done.unionByName(moved).write.parquet(f"{base}/{k}")
    keep = steps.where("up is null").select("thread", F.col("id").alias("_id"), "path")
    out = comments.withColumn("_id", F.col("id").cast("string")).join(keep, ["thread", "_id"]).drop("_id")
    path = scratch_path(spark, "placed")
    out.write.parquet(path)
    remove(spark, base)
    return spark.read.schema(out.schema).parquet(path)


def shown(comments: DataFrame, most: int = SHOWN) -> DataFrame:
    """(thread, place, id, depth, line): the first ``most`` comments that have a text, in reading order, as lines with their
    score and two spaces for each level. Deleted ones have no line, their replies keep their level."""
    body = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", ""))
    rows = placed(comments).withColumn("body", body).where((F.col("body") != "") & ~F.col("body").isin(*GONE))
    place = F.row_number().over(W.partitionBy("thread").orderBy("path"))
    first = rows.withColumn("place", place).where(F.col("place") <= most)
    depth = F.size("path") - 1
    line = F.concat(F.repeat(F.lit("  "), depth), F.format_string("[%+d] ", F.coalesce(F.col("score").cast("long"), F.lit(0))), "body")
    return first.select("thread", "place", "id", depth.alias("depth"), line.alias("line"))


def as_text(lines: DataFrame) -> DataFrame:
    """(thread, text): at most ``most`` lines of each thread meet."""
    return lines.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))


# Turns as comments: the first turn of a conversation answers that of the one before it, in threads of 40 conversations.
_ID, _THREAD = "conv_id * 100 + turn", "floor(conv_id / 40)"
_PARENT = "case when turn > 0 then conv_id * 100 + (turn * 7 + conv_id) % turn when conv_id % 40 > 0 then (conv_id - 1) * 100 end"
_KIND = "case when turn > 0 and (conv_id + turn * 3) % 11 = 0 then 'more' else 't1' end"
_BODY = "case when (conv_id + turn) % 7 = 0 then '[deleted]' else text end"


def _comments(spark, d):
    t = views.table(spark, d, "conversations")
    return t.selectExpr(f"cast({_THREAD} as bigint) as thread", f"{_ID} as id", f"{_PARENT} as parent", "-turn as ord", f"{_KIND} as kind", f"{_BODY} as body", "(conv_id * 31 + turn * 17) % 23 - 5 as score")


_SQL = f"""with recursive c as (select cast({_THREAD} as bigint) as thread, {_ID} as id, {_PARENT} as parent, -turn as ord, {_KIND} as kind, {_BODY} as body, (conv_id * 31 + turn * 17) % 23 - 5 as score from conversations),
  t(thread, id, path) as (
    select thread, id, [{{'o': ord, 'i': cast(id as varchar)}}] from c where parent is null and kind = 't1'
    union all select c.thread, c.id, list_append(t.path, {{'o': c.ord, 'i': cast(c.id as varchar)}}) from c join t on c.thread = t.thread and c.parent = t.id where c.kind = 't1'),
  b as (select c.thread, c.id, t.path, score, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as body from c join t on c.thread = t.thread and c.id = t.id),
  s as (select *, row_number() over (partition by thread order by path) as place from b where body not in ('', '[deleted]', '[removed]') qualify place <= 80)"""
QUERIES = {
    "comment_lines": (
        lambda s, d: shown(_comments(s, d)),
        f"{_SQL} select thread, cast(place as int) as place, id, cast(len(path) - 1 as int) as depth, repeat('  ', len(path) - 1) || '[' || case when score < 0 then '' else '+' end || score || '] ' || body as line from s",
    ),
    "comment_texts": (
        lambda s, d: as_text(shown(_comments(s, d))),
        f"{_SQL} select thread, string_agg(repeat('  ', len(path) - 1) || '[' || case when score < 0 then '' else '+' end || score || '] ' || body, chr(10) order by place) as text from s group by thread",
    ),
}
