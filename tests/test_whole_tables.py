import numpy as np
import pytest
from corpusloom.operators import pages, runs, search
from corpusloom.plans import catalogue
from corpusloom.sources import views


def test_links_are_made_of_every_vector(spark, sf):
    ids = [r.vec_id for r in views.table(spark, sf, "embeddings").select("vec_id").collect()]
    n = max(ids) + 1
    got = {(r.src, r.dst) for r in runs._all_links(spark, sf).collect()}
    assert n > 200 and got == {(i, (7 * i + 3) % n) for i in ids if i != (7 * i + 3) % n}
    ends = {(r.src, r.dst) for r in catalogue.queries()["links_for_run_all"](spark, sf).collect()}
    assert ends == {p for p in got if 205 in p} and max(s for s, _ in ends) >= 200
    others = {r.other for r in catalogue.queries()["related_link_labels_all"](spark, sf).collect()}
    assert others == {x for p in ends for x in p} - {205}


def test_every_20th_row_is_searched(spark, sf):
    ids = [r.vec_id for r in views.table(spark, sf, "embeddings").select("vec_id").collect()]
    got = catalogue.queries()["vector_topk_all"](spark, sf).collect()
    asked = {i for i in ids if i % 20 == 0}
    assert len(asked) > 3 and {r.q for r in got} == asked and len(got) == 20 * len(asked)


@pytest.mark.parametrize("block", [4, 1000])
def test_search_in_blocks_equals_the_search_of_a_stated_set(spark, block, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 7)
    made = np.random.default_rng(5).integers(-2, 3, (60, 3)).astype(float).tolist()  # many ties, some zero vectors
    rows = [(i, v) for i, v in enumerate(made)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, None, 2.0])]
    vectors = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    queries = vectors.where("id % 4 = 0 or id > 59").selectExpr("id as q", "embedding as vector")
    key = lambda df: sorted((r.q, r.rank, r.id, r.score) if r.score is not None else (r.q, r.rank, r.id, -9) for r in df.collect())
    for k in (5, 70):
        assert key(search.vector_topk_of_many(vectors, queries, k, block=block)) == key(search.vector_topk(vectors, queries, k))
    assert search.vector_topk_of_many(vectors, queries.where("false"), 5).count() == 0
    assert search.vector_topk_of_many(vectors.where("false"), queries, 5).count() == 0


def test_every_page_reaches_the_merge_of_feeds(spark, sf):
    n = views.table(spark, sf, "pages").count()
    feeds = pages._feeds(spark, sf, "page_id div 20")
    assert feeds.count() == -(-n // 20) and pages.feed_entries(feeds).count() == n
    wanted = {r.url for r in views.table(spark, sf, "pages").where("page_id % 9 >= 2").select("url").collect()}
    assert {r.link for r in catalogue.queries()["feed_union_all"](spark, sf).collect()} == wanted
