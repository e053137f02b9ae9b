"""Planning of venues."""

from pyspark.sql import functions as F

from stemma.operators import planner, splitting
from stemma.sources.pages import parse_pages

PAPERS = "hash string, title string, snippet string, year int, conference_id long"


def papers(spark):
    rows = [(f"a{i}", f"A Foo Method {i}", "x", 2005, 1) for i in range(60)] + [(f"b{i}", f"A Bar Result {i}", "x", 2005, 1) for i in range(60)]
    rows += [(f"o{i}", f"Other venue {i}", None, 2005, 2) for i in range(30)] + [("a1", "A Foo Method 1", "x", 2005, 1)]
    return spark.createDataFrame(rows, PAPERS)


def keywords(spark, *words):
    return spark.createDataFrame([(w, i) for i, w in enumerate(words, 1)], "keyword string, rank int")


def year_of(spark, venue=1):
    return planner.venue_documents(papers(spark), venue, 2005, 2005)


def oracle(n, **more):
    return splitting.CountOracle({(k, 2005, 2005): v for k, v in n.items()}, **more)


SMALL = planner.Limits(max_results=100)


def test_year_is_resolved_and_verified(spark):
    counts = oracle({'"v" AND "foo"': 60, '"v" -"foo"': 60})
    ok, leaves = planner.plan_year(year_of(spark), '"v"', 2005, 120, keywords(spark, "foo", "bar"), counts, SMALL)
    assert ok and [(x.query, x.count) for x in leaves] == [('"v" AND "foo"', 60), ('"v" -"foo"', 60)]


def test_thin_or_unknown_years_are_not(spark):
    none = splitting.CountOracle({})
    assert planner.plan_year(year_of(spark, 2), '"v"', 2005, 900, keywords(spark, "foo"), none, SMALL) == (False, [])
    assert planner.plan_year(year_of(spark), '"v"', 2005, 120, keywords(spark, "foo", "bar"), none, SMALL) == (False, [])
    assert planner.plan_year(year_of(spark), '"v"', 2005, 120, keywords(spark, "foo", "bar"), splitting.CountOracle({}, budget=0), SMALL) == (False, [])


def test_bucket_at_the_cap_is_split_on(spark):
    counts = oracle({'"v" AND "bar"': 60, '"v" -"bar"': 100, '"v" -"bar" AND "foo"': 50})
    rows = [(f"a{i}", f"Bar {i}", "", 2005, 1) for i in range(60)] + [(f"b{i}", f"{'Foo' if i % 2 else 'Other'} {i}", "", 2005, 1) for i in range(60)]
    docs = planner.venue_documents(spark.createDataFrame(rows, PAPERS), 1)
    ok, leaves = planner.plan_year(docs, '"v"', 2005, 160, keywords(spark, "bar", "foo"), counts, planner.Limits(max_results=100, headroom=1.0))
    assert ok and [x.count for x in leaves] == [60, 50, 50] and all(x.count < 100 for x in leaves)


def test_root_that_covers_nearly_all_is_dropped(spark):
    counts = oracle({'"v" AND "foo"': 110, '"v" AND "bar"': 60, '"v" -"bar"': 60})
    ok, leaves = planner.plan_year(year_of(spark), '"v"', 2005, 120, keywords(spark, "foo", "bar"), counts, SMALL)
    assert ok and [x.query for x in leaves] == ['"v" AND "bar"', '"v" -"bar"']


def test_each_unresolved_node_is_mined_for_itself(spark):
    rows = [(f"a{i}", f"Foo {'red house' if i % 2 else 'old mill'} {i}", "", 2005, 1) for i in range(40)] + [(f"b{i}", f"Plain {i}", "", 2005, 1) for i in range(40)]
    docs = planner.venue_documents(spark.createDataFrame(rows, PAPERS), 1)
    o = planner.Limits(max_results=50, headroom=0.5, max_side_fraction=0.75)
    nodes = planner.Corpus.of(planner.texts(docs), keywords(spark, "foo")).grow({"foo": 1}, 20, o)
    assert [(n.resolved, n.size) for n in nodes] == [(False, 40), (False, 40)]
    more = planner.escalate(docs, nodes[0], keywords(spark, "foo"), {"foo": 1}, 20, o)
    assert all(n.resolved and n.size == 20 and n.includes[0] == "foo" and n.path[0] == "0" for n in more) and len(more) == 2
    assert planner.escalate(docs, nodes[1], keywords(spark, "foo", "plain"), {"foo": 1, "plain": 2}, 20, o)[0].resolved is False


def test_stored_partitions_are_reused_by_name(spark):
    t = lambda q, e, k=("k",), s="pending": (1, 1, q, 2016, 2016, list(k), 1, s, e, None)
    tasks = spark.createDataFrame([t('"v" AND "k"', 90), t('"v" -"k"', 70), t('"v"', 155, ()), t('"w" AND "k"', 9)], "id long, conference_id long, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate long, error string")
    years = spark.createDataFrame([(2016, 160)], "year int, count long")
    assert {(r.query, r["count"], r.needs_split) for r in planner.reused_leaves(tasks, '"v"', years, 80).collect()} == {('"v" AND "k"', 90, True), ('"v" -"k"', 70, False)}
    assert planner.reused_leaves(tasks, '"v"', spark.createDataFrame([(2016, 400)], "year int, count long"), 80).count() == 0


def test_stored_ranking_is_taken_for_the_same_corpus(spark):
    o = planner.Limits().mining
    mined, rows = planner.corpus_ranking(papers(spark), spark.createDataFrame([], "keyword string, score double, corpus_size long"), o)
    assert rows is not None and rows.count() == mined.count() > 0
    again, none = planner.corpus_ranking(papers(spark), rows, o)
    assert none is None and [r.keyword for r in again.orderBy("rank").collect()] == [r.keyword for r in mined.orderBy("rank").collect()]
    assert planner.corpus_ranking(papers(spark).limit(3), rows, o)[1] is not None


def test_pool_is_clean(spark):
    mined = keywords(spark, "foo", "foos", "value")
    texts = papers(spark).select("hash", F.concat_ws(" ", "title", "snippet").alias("text"))
    pool = planner.keyword_pool(mined, keywords(spark, "bar", "foo", "nowhere"), texts, F.lit('"Proceedings of Value"')).orderBy("rank").collect()
    assert [r.keyword for r in pool] == ["foo", "bar"]


def test_reuse_needs_all_of_the_count(spark):
    leaf = lambda i, year, e: (i, 1, "q", year, year, ["k"], 1, "pending", e, None)
    tasks = spark.createDataFrame([leaf(1, 2016, 90), leaf(2, 2016, 60), leaf(3, 2016, 50), leaf(4, 2017, 40), leaf(5, 2017, 40), leaf(6, 2018, 90), leaf(7, 2019, 90), leaf(8, 2019, None)], "id long, conference_id long, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate long, error string")
    counts = spark.createDataFrame([(1, 2016, 200), (1, 2017, 500)], "conference_id long, year int, count long")
    assert [(r.year, r.leaves, r.estimate) for r in planner.reusable_years(tasks, counts).collect()] == [(2016, 3, 200)]


def test_counts_of_pages_and_tasks(spark):
    html = '<div id="gs_ab_md">About 1,230 results</div><div id="gs_res_ccl"></div>'
    pages = spark.createDataFrame([("q", 2000, 2001, html), ("r", 2000, 2001, '<form id="captcha-form"></form>')], "query string, year_from int, year_to int, html string")
    assert [(r.query, r["count"]) for r in planner.counts_of_pages(parse_pages(pages)).collect()] == [("q", 1230)]
    leaves = spark.createDataFrame([("q", 2000, 2001, ["a"], 5, True)], "query string, year_from int, year_to int, keywords array<string>, count long, needs_split boolean")
    r = planner.leaves_to_tasks(leaves, 3, 4).collect()[0]
    assert r.error == "estimate 5 exceeds the 4-result cap"
    assert (r.status, r.page, r.total_results_estimate, r.conference_id) == ("needs_split", 1, 5, 3)


def test_veto_order_and_root():
    c = planner.Corpus([(["alpha", "beta"], 1), (["alpha"], 1)])
    allow = c.allow(0.5)
    assert allow((), (), "beta") and not allow((), (), "alpha") and allow(("gamma",), (), "beta") and not allow((), (), "delta")
    assert c.ranked(1.0)((), (), ["delta", "alpha", "beta"]) == ["beta", "delta", "alpha"] and c.ranked(1.0, ("gamma",))((), (), ["z", "a"]) == ["z", "a"]
    assert splitting.root_keyword([(("a", "b"), ()), ((), ("a",))]) == "a" and splitting.root_keyword([(("a",), ()), (("b",), ())]) is None
