"""Operators of the store, mining, partitioning, merge and diff on small fixtures."""

import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from stemma.operators import diff, dml, merge, mining, partition, splitting, stats


# ---- differences between copies


def test_diff_all_cases(spark):
    a = spark.createDataFrame([(1, " A ", 1, 9), (2, "b", None, 9), (3, None, 0, 9), (4, "d", 4, 9), (5, "e", 5, 9), (None, "n", 1, 9), (4, "d", 4, 9)], "id long, s string, n int, diffs int")
    b = spark.createDataFrame([(1, "a\t", 1), (2, "b", 0), (3, None, 0), (5, "x", 6), (6, "new", 1), (None, "N", 2), (5, "x", 6)], "id long, s string, n int")
    got = {(r.row_id, r.finding) for r in diff.findings(diff.table_diff(a, b, "id", {"s": None, "n": None}), "t").collect()}
    assert got == {(2, "n"), (4, "only_main"), (5, "s"), (5, "n"), (6, "only_copy"), (None, "n")}
    shown = [r for r in diff.table_diff(a, b, "id", {"s": None, "n": None}).collect() if r.key == 5][0]
    assert [tuple(d) for d in shown.diffs] == [("s", "e", "x"), ("n", "5", "6")] and shown.side == "both"


def test_diff_empty_and_long(spark):
    a = spark.createDataFrame([(1, "x" * 100_000)], "id long, s string")
    none = spark.createDataFrame([], "id long, s string")
    find = lambda l, r: diff.findings(diff.table_diff(l, r, "id", {"s": None}), "t").collect()
    assert find(none, none) == [] and find(a, a) == []
    assert [r.finding for r in find(a, none)] == ["only_main"] and [r.finding for r in find(none, a)] == ["only_copy"]


def test_diff_disagreeing_deliveries(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id long, s string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (1, "x")], "id long, s string")
    assert diff.table_diff(a, b, "id", {"s": None}).count() == 0
    assert diff.table_diff(a, b.filter("s = 'x'"), "id", {"s": None}).count() == 1


# ---- mining


def docs(spark, texts):
    return spark.createDataFrame([(f"h{i:04}", t, "") for i, t in enumerate(texts)], "hash string, title string, snippet string")


def test_mine_words_and_empty(spark):
    d = docs(spark, ["federated learning"] * 4 + ["centralized training"] * 4 + ["other topic"] * 2)
    got = mining.mine(d, mining.MiningOptions(min_freq=2)).collect()
    assert {r.keyword for r in got} >= {"federated", "learning", "centralized", "training"} and got[0].balance == 0.8
    assert mining.mine(docs(spark, []).limit(0)).collect() == []


def test_phrase_boost_and_stop_words(spark):
    d = docs(spark, ["federated learning"] * 2 + ["centralized models"] * 2)
    plain = [r.keyword for r in mining.mine(d, mining.MiningOptions(min_freq=2, longest=2)).orderBy("rank").collect()]
    boosted = [r.keyword for r in mining.mine(d, mining.MiningOptions(min_freq=2, longest=2, phrase_boost=2.0)).orderBy("rank").collect()]
    assert plain.index("learning") < plain.index("federated learning") or plain[0] != "federated learning"
    assert boosted.index("federated learning") < boosted.index("learning")


def test_idf_sinks_generic(spark):
    target = docs(spark, ["rare"] * 4 + ["generic"] * 4)
    back = docs(spark, ["generic thing"] * 99 + ["generic rare"])
    got = mining.mine_idf(target, back).orderBy("rank").collect()
    assert got[0].keyword == "rare" and got[0].idf > got[1].idf
    assert {r.idf for r in mining.mine_idf(target, back.limit(0)).collect()} == {1.0}


def test_drop_contained_follows_rank(spark):
    ranked = spark.createDataFrame([("model", 1), ("models", 2), ("large", 3), ("large language", 4), ("transformer", 5)], "keyword string, rank int")
    assert {r.keyword for r in mining.drop_contained(ranked).collect()} == {"models", "large", "large language", "transformer"}
    assert {r.keyword for r in mining.drop_contained(ranked, kept_first=True).collect()} == {"model", "large", "large language", "transformer"}


# ---- partitioning


def parts(spark, texts, limit, keywords, **more):
    d = spark.createDataFrame([("g", f"h{i:04}", t) for i, t in enumerate(texts)], "grp string, hash string, text string")
    k = spark.createDataFrame([(w, i) for i, w in enumerate(keywords, 1)], "keyword string, rank int")
    placed, nodes = partition.partition(d, k, limit, **more)
    return placed.collect(), nodes.orderBy("path").collect()


def test_two_keywords(spark):
    placed, nodes = parts(spark, ["alpha beta"] * 3 + ["alpha"] * 3 + ["beta"] * 3 + ["common only"] * 3, 5, ["alpha", "beta"])
    assert [n.size for n in nodes] == [3, 3, 3, 3] and all(n.resolved for n in nodes)
    assert nodes[0].includes == ["alpha", "beta"] and nodes[-1].excludes == ["alpha", "beta"]
    assert len({p.hash for p in placed}) == len(placed) == 12


def test_infeasible_and_conditional(spark):
    _, nodes = parts(spark, ["same"] * 10, 5, ["alpha"])
    assert [(n.size, n.resolved) for n in nodes] == [(10, False)]
    _, nodes = parts(spark, ["alpha loppy even"] * 5 + ["alpha loppy"] * 4 + ["alpha"] + ["plain"] * 10, 5, ["alpha", "loppy", "even"])
    assert {(n.size, n.resolved) for n in nodes} == {(5, True), (10, False)} and not any("loppy" in n.includes + n.excludes for n in nodes)


def test_fits_keeps_node_whole(spark):
    fits = lambda inc, exc: (inc, exc) in (((), ("alpha",)), ((), ()))
    _, nodes = parts(spark, ["alpha beta"] * 3 + ["alpha"] * 3 + ["beta"] * 3 + ["common only"] * 3, 5, ["alpha", "beta"], fits=fits)
    assert [n.size for n in nodes] == [3, 3, 6]


@pytest.mark.parametrize("fits", [None, lambda inc, exc: len(inc) == 2])
def test_big_nodes_are_split_in_spark_the_same(spark, monkeypatch, fits):
    rnd = random.Random(3)
    texts = [" ".join(w for w in ("aa", "bb", "cc", "dd ee", "ff", "gg") if rnd.random() < 0.4) for _ in range(120)]
    words = ["gg", "aa", "bb", "cc", "dd ee", "ff", "zz"]
    whole = parts(spark, texts, 9, words, min_balance=0.1, boost=1.5, fits=fits)
    for most in (1, 7):
        monkeypatch.setattr(partition, "MOST_ATOMS", most)
        again = parts(spark, texts, 9, words, min_balance=0.1, boost=1.5, fits=fits)
        assert again[1] == whole[1] and sorted(again[0]) == sorted(whole[0])


def test_groups_are_apart_and_rows_without_one_are_left_out(spark):
    d = spark.createDataFrame([(g, f"{g}{i}", "aa" if i % 2 else "bb", "x") for g in (1, 2) for i in range(6)] + [(None, "n", "aa", "x"), (1, None, "aa", "x"), (2, "20", "bb", "y")], "grp int, hash string, text string, path string")
    k = spark.createDataFrame([("aa", 1), ("aa", 2)], "keyword string, rank int")
    placed, nodes = partition.partition(d, k, 3)
    assert sorted((n.grp, n.path, n.size) for n in nodes.collect()) == [(g, p, 3) for g in (1, 2) for p in "01"] and placed.count() == 12
    placed, nodes = partition.partition(d.limit(0), k, 3)
    assert placed.count() == nodes.count() == 0
    _, nodes = partition.partition(d, k.limit(0), 3)
    assert {n.resolved for n in nodes.collect()} == {False}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_partition_invariants(spark, seed):
    rnd = random.Random(seed)
    texts = [" ".join(w for w in ("aa", "bb", "cc", "dd") if rnd.random() < 0.5) for _ in range(rnd.randint(1, 60))]
    limit = rnd.randint(3, 15)
    placed, nodes = parts(spark, texts, limit, ["aa", "bb", "cc", "dd"])
    assert sorted(p.hash for p in placed) == [f"h{i:04}" for i in range(len(texts))]
    assert all(n.size <= limit for n in nodes if n.resolved) and sum(n.size for n in nodes) == len(texts)


# ---- splitting against counts


def fake(counts):
    return splitting.CountOracle({(k, 0, 0): v for k, v in counts.items()})


def test_split_stops_at_clean_split():
    c = fake({'b AND "learning"': 700, 'b AND "neural"': 600})
    ok, leaves = splitting.split_leaf("b", (0, 0), 1200, ["learning", "neural"], c, 1000, 0.1)
    assert ok and [x.count for x in leaves] == [700, 500] and len(c.trace) == 1


def test_split_forced_chain():
    c = fake({'b AND "big"': 1400, 'b AND "fix"': 1450, 'b AND "big" AND "fix"': 600})
    ok, leaves = splitting.split_leaf("b", (0, 0), 1500, ["big", "fix"], c, 1000, 0.1, probes=2)
    assert ok and [x.count for x in leaves] == [600, 800, 100]


def test_split_universe_is_disjoint():
    has = {"neural": lambda i: i % 19 < 10, "attention": lambda i: i % 31 < 20, "graph": lambda i: i % 50 < 9}
    import re

    def count(q, *_):
        inc, exc = re.findall(r'AND "(\w+)"', q), re.findall(r'-"(\w+)"', q)
        return sum(all(has[w](i) for w in inc) and not any(has[w](i) for w in exc) for i in range(2500))

    ok, leaves = splitting.split_leaf("b", (0, 0), 2500, list(has), count, 1000, 0.05, probes=6)
    assert ok and sum(x.count for x in leaves) == 2500 and all(x.count <= 1000 for x in leaves)


def test_split_fails_without_division():
    ok, leaves = splitting.split_leaf("b", (0, 0), 3000, ["learning", "neural"], fake({'b AND "learning"': 3000, 'b AND "neural"': 0}), 1000)
    assert not ok and leaves == []


def test_year_windows(spark):
    names = spark.createDataFrame([("q",)], "query string")
    counts = spark.createDataFrame([("q", 2000, 2001, 150), ("q", 2000, 2000, 90), ("q", 2001, 2001, 120), ("q", 2002, 2003, 80)], "query string, year_from int, year_to int, count long")
    got = {(r.year_from, r.year_to, r["count"], r.needs_split) for r in splitting.year_windows(names, 2000, 2004, counts, 100).collect()}
    assert got == {(2000, 2000, 90, False), (2001, 2001, 120, True), (2002, 2003, 80, False), (2004, 2004, None, True)}
    assert splitting.year_windows(names, 2005, 2004, counts, 100).count() == 0


# ---- writes and merge


TASKS = "id long, conference_id long, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate long, error string"


def test_upsert_tasks(spark):
    cur = spark.createDataFrame([(1, 1, "a", 2000, 2001, [], 31, "needs_split", 545, None), (2, 1, "b", 2000, 2001, [], 4, "completed", 10, None), (3, 1, "c", 2000, 2001, [], 4, "pending", 10, None)], TASKS)
    plan = spark.createDataFrame([(9, 1, "a", 2000, 2001, [], 1, "pending", 251, None), (9, 1, "b", 2000, 2001, [], 1, "needs_split", 999, None), (7, 1, "n", 2000, 2001, None, 1, "pending", 5, None)], TASKS)
    rows = dml.upsert_tasks(cur, plan).collect()
    got = {r.query: (r.status, r.page, r.total_results_estimate) for r in rows}
    assert got == {"a": ("pending", 1, 251), "b": ("completed", 4, 999), "c": ("pending", 4, 10), "n": ("pending", 1, 5)}
    assert {r.query: r.id for r in rows if r.query != "n"} == {"a": 1, "b": 2, "c": 3} and len({r.id for r in rows}) == 4


def test_paper_heal(spark):
    rows = [(1, "h", "t", "a", 2000, None, None, "u", "s", 0, 5, None), (2, "h", "T2", "a2", 2001, "x", 9, "u", "s", 3, 6, "crawl")]
    df = spark.createDataFrame(rows, "seq long, hash string, title string, authors string, year int, snippet string, citations long, source_url string, scholar_id string, task_id long, conference_id long, sourced_from string").withColumns({"raw_html": F.lit(""), "scraped_at": F.lit(None).cast("timestamp")})
    r = dml.heal_papers(df).collect()[0]
    assert (r.title, r.citations, r.task_id, r.conference_id, r.sourced_from) == ("t", 0, 3, 5, "crawl")


def test_link_delta(spark):
    links = spark.createDataFrame([("h1", 1)], "hash string, task_id long")
    new = spark.createDataFrame([("h1", 1), ("h2", 1), ("h2", 1), ("h3", 2)], "hash string, task_id long")
    assert {(r.task_id, r.added) for r in dml.link_delta(links, new).collect()} == {(1, 1), (2, 1)}


def test_merge_is_idempotent(spark):
    own = spark.createDataFrame([(1, 1, "a", 2000, 2001, ["k"], 1, "pending", 0, None), (2, 1, "b", 2000, 2001, None, 5, "completed", 7, None)], TASKS)
    other = spark.createDataFrame([(11, 1, "a", 2000, 2001, ["k"], 4, "completed", 30, "e"), (12, 1, "b", 2000, 2001, None, 9, "running", 9, None), (13, 1, "c", 2000, 2001, [], 1, "running", None, None)], TASKS)
    once = merge.merge_tasks(own, other)
    got = {r.query: (r.status, r.page, r.total_results_estimate, r.error, r.change) for r in once.collect()}
    assert got == {"a": ("completed", 4, 30, "e", "updated"), "b": ("completed", 9, 7, None, "updated"), "c": ("pending", 1, None, None, "added")}
    assert {r.change for r in merge.merge_tasks(once.drop("change"), other).collect()} == {"same"}


def test_replace_plan_and_requeue(spark):
    cur = spark.createDataFrame([(1, 1, "a", 2000, 2001, [], 1, "pending", 0, "x"), (2, 1, "b", 2000, 2001, [], 1, "needs_split", 0, None), (3, 1, "al AND \"x\"", 2000, 2001, [], 1, "pending", 0, None), (4, 1, "d", 2000, 2001, [], 1, "error", 0, "bad")], TASKS)
    keep = cur.limit(0)
    pages = spark.createDataFrame([(2,)], "task_id long")
    names = spark.createDataFrame([(1, "al")], "conference_id long, query string")
    assert {(r.id, r.action) for r in dml.replace_plan(cur, keep, pages, names).collect()} == {(1, "deleted"), (2, "superseded")}
    assert {(r.id, r.status, r.error) for r in dml.requeue(cur, ("error",), True).collect()} >= {(4, "pending", None), (1, "pending", "x")}


def test_run_lengths_and_stall(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 0, 0, 1, 0])], "k string, o int, v int").withColumn("r", F.col("v") == 1)
    assert [x.run for x in stats.run_lengths(df, "k", "o", "r").orderBy("o").collect()] == [0, 1, 2, 0, 1]
    assert [x.o for x in stats.stalled(df, "k", "o", "v").collect()] == [2]


def test_newest_wins_only_if_newer(spark):
    t = lambda d: datetime(2020, 1, d)
    own = spark.createDataFrame([("q", 1, t(2)), ("r", 1, t(2))], "q string, n int, at timestamp")
    other = spark.createDataFrame([("q", 2, t(2)), ("r", 2, t(3)), ("s", 3, t(1))], "q string, n int, at timestamp")
    assert {(r.q, r.n) for r in dml.newest(own, other, ["q"], "n", "at").collect()} == {("q", 1), ("r", 2), ("s", 3)}


def test_many_keywords_by_automaton(spark, monkeypatch):
    d = spark.createDataFrame([("a", "Alpha beta"), ("b", None), ("c", "GAMMA alphabet"), ("d", "")], "hash string, text string")
    k = spark.createDataFrame([("alpha",), ("Beta",), ("amma",), ("nowhere",), ("alpha",)], "keyword string")
    few = sorted(map(tuple, mining.membership(d, k).collect()))
    monkeypatch.setattr(mining, "MOST_KEYWORDS", 2)
    assert sorted(map(tuple, mining.membership(d, k).collect())) == few == [("a", "Beta"), ("a", "alpha"), ("c", "alpha"), ("c", "amma")]


def test_viable_without_texts_keeps_all(spark):
    d = spark.createDataFrame([], "hash string, text string")
    assert {r.keyword for r in mining.viable(d, spark.createDataFrame([("x",), ("y",)], "keyword string"), 0.5).collect()} == {"x", "y"}


TASKS = "id long, conference_id long, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate long, error string"


def task(i, query, status="pending", page=1, estimate=5, error=""):
    return (i, 1, query, 2000, 2000, [], page, status, estimate, error)


def test_merged_tasks_have_ids_of_their_own(spark):
    own = spark.createDataFrame([task(5, "q")], TASKS)
    other = spark.createDataFrame([task(5, "r"), task(6, "q"), task(7, "s", "running")], TASKS)
    merged = merge.merge_tasks(own, other)
    rows = {r.query: r for r in merged.collect()}
    assert rows["q"].id == 5 and len({r.id for r in rows.values()}) == 3 and rows["s"].status == "pending"
    assert {r.src_id: r.dst_id for r in merge.task_map(merged, other).collect()} == {5: rows["r"].id, 6: 5, 7: rows["s"].id}
    taken = spark.createDataFrame([task(rows["r"].id, "q")], TASKS)  # an own task that has the id made for another
    again = merge.merge_tasks(taken, other).collect()
    assert len({r.id for r in again}) == 3 and {r.id for r in again if r.query == "q"} == {rows["r"].id}


def test_merged_papers_take_mapped_tasks_and_fill_markup(spark):
    form = "hash string, title string, year int, citations long, task_id long, conference_id long, sourced_from string, raw_html string, scraped_at timestamp"
    t = datetime(2020, 1, 1)
    own = spark.createDataFrame([("a", "T", 1, 3, None, 1, "plan", "", t)], form)
    other = spark.createDataFrame([("a", "T", 1, 2, 5, 1, "crawl", "<p>", None), ("b", "U", 1, None, 9, 1, "crawl", "<q>", t)], form)
    tasks = spark.createDataFrame([(5, 50)], "src_id long, dst_id long")
    got = {r.hash: (r.citations, r.task_id, r.sourced_from, r.raw_html, r.scraped_at, r.change) for r in merge.merge_papers(own, other, tasks).collect()}
    assert got == {"a": (3, 50, "crawl", "<p>", t, "same"), "b": (0, None, "plan", "<q>", t, "added")}


def test_upsert_overwrites_the_estimate(spark):
    cur, plan = spark.createDataFrame([task(1, "q", estimate=10), task(2, "r", estimate=3)], TASKS), spark.createDataFrame([task(None, "q", estimate=0), task(None, "n")], TASKS)
    assert {(r.query, r.total_results_estimate) for r in dml.upsert_tasks(cur, plan).collect()} == {("q", 0), ("r", 3), ("n", 5)}


def test_healing_keeps_markup_and_time(spark):
    t = lambda d: datetime(2020, 1, d)
    rows = [(2, "h", "second", None, "<2>", t(1)), (1, "h", "first", 7, "<1>", t(5))]
    s = spark.createDataFrame(rows, "seq long, hash string, title string, task_id long, raw_html string, scraped_at timestamp")
    for c, kind in (("authors", "string"), ("year", "int"), ("snippet", "string"), ("source_url", "string"), ("scholar_id", "string"), ("citations", "long"), ("conference_id", "long"), ("sourced_from", "string")):
        s = s.withColumn(c, F.lit(None).cast(kind))
    r = dml.heal_papers(s).collect()[0]
    assert (r.title, r.raw_html, r.scraped_at, r.task_id, r.sourced_from) == ("first", "<1>", t(5), 7, "crawl")


def test_task_changes_and_stale_tasks(spark):
    cur = spark.createDataFrame([task(1, "a"), task(2, "b"), task(3, "c", "completed", estimate=9)], TASKS)
    changes = spark.createDataFrame([(1, "running", None, None), (2, None, None, 4)], "id long, status string, error string, page int")
    assert {(r.id, r.status, r.page) for r in dml.change_tasks(cur, changes).collect()} == {(1, "running", 1), (2, "pending", 4), (3, "completed", 1)}
    actions = spark.createDataFrame([(1, "deleted"), (2, "superseded")], "id long, action string")
    papers = spark.createDataFrame([("h", 1), ("k", 2), ("m", None)], "hash string, task_id long")
    kept, freed = dml.drop_stale(cur, papers, actions)
    assert {(r.id, r.status) for r in kept.collect()} == {(2, "superseded"), (3, "completed")} and {(r.hash, r.task_id) for r in freed.collect()} == {("h", None), ("k", 2), ("m", None)}
    short = spark.createDataFrame([(3, 2, 9)], "id long, got long, total_results_estimate long")
    r = [x for x in dml.judge_completed(cur, short).collect() if x.id == 3][0]
    assert (r.status, r.error) == ("incomplete", "under-delivered: got 2 of ~9 estimated results") and dml.requeued(cur, ("pending",)) == 2


def test_diff_of_text_keys(spark):
    a = spark.createDataFrame([("a", 1), ("", 2), (None, 3)], "id string, n int")
    b = spark.createDataFrame([("a", 2), ("", 2)], "id string, n int")
    assert {(r.row_id, r.finding) for r in diff.findings(diff.table_diff(a, b, "id", {"n": None}), "t").collect()} == {("a", "n"), (None, "only_main")}


def test_limit_of_keywords(spark):
    d = docs(spark, ["alpha"] * 4 + ["beta"] * 4)
    n = lambda most: mining.mine(d, mining.MiningOptions(most=most)).count()
    assert (n(0), n(1), n(-1)) == (0, 1, 2)


def test_cached_counts_and_other_names(spark):
    wanted = spark.createDataFrame([("q", 1, 2), ("r", 1, 2)], "query string, year_from int, year_to int")
    cache = spark.createDataFrame([("q", 1, 2, 5)], "query string, year_from int, year_to int, count long")
    assert {(r.query, r["count"]) for r in stats.cached_counts(wanted, cache).collect()} == {("q", 5), ("r", None)}
    named = spark.createDataFrame([(1, "A", ["a", "b", "c"])], "id long, name string, names array<string>")
    assert stats.other_names(named, "b").collect()[0].others == ["a", "c"]
