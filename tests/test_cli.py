"""The command line's steps over two small stores."""

import json
from datetime import datetime

import pytest

from stemma import __main__ as cli
from stemma.sources import config
from stemma.store import Store

NOW = datetime(2024, 1, 1)


def filled(spark, root, mine):
    s = Store(spark, root)
    settings = config.parse(json.dumps({"start_year": 2020, "end_year": 2023, "max_results": 100, "conferences": [{"name": "A", "query": '"A"', "aliases": ['"Old A"']}] + ([] if mine else [{"name": "B", "query": '"B"'}])}))
    cli.seed(s, settings)
    ids = {r.name: r.id for r in s.read("conferences").collect()}
    tasks = [(1, ids["A"], '"A"', 2020, 2021, [], 1 if mine else 4, "pending" if mine else "completed", 5, None)] + ([] if mine else [(2, ids["B"], '"B"', 2020, 2021, [], 1, "running", 5, None)])
    papers = [("h1", "T", "", 2020, "" if mine else "text", 3 if mine else 5, 1, ids["A"], "crawl", NOW)] + ([] if mine else [("h2", "U", "", 2020, "x", 1, 2, ids["B"], "crawl", NOW)])
    s.commit(
        tasks=spark.createDataFrame(tasks, "id long, conference_id long, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate long, error string"),
        papers=spark.createDataFrame(papers, "hash string, title string, authors string, year int, snippet string, citations long, task_id long, conference_id long, sourced_from string, scraped_at timestamp"),
        page_html=spark.createDataFrame([(1, 1, "own" if mine else "other", NOW), (1, 2, "more", NOW)][: 1 if mine else 2], "task_id long, page_number int, html string, scraped_at timestamp"),
        count_cache=spark.createDataFrame([('"A"', 2020, 2021, 90, NOW)], "query string, year_from int, year_to int, count long, updated_at timestamp"),
    )
    return s, settings


def test_merge_twice(spark, tmp_path):
    own, settings = filled(spark, str(tmp_path / "a"), True)
    other, _ = filled(spark, str(tmp_path / "b"), False)
    first = {(r.tbl, r.change): r.n for r in cli.merge_stores(own, own.attach(str(tmp_path / "b"))).collect()}
    want = {("tasks", "updated"): 1, ("tasks", "added"): 1, ("papers", "same"): 1, ("papers", "added"): 1, ("conferences", "same"): 1, ("conferences", "added"): 1, ("page_html", "same"): 1, ("page_html", "added"): 1, ("count_cache", "same"): 1}
    assert first == want
    t = {r.query: (r.status, r.page) for r in own.read("tasks").collect()}
    assert t == {'"A"': ("completed", 4), '"B"': ("pending", 1)}
    p = {r.hash: (r.snippet, r.citations, r.sourced_from, r.task_id is not None) for r in own.read("papers").collect()}
    assert p == {"h1": ("text", 5, "crawl", True), "h2": ("x", 1, "crawl", True)}
    assert {(r.page_number, r.html) for r in own.read("page_html").collect()} == {(1, "own"), (2, "more")}
    assert own.read("paper_tasks").count() == 0
    other.commit(paper_tasks=spark.createDataFrame([("h1", 1)], "hash string, task_id long"))
    assert ("paper_tasks", "added", 1) in {tuple(r) for r in cli.merge_stores(own, own.attach(str(tmp_path / "b")), links=True).collect()}
    again = {r.change for r in cli.merge_stores(own, own.attach(str(tmp_path / "b"))).collect()}
    assert again == {"same"} and own.read("conferences").count() == 2


def test_generated_plan_and_selection(spark, tmp_path):
    own, settings = filled(spark, str(tmp_path / "c"), True)
    venue = cli.select(own.read("conferences"), "A").collect()[0]
    plan = {(r.query, r.year_from, r.year_to, r.status) for r in cli.generate(own, venue, settings).collect()}
    assert plan == {('"A"', 2020, 2021, "pending"), ('"A"', 2022, 2023, "needs_split"), ('"Old A"', 2020, 2021, "needs_split"), ('"Old A"', 2022, 2023, "needs_split")}
    with pytest.raises(SystemExit, match="known: A"):
        cli.select(own.read("conferences"), "Z")


def test_plan_of_over_full_years_and_stale_tasks(spark, tmp_path):
    s = Store(spark, str(tmp_path / "d"))
    settings = config.parse(json.dumps({"start_year": 2020, "end_year": 2021, "max_results": 100, "keywords": ["foo", "bar"], "conferences": [{"name": "V", "query": '"V"'}]}))
    cli.seed(s, settings)
    venue = s.read("conferences").collect()[0]
    papers = [(f"a{i}", f"A Foo Method {i}", "", 2020, "x", 0, None, venue.id, "plan", NOW) for i in range(60)] + [(f"b{i}", f"A Bar Result {i}", "", 2020, "x", 0, 8, venue.id, "plan", NOW) for i in range(60)]
    counts = [('"V"', 2020, 2021, 150), ('"V"', 2020, 2020, 120), ('"V"', 2021, 2021, 30)] + [(f'"V"{q}', 2020, 2020, 60) for q in (' AND "foo"', ' -"foo"', ' AND "bar"', ' -"bar"', ' AND "method"', ' -"method"', ' AND "result"', ' -"result"', ' AND "foo method"', ' -"foo method"', ' AND "bar result"', ' -"bar result"')]
    s.commit(
        papers=spark.createDataFrame(papers, "hash string, title string, authors string, year int, snippet string, citations long, task_id long, conference_id long, sourced_from string, scraped_at timestamp"),
        count_cache=spark.createDataFrame([(*c, NOW) for c in counts], "query string, year_from int, year_to int, count long, updated_at timestamp"),
        tasks=spark.createDataFrame([(8, venue.id, '"V" AND "old"', 2020, 2020, ["old"], 1, "pending", 5, None), (9, venue.id, '"V" AND "seen"', 2020, 2020, ["seen"], 3, "pending", 5, None)], "id long, conference_id long, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate long, error string"),
        page_html=spark.createDataFrame([(9, 1, "x", NOW)], "task_id long, page_number int, html string, scraped_at timestamp"),
    )
    cli.emit(s, venue, cli.generate(s, venue, settings))
    tasks = s.read("tasks").collect()
    year = [t for t in tasks if t.year_from == 2020 and t.status == "pending"]
    assert len(year) == 2 and all(t.total_results_estimate == 60 and len(t.keywords) == 1 for t in year)
    assert {(t.query, t.status) for t in tasks if t not in year} == {('"V"', "pending"), ('"V" AND "seen"', "superseded")}
    assert s.read("papers").filter("task_id = 8").count() == 0 and len({t.id for t in tasks}) == len(tasks)
    before = {(t.id, t.query) for t in tasks}
    cli.emit(s, venue, cli.generate(s, venue, settings))  # the stored partition is reused
    assert {(t.id, t.query) for t in s.read("tasks").collect()} == before


def test_backfill_judges_again(spark, tmp_path):
    s = Store(spark, str(tmp_path / "e"))
    row = lambda i, st, n: (i, 1, "q", 2000, 2000, [], 2, st, n, None)
    s.commit(tasks=spark.createDataFrame([row(1, "completed", 100), row(2, "completed", None), row(3, "pending", 100)], "id long, conference_id long, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate long, error string"))
    assert [r.id for r in cli.backfill(s, 0.5).collect()] == [1]
    assert {(t.id, t.status) for t in s.read("tasks").collect()} == {(1, "incomplete"), (2, "completed"), (3, "pending")}
