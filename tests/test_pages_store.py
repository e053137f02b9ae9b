"""Recorded pages, the store, the configuration and the page walk."""

import json

import pytest
from pyspark.sql import functions as F

from stemma.operators import merge
from stemma.sources import config
from stemma.sources.pages import fingerprints, harvested, page_papers, parse_page, parse_pages, replay_links
from stemma.store import Store
from stemma.streaming import pagewalk


def row(i, cites=""):
    return f'<div class="gs_r gs_or" data-cid="c{i}"><h3 class="gs_rt"><a href="http://x/{i}">Title&nbsp;{i}</a></h3><div class="gs_a">Author {i} - Venue, 2005</div><div class="gs_rs">Some <b>text</b></div>{cites}</div>'


def page(items, head="About 1,230 results", more=True):
    pager = '<div id="gs_n"><a href="/s?start=10"><span class="gs_ico_nav_next"></span></a></div>' if more else ""
    return f'<html><div id="gs_ab_md">{head}</div>{"".join(items)}{pager}</html>'


def test_items_and_facts():
    p = parse_page(page([row(1, '<a href="?cites=9">Cited by 12345</a>'), row(2)]))
    assert [x["title"] for x in p["items"]] == ["Title 1", "Title 2"] and p["has_next"] and not p["blocked"]
    assert p["items"][0]["raw_html"].startswith('<div class="gs_r') and p["items"][0]["raw_html"].endswith("</div>")
    variant = '<div class="gs_r gs_or"><div class="gs_rt"><span class="gs_ctu">[C]</span> Bare </div></div><div class="gs_r gs_or"><div class="gs_ri"><h3>Head</h3></div></div><div class="gs_r gs_or">none</div>'
    p = parse_page(page([variant], more=False))
    assert [(x["title"], x["citation_only"]) for x in p["items"]] == [("Bare", True), ("Head", True)] and not p["has_next"]


def test_refusals():
    assert parse_page('<form id="captcha-form"></form>')["challenge"]
    for html in ('<div class="g-recaptcha"></div>', "<p>Our systems have detected unusual traffic</p>", '<div id="sorry">x</div>'):
        assert parse_page(html)["blocked"] and not parse_page(html)["items"]
    assert not parse_page(page([row(1)]) + "unusual traffic")["blocked"]
    for html in (None, "", "<a <b>>", "<div" * 2000):
        assert parse_page(html)["items"] == []


def test_pages_to_papers(spark):
    pages = spark.createDataFrame([(1, 1, page([row(1), row(2)])), (1, 2, page([row(2)])), (2, 1, page([], "x", False)), (3, 1, None)], "task_id long, page_number int, html string")
    parsed = parse_pages(pages)
    assert {(r.task_id, r.page_number): r["count"] for r in parsed.collect()} == {(1, 1): 1230, (1, 2): 1230, (2, 1): 0, (3, 1): None}
    assert {(r.title, r.year, r.venue) for r in page_papers(parsed).collect()} == {("Title 1", 2005, "Venue"), ("Title 2", 2005, "Venue")}
    assert replay_links(parsed).count() == 2


def test_store_commits_together(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"))
    assert s.read("tasks").count() == 0
    s.commit(conferences=spark.createDataFrame([(1, "n", "q")], "id long, name string, query string"))
    assert s.read("conferences").collect()[0].type == "conference"
    s.commit(conference_aliases=spark.createDataFrame([(1, "x", 1)], "conference_id long, query string, ord int"))
    assert s.read("conferences").count() == 1 and s.read("conference_aliases").count() == 1
    with pytest.raises(ValueError):
        s.attach(str(tmp_path / "a"))
    other = s.attach(str(tmp_path / "b"))
    merged = merge.merge_conferences(s.read("conferences"), other.read("conferences"))
    assert merged.count() == 1


def test_store_upserts_compacts_and_forgets(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"))
    form = "hash string, task_id long, citations long"
    s.commit(papers=spark.createDataFrame([("a", 1, 1), ("b", None, 2)], form))
    s.commit({"papers": spark.createDataFrame([("b", 7, 3), ("c", None, 4)], form)}, conferences=spark.createDataFrame([(1, "n", "q")], "id long, name string, query string"))
    s.commit({"papers": spark.createDataFrame([("b", None, 5)], form)})
    rows = lambda: {(r.hash, r.task_id, r.citations) for r in s.read("papers").collect()}
    assert rows() == {("a", 1, 1), ("b", None, 5), ("c", None, 4)} and len(s.versions()["papers"]) == 3
    s.compact(most=2)
    assert rows() == {("a", 1, 1), ("b", None, 5), ("c", None, 4)} and len(s.versions()["papers"]) == 1
    assert s.vacuum(keep=1) == 3 and rows() == {("a", 1, 1), ("b", None, 5), ("c", None, 4)} and s.read("conferences").count() == 1
    with s:
        pass
    with pytest.raises(ValueError, match="closed"):
        s.read("papers")


def test_two_writers_of_one_commit(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "a")) for _ in range(2))
    number = a._manifests
    a._manifests = lambda: []  # reads before the other commits
    b.commit(paper_tasks=spark.createDataFrame([("b", 1)], "hash string, task_id long"))
    with pytest.raises(RuntimeError, match="another writer"):
        a.commit(paper_tasks=spark.createDataFrame([("a", 1)], "hash string, task_id long"))
    a._manifests = number
    assert [r.hash for r in a.read("paper_tasks").collect()] == ["b"]


def test_pages_are_committed_once_with_all_that_follows(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"))
    task = lambda i, e: (i, 4, "q", 2000, 2001, [], 1, "running", e, None)
    s.commit(
        tasks=spark.createDataFrame([task(1, 5), task(2, 40), task(3, 5)], "id long, conference_id long, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate long, error string"),
        papers=page_papers(parse_pages(spark.createDataFrame([(None, 1, page([row(2)]))], "task_id long, page_number int, html string"))).withColumn("sourced_from", F.lit("plan")),
    )
    form = "task_id long, page_number int, html string, scraped_at timestamp"
    first = spark.createDataFrame([(1, 1, page([row(1), row(2)], "About 2 results"), None), (1, 1, page([row(1), row(2)], "About 2 results"), None)], form)
    assert [tuple(r) for r in pagewalk.commit_pages(s, first).collect()] == [(1, 2)]
    state = lambda: {r.id: (r.page, r.status, r.total_results_estimate) for r in s.read("tasks").collect()}
    assert state() == {1: (2, "running", 2), 2: (1, "running", 40), 3: (1, "running", 5)}
    papers = {r.title: (r.task_id, r.conference_id, r.sourced_from) for r in s.read("papers").collect()}
    assert papers == {"Title 1": (1, 4, "crawl"), "Title 2": (1, 4, "crawl")}
    assert pagewalk.commit_pages(s, first).count() == 0 and s.read("page_html").count() == 1
    more = spark.createDataFrame([(1, 2, page([row(2)], more=False), None), (2, 1, page([row(3)], "", more=False), None), (9, 1, page([row(9)]), None)], form)
    assert {tuple(r) for r in pagewalk.commit_pages(s, more).collect()} == {(1, 0), (2, 1), (9, 1)}
    assert state() == {1: (3, "completed", 2), 2: (2, "incomplete", 40), 3: (1, "running", 5)}
    same = spark.createDataFrame([(3, 1, page([row(5)]), None), (3, 2, page([row(5)]), None)], form)
    same.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = pagewalk.stream_pages(spark.readStream.schema(form).parquet(str(tmp_path / "in")), s.root, str(tmp_path / f"c{_}"))
        q.processAllAvailable()
        q.stop()
    assert state()[3] == (3, "error", 1230) and s.read("page_html").count() == 6 and s.read("paper_tasks").count() == 5


def test_a_walk_resumes_after_the_pages_that_are_there(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"))
    task = lambda i, c, st: (i, c, "q", 2000, 2001, [str(i)], 9, st, 5, None)
    s.commit(
        tasks=spark.createDataFrame([task(3, 4, "pending"), task(1, 4, "running"), task(2, 4, "completed"), task(5, 6, "running")], "id long, conference_id long, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate long, error string"),
        page_html=spark.createDataFrame([(1, 1, "x", None), (1, 2, "x", None), (2, 1, "x", None)], "task_id long, page_number int, html string, scraped_at timestamp"),
    )
    assert [(r.id, r.page) for r in pagewalk.resume(s, 4).collect()] == [(1, 3), (3, 1)]
    assert {(r.id, r.status, r.page) for r in s.read("tasks").collect()} == {(1, "pending", 3), (3, "pending", 1), (2, "completed", 9), (5, "running", 9)}
    from stemma.operators import stats

    assert [(r.task_id, r.page_number) for r in stats.archived_pages(s.read("page_html")).collect()] == [(1, 1), (1, 2), (2, 1)]
    assert stats.archived_pages(s.read("page_html"), 2).count() == 1


def test_fingerprints_and_harvest(spark):
    pages = spark.createDataFrame([(1, 1, page([row(1), row(2)])), (1, 2, page([row(1), row(2)], "x")), (1, 3, page([row(2), row(1)])), (1, 4, page([]))], "task_id long, page_number int, html string")
    f = {r.page_number: r.fingerprint for r in fingerprints(parse_pages(pages)).collect()}
    assert f[1] == f[2] != f[3] and f[4] == ""
    plan = spark.createDataFrame([(7, "q", 2000, 2001, page([row(1)]), None)], "conference_id long, query string, year_from int, year_to int, html string, scraped_at timestamp")
    assert [(r.title, r.conference_id, r.task_id, r.sourced_from, r.venue) for r in harvested(parse_pages(plan)).collect()] == [("Title 1", 7, None, "plan", "Venue")]


def test_citation_only_entries_can_be_left_out(spark):
    only = '<div class="gs_r gs_or"><h3 class="gs_rt"><span class="gs_ctu">[C]</span> Bare</h3></div>'
    parsed = parse_pages(spark.createDataFrame([(1, 1, page([row(1), only]))], "task_id long, page_number int, html string"))
    assert page_papers(parsed).count() == 2 and page_papers(parsed, citations=False).count() == 1


def test_config_defaults_and_checks():
    ok = {"conferences": [{"name": "A", "use_short_name": True, "aliases": ["x"]}], "headroom": 0, "max_results": 500, "unknown": 1}
    s = config.parse(json.dumps(ok))
    assert s.side_fraction == 0.75 and s.longest_phrase == 3 and not s.include_citations
    assert s.headroom == 0.8 and s.max_results == 500 and s.conferences[0].query == '"A"' and s.last_year(2024) == 2024
    for bad in ({}, {"conferences": [{"name": "A"}]}, {**ok, "headroom": 2}, {**ok, "max_side_fraction": 0.2}, {"conferences": ok["conferences"] * 2}, {"conferences": [{"name": "A", "query": "q", "aliases": ["q"]}]}):
        with pytest.raises(ValueError):
            config.parse(json.dumps(bad))


WALK = "task_id long, page_number int, fingerprint string, items int, added int, has_next boolean, estimate int"


def walks():
    out = [(1, 1, "a", 3, 3, True, 0), (1, 2, "a", 3, 0, True, 0), (1, 3, "b", 3, 3, True, 0)]
    out += [(2, i, "", 0, 0, True, 0) for i in range(1, 5)]
    out += [(3, i, f"p{i}", 5, 0, True, 0) for i in range(1, 9)]
    out += [(4, 1, "x", 5, 5, False, 0), (5, 1, "", 0, 0, False, 0)]
    out += [(6, i, f"p{i}", 5, 5, True, 699) for i in range(1, 60)] + [(7, i, f"p{i}", 5, 5, True, 4200) for i in range(1, 60)]
    return out


def test_walk_batch_and_stream_agree(spark, tmp_path):
    df = spark.createDataFrame(walks(), WALK)
    wanted = {1: (2, "error"), 2: (3, "needs_split"), 3: (6, "completed"), 4: (1, "completed"), 5: (1, "completed"), 6: (52, "completed"), 7: (52, "needs_split")}
    batch = pagewalk.walk_batch(df).collect()
    assert {r.task_id: (r.page_number, r.status) for r in batch} == wanted
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = pagewalk.walk(stream).writeStream.format("memory").queryName("walked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.task_id, r.page_number, r.status, r.reason) for r in spark.table("walked").collect()} == {tuple(r) for r in batch}


def test_pages_delivered_again_are_no_stall(spark, tmp_path):
    rows = [(1, i, f"p{i}", 5, 5, i < 3, 0) for i in (1, 2, 3)]
    df = spark.createDataFrame([rows[0], rows[0], rows[1]], WALK)
    again = spark.createDataFrame([rows[1], rows[2]], WALK)
    assert [(r.page_number, r.status) for r in pagewalk.walk_batch(df.union(again)).collect()] == [(3, "completed")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    again.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pagewalk.walk(stream).writeStream.format("memory").queryName("twice").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.page_number, r.status) for r in spark.table("twice").collect()] == [(3, "completed")]


def test_commit_batches_is_idempotent(spark, tmp_path):
    spark.createDataFrame([("h", 1), ("h", 1), ("g", 2)], "hash string, task_id long").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("hash string, task_id long").parquet(str(tmp_path / "in"))
        q = pagewalk.commit_batches(stream, str(tmp_path / "out"), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).select("hash", "task_id").distinct().count() == 2


def test_event_windows_stream_equals_batch(spark, tmp_path):
    from datetime import datetime

    df = spark.createDataFrame([(datetime(2024, 1, 1, h, m), "a", 1.5) for h in range(3) for m in (0, 30)], "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "e"))
    batch = {tuple(r) for r in pagewalk.event_windows(df).collect()}
    stream = pagewalk.event_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("ev").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("ev").collect()} == batch and len(batch) == 3
