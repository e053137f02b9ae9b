"""Survivors and the quality model of sources."""

import random
from datetime import datetime

from stemma.llm import survivors as sur

SCHEMA = "seq long, hash string, snippet string, citations long, task_id long, conference_id long, sourced_from string, scraped_at timestamp, n_rows int"


def at(d):
    return datetime(2024, 1, d) if d else None


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def test_every_rule(spark):
    rows = [
        (1, "a", "long enough text \n", 5, 0, 7, "plan", at(3)),
        (2, "a", "long enough text", None, 9, None, "plan", at(5)),
        (3, "a", "  short   ", -1, 8, 0, "crawl", None),
        (4, "a", "n/a", 6, None, None, None, None),
        (5, "b", None, None, None, None, None, None), (6, "b", "", -1, 0, 0, "crawl", at(1)),
        (7, "c", "single", 1, 1, 1, "crawl", at(1)),
        (8, None, "x", 1, 1, 1, "crawl", at(1)), (9, None, "y", 1, 1, 1, "crawl", at(1)),
        (10, "d", "t", 1, 4, 4, "crawl", at(2)), (10, "d", "t", 1, 4, 4, "crawl", at(2)), (11, "d", "u", 2, 5, 4, "crawl", at(2)),
    ] + [(100 + i, f"s{i}", " N/A", None, None, None, None, None) for i in range(6)]
    got = {r.hash: tuple(r)[1:] for r in sur.survivors(frame(spark, rows)).collect()}
    assert got == {"a": (4, 1, 1, 3, 1), "b": (2, 0, 0, 0, 0), "d": (3, 10, 10, 10, 10)}


def test_hot_group_and_empty(spark):
    many = spark.range(20_000).selectExpr("id seq", "'h' hash", "repeat('x', cast(id % 50 as int)) snippet", "id citations", "id task_id", "id conference_id", "'crawl' sourced_from", "timestamp_seconds(id % 100) scraped_at", "1 extra")
    r = sur.survivors(many).collect()[0]
    assert (r.n_rows, r.text_row, r.count_row, r.task_id_row) == (20_000, 49, 99, 99)
    assert sur.survivors(many.limit(0)).count() == 0
    assert sur.true_values(many.limit(0)).count() == 0


def test_model_finds_bad_source(spark):
    rnd = random.Random(3)
    rows, truth = [], {}
    for i in range(1500):
        truth[f"h{i}"] = 1 + rnd.randrange(50)
        for s, right in (("crawl", 0.95), ("merge", 0.9), ("plan", 0.9), ("bad", 0.2)):
            v = truth[f"h{i}"] if rnd.random() < right else 1 + rnd.randrange(50)
            rows.append((len(rows), f"h{i}", None, None, v, None, s, None))
    df = frame(spark, rows)
    _, quality = sur.source_quality(sur.facts(sur.claimed(df, "hash", "sourced_from", ("task_id",))))
    by = {s: (a, b) for _, s, a, b in quality}
    assert by["bad"][0] < 0.5 < 0.8 < by["crawl"][0] and by["bad"][1] < by["crawl"][1]
    judged = {(r.grp, r.value) for r in sur.true_values(df, fields=("task_id",)).filter("judged_true").collect()}
    told: dict = {}
    for r in rows:
        told.setdefault((r[1], r[4]), set()).add(r[6])
    only_bad = {k for k, s in told.items() if s == {"bad"}}
    assert sum((g, v) in judged for g, v in truth.items()) > 0.97 * 1500
    assert len(only_bad & judged) < 0.02 * len(only_bad) and {g for g, _ in judged} == set(truth)


def test_several_values_may_be_true(spark):
    rows = [(i * 10 + k, f"h{i}", None, None, 1 + v, None, s, None) for i in range(300) for k, (s, v) in enumerate([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0), ("c", 1), ("d", 7)])]
    kept = [r for r in sur.true_values(frame(spark, rows), fields=("task_id",)).collect() if r.judged_true and r.grp == "h5"]
    assert {r.value for r in kept} == {1, 2}


def test_true_values_of_texts_and_counts(spark):
    rows = [("a", "crawl", " A text. ", 3, 7, 1), ("a", "plan", "A text.", 0, 7, 0), ("a", "plan", None, -1, 0, 1), ("a", "x", "  ", None, None, None)]
    rows += [(f"g{i}", "crawl", "No abstract", -2, 1, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "hash string, sourced_from string, snippet string, citations long, task_id long, conference_id long")
    out = sur.true_values(df, texts=("snippet",), counts=("citations",))
    assert dict(out.dtypes)["value"] == "string"
    found = {(r.field, r.value) for r in out.collect() if r.grp == "a"}
    assert found == {("snippet", "A text."), ("citations", "3"), ("citations", "0"), ("task_id", "7"), ("conference_id", "1")}
    assert {r.field for r in out.filter("grp like 'g%'").collect()} == {"task_id", "conference_id"}
