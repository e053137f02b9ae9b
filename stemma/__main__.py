"""python -m stemma STORE [--config FILE] [--conference NAME] [--status] [--merge STORE]... [--merge-links] [--backfill-tasks] [--rerun-shortfall] [--gen-tasks]"""

from __future__ import annotations

import argparse
import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.functions import text as T
from stemma.operators import dml, merge, planner, splitting, stats
from stemma.sources import config
from stemma.session import cut_lineage
from stemma.sources.pages import parse_pages, replay_links
from stemma.store import Store


def seed(store: Store, settings: config.Settings) -> None:
    """Venues and their aliases as the configuration names them."""
    spark = store.spark
    venues = spark.createDataFrame([(v.name, v.query, v.type) for v in settings.conferences], "name string, query string, type string")
    known = dml.upsert_venues(store.read("conferences"), venues)
    listed = spark.createDataFrame([(v.name, a, i) for v in settings.conferences for i, a in enumerate(v.aliases, 1)] or [], "name string, query string, ord int")
    named = listed.join(known.select("name", F.col("id").alias("conference_id")), "name").select("conference_id", "query", "ord")
    store.commit(conferences=known, conference_aliases=dml.replace_aliases(store.read("conference_aliases"), named))


def select(conferences: DataFrame, name: str | None) -> DataFrame:
    """All venues, or the one of that exact name; an unknown name is an error that lists the known ones."""
    if name is None:
        return conferences
    one = conferences.filter(F.col("name") == name)
    if one.isEmpty():
        raise SystemExit(f"no venue {name!r}; known: " + ", ".join(sorted(r.name for r in conferences.select("name").limit(100).collect())))
    return one


def merge_stores(own: Store, other: Store, links: bool = False) -> DataFrame:
    """The other store into the own one, in one commit; how many rows of each table were added or updated.

    Links between papers and tasks are not taken over unless asked for; the stored ranking never is.
    """
    known = cut_lineage(merge.merge_conferences(own.read("conferences"), other.read("conferences")))
    conf = merge.conference_map(known, other.read("conferences"))
    moved = lambda name: other.read(name).join(conf, F.col("conference_id") == F.col("src_id"), "left").drop("conference_id", "src_id", "is_new").withColumnRenamed("dst_id", "conference_id")
    theirs = moved("tasks").filter("conference_id is not null")
    tasks = cut_lineage(merge.merge_tasks(own.read("tasks"), theirs))
    if tasks.groupBy("id").count().filter("count > 1").limit(1).count():
        raise RuntimeError("two tasks would have one id")
    ids = cut_lineage(merge.task_map(tasks, theirs))
    key = ["query", "year_from", "year_to"]
    merged = {
        "conferences": known,
        "tasks": tasks,
        "papers": merge.merge_papers(own.read("papers"), moved("papers"), ids),
        "page_html": merge.merge_pages(own.read("page_html"), other.read("page_html"), ids),
        "paper_tasks": merge.merge_links(own.read("paper_tasks"), other.read("paper_tasks"), ids),
        "count_cache": dml.newest(own.read("count_cache"), other.read("count_cache"), key, "count", "updated_at"),
        "plan_harvest_pages": dml.newest(own.read("plan_harvest_pages"), other.read("plan_harvest_pages"), key, "html", "scraped_at"),
    }
    if not links:
        del merged["paper_tasks"]
    rows = merge.merge_stats(**merged).collect()  # seven tables, three kinds of change
    own.commit(conference_aliases=merge.merge_aliases(own.read("conference_aliases"), other.read("conference_aliases"), conf), **merged)
    return own.spark.createDataFrame([tuple(r) for r in rows], "tbl string, change string, n long")


def limits(s: config.Settings) -> planner.Limits:
    return planner.Limits(s.max_results, s.headroom, s.min_balance, s.max_probes, s.min_papers_to_trust, s.min_coverage, s.side_fraction, s.mine_phrase_boost, s.longest_phrase, s.max_mined_keywords)


def generate(store: Store, venue, settings: config.Settings, every: DataFrame | None = None, ranking: DataFrame | None = None) -> DataFrame:
    """The plan of all names of a venue from known counts and papers alone.

    A window over the cap falls into years. A year over it keeps its stored partition if that is still good, else it is
    partitioned by keywords of the venue's own papers, every bucket counted; one that can't be stays marked needs_split.
    """
    spark, o = store.spark, limits(settings)
    papers, cache = store.read("papers"), store.read("count_cache")
    names = [r.query for r in stats.names(store.read("conferences"), store.read("conference_aliases")).filter(F.col("id") == venue.id).select(F.explode("names").alias("query")).collect()]  # configured
    year = settings.last_year(datetime.date.today().year)
    windows = cut_lineage(splitting.year_windows(spark.createDataFrame([(n,) for n in names], "query string"), settings.start_year, year, cache, o.max_results))
    plan = windows.withColumn("keywords", F.array().cast("array<string>")).select("query", "year_from", "year_to", "keywords", "count", "needs_split")
    over = [r for r in windows.filter("needs_split and year_from = year_to and count > 0").collect()]  # a row a name and year
    if not over:
        return planner.leaves_to_tasks(plan, venue.id, o.max_results)
    own = cut_lineage(planner.venue_documents(papers, venue.id))
    every = planner.documents(papers) if every is None else every
    configured = spark.createDataFrame([(k, i) for i, k in enumerate(settings.keywords, 1)] or [], "keyword string, rank int")
    mined = cut_lineage(planner.mined_keywords(own, every, o.min_papers_to_trust, o.mining, ranking).select("keyword", "rank"))
    solved: list[splitting.Leaf] = []
    parts: list[DataFrame] = []
    gone: list[tuple[str, int]] = []
    for name in names:
        mine = [r for r in over if r.query == name]
        if not mine:
            continue
        stored = cut_lineage(planner.reused_leaves(store.read("tasks").filter(F.col("conference_id") == venue.id), name, spark.createDataFrame([(r.year_from, r["count"]) for r in mine], "year int, count long"), o.max_results))
        kept = {r.year_from for r in stored.select("year_from").distinct().collect()}
        parts.append(stored)
        oracle = splitting.CountOracle.of(cache.filter(T.has_base(F.col("query"), F.lit(name)) & (F.col("year_from") == F.col("year_to"))))
        pool = cut_lineage(planner.keyword_pool(mined, configured, planner.texts(own), F.lit(name), o.max_side_fraction))
        for r in mine:
            if r.year_from in kept:
                gone.append((name, r.year_from))
                continue
            ok, leaves = planner.plan_year(own.filter(F.col("year") == r.year_from), name, r.year_from, r["count"], pool, oracle, o)
            if ok:
                gone.append((name, r.year_from))
                solved += leaves
    replaced = spark.createDataFrame(gone or [], "query string, year_from int").withColumn("year_to", F.col("year_from"))
    plan = plan.join(F.broadcast(replaced), ["query", "year_from", "year_to"], "left_anti").select(plan.columns)
    plan = plan.unionByName(spark.createDataFrame([(x.query, x.year_from, x.year_to, list(x.keywords), x.count, x.needs_split) for x in solved] or [], "query string, year_from int, year_to int, keywords array<string>, count long, needs_split boolean"))
    for part in parts:
        plan = plan.unionByName(part.select(plan.columns))
    return planner.leaves_to_tasks(plan, venue.id, o.max_results)


def emit(store: Store, venue, plan: DataFrame) -> None:
    """Makes a venue's plan current: its leaves are tasks, and open tasks outside it are superseded or gone, in one commit."""
    plan = cut_lineage(plan)
    tasks = store.read("tasks")
    mine = tasks.filter(F.col("conference_id") == venue.id)
    none = store.spark.createDataFrame([], "conference_id long, query string")
    actions = cut_lineage(dml.replace_plan(mine, plan, store.read("page_html"), none))  # all names of the venue are in the plan
    kept, papers = dml.drop_stale(tasks, store.read("papers"), actions)
    store.commit(tasks=dml.upsert_tasks(kept, plan), papers=papers)


def backfill(store: Store, ratio: float) -> DataFrame:
    """Links rebuilt from the archived pages, and completed tasks judged again by what they served: (id, got, total_results_estimate) of those now incomplete."""
    linked = replay_links(parse_pages(store.read("page_html")))
    have = store.read("paper_tasks")
    links = cut_lineage(have.unionByName(dml.insert_or_ignore(have, linked, ["hash", "task_id"])))
    short = cut_lineage(stats.shortfall(store.read("tasks"), stats.links(store.read("papers"), links), ratio))
    store.commit(paper_tasks=links, tasks=dml.judge_completed(store.read("tasks"), short))
    return short


def main() -> None:
    p = argparse.ArgumentParser(prog="stemma")
    p.add_argument("store")
    p.add_argument("--config")
    p.add_argument("--conference")
    p.add_argument("--merge", action="append", default=[])
    p.add_argument("--merge-links", action="store_true")
    for flag in ("status", "backfill-tasks", "rerun-shortfall", "gen-tasks"):
        p.add_argument(f"--{flag}", action="store_true")
    o = p.parse_args()
    store = Store(SparkSession.builder.appName("stemma").getOrCreate(), o.store)
    settings = config.load(o.config) if o.config else None
    if settings:
        seed(store, settings)
    for root in o.merge:
        merge_stores(store, store.attach(root), o.merge_links).show()
    if o.backfill_tasks:
        print(f"{backfill(store, settings.min_completion_ratio if settings else 0.5).count()} completed tasks are incomplete")
    if o.rerun_shortfall:
        hit = store.read("tasks")
        if o.conference:
            hit = hit.join(select(store.read("conferences"), o.conference).select(F.col("id").alias("conference_id")), "conference_id", "left_semi")
        again = dml.requeue(hit, ("incomplete", "error"), clear_error=True)
        print(f"{dml.requeued(hit, ('incomplete', 'error'))} tasks are pending again")
        store.commit(tasks=store.read("tasks").join(hit.select("id"), "id", "left_anti").unionByName(again.select(store.read("tasks").columns)))
    if o.gen_tasks and settings:
        every = cut_lineage(planner.documents(store.read("papers")))
        ranking, fresh = planner.corpus_ranking(store.read("papers"), store.read("keyword_rank"), limits(settings).mining)
        if fresh is not None:
            store.commit(keyword_rank=fresh)
        for venue in select(store.read("conferences"), o.conference).select("id", "name").toLocalIterator():
            plan = cut_lineage(generate(store, venue, settings, every, ranking))
            emit(store, venue, plan)
            print(f"{venue.name}: {plan.count()} tasks, {plan.filter("status = 'needs_split'").count()} need a split")
    if o.status:
        stats.status_counts(store.read("tasks"), store.read("conferences"), store.read("papers"), store.read("page_html")).show(vertical=True)
        stats.venue_rollup(select(store.read("conferences"), o.conference), store.read("papers"), store.read("tasks")).show(200, truncate=False)


if __name__ == "__main__":
    main()
