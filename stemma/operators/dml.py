"""Set-based writes: upserts, links, re-queues and plan replacement as DataFrame expressions.

Every function takes the current table and the incoming rows and returns the new table; ``stemma.store`` commits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stemma.functions.text import has_base

TASK_KEY = ("conference_id", "query", "year_from", "year_to", "keywords")
# Status ranks in a merge; the higher one wins.
STATUS_RANK = {"completed": 6, "incomplete": 5, "needs_split": 4, "error": 3, "superseded": 2, "pending": 1, "running": 1}


def status_rank(c: Column) -> Column:
    """Rank of a status; unknown and null rank 0. Letter case and surrounding white space do not matter."""
    out = F.lit(0)
    plain = F.trim(F.lower(c))
    for name, r in STATUS_RANK.items():
        out = F.when(plain == name, r).otherwise(out)
    return out


def source_of(source: Column, task: Column) -> Column:
    """The explicit source, else ``crawl`` with a task and ``plan`` without one."""
    return F.coalesce(F.nullif(source, F.lit("")), F.when(task.isNotNull(), "crawl").otherwise("plan"))


def no_zero(c: Column) -> Column:
    """0 stands for an unknown reference."""
    return F.nullif(c, F.lit(0).cast("bigint"))


def heal_papers(sightings: DataFrame) -> DataFrame:
    """One row a hash from sightings in order of arrival (seq).

    The first sighting fixes title, authors, year, snippet, citations, url, id, html and time. task_id and conference_id are
    those of the first sighting that has one; the source becomes ``crawl`` once a task is known to a paper that came
    without one. One aggregation, combined before the shuffle: a hash seen very often is no hot key.
    """
    frozen = ("title", "authors", "year", "snippet", "source_url", "scholar_id", "raw_html", "scraped_at")
    rows = sightings.withColumns({"_task": no_zero(F.col("task_id")), "_conf": no_zero(F.col("conference_id"))}).withColumn("_src", source_of(F.col("sourced_from"), F.col("_task")))
    seq = F.col("seq")
    aggs = [F.min_by(c, seq).alias(c) for c in frozen]
    aggs += [
        F.coalesce(F.min_by("citations", seq), F.lit(0)).alias("citations"),
        F.min_by("_task", F.when(F.col("_task").isNotNull(), seq)).alias("task_id"),
        F.min_by("_conf", F.when(F.col("_conf").isNotNull(), seq)).alias("conference_id"),
        F.min_by(F.col("_task").isNotNull(), seq).alias("_first_task"),
        F.min_by("_src", seq).alias("_first_src"),
    ]
    one = rows.groupBy("hash").agg(*aggs)
    source = F.when(~F.col("_first_task") & F.col("task_id").isNotNull(), "crawl").otherwise(F.col("_first_src"))
    return one.withColumn("sourced_from", source).drop("_first_task", "_first_src")


def insert_or_ignore(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming whose key is not there yet, once each (which of several is undefined unless they are equal)."""
    return incoming.dropDuplicates(key).join(current.select(*key).distinct(), key, "left_anti")


def link_delta(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """(task_id, added): how many links (hash, task_id) of a commit are new to each task."""
    return insert_or_ignore(links, incoming, ["hash", "task_id"]).groupBy("task_id").agg(F.count("*").alias("added"))


def _key(alias: str, on: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.col(f"{alias}.{k}").cast("string"), F.lit("\0")) if k != "keywords" else F.coalesce(F.to_json(F.col(f"{alias}.{k}")), F.lit("\0")) for k in on]


def same_key(a: str, b: str, on: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for x, y in zip(_key(a, on), _key(b, on)):
        out = out & (x == y)
    return out


def key_text(alias: str) -> Column:
    """The natural key of a task as one text, of which new ids are made."""
    parts = [F.coalesce((F.array_join(c, "\x1e") if k == "keywords" else c).cast("string"), F.lit("~")) for k in TASK_KEY for c in (F.col(f"{alias}.{k}"),)]
    return F.concat_ws("\x1f", *parts)


def fresh_id(key: Column) -> Column:
    """An id below 2 ** 60 made from a natural key: the same whenever and wherever it is made."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def settle_ids(rows: DataFrame, known: Column, key: Column) -> DataFrame:
    """rows with an id of their own each: one that was made from a key and is taken is made again from key and rank.

    known: was the id there before? Such ids are unique and stay. Groups of equal ids are single rows but for a clash.
    """
    order = Window.partitionBy("id").orderBy(F.col("_known").desc(), "_key")
    ranked = rows.withColumns({"_known": known, "_key": key}).withColumn("_rank", F.row_number().over(order))
    again = fresh_id(F.concat_ws("\x1d", "_key", F.col("_rank").cast("string")))
    return ranked.withColumn("id", F.when(F.col("_rank") > 1, again).otherwise(F.col("id"))).drop("_known", "_key", "_rank")


def upsert_tasks(current: DataFrame, plan: DataFrame) -> DataFrame:
    """The task table after a new plan (natural key TASK_KEY).

    A planned task that exists keeps completed and error; any other status becomes the plan's. One that needed a split
    and now is pending starts again at page 1; else the page stays. Estimates are the plan's, unknown ones too. A new
    task has an id made from its key.
    """
    a, b = current.alias("a"), plan.dropDuplicates(list(TASK_KEY)).alias("b")
    both = a.join(b, same_key("a", "b", TASK_KEY), "full_outer")
    old, new = F.col("a.status"), F.col("b.status")
    kept = old.isin("completed", "error")
    have_new, have_old = F.col("b.query").isNotNull(), F.col("a.query").isNotNull()
    status = F.when(~have_new, old).when(~have_old, new).when(kept, old).otherwise(new)
    page = F.when(~have_old, F.lit(1)).when(have_new & (old == "needs_split") & (new == "pending"), F.lit(1)).otherwise(F.col("a.page"))
    keys = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in TASK_KEY]
    estimate = F.when(have_new, F.col("b.total_results_estimate")).otherwise(F.col("a.total_results_estimate"))
    out = both.select(F.coalesce("a.id", fresh_id(key_text("b"))).alias("id"), *keys, page.alias("page"), status.alias("status"), estimate.alias("total_results_estimate"), F.when(have_old, F.col("a.error")).otherwise("").alias("error"), have_old.alias("_old"))
    return settle_ids(out.alias("t"), F.col("_old"), key_text("t")).drop("_old")


def replace_plan(tasks: DataFrame, keep: DataFrame, pages: DataFrame, other_names: DataFrame) -> DataFrame:
    """(id, action) for the open tasks outside a new plan: ``superseded`` if pages were collected, else ``deleted``.

    keep: TASK_KEY rows of the plan. pages: has task_id. other_names: (conference_id, query); tasks built on one of them
    belong to another plan. Names are few by venue: the theta join is an equi-join on the venue first.
    """
    open_ = tasks.filter(F.col("status").isin("needs_split", "pending")).alias("t")
    mine = open_.join(other_names.alias("o"), (F.col("t.conference_id") == F.col("o.conference_id")) & has_base(F.col("t.query"), F.col("o.query")), "left_anti")
    stale = mine.join(keep.alias("k"), same_key("t", "k", TASK_KEY), "left_anti")
    seen = pages.select(F.col("task_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    return stale.join(seen, "id", "left").select("id", F.when(F.col("_seen"), "superseded").otherwise("deleted").alias("action"))


def requeue(tasks: DataFrame, from_status: tuple[str, ...], clear_error: bool = False) -> DataFrame:
    """Tasks in one of the given statuses become pending; the page stays."""
    hit = F.col("status").isin(*from_status)
    out = tasks.withColumn("error", F.when(hit, F.lit(None)).otherwise(F.col("error"))) if clear_error else tasks
    return out.withColumn("status", F.when(hit, "pending").otherwise(F.col("status")))


def requeued(tasks: DataFrame, from_status: tuple[str, ...]) -> int:
    """How many tasks ``requeue`` changes."""
    return tasks.filter(F.col("status").isin(*from_status)).count()


def judge_completed(tasks: DataFrame, short: DataFrame) -> DataFrame:
    """tasks of which the completed ones in short (id, got, total_results_estimate) are incomplete, with the reason."""
    why = F.format_string("under-delivered: got %d of ~%d estimated results", "got", "total_results_estimate")
    return change_tasks(tasks, short.select("id", F.lit("incomplete").alias("status"), why.alias("error"), F.lit(None).cast("int").alias("page")))


def change_tasks(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """tasks after changes (id, status, error, page), of which a null leaves what is there; one change a task.

    This is how a task starts running, moves its page pointer, ends, needs a split or comes out incomplete, with a reason.
    """
    one = changes.groupBy("id").agg(*(F.max(c).alias(f"_{c}") for c in ("status", "error", "page")))
    joined = tasks.join(one, "id", "left")
    return joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in ("status", "error", "page") else F.col(c) for c in tasks.columns))


def drop_stale(tasks: DataFrame, papers: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, papers) after the actions of ``replace_plan``: a superseded task says so, a deleted one is gone from both."""
    gone = actions.filter("action = 'deleted'").select("id")
    marked = actions.filter("action = 'superseded'").select("id", F.lit("superseded").alias("status"), F.lit("not in the current plan").alias("error"), F.lit(None).cast("int").alias("page"))
    freed = papers.join(gone.withColumn("_gone", F.lit(True)), F.col("task_id") == F.col("id"), "left").withColumn("task_id", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("task_id"))).drop("id", "_gone")
    return change_tasks(tasks.join(gone, "id", "left_anti"), marked), freed


def reconcile_pages(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page): the page after the last one stored, 1 without any."""
    last = pages.groupBy(F.col("task_id").alias("id")).agg(F.max("page_number").alias("_last"))
    return tasks.select("id").join(last, "id", "left").select("id", (F.coalesce("_last", F.lit(0)) + 1).alias("page"))


def newest(current: DataFrame, incoming: DataFrame, key: list[str], value: str, at: str) -> DataFrame:
    """The value of each key by the newest timestamp, and change (added, updated, same); a row already there wins ties.

    A null timestamp is older than any other.
    """
    both = current.select(*key, value, at, F.lit(1).alias("_own")).unionByName(incoming.select(*key, value, at, F.lit(0).alias("_own")))
    best = both.groupBy(*key).agg(F.max(F.struct(F.col(at), F.col("_own"), F.col(value))).alias("_m"), F.max("_own").alias("_had"))
    change = F.when(F.col("_had") == 0, "added").when(F.col("_m._own") == 0, "updated").otherwise("same")
    return best.select(*key, F.col(f"_m.{value}").alias(value), F.col(f"_m.{at}").alias(at), change.alias("change"))


def save_harvest(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Recorded pages of plan searches (query, year_from, year_to, html, scraped_at): of each search the newest."""
    return newest(current, incoming, ["query", "year_from", "year_to"], "html", "scraped_at")


def rank_scores(ranked: DataFrame, corpus_size: Column) -> DataFrame:
    """(keyword, score, corpus_size): rank position as a score, n for the first."""
    n = ranked.agg(F.count("*").alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).select("keyword", (F.col("_n") - F.col("rank") + 1).cast("double").alias("score"), corpus_size.cast("bigint").alias("corpus_size"))


def replace_aliases(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The alias table once the venues in incoming have exactly the aliases given there, in their order."""
    w = Window.partitionBy("conference_id", "query").orderBy("ord")
    once = incoming.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return current.join(incoming.select("conference_id").distinct(), "conference_id", "left_anti").unionByName(once)


def backfill_conferences(papers: DataFrame, tasks: DataFrame) -> DataFrame:
    """Papers without a venue take that of their task; null citations become 0."""
    of_task = tasks.select(F.col("id").alias("task_id"), F.col("conference_id").alias("_c"))
    joined = papers.join(of_task, "task_id", "left")
    return joined.withColumn("conference_id", F.coalesce(no_zero(F.col("conference_id")), "_c")).withColumn("citations", F.coalesce("citations", F.lit(0).cast("bigint"))).drop("_c")


def refresh_estimates(tasks: DataFrame, counts: DataFrame) -> DataFrame:
    """Tasks with the estimate of their first page (id, count), where that is known and above 0."""
    fresh = counts.groupBy("id").agg(F.max("count").alias("_count"))
    return tasks.join(fresh, "id", "left").withColumn("total_results_estimate", F.when(F.col("_count") > 0, F.col("_count")).otherwise(F.col("total_results_estimate"))).drop("_count")


def already_complete(tasks: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, got): tasks past their first page that have served as many papers as their estimate says."""
    got = linked.groupBy(F.col("task_id").alias("id")).agg(F.count("*").alias("got"))
    return tasks.filter((F.col("total_results_estimate") > 0) & (F.col("page") > 1)).join(got, "id").filter(F.col("got") >= F.col("total_results_estimate")).select("id", "got")


def set_venue_type(conferences: DataFrame, types: DataFrame) -> DataFrame:
    """Venues with the type given for their name in types (name, type); others keep theirs."""
    return conferences.join(types.select("name", F.col("type").alias("_type")).dropDuplicates(["name"]), "name", "left").select("id", "name", "query", F.coalesce("_type", "type", F.lit("conference")).alias("type"))


def upsert_venues(conferences: DataFrame, incoming: DataFrame) -> DataFrame:
    """Venues by name after incoming (name, query, type): known ones take the new query and type and keep their id."""
    b = incoming.dropDuplicates(["name"]).select("name", F.col("query").alias("_q"), F.col("type").alias("_t"))
    both = conferences.join(b, "name", "full_outer")
    out = both.select(F.coalesce("id", fresh_id(F.col("name"))).alias("id"), "name", F.coalesce("_q", "query").alias("query"), F.coalesce("_t", "type", F.lit("conference")).alias("type"), F.col("id").isNotNull().alias("_old"))
    return settle_ids(out, F.col("_old"), F.col("name")).drop("_old")


def stored_ranking(ranked: DataFrame, corpus_size: int) -> DataFrame:
    """(keyword, score) of a ranking mined on exactly this corpus, best first; no rows if it was another."""
    return ranked.filter(F.col("corpus_size") == corpus_size).select("keyword", "score").orderBy(F.col("score").desc(), "keyword")
