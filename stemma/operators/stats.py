"""Scans and rollups over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stemma.functions.text import has_base
from stemma.operators.dml import no_zero

STATUSES = ("pending", "running", "completed", "needs_split", "error", "incomplete", "superseded")


def papers_of(papers: DataFrame, conference_id: int | None = None, year_from: int = 0, year_to: int = 0) -> DataFrame:
    """Papers of a venue (None: of all), in years if year_from > 0 and year_to >= year_from; filters reach the scan."""
    out = papers if conference_id is None else papers.filter(F.col("conference_id") == conference_id)
    return out.filter(F.col("year").between(year_from, year_to)) if year_from > 0 and year_to >= year_from else out


def tasks_of(tasks: DataFrame, conference_id: int | None = None, status: str | None = None) -> DataFrame:
    out = tasks if conference_id is None else tasks.filter(F.col("conference_id") == conference_id)
    return out if status is None else out.filter(F.col("status") == status)


def names(conferences: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, name, names ARRAY<STRING>): the main query and the aliases in their order."""
    listed = aliases.groupBy(F.col("conference_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "query"))), lambda x: x["query"]).alias("_a"))
    return conferences.join(listed, "id", "left").select("id", "name", F.concat(F.array("query"), F.coalesce("_a", F.array().cast("array<string>"))).alias("names"))


def other_names(named: DataFrame, name: str) -> DataFrame:
    """(id, name, others ARRAY<STRING>): the names of each venue (names) but for one, in order."""
    return named.select("id", "name", F.filter("names", lambda n: n != name).alias("others"))


def archived_pages(pages: DataFrame, task_id: int | None = None) -> DataFrame:
    """Archived pages of a task, or of all, by task and page number."""
    own = pages if task_id is None else pages.filter(F.col("task_id") == task_id)
    return own.orderBy("task_id", "page_number")


def cached_counts(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (query, year_from, year_to) with the count that is known, null where none is; a miss is no error."""
    known = cache.groupBy("query", "year_from", "year_to").agg(F.max("count").alias("count"))
    return wanted.join(known, ["query", "year_from", "year_to"], "left")


def status_counts(tasks: DataFrame, conferences: DataFrame, papers: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row with the number of venues, papers, tasks by status and, if given, archived pages."""
    counted = tasks.agg(F.count("*").alias("tasks"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    whole = counted.crossJoin(F.broadcast(conferences.agg(F.count("*").alias("conferences")))).crossJoin(F.broadcast(papers.agg(F.countDistinct("hash").alias("papers"))))
    return whole if pages is None else whole.crossJoin(F.broadcast(pages.agg(F.count("*").alias("pages"))))


def name_of_task(tasks: DataFrame, named: DataFrame) -> DataFrame:
    """(task_id, conference_id, name, ord): the first name of its venue that a task is built on."""
    spread = named.select(F.col("id").alias("_c"), F.posexplode("names").alias("ord", "_n"))
    hits = tasks.select(F.col("id").alias("task_id"), "conference_id", "query").join(F.broadcast(spread), (F.col("conference_id") == F.col("_c")) & has_base(F.col("query"), F.col("_n")))
    return hits.groupBy("task_id", "conference_id").agg(F.min(F.struct("ord", F.col("_n").alias("name"))).alias("m")).select("task_id", "conference_id", "m.name", "m.ord")


def links(papers: DataFrame, paper_tasks: DataFrame | None = None) -> DataFrame:
    """(hash, task_id): the union without repeats of the papers' own tasks and the recorded links."""
    own = papers.select("hash", no_zero(F.col("task_id")).alias("task_id")).filter("task_id is not null")
    return (own if paper_tasks is None else own.unionByName(paper_tasks.select("hash", "task_id"))).distinct()


def venue_rollup(conferences: DataFrame, papers: DataFrame, tasks: DataFrame) -> DataFrame:
    """(id, name, papers, tasks, completed) of every venue, those without rows included."""
    p = papers.filter(no_zero(F.col("conference_id")).isNotNull()).groupBy(F.col("conference_id").alias("id")).agg(F.countDistinct("hash").alias("papers"))
    t = tasks.groupBy(F.col("conference_id").alias("id")).agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"))
    zero = F.lit(0).cast("bigint")
    return conferences.select("id", "name").join(p, "id", "left").join(t, "id", "left").select("id", "name", *(F.coalesce(c, zero).alias(c) for c in ("papers", "tasks", "completed")))


def name_rollup(named: DataFrame, tasks: DataFrame, linked: DataFrame) -> DataFrame:
    """(conference_id, name, tasks, completed, papers) of each name with tasks."""
    of = name_of_task(tasks, named)
    counts = of.join(tasks.select(F.col("id").alias("task_id"), "status"), "task_id").groupBy("conference_id", "name").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"))
    papers = of.join(linked, "task_id").groupBy("conference_id", "name").agg(F.countDistinct("hash").alias("papers"))
    return counts.join(papers, ["conference_id", "name"], "left").select("conference_id", "name", "tasks", "completed", F.coalesce("papers", F.lit(0).cast("bigint")).alias("papers"))


def coverage_of_years(tasks: DataFrame) -> DataFrame:
    """(conference_id, year_from, leaves, estimate, known): do the keyword leaves of a year add up?"""
    leaf = tasks.filter((F.col("year_from") == F.col("year_to")) & (F.size("keywords") > 0))
    return leaf.groupBy("conference_id", "year_from").agg(F.count("*").alias("leaves"), F.sum("total_results_estimate").alias("estimate"), F.coalesce(F.bool_and(F.coalesce(F.col("total_results_estimate") > 0, F.lit(False))), F.lit(False)).alias("known"))


def shortfall(tasks: DataFrame, linked: DataFrame, ratio: float = 0.5) -> DataFrame:
    """(id, got, total_results_estimate): completed tasks that served fewer papers than ratio of their estimate."""
    got = linked.groupBy(F.col("task_id").alias("id")).agg(F.count("*").alias("got"))
    done = tasks.filter((F.col("status") == "completed") & (F.col("total_results_estimate") > 0)).select("id", "total_results_estimate")
    return done.join(got, "id", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("bigint"))).filter(F.col("got") < F.col("total_results_estimate") * ratio).select("id", "got", "total_results_estimate")


def run_lengths(rows: DataFrame, key: str, order: str, reset: str) -> DataFrame:
    """Adds run: how many rows in a row, this one included, do not reset; 0 where it does."""
    w = Window.partitionBy(key).orderBy(order)
    block = F.sum(F.col(reset).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inner = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_block", block).withColumn("run", F.sum((~F.col(reset)).cast("int")).over(inner)).drop("_block")


def stalled(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value repeats that of the row before, by key; null repeats nothing."""
    return rows.withColumn("_before", F.lag(value).over(Window.partitionBy(key).orderBy(order))).filter(F.col(value) == F.col("_before")).drop("_before")
