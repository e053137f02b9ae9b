"""The walk of a task over its result pages, as a stateful stream and as a batch.

State of a task: number and fingerprint of its last page, length of its runs of empty pages and of pages without new
papers, and how it ended. Input rows: task_id, page_number, fingerprint ('' for an empty page), items, added, has_next,
estimate. A page delivered again is known by its number and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stemma.operators import dml, stats
from stemma.session import cut_lineage
from stemma.sources.pages import page_papers, parse_pages, replay_links, walk_pages
from stemma.store import Store

SPARSE_RUN, STALE_RUN = 3, 6
OUTPUT = "task_id bigint, page_number int, status string, reason string"
STATE = "last string, empty_runs int, stale_runs int, done boolean, page int"


def step(state: tuple[str, int, int, bool], fingerprint: str, items: int, added: int, has_next: bool, page: int, cap: int, estimate: int, most: int) -> tuple[tuple[str, int, int, bool], tuple[str, str] | None]:
    """The state after a page, and (status, reason) if the walk ends with it."""
    last, empty, stale, done = state
    if done:
        return state, None
    end: tuple[str, str] | None = None
    if fingerprint and fingerprint == last:
        end = ("error", "same results as the page before")
    elif not items:
        empty += 1
        if not has_next:
            end = ("completed", "no results and no next page")
        elif empty >= SPARSE_RUN:
            end = ("needs_split", "empty pages in a row")
    else:
        empty, stale = 0, stale + 1 if not added else 0
        if stale >= STALE_RUN:
            end = ("completed", "nothing new on pages in a row")
        elif not has_next:
            end = ("completed", "no next page")
    if end is None and page >= cap:
        end = ("needs_split", "page cap, estimate unknown or over the limit") if estimate <= 0 or estimate > most else ("completed", "page cap within the estimate")
    return (fingerprint, empty, stale, end is not None), end


def walk(pages: DataFrame, cap: int = 52, most: int = 1000) -> DataFrame:
    """The end of each task's walk over a stream of pages (columns above, and estimate); pages in order of number per batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, page = (state.get[:4], state.get[4]) if state.exists else (("", 0, 0, False), 0)
        rows = pd.concat(list(batches)).sort_values("page_number")
        out = []
        for r in rows.itertuples(index=False):
            if r.page_number <= page:
                continue
            page = int(r.page_number)
            now, end = step(now, r.fingerprint, int(r.items), int(r.added), bool(r.has_next), int(r.page_number), cap, int(r.estimate), most)
            if end:
                out.append((key[0], int(r.page_number), *end))
        state.update((*now, page))
        yield pd.DataFrame(out, columns=["task_id", "page_number", "status", "reason"])

    return pages.groupBy("task_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def walk_batch(pages: DataFrame, cap: int = 52, most: int = 1000) -> DataFrame:
    """The same over a table of pages: windows only, so a task's pages may exceed a task's memory."""
    from pyspark.sql import Window

    w = Window.partitionBy("task_id").orderBy("page_number")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    full, new = F.col("items") > 0, F.col("added") > 0
    pages = pages.dropDuplicates(["task_id", "page_number"])
    rows = pages.withColumn("_stall", (F.col("fingerprint") != "") & F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w)))
    rows = rows.withColumns({"_b1": F.sum(full.cast("int")).over(upto), "_b2": F.sum((full & new).cast("int")).over(upto)})
    run = lambda block, what: F.sum(what.cast("int")).over(Window.partitionBy("task_id", block).orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_empty": run("_b1", ~full), "_stale": run("_b2", full & ~new)})
    est = F.col("estimate")
    ended = (
        F.when(F.col("_stall"), F.struct(F.lit("error").alias("status"), F.lit("same results as the page before").alias("reason")))
        .when(~full & ~F.col("has_next"), F.struct(F.lit("completed").alias("status"), F.lit("no results and no next page").alias("reason")))
        .when(~full & (F.col("_empty") >= SPARSE_RUN), F.struct(F.lit("needs_split").alias("status"), F.lit("empty pages in a row").alias("reason")))
        .when(full & (F.col("_stale") >= STALE_RUN), F.struct(F.lit("completed").alias("status"), F.lit("nothing new on pages in a row").alias("reason")))
        .when(full & ~F.col("has_next"), F.struct(F.lit("completed").alias("status"), F.lit("no next page").alias("reason")))
        .when((F.col("page_number") >= cap) & ((est <= 0) | (est > most)), F.struct(F.lit("needs_split").alias("status"), F.lit("page cap, estimate unknown or over the limit").alias("reason")))
        .when(F.col("page_number") >= cap, F.struct(F.lit("completed").alias("status"), F.lit("page cap within the estimate").alias("reason")))
    )
    ends = rows.withColumn("e", ended).filter("e is not null").groupBy("task_id").agg(F.min_by(F.struct("page_number", "e.status", "e.reason"), "page_number").alias("m"))
    return ends.select("task_id", "m.*")


def commit_pages(store: Store, pages: DataFrame, most: int = 1000, cap: int = 52, ratio: float = 0.5, citations: bool = True) -> DataFrame:
    """Makes recorded pages (task_id, page_number, html, scraped_at) durable with all that follows from them, in one commit.

    That is the page itself, its papers (healed where known), its links, and of its task the page pointer, the estimate
    of its first page, the status in which the walk over all its pages ends, with the reason, and whether a completed
    one served far less than its estimate. Returns (task_id, added): links new to each task.

    - A page that is there already is left alone, so a batch that is delivered again changes nothing and adds 0.
    - Only tasks, papers and links that the batch touches are read and written, as upserts.
    """
    have = store.read("page_html")
    one = pages.filter("task_id is not null and page_number is not null").groupBy("task_id", "page_number").agg(F.min_by("html", F.struct("scraped_at", "html")).alias("html"), F.min("scraped_at").alias("scraped_at"))
    new = cut_lineage(dml.insert_or_ignore(have, one, ["task_id", "page_number"]))
    touched = new.select("task_id").distinct()
    before = have.join(touched, "task_id", "left_semi").select("task_id", "page_number", "html", "scraped_at")
    parsed = cut_lineage(parse_pages(before.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True)))))
    tasks = store.read("tasks").join(touched.withColumnRenamed("task_id", "id"), "id", "left_semi")
    counts = parsed.filter("page_number = 1").select(F.col("task_id").alias("id"), "count")
    tasks = cut_lineage(dml.refresh_estimates(tasks, counts))

    seen = page_papers(parsed.filter("fresh"), citations).withColumn("sourced_from", F.lit("crawl"))
    seen = seen.join(tasks.select(F.col("id").alias("task_id"), "conference_id"), "task_id", "left").join(new.select("task_id", "page_number", "scraped_at"), ["task_id", "page_number"])
    order = F.struct(F.lit(1).alias("s"), F.col("task_id"), F.col("page_number").cast("bigint").alias("p"), F.col("place").cast("bigint").alias("i")).alias("seq")
    cols = ["hash", "title", "authors", "year", "snippet", "citations", "source_url", "scholar_id", "raw_html", "task_id", "conference_id", "sourced_from", "scraped_at"]
    kept = store.read("papers").join(seen.select("hash").distinct(), "hash", "left_semi")
    first = F.struct(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("task_id"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("i")).alias("seq")
    papers = dml.heal_papers(kept.select(*cols, first).unionByName(seen.select(*cols, order)))

    links = cut_lineage(dml.insert_or_ignore(store.read("paper_tasks"), replay_links(parsed.filter("fresh")), ["hash", "task_id"]))
    walk = walk_batch(walk_pages(parsed, tasks.select(F.col("id").alias("task_id"), F.col("total_results_estimate").alias("estimate"))), cap, most)
    pointer = parsed.groupBy(F.col("task_id").alias("id")).agg((F.max("page_number") + 1).alias("page"))
    ends = walk.select(F.col("task_id").alias("id"), "status", F.when(F.col("status") != "completed", F.col("reason")).alias("error"))
    moved = dml.change_tasks(tasks, pointer.join(ends, "id", "left").select("id", "status", "error", "page"))
    got = stats.links(papers, store.read("paper_tasks").join(touched, "task_id", "left_semi").unionByName(links)).join(touched, "task_id", "left_semi")
    judged = dml.judge_completed(moved, stats.shortfall(moved, got, ratio))
    store.commit({"page_html": new, "papers": papers, "paper_tasks": links, "tasks": judged})
    return touched.join(links.groupBy("task_id").agg(F.count("*").alias("added")), "task_id", "left").select("task_id", F.coalesce("added", F.lit(0).cast("bigint")).alias("added"))


def resume(store: Store, conference_id: int) -> DataFrame:
    """The tasks of a venue that a walk goes on with, and their pages, by id: what was left running is pending again, and
    a pointer follows the pages that are there. Both are committed."""
    tasks, pages = store.read("tasks"), store.read("page_html")
    mine = dml.requeue(tasks.filter(F.col("conference_id") == conference_id), ("running",))
    waiting = mine.filter("status = 'pending'")
    pointer = dml.reconcile_pages(waiting, pages).withColumns({"status": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    changed = cut_lineage(dml.change_tasks(mine, pointer))
    store.commit({"tasks": changed})
    return changed.filter("status = 'pending'").orderBy("id")


def stream_pages(pages: DataFrame, root: str, checkpoint: str, **limits):
    """Commits a stream of recorded pages batch by batch; each page takes effect once, however often it is delivered."""

    def save(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            commit_pages(Store(batch.sparkSession, root), batch, **limits)

    return pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()


def commit_batches(links: DataFrame, path: str, checkpoint: str):
    """Writes a stream of links (hash, task_id) so that each comes in once, whatever is delivered again.

    A batch replayed after a failure overwrites its own folder; readers take distinct rows over the folders.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["hash", "task_id"]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return links.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) over event time, with a watermark; for batches and streams."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
