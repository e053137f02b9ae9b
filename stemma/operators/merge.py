"""Merge of a second store into the own one, stage by stage; every stage is a join on natural keys and idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stemma.operators.dml import TASK_KEY, fresh_id, key_text, no_zero, same_key, settle_ids, status_rank


def merge_conferences(own: DataFrame, other: DataFrame) -> DataFrame:
    """Venues by name: those known here as they are, others with an id made from the name; change says added or same."""
    have = own.select("id", "name", "query", "type", F.lit("same").alias("change"))
    new = other.dropDuplicates(["name"]).join(own.select("name"), "name", "left_anti").select(fresh_id(F.col("name")).alias("id"), "name", "query", "type", F.lit("added").alias("change"))
    return settle_ids(have.unionByName(new), F.col("change") == "same", F.col("name"))


def conference_map(merged: DataFrame, other: DataFrame) -> DataFrame:
    """(src_id, dst_id, is_new): the ids of the other store's venues, and those they have in the merged table."""
    a = merged.select("name", F.col("id").alias("dst_id"), (F.col("change") == "added").alias("is_new"))
    return other.select("name", F.col("id").alias("src_id")).join(a, "name").select("src_id", "dst_id", "is_new")


def merge_aliases(own: DataFrame, other: DataFrame, conf_map: DataFrame) -> DataFrame:
    moved = other.join(conf_map, F.col("conference_id") == F.col("src_id")).select(F.col("dst_id").alias("conference_id"), "query", "ord")
    return own.unionByName(moved.join(own, ["conference_id", "query"], "left_anti").select("conference_id", "query", "ord").dropDuplicates(["conference_id", "query"]))


def merge_tasks(own: DataFrame, other: DataFrame) -> DataFrame:
    """The task table after the merge: (TASK_KEY, id, page, status, total_results_estimate, error, change).

    The status of higher rank wins and brings its error text; a running task elsewhere counts as pending. The later page
    wins; the own estimate stays unless it is missing or not positive. change: ``added``, ``updated`` or ``same``. The
    other store's ids mean nothing here: an added task has an id made from its key, and no two tasks share one.
    """
    theirs = other.withColumn("status", F.when(F.trim(F.lower("status")) == "running", "pending").otherwise(F.trim(F.lower("status"))))
    b = theirs.groupBy(*TASK_KEY).agg(F.max_by(F.struct("id", "page", "status", "total_results_estimate", "error"), F.struct(status_rank(F.col("status")), F.coalesce("page", F.lit(0)), -F.col("id"))).alias("r")).select(*TASK_KEY, "r.*").alias("b")
    both = own.alias("a").join(b, same_key("a", "b", TASK_KEY), "full_outer")
    mine, has = F.col("a.id").isNotNull(), F.col("b.id").isNotNull()
    wins = ~mine | (has & (status_rank(F.col("b.status")) > status_rank(F.col("a.status"))))
    status = F.when(wins, F.col("b.status")).otherwise(F.col("a.status"))
    error = F.when(wins, F.col("b.error")).otherwise(F.col("a.error"))
    page = F.greatest("a.page", "b.page")
    estimate = F.when(F.col("a.total_results_estimate") > 0, F.col("a.total_results_estimate")).otherwise(F.when(mine & ~has, F.col("a.total_results_estimate")).otherwise(F.coalesce("b.total_results_estimate", "a.total_results_estimate")))
    same = status.eqNullSafe(F.col("a.status")) & page.eqNullSafe(F.col("a.page")) & estimate.eqNullSafe(F.col("a.total_results_estimate"))
    change = F.when(~mine, "added").when(has & ~same, "updated").otherwise("same")
    keys = [F.when(mine, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in TASK_KEY]
    out = both.select(*keys, F.coalesce("a.id", fresh_id(key_text("b"))).alias("id"), page.alias("page"), status.alias("status"), estimate.alias("total_results_estimate"), error.alias("error"), change.alias("change"))
    return settle_ids(out.alias("t"), F.col("change") != "added", key_text("t"))


def task_map(merged: DataFrame, other: DataFrame) -> DataFrame:
    """(src_id, dst_id): the ids of the other store's tasks (with venues of this one), and those they have in the merged table."""
    return merged.alias("a").join(other.alias("b"), same_key("a", "b", TASK_KEY)).select(F.col("b.id").alias("src_id"), F.col("a.id").alias("dst_id"))


def merge_links(own: DataFrame, other: DataFrame, tasks: DataFrame) -> DataFrame:
    """(hash, task_id, change): own links and those of the other store under the own task ids, each once."""
    moved = other.join(tasks, F.col("task_id") == F.col("src_id")).select("hash", F.col("dst_id").alias("task_id")).distinct()
    added = moved.join(own.select("hash", "task_id"), ["hash", "task_id"], "left_anti")
    return own.select("hash", "task_id", F.lit("same").alias("change")).unionByName(added.withColumn("change", F.lit("added")))


def merge_pages(own: DataFrame, other: DataFrame, tasks: DataFrame) -> DataFrame:
    """Own pages and those of the other store under the own task ids, and change; the own page wins."""
    cols = ("task_id", "page_number", "html", "scraped_at")
    moved = other.join(tasks, F.col("task_id") == F.col("src_id")).select(F.col("dst_id").alias("task_id"), *cols[1:])
    added = moved.dropDuplicates(["task_id", "page_number"]).join(own, ["task_id", "page_number"], "left_anti")
    return own.select(*cols, F.lit("same").alias("change")).unionByName(added.select(*cols, F.lit("added").alias("change")))


def merge_papers(own: DataFrame, other: DataFrame, tasks: DataFrame) -> DataFrame:
    """Papers by hash: unknown ones come in, shared ones are healed; change says ``added`` or ``same``.

    own and other: one row a hash with citations, task_id, conference_id, sourced_from and texts. tasks: (src_id, dst_id)
    of ``task_map``. Missing references are filled, the larger citation count stays, empty texts are filled, the page's
    markup among them; the time stays that of the own row. A paper that gets its first task comes from ``crawl``, one
    whose task is unknown here has none and comes from ``plan``.
    """
    texts = [c for c in ("title", "authors", "snippet", "source_url", "scholar_id", "raw_html") if c in own.columns and c in other.columns]
    times = [c for c in ("scraped_at",) if c in own.columns and c in other.columns]
    known = tasks.select(F.col("src_id").alias("_src"), F.col("dst_id").alias("_known")).dropDuplicates(["_src"])
    b = other.join(known, no_zero(F.col("task_id")) == F.col("_src"), "left")
    b = b.withColumn("sourced_from", F.when(F.col("_known").isNull() & no_zero(F.col("task_id")).isNotNull(), "plan").otherwise(F.col("sourced_from"))).withColumn("task_id", F.col("_known"))
    both = own.alias("a").join(b.alias("b"), F.col("a.hash") == F.col("b.hash"), "full_outer")
    mine = F.col("a.hash").isNotNull()
    task_a, task_b = no_zero(F.col("a.task_id")), no_zero(F.col("b.task_id"))
    source = F.when(~mine, F.col("b.sourced_from")).when(task_a.isNull() & task_b.isNotNull(), "crawl").otherwise(F.col("a.sourced_from"))
    fill = lambda c: F.when(F.coalesce(F.col(f"a.{c}"), F.lit("")) == "", F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))).otherwise(F.col(f"a.{c}")).alias(c)
    return both.select(
        F.coalesce("a.hash", "b.hash").alias("hash"),
        *(fill(c) for c in texts),
        F.coalesce("a.year", "b.year").alias("year"),
        F.greatest(F.coalesce("a.citations", F.lit(0).cast("bigint")), F.coalesce("b.citations", F.lit(0).cast("bigint"))).alias("citations"),
        F.coalesce(task_a, task_b).alias("task_id"),
        F.coalesce(no_zero(F.col("a.conference_id")), no_zero(F.col("b.conference_id"))).alias("conference_id"),
        source.alias("sourced_from"),
        *(F.when(mine, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in times),
        F.when(mine, "same").otherwise("added").alias("change"),
    )


def merge_stats(**changed: DataFrame) -> DataFrame:
    """(tbl, change, n) over the change columns of merged tables."""
    out = None
    for name, df in changed.items():
        part = df.groupBy("change").agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "change", "n")
        out = part if out is None else out.unionByName(part)
    return out
