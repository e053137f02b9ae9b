"""The tables of the store, and how older forms are brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SCHEMAS = {
    "conferences": "id bigint, name string, query string, type string",
    "conference_aliases": "conference_id bigint, query string, ord int",
    "tasks": "id bigint, conference_id bigint, query string, year_from int, year_to int, keywords array<string>, page int, status string, total_results_estimate bigint, error string",
    "papers": "hash string, title string, authors string, year int, snippet string, citations bigint, source_url string, scholar_id string, raw_html string, task_id bigint, conference_id bigint, sourced_from string, scraped_at timestamp",
    "page_html": "id bigint, task_id bigint, page_number int, html string, scraped_at timestamp",
    "paper_tasks": "hash string, task_id bigint",
    "count_cache": "query string, year_from int, year_to int, count bigint, updated_at timestamp",
    "keyword_rank": "keyword string, score double, corpus_size bigint",
    "plan_harvest_pages": "query string, year_from int, year_to int, html string, scraped_at timestamp",
}
#: What tells the rows of a table apart.
KEYS = {
    "conferences": ["id"], "conference_aliases": ["conference_id", "query"], "tasks": ["id"], "papers": ["hash"], "page_html": ["task_id", "page_number"], "paper_tasks": ["hash", "task_id"],
    "count_cache": ["query", "year_from", "year_to"], "keyword_rank": ["keyword"], "plan_harvest_pages": ["query", "year_from", "year_to"],
}
DEFAULTS = {"conferences": {"type": "conference"}, "tasks": {"page": 1, "status": "pending"}, "papers": {"citations": 0}}


def columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ", 1)) for c in SCHEMAS[table].split(", ")]


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of the table in order and type: missing ones come with their default, others are dropped."""
    have = set(df.columns)
    defaults = DEFAULTS.get(table, {})
    out = []
    for name, kind in columns(table):
        c = F.col(name) if name in have else F.lit(None)
        out.append((F.coalesce(c, F.lit(defaults[name])) if name in defaults else c).cast(kind).alias(name))
    return df.select(*out)
