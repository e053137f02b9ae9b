"""General problems over the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemma.operators import diff
from stemma.session import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    t = lambda n: table(spark, root, n)
    tasks = diff.table_diff(t("tasks"), t("tasks_copy"), "id", {"status": None, "page": None})
    papers = diff.table_diff(t("papers"), t("papers_copy"), "seq", {"hash": None, "citations": None})
    return diff.findings(tasks, "tasks").unionByName(diff.findings(papers, "papers"))


QUERIES = {"p2_found": p2_found}


def _pair(tbl: str, key: str, a: str, b: str, copy: str) -> str:
    norm = lambda c: rf"regexp_replace(lower({c}::VARCHAR), '^\s+|\s+$', '', 'g')"
    side = lambda t: f"(SELECT DISTINCT {key} AS k, {norm(a)} AS a, {norm(b)} AS b FROM {t})"
    return f"""SELECT '{tbl}' AS tbl, coalesce(l.k, r.k) AS row_id, unnest(CASE WHEN r.k IS NULL THEN ['only_main'] WHEN l.k IS NULL THEN ['only_copy']
 ELSE list_filter([CASE WHEN l.a IS DISTINCT FROM r.a THEN '{a}' END, CASE WHEN l.b IS DISTINCT FROM r.b THEN '{b}' END], lambda x: x IS NOT NULL) END) AS finding
FROM {side(tbl)} l FULL JOIN {side(copy)} r ON l.k = r.k"""


SQL = {"p2_found": _pair("tasks", "id", "status", "page", "tasks_copy") + " UNION ALL " + _pair("papers", "seq", "hash", "citations", "papers_copy")}
