"""Queries over the bibliographic store, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stemma.functions import text as T
from stemma.operators import dml, merge, mining, partition, planner, splitting, stats
from stemma.session import cut_lineage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Get = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of a table reader under its own name."""

    def add(f: Callable[[Get], DataFrame]):
        QUERIES[f.__name__] = lambda spark, root, f=f: f(lambda name: table(spark, root, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- shared views

NORM = r"trim(regexp_replace(lower(translate({}, 'İΣ', 'iσ')), '[\p{{Z}}\p{{Cc}}\p{{P}}\p{{S}}]+', ' ', 'g'))"
_FIRST = r"trim(regexp_replace(split_part(authors, ',', 1), '[\s\p{Z}]+', ' ', 'g'))"
_SURNAME = rf"""regexp_replace(lower(translate(CASE WHEN length({_FIRST}) - length(replace({_FIRST}, ' ', '')) > 0 AND length(split_part({_FIRST}, ' ', -1)) <= 3
 AND split_part({_FIRST}, ' ', -1) LIKE '%.' THEN split_part({_FIRST}, ' ', -2) ELSE split_part({_FIRST}, ' ', -1) END, 'İΣ', 'iσ')), '[^\p{{L}}]', '', 'g')"""
_HEALED = """healed AS (SELECT hash, first(title ORDER BY seq) AS title, first(snippet ORDER BY seq) AS snippet, first(year ORDER BY seq) AS year FROM papers GROUP BY hash)"""
_STOP = ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS))
_CONTENT = f"(length({{0}}) >= 3 AND {{0}} NOT IN ({_STOP}) AND NOT regexp_full_match({{0}}, '[0-9]+'))"
_WORDS = "list_filter(list_transform(regexp_split_to_array({}, '[^0-9A-Za-z]+'), lambda x: lower(x)), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+'))"
_BAL = "CASE WHEN {0} + {1} = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, least({0}, {1})::DOUBLE / (({0} + {1})::DOUBLE / 2.0::DOUBLE)) END"
_KEYWORDS = ("graph", "learning", "neural translation", "model", "robot", "query planning", "segmentation", "budget")
_KW = ", ".join(f"('{k}', {i})" for i, k in enumerate(_KEYWORDS, 1))


def _grams(tok: str) -> str:
    parts = []
    for n in (2, 3):
        inner = f"list_transform(list_filter(range(1, len({tok}) - {n} + 2), lambda i: {_CONTENT.format(f'{tok}[i]')} AND {_CONTENT.format(f'{tok}[i + {n - 1}]')}), lambda i: array_to_string({tok}[i:i + {n - 1}], ' '))"
        parts.append(f"CASE WHEN len({tok}) >= {n} THEN {inner} ELSE []::VARCHAR[] END")
    return f"list_concat({parts[0]}, {parts[1]})"


def _terms_sql(phrases: bool) -> str:
    content = lambda t: f"list_filter({t}, lambda x: {_CONTENT.format('x')})"
    lists = [content("a"), content("b")] + ([_grams("a"), _grams("b")] if phrases else [])
    both = lists[0]
    for x in lists[1:]:
        both = f"list_concat({both}, {x})"
    return f"""{_HEALED}, toks AS (SELECT hash, {_WORDS.format("coalesce(title, '')")} AS a, {_WORDS.format("coalesce(snippet, '')")} AS b FROM healed),
terms AS (SELECT hash, unnest(list_distinct({both})) AS keyword FROM toks),
df AS (SELECT keyword, count(*) AS df FROM terms GROUP BY keyword), n AS (SELECT count(*) AS total FROM healed)"""


def _cands_sql(phrases: bool) -> str:
    w, o = "df", "(total - df)"
    return f"""{_terms_sql(phrases)}, cands AS (SELECT keyword, df AS with_docs, total - df AS without_docs, total, {_BAL.format(w, o)} AS balance FROM df, n
 WHERE {_BAL.format(w, o)} >= 0.15 AND df >= 3 AND df <= total * 0.95::DOUBLE)"""


_DEDUP = """kept AS (SELECT * FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.rank > a.rank AND b.keyword <> a.keyword AND contains(b.keyword, a.keyword)
 AND length(b.keyword) - length(replace(b.keyword, ' ', '')) = length(a.keyword) - length(replace(a.keyword, ' ', ''))))"""


def documents_of(get: Get) -> DataFrame:
    return dml.heal_papers(get("papers"))


def texts_of(get: Get) -> DataFrame:
    return documents_of(get).select("hash", "year", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))).alias("text"))


def keywords_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i) for i, k in enumerate(_KEYWORDS, 1)], "keyword string, rank int")


_TEXTS = _HEALED + ", texts AS (SELECT hash, year, lower(coalesce(title, '') || ' ' || coalesce(snippet, '')) AS t FROM healed), kws(keyword, rank) AS (VALUES " + _KW + ")"
_NORMS = r"regexp_replace(regexp_replace({}, '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'), '^ | $', '', 'g')"


# ---- scalar functions


@query(f"SELECT seq, {NORM.format('title')} AS norm_title FROM papers")
def title_norm(get: Get) -> DataFrame:
    return get("papers").select("seq", T.normalize_title("title").alias("norm_title"))


@query(f"SELECT seq, {_SURNAME} AS surname FROM papers")
def author_surname(get: Get) -> DataFrame:
    return get("papers").select("seq", T.first_surname("authors").alias("surname"))


@query(f"""SELECT seq, sha256({NORM.format("coalesce(title, '')")} || chr(0) || coalesce(year, 0)::VARCHAR || chr(0) ||
 CASE WHEN {_SURNAME} <> '' THEN {_SURNAME} WHEN {NORM.format("authors")} <> '' THEN 's:' || {NORM.format("authors")} ELSE 't:' || left({NORM.format("title")}, 40) END) AS paper_hash FROM
 (SELECT seq, year, coalesce(title, '') AS title, coalesce(authors, '') AS authors FROM papers)""")
def paper_key(get: Get) -> DataFrame:
    return get("papers").select("seq", T.paper_key("title", "year", "authors").alias("paper_hash"))


@query(f"SELECT seq, {_NORMS.format('snippet')} AS snippet FROM papers")
def norm_space(get: Get) -> DataFrame:
    return get("papers").select("seq", T.norm_space("snippet").alias("snippet"))


@query(f"SELECT seq, array_to_string({_WORDS.format('title')}, ' ') AS every_word, array_to_string(list_filter({_WORDS.format('title')}, lambda x: {_CONTENT.format('x')}), ' ') AS content FROM papers")
def title_words(get: Get) -> DataFrame:
    return get("papers").select("seq", F.array_join(T.words("title"), " ").alias("every_word"), F.array_join(T.content_words("title"), " ").alias("content"))


@query(f"SELECT seq, array_to_string({_grams('tok')}, '|') AS phrases FROM (SELECT seq, {_WORDS.format('title')} AS tok FROM papers)")
def title_phrases(get: Get) -> DataFrame:
    split = get("papers").select("seq", T.words("title").alias("w"))
    flagged = split.select("seq", "w", T.content_flags(F.col("w")).alias("f"))
    return flagged.select("seq", F.array_join(T.ngrams(F.col("w"), F.col("f"), 3), "|").alias("phrases"))


_LINE = "coalesce(authors, '') || ' - Proceedings of ' || coalesce(sourced_from, 'x') || ', ' || year || ' - publisher.example'"


@query(rf"""SELECT seq, trim(split_part(line, ' - ', 1)) AS authors, coalesce(TRY_CAST(yr AS INTEGER), 0) AS year,
 CASE WHEN yr IS NOT NULL THEN trim(regexp_replace(trim(regexp_replace(rest, yr || '[^0-9]*$', '')), ',+$', '')) ELSE trim(rest) END AS venue FROM
 (SELECT *, list_last(regexp_extract_all(rest, '(?:19|20)\d{{2}}')) AS yr FROM (SELECT seq, line, CASE WHEN contains(line, ' - ') THEN substr(line, strpos(line, ' - ') + 3) ELSE '' END AS rest FROM (SELECT seq, {_LINE} AS line FROM papers)))""")
def meta_line(get: Get) -> DataFrame:
    line = F.concat(F.coalesce("authors", F.lit("")), F.lit(" - Proceedings of "), F.coalesce("sourced_from", F.lit("x")), F.lit(", "), F.col("year"), F.lit(" - publisher.example"))
    return get("papers").select("seq", T.meta_line(line).alias("m")).select("seq", "m.authors", "m.year", "m.venue")


@query(r"""SELECT seq, citations AS wanted, TRY_CAST(regexp_replace(regexp_extract('Cited by ' || citations, '\d[\d\s.,]*'), '[^0-9]', '', 'g') AS BIGINT) AS read,
 TRY_CAST(regexp_replace(regexp_extract('Page 3 of about ' || format('{:,}', citations) || ' results (0.05 sec)', '(?i)(\d[\d\s.,]*?)\s+(?:results)', 1), '[^0-9]', '', 'g') AS BIGINT) AS header FROM papers WHERE citations >= 0""")
def counts_from_text(get: Get) -> DataFrame:
    p = get("papers").filter("citations >= 0")
    header = F.concat(F.lit("Page 3 of about "), F.format_number("citations", 0), F.lit(" results (0.05 sec)"))
    return p.select("seq", F.col("citations").alias("wanted"), T.first_number(F.concat(F.lit("Cited by "), F.col("citations"))).alias("read"), T.result_count(header).alias("header"))


_RENDER = """query || array_to_string(list_transform(coalesce(keywords, []), lambda w: ' AND "' || w || '"'), '') || ' -"survey"'"""


@query(f"SELECT id, {_RENDER} AS text FROM tasks")
def render_query(get: Get) -> DataFrame:
    return get("tasks").select("id", T.render_query("query", "keywords", F.array(F.lit("survey"))).alias("text"))


@query(rf"""WITH q AS (SELECT id, query || array_to_string(list_transform(coalesce(keywords, []), lambda w: ' AND "' || w || '"'), '') || ' -"survey"' AS q FROM tasks),
p AS (SELECT id, q, regexp_extract_all(q, '\bAND\s+"([^"]*)"', 1) AS terms, regexp_extract(q, 'source:"([^"]*)"', 1) AS src,
 trim(regexp_replace(regexp_replace(regexp_replace(q, 'source:"([^"]*)"', ' ', 'g'), '\bAND\s+"([^"]*)"', ' ', 'g'), '-"([^"]*)"', ' ', 'g')) AS rest FROM q),
e AS (SELECT *, coalesce(list_filter(terms, lambda x: contains(x, ' '))[1], '') AS exact FROM p),
a AS (SELECT *, array_to_string(list_transform(list_filter(terms, lambda x, i: exact = '' OR i <> list_position(terms, exact)), lambda x: CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END), ' ') AS every FROM e)
SELECT id, CASE WHEN src <> '' THEN src WHEN rest LIKE '"%"' AND length(rest) >= 2 THEN substr(rest, 2, length(rest) - 2) ELSE '' END AS venue, exact AS exact_phrase,
 CASE WHEN src = '' AND rest <> '' AND NOT (rest LIKE '"%"' AND length(rest) >= 2) AND every = '' THEN rest ELSE every END AS all_words, array_to_string(list_transform(regexp_extract_all(q, '-"([^"]*)"', 1), lambda x: CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END), ' ') AS without_words, true AS ok FROM a""")
def decompose_query(get: Get) -> DataFrame:
    text = T.render_query("query", "keywords", F.array(F.lit("survey")))
    return get("tasks").select("id", T.decompose_query(text).alias("d")).select("id", "d.*")


@query("SELECT id, coalesce(array_to_string(list_transform(keywords, lambda w: '\"' || w || '\"'), ','), 'none') AS listed, len(keywords) AS n FROM tasks")
def keyword_lists(get: Get) -> DataFrame:
    text = F.to_json("keywords")
    back = F.from_json(text, "array<string>")
    return get("tasks").select("id", F.coalesce(F.array_join(F.transform(back, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), ","), F.lit("none")).alias("listed"), F.when(F.col("keywords").isNotNull(), F.size(back)).cast("bigint").alias("n"))


# ---- scans and rollups


@query("SELECT seq, hash, year FROM papers WHERE conference_id = 7 AND year BETWEEN 2015 AND 2019")
def papers_of_venue(get: Get) -> DataFrame:
    return stats.papers_of(get("papers"), 7, 2015, 2019).select("seq", "hash", "year")


@query("SELECT year, count(*) AS n FROM papers WHERE year BETWEEN 2010 AND 2020 GROUP BY year")
def papers_in_years(get: Get) -> DataFrame:
    return stats.papers_of(get("papers"), None, 2010, 2020).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT seq, coalesce(title, '') || ' ' || coalesce(snippet, '') AS text FROM papers")
def paper_texts(get: Get) -> DataFrame:
    return get("papers").select("seq", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))).alias("text"))


@query("SELECT id, query, page FROM tasks WHERE status = 'pending' AND conference_id = 3")
def pending_tasks(get: Get) -> DataFrame:
    return stats.tasks_of(get("tasks"), 3, "pending").select("id", "query", "page")


@query("SELECT id, conference_id FROM tasks WHERE status = 'completed'")
def completed_tasks(get: Get) -> DataFrame:
    return stats.tasks_of(get("tasks"), None, "completed").select("id", "conference_id")


@query("""SELECT c.id, c.name, c.query || coalesce('|' || string_agg(a.query, '|' ORDER BY a.ord), '') AS names FROM conferences c LEFT JOIN conference_aliases a ON a.conference_id = c.id GROUP BY c.id, c.name, c.query""")
def venue_names(get: Get) -> DataFrame:
    return stats.names(get("conferences"), get("conference_aliases")).select("id", "name", F.array_join("names", "|").alias("names"))


@query("SELECT (SELECT count(*) FROM conferences) AS conferences, (SELECT count(DISTINCT hash) FROM papers) AS papers, count(*) AS tasks, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in stats.STATUSES) + " FROM tasks")
def status_counts(get: Get) -> DataFrame:
    return stats.status_counts(get("tasks"), get("conferences"), get("papers"))


@query("""SELECT c.id, c.name, coalesce(string_agg(a.query, '|' ORDER BY a.ord), '') AS others FROM conferences c LEFT JOIN conference_aliases a ON a.conference_id = c.id GROUP BY c.id, c.name""")
def other_names(get: Get) -> DataFrame:
    """The names of every venue but its main one."""
    named = stats.names(get("conferences"), get("conference_aliases"))
    own = get("conferences").select("id", "query")
    return named.join(own, "id").select("id", "name", F.array_join(F.filter("names", lambda n: n != F.col("query")), "|").alias("others"))


@query("""WITH {} SELECT t.id, k.count FROM tasks t LEFT JOIN (SELECT query, year_from, year_to, max(count) AS count FROM known GROUP BY ALL) k ON k.query = t.query AND k.year_from = t.year_from AND k.year_to = t.year_to""")
def cached_counts(get: Get) -> DataFrame:
    """The known count of every task's search, null where there is none."""
    return stats.cached_counts(get("tasks").select("id", "query", "year_from", "year_to"), _known(get)).select("id", "count")


@query("""SELECT c.id, c.name, coalesce(p.n, 0) AS papers, coalesce(t.n, 0) AS tasks, coalesce(t.d, 0) AS completed FROM conferences c
 LEFT JOIN (SELECT conference_id, count(DISTINCT hash) AS n FROM papers WHERE conference_id <> 0 GROUP BY 1) p ON p.conference_id = c.id
 LEFT JOIN (SELECT conference_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS d FROM tasks GROUP BY 1) t ON t.conference_id = c.id""")
def venue_rollup(get: Get) -> DataFrame:
    return stats.venue_rollup(get("conferences"), get("papers"), get("tasks"))


_NAMED = """named AS (SELECT id, query AS nm, 0 AS ord FROM conferences UNION ALL SELECT conference_id, query, row_number() OVER (PARTITION BY conference_id ORDER BY ord) FROM conference_aliases),
ft AS (SELECT t.id AS task_id, t.conference_id, t.status, first(nm ORDER BY ord) AS name FROM tasks t JOIN named ON named.id = t.conference_id AND (t.query = nm OR starts_with(t.query, nm || ' ')) GROUP BY ALL)"""


@query(f"WITH {_NAMED} SELECT task_id, conference_id, name FROM ft")
def name_of_task(get: Get) -> DataFrame:
    return stats.name_of_task(get("tasks"), stats.names(get("conferences"), get("conference_aliases"))).select("task_id", "conference_id", "name")


@query(f"""WITH {_NAMED}, l AS (SELECT DISTINCT hash, task_id FROM papers WHERE task_id <> 0)
SELECT ft.conference_id, name, count(DISTINCT ft.task_id) AS tasks, count(DISTINCT ft.task_id) FILTER (WHERE status = 'completed') AS completed, count(DISTINCT hash) AS papers FROM ft LEFT JOIN l ON l.task_id = ft.task_id GROUP BY ALL""")
def name_rollup(get: Get) -> DataFrame:
    named = stats.names(get("conferences"), get("conference_aliases"))
    return stats.name_rollup(named, get("tasks"), stats.links(get("papers")))


@query("SELECT name, year, count(DISTINCT p.hash) AS papers FROM papers p JOIN tasks t ON t.id = p.task_id JOIN conferences c ON c.id = t.conference_id GROUP BY ALL")
def papers_per_venue(get: Get) -> DataFrame:
    t = get("tasks").select(F.col("id").alias("task_id"), F.col("conference_id").alias("cid"))
    c = get("conferences").select(F.col("id").alias("cid"), "name")
    return get("papers").select("hash", "year", "task_id").join(t, "task_id").join(c, "cid").groupBy("name", "year").agg(F.countDistinct("hash").alias("papers"))


@query("SELECT task_id, count(DISTINCT hash) AS papers FROM papers WHERE task_id <> 0 GROUP BY 1")
def papers_per_task(get: Get) -> DataFrame:
    return stats.links(get("papers")).groupBy("task_id").agg(F.count("*").alias("papers"))


@query("""SELECT conference_id, year_from, count(*) AS leaves, sum(total_results_estimate)::BIGINT AS estimate, bool_and(coalesce(total_results_estimate > 0, false)) AS known FROM tasks
 WHERE year_from = year_to AND len(keywords) > 0 GROUP BY ALL""")
def stored_partitions(get: Get) -> DataFrame:
    return stats.coverage_of_years(get("tasks"))


@query("""WITH l AS (SELECT task_id AS id, count(DISTINCT hash) AS got FROM papers WHERE task_id <> 0 GROUP BY 1) SELECT t.id, coalesce(got, 0) AS got, total_results_estimate FROM tasks t LEFT JOIN l USING (id)
 WHERE status = 'completed' AND total_results_estimate > 0 AND coalesce(got, 0) < total_results_estimate * 0.5""")
def shortfall_flag(get: Get) -> DataFrame:
    return stats.shortfall(get("tasks"), stats.links(get("papers")), 0.5)


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type = b""")
def stall_pages(get: Get) -> DataFrame:
    e = get("events").withColumn("_o", F.struct("ts", "event_id"))
    return stats.stalled(e, "user_id", "_o", "event_type").select("user_id", "event_id", "event_type")


@query("""SELECT user_id, event_id, (sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM
 (SELECT *, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)""")
def run_lengths(get: Get) -> DataFrame:
    e = get("events").withColumn("_o", F.struct("ts", "event_id")).withColumn("_r", F.col("value") > 50)
    return stats.run_lengths(e, "user_id", "_o", "_r").select("user_id", "event_id", "run")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(get: Get) -> DataFrame:
    from stemma.streaming.pagewalk import event_windows as windows

    return windows(get("events"))


# ---- writes


@query("""SELECT hash, first(title ORDER BY seq) AS title, first(authors ORDER BY seq) AS authors, first(year ORDER BY seq) AS year, first(coalesce(citations, 0) ORDER BY seq) AS citations,
 first(raw_html ORDER BY seq) AS raw_html, epoch_us(first(scraped_at ORDER BY seq)) AS scraped_us,
 first(task_id ORDER BY seq) FILTER (WHERE task_id <> 0) AS task_id, first(conference_id ORDER BY seq) FILTER (WHERE conference_id <> 0) AS conference_id,
 CASE WHEN first(coalesce(task_id, 0) ORDER BY seq) = 0 AND count(*) FILTER (WHERE task_id <> 0) > 0 THEN 'crawl'
  ELSE first(coalesce(sourced_from, CASE WHEN coalesce(task_id, 0) <> 0 THEN 'crawl' ELSE 'plan' END) ORDER BY seq) END AS sourced_from FROM papers GROUP BY hash""")
def paper_heal(get: Get) -> DataFrame:
    return dml.heal_papers(get("papers")).select("hash", "title", "authors", "year", "citations", "raw_html", F.unix_micros("scraped_at").alias("scraped_us"), "task_id", "conference_id", "sourced_from")


@query("""SELECT task_id, count(*) AS added FROM (SELECT DISTINCT hash, task_id FROM papers_copy WHERE task_id <> 0 AND hash IS NOT NULL EXCEPT SELECT hash, task_id FROM papers WHERE task_id <> 0) GROUP BY 1""")
def link_delta(get: Get) -> DataFrame:
    return dml.link_delta(stats.links(get("papers")), stats.links(get("papers_copy")).filter("hash is not null"))


@query("""SELECT DISTINCT hash FROM papers_copy WHERE hash IS NOT NULL AND hash NOT IN (SELECT hash FROM papers WHERE hash IS NOT NULL)""")
def new_papers(get: Get) -> DataFrame:
    return dml.insert_or_ignore(get("papers").select("hash"), get("papers_copy").select("hash").filter("hash is not null"), ["hash"])


_TKEY = "coalesce(conference_id::VARCHAR, '~') || chr(31) || coalesce(query, '~') || chr(31) || coalesce(year_from::VARCHAR, '~') || chr(31) || coalesce(year_to::VARCHAR, '~') || chr(31) || coalesce(array_to_string(keywords, chr(30)), '~')"
_PLAN = f"""plan AS (SELECT {_TKEY} AS k, min(id) AS id, min(lower(trim(status, E' \\t\\n\\r'))) AS status, max(total_results_estimate) AS est FROM tasks_copy GROUP BY 1), cur AS (SELECT *, {_TKEY} AS k FROM tasks)"""


def _plan(get: Get) -> DataFrame:
    plain = F.regexp_replace(F.lower("status"), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return get("tasks_copy").groupBy(*dml.TASK_KEY).agg(F.min("id").alias("id"), F.min(plain).alias("status"), F.max("total_results_estimate").alias("total_results_estimate"))


def _fresh(key: str) -> str:
    """The id that is made from a key."""
    return f"('0x' || substr(md5({key}), 1, 15))::BIGINT"


@query(f"""WITH {_PLAN} SELECT coalesce(c.id, {_fresh('p.k')}) AS id, CASE WHEN p.k IS NOT NULL THEN p.est ELSE c.total_results_estimate END AS total_results_estimate, CASE WHEN p.k IS NULL THEN c.status WHEN c.k IS NULL THEN p.status WHEN c.status IN ('completed', 'error') THEN c.status ELSE p.status END AS status,
 CASE WHEN c.k IS NULL THEN 1 WHEN p.k IS NOT NULL AND c.status = 'needs_split' AND p.status = 'pending' THEN 1 ELSE c.page END AS page FROM cur c FULL JOIN plan p ON c.k = p.k""")
def task_upsert(get: Get) -> DataFrame:
    return dml.upsert_tasks(get("tasks"), _plan(get)).select("id", "total_results_estimate", "status", "page")


@query(f"""WITH {_PLAN} SELECT c.id, CASE WHEN c.id IN (SELECT task_id FROM papers WHERE task_id IS NOT NULL) THEN 'superseded' ELSE 'deleted' END AS action FROM cur c
 WHERE c.status IN ('needs_split', 'pending') AND c.k NOT IN (SELECT k FROM plan)
 AND NOT EXISTS (SELECT 1 FROM conference_aliases a WHERE a.conference_id = c.conference_id AND (c.query = a.query OR starts_with(c.query, a.query || ' ')))""")
def task_prune(get: Get) -> DataFrame:
    return dml.replace_plan(get("tasks"), _plan(get), get("papers").select("task_id"), get("conference_aliases"))


@query(f"""WITH {_PLAN}, gone AS (SELECT id, action FROM ({SQL['task_prune'].replace(f'WITH {_PLAN}', '')}))
SELECT 'tasks' AS tbl, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT id FROM gone WHERE action = 'superseded') OR status = 'superseded' AND error = 'not in the current plan') AS changed FROM tasks WHERE id NOT IN (SELECT id FROM gone WHERE action = 'deleted')
UNION ALL SELECT 'papers', count(*), count(*) FILTER (WHERE task_id IN (SELECT id FROM gone WHERE action = 'deleted')) FROM papers""")
def stale_tasks(get: Get) -> DataFrame:
    """What is left of tasks and papers once open tasks outside the plan are superseded or gone."""
    actions = dml.replace_plan(get("tasks"), _plan(get), get("papers").select("task_id"), get("conference_aliases"))
    tasks, papers = dml.drop_stale(get("tasks"), get("papers"), actions)
    one = tasks.agg(F.count("*").alias("n"), F.count_if((F.col("status") == "superseded") & (F.col("error") == "not in the current plan")).alias("changed"))
    freed = papers.join(get("papers").select("seq", F.col("task_id").alias("_was")), "seq")
    two = freed.agg(F.count("*").alias("n"), F.count_if(F.col("task_id").isNull() & F.col("_was").isNotNull()).alias("changed"))
    return one.select(F.lit("tasks").alias("tbl"), "n", "changed").unionByName(two.select(F.lit("papers").alias("tbl"), "n", "changed"))


@query("""SELECT t.id, coalesce(c.status, t.status) AS status, coalesce(c.error, t.error) AS error, coalesce(c.page, t.page) AS page FROM tasks t
 LEFT JOIN (SELECT id, max(status) AS status, max(error) AS error, max(page) AS page FROM tasks_copy GROUP BY id) c ON c.id = t.id""")
def task_changes(get: Get) -> DataFrame:
    return dml.change_tasks(get("tasks"), get("tasks_copy").select("id", "status", "error", "page")).select("id", "status", "error", "page")


@query("""WITH l AS (SELECT task_id AS id, count(DISTINCT hash) AS got FROM papers WHERE task_id <> 0 GROUP BY 1), s AS (SELECT t.id, coalesce(got, 0) AS got, total_results_estimate AS e FROM tasks t LEFT JOIN l USING (id)
 WHERE status = 'completed' AND total_results_estimate > 0 AND coalesce(got, 0) < total_results_estimate * 0.5)
SELECT t.id, CASE WHEN s.id IS NOT NULL THEN 'incomplete' ELSE t.status END AS status, CASE WHEN s.id IS NOT NULL THEN 'under-delivered: got ' || s.got || ' of ~' || s.e || ' estimated results' ELSE t.error END AS error FROM tasks t LEFT JOIN s ON s.id = t.id""")
def judged_again(get: Get) -> DataFrame:
    """Completed tasks judged by what they served."""
    return dml.judge_completed(get("tasks"), stats.shortfall(get("tasks"), stats.links(get("papers")), 0.5)).select("id", "status", "error")


@query("SELECT id, CASE WHEN status IN ('incomplete', 'error') THEN 'pending' ELSE status END AS status, CASE WHEN status IN ('incomplete', 'error') THEN NULL ELSE error END AS error, page FROM tasks")
def rerun_shortfall(get: Get) -> DataFrame:
    return dml.requeue(get("tasks"), ("incomplete", "error"), clear_error=True).select("id", "status", "error", "page")


@query("SELECT id, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status FROM tasks")
def reset_running(get: Get) -> DataFrame:
    return dml.requeue(get("tasks"), ("running",)).select("id", "status")


@query("SELECT t.id, coalesce(max(year(p.scraped_at) % 100), 0)::INTEGER + 1 AS page FROM tasks t LEFT JOIN papers p ON p.task_id = t.id GROUP BY t.id")
def page_reconcile(get: Get) -> DataFrame:
    pages = get("papers").select("task_id", (F.year("scraped_at") % 100).alias("page_number"))
    return dml.reconcile_pages(get("tasks"), pages)


@query("""SELECT p.seq, coalesce(nullif(p.conference_id, 0), t.conference_id) AS conference_id, coalesce(p.citations, 0) AS citations FROM papers p LEFT JOIN tasks t ON t.id = p.task_id""")
def backfill(get: Get) -> DataFrame:
    return dml.backfill_conferences(get("papers"), get("tasks")).select("seq", "conference_id", "citations")


@query("""SELECT hash, first(citations ORDER BY scraped_at DESC NULLS LAST, own DESC, seq DESC) AS citations, CASE WHEN max(own) = 0 THEN 'added' WHEN first(own ORDER BY scraped_at DESC NULLS LAST, own DESC, seq DESC) = 0 THEN 'updated' ELSE 'same' END AS change
 FROM (SELECT hash, citations, scraped_at, 1 AS own, seq FROM papers UNION ALL SELECT hash, citations, scraped_at, 0, seq FROM papers_copy) WHERE hash IS NOT NULL GROUP BY hash""")
def newest_counts(get: Get) -> DataFrame:
    side = lambda n, own: get(n).filter("hash is not null").select("hash", "citations", F.struct("scraped_at", F.lit(own).alias("o"), "seq").alias("at"))
    return dml.newest(side("papers", 1), side("papers_copy", 0), ["hash"], "citations", "at").select("hash", "citations", "change")


@query("""SELECT conference_id, query, ord FROM conference_aliases WHERE conference_id NOT IN (SELECT id FROM conferences WHERE type = 'journal')
 UNION ALL SELECT id, '"' || name || '"', 1 FROM conferences WHERE type = 'journal'""")
def alias_replace(get: Get) -> DataFrame:
    new = get("conferences").filter("type = 'journal'").select(F.col("id").alias("conference_id"), F.concat(F.lit('"'), "name", F.lit('"')).alias("query"), F.lit(1).alias("ord"))
    return dml.replace_aliases(get("conference_aliases"), new)


@query("""SELECT t.id, CASE WHEN c.n > 0 THEN c.n ELSE t.total_results_estimate END AS total_results_estimate FROM tasks t LEFT JOIN (SELECT id, max(total_results_estimate) AS n FROM tasks_copy GROUP BY id) c ON c.id = t.id""")
def estimate_refresh(get: Get) -> DataFrame:
    fresh = get("tasks_copy").select("id", F.col("total_results_estimate").alias("count"))
    return dml.refresh_estimates(get("tasks"), fresh).select("id", "total_results_estimate")


@query("""SELECT t.id, got FROM tasks t JOIN (SELECT task_id AS id, count(DISTINCT hash) AS got FROM papers WHERE task_id <> 0 GROUP BY 1) g ON g.id = t.id WHERE total_results_estimate > 0 AND page > 1 AND got >= total_results_estimate""")
def already_complete(get: Get) -> DataFrame:
    return dml.already_complete(get("tasks"), stats.links(get("papers")))


@query(f"""SELECT id, name, 'source:"' || name || '"' AS query, 'journal' AS type FROM conferences
 UNION ALL SELECT {_fresh('query')}, query, query, 'conference' FROM (SELECT DISTINCT query FROM conference_aliases) WHERE query NOT IN (SELECT name FROM conferences)""")
def venue_upsert(get: Get) -> DataFrame:
    """All venues renamed, and every alias a venue of its own."""
    known = get("conferences").select("name", F.concat(F.lit('source:"'), "name", F.lit('"')).alias("query"), F.lit("journal").alias("type"))
    new = get("conference_aliases").select(F.col("query").alias("name"), "query", F.lit("conference").alias("type")).distinct()
    return dml.upsert_venues(get("conferences"), known.unionByName(new.join(known.select("name"), "name", "left_anti")))


# ---- merge of a second store


_RANK = "CASE {} WHEN 'completed' THEN 6 WHEN 'incomplete' THEN 5 WHEN 'needs_split' THEN 4 WHEN 'error' THEN 3 WHEN 'superseded' THEN 2 WHEN 'pending' THEN 1 WHEN 'running' THEN 1 ELSE 0 END"


@query(rf"""WITH src0 AS (SELECT *, {_TKEY} AS k, trim(lower(status)) AS s0 FROM tasks_copy), src1 AS (SELECT * REPLACE (CASE WHEN s0 = 'running' THEN 'pending' ELSE s0 END AS status) FROM src0),
src AS (SELECT * FROM src1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY {_RANK.format('status')} DESC, coalesce(page, 0) DESC, id) = 1), cur AS (SELECT *, {_TKEY} AS k FROM tasks),
j AS (SELECT c.k AS ck, s.k AS sk, coalesce(c.id, {_fresh('s.k')}) AS id, c.status AS cs, c.page AS cp, c.total_results_estimate AS ce,
 CASE WHEN c.k IS NULL OR (s.k IS NOT NULL AND {_RANK.format('s.status')} > {_RANK.format('c.status')}) THEN s.status ELSE c.status END AS status, greatest(c.page, s.page) AS page,
 CASE WHEN c.total_results_estimate > 0 THEN c.total_results_estimate WHEN s.k IS NULL THEN c.total_results_estimate ELSE coalesce(s.total_results_estimate, c.total_results_estimate) END AS total_results_estimate
 FROM cur c FULL JOIN src s ON c.k = s.k)
SELECT id, 1::BIGINT AS with_this_id, status, page, total_results_estimate, CASE WHEN ck IS NULL THEN 'added' WHEN sk IS NOT NULL AND (status IS DISTINCT FROM cs OR page IS DISTINCT FROM cp OR total_results_estimate IS DISTINCT FROM ce) THEN 'updated' ELSE 'same' END AS change FROM j""")
def merge_tasks(get: Get) -> DataFrame:
    """Every task with the number of tasks that have its id, which must be 1."""
    same = F.count("*").over(Window.partitionBy("id"))  # an id has one row
    return merge.merge_tasks(get("tasks"), get("tasks_copy")).select("id", same.alias("with_this_id"), "status", "page", "total_results_estimate", "change")


_SIDE = """(SELECT hash, first(year ORDER BY seq) AS year, first(coalesce(citations, 0) ORDER BY seq) AS citations, first(task_id ORDER BY seq) FILTER (WHERE task_id <> 0) AS task_id,
 first(conference_id ORDER BY seq) FILTER (WHERE conference_id <> 0) AS conference_id, first(coalesce(sourced_from, '?') ORDER BY seq) AS sourced_from FROM {} WHERE hash IS NOT NULL GROUP BY hash)"""


def _side(df: DataFrame) -> DataFrame:
    seq, task, conf = F.col("seq"), dml.no_zero(F.col("task_id")), dml.no_zero(F.col("conference_id"))
    return df.filter("hash is not null").groupBy("hash").agg(F.min_by("year", seq).alias("year"), F.min_by(F.coalesce("citations", F.lit(0).cast("bigint")), seq).alias("citations"), F.min_by(task, F.when(task.isNotNull(), seq)).alias("task_id"), F.min_by(conf, F.when(conf.isNotNull(), seq)).alias("conference_id"), F.min_by(F.coalesce("sourced_from", F.lit("?")), seq).alias("sourced_from"))


@query(f"""WITH o AS {_SIDE.format('papers')}, s0 AS {_SIDE.format('papers_copy')}, s AS (SELECT hash, year, citations, conference_id, CASE WHEN task_id IN (SELECT id FROM tasks) THEN task_id END AS task_id,
 CASE WHEN task_id IS NOT NULL AND task_id NOT IN (SELECT id FROM tasks) THEN 'plan' ELSE sourced_from END AS sourced_from FROM s0)
SELECT coalesce(o.hash, s.hash) AS hash, coalesce(o.year, s.year) AS year, greatest(coalesce(o.citations, 0), coalesce(s.citations, 0)) AS citations, coalesce(o.task_id, s.task_id) AS task_id,
 coalesce(o.conference_id, s.conference_id) AS conference_id, CASE WHEN o.hash IS NULL THEN s.sourced_from WHEN o.task_id IS NULL AND s.task_id IS NOT NULL THEN 'crawl' ELSE o.sourced_from END AS sourced_from,
 CASE WHEN o.hash IS NULL THEN 'added' ELSE 'same' END AS change FROM o FULL JOIN s ON o.hash = s.hash""")
def merge_papers(get: Get) -> DataFrame:
    return merge.merge_papers(_side(get("papers")), _side(get("papers_copy")), get("tasks").select(F.col("id").alias("src_id"), F.col("id").alias("dst_id")))


@query(f"""SELECT c.id AS src_id, coalesce(o.id, {_fresh('c.name')}) AS dst_id, o.id IS NULL AS is_new FROM conferences c LEFT JOIN (SELECT * FROM conferences WHERE type = 'conference') o ON o.name = c.name""")
def merge_venues(get: Get) -> DataFrame:
    """A store that knows conferences only takes in one that knows journals too."""
    return merge.conference_map(merge.merge_conferences(get("conferences").filter("type = 'conference'"), get("conferences")), get("conferences"))


@query("""WITH o AS (SELECT DISTINCT hash, task_id FROM papers WHERE task_id <> 0), s AS (SELECT DISTINCT hash, task_id FROM papers_copy WHERE hash IS NOT NULL AND task_id IN (SELECT id FROM tasks))
SELECT hash, task_id, 'same' AS change FROM o UNION ALL SELECT hash, task_id, 'added' FROM (SELECT * FROM s EXCEPT SELECT * FROM o)""")
def merge_links(get: Get) -> DataFrame:
    links = lambda n: stats.links(get(n)).filter("hash is not null")
    return merge.merge_links(links("papers"), links("papers_copy"), get("tasks").select(F.col("id").alias("src_id"), F.col("id").alias("dst_id")))


@query("""SELECT 'tasks' AS tbl, change, count(*) AS n FROM (""" + SQL["merge_tasks"] + """) GROUP BY change UNION ALL SELECT 'papers', change, count(*) FROM (""" + SQL["merge_papers"] + """) GROUP BY change
 UNION ALL SELECT 'counts', change, count(*) FROM (""" + SQL["newest_counts"] + """) GROUP BY change""")
def merge_counts(get: Get) -> DataFrame:
    return merge.merge_stats(tasks=merge_tasks(get), papers=merge_papers(get), counts=newest_counts(get))


# ---- mining


@query(f"WITH {_terms_sql(False)} SELECT keyword, df FROM df")
def word_frequency(get: Get) -> DataFrame:
    return mining.document_frequency(documents_of(get))


@query(f"WITH {_terms_sql(True)} SELECT keyword, df FROM df")
def phrase_frequency(get: Get) -> DataFrame:
    return mining.document_frequency(documents_of(get), 3)


@query(f"""WITH {_cands_sql(False)}, ranked AS (SELECT *, row_number() OVER (ORDER BY balance DESC, total DESC, with_docs DESC, keyword) AS rank FROM cands), {_DEDUP}
SELECT row_number() OVER (ORDER BY rank) AS rank, keyword, with_docs, without_docs, round(balance, 9) AS balance FROM kept QUALIFY row_number() OVER (ORDER BY rank) <= 200""")
def mine_words(get: Get) -> DataFrame:
    return mining.mine(documents_of(get)).select(F.col("rank").cast("bigint").alias("rank"), "keyword", "with_docs", "without_docs", F.round("balance", 9).alias("balance"))


@query(f"""WITH {_cands_sql(True)}, ranked AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN contains(keyword, ' ') THEN balance * 1.5::DOUBLE ELSE balance END DESC, total DESC, with_docs DESC, keyword) AS rank FROM cands), {_DEDUP}
SELECT row_number() OVER (ORDER BY rank) AS rank, keyword, with_docs, without_docs, round(balance, 9) AS balance FROM kept QUALIFY row_number() OVER (ORDER BY rank) <= 200""")
def mine_phrases(get: Get) -> DataFrame:
    return mining.mine(documents_of(get), mining.MiningOptions(longest=3, phrase_boost=1.5)).select(F.col("rank").cast("bigint").alias("rank"), "keyword", "with_docs", "without_docs", F.round("balance", 9).alias("balance"))


_VENUE = "pairs AS (SELECT DISTINCT conference_id, hash FROM papers WHERE conference_id <> 0)"
_VENUE_MINED = f"""{_HEALED}, {_VENUE}, toks AS (SELECT hash, {_WORDS.format("coalesce(title, '') || ' ' || coalesce(snippet, '')")} AS a FROM healed), terms AS (SELECT hash, unnest(list_distinct(list_filter(a, lambda x: {_CONTENT.format('x')}))) AS keyword FROM toks),
bg AS (SELECT keyword, count(*) AS bg_df FROM terms GROUP BY 1), df AS (SELECT conference_id, keyword, count(*) AS df FROM terms JOIN pairs USING (hash) GROUP BY ALL), n AS (SELECT conference_id, count(*) AS total FROM pairs GROUP BY 1), b AS (SELECT count(*) AS bg_n FROM healed),
cands AS (SELECT conference_id, keyword, df AS with_docs, total - df AS without_docs, total, {_BAL.format('df', '(total - df)')} AS balance, ln(1.0::DOUBLE + bg_n::DOUBLE / (1.0::DOUBLE + coalesce(bg_df, 0)::DOUBLE)) AS idf FROM df JOIN n USING (conference_id) LEFT JOIN bg USING (keyword), b
 WHERE {_BAL.format('df', '(total - df)')} >= 0.15 AND df >= 3 AND df <= total * 0.95::DOUBLE), ranked AS (SELECT *, row_number() OVER (PARTITION BY conference_id ORDER BY round(balance * idf, 12) DESC, with_docs DESC, keyword) AS rank FROM cands),
kept AS (SELECT * FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.conference_id = a.conference_id AND b.rank > a.rank AND b.keyword <> a.keyword AND contains(b.keyword, a.keyword))),
mined AS (SELECT conference_id, row_number() OVER (PARTITION BY conference_id ORDER BY rank) AS rank, keyword, with_docs, balance, idf FROM kept QUALIFY row_number() OVER (PARTITION BY conference_id ORDER BY rank) <= 200)"""


def venue_texts(get: Get) -> DataFrame:
    """(conference_id, hash, title, snippet): the documents of every venue."""
    return documents_of(get).drop("conference_id").join(get("papers").filter("conference_id <> 0").select("conference_id", "hash").distinct(), "hash").select("conference_id", "hash", "title", "snippet")


@query(f"WITH {_VENUE_MINED} SELECT conference_id, rank, keyword, with_docs, round(balance, 9) AS balance, round(idf, 9) AS idf FROM mined")
def mine_idf(get: Get) -> DataFrame:
    """The ranked words of every venue against all papers."""
    mined = mining.mine_idf(venue_texts(get), documents_of(get), by=("conference_id",))
    return mined.select("conference_id", F.col("rank").cast("bigint").alias("rank"), "keyword", "with_docs", F.round("balance", 9).alias("balance"), F.round("idf", 9).alias("idf"))


@query(f"""WITH {_cands_sql(False)}, ranked AS (SELECT keyword, row_number() OVER (ORDER BY keyword) AS rank FROM cands)
SELECT keyword FROM ranked a WHERE NOT EXISTS (SELECT 1 FROM ranked b WHERE b.rank < a.rank AND length(a.keyword) <> length(b.keyword) AND (contains(b.keyword, a.keyword) OR contains(a.keyword, b.keyword)))""")
def dedup_keywords(get: Get) -> DataFrame:
    ranked = mining.rank(mining.candidates(documents_of(get), mining.MiningOptions()), [F.col("keyword")])
    return mining.drop_contained(ranked, kept_first=True).select("keyword")


@query(f"""WITH {_cands_sql(False)}, r AS (SELECT keyword, (count(*) OVER () - row_number() OVER (ORDER BY balance DESC, with_docs DESC, keyword) + 1)::DOUBLE AS score, total AS corpus_size FROM cands) SELECT * FROM r""")
def keyword_scores(get: Get) -> DataFrame:
    ranked = mining.rank(mining.candidates(documents_of(get), mining.MiningOptions()), [F.col("balance").desc(), F.col("with_docs").desc(), F.col("keyword")])
    n = ranked.agg(F.count("*").alias("_n"))
    return ranked.crossJoin(F.broadcast(n)).select("keyword", (F.col("_n") - F.col("rank") + 1).cast("double").alias("score"), F.col("total").alias("corpus_size"))


def with_keywords(f: Callable[[Get, DataFrame], DataFrame], get: Get) -> DataFrame:
    return f(get, keywords_of(get("conferences").sparkSession))


@query(f"WITH {_TEXTS} SELECT keyword, count(*) AS df FROM texts, kws WHERE contains(t, keyword) GROUP BY keyword HAVING count(*) <= (SELECT count(*) FROM texts) * 0.9::DOUBLE")
def viable_keywords(get: Get) -> DataFrame:
    return with_keywords(lambda g, k: mining.viable(texts_of(g), k, 0.9), get)


@query(f"WITH kws(keyword, rank) AS (VALUES {_KW}) SELECT c.id, keyword FROM conferences c, kws WHERE NOT contains(lower(c.query), keyword)")
def degenerate_drop(get: Get) -> DataFrame:
    def run(g: Get, k: DataFrame) -> DataFrame:
        named = g("conferences").crossJoin(F.broadcast(k))  # both sides are configuration
        return mining.drop_degenerate(named, F.col("query")).select("id", "keyword")

    return with_keywords(run, get)


_BRANCH = f"WITH {_TEXTS}, sub AS (SELECT * FROM texts WHERE contains(t, 'model') AND NOT contains(t, 'survey')), c AS (SELECT keyword, rank AS pos, (SELECT count(*) FROM sub) AS subset, (SELECT count(*) FROM sub WHERE contains(t, keyword)) AS with_docs FROM kws)"


@query(f"{_BRANCH} SELECT keyword, subset, with_docs FROM c")
def branch_counts(get: Get) -> DataFrame:
    return with_keywords(lambda g, k: mining.branch_counts(texts_of(g), ["model"], ["survey"], k), get)


@query(f"""{_BRANCH}, s AS (SELECT *, CASE WHEN subset = 0 THEN -1.0 ELSE {_BAL.format('with_docs', '(subset - with_docs)')} END AS score FROM c)
SELECT keyword, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM s""")
def branch_rank(get: Get) -> DataFrame:
    return with_keywords(lambda g, k: mining.branch_rank(mining.branch_counts(texts_of(g), ["model"], ["survey"], k), k).select("keyword", F.col("rank").cast("bigint").alias("rank")), get)


# ---- partitioning and planning


@query(f"WITH {_TEXTS} SELECT hash, keyword FROM texts, kws WHERE contains(t, keyword)")
def keyword_membership(get: Get) -> DataFrame:
    return with_keywords(lambda g, k: mining.membership(texts_of(g), k), get)


_ATOMS = f"WITH {_TEXTS}, sig AS (SELECT hash, coalesce(string_agg(keyword, '|' ORDER BY keyword) FILTER (WHERE contains(t, keyword)), '') AS signature FROM texts, kws GROUP BY hash), atoms AS (SELECT signature, count(*) AS size FROM sig GROUP BY signature)"


@query(f"{_ATOMS} SELECT signature, size FROM atoms")
def document_atoms(get: Get) -> DataFrame:
    return with_keywords(lambda g, k: partition.atoms(texts_of(g), k).select(F.array_join("signature", "|").alias("signature"), "size"), get)


@query(f"{_ATOMS} SELECT count(*) AS atoms, max(size) AS largest, max(size) <= 400 AS feasible FROM atoms")
def feasibility(get: Get) -> DataFrame:
    return with_keywords(lambda g, k: partition.feasible(partition.atoms(texts_of(g), k), 400), get)


@query(f"""WITH {_TEXTS}, c AS (SELECT keyword, count(*) AS with_docs, (SELECT count(*) FROM texts) - count(*) AS without_docs FROM texts, kws WHERE contains(t, keyword) GROUP BY keyword)
SELECT keyword, with_docs, without_docs, round({_BAL.format('with_docs', 'without_docs')}, 9) AS balance FROM c WHERE without_docs > 0 ORDER BY {_BAL.format('with_docs', 'without_docs')} DESC, keyword LIMIT 1""")
def best_split_root(get: Get) -> DataFrame:
    return with_keywords(lambda g, k: partition.best_split(texts_of(g), k).select("keyword", "with_docs", "without_docs", F.round("balance", 9).alias("balance")), get)


def _partitioned(get: Get) -> tuple[DataFrame, DataFrame]:
    docs = texts_of(get).select(F.coalesce("year", F.lit(0)).alias("grp"), "hash", "text")
    return partition.partition(docs, keywords_of(docs.sparkSession), limit=60, min_balance=0.15)


_MEMBERS = "mem AS (SELECT hash, keyword, rank FROM texts, kws WHERE contains(t, keyword))"


def _tree(docs: str, limit: str, pick: str) -> str:
    """A recursive query: tree (grp, hash, path, inc, exc, state), of which state 1 is a whole node and 2 one that nothing divides."""
    return f"""tree AS (SELECT grp, hash, '' AS path, []::VARCHAR[] AS inc, []::VARCHAR[] AS exc, 0 AS state FROM {docs} UNION ALL
 (WITH o AS (SELECT * FROM tree WHERE state = 0), sz AS (SELECT grp, path, count(*) AS size FROM o GROUP BY ALL),
 cnt AS (SELECT o.grp, o.path, size, keyword, rank, count(*) AS w FROM o JOIN sz ON sz.grp = o.grp AND sz.path = o.path JOIN mem USING (hash) WHERE size > {limit} GROUP BY ALL),
 bal AS (SELECT *, {_BAL.format('w', '(size - w)')} AS even FROM cnt WHERE w < size), ok AS (SELECT * FROM bal WHERE even >= 0.15), p AS ({pick})
 SELECT o.grp, o.hash, CASE WHEN kw IS NULL THEN o.path WHEN m.hash IS NOT NULL THEN o.path || '0' ELSE o.path || '1' END, CASE WHEN m.hash IS NOT NULL THEN list_append(inc, kw) ELSE inc END,
  CASE WHEN kw IS NOT NULL AND m.hash IS NULL THEN list_append(exc, kw) ELSE exc END, CASE WHEN size <= {limit} THEN 1 WHEN kw IS NULL THEN 2 ELSE 0 END
 FROM o JOIN sz ON sz.grp = o.grp AND sz.path = o.path LEFT JOIN p ON p.grp = o.grp AND p.path = o.path LEFT JOIN mem m ON m.hash = o.hash AND m.keyword = kw))"""


@query(f"""WITH RECURSIVE {_TEXTS}, {_MEMBERS}, docs AS (SELECT coalesce(year, 0) AS grp, hash FROM texts), {_tree('docs', '60', 'SELECT grp, path, first(keyword ORDER BY even DESC, rank) AS kw FROM ok GROUP BY ALL')},
node AS (SELECT grp, path, inc, exc, state = 1 AS resolved, count(*) AS size FROM tree WHERE state > 0 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY grp, resolved ORDER BY path) AS r FROM node)
SELECT grp, CASE WHEN resolved THEN r ELSE -r END AS seq, resolved, size, array_to_string(inc, '|') AS includes, array_to_string(exc, '|') AS excludes FROM n""")
def partition_buckets(get: Get) -> DataFrame:
    """The buckets of every year's papers."""
    buckets = partition.bucket_table(_partitioned(get)[1])
    return buckets.select("grp", F.col("seq").cast("bigint").alias("seq"), "resolved", "size", F.array_join("includes", "|").alias("includes"), F.array_join("excludes", "|").alias("excludes"))


@query(SQL["partition_buckets"].split("SELECT grp, CASE WHEN resolved")[0] + "SELECT n.grp, CASE WHEN resolved THEN r ELSE -r END AS seq, hash FROM tree JOIN n ON n.grp = tree.grp AND n.path = tree.path WHERE state > 0")
def document_buckets(get: Get) -> DataFrame:
    """The bucket of every paper."""
    return partition.document_buckets(*_partitioned(get)).select("grp", F.col("seq").cast("bigint").alias("seq"), "hash")


@query("SELECT count(DISTINCT hash) AS documents, count(DISTINCT hash) AS placed, 0::BIGINT AS twice, 0::BIGINT AS too_large FROM papers")
def partition_invariants(get: Get) -> DataFrame:
    placed, nodes = _partitioned(get)
    per = placed.groupBy("hash").agg(F.count("*").alias("n")).agg(F.count("*").alias("placed"), F.count_if(F.col("n") > 1).alias("twice"))
    large = nodes.agg(F.sum("size").alias("documents"), F.count_if(F.col("resolved") & (F.col("size") > 60)).alias("too_large"))
    return large.crossJoin(F.broadcast(per)).select("documents", "placed", "twice", "too_large")


_COUNTS = """cnt AS (SELECT c.id, c.query, p.year, count(*) AS n FROM papers p JOIN conferences c ON c.id = p.conference_id GROUP BY ALL),
known AS (SELECT query, year AS year_from, year AS year_to, n AS count FROM cnt UNION ALL SELECT a.query, a.year - (a.year - 2000) % 2, a.year - (a.year - 2000) % 2 + 1, sum(a.n)::BIGINT FROM cnt a WHERE a.year >= 2000 GROUP BY ALL)"""


SQL["cached_counts"] = SQL["cached_counts"].format(_COUNTS)


def _known(get: Get) -> DataFrame:
    c = get("conferences").select(F.col("id").alias("conference_id"), "query")
    one = get("papers").select("conference_id", "year").join(c, "conference_id").groupBy("query", "year").agg(F.count("*").alias("count"))
    start = F.col("year") - (F.col("year") - 2000) % 2
    two = one.filter("year >= 2000").groupBy("query", start.alias("year_from")).agg(F.sum("count").alias("count")).select("query", "year_from", (F.col("year_from") + 1).alias("year_to"), "count")
    return one.select("query", F.col("year").alias("year_from"), F.col("year").alias("year_to"), "count").unionByName(two)


@query(f"""WITH {_COUNTS}, w AS (SELECT c.query, y AS year_from, least(y + 1, 2024) AS year_to FROM conferences c, range(2000, 2025, 2) t(y)), wc AS (SELECT w.*, k.count FROM w LEFT JOIN known k USING (query, year_from, year_to)),
s AS (SELECT query, unnest([year_from, year_to]) AS y FROM wc WHERE count > 15 AND year_to > year_from), r AS (SELECT query, year_from, year_to, count FROM wc WHERE NOT coalesce(count > 15 AND year_to > year_from, false)
 UNION ALL SELECT s.query, y, y, k.count FROM s LEFT JOIN known k ON k.query = s.query AND k.year_from = y AND k.year_to = y)
SELECT query, year_from::INTEGER AS year_from, year_to::INTEGER AS year_to, count, coalesce(count > 15, true) AS needs_split FROM r""")
def year_windows(get: Get) -> DataFrame:
    return splitting.year_windows(get("conferences").select("query"), 2000, 2024, _known(get), 15)


@query("""SELECT t.conference_id, t.year_from AS year, count(*) AS leaves, sum(total_results_estimate)::BIGINT AS estimate FROM tasks t LEFT JOIN (SELECT conference_id, year, count(*) AS n FROM papers GROUP BY ALL) c ON c.conference_id = t.conference_id AND c.year = t.year_from
 WHERE year_from = year_to AND len(keywords) > 0 GROUP BY t.conference_id, t.year_from HAVING count(*) >= 2 AND bool_and(coalesce(total_results_estimate > 0, false)) AND (any_value(n) IS NULL OR sum(total_results_estimate) >= 0.95 * any_value(n))""")
def reusable_years(get: Get) -> DataFrame:
    counts = get("papers").groupBy("conference_id", "year").agg(F.count("*").alias("count"))
    return planner.reusable_years(get("tasks"), counts)


@query("""WITH k AS (SELECT conference_id, year, count(DISTINCT hash) AS known, count(*) * 3 AS "true" FROM papers WHERE conference_id IS NOT NULL GROUP BY ALL)
SELECT conference_id, year, known, "true", round(CASE WHEN "true" > known THEN known::DOUBLE / "true"::DOUBLE ELSE 1.0 END, 9) AS coverage, greatest(1, floor(40.0::DOUBLE * known::DOUBLE / "true"::DOUBLE))::INTEGER AS doc_limit FROM k""")
def document_limits(get: Get) -> DataFrame:
    p = get("papers").filter("conference_id is not null")
    counts = p.groupBy("conference_id", "year").agg((F.count("*") * 3).alias("count"))
    return planner.document_limits(p, counts, 50, 0.8).withColumn("coverage", F.round("coverage", 9))


@query(f"""WITH {_VENUE_MINED}, vt AS (SELECT conference_id, hash, lower(coalesce(title, '') || ' ' || coalesce(snippet, '')) AS t FROM healed JOIN pairs USING (hash)), conf(keyword, rank) AS (VALUES {_KW}),
both_ AS (SELECT conference_id, keyword, rank FROM mined UNION ALL SELECT id, keyword, rank + 1000000 FROM conferences, conf), f AS (SELECT conference_id, keyword, min(rank) AS rank FROM both_ GROUP BY ALL),
words AS (SELECT *, length(keyword) - length(replace(keyword, ' ', '')) AS w FROM f), clean AS (SELECT * FROM words a WHERE NOT EXISTS (SELECT 1 FROM words b WHERE b.conference_id = a.conference_id AND b.w = a.w AND b.rank < a.rank AND length(a.keyword) <> length(b.keyword) AND (contains(b.keyword, a.keyword) OR contains(a.keyword, b.keyword)))),
own AS (SELECT clean.* FROM clean JOIN conferences c ON c.id = conference_id WHERE NOT contains(lower(query), lower(keyword))), d AS (SELECT own.conference_id, keyword, count(*) AS df FROM own JOIN vt ON vt.conference_id = own.conference_id AND contains(t, lower(keyword)) GROUP BY ALL), n2 AS (SELECT conference_id, count(*) AS total FROM vt GROUP BY 1)
SELECT own.conference_id, own.keyword, rank::BIGINT AS rank FROM own LEFT JOIN d USING (conference_id, keyword) LEFT JOIN n2 USING (conference_id) WHERE coalesce(total, 0) = 0 OR df <= total * 0.75::DOUBLE""")
def venue_keywords(get: Get) -> DataFrame:
    """The keyword pool of every venue: its own mined words, then configured ones."""
    by = ("conference_id",)
    venue = cut_lineage(venue_texts(get))
    mined = mining.mine_idf(venue, documents_of(get), by=by)
    named = get("conferences").select(F.col("id").alias("conference_id"), "query")

    def run(g: Get, k: DataFrame) -> DataFrame:
        configured = named.crossJoin(F.broadcast(k))  # both sides are configuration
        texts = venue.select("conference_id", "hash", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))).alias("text"))
        return planner.keyword_pool(mined.join(F.broadcast(named), "conference_id"), configured, texts, F.col("query"), by=by)

    return with_keywords(run, get)


@query()
def year_leaves(get: Get) -> DataFrame:
    """Every venue and year with over 90 % of the most papers of any, planned and verified against counts of the papers themselves."""
    papers, spark = cut_lineage(documents_of(get).filter("conference_id is not null")), get("conferences").sparkSession
    counts = cut_lineage(papers.groupBy("conference_id", "year").agg(F.count("*").alias("n")))
    cap = max(2, (counts.agg(F.max("n")).first()[0] or 0) * 9 // 10)
    o = planner.Limits(max_results=cap, min_papers_to_trust=2, min_balance=0.0)
    out = []
    for r in counts.filter(F.col("n") >= cap).collect():  # the few over the cap
        docs = papers.filter((F.col("conference_id") == r.conference_id) & (F.col("year") == r.year)).select("hash", "title", "snippet", "year")
        ok, leaves = planner.plan_year(docs, '"all"', r.year, r.n, keywords_of(spark), _counted(docs), o)
        out += [(r.conference_id, r.year, x.query, list(x.keywords), x.count, ok) for x in leaves]
    return spark.createDataFrame(out or [], "conference_id long, year int, query string, keywords array<string>, count long, complete boolean")


def _counted(docs: DataFrame) -> splitting.CountOracle:
    """Counts of rendered searches taken from the documents themselves."""
    corpus = planner.Corpus.of(planner.texts(docs), keywords_of(docs.sparkSession))

    class Known(splitting.CountOracle):
        def __call__(self, text: str, *_: int) -> int:
            import re

            return sum(n for _, n in corpus.subset(tuple(re.findall(r' AND "([^"]*)"', text)), tuple(re.findall(r' -"([^"]*)"', text))))

    return Known({})


_FIRST_CLEAN = "SELECT grp, path, first(keyword ORDER BY (greatest(w, size - w) <= floor(size * 0.75)) DESC, CASE WHEN greatest(w, size - w) <= floor(size * 0.75) THEN rank END, even DESC, rank) AS kw FROM ok GROUP BY ALL"


@query(f"""WITH RECURSIVE {_TEXTS}, {_MEMBERS}, docs AS (SELECT 0 AS grp, hash FROM texts), cap AS (SELECT greatest(1, count(*) // 3) AS n FROM texts), {_tree('docs', '(SELECT n FROM cap)', _FIRST_CLEAN)},
node AS (SELECT path, inc, exc, state, count(*) AS n FROM tree WHERE state > 0 GROUP BY ALL)
SELECT '"all"' || array_to_string(list_transform(inc, lambda w: ' AND "' || w || '"'), '') || array_to_string(list_transform(exc, lambda w: ' -"' || w || '"'), '') AS query,
 array_to_string(list_concat(inc, exc), '|') AS keywords, n AS count, (SELECT bool_and(state = 1) FROM node) AS complete FROM node WHERE state = 1""")
def over_cap_split(get: Get) -> DataFrame:
    """Leaves of the paper collection taken as one over-full search, from counts of conditioned texts."""
    spark = get("conferences").sparkSession
    count = _counted(documents_of(get))
    total = count("")
    ok, leaves = splitting.split_leaf('"all"', (0, 0), total, list(_KEYWORDS), count, max(1, total // 3))
    return spark.createDataFrame([(x.query, "|".join(x.keywords), x.count, ok) for x in leaves] or [], "query string, keywords string, count bigint, complete boolean")


@query()
def parsed_pages(get: Get) -> DataFrame:
    """The recorded page fragments of the papers, read again."""
    from stemma.sources.pages import page_papers, parse_pages

    pages = get("papers").filter("raw_html is not null").select(F.col("task_id"), F.col("seq").cast("int").alias("page_number"), F.concat(F.lit('<div id="gs_res_ccl"><div class="gs_r gs_or">'), "raw_html", F.lit("</div></div>")).alias("html"))
    return page_papers(parse_pages(pages)).select("task_id", "page_number", "hash", "title", "year")


_WALK = """WITH e AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page_number, CASE WHEN value < 10 THEN '' ELSE event_type END AS fingerprint,
 value >= 10 AS filled, value >= 60 AS fresh, value < 95 AS has_next FROM events),
b AS (SELECT *, fingerprint <> '' AND fingerprint = lag(fingerprint) OVER w AS stall, sum(filled::INT) OVER u AS b1, sum((filled AND fresh)::INT) OVER u AS b2 FROM e WINDOW w AS (PARTITION BY task_id ORDER BY page_number), u AS (PARTITION BY task_id ORDER BY page_number ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, sum((NOT filled)::INT) OVER (PARTITION BY task_id, b1 ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS empty_run, sum((filled AND NOT fresh)::INT) OVER (PARTITION BY task_id, b2 ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS stale_run FROM b),
x AS (SELECT task_id, page_number, CASE WHEN coalesce(stall, false) THEN 'error|same results as the page before' WHEN NOT filled AND NOT has_next THEN 'completed|no results and no next page' WHEN NOT filled AND empty_run >= 3 THEN 'needs_split|empty pages in a row'
 WHEN filled AND stale_run >= 6 THEN 'completed|nothing new on pages in a row' WHEN filled AND NOT has_next THEN 'completed|no next page' WHEN page_number >= 52 THEN 'needs_split|page cap, estimate unknown or over the limit' END AS ended FROM r)
SELECT task_id, first(page_number ORDER BY page_number)::INTEGER AS page_number, split_part(first(ended ORDER BY page_number), '|', 1) AS status, split_part(first(ended ORDER BY page_number), '|', 2) AS reason FROM x WHERE ended IS NOT NULL GROUP BY task_id"""


@query(_WALK)
def page_walk(get: Get) -> DataFrame:
    """The end of each walk, events standing in for pages."""
    from stemma.streaming.pagewalk import walk_batch

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = get("events").withColumn("page_number", F.row_number().over(w))
    pages = e.select(F.col("user_id").alias("task_id"), "page_number", F.when(F.col("value") < 10, "").otherwise(F.col("event_type")).alias("fingerprint"), F.when(F.col("value") < 10, 0).otherwise(10).alias("items"), F.when(F.col("value") < 60, 0).otherwise(3).alias("added"), (F.col("value") < 95).alias("has_next"), F.lit(0).alias("estimate"))
    return walk_batch(pages)
