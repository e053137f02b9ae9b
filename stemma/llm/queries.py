"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stemma.llm import leaks, relevance as rel, sentences, survivors as sur, terms, tokenizer, truncation
from stemma.session import table

PAPER_TEXT = ("title", "snippet")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    papers = table(spark, root, "papers")
    counted = terms.term_frequencies(papers, terms.record_text(*PAPER_TEXT))
    total = F.broadcast(papers.agg(F.count("*").alias("total")))  # one row
    marked = terms.mark_terms(counted.crossJoin(total), F.col("total"))
    return marked.filter("verdict <> 'useful'").select("term", "occurrences", "n_records", "verdict")


def p1_terms(spark: SparkSession, root: str) -> DataFrame:
    return terms.term_frequencies(table(spark, root, "papers"), terms.record_text(*PAPER_TEXT)).select("term", "occurrences", "n_records")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    scored = rel.relevance(table(spark, root, "papers"), "seq", terms.record_text(*PAPER_TEXT), min_tf=3, floor=(3, 6))
    return scored.filter("df <= 6").select(F.col("id").alias("seq"), "term")  # a weight may also come from a higher tf


def p4_scores(spark: SparkSession, root: str) -> DataFrame:
    scored = rel.relevance(table(spark, root, "papers"), "seq", terms.record_text(*PAPER_TEXT))
    return scored.select(F.col("id").alias("seq"), "term", "tf", "df", F.round("weight", 6).alias("weight"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    kept = sur.survivors(table(spark, root, "papers"))
    return kept.select("hash", F.col("text_row").alias("snippet_seq"), F.col("count_row").alias("citations_seq"), F.col("task_id_row").alias("task_seq"), F.col("conference_id_row").alias("conference_seq"))


def p5_values(spark: SparkSession, root: str) -> DataFrame:
    return sur.true_values(table(spark, root, "papers"), texts=("snippet",), counts=("citations",)).withColumnRenamed("grp", "hash")


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, root, "documents"))


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.decode_corpus(p6_ids(spark, root), tokenizer.pieces(spark))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncated(table(spark, root, "papers")).filter("cut").select(F.col("id").alias("seq"), "field")


def p3_rates(spark: SparkSession, root: str) -> DataFrame:
    papers = table(spark, root, "papers")
    return truncation.truncation_rates(truncation.truncated(papers), papers)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id")


def p7_places(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return sentences.sentences(table(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p3_found, p3_rates, p4_found, p4_scores, p5_found, p5_values, p6_ids, p6_decoded, p7_found, p7_places, p8_found)}

_TERMS = r"""
rows AS (SELECT seq, lower(nfc_normalize(coalesce(title, '') || ' ' || coalesce(snippet, ''))) AS txt FROM papers),
tok AS (SELECT seq, unnest(regexp_extract_all(txt, '[\p{L}\p{N}]+')) AS term FROM rows),
tf AS (SELECT seq, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS n_records FROM tf GROUP BY ALL)
"""

_STAND = r"""s AS (SELECT *, regexp_replace(snippet, '^\s+|\s+$', '', 'g') AS t FROM papers),
pairs AS (SELECT DISTINCT lower(t) AS k, hash FROM s WHERE length(t) > 0),
stand AS (SELECT k FROM pairs GROUP BY k HAVING count(*) >= 5 AND count(*) >= 0.002 * (SELECT count(*) FROM pairs))"""


def _model(rounds: int = 8) -> str:
    """The rounds of the quality model one after another: what each source is worth, then what each pattern is."""
    quality = "q0 AS (SELECT DISTINCT field, src, 0.7::DOUBLE AS a, 0.9::DOUBLE AS b FROM votes), b0 AS (SELECT DISTINCT field, 0.5::DOUBLE AS p FROM pat)"
    steps = []
    for k in range(rounds + 1):
        steps.append(quality)
        steps.append(f"""p{k} AS (SELECT pid, field, weight, 1 / (1 + exp(-(score + ln(b.p / (1 - b.p))))) AS probability FROM pat JOIN b{k} b USING (field)
 JOIN (SELECT pid, sum(CASE WHEN said = 1 THEN ln(a / (1 - b)) ELSE ln((1 - a) / b) END) AS score FROM votes JOIN q{k} USING (field, src) GROUP BY pid) USING (pid))""")
        quality = f"""q{k + 1} AS (SELECT v.field, src, (sum(v.weight * probability * said) + 14) / (sum(v.weight * probability) + 20) AS a, (sum(v.weight * (1 - probability) * (1 - said)) + 18) / (sum(v.weight * (1 - probability)) + 20) AS b
 FROM votes v JOIN p{k} USING (pid) GROUP BY v.field, src), b{k + 1} AS (SELECT field, (sum(weight * probability) + 10) / (sum(weight) + 20) AS p FROM p{k} GROUP BY field)"""
    return ", ".join(steps)


SQL = {
    "p1_found": f"""WITH {_TERMS}
SELECT term, occurrences, n_records, CASE WHEN n_records < 3 THEN 'rare' ELSE 'common' END AS verdict FROM df
WHERE n_records < 3 OR n_records > (SELECT count(*) FROM papers) * 0.25""",
    "p1_terms": f"WITH {_TERMS} SELECT term, occurrences, n_records FROM df",
    "p4_found": f"WITH {_TERMS} SELECT seq, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND n_records <= 6",
    "p4_scores": f"""WITH {_TERMS}, len AS (SELECT seq, sum(tf) AS length FROM tf GROUP BY seq),
n AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean FROM len)
SELECT seq, term, tf, n_records AS df,
 round(ln(1 + (n - n_records + 0.5) / (n_records + 0.5)) * tf::DOUBLE * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS weight
FROM tf JOIN df USING (term) JOIN len USING (seq), n""",
    "p5_found": r"""WITH s AS (SELECT *, regexp_replace(snippet, '^\s+|\s+$', '', 'g') AS t FROM papers),
pairs AS (SELECT DISTINCT lower(t) AS k, hash FROM s WHERE length(t) > 0),
stand AS (SELECT k FROM pairs GROUP BY k HAVING count(*) >= 5 AND count(*) >= 0.002 * (SELECT count(*) FROM pairs)),
r AS (SELECT *, CASE WHEN length(t) > 0 AND lower(t) NOT IN (SELECT k FROM stand) THEN length(t) END AS len FROM s)
SELECT hash,
 coalesce(first(seq ORDER BY len DESC NULLS LAST, seq) FILTER (WHERE len IS NOT NULL), 0) AS snippet_seq,
 coalesce(first(seq ORDER BY scraped_at DESC NULLS LAST, seq) FILTER (WHERE citations >= 0), 0) AS citations_seq,
 coalesce(first(seq ORDER BY (sourced_from IS NOT DISTINCT FROM 'crawl') DESC, scraped_at DESC NULLS LAST, seq) FILTER (WHERE task_id <> 0), 0) AS task_seq,
 coalesce(first(seq ORDER BY (sourced_from IS NOT DISTINCT FROM 'crawl') DESC, scraped_at DESC NULLS LAST, seq) FILTER (WHERE conference_id <> 0), 0) AS conference_seq
FROM r WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) >= 2""",
    "p5_values": f"""WITH {_STAND}, r AS (SELECT *, coalesce(sourced_from, '(none)') AS src FROM s WHERE hash IS NOT NULL),
claims AS (SELECT DISTINCT hash, src, field, value FROM (SELECT hash, src, 'task_id' AS field, nullif(task_id, 0)::VARCHAR AS value FROM r UNION ALL SELECT hash, src, 'conference_id', nullif(conference_id, 0)::VARCHAR FROM r
 UNION ALL SELECT hash, src, 'citations', citations::VARCHAR FROM r WHERE citations >= 0 UNION ALL SELECT hash, src, 'snippet', t FROM r WHERE length(t) > 0 AND lower(t) NOT IN (SELECT k FROM stand)) WHERE value IS NOT NULL),
asserted AS (SELECT hash, field, value, list_sort(list(DISTINCT src)) AS yes FROM claims GROUP BY ALL), saw AS (SELECT hash, list_sort(list(DISTINCT src)) AS every FROM r GROUP BY hash),
known AS (SELECT hash, field, value, yes, list_filter(every, lambda x: NOT list_contains(yes, x)) AS no FROM asserted JOIN saw USING (hash)),
pat AS (SELECT field, yes, no, count(*) AS weight, row_number() OVER () AS pid FROM known GROUP BY field, yes, no),
votes AS (SELECT pid, field, weight, unnest(yes) AS src, 1 AS said FROM pat UNION ALL SELECT pid, field, weight, unnest(no), 0 FROM pat), {_model()},
judged AS (SELECT hash, known.field, value, probability, max(probability) OVER (PARTITION BY hash, known.field) AS best FROM known JOIN pat ON pat.field = known.field AND pat.yes = known.yes AND pat.no = known.no JOIN p8 USING (pid))
SELECT hash, field, value, round(probability, 6) AS probability, probability >= 0.5 OR probability = best AS judged_true FROM judged""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
