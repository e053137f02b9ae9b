"""Best representative of each duplicate group.

Two operators:

``source_quality`` / ``true_values``: a latent two-sided quality model. A value of a group is a fact whose truth is
hidden; a source that saw the group asserts it or stays silent. Expectation-maximisation infers each source's sensitivity
(how often it asserts a true value) and specificity (how often it is silent on a false one), and every value judged true
is retained, so a field may keep several. Facts with the same pattern of assertions share one row of the iteration.

``survivors``: field-by-field choice by declared preferences (longest real text, last seen, trusted source first). It
is one aggregation whose state is a few numbers a group, combined before the shuffle, so a group may hold any share of
the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stemma.session import cut_lineage, write_cut

#: A text that recurs in at least this share of all (text, group) pairs is a stand-in; so there are at most 1 / share.
STANDIN_SHARE = 0.002
STANDIN_GROUPS = 5
#: Patterns of assertion, at most 2 ** sources a field, up to which they are joined to the facts by broadcast.
MOST_PATTERNS = 100_000


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text in the count of stand-ins."""
    folded = F.lower(text)
    return F.xxhash64(folded).alias("_k1"), F.xxhash64(F.lit("#"), folded).alias("_k2")


def stand_ins(rows: DataFrame, group: str, text: Column, share: float = STANDIN_SHARE, least: int = STANDIN_GROUPS) -> DataFrame:
    """(_k1, _k2): keys of texts that recur for unrelated groups; at most 1 / share rows, so they may be broadcast.

    Letter case and surrounding white space are no difference. Empty and null texts are not counted.
    """
    words = stripped(text)
    pairs = rows.filter(F.length(words) > 0).select(*_text_key(words), F.xxhash64(F.col(group)).alias("_g")).distinct()
    counts = pairs.groupBy("_k1", "_k2").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.filter(F.col("_n") >= least).crossJoin(F.broadcast(total)).filter(F.col("_n") >= F.col("_total") * share).select("_k1", "_k2")


def survivors(
    rows: DataFrame,
    group: str = "hash",
    order: str = "seq",
    seen: str = "scraped_at",
    text: str = "snippet",
    count: str = "citations",
    refs: tuple[str, ...] = ("task_id", "conference_id"),
    source: str = "sourced_from",
    trusted: str = "crawl",
) -> DataFrame:
    """One row for each group with at least two rows; every column names the row (by ``order``) whose value survives.

    Columns: group, n_rows, text_row, count_row and one <ref>_row for each of refs; 0 if no row has a value.

    - text: the longest in characters without surrounding white space; empty texts and stand-ins have no value.
    - count: last by ``seen``; null and negative counts have no value.
    - refs, each by itself: null and 0 have no value; those from the trusted source before all others, then last seen.
    - A null ``seen`` is older than any other; ties go to the smallest ``order``. A null source is not trusted.
    - Rows with a null group belong to no group and give no row. Repeated rows count as rows. An empty table gives none.
    - Other columns are not read.
    """
    first = -F.col(order).cast("bigint")
    found = stand_ins(rows, group, F.col(text))
    words = stripped(F.col(text))
    narrow = rows.filter(F.col(group).isNotNull()).select(
        group, order, seen, source, count, *refs, *_text_key(words), F.coalesce(F.length(words), F.lit(0)).alias("_len")
    )
    judged = narrow.join(F.broadcast(found.withColumn("_standin", F.lit(True))), ["_k1", "_k2"], "left")
    real = (F.col("_len") > 0) & F.col("_standin").isNull()
    aggs = [
        F.count("*").alias("n_rows"),
        F.max(F.when(real, F.struct(F.col("_len"), first.alias("s")))).alias("_text"),
        F.max(F.when(F.col(count) >= 0, F.struct(F.col(seen), first.alias("s")))).alias("_count"),
    ]
    trust = F.coalesce(F.col(source) == trusted, F.lit(False)).alias("t")
    for r in refs:
        aggs.append(F.max(F.when(F.col(r) != 0, F.struct(trust, F.col(seen), first.alias("s")))).alias(f"_{r}"))
    kept = judged.groupBy(group).agg(*aggs).filter("n_rows >= 2")
    pick = lambda c: F.coalesce(-F.col(f"{c}.s"), F.lit(0).cast("bigint"))
    return kept.select(group, "n_rows", pick("_text").alias("text_row"), pick("_count").alias("count_row"), *(pick(f"_{r}").alias(f"{r}_row") for r in refs))


def claimed(rows: DataFrame, group: str, source: str, fields: tuple[str, ...], texts: tuple[str, ...] = (), counts: tuple[str, ...] = ()) -> DataFrame:
    """(grp, src, field, value): every value that a row names, and a row with field '' for each source that saw a group.

    fields: references, of which 0 is no value; texts: without surrounding white space, empty ones and stand-ins are no
    value; counts: negative ones are no value. value is a BIGINT, or with texts a STRING.
    """
    kind = "string" if texts else "bigint"
    rows, every = rows.filter(F.col(group).isNotNull()), rows
    value = {f: F.nullif(F.col(f).cast("bigint"), F.lit(0)) for f in fields} | {c: F.when(F.col(c) >= 0, F.col(c).cast("bigint")) for c in counts}
    for t in texts:
        found = F.broadcast(stand_ins(every, group, F.col(t)).withColumn(f"_standin_{t}", F.lit(True)))
        rows = rows.withColumns({name: c for name, c in zip(("_k1", "_k2"), _text_key(stripped(F.col(t))))}).join(found, ["_k1", "_k2"], "left").drop("_k1", "_k2")
        value[t] = F.when((F.length(stripped(F.col(t))) > 0) & F.col(f"_standin_{t}").isNull(), stripped(F.col(t)))
    each = [F.struct(F.lit(f).alias("field"), v.cast(kind).alias("value")) for f, v in value.items()]
    seen = F.struct(F.lit("").alias("field"), F.lit(None).cast(kind).alias("value"))
    out = rows.select(F.col(group).alias("grp"), F.coalesce(F.col(source), F.lit("(none)")).alias("src"), F.explode(F.array(seen, *each)).alias("c")).select("grp", "src", "c.field", "c.value")
    return out.filter("value is not null or field = ''")


def _once_a_task(claims: DataFrame, most: int = 200_000) -> DataFrame:
    """claims without those that the task has had just before: it remembers so many, so a hot group is combined before the shuffle."""
    names = claims.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        had: set = set()
        for batch in batches:
            kept = []
            for i, (*row, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(names))))):
                key = *row, xxhash.xxh3_128_digest(value) if isinstance(value, str) and len(value) > 32 else value
                if key not in had:
                    had.add(key)
                    kept.append(i)
            if len(had) > most:
                had.clear()
            yield batch.take(pa.array(kept, pa.int64()))

    return claims.mapInArrow(run, claims.schema)


def facts(claims: DataFrame) -> DataFrame:
    """(grp, field, value, asserted ARRAY, silent ARRAY): who asserts each value, and who saw the group without it.

    claims: of ``claimed``. They are shuffled once, by group. Arrays hold sources; the model is meant for a bounded
    number of them, such as systems or feeds, not one for each web page.
    """
    placed = _once_a_task(claims).repartition("grp")
    asserted = placed.filter("field <> ''").groupBy("grp", "field", "value").agg(F.sort_array(F.collect_set("src")).alias("asserted"))
    saw = placed.filter("field = ''").groupBy("grp").agg(F.collect_set("src").alias("saw"))
    return asserted.join(saw, "grp").select("grp", "field", "value", "asserted", F.sort_array(F.array_except("saw", "asserted")).alias("silent"))


def source_quality(known: DataFrame, rounds: int = 8, prior_true: float = 0.5) -> tuple[DataFrame, list[tuple]]:
    """Expectation-maximisation over patterns of assertion.

    Returns the patterns (field, asserted, silent, probability) and [(field, source, sensitivity, specificity)].
    known: the rows of ``facts``. Only a few numbers a source reach the driver; patterns stay distributed. Beta priors
    (sensitivity 0.7, specificity 0.9, worth 20 facts) keep sources with few facts defined.
    """
    patterns = cut_lineage(known.groupBy("field", "asserted", "silent").agg(F.count("*").alias("weight")))
    joined = lambda c: F.array_join(c, "\x1f")  # noqa: E731  # a hash of arrays would not tell where one ends
    patterns = patterns.withColumn("pid", F.xxhash64("field", joined("asserted"), F.lit("|"), joined("silent")))
    both = F.concat(F.transform("asserted", lambda s: F.struct(s.alias("src"), F.lit(True).alias("said"))), F.transform("silent", lambda s: F.struct(s.alias("src"), F.lit(False).alias("said"))))
    votes = cut_lineage(patterns.select("pid", "field", "weight", F.posexplode(both).alias("at", "v")).select("pid", "field", "weight", "at", "v.src", "v.said"))
    quality = {(r.field, r.src): (0.7, 0.9) for r in votes.select("field", "src").distinct().collect()}
    prior = {f: prior_true for f, _ in quality}
    spark = known.sparkSession

    def judged() -> DataFrame:
        """(pid, probability) of each pattern."""
        rows = [(f, s, math.log(a / (1 - b)), math.log((1 - a) / b), math.log(prior[f] / (1 - prior[f]))) for (f, s), (a, b) in quality.items()]
        odds = F.broadcast(spark.createDataFrame(rows, "field string, src string, yes double, no double, base double"))  # sources, which the model needs to be few
        score = F.sum(F.when(F.col("said"), F.col("yes")).otherwise(F.col("no"))) + F.first("base")
        return votes.join(odds, ["field", "src"]).groupBy("pid").agg((1 / (1 + F.exp(-score))).alias("probability"))

    if not quality:
        return patterns.select("field", "asserted", "silent", F.lit(None).cast("double").alias("probability")), []
    for _ in range(rounds):
        p, w, said = F.col("probability"), F.col("weight"), F.col("said").cast("double")
        once = lambda c: F.sum(F.when(F.col("at") == 0, c).otherwise(0.0))  # noqa: E731  # of each pattern, whoever comes first
        sums = votes.join(judged(), "pid").groupBy("field", "src").agg(F.sum(w * p * said).alias("tp"), F.sum(w * p).alias("t"), F.sum(w * (1 - p) * (1 - said)).alias("tn"), F.sum(w * (1 - p)).alias("f"), once(w * p).alias("true"), once(w).alias("all")).collect()
        quality = {(r.field, r.src): ((r.tp + 14) / (r.t + 20), (r.tn + 18) / (r.f + 20)) for r in sums}
        prior = {f: (sum(r.true for r in sums if r.field == f) + 10) / (sum(r.all for r in sums if r.field == f) + 20) for f in prior}
    probable = patterns.join(judged(), "pid")
    return probable.select("field", "asserted", "silent", "probability"), sorted((*k, *v) for k, v in quality.items())


def true_values(rows: DataFrame, group: str = "hash", source: str = "sourced_from", fields: tuple[str, ...] = ("task_id", "conference_id"), rounds: int = 8, texts: tuple[str, ...] = (), counts: tuple[str, ...] = ()) -> DataFrame:
    """Every value of every group with its probability: (grp, field, value, probability, judged_true).

    - null is no value, nor are 0 in fields, stand-ins in texts and negative counts (see ``claimed``); a null source is a source of its own; rows with a null group are left out.
    - Repeated rows assert once. A group whose values are all judged false keeps its most probable ones (ties: all).
    - An empty table gives no rows.
    """
    known = write_cut(facts(claimed(rows, group, source, fields, texts, counts)))
    probable = cut_lineage(source_quality(known, rounds)[0])
    few = probable.limit(MOST_PATTERNS + 1).count() <= MOST_PATTERNS
    scored = known.join(F.broadcast(probable) if few else probable, ["field", "asserted", "silent"])
    true, false = scored.filter("probability >= 0.5").withColumn("judged_true", F.lit(True)), scored.filter("probability < 0.5")
    doubtful = false.select("grp", "field").distinct()
    best = scored.join(doubtful, ["grp", "field"], "left_semi").groupBy("grp", "field").agg(F.max("probability").alias("best"))
    rest = false.join(best, ["grp", "field"]).withColumn("judged_true", F.col("probability") == F.col("best"))
    out = ["grp", "field", "value", F.round("probability", 6).alias("probability"), "judged_true"]
    return true.select(*out).unionByName(rest.select(*out))
