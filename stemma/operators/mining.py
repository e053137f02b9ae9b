"""Keyword mining: document frequencies, Balance and IDF ranking, substring clean-up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stemma.functions import text as T


@dataclass(frozen=True)
class MiningOptions:
    min_balance: float = 0.15
    min_freq: int = 3
    max_share: float = 0.95
    longest: int = 1
    most: int = 200
    phrase_boost: float = 1.0
    stop_words: frozenset[str] = T.STOP_WORDS


By = tuple[str, ...]


def document_terms(docs: DataFrame, longest: int = 1, stop_words: frozenset[str] = T.STOP_WORDS, by: By = ()) -> DataFrame:
    """(hash, keyword): the distinct words and phrases of each document; title and snippet are apart. Rows without a hash are left out.

    by: columns that tell groups of documents apart, such as venues, here and below; a result has them in front.
    """
    known = docs.filter(F.coalesce("hash", F.lit("")) != "")
    split = known.select(*by, "hash", *(T.words(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("title", "snippet")))
    flagged = split.select(*by, "hash", "title", "snippet", *(T.content_flags(F.col(c), stop_words).alias(f"_{c}") for c in ("title", "snippet")))
    parts = []
    for c in ("title", "snippet"):
        tokens, flags = F.col(c), F.col(f"_{c}")
        parts.append(_content(tokens, flags))
        if longest > 1:
            parts.append(T.ngrams(tokens, flags, longest))
    return flagged.select(*by, "hash", F.explode(F.array_distinct(F.concat(*parts))).alias("keyword"))


def _content(tokens: Column, flags: Column) -> Column:
    return F.filter(tokens, lambda w, i: F.get(flags, i))


def document_frequency(docs: DataFrame, longest: int = 1, stop_words: frozenset[str] = T.STOP_WORDS, by: By = ()) -> DataFrame:
    """(keyword, df). Counting is combined before the shuffle, so a word of every document costs one row a task."""
    return document_terms(docs, longest, stop_words, by).groupBy(*by, "keyword").agg(F.count("*").alias("df"))


def candidates(docs: DataFrame, o: MiningOptions, by: By = ()) -> DataFrame:
    """(keyword, with_docs, without_docs, total, balance) of the words and phrases that divide the documents well enough."""
    total = F.broadcast(docs.filter(F.coalesce("hash", F.lit("")) != "").groupBy(*by).agg(F.count("*").alias("total")))  # a row, or one a group
    df = document_frequency(docs, max(1, o.longest), o.stop_words, by)
    counted = df.join(total, list(by)) if by else df.crossJoin(total)
    w, n = F.col("df"), F.col("total")
    scored = counted.select(*by, "keyword", w.alias("with_docs"), (n - w).alias("without_docs"), "total", T.balance(w, n - w).alias("balance"))
    return scored.filter((F.col("balance") >= o.min_balance) & (F.col("with_docs") >= max(1, o.min_freq)) & (F.col("with_docs") <= F.col("total") * o.max_share))


def rank(scored: DataFrame, order: list[Column], by: By = ()) -> DataFrame:
    """Adds rank from 1. The filters before bound the rows: Balance leaves words in at least so many documents of a share."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)))


def drop_contained(ranked: DataFrame, kept_first: bool = False, by: By = ()) -> DataFrame:
    """Drops keywords that contain, or lie within, another of as many words.

    By default a keyword goes if one of a later rank contains it; with kept_first if one of an earlier rank does, or
    lies within it. Pairs are found by joining the parts of each keyword to keywords, never by a cross join of all.
    """
    parts = F.size(F.split("keyword", " "))
    a = ranked.select(*by, "keyword", "rank", parts.alias("n"), F.length("keyword").alias("len"))
    # every keyword listed under each of its substrings that starts at any character and has another keyword's length
    inner = a.select(*by, F.col("keyword").alias("short"), F.col("rank").alias("short_rank"), "n")
    lens = a.select("n", "len").distinct().groupBy("n").agg(F.collect_set("len").alias("lens"))
    outer = a.join(F.broadcast(lens), "n").select(*by, F.col("keyword").alias("long"), F.col("rank").alias("long_rank"), "n", F.explode(F.filter("lens", lambda x: x < F.col("len"))).alias("piece"), F.col("len").alias("long_len"))
    pieces = outer.select(*by, "long", "long_rank", "n", "piece", F.explode(F.sequence(F.lit(1), F.col("long_len") - F.col("piece") + 1)).alias("at"))
    pieces = pieces.select(*by, "long", "long_rank", "n", F.col("long").substr(F.col("at"), F.col("piece")).alias("short"))
    pairs = pieces.join(inner, [*by, "n", "short"])
    if kept_first:
        gone = pairs.select(*by, F.when(F.col("long_rank") > F.col("short_rank"), F.col("long")).otherwise(F.col("short")).alias("keyword"))
    else:
        gone = pairs.filter(F.col("long_rank") > F.col("short_rank")).select(*by, F.col("short").alias("keyword"))
    return ranked.join(gone.distinct(), [*by, "keyword"], "left_anti")


def _top(ranked: DataFrame, o: MiningOptions, by: By = ()) -> DataFrame:
    again = rank(drop_contained(ranked, by=by), [F.col("rank")], by)
    return again if o.most < 0 else again.filter(F.col("rank") <= o.most)  # 0: none; below 0: all


def mine(docs: DataFrame, o: MiningOptions = MiningOptions(), by: By = ()) -> DataFrame:
    """(rank, keyword, with_docs, without_docs, total, balance), best first, the first ``most`` of them.

    Ties go to the larger collection, the larger count, then the smaller keyword by bytes. An empty table gives no rows.
    """
    score = T.boosted(F.col("keyword"), F.col("balance"), o.phrase_boost)
    return _top(rank(candidates(docs, o, by), [score.desc(), F.col("total").desc(), F.col("with_docs").desc(), F.col("keyword")], by), o, by)


def mine_idf(docs: DataFrame, background: DataFrame, o: MiningOptions = MiningOptions(), by: By = ()) -> DataFrame:
    """As ``mine``, ranked by Balance times IDF over a background; adds idf.

    A phrase counts in the background where its words stand in a row. Without any background row IDF is 1.
    """
    scored = candidates(docs, o, by)
    totals = background.agg(F.count("*").alias("bg_total"))
    bg = background.select("title", "snippet", F.monotonically_increasing_id().alias("_i"))
    spread = bg.select(F.col("_i").cast("string").alias("hash"), F.concat_ws(" ", "title", "snippet").alias("title"), F.lit("").alias("snippet"))
    df = document_frequency(spread, max(1, o.longest), o.stop_words).withColumnRenamed("df", "bg_df")
    both = scored.join(df, "keyword", "left").crossJoin(F.broadcast(totals)).withColumn("bg_df", F.coalesce("bg_df", F.lit(0)))
    both = both.withColumn("idf", T.idf(F.col("bg_df"), F.col("bg_total"))).drop("bg_df", "bg_total")
    score = T.boosted(F.col("keyword"), F.col("balance") * F.col("idf"), o.phrase_boost)
    return _top(rank(both, [F.round(score, 12).desc(), F.col("with_docs").desc(), F.col("keyword")], by), o, by)


def viable(docs: DataFrame, keywords: DataFrame, max_share: float, by: By = ()) -> DataFrame:
    """Keywords (keyword, df) that occur as substrings in some text (hash, text), and in at most max_share of them; without texts all."""
    held = holding(docs.select(F.struct(*by, "hash").alias("hash"), "text"), keywords).select(*(F.col(f"hash.{c}") for c in by), F.explode("held").alias("keyword"))
    counted = held.groupBy(*by, "keyword").agg(F.count("*").alias("df"))
    total = F.broadcast(docs.groupBy(*by).agg(F.count("*").alias("total")))  # a row, or one a group
    every = keywords.select(*by, "keyword").distinct().join(counted, [*by, "keyword"], "left")
    every = every.join(total, list(by), "left") if by else every.crossJoin(total)
    kept = every.filter((F.coalesce("total", F.lit(0)) == 0) | (F.col("df") <= F.col("total") * max_share))
    return kept.select(*by, "keyword", F.coalesce("df", F.lit(0).cast("bigint")).alias("df"))


#: Keywords that are tested one by one in the JVM; more are looked for together by one automaton.
MOST_KEYWORDS = 200


def keyword_array(keywords: DataFrame) -> DataFrame:
    """One row with the sorted keywords. Keyword lists are configuration or what mining leaves of a pool, never data."""
    return keywords.select("keyword").distinct().agg(F.sort_array(F.collect_set("keyword")).alias("kws"))


def holding(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(hash, held ARRAY<STRING>): the keywords that each text (hash, text) contains, letter case aside, sorted."""
    texts = docs.select("hash", F.lower(F.coalesce("text", F.lit(""))).alias("_t"))
    if keywords.select("keyword").distinct().limit(MOST_KEYWORDS + 1).count() <= MOST_KEYWORDS:
        return texts.crossJoin(F.broadcast(keyword_array(keywords))).select("hash", F.filter("kws", lambda k: F.contains(F.col("_t"), F.lower(k))).alias("held"))
    listed: dict[str, list[str]] = {}
    for r in keywords.select("keyword", F.lower("keyword").alias("low")).distinct().collect():
        listed.setdefault(r.low, []).append(r.keyword)
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        everywhere = shared.value.get("", [])
        for low, names in shared.value.items():
            if low:
                automaton.add_word(low, names)
        automaton.make_automaton()
        for batch in batches:
            held = [sorted({*everywhere, *(w for _, names in automaton.iter(t) for w in names)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.string()))], ["hash", "held"])

    return texts.mapInArrow(find, f"hash {docs.schema['hash'].dataType.simpleString()}, held array<string>")


def membership(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(hash, keyword): which texts (hash, text) contain which keywords, letter case aside; tested within each row."""
    return holding(docs, keywords).select("hash", F.explode("held").alias("keyword"))


def branch_counts(docs: DataFrame, includes: list[str], excludes: list[str], keywords: DataFrame) -> DataFrame:
    """(keyword, subset, with_docs): of the texts that hold all includes and no exclude, how many hold each keyword."""
    t = F.lower(F.coalesce("text", F.lit("")))
    kept = docs
    for w in includes:
        kept = kept.filter(F.contains(t, F.lit(w.lower())))
    for w in excludes:
        kept = kept.filter(~F.contains(t, F.lit(w.lower())))
    subset = kept.agg(F.count("*").alias("subset"))
    counted = membership(kept, keywords).groupBy("keyword").agg(F.count("*").alias("with_docs"))
    return keywords.select("keyword").distinct().join(counted, "keyword", "left").crossJoin(F.broadcast(subset)).select("keyword", "subset", F.coalesce("with_docs", F.lit(0)).alias("with_docs"))


def branch_rank(counts: DataFrame, order: DataFrame, boost: float = 1.0) -> DataFrame:
    """Adds score and rank: Balance within the branch, phrases weighing ``boost`` times; ties in the given order (keyword, rank).

    Without texts in the branch every score is -1. The ranks are those of one list of keywords, which one task sorts.
    """
    even = T.balance(F.col("with_docs"), F.col("subset") - F.col("with_docs"))
    score = F.when(F.col("subset") == 0, F.lit(-1.0)).otherwise(T.boosted(F.col("keyword"), even, boost))
    given = order.groupBy("keyword").agg(F.min("rank").alias("_given"))
    return rank(counts.join(given, "keyword").withColumn("score", score), [F.col("score").desc(), F.col("_given"), F.col("keyword")]).drop("_given")


def drop_degenerate(keywords: DataFrame, base: Column) -> DataFrame:
    """Keywords that the name itself contains divide nothing."""
    return keywords.filter(~F.contains(F.lower(base), F.lower("keyword")))
