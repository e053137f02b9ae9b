"""Planning of venues: keyword pool, stored partitions, partitioned years and leaves as tasks.

Windows, known counts, pools and atoms are DataFrames over all venues or papers. What comes to the driver is one over-full
year at a time: the atoms of its papers, over which the tree is grown, keywords are vetoed and ranked, and counts asked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from stemma.functions import text as T
from stemma.operators import dml, mining, partition, stats
from stemma.operators.splitting import Chain, CountOracle, Leaf, query_text, root_keyword, split_balance, split_leaf
from stemma.session import cut_lineage

#: Atoms of the papers of one venue and year that the driver takes.
MOST_YEAR_ATOMS = 200_000


@dataclass(frozen=True)
class Limits:
    """What a plan keeps to; the names are those of the configuration."""

    max_results: int = 1000
    headroom: float = 0.8
    min_balance: float = 0.15
    max_probes: int = 8
    min_papers_to_trust: int = 10
    min_coverage: float = 0.5
    max_side_fraction: float = 0.75
    mine_phrase_boost: float = 1.5
    mine_max_ngram: int = 3
    max_mined_keywords: int = 200
    root_rejections: int = 3

    @property
    def mining(self) -> mining.MiningOptions:
        return mining.MiningOptions(min_balance=self.min_balance, longest=self.mine_max_ngram, most=self.max_mined_keywords, phrase_boost=self.mine_phrase_boost)


def documents(papers: DataFrame) -> DataFrame:
    """(hash, title, snippet, year) once a hash; of several sightings (seq) the first, with all its fields."""
    if "seq" in papers.columns:
        return dml.heal_papers(papers).select("hash", "title", "snippet", "year")
    return papers.groupBy("hash").agg(F.min(F.struct("title", "snippet", "year")).alias("p")).select("hash", "p.*")


def venue_documents(papers: DataFrame, conference_id: int, year_from: int = 0, year_to: int = 0) -> DataFrame:
    """(hash, title, snippet, year) of a venue, once a hash."""
    return documents(stats.papers_of(papers, conference_id, year_from, year_to))


def texts(docs: DataFrame) -> DataFrame:
    """(hash, text) of documents; a null title or snippet is empty."""
    return docs.select("hash", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))).alias("text"))


def corpus_ranking(papers: DataFrame, stored: DataFrame, options: mining.MiningOptions) -> tuple[DataFrame, DataFrame | None]:
    """(ranking (keyword, rank) of all papers, rows to store). A stored ranking of as many papers and the same phrase
    length is taken; else all papers are mined anew."""
    every = documents(papers)
    key = rank_key(every.count(), options.longest)
    have = dml.stored_ranking(stored, key)
    if not have.isEmpty():
        return mining.rank(have, [F.col("score").desc(), F.col("keyword")]).select("keyword", "rank"), None
    mined = mining.mine_idf(every, every, options).select("keyword", "rank")
    return mined, dml.rank_scores(mined, F.lit(key))


def mined_keywords(own: DataFrame, every: DataFrame, least: int = 10, options: mining.MiningOptions = Limits().mining, ranking: DataFrame | None = None) -> DataFrame:
    """The ranked keywords of a venue's documents against all; those of all (``ranking``, or mined here) if it has fewer than ``least``."""
    if own.limit(least).count() >= least:
        return mining.mine_idf(own, every, options)
    return ranking if ranking is not None else mining.mine_idf(every, every, options)


def rank_key(papers: int, longest: int) -> int:
    """Under which a mined ranking is stored: it is of use only for the same number of papers and phrase length."""
    return papers * 1000 + longest


def keyword_pool(mined: DataFrame, configured: DataFrame, docs: DataFrame, base: Column, side: float = 0.75, by: mining.By = ()) -> DataFrame:
    """(keyword, rank): mined before configured keywords, first occurrence kept, cleaned of substrings, of parts of the name (base) and of those that divide nothing.

    by: columns of mined, configured and docs (hash, text) that tell pools of several venues apart.
    """
    mine = mined.select(*by, "keyword", F.col("rank").cast("long").alias("rank"), base.alias("_base"))
    both = mine.unionByName(configured.select(*by, "keyword", (F.col("rank") + 1_000_000).cast("long").alias("rank"), base.alias("_base")))
    first = cut_lineage(both.groupBy(*by, "keyword").agg(F.min("rank").alias("rank"), F.min("_base").alias("_base")))
    clean = mining.drop_contained(first, kept_first=True, by=by)
    kept = mining.drop_degenerate(clean, F.col("_base")).drop("_base")
    return kept.join(mining.viable(docs, kept, side, by).select(*by, "keyword"), [*by, "keyword"], "left_semi")


def reusable_years(tasks: DataFrame, counts: DataFrame, share: float = 0.95) -> DataFrame:
    """(conference_id, year, leaves, estimate): years whose stored leaves add up to the known count, so need no new plan.

    counts: (conference_id, year, count). At least two leaves, each with a positive estimate; an unknown count passes.
    """
    stored = stats.coverage_of_years(tasks).withColumnRenamed("year_from", "year")
    known = stored.join(counts, ["conference_id", "year"], "left")
    return known.filter((F.col("leaves") >= 2) & F.col("known") & (F.col("count").isNull() | (F.col("estimate") >= share * F.col("count")))).select("conference_id", "year", "leaves", "estimate")


def reused_leaves(tasks: DataFrame, base: str, years: DataFrame, cap: int, share: float = 0.95) -> DataFrame:
    """(query, year_from, year_to, keywords, count, needs_split): the stored leaves of a name's over-full years (year,
    count) whose partition is still good. A bucket over the cap, or marked, stays marked; the bare year is no bucket."""
    bare = (F.coalesce(F.size("keywords"), F.lit(0)) <= 0) & (F.col("query") == base)
    single = tasks.filter((F.col("year_from") == F.col("year_to")) & T.has_base(F.col("query"), F.lit(base)) & ~bare).join(years.select(F.col("year").alias("year_from"), F.col("count").alias("_whole")), "year_from")
    estimate = F.coalesce("total_results_estimate", F.lit(0).cast("bigint"))
    whole = single.groupBy("year_from").agg(F.count("*").alias("n"), F.min(estimate).alias("least"), F.sum(estimate).alias("sum"), F.max("_whole").alias("whole"))
    good = whole.filter((F.col("n") >= 2) & (F.col("least") > 0) & (F.col("whole").isNull() | (F.col("whole") <= 0) | (F.col("sum") >= share * F.col("whole")))).select("year_from")
    marked = (F.col("status") == "needs_split") | (F.col("total_results_estimate") > cap)
    return single.join(good, "year_from", "left_semi").select("query", "year_from", "year_to", "keywords", F.col("total_results_estimate").alias("count"), F.coalesce(marked, F.lit(False)).alias("needs_split"))


class Corpus:
    """Atoms of some papers: what holds for their texts under any required and forbidden keywords."""

    def __init__(self, rows: list[tuple[list[str], int]]):
        self.rows = [(frozenset(s), n) for s, n in rows]

    @classmethod
    def of(cls, docs: DataFrame, keywords: DataFrame) -> "Corpus":
        rows = partition.atoms(docs, keywords).limit(MOST_YEAR_ATOMS + 1).collect()
        if len(rows) > MOST_YEAR_ATOMS:
            raise ValueError("too many kinds of papers in one year for the driver; partition() takes them in Spark")
        return cls([(r.signature, r["size"]) for r in rows])

    def __len__(self) -> int:
        return sum(n for _, n in self.rows)

    def subset(self, inc: Chain, exc: Chain) -> list[tuple[frozenset[str], int]]:
        return [(s, n) for s, n in self.rows if s.issuperset(inc) and s.isdisjoint(exc)]

    def allow(self, side: float, base_inc: Chain = (), base_exc: Chain = ()) -> Callable[[Chain, Chain, str], bool]:
        """A veto: a keyword must divide the papers of its branch and leave neither side nearly all; a branch without papers proves nothing."""

        def test(inc: Chain, exc: Chain, word: str) -> bool:
            kept = self.subset((*base_inc, *inc), (*base_exc, *exc))
            whole, held = sum(n for _, n in kept), sum(n for s, n in kept if word in s)
            return not whole or 0 < held <= side * whole

        return test

    def ranked(self, boost: float, base_inc: Chain = (), base_exc: Chain = ()) -> Callable[[Chain, Chain, list[str]], list[str]]:
        """An order of keywords by Balance within their branch, phrases weighing ``boost`` times; ties stay in order."""

        def order(inc: Chain, exc: Chain, words: list[str]) -> list[str]:
            kept = self.subset((*base_inc, *inc), (*base_exc, *exc))
            whole = sum(n for _, n in kept)
            score = lambda w: split_balance(h := sum(n for s, n in kept if w in s), whole - h) * (boost if " " in w and boost > 0 else 1.0) if whole else -1.0
            return sorted(words, key=lambda w: -score(w))

        return order

    def grow(self, ranks: dict[str, int], limit: int, o: Limits, fits: partition.Fits | None = None) -> list[partition.Node]:
        return partition.grow([sorted(s) for s, _ in self.rows], [n for _, n in self.rows], ranks, limit, o.min_balance, o.mine_phrase_boost, fits)


def verified_root(corpus: Corpus, ranks: dict[str, int], limit: int, o: Limits, base: str, year: int, true_count: int, oracle: CountOracle) -> dict[str, int]:
    """The keywords without those that come out as root but whose count is 0 or more than the permitted share of the year.

    At most ``root_rejections`` are measured; a root that can't be is kept, and so is what is left after the last one.
    """
    for _ in range(o.root_rejections):
        root = root_keyword([(n.includes, n.excludes) for n in corpus.grow(ranks, limit, o) if n.resolved])
        if true_count <= 0 or not ranks or oracle.exhausted or root is None:
            break
        held = oracle(query_text(base, (root,), ()), year, year)
        if held is None or 0 < held <= int(true_count * o.max_side_fraction):
            break
        ranks = {w: r for w, r in ranks.items() if w.lower() != root.lower()}
    return ranks


def escalate(docs: DataFrame, node: partition.Node, keywords: DataFrame, ranks: dict[str, int], limit: int, o: Limits) -> list[partition.Node]:
    """Leaves of an unresolved node once longer phrases of its own papers have been mined; the node itself if there are none."""
    t = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    own = docs
    for w in node.includes:
        own = own.filter(F.contains(t, F.lit(w.lower())))
    for w in node.excludes:
        own = own.filter(~F.contains(t, F.lit(w.lower())))
    mined = mining.mine(own, replace(o.mining, min_freq=2, longest=o.mine_max_ngram + 1)).select("keyword", "rank").orderBy("rank").collect()  # max_mined_keywords at most
    last = max(ranks.values(), default=0)
    more = {**{r.keyword: last + r["rank"] for r in mined}, **ranks}
    if len(more) == len(ranks):
        return [node]
    listed = docs.sparkSession.createDataFrame(list(more.items()), "keyword string, rank long")
    join = lambda n: replace(n, path=node.path + n.path, includes=(*node.includes, *n.includes), excludes=(*node.excludes, *n.excludes))
    return [join(n) for n in Corpus.of(texts(own), listed).grow(more, limit, o)]


def plan_year(docs: DataFrame, base: str, year: int, true_count: int, keywords: DataFrame, oracle: CountOracle, o: Limits = Limits()) -> tuple[bool, list[Leaf]]:
    """Leaves of an over-full year from the papers docs (hash, title, snippet) known of it; (False, []) if it can't be.

    The papers are trusted if there are enough of them and they cover enough of the count. Their tree is grown with a
    verified root, nodes that the oracle says fit are left whole, unresolved ones are tried again with phrases of their
    own, and every bucket is counted. One at or above the cap is split on, by keywords that its own papers allow, best
    first. Success needs every bucket counted below the cap and nothing unresolved.
    """
    ranks = {r.keyword: r["rank"] for r in keywords.groupBy("keyword").agg(F.min("rank").alias("rank")).collect()}  # a pool
    corpus = Corpus.of(texts(docs), keywords)
    known = len(corpus)
    if known < o.min_papers_to_trust or (true_count > known and known / true_count < o.min_coverage) or oracle.exhausted:
        return False, []
    target = int(o.max_results * o.headroom)
    limit = max(1, int(o.max_results * o.headroom * known / true_count)) if true_count > 0 else max(1, target)
    ranks = verified_root(corpus, ranks, limit, o, base, year, true_count, oracle)

    def fits(inc: Chain, exc: Chain) -> bool:
        n = oracle(query_text(base, inc, exc), year, year)
        return n is not None and n <= target

    nodes = corpus.grow(ranks, limit, o, fits)
    nodes = [n for node in nodes for n in ([node] if node.resolved else escalate(docs, node, keywords, ranks, limit, o))]
    words = sorted(ranks, key=lambda w: (ranks[w], w))
    leaves: list[Leaf] = []
    for node in nodes:
        text = query_text(base, node.includes, node.excludes)
        n = oracle(text, year, year)
        if not node.resolved or n is None or oracle.exhausted:
            return False, []
        if n < o.max_results:
            leaves.append(Leaf(text, year, year, node.includes + node.excludes, n, False))
            continue
        allow, ranked = corpus.allow(o.max_side_fraction, node.includes, node.excludes), corpus.ranked(o.mine_phrase_boost, node.includes, node.excludes)
        ok, more = split_leaf(text, (year, year), n, words, oracle, o.max_results - 1, o.min_balance, o.max_probes, o.max_side_fraction, veto=allow, ranked=ranked)
        if not ok or oracle.exhausted:
            return False, []
        leaves += [replace(x, keywords=node.includes + node.excludes + x.keywords) for x in more]
    return bool(leaves), leaves


def leaves_to_tasks(leaves: DataFrame, conference_id: int, cap: int = 1000) -> DataFrame:
    """Plan rows of the task table from leaves (query, year_from, year_to, keywords, count, needs_split)."""
    why = F.concat(F.lit("estimate "), F.coalesce(F.col("count"), F.lit(0)).cast("string"), F.lit(f" exceeds the {cap}-result cap"))
    return leaves.select(
        F.lit(None).cast("bigint").alias("id"), F.lit(conference_id).cast("bigint").alias("conference_id"), "query", "year_from", "year_to", "keywords", F.lit(1).alias("page"),
        F.when(F.col("needs_split"), "needs_split").otherwise("pending").alias("status"), F.col("count").cast("bigint").alias("total_results_estimate"), F.when(F.col("needs_split"), why).otherwise("").alias("error"),
    )


def counts_of_pages(parsed: DataFrame) -> DataFrame:
    """(query, year_from, year_to, count) that recorded pages of plan searches announce; refused pages tell nothing."""
    return parsed.filter(~F.col("page.blocked") & F.col("count").isNotNull()).groupBy("query", "year_from", "year_to").agg(F.max("count").alias("count"))


def document_limits(papers: DataFrame, counts: DataFrame, cap: int = 1000, headroom: float = 0.8) -> DataFrame:
    """(conference_id, year, known, true, coverage, doc_limit): the capacity of a bucket in known documents."""
    known = papers.groupBy("conference_id", "year").agg(F.countDistinct("hash").alias("known"))
    both = known.join(counts.withColumnRenamed("count", "true"), ["conference_id", "year"])
    k, t = F.col("known"), F.col("true")
    return both.select("conference_id", "year", "known", "true", T.coverage(k, t).alias("coverage"), T.document_limit(cap, headroom, k, t).alias("doc_limit"))
