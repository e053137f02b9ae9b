"""Capacity-constrained partitioning of document sets by keyword membership.

Documents with the same keywords can never be told apart, so a tree is grown over such atoms and their sizes; documents
are read once for their atom, and once at the end for the bucket of their atom. A node of few atoms is finished in one
task by ``grow``; nodes of more are split level by level in Spark, all groups at once, until they are small enough.
Neither a group nor a node ever has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stemma.functions import text as T
from stemma.operators.mining import holding, membership
from stemma.session import cut_lineage, write_cut

#: Atoms of a node that one task finishes.
MOST_ATOMS = 50_000
Fits = Callable[[tuple[str, ...], tuple[str, ...]], bool]


def atoms(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(signature ARRAY<STRING>, size): documents (hash, text) with the same keywords."""
    return holding(docs, keywords).groupBy(F.col("held").alias("signature")).agg(F.count("*").alias("size"))


def feasible(atoms_: DataFrame, limit: int) -> DataFrame:
    """(atoms, largest, feasible): can every atom be a bucket?"""
    return atoms_.agg(F.count("*").alias("atoms"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.coalesce(F.max("size") <= limit, F.lit(True)).alias("feasible"))


def best_split(docs: DataFrame, keywords: DataFrame, min_balance: float = 0.0, boost: float = 1.0) -> DataFrame:
    """The keyword that divides all documents best: (keyword, with_docs, without_docs, balance); no row if none does."""
    total = docs.agg(F.count("*").alias("n"))
    counted = membership(docs, keywords).groupBy("keyword").agg(F.count("*").alias("with_docs")).crossJoin(F.broadcast(total))
    counted = counted.withColumn("without_docs", F.col("n") - F.col("with_docs")).withColumn("balance", T.balance(F.col("with_docs"), F.col("without_docs")))
    kept = counted.filter((F.col("without_docs") > 0) & (F.col("balance") >= min_balance))
    return kept.orderBy(T.boosted(F.col("keyword"), F.col("balance"), boost).desc(), "keyword").limit(1).select("keyword", "with_docs", "without_docs", "balance")


@dataclass(frozen=True)
class Node:
    """A leaf of the tree: path spells the way down, 0 for with and 1 for without; atoms: places in the signatures given."""

    path: str
    size: int
    includes: tuple[str, ...]
    excludes: tuple[str, ...]
    resolved: bool
    atoms: tuple[int, ...]


def grow(signatures: list[list[str]], sizes: list[int], ranks: dict[str, int], limit: int, min_balance: float = 0.0, boost: float = 1.0, fits: Fits | None = None, deepest: int = 64, root: Node | None = None) -> list[Node]:
    """The leaves of a node's tree in order of emission. root: the node, if it isn't a whole group.

    At each node above the limit the keyword of the best Balance divides it, phrases weighing ``boost`` times, ties going
    to the smaller rank. fits(includes, excludes) may declare a node whole that exceeds the limit; a root is never asked for.
    """
    words = sorted(ranks, key=lambda w: (ranks[w], w))
    place = {w: i for i, w in enumerate(words)}
    factor = np.array([boost if boost > 0 and " " in w else 1.0 for w in words])
    weight = np.array(sizes, dtype=np.int64)
    held = [np.array([place[w] for w in s if w in place], dtype=np.int64) for s in signatures]
    starts = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int64)
    flat = np.concatenate(held) if held else np.zeros(0, np.int64)
    out: list[Node] = []
    waiting = [(root.path, root.includes, root.excludes, np.arange(len(sizes)))] if root else [("", (), (), np.arange(len(sizes)))]
    while waiting:
        path, inc, exc, own = waiting.pop()
        size = int(weight[own].sum())
        leaf = lambda ok: Node(path, size, inc, exc, ok, tuple(own.tolist()))  # noqa: E731, B023
        if size <= limit or (path and fits is not None and fits(inc, exc)):
            out.append(leaf(True))
            continue
        counts = starts[own + 1] - starts[own]
        pairs = flat[np.repeat(starts[own] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())] if len(own) else flat[:0]
        with_ = np.bincount(pairs, np.repeat(weight[own], counts), len(words)).astype(np.int64)
        even = np.minimum(1.0, np.minimum(with_, size - with_) / (size / 2.0))
        score = np.where((with_ > 0) & (with_ < size) & (even >= min_balance), even * factor, -1.0)
        if not len(words) or score.max() < 0 or len(path) >= deepest:
            out.append(leaf(False))
            continue
        pick = int(score.argmax())
        has = np.zeros(len(own), bool)
        has[np.repeat(np.arange(len(own)), counts)[pairs == pick]] = True
        waiting += [(path + "1", inc, (*exc, words[pick]), own[~has]), (path + "0", (*inc, words[pick]), exc, own[has])]
    return out


def signed(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """(grp, hash, signature) of documents (grp, hash, text), each once; a null text holds no keyword. Without a group or a hash a row is none."""
    once = docs.filter("grp is not null and hash is not null").groupBy("grp", "hash").agg(F.max("text").alias("text"))
    return holding(once.select(F.struct("grp", "hash").alias("hash"), "text"), keywords).select("hash.grp", "hash.hash", F.col("held").alias("signature"))


def partition(docs: DataFrame, keywords: DataFrame, limit: int, min_balance: float = 0.0, boost: float = 1.0, fits: Fits | None = None, deepest: int = 64) -> tuple[DataFrame, DataFrame]:
    """Divides each group of documents (grp, hash, text) into buckets of at most ``limit``.

    keywords: (keyword, rank); an earlier rank wins ties. fits(includes, excludes): see ``grow``; it is asked in tasks. A
    node that no keyword divides well enough is unresolved.

    Returns assignments (grp, hash, path) and nodes (grp, path, size, includes, excludes, resolved). Sorted paths are the
    order of emission. An empty table gives no nodes. Rows that share grp and hash are one document.
    """
    kind = docs.schema["grp"].dataType.simpleString()
    ranks = {r.keyword: r.rank for r in keywords.groupBy("keyword").agg(F.min("rank").alias("rank")).collect()}  # configuration, or what mining leaves of a pool
    whole = signed(docs, keywords)
    no_words = F.array().cast("array<string>")
    state = cut_lineage(whole.groupBy("grp", "signature").agg(F.count("*").alias("n")).select("grp", F.lit("").alias("path"), no_words.alias("includes"), no_words.alias("excludes"), "signature", "n"))
    done: list[DataFrame] = []
    while big := state.groupBy("grp", "path", "includes", "excludes").agg(F.count("*").alias("atoms"), F.sum("n").alias("size")).filter(F.col("atoms") > MOST_ATOMS).collect():  # at most atoms / MOST_ATOMS
        state = _split_big(state, big, done, ranks, limit, min_balance, boost, fits, deepest)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        start = Node(first.path, 0, tuple(first.includes), tuple(first.excludes), True, ())
        leaves = grow([list(s) for s in rows.signature], rows.n.tolist(), ranks, limit, min_balance, boost, fits, deepest, start)
        at = pd.DataFrame([(i, n.path, list(n.includes), list(n.excludes), n.resolved) for n in leaves for i in n.atoms], columns=["i", "path", "includes", "excludes", "resolved"])
        own = rows[["grp", "signature", "n"]].iloc[at.i].reset_index(drop=True)
        return pd.concat([own, at.drop(columns="i")], axis=1)

    ended = state.groupBy("grp", "path").applyInPandas(finish, f"grp {kind}, signature array<string>, n bigint, path string, includes array<string>, excludes array<string>, resolved boolean")
    for part in done:
        ended = ended.unionByName(part)
    placed = write_cut(ended)
    nodes = placed.groupBy("grp", "path", "includes", "excludes", "resolved").agg(F.sum("n").alias("size")).select("grp", "path", "size", "includes", "excludes", "resolved")
    same = F.col("a.grp").eqNullSafe(F.col("b.grp")) & (F.col("a.signature") == F.col("b.signature"))
    return whole.alias("a").join(placed.alias("b"), same).select("a.grp", "a.hash", "b.path"), nodes


def _split_big(state: DataFrame, big: list, done: list[DataFrame], ranks: dict[str, int], limit: int, min_balance: float, boost: float, fits: Fits | None, deepest: int) -> DataFrame:
    """The state after one level of the nodes in big; what ends there is added to done."""
    spark = state.sparkSession
    counted = state.join(spark.createDataFrame([(r.grp, r.path, r.size) for r in big], state.select("grp", "path", F.lit(0).cast("bigint").alias("size")).schema), ["grp", "path"])
    held = counted.select("grp", "path", "size", "n", F.explode("signature").alias("keyword")).groupBy("grp", "path", "size", "keyword").agg(F.sum("n").alias("w"))
    listed = F.broadcast(spark.createDataFrame([(w, r) for w, r in ranks.items()] or [], "keyword string, rank bigint"))
    even = held.join(listed, "keyword").withColumn("balance", T.balance(F.col("w"), F.col("size") - F.col("w"))).filter((F.col("w") < F.col("size")) & (F.col("balance") >= min_balance))
    best = even.groupBy("grp", "path").agg(F.max_by("keyword", F.struct(T.boosted(F.col("keyword"), F.col("balance"), boost), -F.col("rank"), "keyword")).alias("pick"))
    picks = {(r.grp, r.path): r.pick for r in best.collect()}  # a row a big node
    fate = []
    for r in big:
        whole = r.size <= limit or bool(r.path and fits is not None and fits(tuple(r.includes), tuple(r.excludes)))
        pick = None if whole or len(r.path) >= deepest else picks.get((r.grp, r.path))
        fate.append((r.grp, r.path, pick, whole if pick is None else None))
    kind = state.select("grp", "path", F.lit("").alias("pick"), F.lit(True).alias("resolved")).schema
    for f in kind.fields:
        f.nullable = True
    marked = cut_lineage(state.join(F.broadcast(spark.createDataFrame(fate, kind)), ["grp", "path"], "left"))
    done.append(marked.filter("resolved is not null").select("grp", "signature", "n", "path", "includes", "excludes", "resolved"))
    has = F.array_contains("signature", F.col("pick"))
    moved = marked.filter("resolved is null").withColumn("has", F.when(F.col("pick").isNotNull(), has))
    added = lambda c, side: F.when(F.col("has") == side, F.concat(c, F.array("pick"))).otherwise(F.col(c)).alias(c)
    step = F.when(F.col("has").isNull(), "").when(F.col("has"), "0").otherwise("1")
    return cut_lineage(moved.select("grp", F.concat("path", step).alias("path"), added("includes", True), added("excludes", False), "signature", "n"))


def document_buckets(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, seq, hash): the documents of each bucket under its number in ``bucket_table``, to be stored."""
    order = Window.partitionBy("grp", "resolved").orderBy("path")
    numbered = nodes.select("grp", "path", (F.row_number().over(order) * F.when(F.col("resolved"), 1).otherwise(-1)).alias("seq"))
    return placed.join(numbered, ["grp", "path"]).select("grp", "seq", "hash")


def bucket_table(nodes: DataFrame) -> DataFrame:
    """(grp, seq, resolved, size, includes, excludes): buckets numbered in order of emission, unresolved groups below zero."""
    order = Window.partitionBy("grp", "resolved").orderBy("path")
    seq = F.row_number().over(order)
    return nodes.select("grp", F.when(F.col("resolved"), seq).otherwise(-seq).alias("seq"), "resolved", "size", "includes", "excludes")
