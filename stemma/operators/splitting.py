"""Adaptive planning against known counts: year windows in Spark, keyword splits of a few over-full leaves on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

Chain = tuple[str, ...]


@dataclass
class CountOracle:
    """Answers (query, from, to) from a table of counts. A known count is free; asking for an unknown one costs one of the
    budget's probes, since a search would be made for it, and gives None."""

    counts: dict[tuple[str, int, int], int]
    budget: int | None = None
    trace: list[tuple[str, int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, counts: DataFrame, budget: int | None = None, most: int = 1_000_000) -> "CountOracle":
        """From (query, year_from, year_to, count): a cache of the few probes made for a plan; more than ``most`` are refused."""
        rows = counts.select("query", "year_from", "year_to", "count").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("too many counts for the driver; select those of the plan first")
        return cls({(r[0], r[1], r[2]): r[3] for r in rows}, budget)

    @property
    def exhausted(self) -> bool:
        return self.budget is not None and self.budget <= 0

    def __call__(self, query: str, year_from: int, year_to: int) -> int | None:
        known = self.counts.get((query, year_from, year_to))
        if known is None:
            if self.exhausted:
                return None
            if self.budget is not None:
                self.budget -= 1
        self.trace.append((query, year_from, year_to))
        return known


@dataclass(frozen=True)
class Leaf:
    query: str
    year_from: int
    year_to: int
    keywords: Chain
    count: int | None
    needs_split: bool


def query_text(base: str, includes: Chain, excludes: Chain) -> str:
    return base + "".join(f' AND "{w}"' for w in includes) + "".join(f' -"{w}"' for w in excludes)


def split_balance(with_: int, without: int) -> float:
    total = with_ + without
    return min(1.0, min(with_, without) / (total / 2)) if total else 0.0


def split_leaf(
    base: str,
    years: tuple[int, int],
    size: int,
    keywords: list[str],
    count: Callable[[str, int, int], int | None],
    limit: int,
    min_balance: float = 0.15,
    probes: int = 8,
    side_share: float = 0.75,
    deepest: int = 32,
    veto: Callable[[Chain, Chain, str], bool] | None = None,
    ranked: Callable[[Chain, Chain, list[str]], list[str]] | None = None,
) -> tuple[bool, list[Leaf]]:
    """Splits a leaf that exceeds ``limit`` into leaves with and without keywords; (success, leaves).

    An empty query or a balance outside [0, 1] is an error.

    At each node up to ``probes`` counted keywords are tried, the first that leaves no side above side_share at once,
    else the best balanced; a vetoed keyword costs nothing, an unreadable count one probe. Both sides are always
    followed, the side with the keyword first; success needs both.
    """

    if not base or not 0 <= min_balance <= 1:
        raise ValueError("a leaf has a query, and min_balance lies in [0, 1]")

    def grow(inc: Chain, exc: Chain, size: int, free: list[str], depth: int) -> tuple[bool, list[Leaf]]:
        if size <= 0:
            return True, []
        text = query_text(base, inc, exc)
        if size <= limit:
            return True, [Leaf(text, *years, inc + exc, size, False)]
        if depth > deepest or probes <= 0:
            return False, []
        ceiling = int(size * side_share)
        picked: tuple[float, str, int] | None = None
        used = 0
        for word in ranked(inc, exc, free) if ranked else free:
            if used >= probes:
                break
            if veto and not veto(inc, exc, word):
                continue
            used += 1
            held = count(query_text(base, (*inc, word), exc), *years)
            if held is None or held <= 0 or held >= size:
                continue
            even = split_balance(held, size - held)
            if even < min_balance:
                continue
            if max(held, size - held) <= ceiling:
                picked = (even, word, held)
                break
            if picked is None or even > picked[0]:
                picked = (even, word, held)
        if picked is None:
            return False, []
        _, word, held = picked
        rest = [w for w in free if w != word]
        left, right = grow((*inc, word), exc, held, rest, depth + 1), grow(inc, (*exc, word), size - held, rest, depth + 1)
        return left[0] and right[0], left[1] + right[1]

    return grow((), (), size, list(keywords), 0)


def year_windows(names: DataFrame, year_from: int, year_to: int, counts: DataFrame, limit: int, window: int = 2) -> DataFrame:
    """(query, year_from, year_to, count, needs_split): the disjoint windows of each name (query).

    A window over the limit falls into single years; a single year over it, or a count that is not known, needs a split.
    counts: (query, year_from, year_to, count). An empty range has no windows.
    """
    if limit < 1 or window < 1:
        raise ValueError("limit and window are 1 at least")
    if year_to < year_from:
        return names.select("query", F.lit(0).alias("year_from"), F.lit(0).alias("year_to"), F.lit(0).cast("bigint").alias("count"), F.lit(False).alias("needs_split")).limit(0)
    starts = F.explode(F.sequence(F.lit(year_from), F.lit(year_to), F.lit(window))).alias("year_from")
    wide = names.select("query", starts).withColumn("year_to", F.least(F.col("year_from") + window - 1, F.lit(year_to)))
    known = counts.groupBy("query", "year_from", "year_to").agg(F.max("count").alias("count"))
    counted = wide.join(known, ["query", "year_from", "year_to"], "left")
    over = (F.col("count") > limit) & (F.col("year_to") > F.col("year_from"))
    whole = counted.filter(~F.coalesce(over, F.lit(False)))
    single = counted.filter(over).select("query", F.explode(F.sequence("year_from", "year_to")).alias("year_from")).withColumn("year_to", F.col("year_from")).join(known, ["query", "year_from", "year_to"], "left")
    return whole.unionByName(single).withColumn("needs_split", F.coalesce(F.col("count") > limit, F.lit(True)))


def within_limit(leaves: list[Leaf]) -> bool:
    return not any(x.needs_split for x in leaves)


def root_keyword(buckets: list[tuple[Chain, Chain]]) -> str | None:
    """The one keyword that every bucket requires or forbids, if there is just one."""
    shared: set[str] | None = None
    for inc, exc in buckets:
        shared = set(inc) | set(exc) if shared is None else shared & (set(inc) | set(exc))
    return next(iter(shared)) if shared and len(shared) == 1 else None
