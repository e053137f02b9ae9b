"""Differences between two copies of a table, field by field.

One shuffle for each side: both sides are reduced to one row a key (map-side combine first, so a key delivered
often costs one row a task), then joined by a null-safe full outer join on the same partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def plain(c: Column) -> Column:
    """Letter case and surrounding white space are no difference."""
    return F.regexp_replace(F.lower(c.cast("string")), r"(?U)^\s+|\s+$", "")


def _side(df: DataFrame, key: str, fields: Mapping[str, Column]) -> DataFrame:
    aggs = [F.lit(True).alias("_here")]
    picked = df.select(F.col(key).alias("_key"), *(c.alias(f"_{i}") for i, c in enumerate(fields.values())))
    for i in range(len(fields)):
        c = F.col(f"_{i}")
        aggs += [F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"), F.max(c.isNull()).alias(f"_null{i}")]
    kind = df.schema[key].dataType.simpleString()
    none = F.lit("" if kind in ("string", "binary") else "1970-01-01" if kind.startswith(("date", "timestamp")) else "0").cast(kind)
    return picked.groupBy(F.coalesce("_key", none).alias("_k"), F.col("_key").isNull().alias("_kn")).agg(*aggs)


def table_diff(left: DataFrame, right: DataFrame, key: str, fields: Mapping[str, tuple[Column, Column] | None]) -> DataFrame:
    """Rows (key, side STRING, diffs ARRAY<STRUCT<field, left_value, right_value>>), for differing keys only.

    left, right: two copies of a table with a key of one type, a number, text or date. fields: name -> the normalised column on each side, or None
    for ``plain`` of the column of that name on both.
    side is ``only_left`` or ``only_right`` for a key missing on the other side (diffs is then empty), else ``both``.

    - Repeated delivery of a key counts once. If its deliveries disagree, a field is equal only if smallest value,
      largest value and presence of a null agree on both sides; the smallest value is shown.
    - null equals null and differs from every value. A null key is a key like any other and comes out as null.
    - An empty side makes every key of the other one missing; two empty sides give no rows.
    - Columns that are not compared are never read; clashing names are no matter.
    """
    pairs = {n: p or (plain(F.col(n)), plain(F.col(n))) for n, p in fields.items()}
    a = _side(left, key, {n: p[0] for n, p in pairs.items()}).alias("a")
    b = _side(right, key, {n: p[1] for n, p in pairs.items()}).alias("b")
    joined = a.join(b, (F.col("a._k") == F.col("b._k")) & (F.col("a._kn") == F.col("b._kn")), "full_outer")
    parts = []
    for i, name in enumerate(pairs):
        same = F.lit(True)
        for part in ("_lo", "_hi", "_null"):
            same = same & F.col(f"a.{part}{i}").eqNullSafe(F.col(f"b.{part}{i}"))
        value = F.struct(F.lit(name).alias("field"), F.col(f"a._lo{i}").cast("string").alias("left_value"), F.col(f"b._lo{i}").cast("string").alias("right_value"))
        parts.append(F.when(~same, value))
    side = F.when(F.col("b._here").isNull(), "only_left").when(F.col("a._here").isNull(), "only_right").otherwise("both")
    diffs = F.filter(F.array(*parts), lambda d: d.isNotNull())
    missing = F.coalesce("a._kn", "b._kn")
    return joined.select(
        F.when(~missing, F.coalesce("a._k", "b._k")).alias("key"),
        side.alias("side"),
        F.when(side == "both", diffs).otherwise(F.filter(diffs, lambda d: F.lit(False))).alias("diffs"),
    ).filter((F.col("side") != "both") | (F.size("diffs") > 0))


def findings(diff: DataFrame, tbl: str, only_left: str = "only_main", only_right: str = "only_copy") -> DataFrame:
    """One row for each missing key or differing field: (tbl, row_id, finding)."""
    names = F.when(F.col("side") == "only_left", F.array(F.lit(only_left))).when(F.col("side") == "only_right", F.array(F.lit(only_right))).otherwise(F.col("diffs.field"))
    return diff.select(F.lit(tbl).alias("tbl"), F.col("key").alias("row_id"), F.explode(names).alias("finding"))
