"""How distinctive each term is of its record: probabilistic relevance weights (saturating frequency, length-normalised).

weight = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average length))

Texts are read once. The pass writes the terms of records that are wanted, and the counts of each block of records,
which give document frequencies, number of records and mean length over all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stemma.llm.terms import BLOCK_TERMS, Block, tally
from stemma.session import write_cut

#: A term in more than one record of HOT, and in more than one of MOST_HOT of all (record, term) pairs, is hot. So there
#: are at most MOST_HOT hot terms, and no other has more rows than the greater of these shares.
HOT, MOST_HOT = 1000, 200_000
PARTS = "kind tinyint, id bigint, term string, n bigint, m bigint"


def read(rows: DataFrame, id_col: str, text: Column, min_tf: int) -> DataFrame:
    """PARTS: of kind 0 (id, term, tf, length) of records; of kind 1 (term, records) and of kind 2 (records, length) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, records, length = Block(), 0, 0

        def part(kind: int, ids, terms, n, m) -> pa.RecordBatch:
            size = len(n)
            arrays = [pa.array(np.full(size, kind, np.int8)), ids or pa.nulls(size, pa.int64()), terms if terms is not None else pa.nulls(size, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["kind", "id", "term", "n", "m"])

        def counted() -> pa.RecordBatch:
            terms, _, n = block.sums()
            return part(1, None, terms, n, np.zeros(len(n), np.int64))

        for batch in batches:
            t = tally(batch.column(1).to_pylist())
            records += int((t.lengths > 0).sum())
            length += int(t.lengths.sum())
            block.add(t)
            kept = np.flatnonzero(t.tf >= min_tf)
            yield part(0, batch.column(0).take(pa.array(t.row[kept])), t.terms.take(pa.array(t.code[kept])), t.tf[kept], t.lengths[t.row[kept]])
            if block.size > BLOCK_TERMS:
                yield counted()
                block = Block()
        if block.size:
            yield counted()
        yield part(2, None, None, [records], [length])

    return rows.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text")).filter("text is not null").mapInArrow(run, PARTS)


def relevance(rows: DataFrame, id_col: str, text: Column, k1: float = 1.2, b: float = 0.75, min_tf: int = 1, floor: tuple[int, int] | None = None) -> DataFrame:
    """The weight of each term in each record: (id, term, tf, df, weight).

    Document frequencies, record count and mean length cover all rows. min_tf: terms that occur less often in the record
    have no row. floor: (tf, df); rows must weigh at least what a term that occurs so often, in so many records, weighs
    in the same record. Since weights grow with tf and fall with df, no row with that tf or more and that df or less is lost.

    - A null text has no terms and does not count as a record; neither does one without any letter or digit.
    - Repeated rows are records of their own; a null id stays null. An empty table gives no rows.
    - Terms of equal weight all come out. Columns other than id_col and those of ``text`` are not read.

    A very common term has a join key that a third of all rows may share. Hot terms (HOT, MOST_HOT) are joined by
    broadcast, all others by shuffle.
    """
    parts = write_cut(read(rows, id_col, text, min_tf))
    wanted = parts.filter("kind = 0").select("id", "term", F.col("n").alias("tf"), F.col("m").alias("length"))
    whole = F.col("kind") == 2
    totals = parts.agg(*(F.coalesce(F.sum(F.when(c, x)), F.lit(0)).alias(name) for c, x, name in ((whole, F.col("n"), "records"), (whole, F.col("m"), "length"), (F.col("kind") == 1, F.col("n"), "pairs"))))
    scale = F.broadcast(totals.select("records", "pairs", (F.col("length") / F.col("records")).alias("mean")))  # one row
    df = parts.filter("kind = 1").groupBy("term").agg(F.sum("n").alias("df")).crossJoin(scale)
    ranked = df.withColumn("hot", (F.col("df") * HOT > F.col("records")) & (F.col("df") * MOST_HOT > F.col("pairs"))).select("term", "df", "records", "mean", "hot")
    known = wanted.join(F.broadcast(ranked.filter("hot")), "term", "left")
    joined = known.filter("hot").unionByName(known.filter("hot is null").drop("df", "records", "mean", "hot").join(ranked.filter("not hot"), "term"))

    def weight(tf: Column, df: Column) -> Column:
        idf = F.log1p((F.col("records") - df + 0.5) / (df + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    scored = joined.withColumn("weight", weight(F.col("tf").cast("double"), F.col("df")))
    if floor is not None:
        scored = scored.filter(F.col("weight") >= weight(F.lit(float(floor[0])), F.lit(floor[1])) * (1 - 1e-9))
    return scored.select("id", "term", "tf", "df", "weight")
