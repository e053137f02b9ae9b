"""Frequency of every distinct term.

Each block of rows is tallied on its own: its terms are coded by the block's dictionary, and two arrays over the codes
hold how often a term occurs and in how many rows. The terms of all blocks make the global dictionary, which numbers
them in ranges of identifiers; the blocks' arrays are encoded by it, sent to the range they fall into and added up there,
array by array. So texts are read once, and what is shuffled has one row a term and block, however common the term.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from stemma.session import write_cut

WORD = regex.compile(r"[\p{L}\p{N}]+")
ASCII_WORD = regex.compile(r"[a-z0-9]+")
#: Distinct terms after which the counts of a block are sent on; bounds a task's memory.
BLOCK_TERMS = 400_000
#: Identifiers of a partition of the dictionary lie next to each other; 2 ** RANGE of them are a range.
PART, RANGE = 40, 16


def terms_of(text: str) -> list[str]:
    """Maximal runs of letters and digits of the NFC, lower-case text."""
    if text.isascii():
        return ASCII_WORD.findall(text.lower())
    return WORD.findall(unicodedata.normalize("NFC", text).lower())


def record_text(*columns: str) -> Column:
    """Columns of a row put together, null as empty, with a blank between."""
    return F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


class Tally(NamedTuple):
    """terms: the distinct ones; row, code, tf: one entry for each row and distinct term in it; lengths: terms of each row."""

    terms: pa.Array
    row: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    lengths: np.ndarray


def tally(texts: list[str | None]) -> Tally:
    found = [terms_of(t) if t else [] for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    coded = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
    width = max(1, len(coded.dictionary))
    pairs, tf = np.unique(np.repeat(np.arange(len(found)), lengths) * width + coded.indices.to_numpy(), return_counts=True)
    return Tally(coded.dictionary, pairs // width, pairs % width, tf, lengths)


class Block:
    """The count arrays of a block of rows, added up over its batches."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, t: Tally) -> None:
        n = len(t.terms)
        self.parts.append((t.terms, np.bincount(t.code, t.tf, n).astype(np.int64), np.bincount(t.code, minlength=n)))
        self.size += n
        if len(self.parts) > 64:
            self.parts = [self.sums()]
            self.size = len(self.parts[0][0])

    def sums(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(terms, occurrences, rows)."""
        if len(self.parts) == 1:
            return self.parts[0]
        coded = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        at, n = coded.indices.to_numpy(), len(coded.dictionary)
        return coded.dictionary, *(np.bincount(at, np.concatenate([p[i] for p in self.parts]), n).astype(np.int64) for i in (1, 2))


def block_counts(rows: DataFrame, text: Column, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Partial counts (term, occurrences, n_records) of each block of rows; a term recurs once for each block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            block.add(tally(batch.column(0).to_pylist()))
            if block.size > block_terms:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.sums()], ["term", "occurrences", "n_records"])
                block = Block()
        if block.size:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.sums()], ["term", "occurrences", "n_records"])

    return rows.select(text.alias("text")).filter("text is not null").mapInArrow(count, "term string, occurrences bigint, n_records bigint")


def dictionary(counts: DataFrame) -> DataFrame:
    """(term, term_id) of every term. The table is written once, so that an id stays the same whatever is computed again."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << PART
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(n, n + batch.num_rows))], ["term", "term_id"])
            n += batch.num_rows

    return write_cut(counts.select("term").distinct().sortWithinPartitions("term").mapInArrow(number, "term string, term_id bigint"))


def sum_ranges(encoded: DataFrame) -> DataFrame:
    """(term_id, occurrences, n_records) from the encoded counts of all blocks: a pair of arrays for each range of ids."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, [np.zeros(1 << RANGE, np.int64) for _ in range(2)]

        def full() -> pa.RecordBatch:
            used = np.flatnonzero(sums[1])
            out = pa.RecordBatch.from_arrays([pa.array((now << RANGE) + used), *(pa.array(s[used]) for s in sums)], ["term_id", "occurrences", "n_records"])
            for s in sums:
                s[:] = 0
            return out

        for batch in batches:
            ids, *counts = (c.to_numpy() for c in batch.columns)
            ranges = ids >> RANGE
            for begin, end in zip(cuts := np.flatnonzero(np.diff(ranges, prepend=-1)), [*cuts[1:], len(ids)]):  # sorted by range
                if ranges[begin] != now:
                    if now is not None:
                        yield full()
                    now = int(ranges[begin])
                for s, c in zip(sums, counts):
                    np.add.at(s, ids[begin:end] & (1 << RANGE) - 1, c[begin:end])
        if now is not None:
            yield full()

    where = F.shiftright("term_id", RANGE).alias("_range")
    ranged = encoded.select("term_id", "occurrences", "n_records", where).repartition("_range").sortWithinPartitions("_range")
    return ranged.select("term_id", "occurrences", "n_records").mapInArrow(add, "term_id bigint, occurrences bigint, n_records bigint")


def term_frequencies(rows: DataFrame, text: Column) -> DataFrame:
    """Every distinct term of the column ``text``: (term, term_id, occurrences, n_records).

    term_id is the term's place in a global dictionary: unique and gap-free within a range of ids.

    - A null text has no terms; a text without letters and digits has none either. Texts are taken whole.
    - Each row is a record: repeated rows count once each. An empty table gives no rows.
    - Only the columns in ``text`` are read.
    """
    counts = write_cut(block_counts(rows, text))
    known = dictionary(counts)
    return sum_ranges(counts.join(known, "term")).join(known, "term_id").select("term", "term_id", "occurrences", "n_records")


def mark_terms(frequencies: DataFrame, records: Column, rare_below: int = 3, common_above: float = 0.25) -> DataFrame:
    """Adds verdict: ``rare`` in fewer than rare_below records, ``common`` in more than that share of them, else ``useful``.

    A term that is both (a very small collection) is ``rare``.
    """
    n = F.col("n_records")
    return frequencies.withColumn("verdict", F.when(n < rare_below, "rare").when(n > records * common_above, "common").otherwise("useful"))
