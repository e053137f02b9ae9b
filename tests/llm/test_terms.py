"""Term counts and relevance weights against brute force."""

import math
import unicodedata
from collections import Counter

import pytest
import regex

from pyspark.sql import functions as F

from stemma.llm import relevance as rel, terms

TEXTS = [(1, "Graph nets, graph NETS!", "deep"), (2, None, None), (3, "", "  "), (4, "Étude étude", "graph " * 30_000), (5, "graph", None), (5, "graph", None), (None, "alone 中文 x́y", "q1 2b")]


def tokens(a, b):
    return regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFC", (a or "") + " " + (b or "")).lower())


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(*r, 7, "x") for r in TEXTS], "seq long, title string, snippet string, term int, weight string")


@pytest.mark.parametrize("block", [2, terms.BLOCK_TERMS])
def test_frequencies_are_exact(rows, block, monkeypatch):
    monkeypatch.setattr(terms.block_counts, "__defaults__", (block,))
    occ, rec = Counter(), Counter()
    for _, a, b in TEXTS:
        occ.update(tokens(a, b))
        rec.update(set(tokens(a, b)))
    got = terms.term_frequencies(rows, terms.record_text("title", "snippet")).collect()
    assert {r.term: (r.occurrences, r.n_records) for r in got} == {t: (occ[t], rec[t]) for t in occ}
    assert len({r.term_id for r in got}) == len(got) == len(occ)


def test_ids_do_not_change(rows):
    found = terms.term_frequencies(rows.repartition(3), terms.record_text("title", "snippet"))
    ids = lambda: {(r.term, r.term_id) for r in found.collect()}
    assert ids() == ids() and len({i for _, i in ids()}) == len(ids())


def test_ranges_add_up_all_blocks(spark):
    rows = [(i, n, 1) for n in (1, 2, 3) for i in (0, 5, 65_535, 65_536, 1 << 40, (1 << 40) + 70_000)]
    got = terms.sum_ranges(spark.createDataFrame(rows, "term_id long, occurrences long, n_records long")).collect()
    assert sorted(map(tuple, got)) == [(i, 6, 3) for i in (0, 5, 65_535, 65_536, 1 << 40, (1 << 40) + 70_000)]


def test_marks_and_empty(rows, spark):
    f = terms.term_frequencies(rows, terms.record_text("title", "snippet"))
    marks = {r.term: r.verdict for r in terms.mark_terms(f, F.lit(7), 2, 0.25).collect()}
    assert marks["graph"] == "common" and marks["deep"] == "rare" and set(marks.values()) == {"rare", "common"}
    assert terms.term_frequencies(rows.limit(0), terms.record_text("title", "snippet")).count() == 0


def brute(k1=1.2, b=0.75):
    docs = [(i, Counter(tokens(x, y)), len(tokens(x, y))) for i, x, y in TEXTS if tokens(x, y)]
    n, mean = len(docs), sum(d[2] for d in docs) / len(docs)
    df = Counter(t for d in docs for t in d[1])
    return sorted((i if i is not None else -1, t, tf, df[t], round(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)), 9)) for i, c, size in docs for t, tf in c.items())


@pytest.mark.parametrize("hot, most", [(1, 200_000), (1000, 200_000), (1000, 3)])
def test_weights_are_exact(rows, hot, most, monkeypatch):
    monkeypatch.setattr(rel, "HOT", hot)
    monkeypatch.setattr(rel, "MOST_HOT", most)
    got = rel.relevance(rows, "seq", terms.record_text("title", "snippet")).collect()
    assert sorted((r.id if r.id is not None else -1, r.term, r.tf, r.df, round(r.weight, 9)) for r in got) == brute()


def test_selection_equals_filter(rows):
    got = rel.relevance(rows, "seq", terms.record_text("title", "snippet"), min_tf=2, floor=(2, 3)).collect()
    kept = [(r.id, r.term, round(r.weight, 9)) for r in got if r.df <= 3]
    assert sorted(kept) == [(i, t, w) for i, t, tf, df, w in brute() if tf >= 2 and df <= 3]
    assert len(got) < sum(tf >= 2 for _, _, tf, _, _ in brute()) or len(got) == len(kept)
    assert rel.relevance(rows.limit(0), "seq", terms.record_text("title", "snippet")).count() == 0
