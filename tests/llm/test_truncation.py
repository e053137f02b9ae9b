"""Truncation: held-out accuracy on texts that are cut here, and the defined cases."""

import random

import pytest

from stemma.llm import truncation as tr

SCHEMA = "seq long, hash string, title string, snippet string, sourced_from string, field int, cut string"


def make(rnd, i):
    a, b, c = (rnd.choice(["graph models", "query planning", "record linkage", "label noise", "video retrieval"]) for _ in range(3))
    s = [f"We study {a} under {b} and release the code.", f"Results on {b} show that {c} is {rnd.choice(['stable', 'robust', 'fast'])}.", f"This work revisits {c} from the perspective of {a}."]
    rnd.shuffle(s)
    return f"{rnd.choice(['On', 'Towards', 'Learning'])} {a} for {b}", " ".join(s[: rnd.randint(2, 3)])


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(5)
    rows, cut = [], set()
    for i in range(3000):
        title, text = make(rnd, i)
        source = rnd.choice(["crawl", "crawl", "plan"])
        if source == "plan" and len(text) > 100:
            text = text[:100]
            cut.add(i)
        elif rnd.random() < 0.04:
            at = rnd.randint(20, len(text) - 8)
            if text[at - 1].isalpha() and text[at].isalpha():
                text = text[:at]
                cut.add(i)
        rows.append((i, f"h{i}", title, text, source, 1, "x"))
    extra = [(90_000, "x", "Keywords", "Keywords: graph models, query planning", "crawl"), (90_001, "y", "On graph models for label noise", "We study graph models under …", "crawl"), (90_002, "z", None, "   ", None), (90_003, None, "", None, None), (90_004, "w", "On graph models for label noise", "We study graph mo�", "crawl"), (90_005, "v", "On graph models for label noise", "This work revisits label noise from the persp" + "...", None)]
    df = spark.createDataFrame([*rows, *((*e, 1, "x") for e in extra)], SCHEMA)
    out = tr.truncated(df).filter("field = 'snippet'").collect()
    return cut, out, df


def test_held_out_accuracy(judged):
    cut, out, _ = judged
    found = {r.id for r in out if r.cut and r.id < 90_000}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.02 * len(found)


def test_defined_cases(judged):
    _, out, _ = judged
    by = {r.id: r.cut for r in out}
    assert 90_000 not in by and 90_001 not in by and 90_002 not in by and 90_003 not in by
    assert by[90_004] and by[90_005]


def test_titles_with_a_name_are_judged(spark):
    rnd = random.Random(6)
    rows = [(i, f"h{i}", f"{rnd.choice(['Fazi', 'Nige', 'Popu'])}{rnd.choice(['ho', 'zu', 'ta'])}: {make(rnd, i)[0].lower()}", make(rnd, i)[1], "crawl", 1, "x") for i in range(1500)]
    cut = {100: 3, 400: 4, 700: 5, 1000: 6, 1300: 3}
    rows = [(i, h, title[: -cut[i]] if i in cut else title, *rest) for i, h, title, *rest in rows]
    found = [r for r in tr.truncated(spark.createDataFrame(rows, SCHEMA)).filter("field = 'title'").collect()]
    assert len(found) == 1500 and {r.id for r in found if r.cut} == set(cut)


def test_only_keyword_lists_are_exempt():
    lists = ("Keywords: graph models, query planning", "\n Keyowrds: label noise, video retrieval", "Topics: graph models, query planning, label noise", "关键词：模型，数据")
    assert not any(tr.prepare(t, "snippet") for t in lists)
    assert all(tr.prepare(t, "title") for t in lists)
    assert all(tr.prepare(t, "snippet") for t in ("Background: we study graph mo", "Results: stable, robust, and for the fas", "Networks: a survey of graph models"))


def test_counts_are_of_contexts_not_of_buckets(spark):
    rnd = random.Random(7)
    tails = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=18)) for _ in range(20_000)]
    key = [k for k, _ in tr.contexts(tails, ["title/en"] * len(tails), ends_only=True)][-1]
    assert len(set(key.tolist())) == len(set(tails))
    texts = [make(rnd, i)[1].casefold() for i in range(200)]
    once = spark.createDataFrame([(t, "snippet/en", False) for t in texts], "text string, stratum string, limit boolean")
    want = {}
    for k in tr.ORDERS:
        for end in {("\x02" + t)[-k:] for t in texts}:
            want[k, end] = sum(("\x02" + t)[:-1].startswith(end, i) for t in texts for i in range(len(t)))
    ends = {e: [k for k, _ in tr.contexts([e.lstrip("\x02")], ["snippet/en"], ends_only=True)][tr.ORDERS.index(n)][0] for n, e in want}
    bits = tr._filter(spark.createDataFrame([(int(k),) for k in ends.values()], "k long"), len(ends))
    got = {r.k: r.c for r in tr._continuations(once, bits).collect()}
    assert {(n, e): got.get(ends[e], 0) for n, e in want} == want


def test_rates(judged):
    _, out, df = judged
    rates = {(r.source, r.field): r for r in tr.truncation_rates(tr.truncated(df), df).collect()}
    assert rates["plan", "snippet"].share_cut > 0.5 > rates["crawl", "snippet"].share_cut and rates["crawl", "title"].n_cut <= 1


def test_empty_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tr.truncated(none).count() == 0
    long = spark.createDataFrame([(1, "h", "T", "word " * 500_000, "crawl", 1, "x"), (1, "h", "T", "word " * 500_000, "crawl", 1, "x")], SCHEMA)
    assert tr.truncated(long).count() == 4


def test_language():
    assert [tr.language(t) for t in ("the model of data", "le modèle des données est", "der bild wird mit", "los datos del método", "модель данных", "实验表明该方法", "12 34")] == ["en", "fr", "de", "es", "ru", "zh", "en"]


def test_language_of_the_end():
    assert tr.language("the model of data " * 40 + "der bild wird mit dem modell und der probe " * 12) == "de"
