"""Leaks against brute force over all windows, and altered sentences."""

import random

import pytest

from stemma.llm import leaks as lk

WORDS = [a + b for a in "ba ko mi ru te za lo".split() for b in "dan fel gor hin pus".split()]


def passage(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(3)) if rnd.random() < 0.2 else rnd.choice(WORDS) for _ in range(n)).capitalize()


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(11)
    instruction = "Read the text below and answer the question that comes after it in one short line of words."
    items = []
    for i in range(40):
        body = f"{passage(rnd, 22)}. {passage(rnd, 20)}."
        items.append((i, (instruction + "\n" if i % 2 else "") + body + " Who returned the ledger?"))
    items += [(100, items[3][1]), (101, None), (102, ""), (103, "Only a question?")]
    docs, wanted = [], set()
    for d in range(300):
        text, item = passage(rnd, 30) + ". ", rnd.choice(items[:40])
        words = item[1].replace(instruction, "").split("?")[0].rsplit(". ", 1)[0].replace(".", "").split()
        kind = rnd.choice(["none", "run", "short", "altered", "broken", "instruction"])
        if kind == "run":
            at = rnd.randrange(len(words) - 14)
            text += "\n".join(words[at : at + 14]).upper() + "."
            wanted.add((d, item[0]))
        elif kind == "short":
            text += "Zzz " + " ".join(words[2:15]) + " zzz."
        elif kind == "altered":
            some = words[:22]
            for k in rnd.sample(range(22), 3):
                some[k] = "changed"
            text += " ".join(some).replace("a", "a​", 1) + "."
            wanted.add((d, item[0]))
        elif kind == "broken":
            text += " ".join(w if k % 2 else "other" for k, w in enumerate(words[:22])) + "."
        elif kind == "instruction":
            text += instruction
        docs.append((d, text + " " + passage(rnd, 10)))
    wanted |= {(d, 100) for d, i in wanted if i == 3}
    docs += [(1000, None), (1001, ""), (1002, "   ")]
    return docs, items, wanted


def test_finds_exactly_what_leaked(spark, data):
    docs, items, wanted = data
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = lk.leaks(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted and len(got) == len(wanted)
    text = dict(docs)
    r = next(r for r in got if r.kind == "verbatim")
    assert len(lk.tokens(text[r.doc_id][r.start_char : r.end_char])) >= 14


def test_blocks_of_items(spark, data, monkeypatch):
    monkeypatch.setattr(lk, "BLOCK_TOKENS", 300)
    docs, items, wanted = data
    got = lk.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == wanted


def test_chinese_and_long(spark):
    body = "因为甲在旧磨坊晾晒了一百零一个星期的重复的信封乙只好把装订册无主的地图和校样留在北码头等待编号"
    items = spark.createDataFrame([(1, body + "。乙把装订册放在哪里？")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "前言。" + "，".join(body[5:31])), (2, "前言。" + body[5:29]), (3, "字" * 200_000 + body)], "doc_id long, text string")
    assert {r.doc_id for r in lk.leaks(docs, items).collect()} == {1, 3}
    assert lk.leaks(docs.limit(0), items).count() == 0 and lk.leaks(docs, items.limit(0)).count() == 0


def test_near_is_edit_distance():
    assert lk.near(("a", "b", "c"), ["x", "a", "q", "c", "y"], 2) == (1, 1, 4)
    assert lk.near(("a", "b", "c"), ["x", "y"], 1) is None


def test_altered_sentences_are_found_wherever_the_edits_lie():
    rnd = random.Random(5)
    for n in range(5, 41):
        words = tuple(f"w{chr(97 + i % 26)}{i}" for i in range(n))
        scanner = lk.Scanner([lk.Passage((1,), words, ((0, n),), False)], 99, 25, 1 / 6)
        most = scanner._edits(n)
        assert abs(most - n / 6) <= 0.5
        spread = [(k + 1) * (n + 1) // (most + 1) - 1 for k in range(most)]
        for places in [spread, *(rnd.sample(range(n), most) for _ in range(40))]:
            changed = list(words)
            for at in sorted(places, reverse=True):
                kind = rnd.choice("cad") if places is not spread else "c"
                changed[at : at + 1] = [] if kind == "d" else [words[at], "other"] if kind == "a" else ["other"]
            assert [x[:2] for x in scanner.scan("before that " + " ".join(changed) + " after it")] == [(0, "altered")], (n, places)


def test_short_sentences_leak_only_in_a_run():
    text = "The ledger of the mill was weighed over several weeks before the flood came. Indeed. It converged early."
    found = lk.passages([(1, [" ".join(s) for s in lk.item_sentences(text, lk.Splitter())])], set())
    scanner = lk.Scanner(found, 14, 25, 1 / 6)
    assert not list(scanner.scan("We do indeed like cheese. Indeed. It converged early.")) and len(list(scanner.scan("x " + text))) == 1


def test_shared_passages_are_no_instructions(spark):
    led = [f"Instruction number {w} for the reader of this text." for w in "one two three four five six".split()]
    shared = "The quiet ledger of the winter store was weighed by candlelight for ninety nights."
    other = [f"The {w} voucher of the salt cellar was kept beneath a brass map for many years." for w in WORDS[:8]]
    rows = [(i, f"{x}\n{shared} Who kept it?") for i, x in enumerate(led * 4)] + [(100 + i, f"{led[i % 6]}\n{x} Who kept it?") for i, x in enumerate(other * 9)]
    split = lk.split_items(spark.createDataFrame(rows, "item_id long, text string"), "item_id", "text")
    assert lk.instructions(split, 4) == {" ".join(lk.tokens(x)) for x in led}
    assert lk.instructions(split.limit(0), 4) == set()


def test_a_run_of_few_long_words_in_a_chinese_passage():
    found = [lk.Passage((1,), ("甲", "乙", "internationalization", "internationalization", "丙", "丁", "戊", "己"), ((0, 8),), True)]
    assert [x[1] for x in lk.Scanner(found, 14, 25, 1 / 6).scan("x internationalization internationalization y")] == ["verbatim"]
