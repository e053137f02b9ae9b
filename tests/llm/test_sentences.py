"""Sentences: the rules of each script, and what holds for any text."""

import pytest
from hypothesis import given, settings, strategies as st

from stemma.llm import sentences as sn

CASES = [
    ("en", ["Mr. Smith joined Acme Ltd. in 2018.", "Results vs. the baseline are in Tab. 4, p = 0.08.", "No!", "Is it worth it?", "It cost 3.2 points."]),
    ("en", ['"It stalls. Then it recovers," the log says.', "Nothing changed (we checked twice. It was the same.) after the merge."]),
    ("en", ["The crawl stopped at 11:05 p.m. on Jan. 8, after page 3.", "See https://a.example/list.8 now."]),
    ("en", ["It works by A, B, et al.", "Experiments follow.", "We repeated the run ... and it stalled again."]),
    ("en", ["He was sure: X v. 4 is slower than v. 2.", "C. C. Doe and Roe disagree."]),
    ("de", ["Am 9. März 2002 wurde die Suche abgebrochen.", "Die Zahl liegt bei ca. 4.700, d. h. unter der Grenze.", "Sie fragte: „Ist er schneller?“", "„Läuft das noch? Dann stoppen“, schrieb sie.", "Seite 6 fehlt!"]),
    ("fr", ["Voir p. ex. la fig. 6 et l'art. 7 du rapport.", "« Faut-il relancer ? » demande le relecteur.", "Quelle surprise !", "D'après M. Doe, oui."]),
    ("es", ["El Sr. Doe revisó 7 páginas.", "¿Por qué faltan?", "Faltan títulos, etc. en la lista.", "Hay unas 8.900 fichas, aprox.", "¡No!"]),
    ("ru", ["См. табл. 6 и прил. 8 к отчёту.", "В 2014 г. А. Б. Doe проверил список.", "«Повторить? Нет», — ответил рецензент.", "Запрос вернул около 9 тыс. записей!"]),
    ("el", ["Γιατί λείπει η σελίδα 2;", "Βλ. π.χ. τον πίν. 8 της έκθεσης.", "Η λίστα περιέχει διπλές· δεν έχουν διορθωθεί."]),
    ("ar", ["كتب د. Doe أن القائمة ناقصة، ثم أغلق المهمة.", "قال: «هل نعيد؟ لا.» ثم انصرف.", "لماذا؟", "توقف البحث!"]),
    ("hi", ["डॉ. Doe ने सूची जाँची।", 'उसने लिखा, "फिर से? नहीं।" और बंद किया।', "क्या पृष्ठ 4 खाली है?"]),
    ("ko", ['심사자는 "다시 실행할까요? 아니요."라고 적었다.', "Doe v3.5 버전이 더 빠르다.", "왜 2쪽에는 결과가 없는가?"]),
]


@pytest.mark.parametrize("lang, wanted", CASES)
def test_scripts(lang, wanted):
    text = " ".join(wanted)
    assert [text[a:b] for a, b in sn.Splitter().spans(text, lang)] == wanted


@pytest.mark.parametrize("wanted", [["「変化なし。」と記録にはある。", "なぜ空なのか？", "Doe v3.4は速い。"], ["审稿人写道：“需要重跑吗？不需要。”随后任务被关闭。", "过于常见……但没有给出证据。", "停止了！"]])
def test_without_blanks(wanted):
    text = "".join(wanted)
    assert [text[a:b] for a, b in sn.Splitter().spans(text)] == wanted


def test_thai_blanks():
    text = "ระบบ Joteduzo ช่วยลดข้อผิดพลาด ผลลัพธ์ของหน้า 3 ไม่ครบถ้วน"
    assert [text[a:b] for a, b in sn.Splitter().spans(text)] == ["ระบบ Joteduzo ช่วยลดข้อผิดพลาด", "ผลลัพธ์ของหน้า 3 ไม่ครบถ้วน"]


def test_layout():
    text = "4.2 Results\n\nOne line\nthat goes on. Two.\n\n- first item. with more\n* second\n\n5. Related Work\r\n\r\n{\"a\": \"x. Y\"} It follows.No blank here."
    assert [text[a:b] for a, b in sn.Splitter().spans(text)] == ["4.2 Results", "One line\nthat goes on.", "Two.", "- first item. with more", "* second", "5. Related Work", '{"a": "x. Y"} It follows.', "No blank here."]


def test_document_settles_abbreviation():
    text = "Zorb. five was read, and zorb. six too. Later zorb. Seven came."
    assert len(sn.Splitter().spans(text)) < len(sn.Splitter().spans("The zorb fell. A zorb ran. Later zorb. Seven came."))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t.!?…。\"“”„«»()[]{}-*aBcД1中กα;·'​", max_size=80))
def test_covers_all_visible_text(text):
    spans = sn.Splitter().spans(text)
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    covered = set().union(*(range(a, b) for a, b in spans)) if spans else set()
    assert all(i in covered or c.isspace() or c == "​" for i, c in enumerate(text))


def test_table(spark):
    rows = [(1, "One. Two.", "en", 5), (2, None, "en", 5), (3, "", None, 5), (4, " \n ", None, 5), (5, "Ab. " * 30_000, "xx", 5), (6, "One. Two.", None, 5), (6, "One. Two.", None, 5), (None, "Null id.", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, start_char int")
    got = sn.sentences(df).collect()
    assert sorted((r.start_char, r.end_char) for r in got if r.doc_id == 1) == [(0, 4), (5, 9)]
    assert {r.doc_id for r in got} == {1, 5, 6, None} and sum(r.doc_id == 6 for r in got) == 4
    assert sn.sentences(df.limit(0)).count() == 0


def test_rare_words_keep_their_verdict(spark):
    rows = [(i, f"We saw the qzt. {'paper' if i % 2 else 'table'} here, cf. the qzz.", "en") for i in range(8)] + [(100 + i, "It ends. " * 50, "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    corpus, rare = sn.corpus_abbreviations(df, most=1)
    assert "qzt" not in corpus and "qzt" in {r.word for r in rare.collect()}
    everywhere, none = sn.corpus_abbreviations(df)
    assert none is None and corpus | {r.word: r.verdict for r in rare.collect()} == everywhere
    few, all_ = (sorted(map(tuple, sn.sentences(df, most=m).collect())) for m in (1, 1000))
    assert few == all_


def test_one_evidence_for_documents_and_corpus():
    text = "Voir l'éq. 3 du texte, un éq seul et in-proc. ici, cf. l'éq. de base. Une équation, a.a.a. et d. h. fin. डॉ. Doe ने डॉ कहा."
    rows, found = sn.stops(text), sn.occurrences(text)
    assert rows["éq"][:2] == [2, 2] and found["éq"] == 3 and found["डॉ"] == 2 and rows["डॉ"][0] == 1
    assert rows["proc"][:3] == rows["in-proc"][:3] == [1, 1, 1] and "3" not in rows
    both, twice = sn.stops(text + "\n\n" + text), sn.occurrences(text + "\n\n" + text)
    assert both == {w: [2 * n for n in r] for w, r in rows.items()} and twice == {w: 2 * n for w, n in found.items()}


@pytest.mark.parametrize("text", ["On lit l'zorb. cinq puis l'zorb. six et d'zorb. sept. Puis l'zorb. Huit vient. Fin ici.", "He saw fig. Three of approx. nine. Later the fig. Four came. Dr. Doe left. See no. 3."])
def test_padding_never_moves_a_boundary(text):
    alone = sn.Splitter().spans(text)
    for size in (10, 1_000, 40_000):
        padded = text + "\n\n" + "Plain filler goes on here. " * (size // 27)
        assert [x for x in sn.Splitter().spans(padded) if x[1] <= len(text)] == alone


def test_document_and_corpus_come_before_the_list():
    text = "The fig was ripe. Each fig fell. We ate a fig. Then a fig. Then it rained. One more fig here, a fig there."
    assert "We ate a fig." in [text[a:b] for a, b in sn.Splitter().spans(text)]
    assert len(sn.Splitter({"fig": "W"}).spans("It was a fig. Then it rained.")) == 2 and len(sn.Splitter().spans("It was in Fig. Three then.")) == 1
