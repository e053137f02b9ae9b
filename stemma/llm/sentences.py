"""Sentence boundaries across languages and scripts, by document-centred disambiguation.

Whether a word with a full stop is an abbreviation, and whether a capital letter after it marks a proper name, is settled
from unambiguous occurrences elsewhere in the document; where those settle nothing, counts over the whole corpus decide,
and where those settle nothing either a short list of well-known abbreviations. One function gathers the evidence of a
document and of the corpus. Terminators, quotations, list items and blanks follow rules of their script.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import ChainMap, Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from stemma.session import cut_lineage

# Well-known abbreviations that do not end a sentence.
BEFORE_NAMES_AND_NUMBERS = frozenset(
    """mr mrs ms dr prof st messrs rev hon gen col capt lt sgt fig figs sec secs sect tab tabs thm thms eq eqs eqn ch chap
    vol vols nos pp cf vs viz ca e.g i.e jan feb mar apr jun jul aug sep sept oct nov dec
    hr fr abb abs kap vgl nr bd bsp evtl ggf inkl sog bzw z.b d.h u.a
    mme mlle mgr ex art chap n° réf p.ex
    sr sra srta dra núm págs pág cap ej p.ej
    см рис табл прил стр ред им проф акад гл т.е т.к
    βλ πίν σελ κεφ εικ π.χ κ
    डॉ श्री د أ""".split()
)
# Well-known abbreviations that may end one.
MAY_END = frozenset("inc ltd co corp jr al etc approx aprox u.s u.k u.s.a p.m a.m ph.d usw др тыс млн млрд руб κ.λπ κλπ".split())

OPENERS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "„": "“”", "«": "»", "‹": "›"}
CLOSERS = frozenset(")]}）］】〕」』》〉”»›\"'’")
QUOTE_OPENERS = frozenset("\"“„«‹‘([{「『（")
MARKS = re.compile("[" + "".join(re.escape(c) for c in sorted({*OPENERS, *"".join(OPENERS.values()), '"'})) + "]")
HARD = frozenset("。！？｡．।॥۔؟\u037e")  # end a sentence wherever they stand outside quotations
TERMINATOR = re.compile(r"[.!?…。！？｡．।॥۔؟;\u037e]+")
BLANK_LINE = re.compile(r"(?:\r\n|[\n\r])(?:[^\S\r\n]*(?:\r\n|[\n\r]))+|\u2029")
LINE = re.compile(r"[^\r\n]+")
BULLET = re.compile(r"[^\S\r\n]*[-*+•‣◦▪●·–—]\s+\S")
NUMBERED = re.compile(r"[^\S\r\n]*\(?(?:\d{1,3}(?:\.\d{1,3})*|[a-zA-Z]|[ivxIVX]{1,4})[.)]\s+\S")
THAI = re.compile(r"[ก-๿]")
FOLLOWER = regex.compile(r"[\p{L}\p{M}]+")
LETTER = re.compile(r"[^\W_]")
# between Thai letters, or between Thai and a run of other words that is too long for a name
THAI_BLANK = regex.compile(r"(?<=[ก-๿])[\s\p{Cf}]*\s[\s\p{Cf}]*(?=[ก-๿]|[\p{Latin}\p{Cyrillic}'’-]+(?:\s+[\p{Latin}\p{Cyrillic}'’-]+){3})")
GREEK = regex.compile(r"[\p{Greek}]")
GERMAN = regex.compile(r"\b(?:der|die|das|den|und|wurde|nicht|ist|bei|von|auf|mit|ein|eine|aus)\b")
NOT_GERMAN = regex.compile(r"\b(?:the|of|and|is|in|to|with|by|le|la|les|el|los|un|une|et|de|y|que)\b")
VOWELS = frozenset("aeiouyáéíóúàèìòùâêîôûäëïöüаеёиоуыэюяαεηιουωάέήίόύώ")
#: So many verdicts on words every worker knows; those of rarer words are then joined to the texts that have them.
MOST = 500_000


# A word, or several joined by full stops, apostrophes or hyphens; the second form is for texts with combining marks.
TOKEN = re.compile(r"\w++(?:[.'’°-]++\w++)*+")
MARKED_TOKEN = regex.compile(r"[\w\p{M}]++(?:[.'’°-]++[\w\p{M}]++)*+")
# The same before a full stop, with the white space and the character after it.
DOTTED = re.compile(r"(?<!\w)(\w++(?:[.'’°-]++\w++)*+)\.(?=(\s*)(.?))", re.DOTALL)
MARKED_DOTTED = regex.compile(r"(?<![\w\p{M}])([\w\p{M}]++(?:[.'’°-]++[\w\p{M}]++)*+)\.(?=(\s*)(.?))", regex.DOTALL)
JOINER = re.compile(r"[.'’°-]+")
MARKED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x483, 0x487), (0x591, 0x5C7), (0x610, 0x61A), (0x64B, 0x65F), (0x900, 0x903), (0x93A, 0x94F), (0x980, 0x1CFF), (0x3099, 0x309A))) + "]")
#: Letters of the longest word that is taken for an abbreviation.
LONGEST = 12
#: Doubtful words of a document that are first looked for one by one; with more the document is read once for all. Either way the evidence is the same.
FEW = 32


@lru_cache(maxsize=1 << 16)
def endings(token: str) -> tuple[str, ...]:
    """A word and what of it follows each joint, in lower case: of l'art also art. Words with digits, and too long ones, are left out."""
    token = token.lower()
    starts = (0,) if token.isalnum() else (0, *(m.end() for m in JOINER.finditer(token)))
    return tuple(w for i in starts if len(w := token[i:]) <= LONGEST and not any(c.isdigit() for c in w))


def stops(text: str) -> dict[str, list[int]]:
    """word -> [before a full stop, the same but for addresses and numbers, with the sentence going on, at the end of a block]
    of a text, or of several with a blank line between."""
    rows: dict[str, list[int]] = {}
    for (token, gap, after), n in Counter((MARKED_DOTTED if MARKED.search(text) else DOTTED).findall(text)).items():
        counts = not after or gap or after in ",;:"  # else inside an address, a number or a quotation
        ends = not after or len(gap) > 1 and (gap.count("\n") > 1 or gap.count("\r") > 1 or "\u2029" in gap)
        for w in endings(token):
            row = rows.setdefault(w, [0, 0, 0, 0])
            row[0] += n
            if counts:
                row[1] += n
                row[2] += 0 if ends or not (after in ",;:" or after.islower()) else n
                row[3] += n if ends else 0
    return rows


def occurrences(text: str) -> Counter:
    """How often each word occurs in such a text, with a full stop or without."""
    text = text.replace("İ", "I").lower()  # the one letter that lower case makes longer
    found: Counter = Counter()
    for token, n in Counter((MARKED_TOKEN if MARKED.search(text) else TOKEN).findall(text)).items():
        if token.isalnum():
            if len(token) <= LONGEST:
                found[token] += n
            continue
        at = 0
        for m in JOINER.finditer(token):  # a word inside, unless a full stop is the joint
            if m.group()[0] != "." and m.start() - at <= LONGEST:
                found[token[at : m.start()]] += n
            at = m.end()
        for w in endings(token):
            found[w] += n
    return found


def dotted_words(text: str) -> set[str]:
    """The words before full stops on which a text may need the verdict of the corpus."""
    return {w for token, _, _ in (MARKED_DOTTED if MARKED.search(text) else DOTTED).findall(text) for w in endings(token.replace("’", "'"))}


def last_word(text: str, low: int, end: int) -> str:
    """The word that ends at ``end``, with full stops, apostrophes and hyphens inside."""
    at = text.rfind(" ", low, end) + 1
    if at and (word := text[at:end]).isalnum():
        return word
    at = end
    while at > low and ((c := text[at - 1]).isalnum() or c in ".'’°-" or unicodedata.category(c)[0] == "M"):
        at -= 1
    return text[at:end].lstrip(".'’°-")


def judge(row: tuple[int, int, int, int], sure: int) -> str:
    """'T' never ends a sentence, 'F' may end one, 'W' an ordinary word, '' not settled by this evidence.

    row: how often without a full stop, with one, with one and the sentence going on, with one at the end of a block.
    """
    bare, dotted, goes_on, ends = row
    if dotted < sure:
        return ""
    if bare > dotted:
        return "W"
    if goes_on * 3 >= dotted and bare * 4 <= dotted:
        return "T" if ends * 50 < dotted and (dotted >= 20 * sure or dotted >= 3 * sure and goes_on * 10 >= dotted * 9) else "F"
    if dotted >= 20 * sure and ends * 200 < dotted and bare * 20 <= dotted:
        return "T"
    return "W" if ends * 20 >= dotted else ""


def proper_names(text: str) -> tuple[set[str], set[str]]:
    """Words seen with a capital inside a sentence, and words seen in lower case, in this document."""
    capital = set(regex.findall(r"(?<=[\p{Ll},]\s)\p{Lu}[\p{L}\p{M}]+", text))
    lower = set(regex.findall(r"\b\p{Ll}[\p{L}\p{M}]+", text))
    return capital, lower


def protected(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets, both marks included; an opening mark without a partner protects nothing."""
    if not MARKS.search(text, start, end):
        return []
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}  # closing marks that some open mark waits for, so that a stray one costs no search
    found: list[tuple[int, int]] = []
    for m in MARKS.finditer(text, start, end):
        c, i = m.group(), m.start()
        if not waiting.get(c):
            if c in OPENERS or c == '"':
                stack.append((c, i))
                for x in OPENERS.get(c, c):
                    waiting[x] = waiting.get(x, 0) + 1
            continue
        while True:  # what was opened since and never closed protects nothing
            o, at = stack.pop()
            closing = OPENERS.get(o, o)
            for x in closing:
                waiting[x] -= 1
            if c in closing:
                break
        found.append((at, i + 1))
    outer: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if outer and a < outer[-1][1]:
            continue
        outer.append((a, b))
    return outer


ASIDE = re.compile(r"(?:\[[^\]\s]{1,20}\]|<[^>\s]{1,20}>)\s")
#: Characters in which the first letter or digit after a terminator is looked for; beyond them nothing is known of it.
AHEAD = 40
#: Characters back in which a semicolon looks for the script it stands in.
BEHIND = 200


class Splitter:
    """Splits texts; ``corpus`` maps words to the verdict of the whole corpus."""

    def __init__(self, corpus: dict[str, str] | None = None):
        self.corpus = corpus or {}

    def spans(self, text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
        """Offsets of the sentences of a text, in code points, end exclusive."""
        if not text or text.isspace():
            return []
        self.text, self.lang = text, (lang or "").lower()[:2]
        self.stops: dict[str, list[int]] | None = None
        self.occurrences: Counter | None = None
        self.kinds: dict[str, str] = {}
        self.lower = ""
        self.thai = bool(THAI.search(text))
        self.names: tuple[set[str], set[str]] | None = None
        out: list[tuple[int, int]] = []
        at = 0
        breaks = [m.span() for m in BLANK_LINE.finditer(text)] if "\n" in text or "\r" in text or "\u2029" in text else []
        for a, b in [*breaks, (len(text), len(text))]:
            for s, e in self._segments(at, a):
                self._split(s, e, out)
            at = b
        return out

    def _segments(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """The items of a list; any other block as a whole."""
        if self.text.find("\n", start, end) < 0 and self.text.find("\r", start, end) < 0:
            yield start, end
            return
        lines = [m.span() for m in LINE.finditer(self.text, start, end) if not self.text[m.start() : m.end()].isspace()]
        for marker in (BULLET, NUMBERED):
            if len(lines) > 1 and marker.match(self.text, lines[0][0], lines[0][1]):
                starts = [a for a, b in lines if marker.match(self.text, a, b)]
                if marker is BULLET or len(starts) > 1:
                    yield from zip(starts, [*starts[1:], end])
                    return
        yield start, end

    def _add(self, a: int, b: int, out: list) -> None:
        part = self.text[a:b]
        bare = part.strip()
        if bare and (bare[0].isalnum() or any(unicodedata.category(c) != "Cf" and not c.isspace() for c in bare)):  # invisible characters alone are no sentence
            a += len(part) - len(part.lstrip())
            out.append((a, a + len(bare)))

    def _split(self, start: int, end: int, out: list) -> None:
        text = self.text
        if BULLET.match(text, start, end):
            self._add(start, end, out)
            return
        head = NUMBERED.match(text, start, end)
        first = head.end() - 1 if head else start
        shields = protected(text, start, end)
        opens = [s[0] for s in shields]
        word = LETTER.search(text, start, end)
        self.first_word = word.start() if word else end
        self.near: bool | None = None
        cuts = []
        for m in TERMINATOR.finditer(text, first, end):
            a, b = m.span()
            if b < end and b - a == 1 and text[a] == "." and ((c := text[b]).islower() or c.isdigit()):
                continue  # inside a number, an address or an abbreviation
            k = bisect_left(opens, a) - 1 if opens else -1
            shield = shields[k] if k >= 0 and a < shields[k][1] else None
            if shield:
                # a quotation that ends with a terminator may end the sentence too
                if b < shield[1] and all(c in CLOSERS or c.isspace() for c in text[b : shield[1] - 1]) and self._after_quote(start, shield, end):
                    cuts.append(shield[1])
                continue
            while b < end and text[b] in CLOSERS and not self._opens(opens, b):
                b += 1
            if self._ends(start, a, m.end(), b, end):
                cuts.append(b)
        at = start
        for c in [*dict.fromkeys(cuts), end]:
            if c > at:
                if self.thai:
                    self._thai(at, c, shields, out)
                else:
                    self._add(at, c, out)
                at = c

    @staticmethod
    def _opens(opens: list[int], at: int) -> bool:
        k = bisect_left(opens, at)
        return k < len(opens) and opens[k] == at

    def _thai(self, a: int, b: int, shields: list[tuple[int, int]], out: list) -> None:
        at, opens = a, [s[0] for s in shields]
        for m in THAI_BLANK.finditer(self.text, a, b):
            k = bisect_left(opens, m.start()) - 1
            if k < 0 or m.start() >= shields[k][1]:
                self._add(at, m.start(), out)
                at = m.end()
        self._add(at, b, out)

    def _next(self, at: int, end: int) -> tuple[int, str, str]:
        """Place and character of what follows, and the first letter or digit from there on."""
        text = self.text
        while at < end and ((c := text[at]).isspace() or not c.isalnum() and unicodedata.category(c) == "Cf"):
            at += 1
        if at >= end:
            return end, "", ""
        c = text[at]
        if c.isalnum():
            return at, c, c
        skip = ASIDE.match(text, at, end) if c in "[<" else None  # what follows a mark such as [x] or <x> tells more than the mark
        begin = skip.end() if skip else at
        letter = LETTER.search(text, begin, begin + AHEAD)
        return at, c, letter.group() if letter else ""

    def _after_quote(self, start: int, shield: tuple[int, int], end: int) -> bool:
        at, c, letter = self._next(shield[1], end)
        if not c:
            return True
        if self.text[shield[0]] in "([{（［【〔":
            at = shield[0] - 1
            while at >= start and self.text[at].isspace():
                at -= 1
            return (at < start or self.text[at] in ".!?。！？") and letter.isupper()
        if at == shield[1]:  # nothing between the quotation and what follows
            return False
        return c in QUOTE_OPENERS or c.isupper() or c.isdigit()

    def _ends(self, start: int, a: int, run_end: int, b: int, end: int) -> bool:
        """Does the run of terminators text[a:run_end], with closing marks up to b, end a sentence?"""
        text = self.text
        run = text[a:run_end]
        if a > self.first_word and not HARD.isdisjoint(run):
            return True
        at, c, letter = self._next(b, end)
        if not c:
            return True
        gap = at > b
        if a <= self.first_word:
            return False
        if ";" in run:
            last = next((x for x in reversed(text[max(start, a - BEHIND) : a]) if x.isalpha()), "")
            return bool(GREEK.match(last)) and gap and not letter.islower()
        starts = c == "{" or letter.isupper() or letter.isdigit() or (letter.isalpha() and not letter.islower())
        if "!" in run or "?" in run:
            return c not in ",;:)]}" if gap else (letter.isupper() and c == letter) or unicodedata.category(c) == "Lo" or (c in QUOTE_OPENERS and letter.isupper())
        if len(run) > 1 or run == "…":
            return gap and starts and c not in ",;:)" and not letter.isdigit()
        if c in ",;:)]}-–—":
            return False
        whole = last_word(text, max(start, a - 4 * LONGEST), a)  # what is longer is no abbreviation, wherever it begins
        word = whole.replace("’", "'").rpartition("'")[2]  # l'art. is art.
        if not starts:
            return gap and letter.islower() and self._ordinary(word, start, a, end)
        if not gap:
            if c in QUOTE_OPENERS:
                return len(word) > 2 and word.isalpha() and letter.isupper()
            kind = self._kind(word) if word else ""
            plain = word.isalpha() and c == letter and (kind == "F" or (len(word) > 2 and kind != "T"))
            if not word:  # after a closing mark
                return c.isupper()
            if letter.isupper():
                initial = text[at + 1 : at + 3] == ". "
                number = c == letter and word.replace(".", "").isdigit() and (text[at + 1 : at + 2].islower() or initial)
                return (number or plain and word[-1].islower()) and at + 1 < end and not text[at + 1].isupper() and "/" not in text[max(start, a - len(whole) - 1) : a]
            return plain and unicodedata.category(c) == "Lo"
        if not word:
            return True
        if word.isdigit():
            return not (len(word) <= 2 and letter.isalpha() and self._german(start, end))
        if len(word) == 1 and word.isalpha():
            return False
        kind = self._kind(word)
        if kind == "T" or (letter.isdigit() and word.lower() in ("approx", "aprox")):
            return False
        if kind == "F" and word.lower() not in MAY_END:
            if letter.isdigit():
                return False
            follower = FOLLOWER.match(text, at)
            if follower:
                if self.names is None:
                    self.names = proper_names(text)
                return not (follower.group() in self.names[0] and follower.group().lower() not in self.names[1])
        return True

    def _german(self, start: int, end: int) -> bool:
        """Are ordinals written with a full stop here? The words around decide, then the language given."""
        if self.near is None:
            near = self.text[start:end].lower()
            own, other = len(GERMAN.findall(near)), len(NOT_GERMAN.findall(near))
            self.near = own > other or (own == other and self.lang == "de")
        return self.near

    def _ordinary(self, word: str, start: int, a: int, end: int) -> bool:
        """Is a full stop followed by a lower-case letter surely a sentence end, as after words that are no abbreviation?"""
        if not word:
            return a > start and self.text[a - 1] in CLOSERS
        if word.replace(".", "").isdigit():
            return "." in word or len(word) > 2 or not self._german(start, end)
        if not word.isalpha() or len(word) < 3 or self._kind(word):
            return False
        low = word.lower()
        return len(word) > 5 or (len(word) > 3 and low[-1] in VOWELS) or self.corpus.get(low) == "W" or self._bare(low) > 0

    def _seen(self, part: str) -> int:
        """How often a string occurs in the document at all, words within words included: an upper bound that often says enough."""
        if not self.lower:
            self.lower = self.text.lower()
        return self.lower.count(part)

    def _bare(self, low: str) -> int:
        """How often this document has a word without a full stop."""
        if self.occurrences is None:
            if self._seen(low) == self._seen(low + "."):
                return 0
            self.occurrences = occurrences(self.text)
        return self.occurrences[low] - self._stops(low)[0]

    def _stops(self, low: str) -> list[int]:
        if self.stops is None:
            self.stops = stops(self.text)
        return self.stops.get(low) or [0, 0, 0, 0]

    def _here(self, low: str, sure: int = 2) -> str:
        """What this document says about a word."""
        if self.stops is None and len(self.kinds) < FEW and self._seen(low + ".") < sure:
            return ""
        _, dotted, goes_on, ends = self._stops(low)
        return judge((self._bare(low), dotted, goes_on, ends), sure) if dotted >= sure else ""

    def _kind(self, word: str) -> str:
        """'T' an abbreviation that never ends a sentence, 'F' one that may, '' none: by the document, else by the corpus,
        and where neither settles it by the list of well-known ones."""
        low = word.lower()
        found = self.kinds.get(low)
        if found is None:
            here = there = ""
            if len(low) <= LONGEST and (low.isalpha() or not any(x.isdigit() for x in low)):
                here, there = self._here(low), self.corpus.get(low, "")
            if not there:
                there = "T" if low in BEFORE_NAMES_AND_NUMBERS else "F" if low in MAY_END else ""
            found = there if here == "F" and there == "T" else here or there  # few occurrences do not show that it never ends a sentence
            self.kinds[low] = found = "" if found == "W" else found
        return found


def corpus_abbreviations(texts: DataFrame, text_col: str = "text", sure: int = 5, most: int = MOST) -> tuple[dict[str, str], DataFrame | None]:
    """Verdicts from the counts over all texts for words seen with a full stop: of all words where there are ``most`` at
    most, else of the most frequent ones, with (word, verdict) of the others as a table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        total: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            words = list(every.keys() | total.keys())
            rows = [(every[w] - r[0], *r[1:]) for w in words for r in (total.get(w, (0, 0, 0, 0)),)]
            arrays = [pa.array(words, pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))]
            every.clear()
            total.clear()
            return pa.RecordBatch.from_arrays(arrays, ["word", "bare", "dotted", "goes_on", "ends"])

        for batch in batches:
            known = [t for t in batch.column(0).to_pylist() if t]
            marked = [bool(MARKED.search(t)) for t in known]
            for kind in (False, True):  # so that few texts with combining marks do not slow down all
                text = "\n\n".join(t for t, m in zip(known, marked) if m is kind)
                every.update(occurrences(text))
                for w, row in stops(text).items():
                    mine = total.setdefault(w, [0, 0, 0, 0])
                    for i in range(4):
                        mine[i] += row[i]
            if len(every) > 200_000:
                yield flush()
        yield flush()

    counted = texts.select(text_col).mapInArrow(count, "word string, bare bigint, dotted bigint, goes_on bigint, ends bigint")
    sums = counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("bare", "dotted", "goes_on", "ends")))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, *rows = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([judge(r, sure) for r in zip(*rows)], pa.string()), batch.column(2)], ["word", "verdict", "dotted"])

    # what is known to be an ordinary word matters for short words only (``Splitter._ordinary``); no verdict says the same of others, but for the list
    listed = F.col("word").isin(*sorted(BEFORE_NAMES_AND_NUMBERS | MAY_END))
    verdicts = cut_lineage(sums.filter(F.col("dotted") >= sure).mapInArrow(judged, "word string, verdict string, dotted bigint").filter((F.col("verdict") != "") & ((F.col("verdict") != "W") | (F.length("word") <= 5) | listed)))
    least = 0
    if (n := verdicts.count()) > most:  # 64 rows: how many words there are for each magnitude of their counts
        sizes = {r[0]: r[1] for r in verdicts.groupBy(F.floor(F.log2("dotted")).alias("m")).count().collect()}
        while n > most:
            n -= sizes.pop(min(sizes))
            least = 1 << min(sizes, default=62)
    known = {r.word: r.verdict for r in verdicts.filter(F.col("dotted") >= least).collect()}
    return known, verdicts.filter(F.col("dotted") < least).select("word", "verdict") if least else None


def with_rare(rows: DataFrame, rare: DataFrame) -> DataFrame:
    """rows (doc_id, text, lang) with words: [(word, verdict)] of the rare words before full stops in the text, or null."""
    key = [F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit("#"), "text").alias("_k2")]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [dotted_words(t or "") for t in batch.column(2).to_pylist()]
            at = pa.array([i for i, ws in enumerate(found) for _ in ws], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([w for ws in found for w in ws], pa.string())], ["_k1", "_k2", "word"])

    used = rows.select(*key, "text").mapInArrow(words, "_k1 bigint, _k2 bigint, word string").join(rare, "word")
    own = used.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("word", "verdict")).alias("words"))
    return rows.select("*", *key).join(own, ["_k1", "_k2"], "left").select("doc_id", "text", "lang", "words")


def sentences(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", most: int = MOST) -> DataFrame:
    """(doc_id, start_char, end_char): one row a sentence; offsets in code points, without surrounding white space.

    - Null, empty and blank texts have no rows; of all others every visible character is in exactly one sentence.
    - Texts are taken whole, and by the same rules whatever their length. A wrong or missing language only weakens the rule for ordinal numbers.
    - Repeated rows give repeated sentences; a null id stays null. An empty table gives no rows.
    - Columns other than those named are not read.
    """
    lang = F.col(lang_col) if lang_col else F.lit(None)
    rows = texts.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), lang.cast("string").alias("lang"))
    corpus, rare = corpus_abbreviations(rows, most=most)
    rows = rows.filter("text is not null")
    rows = rows.withColumn("words", F.lit(None).cast("array<struct<word:string,verdict:string>>")) if rare is None else with_rare(rows, rare)
    shared = rows.sparkSession.sparkContext.broadcast(corpus)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = shared.value
        splitter = Splitter(corpus)
        for batch in batches:
            ids, starts, ends = [], [], []
            for key, text, lang, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                splitter.corpus = ChainMap({w["word"]: w["verdict"] for w in words}, corpus) if words else corpus
                for a, b in splitter.spans(text, lang):
                    ids.append(key)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start_char", "end_char"])

    return rows.mapInArrow(split, "doc_id bigint, start_char bigint, end_char bigint")
