"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over all runs of SEED tokens of the normalised passages scans each document once; hits carry
token offsets that map back to the original text. Runs of hits on one diagonal are verbatim leaks. For altered
sentences, a sentence of n tokens with at most k edits keeps at least n - q + 1 - q * k of its seeds of q tokens. With
SEED for q that may be none in a short sentence; such a sentence has seeds of n // (k + 1) tokens of its own, of which
one is left. So the count of seeds loses no sentence of enough tokens; what passes is aligned by edit distance.

Tokens are spelt in a few symbols each, another set for each place, so that the automaton has few nodes and branches.
A question is no part of a passage: the task asks for passages, and questions of the same form are asked of many.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from stemma.llm.sentences import Splitter
from stemma.session import cut_lineage

SEED = 4
#: Tokens of the passages of one automaton (about 0.4 GB at most in each Python worker); more are scanned in several blocks.
BLOCK_TOKENS = 1_000_000
#: Tokens of the shortest sentence that leaks by itself; Han: of single characters.
LEAST_WORDS, LEAST_CHARS = 5, 10
#: Symbols of an alphabet in which tokens are spelt.
BASE = 64
TOKEN = regex.compile(r"\p{Han}|(?:(?!\p{Han})[\p{L}\p{N}\p{M}]\p{Cf}*)+")
INVISIBLE = regex.compile(r"\p{Cf}+")


ASCII_TOKEN = re.compile(r"[a-z0-9]+")


def tokens(text: str) -> list[str]:
    """Words (Han: single characters) without regard to case, punctuation, layout and invisible characters."""
    if text.isascii():
        return ASCII_TOKEN.findall(text.lower())
    normal = unicodedata.normalize
    return [w if w.isascii() else normal("NFKC", INVISIBLE.sub("", w)) for w in TOKEN.findall(text.casefold())]


def token_offsets(text: str) -> list[tuple[int, int]]:
    """Where in the original text the tokens lie."""
    return [m.span() for m in (ASCII_TOKEN.finditer(text.lower()) if text.isascii() else TOKEN.finditer(text))]


@dataclass(frozen=True)
class Passage:
    """Normalised passage of one or more items. sentences: token ranges; han: measured in characters."""

    items: tuple[int, ...]
    words: tuple[str, ...]
    sentences: tuple[tuple[int, int], ...]
    han: bool


def item_sentences(text: str, splitter: Splitter) -> list[tuple[str, ...]]:
    return [tuple(tokens(line[a:b])) for line in text.splitlines() for a, b in splitter.spans(line) if not line[a:b].rstrip("\"'”»」』)").endswith(("?", "？", "؟"))]


def split_items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, parts ARRAY<STRING>): the sentences of each item but for questions, as tokens with blanks between."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            parts = [[" ".join(s) for s in item_sentences(t, splitter) if s] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], ["item", "parts"])

    return items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text")).dropna().mapInArrow(split, "item bigint, parts array<string>")


def instructions(split: DataFrame, least: int) -> set[str]:
    """Sentences that lead in or close ``least`` different passages; there are at most (sentences) / least of them.

    A sentence with so many different neighbours is a candidate. It is an instruction if its items without any candidate
    still have so many different texts; a passage that many items share, under whatever instructions, has not.
    """
    none = F.array(F.lit(""))
    texts = split.select("parts").distinct().withColumn("text", F.xxhash64(F.array_join("parts", "\x1f")))
    before, after = F.concat(none, F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0)))), F.concat(F.slice("parts", 2, F.size("parts")), none)
    each = cut_lineage(texts.select("text", F.posexplode(F.arrays_zip(F.col("parts").alias("s"), before.alias("b"), after.alias("a"))).alias("pos", "x")).select("text", "pos", "x.s", "x.b", "x.a"))
    near_ = each.groupBy("s").agg(F.countDistinct("b").alias("b"), F.countDistinct("a").alias("a"))
    found = cut_lineage(near_.filter(F.greatest("b", "a") >= least).select("s"))
    if found.isEmpty():
        return set()
    rest = each.join(found, "s", "left_anti").groupBy("text").agg(F.sort_array(F.collect_list(F.struct("pos", "s")))["s"].alias("rest"))
    led = each.join(found, "s").select("s", "text").join(rest, "text").groupBy("s").agg(F.countDistinct("rest").alias("n"))
    return {r.s for r in led.filter(F.col("n") >= least).select("s").collect()}


def passages(rows: list[tuple[int, list[str]]], left_out: set[str]) -> list[Passage]:
    """The passages of items (item, parts): their sentences without instructions. Equal ones are one."""
    found: dict[tuple, list[int]] = defaultdict(list)
    for item, parts in rows:
        if kept := tuple(tuple(s.split(" ")) for s in parts if s not in left_out):
            found[kept].append(item)
    out = []
    for parts, ids in found.items():
        at, ranges = 0, []
        for s in parts:
            ranges.append((at, at + len(s)))
            at += len(s)
        words = tuple(w for s in parts for w in s)
        out.append(Passage(tuple(sorted(set(ids))), words, tuple(ranges), sum(len(w) == 1 and "⺀" <= w for w in words) * 2 > len(words)))
    return out


def near(pattern: tuple[str, ...], text: list[str], most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of pattern in text by edit distance over words, None beyond ``most``."""
    row = [(j, 0) for j in range(len(pattern) + 1)]
    best: tuple[int, int, int] | None = None
    for i, w in enumerate(text, 1):
        last, row = row, [(0, i)]
        for j, p in enumerate(pattern, 1):
            row.append(min((last[j - 1][0] + (w != p), last[j - 1][1]), (last[j][0] + 1, last[j][1]), (row[j - 1][0] + 1, row[j - 1][1])))
        edits, start = row[-1]
        if edits <= most and (best is None or edits < best[0]):
            best = (edits, start, i)
    return best


class Scanner:
    """The automaton of a block of passages."""

    def __init__(self, found: list[Passage], run_words: int, run_chars: int, edit_share: float):
        import ahocorasick

        self.passages, self.run_words, self.run_chars, self.edit_share = found, run_words, run_chars, edit_share
        known = sorted({w for x in found for w in x.words})
        self.width = 1
        while BASE**self.width < len(known):
            self.width += 1
        spell = lambda n: "".join(chr(0x100 + BASE * k + n // BASE**k % BASE) for k in range(self.width))
        self.code = {w: spell(n) for n, w in enumerate(known)}
        self.unknown = "\0" * self.width
        self.size = [self._run_seed(x) for x in found]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for p, passage in enumerate(found):
            spelt = [self.code[w] for w in passage.words]
            spans = {(0, len(spelt), self.size[p])} | {(a, b, self._seed(b - a)) for a, b in passage.sentences if self._counts(passage, b - a)}
            covered = {n: {i for a, b, q in spans if q == n for i in range(a, b - n + 1)} for n in {q for _, _, q in spans}}
            for n, starts in covered.items():
                for i in starts:
                    places["".join(spelt[i : i + n])].append((p, i))
        self.automaton = ahocorasick.Automaton()
        for seed, where in places.items():
            self.automaton.add_word(seed, (len(seed) // self.width, where))
        self.automaton.make_automaton()

    def _run_seed(self, passage: Passage) -> int:
        """Tokens of the seeds for verbatim runs: SEED, or fewer if fewer tokens may be a run (a Han passage with long words)."""
        least, sizes = SEED, [len(w) for w in passage.words]
        while least > 1 and (least > self.run_words if not passage.han else any(sum(sizes[i : i + least - 1]) >= self.run_chars for i in range(len(sizes)))):
            least -= 1
        return least

    def _counts(self, passage: Passage, n: int) -> bool:
        return n >= (LEAST_CHARS if passage.han else LEAST_WORDS)

    def _edits(self, n: int) -> int:
        """About one word in so many: to the nearest whole number."""
        return int(n * self.edit_share + 0.5)

    def _seed(self, n: int) -> int:
        """Tokens of the seeds of a sentence of n tokens: SEED, or fewer if permitted edits may leave none of those whole."""
        most = self._edits(n)
        return SEED if n - SEED + 1 - SEED * most > 0 else max(1, min(SEED, n // (most + 1)))

    def scan(self, text: str) -> Iterator[tuple[int, str, int, int]]:
        """(passage, kind, start_char, end_char) of each passage that leaks into the text, once each."""
        if not self.passages:
            return
        words = tokens(text)
        get, unknown, width = self.code.get, self.unknown, self.width
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter("".join([get(w, unknown) for w in words])):
            first = (end + 1) // width - size
            for p, i in where:
                hits[p].append((first, i, size))
        offsets: list[tuple[int, int]] = []
        for p, pairs in hits.items():
            found = self._verbatim(p, pairs) or self._altered(p, pairs, words)
            if found:
                offsets = offsets or token_offsets(text)
                yield p, found[0], offsets[found[1]][0], offsets[found[2] - 1][1]

    def _verbatim(self, p: int, pairs: list[tuple[int, int, int]]) -> tuple[str, int, int] | None:
        passage, size = self.passages[p], self.size[p]
        lines: dict[int, list[int]] = defaultdict(list)
        for at, i, n in pairs:
            if n == size:
                lines[at - i].append(i)
        for diagonal, places in lines.items():
            places.sort()
            begin = before = places[0]
            for i in [*places[1:], -1]:
                if i == before + 1:
                    before = i
                    continue
                a, b = begin, before + size
                if (sum(map(len, passage.words[a:b])) >= self.run_chars) if passage.han else (b - a >= self.run_words):
                    return "verbatim", diagonal + a, diagonal + b
                begin = before = i
        return None

    def _altered(self, p: int, pairs: list[tuple[int, int, int]], words: list[str]) -> tuple[str, int, int] | None:
        passage = self.passages[p]
        for a, b in passage.sentences:
            n = b - a
            if not self._counts(passage, n):
                continue
            size, most = self._seed(n), self._edits(n)
            inside = sorted((at - i + a, i) for at, i, q in pairs if q == size and a <= i and i + size <= b)
            need = max(1, n - size + 1 - size * most)
            if len({i for _, i in inside}) < need:
                continue
            at = 0
            while at < len(inside):  # hits whose diagonals lie within the edits of each other share a window
                low = high = inside[at][0]
                seen = set()
                while at < len(inside) and inside[at][0] - high <= most:
                    high = inside[at][0]
                    seen.add(inside[at][1])
                    at += 1
                if len(seen) < need:
                    continue
                start = max(0, low - most)
                best = near(passage.words[a:b], words[start : high + n + most], most)
                if best:
                    return "altered", start + best[1], start + best[2]
        return None


#: The scanner that this Python worker made last, by the key of its passages.
_made: dict[str, Scanner] = {}


def leaks(
    texts: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    run_words: int = 14,
    run_chars: int = 25,
    edit_share: float = 1 / 6,
    instruction_passages: int = 5,
) -> DataFrame:
    """(doc_id, item_id, kind, start_char, end_char): each document with each item it leaks, and where first.

    A document leaks an item if it holds run_words words in a row of the item's passage (Han: run_chars characters) or a
    whole sentence of it, of LEAST_WORDS words (Han: LEAST_CHARS characters) or more, with at most edit_share of its
    words, to the nearest whole number, changed, added or dropped. Shorter sentences leak as part of a run only. A
    sentence that leads in or closes instruction_passages different passages is an instruction and no passage; neither
    are questions. Letter case, punctuation, white space and invisible characters do not matter.

    - Null and empty documents leak nothing; items without id, text or passage are never leaked.
    - Items with the same passage all come out, however many. Repeated documents each come out; a repeated item counts once.
    - Texts are scanned whole. Empty tables give no rows. Other columns are not read.

    Passages are sent to each worker, which builds their automaton once. Test sets beyond BLOCK_TOKENS tokens come in
    blocks by hash, each with a scan of its own; the result is the same.
    """
    split = cut_lineage(split_items(items, item_id, item_text))
    left_out = instructions(split, instruction_passages)
    size: Column = F.coalesce(F.sum(F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, s: n + F.size(F.split(s, " ")))), F.lit(0))
    count = max(1, -(-split.agg(size).first()[0] // BLOCK_TOKENS))
    rows = texts.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for k in range(count):
        block = split.filter(F.pmod(F.xxhash64(F.array_join("parts", "\x1f")), F.lit(count)) == k) if count > 1 else split
        known, name = rows.sparkSession.sparkContext.broadcast(passages([tuple(r) for r in block.collect()], left_out)), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], known=known, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _made:
                _made.clear()
                _made[name] = Scanner(known.value, run_words, run_chars, edit_share)
            scanner = _made[name]
            for batch in batches:
                cols: list[list] = [[], [], [], [], []]
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for p, kind, a, b in scanner.scan(text):
                        for item in scanner.passages[p].items:
                            for c, x in zip(cols, (key, item, kind, a, b)):
                                c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "kind", "start_char", "end_char"])

        part = rows.mapInArrow(scan, "doc_id bigint, item_id bigint, kind string, start_char bigint, end_char bigint")
        out = part if out is None else out.unionByName(part)
    return out
