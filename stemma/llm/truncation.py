"""Text cut off by field limits or in transfer.

A backward character n-gram model compares, for the last characters of each value, how often that context ends a value
with how often a text goes on after it, backing off from long to short contexts. Counts are kept by a 64-bit hash of
language and column, order and context in distributed tables, and the ends of the values are joined to them; the model
is trained on all values. A second round leaves values judged cut out of the counts of ends. Each log-odds is set against the share of cut values among those of the
same language, column, source and length: a field limit shows as a length at which most values are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from stemma.session import cut_lineage

ORDERS = (1, 2, 4, 6, 9, 13, 18)
#: Bits of the filter before the counts for each context that ends a value, and the powers of two its size stays between;
#: a filter too small lets contexts through that the join then drops. Slots in which a task adds up counts, a power of two.
FILTER_BITS, FILTER, SLOTS = 16, (20, 29), 21
#: Keys of more than 1 / HOT of the rows are joined in so many parts.
HOT, PARTS = 1000, 64
#: What the shorter context weighs against the counts of the longer one.
STRENGTH = 12.0
SHORTENED = regex.compile(r"(?:^|\s)(?:…|\.\.\.)$")
DOTS = regex.compile(r"(?:…|\.\.\.)$")
#: A label of keywords, misspelt or not, before text without the end of a sentence; any label and what follows it.
KEYWORDS = regex.compile(r"\s*(?:(?:authors?'? )?(?:key ?-?words){e<=2}(?: and phrases)?|index terms|mots[- ]clés|schlüsselwörter|schlagwörter|palabras clave|ключевые слова|关键词|關鍵詞|キーワード)\s?[:：][^.!?。]*$", regex.IGNORECASE)
LABELLED = regex.compile(r"\s*\p{L}[\p{L} ]{2,20}[:：]\s([^.!?。]*)$")
COMMA = regex.compile(r"[,;，；、،]")
#: Terms of a list, at least, and words of a term, at most.
TERMS, WORDS = 3, 3
DANGLING = regex.compile(r"(?:[(\[{«„“,/&\-–—]|&#?x?[0-9a-zA-Z]{0,8}|</?[a-zA-Z]{0,8}|�)+$")
DIGITS = regex.compile(r"\p{N}")
# Function words that tell Latin-script languages apart.
FUNCTION_WORDS = {
    "en": frozenset("the of and for with in on to by is are from we".split()),
    "fr": frozenset("le la les des du une et pour dans est nous sur que sont".split()),
    "de": frozenset("der die das und für ein eine wird mit von zur den im auf".split()),
    "es": frozenset("el los las del una y para con en que por como sigue siendo".split()),
}
SCRIPTS = (("zh", regex.compile(r"\p{Han}"), 3), ("ru", regex.compile(r"\p{Cyrillic}"), 1), ("xx", regex.compile(r"[\p{Arabic}\p{Thai}\p{Hangul}\p{Devanagari}\p{Greek}\p{Hiragana}\p{Katakana}]"), 1))
#: Characters at the end of a value that tell the language it ends in, which is what is judged.
SAMPLE = 400


def language(text: str) -> str:
    """The language in which a lower-case text ends, which is what is judged: by script, and by function words for Latin script."""
    tail = text[-SAMPLE:]
    if not tail.isascii():
        for name, script, weight in SCRIPTS:
            if len(script.findall(tail)) * weight * 3 > len(tail):
                return name
    found = set(tail.split())
    best = max(FUNCTION_WORDS, key=lambda k: len(found & FUNCTION_WORDS[k]))
    return best if found & FUNCTION_WORDS[best] else "en"


def keyword_list(text: str) -> bool:
    """Is it a list of keywords: under a label of keywords, or short terms between commas under any label?"""
    if KEYWORDS.match(text):
        return True
    found = LABELLED.match(text)
    terms = [t.casefold().split() for t in COMMA.split(found[1])] if found else []
    return len(terms) >= TERMS and all(0 < len(t) <= WORDS and not any(w in words for w in t for words in FUNCTION_WORDS.values()) for t in terms)


def prepare(text: str | None, field: str) -> tuple[str, bool] | None:
    """(text as the model sees it, dangling); None for values that are not judged.

    Not judged: null and blank values, values shortened by the index (a blank and an ellipsis), lists of keywords other
    than titles ("Name: a method, a bound" is a title like any other).
    """
    t = text.rstrip() if text else ""
    end = t[-24:]
    if not t or (end[-1] in "…." and SHORTENED.search(end)) or field != "title" and (":" in t[:32] or "：" in t[:32]) and keyword_list(t):
        return None
    between = " " if t[-1].isalnum() and text[len(t) :] == " " else ""  # cut between words; more white space is layout
    if end[-1] in "….":
        t = DOTS.sub("", t)
        end = t[-24:]
    stem = t[: len(t) - len(end)] + DANGLING.sub("", end)
    if len(stem) != len(t) and len(stem := stem.rstrip()) > 3:
        return DIGITS.sub("0", stem).casefold(), True
    return (DIGITS.sub("0", t).casefold() + between, False) if t else None


@lru_cache(maxsize=None)
def _salt(stratum: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh64_intdigest(stratum))


def contexts(texts: list[str], strata: list[str], ends_only: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, owner) for each order: of the contexts that end a text, or of all those after which it goes on."""
    longest = max(ORDERS)
    texts = ["\x02" + t[-longest:] if ends_only else "\x02" + t for t in texts]
    lengths = np.array([len(t) for t in texts])
    x = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths) - 1
    names, which = np.unique(np.array(strata), return_inverse=True)
    x += np.repeat(np.array([_salt(n) for n in names], dtype=np.uint64)[which], lengths)  # the same letters differ by stratum
    _mix(x)
    if not ends_only:
        place = np.arange(len(x), dtype=np.int32) - np.repeat((ends - lengths + 1).astype(np.int32), lengths)
        place[ends] = -1
    h, last = x.copy(), np.empty_like(x)
    for k in range(1, longest + 1):
        if k > 1:
            h, last = last, h
            np.multiply(last[:-1], MULTIPLIER, out=h[1:])
            h[0] = 0
            h += x
        if k in ORDERS:
            least = max(1, k - 1)
            owner = np.flatnonzero(lengths > least) if ends_only else np.flatnonzero(place >= least)
            key = h[ends[owner] if ends_only else owner]
            key += np.uint64(k)
            _mix(key)
            yield key.view(np.int64), owner


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> None:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)


#: A length at which so many texts end as SPIKE times its neighbours' mean (and LEAST at least) may be a field limit.
SPIKE, LEAST, AROUND = 4, 8, 5


def values(rows: DataFrame, id_col: str, columns: tuple[str, ...], source: str, group: str | None) -> DataFrame:
    """(id, source, grp, field, value): one row for each value that is not null; grp: key of its record and text."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("v")
    record = F.col(group or id_col).cast("string").alias("record")
    flat = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(source).cast("string").alias("source"), record, each).filter("v.value is not null")
    return flat.select("id", "source", F.xxhash64("record", "v.field", "v.value").alias("grp"), "v.field", "v.value")


def _sizes(length: Column, octets: Column) -> Column:
    """A size in characters, and one in bytes where it differs: limits come in either unit."""
    unit = lambda u, c: F.struct(F.lit(u).alias("unit"), c.cast("long").alias("size"))
    return F.explode(F.when(length == octets, F.array(unit("c", length))).otherwise(F.array(unit("c", length), unit("b", octets)))).alias("s")


def field_limits(vals: DataFrame) -> DataFrame:
    """(field, unit, size) at which, for some source, far more different texts end than at the sizes around."""
    sized = vals.select("source", "field", F.xxhash64("value").alias("t"), _sizes(F.length("value"), F.octet_length("value"))).select("source", "field", "t", "s.unit", "s.size")
    cells = sized.distinct().groupBy("source", "field", "unit", "size").agg(F.count("*").alias("n"))
    near = cells.select("source", "field", "unit", F.explode(F.array(*(F.col("size") + i for i in range(-AROUND, AROUND + 1) if i))).alias("size"), "n")
    mean = near.groupBy("source", "field", "unit", "size").agg((F.sum("n") / (2 * AROUND)).alias("mean"))
    a, b = cells.alias("a"), mean.alias("b")
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    for c in ("field", "unit", "size"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    both = a.join(b, same, "left")
    return both.filter(F.col("n") >= F.greatest(F.lit(LEAST), SPIKE * F.coalesce("mean", F.lit(0.0)))).select("a.field", "a.unit", "a.size").distinct()


def _at_limit(vals: DataFrame, limits: DataFrame) -> DataFrame:
    """vals with limit: does the value's size look like a limit of its field?"""
    one = lambda unit, name: F.broadcast(limits.filter(F.col("unit") == unit).select("field", F.col("size").alias(name), F.lit(True).alias(f"_{unit}")))  # noqa: E731  # a few sizes
    sized = vals.withColumns({"_length": F.length("value").cast("long"), "_octets": F.octet_length("value").cast("long")})
    hit = sized.join(one("c", "_length"), ["field", "_length"], "left").join(one("b", "_octets"), ["field", "_octets"], "left")
    return hit.select("id", "source", "grp", "field", "value", (F.col("_c").isNotNull() | (F.col("_b").isNotNull() & (F.col("_octets") != F.col("_length")))).alias("limit"))


def _usable(batch: pa.RecordBatch, text_at: int, field_at: int) -> tuple[list[int], list[str], list[str], list[bool]]:
    rows, texts, strata, dangling = [], [], [], []
    for i, (value, field) in enumerate(zip(batch.column(text_at).to_pylist(), batch.column(field_at).to_pylist())):
        found = prepare(value, field)
        if found:
            rows.append(i)
            texts.append(found[0])
            strata.append(f"{field}/{language(found[0])}")
            dangling.append(found[1])
    return rows, texts, strata, dangling


def prepared(vals: DataFrame) -> DataFrame:
    """(text, stratum, limit): the judged values as the model sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, strata, _ = _usable(batch, 0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(strata, pa.string()), batch.column(2).take(pa.array(rows, pa.int64()))], ["text", "stratum", "limit"])

    return vals.select("value", "field", "limit").mapInArrow(run, "text string, stratum string, limit boolean")


def _pieces(texts: list[str], most: int = 500_000) -> Iterator[slice]:
    """Slices of at most so many characters, but for a single longer text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _look_up(rows: DataFrame, found: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """rows joined to found, which has a row for each key and how many of total rows have it; those of hot keys are dealt out by ``by``."""
    hot = F.col("n_rows") > max(1, total / HOT)
    parts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))).alias("_part")
    dealt = rows.join(F.broadcast(found.filter(hot).select(key, F.lit(True).alias("_hot"))), key, "left")  # HOT keys an order at most
    dealt = dealt.withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(PARTS))).otherwise(0).cast("int"))
    return dealt.join(found.select("*", parts), [key, "_part"]).drop("_part", "_hot", "n_rows")


def _end_contexts(ends: DataFrame) -> DataFrame:
    """(end, stratum, n, order, k): the contexts of each end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for order, (key, owner) in zip(ORDERS, contexts(batch.column(3).to_pylist(), batch.column(1).to_pylist(), ends_only=True)):
                end, stratum, n = (batch.column(i).take(pa.array(owner)) for i in range(3))
                yield pa.RecordBatch.from_arrays([end, stratum, n, pa.array(np.full(len(owner), order, np.int32)), pa.array(key)], ["end", "stratum", "n", "order", "k"])

    return ends.select("end", "stratum", "n", "tail").mapInArrow(run, "end bigint, stratum string, n bigint, order int, k bigint")


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """Bits that are set for the first bits of the n keys; the driver holds 2 ** FILTER[1] of them at most."""
    width = min(max((FILTER_BITS * n).bit_length(), FILTER[0]), FILTER[1])
    place = F.shiftrightunsigned("k", 64 - width) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros(1 << width - 3, dtype=np.uint8)
    for r in maps.toLocalIterator():
        bits[(r["at"] - 1) * len(r["bits"]) :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _continuations(once: DataFrame, bits: np.ndarray) -> DataFrame:
    """(k, c): how often a text goes on after a context, for all contexts that end some value, and for others that pass the filter."""
    shared = once.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        shift = np.uint64(64 - (len(bits).bit_length() + 2))
        held, sums = np.zeros(1 << SLOTS, dtype=np.int64), np.zeros(1 << SLOTS, dtype=np.int64)  # each slot counts the first key that comes
        rest, size = [], 0
        pair = lambda keys, n: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["k", "c"])
        for batch in batches:
            texts, strata = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in _pieces(texts):
                counted = []
                for key, _ in contexts(texts[s], strata[s], ends_only=False):
                    at = key.view(np.uint64) >> shift
                    key = key[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    slot = (key.view(np.uint64) >> np.uint64(64 - SLOTS)).astype(np.int64)
                    new = np.flatnonzero(held[slot] == 0)
                    held[slot[new]] = key[new]
                    same = held[slot] == key
                    counted.append(slot[same])
                    rest.append(key[~same])
                    size += len(rest[-1])
                sums += np.bincount(np.concatenate(counted), minlength=len(sums))
                if size > 1 << SLOTS:
                    yield pair(*np.unique(np.concatenate(rest), return_counts=True))
                    rest, size = [], 0
        used = np.flatnonzero(sums)
        yield pair(held[used], sums[used])
        if size:
            yield pair(*np.unique(np.concatenate(rest), return_counts=True))

    return once.select("text", "stratum").mapInArrow(count, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c"))


def _odds(counted: Column) -> Column:
    """log(P(context | goes on) / P(context | ends)) of an end from its steps (order, k, c, e); counted: its own share of e."""
    weight = F.lit(STRENGTH) / F.col("all_on")

    def back_off(share: Column, s: Column) -> Column:
        e, c = F.greatest(s["e"] - counted, F.lit(0)) / F.col("all_ends"), s["c"] / F.col("all_on")
        return (e + weight * share) / (e + c + weight)

    share = F.greatest(F.least(F.aggregate("steps", F.lit(0.5), back_off), F.lit(1 - 1e-9)), F.lit(1e-9))  # 0.5: were both as frequent
    return F.log1p(-share) - F.log(share)


def train(once: DataFrame) -> tuple[DataFrame, int]:
    """(end, free, limited, n_rows) with the log-odds of every end of a value, away from a field limit and at one, and the
    number of values. once: the rows of ``prepared``, each text of a record once.

    In counts of ends, those at a field limit count 0, and in the second round those that the first judged cut.
    """
    tail = F.right("text", F.lit(max(ORDERS))).alias("tail")
    ends = once.groupBy("stratum", tail).agg(F.sum(F.when(F.col("limit"), 0).otherwise(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("n_rows"))
    ends = cut_lineage(ends.withColumn("end", F.xxhash64("stratum", "tail")))
    n_ends, n_values = ends.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    each = cut_lineage(_end_contexts(ends))
    wanted = each.groupBy("k").agg(F.sum("n").alias("e"), F.count("*").alias("n_rows"))
    bits = _filter(wanted.select("k"), wanted.count())
    counts = wanted.join(_continuations(once, bits), "k", "left").select("k", "e", F.coalesce("c", F.lit(0)).alias("c"), "n_rows")
    steps = F.sort_array(F.collect_list(F.struct("order", "k", "c", "e"))).alias("steps")  # one an order
    least = lambda c: F.greatest(F.sum(c), F.lit(1)).cast("double")
    totals = F.broadcast(ends.groupBy("stratum").agg(least("n").alias("all_ends"), least("chars").alias("all_on")))  # languages and columns
    first = _look_up(each, cut_lineage(counts), "k", "end", n_ends).groupBy("end", "stratum", "n").agg(steps).join(totals, "stratum")
    first = cut_lineage(first.withColumn("whole", _odds(F.lit(1)) < 1).withColumn("kept", F.when(F.col("whole"), F.col("n")).otherwise(0)))
    again = first.select("end", "stratum", "whole", "kept", F.explode("steps").alias("s")).select("end", "stratum", "whole", "kept", "s.order", "s.k", "s.c")
    ends_again = cut_lineage(again.groupBy("k").agg(F.sum("kept").alias("e"), F.count("*").alias("n_rows")))
    totals = F.broadcast(first.groupBy("stratum").agg(least("kept").alias("all_ends"), F.max("all_on").alias("all_on")))
    second = _look_up(again, ends_again, "k", "end", n_ends).groupBy("end", "stratum", "whole").agg(steps).join(totals, "stratum")
    odds = second.select("end", _odds(F.col("whole").cast("int")).alias("free"), _odds(F.lit(0)).alias("limited"))
    return cut_lineage(odds.join(ends.select("end", "n_rows"), "end")), n_values


def log_odds(vals: DataFrame, ends: DataFrame, n_values: int) -> DataFrame:
    """(id, source, field, lang, length, octets, odds) of every value that is judged. ends, n_values: from ``train``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            rows, texts, strata, dangling = _usable(batch, 3, 2)
            if not rows:
                continue
            at = pa.array(rows)
            one, source, field, original, limit = (c.take(at) for c in batch.columns)
            sign = np.where(dangling, DANGLES, [-TERMINATED if TERMINATOR.search(t) else 0.0 for t in texts])
            tails = pa.array([t[-max(ORDERS) :] for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(
                [one, source, field, pa.array([s.split("/")[1] for s in strata], pa.string()), pc.utf8_length(original).cast(pa.int64()), pc.binary_length(original).cast(pa.int64()), limit, pa.array(strata, pa.string()), tails, pa.array(sign, pa.float64())],
                ["id", "source", "field", "lang", "length", "octets", "limit", "stratum", "tail", "sign"],
            )

    judged = vals.select("id", "source", "field", "value", "limit").mapInArrow(read, "id bigint, source string, field string, lang string, length bigint, octets bigint, limit boolean, stratum string, tail string, sign double")
    judged = judged.withColumn("end", F.xxhash64("stratum", "tail")).drop("stratum", "tail")
    odds = F.when(F.col("limit"), F.col("limited")).otherwise(F.col("free")) + F.col("sign")
    return _look_up(judged, ends, "end", "id", n_values).select("id", "source", "field", "lang", "length", "octets", odds.alias("odds"))


#: Log-odds that a terminator at the end takes away: rare last words say little against it.
TERMINATED = 3.0
TERMINATOR = regex.compile(r"[.!?。！？।؟…][)\]\"'”»）」]*$")
#: Log-odds that an end such as an opening bracket, a comma or half a character adds.
DANGLES = 9.0


def _share(trust: float, rounds: int = 6) -> Column:
    """The share of cut values of a length, by expectation-maximisation over its log-odds, drawn towards ``base``."""
    start = F.lit(0.5)
    weigh = lambda odds: lambda acc, x: acc + x["n"] / (1 + F.exp(-(x["step"] + odds)))

    def once(share: Column) -> Column:
        odds = F.log(share / (1 - share))
        return (F.aggregate("steps", F.lit(0.0), weigh(odds)) + trust * F.col("base")) / (F.col("n") + trust)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda share, _: once(share))


def truncated(rows: DataFrame, id_col: str = "seq", columns: tuple[str, ...] = ("title", "snippet"), source: str = "sourced_from", group: str | None = "hash", threshold: float = 1.0, trust: float = 8.0) -> DataFrame:
    """(id, source, field, lang, length, odds, posterior, cut) of every judged value; cut: its end was broken off.

    posterior = odds of its end + log-odds of the share of values judged cut among those of the same source, field and
    size in characters or in bytes, whichever is larger, drawn by ``trust`` values towards the share in the source, field and language. cut: posterior > threshold.

    - Null, empty and blank values, values shortened by the index itself (a blank and an ellipsis at the end) and
      lists of keywords other than titles are not judged and have no row.
    - Repeated rows are judged each; equal values of one record (column ``group``, else the row) teach the model once,
      and values whose length may be a field limit teach it only how texts go on. A null source is a source of its own.
    - Values are read whole. An empty table gives no rows. Other columns are not read.
    """
    vals = values(rows, id_col, columns, source, group)
    vals = _at_limit(vals, cut_lineage(field_limits(vals)))
    once = cut_lineage(prepared(vals.select("grp", "field", "value", "limit").dropDuplicates(["grp"])))
    scored = cut_lineage(log_odds(vals, *train(once)).withColumn("src", F.coalesce("source", F.lit("\0"))))
    step = F.round(F.least(F.greatest("odds", F.lit(-12.0)), F.lit(12.0)))
    keys = ["src", "field", "lang", "length", "octets"]
    cells = scored.groupBy(*keys, step.alias("step")).agg(F.count("*").alias("n"))
    base = cells.groupBy("src", "field", "lang").agg(((F.sum(F.when(F.col("step") > threshold, F.col("n")).otherwise(0)) + 1) / (F.sum("n") + 20)).alias("base"))
    sized = cells.select("src", "field", "step", "n", _sizes(F.col("length"), F.col("octets"))).select("src", "field", "s.unit", "s.size", "step", "n")
    steps = sized.groupBy("src", "field", "unit", "size", "step").agg(F.sum("n").alias("n"))
    spikes = steps.groupBy("src", "field", "unit", "size").agg(F.collect_list(F.struct("step", "n")).alias("steps"), F.sum("n").alias("n"))  # 25 steps at most
    prior = cells.select(*keys, _sizes(F.col("length"), F.col("octets"))).distinct().select(*keys, "s.unit", "s.size")
    prior = prior.join(base, ["src", "field", "lang"]).join(spikes, ["src", "field", "unit", "size"]).groupBy(*keys).agg(F.max(_share(trust)).alias("prior"))
    prior = prior.select(*keys, F.log(F.col("prior") / (1 - F.col("prior"))).alias("prior"))
    posterior = F.col("odds") + F.col("prior")
    return scored.join(prior, keys).select("id", "source", "field", "lang", "length", "odds", posterior.alias("posterior"), (posterior > threshold).alias("cut"))


def truncation_rates(judged: DataFrame, rows: DataFrame, columns: tuple[str, ...] = ("title", "snippet"), source: str = "sourced_from") -> DataFrame:
    """(source, field, n_values, n_cut, share_cut): how often each source truncates each field; blank values do not count."""
    whole = values(rows.withColumn("_id", F.lit(0)), "_id", columns, source, None).filter("value rlike '(?U)\\\\S'").groupBy("source", "field").agg(F.count("*").alias("n_values"))
    cut = judged.filter("cut").groupBy("source", "field").agg(F.count("*").alias("n_cut"))
    both = whole.alias("w").join(cut.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")) & (F.col("w.field") == F.col("c.field")), "left")
    n_cut = F.coalesce("n_cut", F.lit(0).cast("long"))
    return both.select("w.source", "w.field", "n_values", n_cut.alias("n_cut"), F.round(n_cut / F.col("n_values"), 6).alias("share_cut"))
