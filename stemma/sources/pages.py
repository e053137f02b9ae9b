"""Recorded result pages: HTML to typed rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stemma.functions import text as T

ITEM = "title string, url string, meta string, snippet string, scholar_id string, raw_html string, cites string, citation_only boolean"
PAGE = f"items array<struct<{ITEM.replace(' string', ':string').replace(' boolean', ':boolean')}>>, header string, has_next boolean, blocked boolean, challenge boolean, no_results boolean"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

# Marks of refusal pages and of the page's own elements.
REFUSAL_PHRASES = ("unusual traffic", "our systems have detected", "please show you're not a robot", "please show you’re not a robot", "detected unusual traffic", "your computer or network may be sending automated queries")
REFUSAL_IDS = frozenset({"captcha-form", "g-recaptcha-response", "captcha", "sorry"})
PAGE_IDS = frozenset({"gs_res_ccl", "gs_hdr_tsi", "gs_asd", "gs_n"})


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: "Node | None" = None
    children: list["Node | str"] = field(default_factory=list)
    start: int = 0
    end: int = 0

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator["Node"]:
        stack: list[Node] = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: str | None = None) -> str:
        parts: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in ("script", "style") and not (skip and skip in x.classes):
                stack.extend(reversed(x.children))
        return "".join(parts)

    def first(self, test: Callable[["Node"], bool]) -> "Node | None":
        return next((n for n in self.walk() if n is not self and test(n)), None)

    def within(self, test: Callable[["Node"], bool]) -> bool:
        node = self.parent
        while node is not None:
            if test(node):
                return True
            node = node.parent
        return False


class Tree(HTMLParser):
    """A tolerant tree of a page; each node knows where in the source it lies."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.lines = [0]
        for m in re.finditer("\n", source):
            self.lines.append(m.end())
        self.root = self.at = Node("", {})
        self.source = source
        self.feed(source)
        self.close()
        while self.at is not self.root:
            self.at.end = len(source)
            self.at = self.at.parent

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, start=self._place())
        self.at.children.append(node)
        if tag in VOID:
            node.end = node.start + len(self.get_starttag_text() or "")
        else:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at.end = self._place() + len(self.get_starttag_text() or "")
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is self.root:
            return
        place = self._place()
        close = self.source.find(">", place) + 1 or len(self.source)
        while self.at is not node:
            self.at.end = place
            self.at = self.at.parent
        node.end, self.at = close, node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def squeeze(s: str) -> str:
    return " ".join(s.split())


def _item(block: Node, source: str) -> dict | None:
    titled = lambda n: "gs_rt" in n.classes
    head = block.first(lambda n: n.tag == "h3" and titled(n)) or block.first(titled)
    if head is None:
        body = block.first(lambda n: "gs_ri" in n.classes)
        head = body.first(lambda n: n.tag == "h3") if body else None
    if head is None:
        return None
    link = head.first(lambda n: n.tag == "a" and not n.within(lambda p: "gs_fl" in p.classes))
    title, url = (squeeze(link.text()), link.attrs.get("href", "")) if link else ("", "")
    only = False
    if not title:
        title, only = squeeze(head.text(skip="gs_ctu")), not url
    if not title:
        return None
    named = lambda c: " ".join(squeeze(n.text()) for n in block.walk() if n.tag == "div" and c in n.classes)
    cites = block.first(lambda n: n.tag == "a" and "cites=" in n.attrs.get("href", ""))
    return {"title": title, "url": url, "meta": named("gs_a"), "snippet": named("gs_rs"), "scholar_id": block.attrs.get("data-cid", ""), "raw_html": source[block.start : block.end], "cites": cites.text() if cites else None, "citation_only": only}


def parse_page(source: str | None) -> dict:
    """The raw facts of one page. A null or empty page has no items and no facts; broken markup never fails."""
    tree = Tree(source or "")
    nodes = list(tree.root.walk())
    ids = {n.attrs["id"]: n for n in reversed(nodes) if "id" in n.attrs}
    blocks = [n for n in nodes if {"gs_r", "gs_or"} <= set(n.classes)]
    pager = ids.get("gs_n")
    forward = [n for n in pager.walk() if n.tag == "a" and "start=" in n.attrs.get("href", "")] if pager else []
    has_next = any(n.first(lambda s: s.tag == "span" and "gs_ico_nav_next" in s.classes) for n in forward)
    challenge = any("g-recaptcha" in n.classes or (n.tag == "iframe" and "recaptcha" in n.attrs.get("src", "")) for n in nodes)
    challenge |= bool(ids.keys() & {"captcha-form", "g-recaptcha-response", "captcha"})
    blocked = any("g-recaptcha" in n.classes for n in nodes) or bool(ids.keys() & REFUSAL_IDS)
    if not blocked and not blocks and not ids.keys() & PAGE_IDS:
        said = tree.root.text().lower()
        blocked = any(p in said for p in REFUSAL_PHRASES)
    header = squeeze(ids["gs_ab_md"].text()) if "gs_ab_md" in ids else None
    items = [x for x in (_item(b, tree.source) for b in blocks) if x]
    return {"items": items, "header": header, "has_next": has_next, "blocked": blocked, "challenge": challenge, "no_results": not blocks and not forward and "gs_ab_md" in ids}


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds page STRUCT (see PAGE) and count to recorded pages; only the markup is read in Python.

    count is the number the header announces; 0 for a page that says it has no results; null if not known.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse_page(x) for x in batch], columns=["items", "header", "has_next", "blocked", "challenge", "no_results"])

    parsed = pages.withColumn("page", F.pandas_udf(run, PAGE)(F.col(html)))
    counted = F.coalesce(T.result_count(F.col("page.header")), F.when(F.col("page.no_results") & ~F.col("page.blocked"), F.lit(0).cast("bigint")))
    return parsed.withColumn("count", counted)


def page_papers(parsed: DataFrame, citations: bool = True) -> DataFrame:
    """One row for each item of parsed pages (task_id, page_number, page): the paper with its key.

    citations: with those that are known from being cited only, without a document of their own?
    """
    flat = parsed.select("task_id", "page_number", F.posexplode("page.items").alias("place", "i"))
    flat = flat if citations else flat.filter(~F.col("i.citation_only"))
    meta = flat.withColumn("m", T.meta_line(T.norm_space(F.col("i.meta"))))
    return meta.select(
        "task_id", "page_number", "place", T.paper_key(F.col("i.title"), F.col("m.year"), F.col("m.authors")).alias("hash"), F.col("i.title").alias("title"), F.col("m.authors").alias("authors"), F.col("m.venue").alias("venue"),
        F.col("m.year").alias("year"), F.col("i.snippet").alias("snippet"), F.coalesce(T.first_number(F.col("i.cites")), F.lit(0)).cast("bigint").alias("citations"), F.col("i.url").alias("source_url"), F.col("i.scholar_id").alias("scholar_id"), F.col("i.raw_html").alias("raw_html"), F.col("i.citation_only").alias("citation_only"),
    )


def replay_links(parsed: DataFrame) -> DataFrame:
    """(hash, task_id) rebuilt from archived pages, each link once."""
    return page_papers(parsed).filter("task_id is not null").select("hash", "task_id").distinct()


def fingerprints(parsed: DataFrame) -> DataFrame:
    """Adds fingerprint: equal for pages that show the same papers in the same order, '' for a page without any."""
    meta = lambda i: T.meta_line(T.norm_space(i["meta"]))
    keys = F.transform("page.items", lambda i: T.paper_key(i["title"], meta(i)["year"], meta(i)["authors"]))
    return parsed.withColumn("fingerprint", F.when(F.coalesce(F.size("page.items"), F.lit(0)) <= 0, "").otherwise(F.sha2(F.array_join(keys, ","), 256)))


def walk_pages(parsed: DataFrame, estimates: DataFrame) -> DataFrame:
    """Parsed pages of whole tasks as input of a walk: (task_id, page_number, fingerprint, items, added, has_next, estimate).

    added: papers that the page is the first of its task to show. estimates: (task_id, estimate); 0 if not known.
    """
    first = page_papers(parsed).groupBy("task_id", "hash").agg(F.min("page_number").alias("page_number"))
    added = first.groupBy("task_id", "page_number").agg(F.count("*").alias("added"))
    marked = fingerprints(parsed).select("task_id", "page_number", "fingerprint", F.size("page.items").alias("items"), F.col("page.has_next").alias("has_next"))
    known = estimates.groupBy("task_id").agg(F.max("estimate").alias("estimate"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return marked.join(added, ["task_id", "page_number"], "left").join(known, "task_id", "left").select("task_id", "page_number", "fingerprint", "items", zero("added"), "has_next", zero("estimate"))


def harvested(parsed: DataFrame) -> DataFrame:
    """Sightings of papers on recorded pages of plan searches (conference_id, query, year_from, year_to, html, page, scraped_at): they have no task."""
    pages = parsed.withColumns({"task_id": F.lit(None).cast("bigint"), "page_number": F.lit(1)})
    rows = page_papers(pages.select("task_id", F.xxhash64("query", "year_from", "year_to").alias("page_number"), "page"))
    venue = pages.select(F.xxhash64("query", "year_from", "year_to").alias("page_number"), "conference_id", "scraped_at").dropDuplicates(["page_number"])
    return rows.join(venue, "page_number").withColumn("sourced_from", F.lit("plan")).withColumn("seq", F.struct("scraped_at", "page_number", "place"))
