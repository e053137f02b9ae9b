"""Configuration: a JSON file with defaults and checks."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Venue:
    name: str
    query: str
    aliases: tuple[str, ...] = ()
    type: str = "conference"


@dataclass(frozen=True)
class Settings:
    """Planning and mining settings. A zero in the file means unset and takes the default."""

    database: str = "stemma_store"
    start_year: int = 2000
    end_year: int = 0
    max_results: int = 1000
    max_keywords: int = 5
    min_balance: float = 0.15
    max_probes: int = 8
    headroom: float = 0.8
    min_papers_to_trust: int = 10
    min_coverage: float = 0.5
    max_probes_per_conf: int = 60
    max_mined_keywords: int = 200
    mine_max_ngram: int = 3
    mine_phrase_boost: float = 1.5
    min_completion_ratio: float = 0.5
    max_side_fraction: float = 0.75
    include_citations: bool = False
    mine_bigrams: bool = False
    keywords: tuple[str, ...] = ()
    conferences: tuple[Venue, ...] = field(default_factory=tuple)

    @property
    def longest_phrase(self) -> int:
        """Words of the longest mined phrase; the older setting asks for two at least."""
        return max(self.mine_max_ngram, 2) if self.mine_bigrams else self.mine_max_ngram

    @property
    def side_fraction(self) -> float:
        """The share of a node that a side may keep, 0.75 where it is unset."""
        return self.max_side_fraction if self.max_side_fraction > 0 else 0.75

    def last_year(self, current: int) -> int:
        return self.end_year or current


def parse(text: str) -> Settings:
    """Settings of a JSON text; unknown keys are ignored, wrong values raise ValueError."""
    raw = json.loads(text)
    venues = []
    for v in raw.get("conferences", []):
        query = f'"{v["name"]}"' if v.get("use_short_name") else v.get("query", "")
        venues.append(Venue(v.get("name", ""), query, tuple(v.get("aliases", ())), v.get("type") or "conference"))
    plain = {f.name: tuple(raw[f.name]) if f.name == "keywords" else raw[f.name] for f in fields(Settings) if f.name != "conferences" and raw.get(f.name)}
    out = replace(Settings(conferences=tuple(venues)), **plain)
    check(out)
    return out


def load(path: str) -> Settings:
    return parse(Path(path).read_text(encoding="utf-8"))


def check(s: Settings) -> None:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"config: {what}")

    need(bool(s.conferences), "name one conference at least")
    seen: set[str] = set()
    for v in s.conferences:
        need(bool(v.name and v.query), "each conference has a name and a query")
        need(v.name not in seen, f"{v.name} is named twice")
        seen.add(v.name)
        need(v.type in ("conference", "journal"), f"{v.name}: type is conference or journal")
        own = {v.query}
        for a in v.aliases:
            need(bool(a.strip()), f"{v.name}: an alias is empty")
            need(a not in own, f"{v.name}: {a} repeats another name")
            own.add(a)
    need(1900 <= s.start_year <= 2100, "start_year is out of range")
    need(s.end_year == 0 or s.start_year <= s.end_year <= 2100, "end_year is out of range")
    for name in ("min_balance", "headroom", "min_coverage", "min_completion_ratio"):
        need(0 < getattr(s, name) <= 1, f"{name} lies in (0, 1]")
    need(0.5 <= s.max_side_fraction < 1, "max_side_fraction lies in [0.5, 1)")
    need(s.max_probes >= 1 and s.max_probes_per_conf >= 1, "probes are 1 at least")
    need(s.max_keywords >= 0 and s.max_mined_keywords >= 0 and s.min_papers_to_trust >= 0, "counts are 0 at least")
    need(s.mine_phrase_boost > 0, "mine_phrase_boost is above 0")
