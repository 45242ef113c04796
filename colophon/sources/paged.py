"""Paged searches, politeness and configuration: what surrounds the engine's queries.

A search is a row (source, query, strategy); ``load`` answers a request for one of its pages, from captured files or from
the network, and searches are read in parallel, their pages in order.
"""

from __future__ import annotations

import json
import time
import tomllib
import urllib.robotparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import search_filter
from .readers import ITEM, WORK

PER_PAGE, ROWS, TASKS = 200, 100, 64


def numbered(load: Callable[[int], dict], per_page: int = PER_PAGE) -> Iterator[list[dict]]:
    """Results page by page, until a page is empty or the pages reach the count that the answer states."""
    page = 1
    while True:
        answer = load(page) or {}
        results = answer.get("results") or []
        if not results:
            return
        yield results
        if page * per_page >= (answer.get("meta") or {}).get("count", 0):
            return
        page += 1


def cursored(load: Callable[[str], dict]) -> Iterator[list[dict]]:
    """Items cursor by cursor, until there are none or the cursor stands still."""
    cursor = "*"
    while True:
        message = (load(cursor) or {}).get("message") or {}
        items = message.get("items") or []
        if not items:
            return
        yield items
        following = message.get("next-cursor")
        if not following or following == cursor:
            return
        cursor = following


def searches(sources: DataFrame, queries: list[str], strategies: list[str], year: int | None) -> DataFrame:
    """A row for every search of works: sources with an id, queries, strategies, with the filter that it is asked with."""
    rows = sources.where("openalex_source_id <> ''").select("slug", "openalex_source_id", F.explode(F.array(*map(F.lit, queries))).alias("query"))
    rows = rows.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    asked = search_filter(F.col("openalex_source_id"), F.col("strategy"), F.col("query"), F.lit(year).cast("int"))
    return rows.withColumn("filter", asked).withColumn("search", F.when(F.col("strategy") == "search", F.col("query")))


def scanned(asked: DataFrame, load: Callable[[dict, object], dict], kind: str = "works") -> DataFrame:
    """(the search's columns, page, position, record) of every result; ``load`` gets the search as a dict and a page or cursor."""
    pages, schema = (numbered, WORK) if kind == "works" else (cursored, ITEM)
    names = asked.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for search in batch.to_dict("records"):
                for k, results in enumerate(pages(lambda at, search=search: load(search, at)), 1):
                    rows = [{**search, "page": k, "position": i, "record": json.dumps(x, ensure_ascii=False)} for i, x in enumerate(results)]
                    yield pd.DataFrame(rows, columns=[*names, "page", "position", "record"])

    # searches are few rows and much work: dealt over tasks, where they would lie in one
    dealt = asked.repartition(max(TASKS, asked.sparkSession.sparkContext.defaultParallelism))
    out = T.StructType([*asked.schema.fields, T.StructField("page", T.IntegerType()), T.StructField("position", T.IntegerType()), T.StructField("record", T.StringType())])
    return dealt.mapInPandas(run, out).withColumn("record", F.from_json("record", schema))


RETRIED = frozenset({429, 500, 502, 503, 504})


@dataclass
class Session:
    """Requests with retries: ``send`` gets an address and gives (status, headers, body); failures of ``RETRIED`` and lost
    connections are tried again, after waits that double."""

    send: Callable[[str], tuple[int, dict, bytes]]
    tries: int = 5
    wait: float = 1.0
    sleep: Callable[[float], None] = time.sleep

    def get(self, url: str) -> tuple[int, dict, bytes]:
        for k in range(self.tries + 1):
            try:
                answer = self.send(url)
                if answer[0] not in RETRIED or k == self.tries:
                    return answer
            except OSError:
                if k == self.tries:
                    raise
            self.sleep(self.wait * 2**k)
        raise AssertionError

    def json(self, url: str) -> dict:
        status, _, body = self.get(url)
        if status >= 400:
            raise OSError(f"{url}: HTTP {status}")
        return json.loads(body)


@dataclass
class Politeness:
    """One host at a time: a least interval with some jitter between its requests, its robots.txt, and a pause after 403
    and 429 (as long as Retry-After says, if it is a number).  A robots.txt that cannot be read allows everything.

    State is by host and lives where it is made, so fetches of one host belong into one task.
    """

    session: Session
    interval: float = 1.0
    jitter: float = 0.2
    pause: float = 20.0
    agent: str = "*"
    clock: Callable[[], float] = time.monotonic
    chance: Callable[[], float] = lambda: 0.5
    last: dict[str, float] = field(default_factory=dict)
    robots: dict[str, urllib.robotparser.RobotFileParser | None] = field(default_factory=dict)

    def allowed(self, url: str) -> bool:
        at = urlsplit(url)
        root = f"{at.scheme}://{at.netloc}"
        if root not in self.robots:
            try:
                status, _, body = self.session.get(f"{root}/robots.txt")
                rules = urllib.robotparser.RobotFileParser()
                rules.parse(body.decode("utf-8", "replace").splitlines())
                self.robots[root] = rules if status < 400 else None
            except OSError:
                self.robots[root] = None
        rules = self.robots[root]
        return rules is None or rules.can_fetch(self.agent, url)

    def get(self, url: str) -> tuple[int, dict, bytes]:
        host = urlsplit(url).netloc
        since = self.clock() - self.last.get(host, float("-inf"))
        if since < self.interval:
            self.session.sleep(self.interval - since + self.jitter * self.chance())
        answer = self.session.get(url)
        self.last[host] = self.clock()
        if answer[0] in (403, 429):
            told = str({k.lower(): v for k, v in answer[1].items()}.get("retry-after", ""))
            self.session.sleep(float(told) if told.isdigit() else self.pause)
        return answer


#: Settings and what they are where nothing is said.
DEFAULTS = {
    "discovery_providers": ["openalex", "crossref"], "openalex_discovery_strategies": ["search", "title_search"], "match_fields": ["title", "abstract"],
    "match_mode": "any", "year_cutoff": None, "download_pdfs": True, "download_workers": 8, "write_candidates_jsonl": True, "write_summary_json": True,
    "dry_run": False, "scholar_csv_paths": [], "respect_robots_txt": True, "api_request_delay_seconds": 0.2, "html_request_delay_seconds": 1.0,
    "request_jitter_seconds": 0.2, "anti_bot_backoff_seconds": 20.0, "include_pending_sources": True,
}


def configuration(text: str, root: str = ".", overrides: dict | None = None) -> dict:
    """Settings from TOML: overrides that are not None stand over it, defaults under it; paths are taken from ``root``."""
    raw = tomllib.loads(text) | {k: v for k, v in (overrides or {}).items() if v is not None}
    words = [k.strip() for k in raw.get("keywords", []) if k.strip()]
    if not words:
        raise ValueError("keywords: at least one is needed")
    if "discovery_strategies" in raw:  # the older name
        raw.setdefault("openalex_discovery_strategies", raw["discovery_strategies"])
    out = DEFAULTS | {k: raw[k] for k in DEFAULTS if k in raw}
    out |= {"prefix": raw["prefix"], "keywords": words, "search_queries": raw.get("search_queries", words), "journals": raw.get("journals", [])}
    at = lambda p: str(p if Path(p).is_absolute() else Path(root) / p)
    out["output_dir"], out["scholar_csv_paths"] = at(raw["output_dir"]), [at(p) for p in out["scholar_csv_paths"]]
    if raw.get("pending_sources_path"):
        out["pending_sources_path"] = at(raw["pending_sources_path"])
    for key in ("review_title_patterns", "abstract_exclude_patterns"):
        if key in raw:
            out[key] = raw[key]
    if out["match_mode"] not in ("any", "all"):
        raise ValueError("match_mode: any or all")
    for p in out["discovery_providers"]:
        if p not in ("openalex", "crossref", "scholar_csv"):
            raise ValueError("discovery_providers: openalex, crossref or scholar_csv")
    return out

