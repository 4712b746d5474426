"""A news API as a Python data source, batch and streaming; the next read begins after the last article's time."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

SCHEMA = "title string, description string, url string, publishedAt string, source_name string"
FIELDS = ("title", "description", "url", "publishedAt")


def rows_of(payload: dict, since: str = "") -> list[tuple]:
    """Articles of a response later than ``since``, oldest first; articles without an address are left out."""
    found = [a for a in payload.get("articles", []) if a.get("url") and (a.get("publishedAt") or "") > since]
    found.sort(key=lambda a: a.get("publishedAt") or "")
    return [(*(a.get(f) for f in FIELDS), (a.get("source") or {}).get("name")) for a in found]


def fetch(options: dict, since: str) -> list[tuple]:
    """One request; ``endpoint`` may be an http address or the path of a saved response. The key comes from the
    environment variable that ``key_env`` names, never from an option."""
    endpoint = options["endpoint"]
    if not endpoint.startswith("http"):
        with open(endpoint, encoding="utf-8") as f:
            return rows_of(json.load(f), since)
    query = {"q": options.get("query", ""), "sortBy": "publishedAt", "language": options.get("language", "en")}
    address = f"{endpoint}?{urlencode(query | ({'from': since} if since else {}))}"
    request = Request(address, headers={"X-Api-Key": os.environ.get(options.get("key_env", "NEWS_API_KEY"), "")})
    with urlopen(request, timeout=float(options.get("timeout", 30))) as answer:
        return rows_of(json.load(answer), since)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        yield from fetch(self.options, self.options.get("since", ""))


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"since": self.options.get("since", "")}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = fetch(self.options, start["since"])
        return iter(rows), {"since": max([start["since"], *(r[3] for r in rows if r[3])])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([r for r in fetch(self.options, start["since"]) if (r[3] or "") <= end["since"]])


class NewsApi(DataSource):
    """``spark.dataSource.register(NewsApi)``, then format ``news_api`` with option ``endpoint``."""

    @classmethod
    def name(cls) -> str:
        return "news_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))
