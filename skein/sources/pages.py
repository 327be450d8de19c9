"""A cursor-paged source as a Python data source: batch and streaming, offsets are cursors.

``fetch(cursor)`` is what reaches the service; the registered one reads pages from a JSON
file, as there is no network here. A page is fetched in the task that reads it, with retries.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "identifier string, title string, cursor string"


def fetch_file(path: str, cursor: str | None, tries: int = 3) -> dict:
    """{'items': [...], 'cursor': next or null} of the page at a cursor."""
    for k in range(tries):
        try:
            with open(path, encoding="utf-8") as f:
                return json.load(f)[cursor or "start"]
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(0.1 * 2**k)
    raise AssertionError


class Page(InputPartition):
    def __init__(self, cursor: str | None):
        super().__init__(cursor)
        self.cursor = cursor


class PageReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Page]:
        found, cursor = [], None
        while True:
            found.append(Page(cursor))
            cursor = fetch_file(self.path, cursor).get("cursor")
            if cursor is None:
                return found

    def read(self, partition: Page) -> Iterator[tuple]:
        for item in fetch_file(self.path, partition.cursor)["items"]:
            yield item["identifier"], item.get("title"), partition.cursor


class PageStream(SimpleDataSourceStreamReader):
    """One page for each call; the cursor is only kept once its rows are."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"cursor": "start", "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter(()), start
        cursor = None if start["cursor"] == "start" else start["cursor"]
        page = fetch_file(self.path, cursor)
        after = page.get("cursor")
        return iter([(i["identifier"], i.get("title"), cursor) for i in page["items"]]), {"cursor": after or start["cursor"], "done": after is None}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self.read(start)[0]


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``, then ``format("paged").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])

    def simpleStreamReader(self, schema) -> PageStream:
        return PageStream(self.options["path"])
