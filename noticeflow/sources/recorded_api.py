"""A paged web API as a data source.

``spark.read.format("notice_api").schema(..).options(folder=.., start=.., end=..).load()`` has one
partition per (category, date window), so windows are read by many tasks.  Pages come from
recorded responses (``<category>_<begin>_<page>.json``) in a folder; a live client is a subclass
that replaces ``page``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Window(InputPartition):
    category: str
    begin: str
    end: str


class NoticeApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notice_api"

    def schema(self) -> str:
        return "category string, begin string, page int, record string"

    def reader(self, schema) -> NoticeReader:
        return NoticeReader(self.options)


class NoticeReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["folder"]
        self.categories = options.get("categories", "bid").split(",")
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.days, self.pages = int(options.get("days", 7)), int(options.get("pages", 3))

    def partitions(self) -> list[Window]:
        out, at = [], self.start
        while at <= self.end:
            last = min(self.end, at + timedelta(days=self.days - 1))
            out += [Window(c, at.isoformat(), last.isoformat()) for c in self.categories]
            at = last + timedelta(days=1)
        return out

    def page(self, window: Window, number: int) -> list | None:
        """Records of a page; None past the last one."""
        path = Path(self.folder) / f"{window.category}_{window.begin}_{number}.json"
        if not path.exists():
            return None
        payload = json.loads(path.read_text())
        items = payload.get("items", payload) if isinstance(payload, dict) else payload
        return items if isinstance(items, list) else [items]

    def read(self, window: Window) -> Iterator[tuple]:
        for number in range(1, self.pages + 1):
            records = self.page(window, number)
            if not records:
                return
            for r in records:
                yield window.category, window.begin, number, json.dumps(r, ensure_ascii=False, sort_keys=True)
