"""A paged news API as a stream: offsets per feed, a long window where the short one is empty, resumed by the checkpoint.

``spark.readStream.format("notice_stream").options(folder=..).load()``.  A feed is a folder
``country=<c>/pack=<p>`` with a folder ``days=<n>`` per window; its pages are the files in there, by
name.  An offset has the pages of every feed and window, so it says by itself what a batch reads, also after a
restart: the new pages of the shortest window that has any; those of a longer one only as long as the shorter ones are empty.  A
live client is a subclass of ``FeedReader`` that replaces ``listed`` and ``page``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .stores import open_store

#: Days of the windows, in the order in which they are tried.
WINDOWS = (7, 30)


@dataclass
class Page(InputPartition):
    feed: str
    days: int
    number: int


class NoticeStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notice_stream"

    def schema(self) -> str:
        return "country string, pack string, days int, page int, record string"

    def streamReader(self, schema) -> FeedReader:  # noqa: N802
        return FeedReader(self.options)


class FeedReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["folder"].rstrip("/")
        self.windows = [int(d) for d in options.get("windows", ",".join(map(str, WINDOWS))).split(",")]

    def feeds(self) -> list[str]:
        from pyarrow import fs

        store, root = open_store(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = [f.path[len(root) :].strip("/") for f in found if f.type == fs.FileType.Directory]
        return sorted(n for n in names if n.count("/") == 1)

    def listed(self, feed: str, days: int) -> list[str]:
        """Names of the pages of a window, in order."""
        from pyarrow import fs

        store, root = open_store(f"{self.folder}/{feed}/days={days}")
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and f.size)

    def page(self, feed: str, days: int, number: int) -> list[str]:
        """Records of a page, a line each."""
        store, _ = open_store(f"{self.folder}/{feed}")
        with store.open_input_stream(self.listed(feed, days)[number - 1], compression=None) as f:
            return [line for line in f.read().decode().split("\n") if line.strip()]

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {feed: {str(d): len(self.listed(feed, d)) for d in self.windows} for feed in self.feeds()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        out = []
        for feed, there in sorted(end.items()):
            days = next((d for d in self.windows if there[str(d)]), None)
            if days is not None:
                out += [Page(feed, days, n) for n in range(start.get(feed, {}).get(str(days), 0) + 1, there[str(days)] + 1)]
        return out

    def read(self, page: Page) -> Iterator[tuple]:
        country, pack = (x.split("=", 1)[1] for x in page.feed.split("/"))
        for record in self.page(page.feed, page.days, page.number):
            yield country, pack, page.days, page.number, record

    def commit(self, end: dict) -> None:
        pass
