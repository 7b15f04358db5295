"""Streams of pages, read by tasks: a partition is a resource's span of up to so many pages.

Where a page's end leads to is known only by reading it, and rows shouldn't pass the driver. So the stream's offset counts
spans by resource, and the token at which a span begins stands in a ledger, a folder of small files that the driver and all
executors share: the task that reads a span enters the token at its end. The driver reads only the ledger. A span that runs
again, after a failure or a restart, begins at the same token and enters the same end. A resource whose last page has been
read has an end without a token, and gives no further spans.

Defined cases: a page without rows is read over; a resource without pages gives nothing; without new pages a batch is empty.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Pages of a span, at most.
PAGES = 100


class Ledger:
    """Tokens by resource and span, in files that appear whole or not at all."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.files, self.root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def _path(self, resource: str, span: int) -> str:
        return f"{self.root}/{hashlib.sha256(resource.encode()).hexdigest()[:16]}/{span}"

    def token(self, resource: str, span: int) -> str | None:
        """Where a span begins; None after the last page. The first begins at the empty token."""
        if not span:
            return ""
        with self.files.open_input_stream(self._path(resource, span)) as f:
            return json.loads(f.read())

    def known(self, resource: str) -> int:
        """The last span whose beginning is known."""
        from pyarrow import fs

        found = self.files.get_file_info(fs.FileSelector(self._path(resource, 0).rsplit("/", 1)[0], allow_not_found=True))
        return max((int(x.base_name) for x in found if x.base_name.isdigit()), default=0)

    def enter(self, resource: str, span: int, token: str | None, writer: str) -> None:
        path = self._path(resource, span)
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.files.open_output_stream(f"{path}.{writer}") as f:
            f.write(json.dumps(token).encode())
        self.files.move(f"{path}.{writer}", path)


class PageSource(DataSource):
    """Options: client (`module:function`, called as function(resource, token) -> (rows, next token or None)), resources
    (comma), schema, ledger (a shared folder, one for each stream), pages (of a span, at most)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Pages(dict(self.options))


class _Span(InputPartition):
    def __init__(self, resource: str, span: int):
        super().__init__((resource, span))


class _Pages(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def _resources(self) -> list[str]:
        return [x for x in self.options["resources"].split(",") if x]

    def initialOffset(self) -> dict:
        return dict.fromkeys(self._resources(), 0)

    def latestOffset(self) -> dict:
        ledger, out = Ledger(self.options["ledger"]), {}
        for resource in self._resources():
            span = ledger.known(resource)
            out[resource] = span + (ledger.token(resource, span) is not None)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(resource, span) for resource, to in end.items() for span in range(start.get(resource, 0), to)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        from pyspark import TaskContext

        if partition is None:  # no resource has a span, and Spark runs one task for nothing
            return
        resource, span = partition.value
        module, _, function = self.options["client"].partition(":")
        client, ledger = getattr(import_module(module), function), Ledger(self.options["ledger"])
        token = ledger.token(resource, span)
        for _ in range(int(self.options.get("pages", PAGES))):
            if token is None:
                break
            rows, token = client(resource, token)
            yield from rows
        task = TaskContext.get()
        ledger.enter(resource, span + 1, token, f"{task.taskAttemptId()}" if task else "driver")

    def commit(self, end: dict) -> None:
        pass
