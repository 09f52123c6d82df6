"""A paged REST source as a Python data source, and batch sinks.

Options: ``url`` with ``{page}`` (and ``{size}``) in it, ``items`` (member that holds the list, '' for a bare
array), ``size`` (items of a full page), ``pages`` (how many are read side by side, 8 unless told),
``timeout``, ``retries``, ``token`` or ``refresh`` and ``refresh_url`` (a refresh token is exchanged for an
access token by each reader).

Pages are dealt to ``pages`` input partitions (1, 1 + pages, 1 + 2 * pages, ...), and each partition reads its
pages until one is empty, short or answered by 404, so the source is read to its end however long it is. Any
other error is tried again with growing pauses and then raised: no page is ever taken for an empty one.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TITLE_LENGTH = 50  # characters of a title that the service keeps


def call(url: str, body: object | None = None, token: str | None = None, timeout: float = 30, retries: int = 4, pause: float = 0.5) -> object | None:
    """The JSON answer of a request; None for 404. Other errors are raised after ``retries`` further tries."""
    data = None if body is None else json.dumps(body).encode()
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    request = urllib.request.Request(url, data=data, headers=head if url.startswith("http") else {})
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if e.code < 500 and e.code not in (408, 425, 429) or attempt == retries:
                raise
        except urllib.error.URLError as e:
            if isinstance(e.reason, FileNotFoundError):
                return None
            if attempt == retries:
                raise
        except (TimeoutError, ConnectionError, json.JSONDecodeError):
            if attempt == retries:
                raise
        time.sleep(pause * 2**attempt)
    return None


def access_token(refresh_url: str, refresh: str, **more) -> str:
    """A refresh token exchanged for an access token."""
    got = call(refresh_url, {"refresh": refresh}, **more)
    if not isinstance(got, dict) or "access" not in got:
        raise ValueError(f"no access token from {refresh_url}")
    return got["access"]


class Pages(InputPartition):
    def __init__(self, first: int):
        self.first = first


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.side = int(options.get("pages", 8))

    def partitions(self) -> list[InputPartition]:
        return [Pages(i) for i in range(1, self.side + 1)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        how = {"timeout": float(self.o.get("timeout", 30)), "retries": int(self.o.get("retries", 4)), "pause": float(self.o.get("pause", 0.5))}
        token = self.o.get("token") or (access_token(self.o["refresh_url"], self.o["refresh"], **how) if self.o.get("refresh") else None)
        full, page = int(self.o.get("size", 100)), partition.first
        while True:
            got = call(self.o["url"].replace("{page}", str(page)).replace("{size}", str(full)), token=token, **how)
            if got is None:
                return
            items = got.get(self.o["items"], []) if self.o.get("items") else got
            for i, x in enumerate(items):
                yield page, i, json.dumps(x)
            if len(items) < full:
                return
            page += self.side


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged_json").option(...).load()"""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, position int, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))


def post_batches(df: DataFrame, send: Callable[[list[dict]], None], size: int = 100) -> None:
    """Rows to a service in batches, from the executors; ``send`` must bear repetition."""

    def run(rows: Iterator) -> None:
        batch: list[dict] = []
        for r in rows:
            batch.append(r.asDict(recursive=True))
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)


def find_or_create(base: str, title: str, body: dict, token: str | None = None, **more) -> tuple[object, bool]:
    """(id, created) of the project with a title; titles are clamped to what the service keeps."""
    title = title[:TITLE_LENGTH]
    page = 1
    while True:
        got = call(f"{base}/api/projects/?page={page}&page_size=200", token=token, **more)
        found = (got or {}).get("results", [])
        for p in found:
            if p.get("title") == title:
                return p["id"], False
        if len(found) < 200:
            break
        page += 1
    made = call(f"{base}/api/projects/", {"title": title, **body}, token=token, **more)
    if not isinstance(made, dict):
        raise ValueError(f"the service made no project {title!r}")
    return made["id"], True


def class_map(text: str) -> dict[int, str]:
    """Class names of a dataset file, given as list or as mapping (YAML; read by PyYAML where there is one)."""
    try:
        import yaml

        names = yaml.safe_load(text).get("names", [])
    except ImportError:
        names = [ln.strip()[2:] for ln in text.splitlines() if ln.strip().startswith("- ")]
    return dict(enumerate(names)) if isinstance(names, list) else {int(k): v for k, v in names.items()}
