"""REST services as a Spark data source: page, offset and cursor pagination.

Page and offset styles are planned: one probe tells how many records a request gives
and, where the service names a total, how many there are; without one the last page
is found by doubling and halving.  Ranges of pages become partitions, each read and
retried by itself; the last one goes on until the service has no more.  Cursors can
only be followed one after the other, in one partition.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_PAGES = 10_000
TIMEOUT = 30
RETRIES = 3
#: Most partitions of a read.
PARTITIONS = 32


def fetch(config: dict, params: dict) -> object:
    """One request's JSON body; busy or failing servers and broken connections are asked again."""
    query = urllib.parse.urlencode({**config.get("params", {}), **params})
    url = config["url"] + (("&" if "?" in config["url"] else "?") + query if query else "")
    request = urllib.request.Request(url, method=config.get("method", "GET"), headers=dict(config.get("headers", {})))
    if config.get("auth_token"):
        request.add_header("Authorization", f"Bearer {config['auth_token']}")
    retries = int(config.get("retries", RETRIES))
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=config.get("timeout", TIMEOUT)) as answer:
                return json.loads(answer.read() or b"null")
        except urllib.error.HTTPError as problem:
            if attempt == retries or (problem.code < 500 and problem.code != 429):
                raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if attempt == retries:
                raise
        time.sleep(float(config.get("retry_delay", 1.0)) * 2**attempt)
    raise AssertionError


def records(body: object, data_key: str = "data") -> list:
    """The body if it is a list, else its list under ``data_key``, else nothing."""
    if isinstance(body, list):
        return body
    found = body.get(data_key) if isinstance(body, dict) else None
    return found if isinstance(found, list) else []


def total_of(body: object, key: str) -> int | None:
    """The number under a dotted key, if there is one."""
    for part in key.split("."):
        body = body.get(part) if isinstance(body, dict) else None
    return body if isinstance(body, int) and not isinstance(body, bool) and body >= 0 else None


def _page(config: dict, number: int, size: int) -> dict:
    """Parameters of a page, from 0, of ``size`` records."""
    if config.get("pagination") == "page":
        return {config.get("page_param", "page"): number + 1, config.get("page_size_param", "page_size"): int(config.get("page_size", 10_000))}
    return {"offset": number * size, "limit": size}


def last_page(holds: Callable[[int], bool], most: int) -> int:
    """The last page that holds records, page 0 being one: by doubling, then halving; at most ``most``."""
    low, high = 0, 1
    while high <= most and holds(high):
        low, high = high, high * 2
    high = min(high, most + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


class PageRange(InputPartition):
    """Pages from ``first`` up to ``stop``, or to the end where that is None; ``size`` records each."""

    def __init__(self, first: int, stop: int | None, size: int):
        self.first, self.stop, self.size = first, stop, size


def planned(config: dict) -> list[PageRange]:
    """Ranges of pages that together hold all records of a page- or offset-style service."""
    most, key = int(config.get("max_pages", MAX_PAGES)), config.get("data_key", "data")
    body = fetch(config, _page(config, 0, int(config.get("page_size", 10_000))))
    size = len(records(body, key))
    if not size:
        return []
    total = total_of(body, config.get("total_key", "total"))
    if total is not None:
        last = max(1, -(-total // size)) - 1
    else:
        last = last_page(lambda n: bool(records(fetch(config, _page(config, n, size)), key)), most)
    if last >= most:
        raise RuntimeError(f"{config['url']} has more than {most} pages")
    parts = max(1, min(int(config.get("num_partitions", PARTITIONS)), last + 1))
    cuts = [(last + 1) * i // parts for i in range(parts)]
    return [PageRange(a, b, size) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]


def read_range(config: dict, part: PageRange) -> Iterator[list]:
    """The lists of records of a range.

    Offsets go on by what was received; a range inside the service that comes
    short is an error, as is a service that goes on beyond ``max_pages``.
    """
    key, most = config.get("data_key", "data"), int(config.get("max_pages", MAX_PAGES))
    if config.get("pagination") == "page":
        number = part.first
        while part.stop is None or number < part.stop:
            rows = records(fetch(config, _page(config, number, part.size)), key)
            if not rows:
                if part.stop is not None:
                    raise RuntimeError(f"{config['url']} has no page {number + 1} any more")
                return
            if number >= most:
                raise RuntimeError(f"{config['url']} has more than {most} pages")
            yield rows
            number += 1
        return
    at, stop = part.first * part.size, None if part.stop is None else part.stop * part.size
    while stop is None or at < stop:
        rows = records(fetch(config, {"offset": at, "limit": part.size if stop is None else min(part.size, stop - at)}), key)
        if not rows:
            if stop is not None:
                raise RuntimeError(f"{config['url']} has no record {at} any more")
            return
        if at >= most * part.size:
            raise RuntimeError(f"{config['url']} has more than {most} pages")
        yield rows
        at += len(rows)


def pages(config: dict) -> Iterator[list]:
    """All lists of records, one after the other.

    A service that still has records after ``max_pages`` (``MAX_PAGES``) pages, or
    that repeats a cursor, is an error, never a short result.
    """
    style, key = config.get("pagination"), config.get("data_key", "data")
    most, cursor = int(config.get("max_pages", MAX_PAGES)), None
    if style in ("page", "offset"):
        for part in planned(config):
            yield from read_range(config, part)
        return
    for number in range(most + 1):
        body = fetch(config, {"cursor": cursor} if cursor else {})
        rows = records(body, key)
        if rows and number == most:
            break
        if rows:
            yield rows
        last, cursor = cursor, body.get(config.get("cursor_key", "next_cursor")) if isinstance(body, dict) else None
        if style == "cursor" and cursor and cursor == last:
            raise RuntimeError(f"{config['url']} repeats the cursor {cursor!r}")
        if style != "cursor" or not cursor:
            return
    raise RuntimeError(f"{config['url']} has more than {most} pages")


class RestReader(DataSourceReader):
    def __init__(self, config: dict):
        self.config = config

    def partitions(self) -> list[InputPartition]:
        if self.config.get("pagination") in ("page", "offset"):
            return planned(self.config) or [PageRange(0, 0, 1)]
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for rows in read_range(self.config, partition) if isinstance(partition, PageRange) else pages(self.config):
            for r in rows:
                yield (json.dumps(r),)


class RestSource(DataSource):
    """One row ``record`` (JSON text) per record; parse it with a schema on the way out."""

    @classmethod
    def name(cls) -> str:
        return "sluiceway_rest"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> RestReader:
        return RestReader(json.loads(self.options["config"]))
