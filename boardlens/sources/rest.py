"""Board documents over REST as a Spark data source, with bounded concurrency and readable errors.

``spark.dataSource.register(BoardDocuments)`` and
``spark.read.format("board_documents").option("base", url).option("keys", "a,b")``.
Each key is one partition-row request; how many run at once is the number of
partitions (option ``parallel``, 3). Offline, any file:// or http:// server
with one JSON document per key does.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DOCUMENT_TIMEOUT_S, IMAGE_TIMEOUT_S, PARALLEL = 60, 15, 3


def describe_status(status: int, reason: str, path: str, retry_after: str | None = None) -> str:
    if status in (401, 403):
        return f"The access token is invalid or expired ({status} {reason})."
    if status == 404:
        return f"Board not found (404), check its address: {path}"
    if status == 429:
        return "The rate limit is exceeded (429)." + (f" Retry after {retry_after} seconds." if retry_after else " Wait a moment before retrying.")
    return f"The request failed ({status} {reason}): {path}"


def fetch(url: str, token: str | None, timeout: float) -> bytes:
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.read()
    except urllib.error.HTTPError as e:
        raise RuntimeError(describe_status(e.code, e.reason, url, e.headers.get("Retry-After"))) from e
    except TimeoutError as e:
        raise RuntimeError(f"The request took more than {timeout} s: {url}") from e


class _Keys(InputPartition):
    def __init__(self, keys: list[tuple[int, str]]):
        self.keys = keys


class BoardDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "board_documents"

    def schema(self) -> str:
        return "ord long, board_id string, raw string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.base, self.token = options["base"].rstrip("/"), options.get("token")
        self.keys = [k.strip() for k in options["keys"].split(",") if k.strip()]
        self.parallel = int(options.get("parallel", PARALLEL))

    def partitions(self) -> list[InputPartition]:
        numbered = list(enumerate(self.keys))
        return [_Keys(numbered[i :: self.parallel]) for i in range(min(self.parallel, len(numbered)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, key in partition.keys:
            raw = fetch(f"{self.base}/{key}", self.token, DOCUMENT_TIMEOUT_S).decode()
            json.loads(raw)
            yield i, key, raw


def image_addresses(raw: bytes) -> dict[str, str]:
    """{image reference: address} of an image listing."""
    images = json.loads(raw).get("meta", {}).get("images", {})
    return {k: v for k, v in images.items() if v}


def fetch_screenshots(addresses: DataFrame, token: str | None = None) -> DataFrame:
    """(ord, url) to (ord, png): in request order, nulls skipped; an error only if none renders."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for i, url in zip(batch["ord"], batch["url"], strict=True):
                if url:
                    try:
                        out.append((i, fetch(url, token, IMAGE_TIMEOUT_S)))
                    except RuntimeError:
                        continue
            yield pd.DataFrame(out, columns=["ord", "png"])

    got = addresses.repartition(PARALLEL).mapInPandas(run, "ord long, png binary").cache()
    if addresses.where("url IS NOT NULL").limit(1).count() and not got.limit(1).count():
        raise RuntimeError("no screenshot could be rendered")
    return got.orderBy("ord")
