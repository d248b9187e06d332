"""Places that the driver and every executor can reach.

Tables go through :mod:`boardlens.sources.scratch`; files that Python code on
executors writes are handled here.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlens.llm import bpe
from boardlens.sources.scratch import drop_dir, drop_table, materialise, new_dir

__all__ = ["drop_dir", "drop_table", "give_back", "lean", "materialise", "new_dir", "numbered", "open_fs", "open_ranges", "read_bytes", "write_bytes"]


def numbered(docs: DataFrame, keep: list[str], *extra: Column) -> DataFrame:
    """The columns ``keep`` under plain names of their places (whatever theirs are), and ``extra`` ones."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in keep] + list(extra)
    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])


def give_back() -> None:
    """Return to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *, tables: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, in a Python worker that holds only what it needs.

    Workers live on and take tasks of other operators: the tokenizers' tables of
    earlier tasks go first (unless ``tables`` are what it works with), and freed
    memory is returned before and after.
    """

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            bpe.forget()
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return on


def open_fs(uri: str):
    """(filesystem, path) of a URI for Python code on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes, attempt: str) -> None:
    """Write under a temporary name, then rename: readers never see half a file.

    A file of another attempt of the same task that holds the same bytes stays.
    """
    from pyarrow import fs as pafs

    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}._{attempt}"
    with fs.open_output_stream(temp) as out:
        out.write(data)
    there = fs.get_file_info(path)
    if there.type != pafs.FileType.NotFound:
        if there.size == len(data) and read_bytes(uri) == data:
            fs.delete_file(temp)
            return
        fs.delete_file(path)
    fs.move(temp, path)


@contextmanager
def open_ranges(uri: str):
    """A function that reads (place, size) of a file."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        yield lambda at, size: f.read_at(size, at)


def read_bytes(uri: str) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()
