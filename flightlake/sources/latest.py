"""A stream source of growing files of lines that gives only the newest line of each file and skips the backlog.

Offsets are the files' sizes.  A reader seeks to the end of what a micro-batch covers and goes back to the last complete line, so the
work of a trigger does not depend on how many lines have come in since the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are read at a time, from the end back.
BLOCK = 4096


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Part(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


def newest_line(read, start: int, stop: int) -> bytes | None:
    """The last complete line that ends in bytes start..stop of a file; ``read(at, n)`` gives n bytes from a place on."""
    tail, at, end = b"", stop, -1
    while True:
        if end < 0:
            end = tail.rfind(b"\n")
            if end >= 0 and at + end < start:
                return None  # the last line that is complete was there before
        if end >= 0:
            begin = tail.rfind(b"\n", 0, end)
            if begin >= 0 or at == 0:
                return tail[begin + 1 : end].rstrip(b"\r")
        elif at <= start:
            return None
        n = min(BLOCK, at)
        if not n:
            return None
        at -= n
        tail = read(at, n) + tail
        end = end + n if end >= 0 else -1


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        files, folder = _opened(self.path)
        found = files.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Part(name, start.get(name, 0), size) for name, size in end.items() if size > start.get(name, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = _opened(self.path)
        with files.open_input_file(partition.name) as f:
            line = newest_line(lambda at, n: f.read_at(n, at), partition.start, partition.stop)
        if line is not None:
            yield partition.name.rsplit("/", 1)[-1], line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class LatestLines(DataSource):
    """spark.readStream.format("latest_lines").load(folder): (file, value), at most one row a file and trigger."""

    @classmethod
    def name(cls) -> str:
        return "latest_lines"

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


def latest_lines(spark: SparkSession, folder: str):
    """A stream of (file, value) from the files of lines under ``folder``, on any store that pyarrow opens by its address."""
    spark.dataSource.register(LatestLines)
    return spark.readStream.format("latest_lines").load(folder)
