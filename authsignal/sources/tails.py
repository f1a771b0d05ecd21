"""The last lines of large logs, read from the end of the files.

A source is a folder of files whose paths sort by age, as log rotation leaves them. One task per
source starts with the newest file and reads blocks from its end towards the start, then the file before,
until it has found enough matching lines; what lies before them is never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 16
SCHEMA = "source string, rank int, file string, position long, line string, bytes_read long"


class SourceFiles(InputPartition):
    """One source: its name and its files, the newest first, with their sizes."""

    def __init__(self, source: str, files: list[tuple[str, int]]):
        super().__init__(source)
        self.source, self.files = source, files


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def lines_from_end(file, size: int, block: int) -> Iterator[tuple[int, bytes, int]]:
    """Lines of a file from the last to the first: position, text and bytes read so far.

    Only whole lines come out, and a line may be longer than a block.
    """
    at, pieces, read = size, [], 0  # pieces: what is known of the line that began before ``at``, last piece first
    while at > 0:
        take = min(block, at)
        at -= take
        file.seek(at)
        part = file.read(take)
        read += take
        end = len(part)
        if at + take == size and part.endswith(b"\n"):
            end -= 1  # the last line's own end
        while (cut := part.rfind(b"\n", 0, end)) >= 0:
            tail = b"".join([part[cut + 1 : end], *reversed(pieces)])
            yield at + cut + 1, tail, read
            pieces, end = [], cut
        pieces.append(part[:end])
    if size > 0:
        yield 0, b"".join(reversed(pieces)), read


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.count = options["path"], int(options.get("lines", 10))
        self.pattern, self.block = options.get("pattern", ""), int(options.get("block", BLOCK))

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        sources: dict[str, list[tuple[str, int]]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            below = info.path[len(root) :].strip("/").split("/")
            if info.type == fs.FileType.File and not below[-1].startswith((".", "_")):
                sources.setdefault(below[0] if len(below) > 1 else "", []).append((info.path, info.size))
        return [SourceFiles(source, sorted(files, reverse=True)) for source, files in sorted(sources.items())]

    def read(self, partition: SourceFiles) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        wanted, found, before = re.compile(self.pattern), [], 0
        for path, size in partition.files:
            read = 0
            with store.open_input_file(path) as file:
                for position, raw, read in lines_from_end(file, size, self.block):
                    line = raw.decode("utf-8", "replace").removesuffix("\r")
                    if len(found) < self.count and wanted.search(line):
                        found.append((partition.source, len(found) + 1, path.rpartition("/")[2], position, line))
                    if len(found) >= self.count:
                        break
            before += read
            if len(found) >= self.count:
                break
        rows = [(*row, before) for row in found]
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["source", "rank", "file", "position", "line", "bytes_read"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


class LogTail(DataSource):
    """Options: ``path`` (a URI or an absolute path), ``lines``, ``pattern`` (a regular expression), ``block``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TailReader(self.options)


def read_tails(spark: SparkSession, path: str, lines: int = 10, pattern: str = "", block: int = BLOCK) -> DataFrame:
    """The last ``lines`` lines of each source that match ``pattern``; rank 1 is the newest.

    A source is a folder directly below ``path`` with all that lies in it.
    ``bytes_read`` is what the source's task read for them: about the bytes from the oldest found line to
    the end, in blocks. The store must be one that the Arrow file systems reach from every worker.
    """
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").options(path=path, lines=lines, pattern=pattern, block=block).load()
