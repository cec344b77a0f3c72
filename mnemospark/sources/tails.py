"""Transcripts from where reading stopped: a data source with an offset for each file, in batches and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def tail_source() -> type[DataSource]:
    """The data source `transcript_tail`: (file, line, at, value), each line with the byte it starts at.

    Options: path, a file or folder of *.jsonl; offsets, JSON of {file: [byte, line]} to start from (batch); unterminated,
    whether a last line without its end counts (batch; a stream waits for the end). A stream's offset is the length of
    each file, and a line belongs to the part that holds its end, so what is read again from a checkpoint are the same
    lines; it has no line numbers, as those would need all that comes before. A file that became shorter starts over.
    Made in a function, so that it reaches executors whole.
    """
    chunk, step = 1 << 20, 1 << 16

    class Part(InputPartition):
        def __init__(self, file: str, start: int, end: int, line: int | None, last: bool):
            self.file, self.start, self.end, self.line, self.last = file, start, end, line, last

    def system(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)

    def sizes(path: str) -> dict[str, int]:
        from pyarrow import fs

        store, at = system(path)
        root = path[: len(path) - len(at)] if path.endswith(at) else ""
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True))
        return {root + f.path: f.size for f in found if f.type == fs.FileType.File and (f.path == at or f.path.endswith(".jsonl"))}

    def lines(part: Part) -> Iterator[tuple]:
        store, at = system(part.file)
        with store.open_input_file(at) as f:
            start = part.start
            if part.line is None:  # back to where the line begins that the last part left open
                while start > 0:
                    low = max(0, start - step)
                    f.seek(low)
                    cut = f.read(start - low).rfind(b"\n")
                    start = low + cut + 1 if cut >= 0 else low
                    if cut >= 0:
                        break
            f.seek(start)
            line, rest, left = part.line, b"", part.end - start
            while left > 0 and (block := f.read(min(chunk, left))):
                left -= len(block)
                *whole, rest = (rest + block).split(b"\n")
                for value in whole:
                    yield part.file, line, start, value.decode("utf-8", "replace")
                    start += len(value) + 1
                    line = None if line is None else line + 1
            if rest and part.last:
                yield part.file, line, start, rest.decode("utf-8", "replace")

    class Batch(DataSourceReader):
        def __init__(self, options):
            self.path, self.last = options["path"], options.get("unterminated", "true") == "true"
            self.offsets = json.loads(options.get("offsets") or "{}")

        def partitions(self):
            out = []
            for file, size in sorted(sizes(self.path).items()):
                at, line = self.offsets.get(file, (0, 0))
                at, line = (0, 0) if at > size else (at, line)
                if size > at:
                    out.append(Part(file, at, size, line, self.last))
            return out

        def read(self, part):
            return lines(part) if part else iter(())

    class Stream(DataSourceStreamReader):
        def __init__(self, options):
            self.path = options["path"]

        def initialOffset(self):
            return {}

        def latestOffset(self):
            return sizes(self.path)

        def partitions(self, start, end):
            from_ = lambda f, n: start.get(f, 0) if start.get(f, 0) <= n else 0
            return [Part(f, from_(f, n), n, None, False) for f, n in sorted(end.items()) if n > from_(f, n)]

        def read(self, part):
            return lines(part) if part else iter(())

        def commit(self, end):
            pass

    class Tail(DataSource):
        @classmethod
        def name(cls):
            return "transcript_tail"

        def schema(self):
            return "file string, line long, at long, value string"

        def reader(self, schema):
            return Batch(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    return Tail


def read_new(spark: SparkSession, path: str, offsets: dict[str, tuple[int, int]] | None = None, unterminated: bool = True) -> DataFrame:
    """Lines behind the offsets {file: (byte, line)}; what lies before them is not read."""
    spark.dataSource.register(tail_source())
    return spark.read.format("transcript_tail").option("path", path).option("offsets", json.dumps(offsets or {})).option("unterminated", str(unterminated).lower()).load()


def stream_new(spark: SparkSession, path: str) -> DataFrame:
    """Whole lines as files grow; the checkpoint knows how far each was read."""
    spark.dataSource.register(tail_source())
    return spark.readStream.format("transcript_tail").option("path", path).load()


def file_times(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, changed, length) of the files below a folder, in seconds and bytes; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("path", "unix_seconds(modificationTime) AS changed", "length")
