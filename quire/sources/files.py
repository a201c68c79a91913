"""Text files as Spark data sources: large files read by ranges of lines, and one file written, and read, for each row.

Both work with any file system that Arrow knows (local, HDFS, S3, ...), in tasks; nothing of a file's content goes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RANGE_BYTES, READ_BYTES, BATCH_LINES, BATCH_FILES = 32 << 20, 1 << 20, 10_000, 1000


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class Lines(InputPartition):
    """Ranges (path, start, end) of files: the lines that begin at or behind `start` and before `end`. Small files share a partition."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


def lines_between(stream, start: int, end: int, read: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); the line in which `start` lies belongs to the range before."""
    at = max(start - 1, 0)
    stream.seek(at)
    skip, held = start > 0, b""
    while True:
        more = stream.read(read)
        held += more
        first = 0
        while (cut := held.find(b"\n", first)) >= 0:
            if not skip:
                if at >= end:
                    return
                yield at, held[first:cut]
            skip = False
            at += cut + 1 - first
            first = cut + 1
        held = held[first:]
        if not more:
            # What follows the last line end is a line too, an empty one if nothing follows.
            if not skip and at < end:
                yield at, held
            return
        if not skip and at >= end:
            return


class LineRanges(DataSource):
    """Files below a folder as (path, start, line): `path`, `suffix`, and `rangeBytes`, the size of a task."""

    @classmethod
    def name(cls) -> str:
        return "quire_lines"

    def schema(self) -> str:
        return "path string, start long, line binary"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.suffix, self.size = options["path"], options.get("suffix", ".txt").lower(), int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[Lines]:
        from pyarrow import fs

        system, root = file_system(self.root)
        found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.lower().endswith(self.suffix)]
        # A file's end is one past its last byte, so that an empty last line, and an empty file, have a place.
        out: list[Lines] = []
        held, size = [], 0
        for path, start, end in ((i.path, a, min(a + self.size, i.size + 1)) for i in sorted(found, key=lambda i: i.path) for a in range(0, i.size + 1, self.size)):
            if held and size + end - start > self.size:
                out.append(Lines(held))
                held, size = [], 0
            held.append((path, start, end))
            size += end - start
        return [*out, Lines(held)] if held or not out else out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.root)
        held: list[tuple[str, int, bytes]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "start", "line"])

        size = 0
        for path, start, end in partition.ranges:
            with system.open_input_file(path) as stream:
                for at, line in lines_between(stream, start, end):
                    held.append((path, at, line))
                    size += len(line)
                    if len(held) >= BATCH_LINES or size >= READ_BYTES:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


class FileForEachRow(DataSource):
    """Rows (name, content) as files of a folder, `path`; read back with the content as bytes, of names that end in `suffix`."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return GroupReader(self.options["path"], self.options.get("suffix", ".txt"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    """Tasks write below a folder of the attempt. Once all have, `commit` moves that folder's groups of files into place, in one rename a
    task, and marks success; `abort` drops the folder. Readers look below committed groups only."""

    def __init__(self, path: str):
        self.path, self.attempt = path, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        system, root = file_system(self.path)
        task = TaskContext.get()
        folder = f"{root}/_attempt-{self.attempt}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        n = 0
        for row in rows:
            with system.open_output_stream(f"{folder}/{row['name']}") as out:
                body = row["content"] or b""
                out.write(body.encode() if isinstance(body, str) else bytes(body))
            n += 1
        return Written(n) if n else Written(0)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        attempt = f"{root}/_attempt-{self.attempt}"
        done: set[str] = set()
        if system.get_file_info(attempt).type == fs.FileType.Directory:
            # A task that ran twice left two folders of the same files; one of them counts.
            for part in sorted(i.path for i in system.get_file_info(fs.FileSelector(attempt))):
                number = part.rsplit("/", 1)[-1].rsplit("-", 1)[0]
                if number not in done:
                    done.add(number)
                    system.move(part, f"{root}/{self.attempt}-{number}")
            system.delete_dir(attempt)
        with system.open_output_stream(f"{root}/_SUCCESS-{self.attempt}") as out:
            out.write(str(sum(m.files for m in messages if m is not None)).encode())

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/_attempt-{self.attempt}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_attempt-{self.attempt}")


class Group(InputPartition):
    """The files that one task of a write made."""

    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class GroupReader(DataSourceReader):
    """A task for each committed group lists and reads its files, so the driver sees folders only, as many as writing had tasks."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Group]:
        from pyarrow import fs

        system, root = file_system(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and not i.base_name.startswith("_")]
        return [Group(i.path) for i in sorted(found, key=lambda i: i.path)] or [Group("")]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.folder:
            return
        system, _ = file_system(self.path)
        names, bodies, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["name", "content"])

        for info in system.get_file_info(fs.FileSelector(partition.folder)):
            if info.type == fs.FileType.File and info.base_name.endswith(self.suffix):
                with system.open_input_stream(info.path) as stream:
                    bodies.append(stream.read())
                names.append(info.base_name)
                size += len(bodies[-1])
                if len(names) >= BATCH_FILES or size >= READ_BYTES:
                    yield batch()
                    names, bodies, size = [], [], 0
        if names:
            yield batch()


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, suffix: str = ".txt") -> DataFrame:
    """(path, start, line: binary) of all lines of the files below a folder; a file of many ranges is many tasks."""
    spark.dataSource.register(LineRanges)
    return spark.read.format("quire_lines").option("path", path).option("rangeBytes", range_bytes).option("suffix", suffix).load()


def write_files(texts: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """One file a row, of a text (as UTF-8; null: empty) or of bytes; the number of tasks is that of texts' partitions, whatever the names are."""
    texts.sparkSession.dataSource.register(FileForEachRow)
    texts.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).write.format("quire_files").option("path", path).mode("append").save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the committed .txt files below a folder of `write_files`, empty ones too; a task for each task that wrote."""
    spark.dataSource.register(FileForEachRow)
    return spark.read.format("quire_files").option("path", path).load().select("name", F.col("content").cast("string").alias("content"))
