"""Standard MIDI Files as a data source and as a table function.

`register(spark)` makes both known: ``spark.read.format("scores").load(folder)`` reads the events of all files below a folder, and
``SELECT * FROM decode_smf(TABLE(SELECT path, content FROM files))`` those of a table of contents (Spark has no lateral join with Arrow functions).

``df.write.format("scores").mode("append").save(folder)`` writes files (path, content) below a folder, each under its path's last part.

The source lists files once, packs them into partitions by size, and takes over conditions on track_id (track chunks of other tracks are passed over, not decoded) and kind.
Files are opened through Arrow's file systems, by the path's scheme, so the folder may be in any store that these reach; `smf.read_events` reads by Spark's own.
"""

import hashlib
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from notewright.sources import smf

SUFFIXES = (".mid", ".midi")


@dataclass
class Files(InputPartition):
    """Paths that one task reads."""

    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    """How many files a task wrote."""

    files: int


def system_of(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system that a folder is in, and its path there."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)


class Writer(DataSourceArrowWriter):
    """A file is written beside its place and then moved there, so a task that runs again leaves whole files only."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = system_of(self.folder)
        system.create_dir(root, recursive=True)
        files = 0
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                to = posixpath.join(root, posixpath.basename(path.as_py()))
                with system.open_output_stream(f"{to}.part") as f:
                    f.write(content.as_py())
                system.move(f"{to}.part", to)
                files += 1
        return Written(files)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        #: Bytes of a partition; an opened file counts for some more.
        self.most, self.opening = int(options.get("partitionbytes", 32 << 20)), int(options.get("openingbytes", 64 << 10))
        self.tracks: set[int] | None = None
        self.kinds: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("track_id",), ("kind",)):
                yield f
            elif f.attribute == ("track_id",):
                self.tracks = values if self.tracks is None else self.tracks & values
            else:
                self.kinds = values if self.kinds is None else self.kinds & values

    def partitions(self) -> list[Files]:
        """Files by path, packed one after another up to a size."""
        system, root = system_of(self.folder)
        found = system.get_file_info(pa.fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.is_file and f.path.lower().endswith(SUFFIXES))
        out, room = [], 0
        for path, size in files:
            size += self.opening
            if not out or room < size:
                out.append(Files([]))
                room = self.most
            out[-1].paths.append(path)
            room -= size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = system_of(self.folder)

        def content(path: str) -> bytes:
            with system.open_input_stream(path) as f:
                return f.read()

        files = ((path, hashlib.md5(path.encode()).hexdigest()[:12], lambda path=path: content(path)) for path in partition.paths)
        # an error row has no track
        kinds = self.kinds if self.tracks is None else (set(smf.KINDS) if self.kinds is None else self.kinds - {"error"})
        return smf.event_batches(files, self.tracks, kinds)


class Scores(DataSource):
    """Options: path, a folder; partitionBytes, openingBytes."""

    @classmethod
    def name(cls) -> str:
        return "scores"

    def schema(self) -> str:
        return smf.EVENTS

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite or [f.name for f in schema] != ["path", "content"]:
            raise ValueError("files (path, content) are appended")
        return Writer(self.options["path"])


@F.arrow_udtf(returnType=smf.EVENTS)
class DecodeSmf:
    """Events of a table of files (path, content), batch by batch where they are."""

    def eval(self, files: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        paths = (p.as_py() or "" for p in files.column("path"))
        given = ((p, hashlib.md5(p.encode()).hexdigest()[:12], (lambda c=c: c.as_py() or b"")) for p, c in zip(paths, files.column("content"), strict=True))
        yield from smf.event_batches(given)


def register(spark: SparkSession) -> None:
    """The source `scores` and the function `decode_smf`, with conditions pushed into the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Scores)
    spark.udtf.register("decode_smf", DecodeSmf)
