"""Data sources of files: rows written as files or as archives of many rows, and archives read by their entries.

Tasks write to a folder of their job beside the files; when all tasks are done the driver gives the files their names, where one with
the same name gives way, and when one fails for good it removes the job's folder. So a name stands for a whole file, and a task that
is tried again leaves nothing behind.

An archive is written as its entries come, in the order of the rows, whatever the number of Arrow batches; a task holds one batch
(spark.sql.execution.arrow.maxBytesPerBatch) and one entry's compressed bytes. A large archive is read by several tasks, each some entries that its
directory names; conditions on entries' names reach the planning.

Folders are URIs of any store that pyarrow's file systems reach from driver and executors.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.sources.shared import shared_path

#: Entries' time, so that equal input gives equal bytes.
TIME = (1980, 1, 1, 0, 0, 0)


@dataclass
class Done(WriterCommitMessage):
    """What a task has written: its files' names in the job's folder and their own."""

    files: list[tuple[str, str]]


class _Staged(DataSourceArrowWriter):
    """Files in a job's folder, named when all tasks are done."""

    def __init__(self, folder: str, manifest: str | None) -> None:
        self.folder, self.manifest, self.job = folder.rstrip("/"), manifest, f".job-{uuid.uuid4().hex}"

    def stage(self) -> tuple[fs.FileSystem, str]:
        store, root = fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{root}/{self.job}", recursive=True)
        return store, f"{root}/{self.job}"

    def noted(self, store: fs.FileSystem, stage: str, sizes: list[tuple[str, int]]) -> None:
        """The names and sizes of a task's files, for the manifest."""
        with store.open_output_stream(f"{stage}/list-{uuid.uuid4().hex}.json") as out:
            out.write("".join(json.dumps({"name": n, "path": f"{self.folder}/{n}", "n_bytes": size}) + "\n" for n, size in sizes).encode())

    def commit(self, messages: list[Done | None]) -> None:
        store, stage = self.stage()
        root = stage.rsplit("/", 1)[0]
        for own, name in (pair for m in messages if m for pair in m.files):
            if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")
            store.move(f"{stage}/{own}", f"{root}/{name}")
        if self.manifest:
            own_store, target = fs.FileSystem.from_uri(self.manifest)
            own_store.create_dir(target, recursive=True)
            for f in store.get_file_info(fs.FileSelector(stage)):
                if f.base_name.startswith("list-"):
                    with store.open_input_stream(f.path) as source, own_store.open_output_stream(f"{target}/{f.base_name}") as out:
                        out.write(source.read())
        store.delete_dir(stage)

    def abort(self, messages: list[Done | None]) -> None:
        store, stage = self.stage()
        store.delete_dir(stage)


class FilesWriter(_Staged):
    """Rows (name, content): a file each."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        store, stage = self.stage()
        files, sizes = [], []
        for batch in iterator:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                own = uuid.uuid4().hex
                buffer = data.as_buffer()
                with store.open_output_stream(f"{stage}/{own}") as out:
                    out.write(buffer)
                files.append((own, name))
                sizes.append((name, buffer.size))
        self.noted(store, stage, sizes)
        return Done(files)


class _Window:
    """A stream that can be sought within the entry that is being written."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.base, self.held = out, 0, io.BytesIO()

    def write(self, data: bytes) -> int:
        return self.held.write(data)

    def tell(self) -> int:
        return self.base + self.held.tell()

    def seek(self, to: int, whence: int = 0) -> int:
        if whence != 0:
            raise io.UnsupportedOperation
        return self.base + self.held.seek(to - self.base)

    def flush(self) -> None:
        pass

    def seekable(self) -> bool:
        return True

    def settle(self) -> None:
        """Hands on what is held: the entry is whole."""
        self.out.write(self.held.getbuffer())
        self.base += self.held.seek(0, 2)
        self.held = io.BytesIO()


class ArchivesWriter(_Staged):
    """Rows (archive, name, content), those of an archive one after the other: a ZIP file for each archive."""

    def __init__(self, folder: str, manifest: str | None, drop_first: bool) -> None:
        super().__init__(folder, manifest)
        self.drop_first = drop_first

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        store, stage = self.stage()
        files: list[tuple[str, str]] = []
        sizes: list[tuple[str, int]] = []
        now, skipped = None, False
        out = window = archive = None

        def close() -> None:
            nonlocal archive
            if archive is not None:
                archive.close()
                window.settle()
                out.close()
                sizes.append((now, window.base))
                archive = None

        for batch in iterator:
            for key, name, data in zip(batch.column("archive").to_pylist(), batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if key != now:
                    close()
                    now, skipped = key, False
                if self.drop_first and not skipped:
                    skipped = True
                    continue
                if archive is None:
                    files.append((uuid.uuid4().hex, key))
                    out = store.open_output_stream(f"{stage}/{files[-1][0]}")
                    window = _Window(out)
                    archive = zipfile.ZipFile(window, "w")
                archive.writestr(zipfile.ZipInfo(name, TIME), data.as_buffer() or b"", zipfile.ZIP_DEFLATED)
                window.settle()
        close()
        self.noted(store, stage, sizes)
        return Done(files)


@dataclass
class Entries(InputPartition):
    """Entries of archives: all of a path's, or those with these places."""

    parts: list[tuple[str, list[int] | None]]


def _passes(filters: Iterable[Filter], name: str) -> bool:
    tests = {EqualTo: lambda v: name == v, In: lambda v: name in v, StringStartsWith: name.startswith, StringEndsWith: name.endswith, StringContains: lambda v: v in name}
    return all(tests[type(f)](f.value) for f in filters)


def _packs(items: Iterable[tuple[int, tuple[str, int | None]]], most: int) -> Iterator[list[tuple[str, list[int] | None]]]:
    """(bytes, (path, place)) in order to lists of at most `most` bytes; place None is a whole archive."""
    held, weight = [], 0
    for size, (path, place) in items:
        if held and weight + size > most:
            yield held
            held, weight = [], 0
        if place is not None and held and held[-1][0] == path:
            held[-1][1].append(place)
        else:
            held.append((path, None if place is None else [place]))
        weight += size
    if held:
        yield held


class ArchivesReader(DataSourceReader):
    def __init__(self, folder: str, glob: str, most: int) -> None:
        self.folder, self.glob, self.most, self.filters = folder.rstrip("/"), glob, most, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and tuple(f.attribute) == ("name",):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Entries]:
        """Small archives several to a task, unread; a large one's entries, of those that are wanted, by several."""
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        found = sorted((f for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.glob) and "/.job-" not in f.path), key=lambda f: f.path)
        small = [(f.size, (f.path, None)) for f in found if f.size <= self.most]
        parts = list(_packs(small, self.most))
        for f in found:
            if f.size > self.most:
                with store.open_input_file(f.path) as source, zipfile.ZipFile(source) as z:
                    wanted = [(i.compress_size, (f.path, k)) for k, i in enumerate(_files(z)) if _passes(self.filters, i.filename)]
                parts += _packs(wanted, self.most)
        return [Entries(p) for p in parts] or [Entries([])]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for path, places in partition.parts:
            with store.open_input_file(path) as source, zipfile.ZipFile(source) as z:
                infos = _files(z)
                for k in range(len(infos)) if places is None else places:
                    if _passes(self.filters, infos[k].filename):
                        yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([k], pa.int64()), pa.array([infos[k].filename]), pa.array([z.read(infos[k])], pa.binary())], ["archive", "place", "name", "content"])


def _files(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in z.infolist() if not i.is_dir()]


class QuireArchives(DataSource):
    """Options: path; suffix (of files that are read, ".cbz"), partitionBytes (64 MB); dropFirst, manifest (written)."""

    @classmethod
    def name(cls) -> str:
        return "quire-archives"

    def schema(self) -> str:
        return "archive string, place long, name string, content binary"

    def reader(self, schema: StructType) -> ArchivesReader:
        return ArchivesReader(self.options["path"], self.options.get("suffix", ".cbz"), int(self.options.get("partitionbytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchivesWriter:
        return ArchivesWriter(self.options["path"], self.options.get("manifest"), self.options.get("dropfirst", "false") == "true")


class QuireFiles(DataSource):
    """Options: path, manifest."""

    @classmethod
    def name(cls) -> str:
        return "quire-files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options.get("manifest"))


MANIFEST = "name string, path string, n_bytes long"


def _save(rows: DataFrame, kind: type[DataSource], folder: str, **options: object) -> DataFrame:
    spark = rows.sparkSession
    spark.dataSource.register(kind)
    manifest = shared_path(spark, "manifest")
    rows.write.format(kind.name()).mode("append").options(manifest=manifest, **options).save(folder)
    return spark.read.schema(MANIFEST).json(manifest)


def save_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content) as files; (name, path, n_bytes) of what was written. Rows without a name or content are left out."""
    return _save(rows.select(F.col("name").cast("string").alias("name"), "content").where("name is not null and content is not null"), QuireFiles, folder)


def save_archives(rows: DataFrame, folder: str, order: list[str | Column], drop_first: bool = False) -> DataFrame:
    """Writes rows (archive, name, content) as archives with their entries in order; (name, path, n_bytes) of what was written.

    An archive is a file, so one task writes it; it may be larger than the task's memory. Archives without an entry (the only one was
    dropped) aren't written. Rows without an archive or a name are left out, null content is an empty entry.
    """
    own = rows.where("archive is not null and name is not null")
    own = own.select(F.col("archive").cast("string").alias("archive"), "name", "content", *[(F.col(c) if isinstance(c, str) else c).alias(f"by_{i}") for i, c in enumerate(order)])
    own = own.repartition("archive").sortWithinPartitions("archive", *[f"by_{i}" for i in range(len(order))])
    return _save(own.select("archive", "name", "content"), QuireArchives, folder, dropFirst=drop_first)


def read_archives(spark: SparkSession, folder: str, suffix: str = ".cbz", partition_bytes: int = 64 << 20) -> DataFrame:
    """(archive, place, name, content) of the entries of all archives below a folder. Turns on the pushdown of filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(QuireArchives)
    return spark.read.format(QuireArchives.name()).option("suffix", suffix).option("partitionBytes", partition_bytes).load(folder)
