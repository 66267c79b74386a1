"""Sources of landed things: snapshots, failures, files, archives, number ranges."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import urls
from quire.functions.names import unused
from quire.sources.shared import small_batches


def read_novels(spark: SparkSession, path: str) -> DataFrame:
    """Novel records, one JSON document a file."""
    return spark.read.schema(schemas.NOVEL).option("multiLine", True).json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """A table, or an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, name, length of files below a folder; their content isn't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", urls.last_segment(F.col("path")).alias("name"), "length")


def read_images(spark: SparkSession, path: str, bmp: bool = False) -> DataFrame:
    """path, chapter (the folder's name), name, content of image files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    out = files.select("path", F.element_at(parts, -2).alias("chapter"), F.element_at(parts, -1).alias("name"), "content")
    return out.where(urls.is_image(F.col("name"), bmp))


def with_files(rows: DataFrame, files: DataFrame, on: str, name: str = "file_content") -> DataFrame:
    """rows with the content of the landed file whose path is in a column, null where none landed."""
    own = unused([*rows.columns, name], 1)[0]
    landed = files.select(F.col("path").alias(own), F.col("content").alias(name))
    return rows.join(landed, F.col(on) == F.col(own), "left").drop(own)


def unzip(archives: DataFrame, content: str = "content", pattern: str = "*") -> DataFrame:
    """archives with a row for each entry whose name matches a pattern; others aren't read: entry_pos, entry_name, entry_content."""
    small_batches(archives.sparkSession)
    others = [c for c in archives.columns if c != content]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in archives.schema if f.name != content)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                with zipfile.ZipFile(io.BytesIO(batch.column(content)[row].as_py())) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    for pos, info in enumerate(infos):
                        if not fnmatchcase(info.filename, pattern):
                            continue
                        own = [batch.column(c).slice(row, 1) for c in others]
                        yield pa.RecordBatch.from_arrays([*own, pa.array([pos], pa.int32()), pa.array([info.filename]), pa.array([z.read(info)], pa.binary())], [*others, "entry_pos", "entry_name", "entry_content"])

    return archives.mapInArrow(run, f"{schema}, entry_pos int, entry_name string, entry_content binary")


def numbered(spark: SparkSession, start: int, end: int) -> DataFrame:
    """index from start to end, both included."""
    return spark.range(start, end + 1).withColumnRenamed("id", "index")


def numbered_urls(spark: SparkSession, start: int, end: int, template: str) -> DataFrame:
    """index and url, where {} in the template is the index."""
    before, _, after = template.partition("{}")
    return numbered(spark, start, end).withColumn("url", F.concat(F.lit(before), F.col("index").cast("string"), F.lit(after)))
