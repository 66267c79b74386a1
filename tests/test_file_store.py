"""Files and archives written by tasks that may fail, larger than a batch, and read back entry by entry."""

import hashlib
import io
import os
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.sources import archives, file_store


def files_below(path):
    return sorted(str(f.relative_to(path)) for f in Path(path).rglob("*") if f.is_file() and not f.name.startswith("."))


def test_archives_are_those_of_a_group_in_memory(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = turns.select("conv_id", F.concat("turn", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), "turn")
    whole = {r["conv_id"]: bytes(r["content"]) for r in archives.build_cbz(rows.drop("turn"), "conv_id").collect()}
    out = f"file://{tmp_path}/out"
    made = file_store.save_archives(rows.withColumn("archive", F.concat("conv_id", F.lit(".cbz"))).repartition(7), out, ["turn"])
    assert {r["name"]: r["n_bytes"] for r in made.collect()} == {f"{k}.cbz": len(v) for k, v in whole.items()}
    assert {f: (tmp_path / "out" / f).read_bytes() for f in files_below(tmp_path / "out")} == {f"{k}.cbz": v for k, v in whole.items()}
    read = file_store.read_archives(spark, out)
    got = {(r["archive"], r["place"]): (r["name"], bytes(r["content"])) for r in read.collect()}
    want = {(f"{k}.cbz", i): (x.filename, z.read(x)) for k, v in whole.items() for z in [zipfile.ZipFile(io.BytesIO(v))] for i, x in enumerate(z.infolist())}
    assert got == want


def test_an_archive_over_many_batches_and_tasks(spark, tmp_path, monkeypatch):
    """Its entries come in batches, and are read by several tasks, those alone whose names are asked for."""
    out = f"file://{tmp_path}/out"
    rows = spark.range(300).select(F.lit("big.cbz").alias("archive"), F.concat("id", F.lit(".bin")).alias("name"), F.concat(*[F.sha2(F.concat("id", F.lit(f"-{k}")), 512) for k in range(40)]).cast("binary").alias("content"), "id")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "50000")
        file_store.save_archives(rows, out, [-F.col("id")], drop_first=True)
        with zipfile.ZipFile(tmp_path / "out" / "big.cbz") as z:
            assert z.testzip() is None
            assert z.namelist() == [f"{i}.bin" for i in range(298, -1, -1)]
        read = file_store.read_archives(spark, out, partition_bytes=100_000)
        assert read.rdd.getNumPartitions() > 5
        assert read.agg(F.count_distinct("place"), F.count("*")).first() == (299, 299)
        some = read.where("name like '%7.bin'")
        assert {r["name"] for r in some.select("name").collect()} == {f"{i}.bin" for i in range(299) if i % 10 == 7}
        assert some.rdd.getNumPartitions() < read.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.range(40, numPartitions=4).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("no such page"))).otherwise(F.col("id").cast("string")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no such page"):
        file_store.save_files(rows, out).count()
    assert files_below(tmp_path / "out") == []
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith(".job")]
    good = rows.where("name <> '33.txt'")
    assert file_store.save_files(good, out).count() == 39
    assert file_store.save_files(good.where("name = '1.txt'").withColumn("content", F.lit("new").cast("binary")), out).count() == 1  # it takes the place of the old one
    assert len(files_below(tmp_path / "out")) == 39
    assert (tmp_path / "out" / "1.txt").read_text() == "new"


def test_odd_rows(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("a.cbz", "1.txt", None, 1), ("a.cbz", None, b"x", 2), (None, "2.txt", b"x", 3), ("b.cbz", "ünï.txt", b"", 4)], "archive string, name string, content binary, archive_2 int")
    assert file_store.save_archives(rows, out, ["archive_2"]).count() == 2
    assert sorted((r["archive"], r["name"], bytes(r["content"])) for r in file_store.read_archives(spark, out).collect()) == [("a.cbz", "1.txt", b""), ("b.cbz", "ünï.txt", b"")]
    assert file_store.save_archives(rows, f"{out}2", ["archive_2"], drop_first=True).count() == 0
    assert file_store.read_archives(spark, f"{out}2").count() == 0
    assert hashlib.md5((tmp_path / "out" / "b.cbz").read_bytes()).hexdigest() == hashlib.md5(archives.zip_bytes([("ünï.txt", b"")])).hexdigest()
