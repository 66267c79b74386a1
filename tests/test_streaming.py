"""Landed pages appended once, over runs that end early, late copies, and pages that another job stored."""

import pytest

from quire.streaming.landing import append_new, read_keys, read_pages

SCHEMA = "page_id bigint, url string, html string"


def land(spark, base, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")


def run(spark, base, most_files=1000, **other):
    query = append_new(read_pages(spark, f"{base}/in", most_files), f"{base}/out", f"{base}/state", **other)
    assert query.awaitTermination(120)
    return query


def store(spark, base):
    rows = spark.read.parquet(f"{base}/out").collect()
    got = {r["url"]: (r["page_id"], r["elements"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_pages_are_appended_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    batches = ([(1, "u1", "<p>a</p>"), (2, "u2", "<p>b</p>"), (3, "u1", "<p>again</p>")], [(4, "u2", "<p>b</p>"), (5, "u3", "<p><b>c</b></p>")])
    for rows in batches:
        land(spark, base, rows)
        run(spark, base)
    assert store(spark, base) == {"u1": (1, ["p"]), "u2": (2, ["p"]), "u3": (5, ["p", "b"])}


def test_late_copies_over_restarts_and_odd_pages(spark, tmp_path):
    base = f"file://{tmp_path}"
    land(spark, base, [(7, "u1", None), (6, "u1", "<i>first</i>"), (8, None, "<p>x</p>")])
    run(spark, base)
    for k in range(3):  # a file a batch
        land(spark, base, [(10 + k, "u1", "<p>late</p>"), (20 + k, None, "<p>y</p>"), (30 + k, f"new{k}", "")])
    query = run(spark, base, most_files=1)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    run(spark, base)
    assert store(spark, base) == {"u1": (6, ["i"]), None: (8, ["p"]), "new0": (30, []), "new1": (31, []), "new2": (32, [])}


def test_a_batch_that_fails_is_taken_up_again(spark, tmp_path):
    base = f"file://{tmp_path}"
    land(spark, base, [(1, "u1", "<p>a</p>")])
    run(spark, base)
    land(spark, base, [(2, "u2", "<p>b</p>"), (3, "u1", "<p>c</p>")])
    (tmp_path / "out" / "_spark_metadata").rename(tmp_path / "aside")
    (tmp_path / "out" / "_spark_metadata").write_text("in the way")
    with pytest.raises(Exception):  # noqa: B017
        run(spark, base)
    (tmp_path / "out" / "_spark_metadata").unlink()
    (tmp_path / "aside").rename(tmp_path / "out" / "_spark_metadata")
    run(spark, base)
    assert store(spark, base) == {"u1": (1, ["p"]), "u2": (2, ["p"])}


def test_pages_that_another_job_stored_do_not_come_again(spark, tmp_path):
    base = f"file://{tmp_path}"
    spark.createDataFrame([(1, "u1", "<p>old</p>")], SCHEMA).write.parquet(f"{base}/old")
    land(spark, base, [(2, "u1", "<p>a</p>"), (3, "u2", "<p>b</p>")])
    for _ in range(2):
        run(spark, base, stored=read_keys(spark, f"{base}/old"))
    assert store(spark, base) == {"u2": (3, ["p"])}
