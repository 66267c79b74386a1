"""What is stored is left out whatever the filter says, its errors are as stated, and a store is rewritten only where keys fall."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import links, scans, seen


def test_filter_errs_as_stated(spark):
    stored, absent = spark.range(20_000).withColumn("b", F.lit("x")), spark.range(100_000, 140_000).withColumn("b", F.lit("x"))
    for error in (0.05, 0.01, 0.001):
        words = seen.words_for(20_000, error)
        filter_ = seen.bloom(stored, ["id", "b"], words).cache()
        assert seen.maybe(stored, filter_, ["id", "b"], words, "m").where("not m").count() == 0
        rate = seen.maybe(absent, filter_, ["id", "b"], words, "m").where("m").count() / 40_000
        assert rate < 1.5 * error + 0.0005
    assert 10 < 64 * seen.words_for(10**6, 0.01) / 10**6 < 16


@pytest.mark.parametrize("most_words", [1_000_000, 0])
def test_missing_is_the_anti_join(spark, most_words):
    wanted = spark.createDataFrame([(i % 700, "a" if i % 3 else None, i) for i in range(3000)], "k int, s string, word int")
    stored = spark.createDataFrame([(i, "a", 1) for i in range(0, 700, 2)] + [(None, "a", 1), (1, None, 1)], "k int, s string, bits int")
    got = seen.missing(wanted, stored, ["k", "s"], most_words=most_words)
    assert got.columns == wanted.columns or set(got.columns) == set(wanted.columns)
    assert sorted(map(str, got.select("word").collect())) == sorted(map(str, wanted.join(stored, ["k", "s"], "left_anti").select("word").collect()))
    assert seen.missing(wanted, stored.limit(0), ["k"]).count() == 3000
    assert seen.missing(wanted.limit(0), stored, ["k"]).count() == 0


def test_new_rows_pass_without_a_shuffle(spark):
    wanted, stored = spark.range(1000), spark.range(500)
    plan = seen.missing(wanted, stored, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("LeftAnti")  # one branch alone has the join


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    path, schema = f"file://{tmp_path}/store", "id long, v string"
    rows = lambda lo, hi, v: spark.range(lo, hi).select("id", F.lit(v).alias("v"))
    seen.upsert_into(rows(0, 500, "old"), path, ["id"], schema, 16)
    before = {f: f.stat().st_mtime_ns for f in Path(tmp_path / "store").rglob("*.parquet")}
    fresh = rows(498, 502, "new")
    seen.upsert_into(fresh, path, ["id"], schema, 16)
    after = {f: f.stat().st_mtime_ns for f in Path(tmp_path / "store").rglob("*.parquet")}
    assert len(before.keys() & after.keys()) >= 16 - 4
    assert all(before[f] == after[f] for f in before.keys() & after.keys())
    got = {r["id"]: r["v"] for r in seen.read_store(spark, path, schema).collect()}
    assert got == {i: "new" if i >= 498 else "old" for i in range(502)}
    seen.upsert_into(fresh.limit(0), path, ["id"], schema, 16)
    seen.upsert_into(spark.createDataFrame([(None, "a")], schema), path, ["id"], schema, 16)
    seen.upsert_into(spark.createDataFrame([(None, "b")], schema), path, ["id"], schema, 16)
    assert [r["v"] for r in seen.read_store(spark, path, schema).where("id is null").collect()] == ["b"]
    assert seen.read_store(spark, path, schema).count() == 503


@pytest.mark.parametrize("hot", [0.95, 0.4, 0])
def test_running_sums_of_groups_over_many_ranges(spark, hot):
    import random

    rng = random.Random(1)
    rows = [("h" if rng.random() < hot else rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(50)]), i, rng.random() < rng.choice([0.05, 0.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "part string, t int, sum int, lead boolean").repartition(3)
    got = {x["sum"]: x["v"] for x in scans.running_sum(df, ["part"], ["t", "sum"], F.col("sum"), F.col("lead"), "v").collect()}
    want, run = {}, {}
    for k, _, i, anew in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        want[i] = run[k] = i if anew else run.get(k, 0) + i
    assert got == want
    assert scans.running_sum(df.limit(0), ["part"], ["t"], F.lit(1)).count() == 0


def test_ranges_share_a_hot_key_alike(spark):
    """No range has more than twice the rows of the middle one, though all rows are of one key."""
    rows = spark.range(40_000).select(F.lit("one").alias("key"), F.xxhash64("id").alias("t"), "id")
    spread = rows.repartitionByRange(8, "key", "t").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in spread)
    assert len(sizes) == 8
    assert sizes[-1] <= 2 * sizes[4]
    assert scans.numbered(rows, ["key"], ["t"]).agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (1, 40_000, 40_000)


def traced(step, urls):
    out = {}
    for u in urls:
        path, at = [], u
        while at not in path and at in step:
            path.append(at)
            at = step[at]
        if at in path:
            circle = path[path.index(at) :]
            out[u] = ("circle", at, path.index(at), min(circle), len(circle))
        else:
            out[u] = ("end", at, len(path), None, 0)
    return out


def test_trace_finds_ends_and_circles(spark):
    import random

    rng = random.Random(2)
    for n, p in ((1, 1.0), (40, 0.9), (60, 1.0), (60, 0.0)):
        step = {i: rng.randrange(n) for i in range(n) if rng.random() < p}
        rows = [(i, step.get(i)) for i in range(n)] + [(i, x) for i, x in step.items()] + [(None, 3), (200, 201), (201, 202)]
        step |= {200: 201, 201: 202}
        got = {r["url"]: tuple(r)[1:] for r in links.trace(spark.createDataFrame(rows, "url long, next long")).collect()}
        assert got == traced(step, [*range(n), 200, 201, 202])
    assert links.trace(spark.createDataFrame([], "url long, next long")).count() == 0
