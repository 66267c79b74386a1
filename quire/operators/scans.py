"""Running sums over ordered groups of any size.

A window holds a group in one task. Here rows are range-partitioned by key and order, so that a group may lie in many ranges. Each
range sums for itself, and gives for each group a carry: its last sum, and whether it starts anew somewhere. A range continues
one group at most, so there are no more carries to hand on than ranges; they are combined per group, broadcast, and added to the
rows before a range's first new start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.names import unused
from quire.sources.shared import written


def _changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Where a column's value isn't that of the row before; null equals null."""
    whole = pa.concat_arrays([pa.array([None if before is None else before.as_py()], column.type), column])
    now, last = whole.slice(1), whole.slice(0, len(column))
    differ = pc.fill_null(pc.not_equal(now, last), False).to_numpy(zero_copy_only=False)
    differ |= pc.xor(now.is_null(), last.is_null()).to_numpy(zero_copy_only=False)
    if before is None and len(differ):
        differ[0] = True
    return differ


def _local_sums(keys: Sequence[str], add: str, reset: str) -> object:
    """Adds to rows in order: their range, their place in it, their sum there, and whether nothing started anew before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, total, lead = TaskContext.get().partitionId(), 0, 0, True
        last: list[pa.Scalar | None] = [None] * len(keys)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = reduce(np.logical_or, [_changes(batch.column(k), x) for k, x in zip(keys, last, strict=True)])
            anew = batch.column(reset).to_numpy(zero_copy_only=False) | fresh
            through = np.cumsum(batch.column(add).to_numpy(zero_copy_only=False))
            start = np.maximum.accumulate(np.where(anew, np.arange(n), -1))  # the row that a row's sum starts at
            before = np.where(start > 0, through[start - 1], 0)
            sums = through - before + np.where(start < 0, total, 0)
            group = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            plain = np.cumsum(batch.column(reset).to_numpy(zero_copy_only=False))
            seen = plain - np.where(group > 0, plain[group - 1], 0)  # new starts in the group so far
            leads = (seen == 0) & ((group >= 0) | lead)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, "i4")), pa.array(np.arange(place, place + n)), pa.array(sums), pa.array(leads)], [*batch.schema.names, *_EXTRA])
            place, total, lead = place + n, int(sums[-1]), bool(leads[-1])
            last = [batch.column(k)[n - 1] for k in keys]

    return run


_EXTRA = ["part", "place", "sum", "lead"]


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], add: Column, reset: Column | None = None, name: str = "total") -> DataFrame:
    """rows with the sum of `add` (a whole number, null counts 0) over their group's rows up to them, from the last row where `reset` holds on.

    Groups are rows with equal keys (null equals null), in ascending order (nulls first); rows that tie in all of it follow one
    another in any order. An empty table gives an empty one.
    """
    own = unused([*rows.columns, name], 2)
    marked = rows.withColumns({own[0]: F.coalesce(add.cast("long"), F.lit(0)), own[1]: F.coalesce(F.lit(False) if reset is None else reset, F.lit(False))})
    inner = [f"c{i}" for i in range(len(marked.columns))]  # so that no name is ambiguous
    renamed = dict(zip(marked.columns, inner, strict=True))
    plain = marked.toDF(*inner)
    of, by = [renamed[k] for k in keys], [renamed[c] for c in order]
    ranged = plain.repartitionByRange(*of, *by).sortWithinPartitions(*of, *by)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", part int, place long, sum long, lead boolean"
    local = written(ranged.mapInArrow(_local_sums(of, inner[-2], inner[-1]), schema), "ranges")

    ends = local.groupBy(*of, "part").agg(F.max_by("sum", "place").alias("last"), F.bool_and("lead").alias("open"))
    w = W.partitionBy(*of).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("last").over(w), F.lit(0)))
    ends = ends.withColumn("base", F.coalesce(F.last(F.when(~F.col("open"), F.col("before")), ignorenulls=True).over(w), F.lit(0)))
    carried = ends.select(*[F.col(k).alias(f"of_{k}") for k in of], F.col("part").alias("in_part"), (F.col("before") - F.col("base")).alias("carry")).where("carry != 0")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in of], F.col("part") == F.col("in_part"))
    out = local.join(F.broadcast(carried), same, "left")  # a row a range at most
    total = F.col("sum") + F.when(F.col("lead"), F.coalesce("carry", F.lit(0))).otherwise(0)
    return out.select(*[F.col(renamed[c]).alias(c) for c in rows.columns if c != name], total.alias(name))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """rows with their place in their group, from 1."""
    return running_sum(rows, keys, order, F.lit(1), None, name)
