"""One order over all tasks: running totals, the last mark before each row, and intervals that meet.

Rows are range-partitioned and sorted, each task works on its own run of the order, and what a run needs from those before
is one row a task. No window goes over the whole table, and nothing comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.sources.files import written

#: Rows of an order that a task should have; tables of fewer rows have as many tasks as shuffles have partitions.
RUN_ROWS = 4_000_000


def fresh(rows: DataFrame, name: str) -> str:
    """name, with underscores until no column of rows has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _runs(rows: DataFrame, runs: int | None) -> int:
    """How many tasks an order of rows, a written table, takes; its files' footers tell the count."""
    return runs or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RUN_ROWS))


def placed(rows: DataFrame, order: list, runs: int, run: str) -> DataFrame:
    """rows in one order: sorted in each partition, whose number `run` holds."""
    return rows.repartitionByRange(runs, *order).sortWithinPartitions(*order).withColumn(run, F.spark_partition_id())


def _totals(place: int, out: str):
    """For mapInArrow: adds the sum of the column at `place` over the task's rows before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = pc.fill_null(batch.column(place).cast(pa.int64()), 0).to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], [*batch.schema.names, out])
            total = int(ends[-1]) if len(ends) else total

    return run


def _starts(runs: DataFrame) -> DataFrame:
    """(run, size) rows, one a task, to (run, start): the sum of the sizes before."""
    ordered = runs.coalesce(1).sortWithinPartitions("run")
    return ordered.mapInArrow(_totals(1, "start"), "run int, size long, start long").select("run", "start")


def at_starts(rows: DataFrame, run: str, inside: str, size: str) -> DataFrame:
    """rows of a written table with `inside` raised from a sum inside its run to a sum over all runs before as well; `run` goes."""
    sizes = rows.groupBy(F.col(run).alias("run")).agg(F.max(F.col(inside) + F.coalesce(F.col(size), F.lit(0))).cast("long").alias("size"))
    starts = _starts(sizes.select("run", "size")).select(F.col("run").alias(run), F.col("start").alias("start__"))
    return rows.join(F.broadcast(starts), run).withColumn(inside, F.col(inside) + F.col("start__")).drop(run, "start__")


def running_total(rows: DataFrame, order: str | list[str], value: str, out: str, runs: int | None = None) -> DataFrame:
    """Adds `out`, the sum of `value` (whole numbers, null as 0) over all rows before in `order`, of any types that sort, then in `value`.

    rows are worked out once and should be slim: they are written to the shared folder, as is their order.
    """
    rows = written(rows, "unordered")
    run = fresh(rows, "run")
    inside = placed(rows, [*([order] if isinstance(order, str) else order), value], _runs(rows, runs), run)
    schema = T.StructType([*inside.schema, T.StructField(out, T.LongType())])
    inside = written(inside.mapInArrow(_totals(inside.columns.index(value), out), schema), "ordered")
    return at_starts(inside, run, out, value)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, (run, row, mark), to the rows with the last mark up to each; at the end one row with the task's last mark."""
    last, run = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column("run").slice(0, 1)
        marks = batch.column("mark")
        marks = pa.concat_arrays([last if last is not None else pa.nulls(1, marks.type), marks])
        at = np.maximum.accumulate(np.where(marks.is_valid().to_numpy(zero_copy_only=False), np.arange(len(marks)), 0))
        marks = marks.take(pa.array(at))
        last = marks.slice(len(marks) - 1)
        own = np.flatnonzero(batch.column("row").is_valid().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch.column("run").take(pa.array(own)), batch.column("row").take(pa.array(own)), marks.take(pa.array(own + 1))], ["run", "row", "mark"])
        kind = batch.column("row").type
    if run is not None:
        yield pa.RecordBatch.from_arrays([run, pa.nulls(1, kind), last], ["run", "row", "mark"])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, mark), a row a task in order, to the last mark of the tasks before."""
    last = None
    for batch in batches:
        marks = batch.column("mark")
        marks = pa.concat_arrays([last if last is not None else pa.nulls(1, marks.type), marks])
        at = np.maximum.accumulate(np.where(marks.is_valid().to_numpy(zero_copy_only=False), np.arange(len(marks)), 0))
        marks = marks.take(pa.array(at))
        last = marks.slice(len(marks) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("run"), marks.slice(0, len(marks) - 1)], ["run", "carried"])


def last_mark(rows: DataFrame, at: str, marks: DataFrame, mark_at: str, runs: int | None = None) -> DataFrame:
    """(row, mark) structs: each row with the mark of the greatest `mark_at` up to its `at`; null where there is none.

    Rows and marks are put in one order together, so neither side is broadcast or sorted by one task; rows of one position
    may be any number, as their own order goes on by row. Of marks at one place any may be taken. A null position has no mark.
    """
    row, mark = F.struct(*map(F.col, rows.columns)), F.struct(*map(F.col, marks.columns))
    row_type, mark_type = rows.select(row.alias("s")).schema["s"].dataType, marks.select(mark.alias("s")).schema["s"].dataType
    number = F.monotonically_increasing_id().alias("number")
    own = rows.select(F.col(at).cast("long").alias("at"), F.lit(1).alias("kind"), number, row.alias("row"), F.lit(None).cast(mark_type).alias("mark"))
    their = marks.select(F.col(mark_at).cast("long").alias("at"), F.lit(0).alias("kind"), number, F.lit(None).cast(row_type).alias("row"), mark.alias("mark"))
    both = written(own.unionByName(their.filter("at is not null")), "marks")
    both = placed(both, ["at", "kind", "number"], _runs(both, runs), "run").select("run", "row", "mark")
    filled = written(both.mapInArrow(_filled, both.schema), "marked")
    tails = filled.filter("row is null").select("run", "mark").coalesce(1).sortWithinPartitions("run")
    carried = tails.mapInArrow(_carried, T.StructType([filled.schema["run"], T.StructField("carried", mark_type)]))
    return filled.filter("row is not null").join(F.broadcast(carried), "run").select("row", F.coalesce("mark", "carried").alias("mark"))


def binned(rows: DataFrame, low: str, high: str, width: int, bin_: str) -> DataFrame:
    """rows once for each stretch of `width` that their interval from low to before high reaches into; empty intervals go."""
    first, last = F.floor(F.col(low) / width).cast("long"), F.floor((F.col(high) - 1) / width).cast("long")
    return rows.filter(F.col(low) < F.col(high)).withColumn(bin_, F.explode(F.sequence(first, last)))


def overlaps(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: int) -> DataFrame:
    """Each pair of rows whose intervals [low, high) meet, once, by an equality join on bins of `width`.

    No column may have the same name on both sides. Rows of a side are as many as the bins that it reaches into, so work
    grows with the lengths of both sides over the width, and with the pairs.
    """
    (a, b), (c, d) = left_range, right_range
    met = binned(left, a, b, width, "bin__").join(binned(right, c, d, width, "bin__"), "bin__")
    begin = F.greatest(F.col(a), F.col(c))
    return met.filter((begin < F.least(F.col(b), F.col(d))) & (F.col("bin__") == F.floor(begin / width))).drop("bin__")
