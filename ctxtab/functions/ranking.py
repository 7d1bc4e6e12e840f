"""Global ordering without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row to one task.  The
helpers here range-partition and sort the rows once, number them inside each
partition (``monotonically_increasing_id`` holds the partition in its high
bits) and add the rows of earlier partitions -- the DataFrame form of
``zipWithIndex``.  The sorted rows are written to the reliable checkpoint
folder, so that the offsets and the rows come from the same range bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxtab.session import cut_lineage

_LOW = 33  # bits of monotonically_increasing_id that count inside a partition


def _range_sorted(df: DataFrame, order: list[str | Column], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def global_index(df: DataFrame, order: list[str | Column], name: str = "idx", partitions: int | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """0-based position in the global ``order`` (exact, one shuffle); only the columns ``keep`` are written, if given."""
    s = _range_sorted(df, order, partitions).withColumn("_mid", F.monotonically_increasing_id())
    s = cut_lineage(s if keep is None else s.select(*keep, "_mid"))
    pid = F.shiftright("_mid", _LOW)
    per = s.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_pc"))  # a row for each partition
    # kept, as every job on the result would scan all rows for them
    offs = cut_lineage(per.select("_pid", (F.sum("_pc").over(Window.orderBy("_pid")) - F.col("_pc")).alias("_off")))
    return (s.withColumn("_pid", pid).join(F.broadcast(offs), "_pid")
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << _LOW) - 1)))
            .drop("_mid", "_pid", "_off"))


def prefix_sum(df: DataFrame, order: list[str], weight: str, name: str = "_before", partitions: int | None = None) -> DataFrame:
    """Per row: the sum of ``weight`` (long) over the rows that come strictly before it in ``order`` (a total order)."""
    s = _range_sorted(df, order, partitions).withColumn("_mid", F.monotonically_increasing_id())
    schema = T.StructType([*s.schema.fields, T.StructField("_local", T.LongType())])

    def running(batches):
        total = 0
        for b in batches:
            w = b.column(weight).fill_null(0).to_numpy().astype(np.int64)
            ends = total + np.cumsum(w)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - w)], [*b.schema.names, "_local"])

    s = cut_lineage(s.mapInArrow(running, schema).withColumn("_pid", F.shiftright("_mid", _LOW)))
    per = s.groupBy("_pid").agg(F.sum(F.coalesce(F.col(weight), F.lit(0))).alias("_pc"))
    # kept, as every job on the result would scan all rows for them
    offs = cut_lineage(per.select("_pid", (F.sum("_pc").over(Window.orderBy("_pid")) - F.col("_pc")).alias("_off")))
    return (s.join(F.broadcast(offs), "_pid").withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_mid", "_pid", "_off", "_local"))
