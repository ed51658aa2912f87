"""Cut points that survive lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir; a temporary one only in local mode and where it names none."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not given and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="icspark-"))
    return given or context._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, so its rows and partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ranked(df: DataFrame, by: list[str], name: str = "_i") -> tuple[DataFrame, int]:
    """(df with the position of each row in the order of `by` from 0, number of rows).

    Rows are range-partitioned and sorted, so no task holds the table; one count a partition reaches the driver.
    """
    keys = [F.col(f"`{c}`") for c in by]
    # range bounds are sampled anew by each run: the positions need one written order
    held = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = dict(held.groupBy("_p").count().collect())
    total, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    before = F.array(*[F.lit(o).cast("long") for o in offsets or [0]])
    within = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return held.withColumn(name, F.get(before, F.col("_p")) + within).drop("_p", "_m"), total
