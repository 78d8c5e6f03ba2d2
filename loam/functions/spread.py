"""Small inputs of heavy Python stages over all cores, and joins of tables that both grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes for each core below which an input is too small to keep all cores busy as it is read.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deals a small input out to all cores; a large one, which has partitions enough, is left where it lies.

    The optimizer's size estimate decides, so nothing runs here and no more than SMALL bytes a core are ever moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if not df.isStreaming and size < cores * SMALL else df


def shuffled(df: DataFrame) -> DataFrame:
    """A side of an equi-join whose two sides both grow with the input: the join is planned by shuffles.

    The planner goes by the bytes of files, which say little: of repeating texts 5 MB of Parquet are more in memory than a
    driver has, and a side under the threshold on disk would be sent through it whole.
    """
    return df.hint("merge")
