"""Pages of an ordered listing that read only the files they lie in."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FILE_ROWS = 100_000


def _place(path: str) -> tuple[int, int]:
    """Range and running number of a written file: files are named after both."""
    return tuple(int(n) for n in re.search(r"part-(\d+)-.*c(\d+)[^/]*$", path).groups())


class Pages:
    """Rows laid out once in order, with an order-statistic index: the rows before each file.

    The index has a line per file and is all that reaches the driver. A page opens the one or two files that hold it
    (more only where files are shorter than a page), whatever its number, and puts just their rows in order.
    """

    def __init__(self, spark: SparkSession, root: str, order: list[Column], schema):
        self.spark, self.order, self.schema = spark, order, schema
        counts = spark.read.schema(schema).parquet(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
        listed = sorted((_place(r["path"]), r["path"], r["n"]) for r in counts.collect())
        self.paths = [path for _, path, _ in listed]
        self.before = [0, *accumulate(n for _, _, n in listed)]
        self.total = self.before[-1]

    @staticmethod
    def laid_out(df: DataFrame, order: list[Column], root: str, file_rows: int = FILE_ROWS) -> Pages:
        """Write ``df`` in order to ``root``; ``order`` must end in a unique column."""
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", str(file_rows)).parquet(root)
        return Pages(df.sparkSession, root, order, df.schema)

    def span(self, number: int, size: int) -> tuple[int, int, int]:
        """Page (a number past the end gives the last one) and the half-open range of its rows."""
        last = max(1, -(-self.total // size))
        number = min(max(1, number), last)
        return number, (number - 1) * size, min(number * size, self.total)

    def files(self, low: int, high: int) -> tuple[int, int]:
        """Files that hold rows low..high: first and one behind the last."""
        return bisect_right(self.before, low) - 1, bisect_right(self.before, max(low, high - 1))

    def page(self, number: int, size: int = 20) -> DataFrame:
        """Rows of the page with ``position`` (from 1) and ``page``."""
        number, low, high = self.span(number, size)
        if high <= low:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn("position", F.lit(0).cast("bigint")).withColumn("page", F.lit(number))
        first, behind = self.files(low, high)
        rows = self.spark.read.schema(self.schema).parquet(*self.paths[first:behind])
        position = F.row_number().over(Window.partitionBy().orderBy(*self.order)) + F.lit(self.before[first]).cast("bigint")
        return rows.withColumn("position", position).filter(F.col("position").between(low + 1, high)).withColumn("page", F.lit(number))
