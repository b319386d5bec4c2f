"""Pages at any depth: rows laid out by (created_utc, id) in files of which the first and last key and the number of rows are known.

A page, by its cursor or by its number, reads the few files that hold it, however deep it is: their names come from a table
with a row per file. The files also have created_utc as a number (key_micros), as Parquet keeps no statistics of Spark's timestamps;
by it a cursor skips the row groups after it.

Layout under the folder: rows/ (sorted files that don't overlap) and files/ (file, lo, hi, n, newer: the rows in later files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import shared_folder
from .activity import page

#: About how many rows a file holds.
FILE_ROWS = 500_000


class PageLayout:
    """The layout in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = spark.read.parquet(f"{self.folder}/files")

    @classmethod
    def write(cls, rows: DataFrame, folder: str | None = None, file_rows: int = FILE_ROWS) -> PageLayout:
        """Lay out rows (created_utc, id and any others but key_micros). Rows without one of the two have no place in a page and are left out.

        An empty table makes a layout without pages. Rows of one key stay in one file.
        """
        spark = rows.sparkSession
        folder = (folder or shared_folder(spark)).rstrip("/")
        rows = rows.where("created_utc IS NOT NULL AND id IS NOT NULL")
        n_files = max(1, -(-rows.count() // file_rows))
        timed = rows.withColumn("key_micros", F.unix_micros(F.col("created_utc").cast("timestamp")))
        timed.repartitionByRange(n_files, "created_utc", "id").sortWithinPartitions("created_utc", "id").write.parquet(f"{folder}/rows")
        laid = spark.read.schema(timed.schema).parquet(f"{folder}/rows")
        key = F.struct("created_utc", "id")
        each = laid.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
        later = Window.orderBy(F.desc("hi"), F.desc("lo")).rowsBetween(Window.unboundedPreceding, -1)  # over a row per file
        each.withColumn("newer", F.coalesce(F.sum("n").over(later), F.lit(0))).coalesce(1).write.parquet(f"{folder}/files")
        return cls(spark, folder)

    def _read(self, files: DataFrame) -> DataFrame:
        """The rows of the few files chosen."""
        names = [f"{self.folder}/rows/{r.file}" for r in files.select("file").collect()]
        if not names:
            return self.spark.read.parquet(f"{self.folder}/rows").limit(0)
        return self.spark.read.parquet(*names)

    def files_of_page(self, limit: int, before: tuple | None = None) -> DataFrame:
        """The files that hold the limit + 1 rows before a key: the newest with such rows and those after it as far as needed."""
        files = self.files
        if before:
            at, key = before
            files = files.where((F.col("lo.created_utc") < F.lit(at)) | ((F.col("lo.created_utc") == F.lit(at)) & (F.col("lo.id") < F.lit(key))))
        first = files.agg(F.min("newer").alias("newer"), F.min_by("n", "newer").alias("n")).first()
        # Any number of the first file's rows may lie after the key.
        return files.where(F.col("newer") < (first.newer or 0) + (first.n or 0) + limit + 1)

    def page(self, limit: int, before: tuple | None = None) -> DataFrame:
        """activity.page of the rows."""
        rows = self._read(self.files_of_page(limit, before))
        if before:
            rows = rows.where(F.col("key_micros") <= F.unix_micros(F.lit(before[0]).cast("timestamp")))
        return page(rows.drop("key_micros"), limit, before)

    def files_of_number(self, number: int, size: int) -> DataFrame:
        """The files that hold a page by its number (from 0, newest first)."""
        return self.files.where((F.col("newer") < (number + 1) * size) & (F.col("newer") + F.col("n") > number * size))

    def numbered(self, number: int, size: int) -> DataFrame:
        """The rows of a page by its number with their place (from 0 over all rows); pages past the last are empty."""
        files = self.files_of_number(number, size)
        skipped = files.agg(F.min("newer").alias("newer")).first().newer or 0
        newest = [F.desc("created_utc"), F.desc("id")]
        rows = self._read(files).orderBy(*newest).limit((number + 1) * size - skipped)  # a file and a page at most
        placed = rows.withColumn("place", F.row_number().over(Window.orderBy(*newest)) - 1 + F.lit(skipped))
        return placed.where(F.col("place") >= number * size).withColumn("place", F.col("place").cast("long")).drop("key_micros")

    def n_rows(self) -> int:
        return self.files.agg(F.sum("n").alias("n")).first().n or 0
