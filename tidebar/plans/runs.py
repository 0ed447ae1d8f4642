"""Processing of days in order, once each, over any number of runs.

A store keeps the rows that were made of each day and a registry of the days done. A run works on the days that are due:
those not registered, in order, up to the first incomplete one. It writes the rows of all of them, and only then the
registry's entry for each; the entry's own success marker is what counts. So a run that breaks off before it leaves rows
that nobody reads, the next one does these days again, and a run that is repeated under its name does nothing.

One writer at a time. All writes are distributed; nothing passes the driver but the question whether a marker is there.

Edge cases: no due day registers an empty run. Days without any row are registered like others. Rows of an unregistered
run are never read, whatever it left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.plans.ledger import catch_up_days
from tidebar.session import path_exists

ENTRY = "day date, run string"


class DayStore:
    """Folder with ``rows/run=<run>`` and ``log/<run>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def runs(self) -> list[str]:
        """Paths of the registry's entries that were written to the end."""
        return [f"{self.root}/log/*"] if path_exists(self.spark, f"{self.root}/log") else []

    def done(self) -> DataFrame:
        """(day, run) of every day done."""
        paths = self.runs()
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def due(self, days: DataFrame, complete: DataFrame) -> DataFrame:
        """Days to do next, of the expected ``days`` (day), up to the first that is not in ``complete`` (day)."""
        return catch_up_days(days, self.done(), complete)

    def write_rows(self, run: str, days: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """The rows of ``days``, over what a broken run of this name left; ``make`` returns them with their day."""
        make(days).write.mode("overwrite").parquet(f"{self.root}/rows/run={run}")

    def register(self, run: str, days: DataFrame) -> None:
        days.select(F.col("day").cast("date").alias("day"), F.lit(run).alias("run")).write.mode("overwrite").parquet(f"{self.root}/log/{run}")

    def run(self, run: str, days: DataFrame, complete: DataFrame, make: Callable[[DataFrame], DataFrame]) -> bool:
        """Do what is due; False if this run was registered before."""
        if path_exists(self.spark, f"{self.root}/log/{run}/_SUCCESS"):
            return False
        due = self.due(days, complete)
        self.write_rows(run, due, make)
        # what is due follows from the registry, which has not changed since: the same days again
        self.register(run, due)
        return True

    def rows(self, schema: str) -> DataFrame:
        """All rows of days done, with their run."""
        done = self.done()
        if not path_exists(self.spark, f"{self.root}/rows"):
            return self.spark.createDataFrame([], f"{schema}, day date, run string")
        read = self.spark.read.schema(f"{schema}, day date, run string").parquet(f"{self.root}/rows")
        return read.join(done, ["day", "run"], "left_semi")
