"""Wall-clock events around actions, and the log of queries."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QLOG


class Timer:
    """Named events and how long they took, in microseconds."""

    def __init__(self):
        self.events: list[tuple[str, int]] = []

    @contextmanager
    def event(self, name: str) -> Iterator[None]:
        began = time.perf_counter_ns()
        try:
            yield
        finally:
            self.events.append((name, (time.perf_counter_ns() - began) // 1000))

    def total(self, name: str | None = None) -> int:
        return sum(us for n, us in self.events if name in (None, n))

    def table(self, spark: SparkSession) -> DataFrame:
        """event, runs, total_us, mean_us."""
        df = spark.createDataFrame(self.events, "event STRING, us BIGINT")
        return df.groupBy("event").agg(F.count("*").alias("runs"), F.sum("us").alias("total_us"), F.avg("us").alias("mean_us"))


def log_query(spark: SparkSession, to: str, row: tuple) -> None:
    """Append one query's row (path, epoch, begin, end, selectivities, microseconds) to a log; nothing is rewritten."""
    spark.createDataFrame([row], QLOG).coalesce(1).write.mode("append").option("header", True).csv(to)
